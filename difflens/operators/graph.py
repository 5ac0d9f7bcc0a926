"""Graphs of chunks, many small ones at once: a graph is the edges of one range_id."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["range_id", "src", "dst"]


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder; sets a folder only where none is set, as in local tests."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="difflens-"))
    return df.checkpoint()


#: Rows that a task groups, see spread().
PART_ROWS = 1 << 18


def parts_of(rows: DataFrame) -> int:
    """How many parts hold some PART_ROWS each."""
    return rows.count() // PART_ROWS + 1


def spread(rows: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """rows dealt by keys over parts (parts_of them), for grouping by keys (and more).

    Left alone, Spark groups within each input split first, which holds more the larger the input is, and merges what it
    deals then up to a size as compressed; a task's memory follows both. Where few rows are equal that saves nothing.
    """
    return rows.repartition(parts or parts_of(rows), *keys)


#: Nodes of a graph that fits a row: a bit of a long each.
ROW_NODES = 64


def _with(value: Column, f) -> Column:
    """f of a value that is computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _has(bits: Column, i: Column) -> Column:
    return F.getbit(bits, i) == 1


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _leads(nodes: Column, ends: Column) -> Column:
    """For each node the set of those that ends (structs of a, b) lead it to in one step, as bits."""
    at = lambda x: F.array_position(nodes, x).cast("int") - 1
    none = F.lit(0).cast("long")
    steps = F.transform(ends, lambda e: F.struct(at(e["a"]).alias("a"), _bit(at(e["b"])).alias("b")))
    return _with(steps, lambda st: F.transform(nodes, lambda _, i: F.aggregate(F.filter(st, lambda s: s["a"] == i), none, lambda m, s: m.bitwiseOR(s["b"]))))


def _reach(out: Column, skip: Column | None = None) -> Column:
    """For each node the set of those that it leads to in any number of steps; paths don't pass through skip (a number)."""

    def through(acc, k):
        longer = F.transform(acc, lambda m: F.when(_has(m, k), m.bitwiseOR(F.get(acc, k))).otherwise(m))
        return longer if skip is None else F.when(k == skip, acc).otherwise(longer)

    return F.aggregate(F.sequence(F.lit(0), F.size(out) - 1), out, through)


def in_rows(edges: DataFrame, keys: list[str], both_ways: bool = False) -> tuple[DataFrame, DataFrame]:
    """Graphs (edges of one value of keys, without self-edges) of at most ROW_NODES nodes, a row each: keys, nodes (sorted),
    reach (for each node the set of those that it leads to, as bits), ends; and the distinct edges of larger graphs.
    """
    e = edges.where("src <> dst").select(*keys, "src", "dst")
    # a graph of n edges has 2n nodes at most: only those with more rows are counted exactly
    many = e.groupBy(*keys).count().where(F.col("count") > ROW_NODES // 2).select(*keys)
    counted = e.join(many, keys, "left_semi").select(*keys, F.explode(F.array("src", "dst")).alias("node")).groupBy(*keys).agg(F.count_distinct("node").alias("n"))
    large = cut(counted.where(F.col("n") > ROW_NODES).select(*keys))
    some = not large.isEmpty()
    small = e.join(large, keys, "left_anti") if some else e
    g = small.groupBy(*keys).agg(F.collect_set(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))).alias("ends"))
    if both_ways:
        g = g.withColumn("ends", F.concat("ends", F.transform("ends", lambda s: F.struct(s["b"].alias("a"), s["a"].alias("b")))))
    sorted_ = F.array_sort(F.array_distinct(F.concat(F.transform("ends", lambda s: s["a"]), F.transform("ends", lambda s: s["b"]))))
    x = _with(sorted_, lambda nodes: F.struct(nodes.alias("nodes"), _with(_leads(nodes, F.col("ends")), lambda out: _reach(out)).alias("reach")))
    rows = g.withColumn("x", x).select(*keys, "x.nodes", "x.reach", "ends")
    rest = (e.join(large, keys, "left_semi") if some else e.where("false")).distinct()
    return rows, rest


def _each(rows: DataFrame, keys: list[str], *of) -> DataFrame:
    """keys, node and the columns that of (name, a function of nodes, reach and a node's number) give, a row a node."""
    nodes, reach = F.col("nodes"), F.col("reach")
    one = F.transform(nodes, lambda v, i: F.struct(v.alias("node"), *(f(nodes, reach, i).alias(name) for name, f in of)))
    return rows.select(*keys, F.explode(one).alias("r")).select(*keys, "r.*")


def _least(bits: Column, nodes: Column) -> Column:
    """The first of the nodes in a set."""
    return F.get(F.filter(nodes, lambda v, k: _has(bits, k)), F.lit(0))


def _cycle_of(nodes: Column, reach: Column, i: Column) -> Column:
    """The smallest node that a node leads to and that leads back, null without one."""
    mine = F.get(reach, i)
    return F.when(_has(mine, i), F.get(F.filter(nodes, lambda v, k: _has(mine, k) & _has(F.get(reach, k), i)), F.lit(0)))


def _depths(reach: Column) -> Column:
    """For each node the longest chain of nodes below it, cycles as one. What a node leads to beyond its cycle leads to fewer itself, and so comes before."""
    zero, numbers = F.lit(0), F.sequence(F.lit(0), F.size(reach) - 1)
    order = F.array_sort(F.transform(reach, lambda m, i: F.struct(F.bit_count(m.bitwiseOR(_bit(i))).alias("n"), i.alias("i"))))

    def place(acc, o):
        below = F.filter(numbers, lambda k: _has(F.get(reach, o["i"]), k) & ~_has(F.get(reach, k), o["i"]))
        mine = F.coalesce(F.array_max(F.transform(below, lambda k: F.get(acc, k) + 1)), zero)
        return F.transform(acc, lambda d, k: F.when(k == o["i"], mine).otherwise(d))

    return F.aggregate(order, F.transform(reach, lambda m: zero), place)


def assemble(edges: DataFrame) -> DataFrame:
    """range_id, src, dst, kind, source, n_ranges: one edge a key without self-edges, the best source, adjacent lines merged."""
    e = spread(edges.where("src <> dst").select(*KEYS, "kind", "source", "line"), *KEYS, "kind")
    rank = F.when(F.col("source") == "references", 0).when(F.col("source") == "test-anchor", 1).otherwise(2)
    # a range begins where the line before is missing; all lines without a number are one
    w = Window.partitionBy(*KEYS, "kind").orderBy("line")
    last, line = F.lag("line").over(w), F.col("line")
    new = F.coalesce(line > last + 1, last.isNull() & (line.isNotNull() | (F.row_number().over(w) == 1)))
    d = e.withColumn("new", new).groupBy(*KEYS, "kind").agg(F.min(F.struct(rank.alias("rank"), "source")).alias("best"), F.count_if("new").alias("n_ranges"))
    return d.select(*KEYS, "kind", "best.source", "n_ranges")


def coalesce_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: overlapping or adjacent ranges merged."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = ranges.distinct().withColumn("new", F.coalesce((F.col("start") > seen + 1).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    return d.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def neighbors(edges: DataFrame) -> DataFrame:
    """range_id, node, other, kind, direction: distinct edges in both directions."""
    e = edges.where("src <> dst").select(*KEYS, "kind").distinct()
    out = e.select("range_id", F.col("src").alias("node"), F.col("dst").alias("other"), "kind", F.lit("out").alias("direction"))
    return out.unionByName(e.select("range_id", F.col("dst").alias("node"), F.col("src").alias("other"), "kind", F.lit("in").alias("direction")))


def closure(edges: DataFrame) -> DataFrame:
    """range_id, src, dst: all pairs with a path: small ranges by row (in_rows), larger ones in rounds."""
    rows, rest = in_rows(edges, ["range_id"])
    met = _each(rows, ["range_id"], ("to", lambda nodes, reach, i: F.filter(nodes, lambda v, k: _has(F.get(reach, i), k))))
    pairs = met.select("range_id", F.col("node").alias("src"), F.explode("to").alias("dst"))
    return pairs if rest.isEmpty() else pairs.unionByName(_closure_in_rounds(rest))


def _closure_in_rounds(edges: DataFrame) -> DataFrame:
    """Each round joins the newest pairs to all known ones, so lengths double and rounds grow with the logarithm of the longest shortest path."""
    reach = fresh = cut(edges.where("src <> dst").select(*KEYS).distinct())
    while True:
        step = reach.select("range_id", F.col("src").alias("dst"), F.col("dst").alias("far"))
        longer = fresh.join(step, ["range_id", "dst"]).select("range_id", "src", F.col("far").alias("dst")).distinct()
        fresh = cut(longer.join(reach, KEYS, "left_anti"))
        if fresh.isEmpty():
            return reach
        reach = cut(reach.unionByName(fresh))


def cycles(reach: DataFrame) -> DataFrame:
    """range_id, node, scc: nodes on a cycle with the smallest node that they reach both ways."""
    back = reach.select("range_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = reach.join(back, KEYS)
    return both.groupBy("range_id", F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("scc"))


def least_along(flow: DataFrame, start: DataFrame, follow: bool = True) -> DataFrame:
    """range_id, way, node, label: the smallest start label among a node and all nodes that lead to it. flow: range_id, way, at, to; start: range_id, way, node, label.

    follow: labels are nodes themselves and start as their own label; then they are followed too and travel far in few rounds.
    """
    keys, label = ["range_id", "way", "node"], start
    while True:
        near = flow.join(label.withColumnRenamed("node", "at"), ["range_id", "way", "at"]).groupBy("range_id", "way", F.col("to").alias("node")).agg(F.min("label").alias("near"))
        new = label.join(near, keys, "left").select(*keys, "label", F.least("label", "near").alias("to"))
        if follow:
            further = label.select("range_id", "way", F.col("node").alias("to"), F.col("label").alias("beyond"))
            new = new.join(further, ["range_id", "way", "to"]).withColumn("to", F.least("to", "beyond"))
        new = cut(new.select(*keys, F.col("to").alias("label"), (~F.col("to").eqNullSafe(F.col("label"))).alias("moved")))
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label


def strong(edges: DataFrame) -> DataFrame:
    """range_id, node, scc: nodes on a cycle with the smallest node of theirs, as cycles() of the closure: small ranges by row (in_rows), larger ones in turns."""
    rows, rest = in_rows(edges, ["range_id"])
    found = _each(rows, ["range_id"], ("scc", _cycle_of)).where("scc is not null")
    return found if rest.isEmpty() else found.unionByName(_strong_in_turns(rest))


def _strong_in_turns(edges: DataFrame) -> DataFrame:
    """strong() in memory that grows with the edges alone.

    Each turn first trims edges that can't lie on a cycle as they begin or end in a dead end, then gives every node the
    smallest node that leads to it and the smallest that it leads to. Where both are one, that is its cycle; a cycle can't
    hold nodes that differ in either, so edges between such nodes go. Each turn ends at least one part's smallest node.
    """
    rest, found = cut(edges.where("src <> dst").select(*KEYS).distinct()), None
    while not rest.isEmpty():
        for _ in range(2):
            entered, left = rest.select("range_id", F.col("dst").alias("src")).distinct(), rest.select("range_id", F.col("src").alias("dst")).distinct()
            rest = rest.join(entered, ["range_id", "src"], "left_semi").join(left, ["range_id", "dst"], "left_semi")
        rest = cut(rest.select(*KEYS))
        flow = cut(rest.select("range_id", F.lit(0).alias("way"), F.col("src").alias("at"), F.col("dst").alias("to")).union(rest.select("range_id", F.lit(1), "dst", "src")))
        nodes = flow.select("range_id", "way", F.col("at").alias("node")).union(flow.select("range_id", "way", "to")).distinct()
        label = least_along(flow, cut(nodes.withColumn("label", F.col("node"))))
        wide = cut(label.groupBy("range_id", "node").agg(F.min(F.when(F.col("way") == 0, F.col("label"))).alias("before"), F.min(F.when(F.col("way") == 1, F.col("label"))).alias("after")))
        same = wide.where("before = after").select("range_id", "node", F.col("before").alias("scc"))
        several = same.groupBy("range_id", "scc").count().where("count > 1").select("range_id", "scc")
        mine = same.join(several, ["range_id", "scc"], "left_semi").select("range_id", "node", "scc")
        found = mine if found is None else found.unionByName(mine)
        open_ = wide.where("before <> after")
        end = lambda c: open_.select("range_id", F.col("node").alias(c), F.struct("before", "after").alias(f"{c}_mark"))
        rest = cut(rest.join(end("src"), ["range_id", "src"]).join(end("dst"), ["range_id", "dst"]).where("src_mark = dst_mark").select(*KEYS))
    nothing = edges.select("range_id", F.col("src").alias("node"), F.col("src").alias("scc")).where(F.lit(False))
    return nothing if found is None else cut(found)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """range_id, node, component: the smallest node that edges lead to in either direction: small ranges by row (in_rows), larger ones in rounds. nodes: range_id, node."""
    rows, rest = in_rows(edges, ["range_id"], both_ways=True)
    placed = _each(rows, ["range_id"], ("component", lambda nodes, reach, i: _least(F.get(reach, i), nodes)))
    if not rest.isEmpty():
        ends = rest.select("range_id", F.col("src").alias("node")).union(rest.select("range_id", "dst")).distinct()
        placed = placed.unionByName(_components_in_rounds(rest, ends))
    return nodes.select("range_id", "node").distinct().join(placed.hint("merge"), ["range_id", "node"], "left").select("range_id", "node", F.coalesce("component", "node").alias("component"))


def _components_in_rounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each round takes the least label around and then that label's own, so that long paths need few rounds."""
    e = edges.where("src <> dst")
    both = cut(e.select("range_id", F.col("src").alias("node"), F.col("dst").alias("other")).union(e.select("range_id", "dst", "src")).distinct())
    label = cut(nodes.select("range_id", "node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(label, ["range_id", "node"]).groupBy("range_id", F.col("other").alias("node")).agg(F.min("component").alias("near"))
        least = label.join(near, ["range_id", "node"], "left").select("range_id", "node", "component", F.least("component", "near").alias("to"))
        root = label.select("range_id", F.col("node").alias("to"), F.col("component").alias("root"))
        new = cut(least.join(root, ["range_id", "to"]).select("range_id", "node", "component", F.least("to", "root").alias("new")))
        label = new.select("range_id", "node", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return label


def source_cycles(edges: DataFrame, sccs: DataFrame) -> DataFrame:
    """range_id, scc, first_node: cycles that no edge enters from outside, with their earliest node."""
    e = edges.where("src <> dst").select(*KEYS).distinct()
    a = sccs.select("range_id", F.col("node").alias("src"), F.col("scc").alias("scc_src"))
    b = sccs.select("range_id", F.col("node").alias("dst"), F.col("scc").alias("scc_dst"))
    entered = e.join(b, ["range_id", "dst"]).join(a, ["range_id", "src"], "left").where("scc_src is null or scc_src <> scc_dst").select("range_id", F.col("scc_dst").alias("scc")).distinct()
    return sccs.groupBy("range_id", "scc").agg(F.min("node").alias("first_node")).join(entered, ["range_id", "scc"], "left_anti")


def order_check(edges: DataFrame, sccs: DataFrame) -> DataFrame:
    """range_id, src, dst, category: edges whose target stands after their source; in one cycle that is no inversion."""
    late = edges.where("src < dst").select(*KEYS).distinct()
    end = lambda c: sccs.select("range_id", F.col("node").alias(c), F.col("scc").alias(f"{c}_scc"))
    met = late.join(end("src"), ["range_id", "src"], "left").join(end("dst"), ["range_id", "dst"], "left")
    return met.select(*KEYS, F.when(F.col("src_scc") == F.col("dst_scc"), "cycle").otherwise("inversion").alias("category"))


def frontier(edges: DataFrame, reviewed: DataFrame) -> DataFrame:
    """range_id, interactions, frontier: call and exercise edges, and those with exactly one end reviewed. reviewed: range_id, node."""
    e = edges.where("src <> dst and kind in ('calls', 'exercises')").select(*KEYS, "kind").distinct()
    mark = lambda end: reviewed.select("range_id", F.col("node").alias(end), F.lit(True).alias(f"{end}_done"))
    j = e.join(mark("src"), ["range_id", "src"], "left").join(mark("dst"), ["range_id", "dst"], "left")
    one = F.coalesce("src_done", F.lit(False)) != F.coalesce("dst_done", F.lit(False))
    return j.groupBy("range_id").agg(F.count("*").alias("interactions"), F.count_if(one).alias("frontier"))


def _pairs(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """range_id, a, b: the distinct pairs of neighbors, a < b."""
    ends = edges.where("src <> dst").select("range_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return spread(ends, "range_id", "a", "b", parts=parts).distinct()


def free_glances(edges: DataFrame) -> DataFrame:
    """range_id, node, glances: distinct neighbors that stand before a node (nodes stand in their order)."""
    parts = parts_of(edges.where("src <> dst"))
    one = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("n")), F.struct(F.col("b").alias("node"), F.lit(1).alias("n"))))
    ends = _pairs(edges, parts).select("range_id", one.alias("x")).select("range_id", "x.*")
    return spread(ends, "range_id", "node", parts=2 * parts).groupBy("range_id", "node").agg(F.sum("n").alias("glances"))


def glance_summary(edges: DataFrame, places: DataFrame) -> DataFrame:
    """range_id, n, least, median, p90, most, mean, share: over a range's placed nodes, how many distinct neighbors stand before each; share of nodes with one at least.

    A node stands at its first place; without neighbors it has none before it; neighbors without a place don't count.
    places: range_id, node, pos.
    """
    at = spread(places.select("range_id", "node", "pos"), "range_id", "node").groupBy("range_id", "node").agg(F.min("pos").alias("pos"))
    end = lambda c: at.select("range_id", F.col("node").alias(c), F.col("pos").alias(f"{c}_pos"))
    met = _pairs(edges).join(end("a").hint("merge"), ["range_id", "a"]).join(end("b").hint("merge"), ["range_id", "b"]).where("a_pos <> b_pos")
    later = met.groupBy("range_id", F.when(F.col("a_pos") > F.col("b_pos"), F.col("a")).otherwise(F.col("b")).alias("node")).agg(F.count("*").alias("glances"))
    each = at.join(later.hint("merge"), ["range_id", "node"], "left").select("range_id", "node", F.coalesce("glances", F.lit(0)).alias("glances"))
    quantile = lambda q: F.round(F.percentile("glances", q), 6)  # noqa: E731  between two values in proportion
    share = F.round(F.count_if(F.col("glances") > 0) / F.count("*"), 6)
    return each.groupBy("range_id").agg(F.count("*").alias("n"), F.min("glances").alias("least"), quantile(0.5).alias("median"), quantile(0.9).alias("p90"), F.max("glances").alias("most"), F.round(F.avg("glances"), 6).alias("mean"), share.alias("share"))


def edge_sample(edges: DataFrame, most: int = 30, seed: str = "s") -> DataFrame:
    """kind, range_id, src, dst: at most `most` edges of a kind, those with the smallest digests. A sampling operator."""
    e = spread(edges.where("src <> dst").select("kind", *KEYS), "kind", *KEYS).distinct()
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("range_id").cast("string"), F.col("src").cast("string"), F.col("dst").cast("string")))
    # a heap of `most` a task first (min_by keeps no order), so that a kind with most edges isn't sorted by one task
    salted = e.withColumn("digest", key).withColumn("salt", F.substring("digest", 1, 2))
    w = Window.partitionBy("kind", "salt").orderBy("digest")
    top = salted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return top.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("digest"))).where(F.col("r") <= most).select("kind", *KEYS)


def depth(edges: DataFrame, sccs: DataFrame | None = None) -> DataFrame:
    """range_id, node, depth: longest path over the condensation to what depends on nothing; nodes of a cycle share a depth. Small ranges go by row (in_rows), larger ones in rounds.

    sccs: what strong() gives; without it larger ranges' cycles are found here.
    """
    rows, rest = in_rows(edges, ["range_id"])
    found = rows.withColumn("depth", _depths(F.col("reach"))).select("range_id", F.explode(F.arrays_zip("nodes", "depth")).alias("r")).select("range_id", F.col("r.nodes").alias("node"), "r.depth")
    return found if rest.isEmpty() else found.unionByName(_depth_in_rounds(rest, _strong_in_turns(rest) if sccs is None else sccs))


def _depth_in_rounds(edges: DataFrame, sccs: DataFrame) -> DataFrame:
    e = edges.where("src <> dst").select(*KEYS).distinct()
    nodes = e.select("range_id", F.col("src").alias("node")).union(e.select("range_id", "dst")).distinct()
    named = nodes.join(sccs, ["range_id", "node"], "left").select("range_id", "node", F.coalesce("scc", "node").alias("scc"))
    a = named.select("range_id", F.col("node").alias("src"), F.col("scc").alias("a"))
    b = named.select("range_id", F.col("node").alias("dst"), F.col("scc").alias("b"))
    dag = cut(e.join(a, ["range_id", "src"]).join(b, ["range_id", "dst"]).where("a <> b").select("range_id", "a", "b").distinct())
    level = cut(named.select("range_id", "scc").distinct().withColumn("depth", F.lit(0)))
    while True:
        below = level.select("range_id", F.col("scc").alias("b"), F.col("depth").alias("under"))
        least = dag.join(below, ["range_id", "b"]).groupBy("range_id", F.col("a").alias("scc")).agg((F.max("under") + 1).alias("least"))
        new = cut(level.join(least, ["range_id", "scc"], "left").select("range_id", "scc", F.greatest("depth", F.coalesce("least", F.lit(0))).alias("depth"), (F.coalesce("least", F.lit(0)) > F.col("depth")).alias("moved")))
        level = new.drop("moved")
        if new.where("moved").isEmpty():
            return named.join(level, ["range_id", "scc"]).select("range_id", "node", "depth")


def dependency_order(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """range_id, node, position: what is depended on first, ties in the nodes' own order."""
    return depths.select("range_id", "node", F.row_number().over(Window.partitionBy("range_id").orderBy("depth", "node")).alias("position"))


def behind(edges: DataFrame, reviewed: DataFrame) -> DataFrame:
    """range_id, focus, node, kind, direction, n: for each neighbor (node) of each focus, the unreviewed nodes past it along its kind and direction, the focus left out. reviewed: range_id, node.

    Small graphs of one range and kind go by row (in_rows), larger ones in rounds.
    """
    by = ["range_id", "kind"]
    rows, rest = in_rows(edges, by)
    marks = reviewed.select("range_id", "node").distinct().withColumn("done", F.lit(True))
    nodes = rows.select(*by, F.posexplode("nodes").alias("i", "node")).hint("merge").join(marks, ["range_id", "node"])
    done = nodes.groupBy(*by).agg(F.bit_or(_bit(F.col("i"))).alias("done"))
    g = rows.drop("reach").join(done, by, "left").withColumn("done", F.coalesce("done", F.lit(0).cast("long")))

    def past(direction: str, ends: Column) -> DataFrame:
        def of(out):
            # the sets that nodes lead to by paths that don't enter the focus, a focus each
            one = lambda v, f: F.when(F.get(out, f) != 0, F.struct(v.alias("focus"), f.alias("f"), F.get(out, f).alias("next"), _reach(out, f).alias("reach")))
            return F.filter(F.transform("nodes", one), lambda x: x.isNotNull())

        d = g.select(*by, "nodes", "done", F.explode(_with(_leads(F.col("nodes"), ends), of)).alias("x")).select(*by, "nodes", "done", "x.*")
        d = d.select(*by, "focus", "f", "reach", "done", F.posexplode(F.transform("nodes", lambda v, i: F.when(_has(F.col("next"), i), v))).alias("i", "node")).where("node is not null")
        left = F.get("reach", F.col("i")).bitwiseAND(F.bitwise_not(F.col("done").bitwiseOR(_bit(F.col("i"))).bitwiseOR(_bit(F.col("f")))))
        return d.select("range_id", "focus", "node", "kind", F.lit(direction).alias("direction"), F.bit_count(left).cast("long").alias("n"))

    turned = F.transform("ends", lambda s: F.struct(s["b"].alias("a"), s["a"].alias("b")))
    found = past("out", F.col("ends")).unionByName(past("in", turned))
    return found if rest.isEmpty() else found.unionByName(_behind_in_rounds(rest, reviewed))


def _behind_in_rounds(edges: DataFrame, reviewed: DataFrame) -> DataFrame:
    hop = cut(neighbors(edges))
    seeds = hop.select("range_id", F.col("node").alias("focus"), F.col("other").alias("node"), "kind", "direction")
    step = hop.select("range_id", F.col("node").alias("at"), F.col("other").alias("next"), "kind", "direction")
    keys = ["range_id", "focus", "node", "kind", "direction", "at"]
    seen = fresh = cut(seeds.withColumn("at", F.col("node")))
    while not fresh.isEmpty():
        far = fresh.join(step, ["range_id", "at", "kind", "direction"]).where("next <> focus").drop("at").withColumnRenamed("next", "at").select(*keys).distinct()
        fresh = cut(far.join(seen, keys, "left_anti"))
        seen = cut(seen.unionByName(fresh))
    done = reviewed.select("range_id", F.col("node").alias("at"), F.lit(True).alias("done"))
    n = F.count_if((F.col("at") != F.col("node")) & F.col("done").isNull())
    return seen.join(done, ["range_id", "at"], "left").groupBy(*keys[:-1]).agg(n.alias("n"))


def chips(edges: DataFrame, reviewed: DataFrame) -> DataFrame:
    """range_id, focus, node, kind, direction, action, file_level, state, frontier, rank: each focus's neighbors in reading order. edges: with source."""
    e = edges.where("src <> dst").groupBy(*KEYS, "kind").agg(F.min("source").alias("source"))  # references before test-anchor
    out = e.select("range_id", F.col("src").alias("focus"), F.col("dst").alias("node"), "kind", "source", F.lit("out").alias("direction"))
    both = out.unionByName(e.select("range_id", F.col("dst").alias("focus"), F.col("src").alias("node"), "kind", "source", F.lit("in").alias("direction")))
    mark = lambda end: reviewed.select("range_id", F.col("node").alias(end), F.lit(True).alias(f"{end}_done"))
    j = both.join(mark("node"), ["range_id", "node"], "left").join(mark("focus"), ["range_id", "focus"], "left")
    done, mine = F.coalesce("node_done", F.lit(False)), F.coalesce("focus_done", F.lit(False))
    reveal = (F.col("kind") == "exercises") & (F.col("source") == "test-anchor")
    order = F.array_position(F.array(*map(F.lit, ("calls:out", "calls:in", "exercises:in", "exercises:out", "file-imports:out", "file-imports:in"))), F.concat_ws(":", "kind", "direction"))
    rank = F.row_number().over(Window.partitionBy("range_id", "focus").orderBy(order, "node"))
    return j.select(
        "range_id", "focus", "node", "kind", "direction", F.when(reveal, "reveal").otherwise("jump").alias("action"), (reveal | (F.col("kind") == "file-imports")).alias("file_level"),
        F.when(done, "reviewed").otherwise("unreviewed").alias("state"), (~reveal & F.col("kind").isin("calls", "exercises") & (done != mine)).alias("frontier"), rank.alias("rank"),
    )


def islands(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """range_id, nodes, alone, share: nodes that no call or exercise edge touches. nodes: range_id, node."""
    e = edges.where("src <> dst and kind in ('calls', 'exercises') and range_id is not null")
    ends = e.select("range_id", F.explode(F.array("src", "dst")).alias("node"), F.lit(True).alias("linked"))
    marked = spread(nodes.select("range_id", "node", F.lit(False).alias("linked")).unionByName(ends), "range_id", "node")
    each = marked.groupBy("range_id", "node").agg(F.bool_or("linked").alias("linked"), F.bool_or(~F.col("linked")).alias("placed")).where("placed")
    g = each.groupBy("range_id").agg(F.count("*").alias("nodes"), F.count_if(~F.col("linked")).alias("alone"))
    return g.withColumn("share", F.round(F.col("alone") / F.col("nodes"), 6))
