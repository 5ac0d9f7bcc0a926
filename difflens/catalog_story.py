"""Registered queries of chapter books, with their DuckDB twins. Chunks are numbers; a number's rest names its bucket, file and role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difflens.catalog import FIXTURE, query
from difflens.operators import book, graph, story
from difflens.sources import corpus


def _layers(name: str, edges: str) -> dict[str, str]:
    """CTEs of the depth of each node over edges (range_id, a, b; a stands before b)."""
    n = name
    return {
        f"{n}_edge": f"{n}_edge as (select distinct range_id, a, b from ({edges}) where a <> b)",
        f"{n}_path": f"{n}_path as (select range_id, a, b from {n}_edge union select p.range_id, p.a, e.b from {n}_path p join {n}_edge e on e.range_id = p.range_id and e.a = p.b)",
        f"{n}_loop": f"{n}_loop as (select p.range_id, p.a as node, least(min(p.b), p.a) as scc from {n}_path p join {n}_path q on q.range_id = p.range_id and q.a = p.b and q.b = p.a group by p.range_id, p.a)",
        f"{n}_node": f"{n}_node as (select m.range_id, m.node, coalesce(l.scc, m.node) as scc from (select range_id, a as node from {n}_edge union select range_id, b from {n}_edge) m left join {n}_loop l on l.range_id = m.range_id and l.node = m.node)",
        f"{n}_dag": f"{n}_dag as (select distinct e.range_id, x.scc as a, y.scc as b from {n}_edge e join {n}_node x on x.range_id = e.range_id and x.node = e.a join {n}_node y on y.range_id = e.range_id and y.node = e.b where x.scc <> y.scc)",
        f"{n}_step": f"{n}_step as (select distinct range_id, scc, 0 as depth from {n}_node union select s.range_id, d.b, s.depth + 1 from {n}_step s join {n}_dag d on d.range_id = s.range_id and d.a = s.scc)",
        f"{n}_depth": f"{n}_depth as (select m.range_id, m.node, max(s.depth) as depth from {n}_node m join {n}_step s on s.range_id = m.range_id and s.scc = m.scc group by all)",
    }


_STORY, _TESTS = "% 8 in (0, 1, 3, 4)", "% 8 in (2, 5)"
FIXTURE |= {
    "s_edges": "s_edges as (select l_orderkey // 8 as range_id, l_partkey % 24 as src, l_suppkey % 24 as dst, case l_returnflag when 'A' then 'calls' when 'N' then 'exercises' else 'file-imports' end as kind, case l_linestatus when 'O' then 'references' else 'test-anchor' end as source, l_orderkey % 8 * 10 + l_linenumber as line from lineitem)",
    "s_nodes": f"s_nodes as (select range_id, node as chunk, case when node {_STORY} then 'story' when node {_TESTS} then 'test' when node % 8 = 6 then 'low-signal' else 'leftover' end as bucket, case when node {_TESTS} then 't' || node // 8 else 'f' || node // 4 end as path, case when node % 4 = 0 then 0 when node % 8 = 3 then 2 else 1 end as priority from (select range_id, src as node from s_edges union select range_id, dst from s_edges))",
    "s_calls": f"s_calls as (select range_id, src, dst, min(line) as line from s_edges where kind = 'calls' and src <> dst and src {_STORY} and dst {_STORY} group by all)",
}
FIXTURE |= _layers("s_call", "select range_id, src as a, dst as b from s_calls")
FIXTURE |= {
    "s_near": "s_near as (select range_id, chunk as a, chunk as b from s_nodes where bucket = 'story' union select n.range_id, n.a, e.b from s_near n join (select range_id, a, b from s_call_edge union select range_id, b, a from s_call_edge) e on e.range_id = n.range_id and e.a = n.b)",
    "s_part": "s_part as (select range_id, a as chunk, min(b) as part from s_near group by all)",
    "s_spine": """s_spine as (select range_id, chunk, path, row_number() over (partition by range_id order by part_priority, part, depth, call_line, chunk) as pos from (select n.range_id, n.chunk, n.path, p.part, min(n.priority) over (partition by n.range_id, p.part) as part_priority, coalesce(d.depth, 0) as depth, coalesce(c.call_line, 1000000) as call_line
 from s_nodes n join s_part p using (range_id, chunk) left join s_call_depth d on d.range_id = n.range_id and d.node = n.chunk left join (select range_id, dst as chunk, min(line) as call_line from s_calls group by all) c using (range_id, chunk)))""",
    "s_before": "s_before as (select *, lag(chunk) over (partition by range_id order by pos) as last_chunk, lag(path) over (partition by range_id order by pos) as last_path from s_spine)",
    "s_run": "s_run as (select s.range_id, pos, chunk, path, sum(case when coalesce(path = last_path, false) or c.a is not null then 0 else 1 end) over (partition by s.range_id order by pos) as chapter from s_before s left join (select range_id, a, b from s_call_edge union select range_id, b, a from s_call_edge) c on c.range_id = s.range_id and c.a = s.last_chunk and c.b = s.chunk)",
    "s_chapters": "s_chapters as (select range_id, pos, chunk, path, 'chapter:' || first_value(chunk) over w as section_id, first_value(path) over w as anchor_path from s_run window w as (partition by range_id, chapter order by pos))",
    "s_precise": f"s_precise as (select distinct range_id, src, dst from s_edges where kind = 'exercises' and source = 'references' and src {_TESTS} and dst {_STORY})",
    "s_anchor": f"s_anchor as (select range_id, 't' || src // 8 as test, max('f' || dst // 4) as impl from s_edges where kind = 'exercises' and source = 'test-anchor' and src {_TESTS} and dst {_STORY} group by all)",
    "s_lead": "s_lead as (select range_id, path, min(chunk) as chunk from s_nodes where bucket in ('story', 'test') group by range_id, path)",
    "s_targets": "s_targets as (select * from s_precise union all select a.range_id, t.chunk, i.chunk from s_anchor a join s_lead t on t.range_id = a.range_id and t.path = a.test join s_lead i on i.range_id = a.range_id and i.path = a.impl where not exists (select 1 from s_precise p where p.range_id = a.range_id and p.src = t.chunk))",
    "s_trail": "s_trail as (select * from s_nodes n where bucket = 'test' and not exists (select 1 from s_targets t where t.range_id = n.range_id and t.src = n.chunk))",
}
FIXTURE |= _layers("s_help", f"select e.range_id, 't' || dst // 8 as a, 't' || src // 8 as b from s_edges e where kind = 'file-imports' and src {_TESTS} and dst {_TESTS} and exists (select 1 from s_trail t where t.range_id = e.range_id and t.path = 't' || src // 8) and exists (select 1 from s_trail t where t.range_id = e.range_id and t.path = 't' || dst // 8)")
FIXTURE |= {
    "s_tail_files": "s_tail_files as (select f.range_id, f.path, row_number() over (partition by f.range_id order by coalesce(depth, 0), f.path = 't1', file_rank) as file_pos from (select range_id, path, min(chunk) as file_rank from s_trail group by all) f left join s_help_depth d on d.range_id = f.range_id and d.node = f.path)",
}


def _slots(placement: str, chapters: str = "s_chapters") -> str:
    """A subquery of the woven slots."""
    at, side, sign = ("min", 0, "") if placement == "before" else ("max", 2, "-")
    tests = f"union all select n.range_id, t.pos, n.chunk, n.path, c.section_id, c.anchor_path, {side}, {sign}n.chunk from s_nodes n join (select x.range_id, x.src, {at}(c.pos) as pos from s_targets x join {chapters} c on c.range_id = x.range_id and c.chunk = x.dst group by all) t on t.range_id = n.range_id and t.src = n.chunk join {chapters} c on c.range_id = t.range_id and c.pos = t.pos"
    return f"(select range_id, row_number() over (partition by range_id order by pos, side, tie) as slot, chunk, path, section_id, anchor_path from (select *, 1 as side, 0 as tie from {chapters} {tests}))"


def _sections(placement: str, chapters: str = "s_chapters", ranges: str = "s_nodes") -> str:
    return f"""(select range_id, sum(new) over (partition by range_id order by pos) as section_no, section_id, pos, chunk, label from (select *, row_number() over w as pos, case when section_id = lag(section_id) over w then 0 else 1 end as new from (select range_id, chunk, section_id, case when path <> anchor_path then path end as label, 0 as block, slot as a, 0 as b from {_slots(placement, chapters)}
 union all select t.range_id, chunk, 'chapter:test:' || t.path, null, 1, file_pos, chunk from s_trail t join s_tail_files f on f.range_id = t.range_id and f.path = t.path where t.range_id in (select range_id from {ranges})
 union all select range_id, chunk, case bucket when 'low-signal' then path else 'leftovers' end, null, case bucket when 'low-signal' then 2 else 3 end, case bucket when 'low-signal' then min(chunk) over (partition by range_id, bucket, path) else 0 end, chunk from s_nodes where bucket in ('low-signal', 'leftover') and range_id in (select range_id from {ranges})) window w as (partition by range_id order by block, a, b)))"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "exercises").otherwise("file-imports")
    source = F.when(F.col("l_linestatus") == "O", "references").otherwise("test-anchor")
    li = corpus.table(spark, sf_dir, "lineitem")
    return li.select(F.expr("l_orderkey div 8").alias("range_id"), (F.col("l_partkey") % 24).alias("src"), (F.col("l_suppkey") % 24).alias("dst"), kind.alias("kind"), source.alias("source"), (key % 8 * 10 + F.col("l_linenumber")).alias("line"))


def _path(node) -> F.Column:
    eighth, fourth = F.floor(node / 8).cast("string"), F.floor(node / 4).cast("string")
    return F.when(node.isNull(), None).when((node % 8).isin(2, 5), F.concat(F.lit("t"), eighth)).otherwise(F.concat(F.lit("f"), fourth))


def _nodes(e: DataFrame) -> DataFrame:
    n = F.col("chunk")
    bucket = F.when((n % 8).isin(0, 1, 3, 4), "story").when((n % 8).isin(2, 5), "test").when(n % 8 == 6, "low-signal").otherwise("leftover")
    priority = F.when(n % 4 == 0, 0).when(n % 8 == 3, 2).otherwise(1)
    all_ = e.select("range_id", F.col("src").alias("chunk")).union(e.select("range_id", "dst")).distinct()
    return all_.select("range_id", "chunk", _path(n).alias("path"), n.alias("git_rank"), bucket.alias("bucket"), priority.alias("priority"), (n.isin(10, 13)).alias("e2e"))


def _among(e: DataFrame, a: tuple, b: tuple) -> DataFrame:
    return e.where((F.col("src") % 8).isin(*a) & (F.col("dst") % 8).isin(*b))


S, T = (0, 1, 3, 4), (2, 5)


class _Book:
    """The parts of the ranges' books."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.edges = e = _edges(spark, sf_dir)
        self.nodes = _nodes(e)
        self.calls = _among(e, S, S).where("kind = 'calls' and src <> dst").groupBy("range_id", "src", "dst").agg(F.min("line").alias("line"))
        near = _among(e, T, S).where("kind = 'exercises' and source = 'test-anchor'")
        self.anchors = near.groupBy("range_id", _path(F.col("src")).alias("test")).agg(F.max(_path(F.col("dst"))).alias("impl"))
        self.targets = self._targets()
        self.imports = _among(e, T, T).where("kind = 'file-imports'").select("range_id", _path(F.col("src")).alias("src"), _path(F.col("dst")).alias("dst"))

    def of(self, *buckets: str) -> DataFrame:
        return self.nodes.where(F.col("bucket").isin(*buckets))

    def _targets(self) -> DataFrame:
        return story.exercise_targets(self.edges, self.of("test"), self.of("story"), self.anchors)

    def kept(self) -> _Book:
        """The same, with the parts that a whole book reads many times stored once."""
        self.nodes, self.calls = graph.cut(self.nodes), graph.cut(self.calls)
        self.targets = graph.cut(self._targets())
        return self

    def spine(self) -> DataFrame:
        return story.spine(self.of("story").select("range_id", "chunk", "path", "git_rank", "priority"), self.calls)

    def chapters(self, spine: DataFrame) -> DataFrame:
        return story.titled(book.chapters(spine.select("range_id", "pos", "chunk", "path"), self.calls))

    def trailing(self, placement: str = "before") -> DataFrame:
        placed = self.targets.select("range_id", F.col("src").alias("chunk"))
        return story.trailing_tests(self.of("test"), placed if placement != "end" else placed.where("false"), self.imports)

    def sections(self, chapters: DataFrame, placement: str = "before", trailing: DataFrame | None = None) -> DataFrame:
        tail = self.trailing(placement) if trailing is None else trailing
        return story.sections(story.woven(chapters, self.of("test"), self.targets, placement), tail, self.of("low-signal", "leftover"))


@query("select range_id, chunk, path, pos from s_spine")
def or4_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR-4, consumer-first."""
    return _Book(spark, sf_dir).spine().select("range_id", "chunk", "path", "pos")


@query("select range_id, src, dst from s_targets")
def or7_exercise_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Book(spark, sf_dir).targets


@query(f"select 'before' as placement, * from {_slots('before')} union all select 'after', * from {_slots('after')}")
def or6_woven_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Book(spark, sf_dir).kept()
    chapters = graph.cut(b.chapters(b.spine()))
    one = lambda p: story.woven(chapters, b.of("test"), b.targets, p).select(F.lit(p).alias("placement"), "*")
    return one("before").unionByName(one("after"))


@query("select t.range_id, f.file_pos, t.chunk, t.path, t.chunk as git_rank from s_trail t join s_tail_files f on f.range_id = t.range_id and f.path = t.path")
def or8_trailing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Book(spark, sf_dir).trailing()


@query(f"select * from {_sections('before')}")
def or9_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _Book(spark, sf_dir).kept()
    return b.sections(graph.cut(b.chapters(b.spine())))


@query("select range_id, placement, list(chunk order by chunk) as chunks from s_nodes, (select unnest(['before', 'after', 'end']) as placement) group by all")
def se4_same_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE-4: the chunks of a book by placement; each mode holds all of the range, once."""
    b = _Book(spark, sf_dir).kept()
    chapters = graph.cut(b.chapters(b.spine()))
    woven = graph.cut(b.trailing())  # before and after leave the same tests
    books = [b.sections(chapters, p, None if p == "end" else woven).select("range_id", F.lit(p).alias("placement"), "chunk") for p in ("before", "after", "end")]
    return books[0].unionByName(books[1]).unionByName(books[2]).groupBy("range_id", "placement").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))


_OVERLAY = """f7_chapters as (select range_id, row_number() over w as pos, chunk, path, 'chapter:' || first_value(chunk) over (partition by range_id, chunk % 2 order by chunk desc) as section_id, first_value(path) over (partition by range_id, chunk % 2 order by chunk desc) as anchor_path from s_nodes where bucket = 'story' and range_id % 4 = 0 window w as (partition by range_id order by chunk % 2, chunk desc))"""
FIXTURE["f7_chapters"] = _OVERLAY


@query(f"select * from {_sections('before', 'f7_chapters', 'f7_chapters')}")
def fr7_chapter_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-7: overlays of two chapters, even and odd chunks from the last; of four ranges one is whole and fresh, one lacks a chunk, one is stale, one has none."""
    b = _Book(spark, sf_dir)
    own = b.of("story").select("range_id", "chunk", "path")
    r, least = F.col("range_id") % 4, own.groupBy("range_id").agg(F.min("chunk").alias("least"))
    kept = own.join(least, "range_id").where((r < 3) & ((r != 1) | (F.col("chunk") != F.col("least"))))
    overlay = kept.groupBy("range_id", (F.col("chunk") % 2).alias("chapter")).agg(F.sort_array(F.collect_list("chunk"), False).alias("members"), F.lit("new").alias("fingerprint"))
    stamps = own.select("range_id", F.when(r == 2, "newer").otherwise("new").alias("fingerprint")).distinct()
    chapters = story.composed(own, overlay, stamps)
    return b.sections(chapters).join(chapters.select("range_id").distinct(), "range_id", "left_semi")


FIXTURE |= _layers("o3", "select range_id, dst as a, src as b from s_edges where kind = 'file-imports' and src % 2 = 1 and dst % 2 = 1")
_OWN = "(select range_id, src as test, min(dst) as anchor from s_edges where kind = 'exercises' and src % 2 = 1 and dst % 2 = 0 group by all)"


@query(f"""select t.range_id, t.chunk as test, b.anchor, row_number() over (partition by t.range_id order by b.anchor nulls last, coalesce(d.depth, 0), t.chunk) as position from s_nodes t
left join (select range_id, test, min(anchor) as anchor from (select * from {_OWN} union all select p.range_id, p.a, o.anchor from o3_path p join {_OWN} o on o.range_id = p.range_id and o.test = p.b) group by all) b on b.range_id = t.range_id and b.test = t.chunk left join o3_depth d on d.range_id = t.range_id and d.node = t.chunk where t.chunk % 2 = 1""")
def or3_test_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR-3: odd nodes are tests, even ones implementations in git order."""
    e = _edges(spark, sf_dir)
    odd, tests = F.col("src") % 2 == 1, _nodes(e).where("chunk % 2 = 1").select("range_id", F.col("chunk").alias("test"), "git_rank")
    own = e.where(odd & (F.col("kind") == "exercises") & (F.col("dst") % 2 == 0)).groupBy("range_id", F.col("src").alias("test")).agg(F.min("dst").alias("anchor"))
    return story.test_block(tests, own, e.where(odd & (F.col("kind") == "file-imports") & (F.col("dst") % 2 == 1)))


FIXTURE |= _layers("o1", "select range_id, dst as a, src as b from c_dist")


@query("select range_id, node, row_number() over (partition by range_id order by depth, node) as position from o1_depth")
def or1_dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR-1: what is depended on first, by depth over the condensed graph, then by number."""
    e = corpus.edges(spark, sf_dir)
    return graph.dependency_order(e, graph.depth(e))


@query("""with p as (select range_id, node, row_number() over (partition by range_id order by depth, node) as position from o1_depth)
select count(*) as edges, count(*) filter (y.position > x.position and b.a is null) as violations from c_dist d join p x on x.range_id = d.range_id and x.node = d.src join p y on y.range_id = d.range_id and y.node = d.dst left join o1_path b on b.range_id = d.range_id and b.a = d.src and b.b = d.dst""")
def or1_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR-1: edges outside cycles whose target doesn't stand first in the dependency order; there are none."""
    e = corpus.edges(spark, sf_dir)
    sccs = graph.strong(e)
    pos = graph.dependency_order(e, graph.depth(e))
    a, b = pos.select("range_id", F.col("node").alias("src"), F.col("position").alias("p")), pos.select("range_id", F.col("node").alias("dst"), F.col("position").alias("q"))
    s, t = sccs.select("range_id", F.col("node").alias("src"), F.col("scc").alias("s")), sccs.select("range_id", F.col("node").alias("dst"), F.col("scc").alias("t"))
    d = e.where("src <> dst").select("range_id", "src", "dst").distinct().join(a, ["range_id", "src"]).join(b, ["range_id", "dst"]).join(s, ["range_id", "src"], "left").join(t, ["range_id", "dst"], "left")
    return d.agg(F.count("*").alias("edges"), F.count_if((F.col("q") > F.col("p")) & ~F.coalesce(F.col("s") == F.col("t"), F.lit(False))).alias("violations"))
