"""Stored tables that follow their inputs, prompts under two budgets, glances and visible fractions."""

import os

import pytest
from pyspark.sql import functions as F

from difflens.operators import book, freshness, graph
from difflens.sources import stored
from difflens.streaming import state


def live(spark, prints):
    return spark.createDataFrame(list(prints.items()), "range_id long, fingerprint string")


def runner(spark, path, asked):
    def run(prints, value):
        def build(stale):
            keys = sorted((r.range_id for r in stale.collect()), key=repr)
            asked.append(keys)
            return spark.createDataFrame([(k, value) for k in keys if k != 3 for _ in range(2)], "range_id long, v string")

        return sorted(((r.range_id, r.v) for r in stored.refresh(spark, path, live(spark, prints), build, ["range_id"], "v string", parts=4).collect()), key=repr)

    return run


def test_only_stale_keys_are_built(spark, tmp_path):
    asked, path = [], str(tmp_path / "t")
    run = runner(spark, path, asked)
    first = {k: "a" for k in range(8)} | {None: "n"}
    assert run(first, "one") == sorted([(k, "one") for k in first if k != 3 for _ in range(2)], key=repr)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}
    before = files()
    assert run(first, "again") and len(asked) == 1 and files() == before  # nothing is stale, not even the key without rows
    second = {k: "b" if k == 2 else "a" for k in range(1, 8)} | {None: "n", 9: "a"}
    assert run(second, "two") == sorted([(k, "two" if k in (2, 9) else "one") for k in second if k != 3 for _ in range(2)], key=repr)
    assert asked[1:] == [[2, 9]] and set(files()) & set(before)  # directories without a stale key stay


def test_a_lost_directory_is_built_again(spark, tmp_path):
    asked, path = [], str(tmp_path / "t")
    run, prints = runner(spark, path, asked), {k: "a" for k in range(8)}
    whole = run(prints, "one")
    gone = next(d for d in sorted(os.listdir(path)) if d.startswith("_part="))
    held = {r.range_id for r in spark.read.parquet(f"{path}/{gone}").collect()}
    os.rename(f"{path}/{gone}", str(tmp_path / "gone"))
    assert run(prints, "one") == whole and asked[1] == sorted(held)


def test_nothing_live_and_a_failed_build(spark, tmp_path):
    asked, path = [], str(tmp_path / "t")
    run = runner(spark, path, asked)
    assert run({}, "one") == [] and not asked

    def broken(stale):
        return stale.select("range_id", F.raise_error(F.lit("broken")).cast("string").alias("v"))

    run({1: "a", 2: "a"}, "one")
    with pytest.raises(Exception, match="broken"):
        stored.refresh(spark, path, live(spark, {1: "b", 2: "a"}), broken, ["range_id"], "v string", parts=4).collect()
    assert run({1: "a", 2: "a"}, "two") == [(1, "one"), (1, "one"), (2, "one"), (2, "one")]


def test_contexts_by_chunk(spark, tmp_path):
    heads = lambda h: spark.createDataFrame([(1, h), (2, "x")], "range_id long, head string")
    sections = spark.createDataFrame([(1, 0, "s", 0, 10), (1, 0, "s", 1, 11), (2, 0, "s", 0, 10)], "range_id long, section_no int, section string, pos int, chunk long")
    none = spark.createDataFrame([], "range_id long, chapter_no int, pos int, chunk long")

    def run(head, v):
        prints = freshness.fingerprints(heads(head), sections, none, "7")
        return sorted((r.range_id, r.key, r.v) for r in stored.refresh_chunks(spark, str(tmp_path / "c"), prints, "context", lambda s: s.withColumn("v", F.lit(v)), "v string", parts=2).collect())

    assert run("h", "one") == [(1, "10", "one"), (1, "11", "one"), (2, "10", "one")]
    assert run("i", "two") == [(1, "10", "two"), (1, "11", "two"), (2, "10", "one")]


def prompt(spark, diffs, bodies, cap, definitions_cap):
    s = spark.createDataFrame([("a.ts", "impl", [], ["b.ts"])], "section string, role string, imports array<string>, imported_by array<string>")
    c = spark.createDataFrame([("a.ts", i, f"c{i}", "t", "method", 3, d) for i, d in enumerate(diffs)], "section string, pos int, id string, title string, kind string, lines int, diff string")
    d = spark.createDataFrame([("a.ts", i, "d.ts", n, b) for i, (n, b) in enumerate(bodies)], "section string, pos int, path string, name string, body string")
    return book.prompt_inputs(s, c, d, cap, definitions_cap).first()


def test_budgets_on_top_of_each_other(spark):
    head = "a.ts [impl]\nimported by: b.ts"
    meta = [f"chunk c{i}\n  t (method, ~3 lines)\n" for i in range(3)]
    diffs = ["+" + "x" * 40, "+" + "y" * 100, "+z"]
    shown = [head, meta[0] + diffs[0], meta[1] + book.OMITTED, meta[2] + book.OMITTED]
    text = "\n\n".join(shown)
    r = prompt(spark, diffs, [("f", "body"), ("f", "later"), ("g", "b" * 400), ("h", "x")], -(-len(text) // 4), 30)
    said = f"{book.CONTEXT}\n\nf — d.ts\nbody\n\n… (2 more definitions omitted — over context budget)"
    assert (r.text, r.omitted, r.definitions_omitted) == (f"{text}\n\n{said}", 2, 2)  # +z would fit, but comes after the first overflow
    assert r.tokens == -(-len(r.text) // 4)
    whole = prompt(spark, diffs, [("f", "body")], 1000, 1000)
    assert (whole.omitted, whole.definitions_omitted) == (0, 0) and whole.text.endswith(f"+z\n\n{book.CONTEXT}\n\nf — d.ts\nbody")


def test_budget_edges(spark):
    one = prompt(spark, [""], [("f", "b" * 99)], 1000, 5)
    assert one.text.endswith(f"{book.NO_DIFF}\n\n{book.CONTEXT}\n\n… (1 more definition omitted — over context budget)")
    none = prompt(spark, [], [], 1, 1)
    assert (none.text, none.omitted, none.definitions_omitted) == ("a.ts [impl]\nimported by: b.ts", 0, 0)


def test_glances_by_place(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 3, 9)], "range_id long, src long, dst long").withColumns({"kind": F.lit("calls"), "source": F.lit("references")})
    places = spark.createDataFrame([(1, 1, 5), (1, 1, 50), (1, 2, 7), (1, 3, 1), (1, 4, 2)], "range_id long, node long, pos int")
    r = graph.glance_summary(edges, places).first()
    # in order 3, 4 (no neighbor), 1 (after 3), 2 (after 1); 9 has no place
    assert (r.n, r.least, r.median, r.most, r["mean"], r["share"]) == (4, 0, 0.5, 1, 0.5, 0.5)


def test_visible_fraction(spark):
    rows = [(0.0, 10.0, 0.0, 30.0, 1.0), (-5.0, 5.0, 0.0, 30.0, 0.5), (40.0, 50.0, 0.0, 30.0, 0.0), (3.0, 3.0, 0.0, 30.0, 0.0), (-10.0, 50.0, 0.0, 30.0, 0.5)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double, expected double")
    assert all(r.got == r.expected for r in d.withColumn("got", state.visible_fraction(*(F.col(c) for c in "abcd"))).collect())


def test_fingerprints_are_computed_once_and_stored_once_a_key(spark, tmp_path):
    asked, path = spark.sparkContext.accumulator(0), str(tmp_path / "once")

    def run(head):
        @F.udf("string")
        def digest(key):
            asked.add(1)
            return head if key % 2 else "same"

        live_ = spark.range(40).select(F.col("id").alias("range_id"), digest("id").alias("fingerprint"))
        build = lambda stale: stale.select("range_id", F.explode(F.array(F.lit(head), F.lit("and")).alias("v")).alias("v"))
        return sorted((r.range_id, r.v) for r in stored.refresh(spark, path, live_, build, ["range_id"], "v string", parts=4).collect())

    assert run("one") == sorted((k, v) for k in range(40) for v in ("one", "and")) and asked.value == 40
    assert run("two") == sorted((k, v) for k in range(40) for v in ("two" if k % 2 else "one", "and")) and asked.value == 80
    kept = spark.read.parquet(path).groupBy("_held").agg(F.count("*").alias("rows"), F.count("_fingerprint").alias("prints"))
    assert {tuple(r) for r in kept.collect()} == {(False, 40, 40), (True, 80, 0)}


def test_a_table_with_fingerprints_on_every_row_is_read_on(spark, tmp_path):
    path = str(tmp_path / "old")
    old = [(k, "a", held, "old" if held else None) for k in (1, 2, 3) for held in (False, True)]
    rows = spark.createDataFrame(old, "range_id long, _fingerprint string, _held boolean, v string")
    rows.withColumn("_part", F.pmod(F.xxhash64("range_id"), F.lit(4)).cast("int")).write.partitionBy("_part").parquet(path)
    asked = []
    assert runner(spark, path, asked)({1: "a", 2: "b"}, "new") == [(1, "old"), (2, "new"), (2, "new")] and asked == [[2]]
