"""What grows by explode isn't broadcast: Spark would go by the size before."""

from __future__ import annotations

from pyspark.sql import functions as F

from difflens import catalog
from difflens.operators import chunking, graph, imports, references


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    def stored(rows, fields):  # a table that Spark knows to be small
        path = str(tmp_path / fields.replace(" ", "_").replace(",", ""))
        spark.createDataFrame(rows, fields).write.parquet(path)
        return spark.read.parquet(path)

    hunks = stored([(1, 1, 2, 6, 2, 0)], "doc_id long, hunk_no int, start int, count int, other_start int, other_count int")
    spans = stored([(1, 1, 0, "f", "function", 1, 9)], "doc_id long, sym_id int, depth int, name string, kind string, start_line int, end_line int")
    lines = stored([(1, i, "x") for i in range(1, 10)], "doc_id long, line_no int, text string")
    scoped = stored([(1, 0, "f", 3)], "doc_id long, sym int, name string, line int")
    pairs = stored([(1, 2)], "doc_id long, to_doc long")
    at = chunking.innermost_symbol(chunking.changed_lines(hunks), spans)
    assert "Broadcast" not in _plan(at) and [r.sym_id for r in at.collect()] == [1] * 6
    told = references.resolve(scoped, spans, pairs)
    assert "SortMergeJoin" in _plan(told) and told.count() == 1
    tests = stored([(1, 1, 3, 4)], "doc_id long, hunk_no int, start int, end int")
    assert "Broadcast" not in _plan(references.widened(tests, spans))
    assert "Broadcast" not in _plan(chunking.fingerprints(hunks, lines, lambda c: c))
    files = stored([(1, "a.ts"), (1, "b.ts")], "range_id long, path string")
    said = stored([(1, "a.ts", "./b")], "range_id long, path string, specifier string")
    found = imports.resolve_relative(said, files)
    assert "Broadcast" not in _plan(found) and found.first().target == "b.ts"


def test_groups_are_dealt_by_rows(spark, monkeypatch):
    """As many parts as rows need, whatever the input's splits; nothing is grouped before they are dealt."""
    monkeypatch.setattr(graph, "PART_ROWS", 4)
    rows = [(r, 1, 2, "calls", "references", n) for r in range(6) for n in (1, 2, 2, 4, None, None)] + [(0, 1, 2, "calls", "test-anchor", 9), (0, 3, 3, "calls", "x", 1)]
    e = spark.createDataFrame(rows, "range_id long, src long, dst long, kind string, source string, line int").coalesce(1)
    nodes = e.select("range_id", F.explode(F.array("src", "dst")).alias("node"))
    for got in (graph.assemble(e), graph.free_glances(e), graph.edge_sample(e), graph.islands(e, nodes), graph.glance_summary(e, nodes.withColumn("pos", F.col("node")))):
        told = _plan(got)
        assert "REPARTITION_BY_NUM" in told
        below = told[told.rindex("REPARTITION_BY_NUM") :]
        assert "Aggregate" not in below and "Window" not in below
    assert {tuple(r) for r in graph.assemble(e).collect()} == {(r, 1, 2, "calls", "references", 4 if r == 0 else 3) for r in range(6)}
    assert {tuple(r) for r in graph.free_glances(e).collect()} == {(r, n, n - 1) for r in range(6) for n in (1, 2)}
    assert {(r.range_id, r.nodes, r.alone) for r in graph.islands(e, nodes).collect()} == {(r, 3 if r == 0 else 2, 1 if r == 0 else 0) for r in range(6)}


def test_books_read_their_parts_once(spark):
    told = _plan(catalog.queries()["or6_woven_tests"](spark, "/root/testdata/sf0.001"))
    assert "FileScan" not in told and "Window" in told


def test_lookups_read_their_tables_once(spark):
    """The driver keeps the plan of each stage: what is read many times is stored, not repeated in it."""
    told = _plan(catalog.queries()["jn14_both_lookups"](spark, "/root/testdata/sf0.001"))
    assert told.count("FileScan") <= 1 and "SortMergeJoin" in told
