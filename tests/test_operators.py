"""Hand cases: small inputs with known results."""

from pyspark.sql import functions as F

from difflens.functions import paths, text
from difflens.operators import chunking, evaluation, graph, imports, ordering, references
from difflens.sources import readers
from difflens.streaming import state


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_digest_and_paths(spark):
    assert value(spark, text.fnv1a(F.lit("hello"))) == "m3bicr"
    assert value(spark, text.fnv1a(F.lit(""))) == "ztntfp"
    assert value(spark, paths.strip_code_extensions(F.lit("foo.svelte.ts"))) == "foo"
    assert value(spark, paths.normalize(F.lit("a/./b/../../../c"))) == "c"
    assert value(spark, paths.ancestor_namespaces(F.lit("a.b.c"))) == ["a.b", "a"]
    assert value(spark, paths.repo_id(F.lit("git@h:o/my repo.git"), F.lit("/x"), F.lit("0123456789abcdef"))) == "my-repo-0123456789ab"


def test_gates(spark):
    fails = lambda t: value(spark, text.register_failures(F.lit(t), F.lit("chunk")))
    assert fails("x" * 111) == ["chars"] and fails("simplify it") == [] and fails("simply it") == ["banned"]
    badge = lambda t: value(spark, text.badge_failures(F.lit(t)))
    assert badge("Misc") == ["placeholder"] and badge("API change") == [] and badge("URGENTLY fix") == ["shout"]


def test_body_cap(spark):
    body = "\n".join(["x"] * 82 + ["", "y", "z"])
    out = value(spark, text.cap_body(F.lit(body))).split("\n")
    assert len(out) == 83 and out[-1] == "… (3 more lines)"


def test_parts_of_a_hunk(spark):
    outline = spark.createDataFrame([(1, 0, 0, "Foo", "type", 1, 90), (1, 1, 1, "bar", "function", 10, 30), (1, 2, 1, "baz", "function", 40, 60)], "doc_id int, sym_id int, depth int, name string, kind string, start_line int, end_line int")
    hunks = spark.createDataFrame([(1, 1, 25, 20, 25, 2), (1, 2, 15, 0, 15, 1)], "doc_id int, hunk_no int, start int, count int, other_start int, other_count int")
    got = {(r.hunk_no, r.part_no): (r.sym_id, r.start, r["count"], r.other_count) for r in chunking.parts(hunks, outline).collect()}
    assert got == {(1, 1): (1, 25, 6, 2), (1, 2): (0, 31, 9, 0), (1, 3): (2, 40, 5, 0), (2, 1): (1, 15, 0, 1)}


def test_buckets(spark):
    assert value(spark, chunking.bucketize(F.array(*map(F.lit, [10, 25, 10, 40, 3])), 40)) == [0, 0, 1, 2, 3]


def test_coverage_and_leftovers(spark):
    lines = lambda *n: spark.createDataFrame([(1, i) for i in n], "doc_id int, line_no int")
    assert {(r.line_no, r.owners) for r in chunking.coverage(lines(10, 11, 12), lines(10, 11, 11)).collect()} == {(12, 0), (11, 2)}
    assert {(r.start, r.end) for r in chunking.leftovers(lines(10, 11, 20), lines()).collect()} == {(10, 11), (20, 20)}


def test_graphs(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (1, "d", "d")], "range_id int, src string, dst string")
    reach = graph.closure(e)
    sccs = graph.cycles(reach)
    assert {(r.node, r.scc) for r in sccs.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert {(r.node, r.depth) for r in graph.depth(e, sccs).collect()} == {("a", 1), ("b", 1), ("c", 1), ("d", 0)}
    ranges = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 8, 9)], "k int, start int, end int")
    assert {(r.start, r.end) for r in graph.coalesce_ranges(ranges, ["k"]).collect()} == {(1, 6), (8, 9)}


def test_import_resolution(spark):
    files = spark.createDataFrame([(1, p) for p in ("src/a.ts", "src/util.tsx", "src/util/index.ts", "p/x/y.ts", "q/x/y.ts")], "range_id int, path string")
    specs = spark.createDataFrame([(1, "src/a.ts", s) for s in ("./util", "$lib/utils", "$lib/x/y", "left-pad")], "range_id int, path string, specifier string")
    edges, left = imports.import_graph(specs, files)
    assert [(r.src, r.dst) for r in edges.collect()] == [("src/a.ts", "src/util.tsx")]
    assert left.first()["unresolved"] == 3


def test_orders(spark):
    tests = spark.createDataFrame([(1, "t1", 1, 5), (1, "t2", 2, 5)], "range_id int, chunk_id string, git_rank int, target_pos int")
    order = lambda p: [r.chunk_id for r in ordering.weave_tests(tests, p).orderBy("position").collect()]
    assert order("before") == ["t1", "t2"] and order("after") == ["t2", "t1"]
    assert value(spark, ordering.sticky_budget(F.array(*[F.lit(x).cast("long") for x in (3, 9, 1)]), 10)) == 1
    keys = lambda *k: spark.createDataFrame([(1, x) for x in k], "range_id int, key string")
    r = ordering.permutation_check(keys("a", "b", "c"), keys("a", "a", "x")).first()
    assert (r.missing, r.unknown, r.duplicated) == (["b", "c"], ["x"], ["a"])


def test_outcomes_spend_sizes(spark):
    log = [("u", 1, "transient"), ("u", 2, "transient"), ("u", 3, "done"), ("v", 1, "transient"), ("v", 2, "transient"), ("v", 3, "transient"), ("w", 1, "invalid-output"), ("w", 2, "invalid-output")]
    got = {r.unit: r.outcome for r in evaluation.attempt_outcomes(spark.createDataFrame(log, "unit string, seq int, result string")).collect()}
    assert got == {"u": "done", "v": "failed", "w": "failed"}
    r = evaluation.spend(spark.createDataFrame([("a", 1, 2, None)] * 3, "kind string, input long, output long, cost double"), "kind").first()
    assert (r.calls, r.cost) == (3, None)
    r = evaluation.size_stats(spark.createDataFrame([(1, x) for x in (1, 2, 3, 10)], "g int, v int"), "g", "v").first()
    assert (r.p50, r.p90) == (2.5, 7.9)


def test_state(spark):
    rows = [(1, 1, 1, "reviewed", None, None, None), (1, 1, 2, None, None, True, None), (1, 1, 3, "bogus", True, None, None)]
    r = state.review_state(spark.createDataFrame(rows, "range_id int, chunk_id int, seq int, state string, auto_read boolean, expanded boolean, reviewed_via string")).first()
    assert (r.state, r.expanded, r.auto_read) == ("reviewed", True, None)
    ticks = [("k", 1, True, False, 500), ("k", 2, True, True, 100), ("k", 3, True, False, 300), ("k", 4, False, False, 0), ("k", 5, True, False, 200)]
    r = state.dwell(spark.createDataFrame([(*t, 1) for t in ticks], "key string, seq int, accruing boolean, spike boolean, dt int, lines int")).first()
    assert (r.banked, r.current) == (300, 200)


def test_stream_equals_batch(spark, tmp_path):
    from difflens.sources import corpus

    patches = corpus.review_patches(spark, "/root/testdata/sf0.001")
    patches.repartition(4).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(patches.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.review_state(live).writeStream.outputMode("complete").format("memory").queryName("live_state").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(spark.table("live_state")) == key(state.review_state(patches))


def test_readers(spark, tmp_path):
    diff = "noise\ndiff --git a/a.ts b/a.ts\nnew file mode 100644\n--- /dev/null\n+++ b/a.ts\n@@ -0,0 +1,3 @@\ndiff --git a/o.ts b/n.ts\nrename from o.ts\nrename to n.ts\n@@ -4 +4 @@\ndiff --git a/x.png b/x.png\nBinary files a/x.png and b/x.png differ"
    files, hunks = readers.parse_diff(spark.createDataFrame([(1, diff)], "range_id int, text string"))
    assert [(r.path, r.base_path, r.status, r.binary) for r in files.orderBy("file_no").collect()] == [("a.ts", None, "added", False), ("n.ts", "o.ts", "renamed", False), ("x.png", None, "modified", True)]
    assert [(r.base_start, r.base_count, r.head_start, r.head_count) for r in hunks.orderBy("file_no").collect()] == [(0, 0, 1, 3), (4, 1, 4, 1)]
    p = tmp_path / "l.json"
    p.write_text('{"ts":"2024-01-01T00:00:00Z","kind":"a","usage":{"input":1,"output":2}}\nbroken\n\n')
    assert readers.read_ledger(spark, str(p)).select("kind", "usage.input", "usage.cost").collect() == [("a", 1, None)]
    p.write_text('{"version":1,"key":"a"}\n{"version":2,"key":"b"}\nbroken\n')
    assert [r.key for r in readers.read_overlay(spark, str(p), "key string", 1).collect()] == ["a"]


def test_definitions_need_one_span(spark):
    scoped = spark.createDataFrame([(1, 0, "a", 3), (1, 0, "b", 4), (1, 0, "c", 5), (1, 0, "d", 6)], "doc_id long, sym int, name string, line int")
    spans = spark.createDataFrame([(2, 7, "a", 1), (2, 8, "b", 1), (2, 9, "b", 5), (1, 4, "c", 9), (2, 6, "c", 2), (3, 5, "d", 1)], "doc_id long, sym_id int, name string, start_line int")
    found = references.resolve(scoped, spans, spark.createDataFrame([(1, 2)], "doc_id long, to_doc long"))
    # b twice in a file, c in two files, d in a file that isn't imported
    assert [(r["name"], r["to_doc"], r["to_sym"]) for r in found.collect()] == [("a", 2, 7)]


def test_behind_stops_at_cycles_and_the_focus(spark):
    e = spark.createDataFrame([(1, 1, 2, "calls"), (1, 2, 3, "calls"), (1, 3, 2, "calls"), (1, 3, 1, "calls"), (1, 3, 4, "calls")], "range_id long, src long, dst long, kind string")
    n = graph.behind(e, spark.createDataFrame([(1, 4)], "range_id long, node long"))
    assert {(r["focus"], r["node"]): r["n"] for r in n.where("direction = 'out'").collect()}[1, 2] == 1
