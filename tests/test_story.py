"""Hand cases of chapter books, fragments, manifests and runs."""

from pyspark.sql import functions as F

from difflens.functions import text
from difflens.operators import book, chunking, freshness, graph, items, story


def test_spine_follows_calls_in_both_directions(spark):
    chunks = spark.createDataFrame([(1, c, f"f{i}", i, p) for i, (c, p) in enumerate((("a", 1), ("b", 1), ("c", 1), ("route", 0), ("lone", 2)))], "range_id int, chunk string, path string, git_rank int, priority int")
    calls = spark.createDataFrame([(1, "route", "c", 9), (1, "route", "b", 20), (1, "c", "a", 1), (1, "a", "a", 3)], "range_id int, src string, dst string, line int")
    order = lambda d: [r.chunk for r in story.spine(chunks, calls, d).orderBy("pos").collect()]
    assert order("consumer-first") == ["route", "c", "b", "a", "lone"]
    assert order("dependency-first") == ["a", "b", "c", "route", "lone"]


def test_components_of_a_long_path_and_a_lone_node(spark):
    e = spark.createDataFrame([(1, i + 1, i) for i in range(9)] + [(2, 5, 6)], "range_id int, src int, dst int")
    nodes = spark.createDataFrame([(1, i) for i in range(11)] + [(2, 5), (2, 6)], "range_id int, node int")
    got = {(r.range_id, r.node): r.component for r in graph.components(e, nodes).collect()}
    assert got == {(1, i): 0 for i in range(10)} | {(1, 10): 10, (2, 5): 5, (2, 6): 5}


def test_tests_beside_their_targets(spark):
    chapters = spark.createDataFrame([(1, 1, 10, "x", "chapter:10", "x"), (1, 2, 20, "y", "chapter:20", "y")], "range_id int, pos int, chunk int, path string, section_id string, anchor_path string")
    tests = spark.createDataFrame([(1, 1, "t", 1, False), (1, 2, "t", 2, False), (1, 3, "u", 3, True)], "range_id int, chunk int, path string, git_rank int, e2e boolean")
    targets = spark.createDataFrame([(1, 1, 20), (1, 2, 20), (1, 2, 10)], "range_id int, src int, dst int")
    order = lambda p: [(r.chunk, r.section_id) for r in story.woven(chapters, tests, targets, p).orderBy("slot").collect()]
    assert order("before") == [(2, "chapter:10"), (10, "chapter:10"), (1, "chapter:20"), (20, "chapter:20")]
    assert order("after") == [(10, "chapter:10"), (20, "chapter:20"), (2, "chapter:20"), (1, "chapter:20")]
    assert order("end") == [(10, "chapter:10"), (20, "chapter:20")]


def test_trailing_helpers_come_first_and_e2e_last(spark):
    tests = spark.createDataFrame([(1, 1, "e", 1, True), (1, 2, "spec", 2, False), (1, 3, "help", 3, False)], "range_id int, chunk int, path string, git_rank int, e2e boolean")
    imports = spark.createDataFrame([(1, "spec", "help")], "range_id int, src string, dst string")
    got = story.trailing_tests(tests, tests.where("false"), imports).orderBy("file_pos").collect()
    assert [r.path for r in got] == ["help", "e", "spec"]


def test_helper_takes_the_earliest_anchor_of_its_importers(spark):
    tests = spark.createDataFrame([(1, "late", 1), (1, "early", 2), (1, "help", 3), (1, "none", 4)], "range_id int, test string, git_rank int")
    own = spark.createDataFrame([(1, "late", 7), (1, "early", 2), (1, "help", 9)], "range_id int, test string, anchor int")
    imports = spark.createDataFrame([(1, "late", "help"), (1, "early", "help"), (1, "help", "help")], "range_id int, src string, dst string")
    got = [(r.test, r.anchor) for r in story.test_block(tests, own, imports).orderBy("position").collect()]
    assert got == [("help", 2), ("early", 2), ("late", 7), ("none", None)]


def test_oversize_hunk_is_cut_after_blank_lines_or_statements(spark):
    body = ["x"] * 30
    body[7], body[8], body[17] = "", "y;", "z }"  # the first cut looks at lines 3 to 10, the second from 11 to 18
    lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(body)], "doc_id int, line_no int, text string")
    hunks = spark.createDataFrame([(1, 1, 1, 30, 4), (1, 2, 50, 10, 1)], "doc_id int, hunk_no int, start int, count int, other_count int")
    got = [(r.hunk_no, r.start, r["count"], r.other_count) for r in chunking.split_oversize(hunks, lines, cap=10).orderBy("hunk_no", "piece_no").collect()]
    assert got == [(1, 1, 8, 4), (1, 9, 10, 0), (1, 19, 10, 0), (1, 29, 2, 0), (2, 50, 10, 1)]


def test_run_ends_at_the_first_full_store(spark):
    rows = [(1, i, o) for i, o in enumerate(("fresh", "ok", "error", "full", "ok"))] + [(2, 0, "error")]
    got = {r.range_id: tuple(r)[1:] for r in freshness.fill_counters(spark.createDataFrame(rows, "range_id int, pos int, outcome string")).collect()}
    assert got == {1: (5, 2, 1, 1, True, 3), 2: (1, 0, 0, 0, False, 0)}


def test_settings_salvage_and_digest_of_pairs_of_units(spark):
    one = spark.range(1)
    c = one.select(items.story_config(F.lit('{"direction":"dependency-first","testPlacement":"after"}'), F.lit("consumer-first"), F.lit("before")).alias("c")).first().c
    assert tuple(c) == ("dependency-first", "after", "dependency-first/after", True)
    t = spark.createDataFrame([(1, 2, "b", ["chars"]), (1, 1, "a", []), (2, 1, "a", ["banned", "chars"])], "section int, seq int, key string, failures array<string>")
    assert {r.section: (r.kept, r.dropped) for r in text.salvage(t).collect()} == {1: (["a"], ["b: chars"]), 2: ([], ["a: banned,chars"])}

    def plain(s):
        h, raw = 2166136261, s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619) % 2**32
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out

    for s in ("", "é", "a😀b"):
        assert one.select(text.fnv1a(F.lit(s))).first()[0] == plain(s)


def test_overlay_that_lacks_a_chunk_gives_no_book(spark):
    spine = spark.createDataFrame([(r, c, "p") for r in (1, 2, 3) for c in (1, 2)], "range_id int, chunk int, path string")
    overlay = spark.createDataFrame([(1, 1, [2, 1], "s"), (2, 1, [2], "s"), (3, 1, [1, 2], "old")], "range_id int, chapter int, members array<int>, fingerprint string")
    stamps = spark.createDataFrame([(r, "s") for r in (1, 2, 3)], "range_id int, fingerprint string")
    assert [(r.range_id, r.chunk) for r in story.composed(spine, overlay, stamps).orderBy("range_id", "pos").collect()] == [(1, 2), (1, 1)]


def test_manifest_without_calls(spark):
    chunks = spark.createDataFrame([(1, 5, 1, 1, "t", "method", 3, "f.ts")], "range_id int, chunk int, pos int, chapter int, title string, kind string, lines int, path string")
    none = spark.createDataFrame([], "range_id int, src int, dst int, line int")
    assert book.chunk_manifest(chunks, none).first()["text"] == f"5 — t (method, ~3 lines) [f.ts]\n\ncalls:\n(none)\n\n1. 5\n\n{book.REGROUP}"
