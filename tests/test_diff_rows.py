"""Two-sided rows, the chunker's cutting and both sides' change types, cycles by colouring: hand cases and loops."""

import random

from pyspark.sql import functions as F

from difflens.operators import chunking, graph, rendering, story
from difflens.sources import readers

HUNK = "doc_id int, chunk int, hunk_no int, deleted boolean, head_start int, head_count int, base_start int, base_count int"


def sides(spark, n=30, which=("head", "base")):
    return spark.createDataFrame([(d, s, i, f"{s} {i}") for d in (1, 2, 3, 4) for s in which for i in range(1, n + 1)], "doc_id int, side string, line_no int, text string")


def shown(rows, doc):
    return [f"{r.type}:{r.head or r.base or ''}" for r in sorted(rows, key=lambda r: r.row_no) if r.doc_id == doc]


def plain_rows(hunks, n, deleted, context=3):
    """One chunk's rows, one line after another."""
    out, last = [], 0
    hunks = sorted(hunks, key=lambda h: h[2] if deleted else h[0])
    for k, (head, heads, base, bases) in enumerate(hunks):
        start, count = (base, bases) if deleted else (head, heads)
        before = start - 1 if count else start
        if out and before - context > last:
            out.append("gap:")

        def near(a, b):
            nonlocal last
            for i in range(max(a, last + 1, 1), min(b, n) + 1):
                out.append(f"context:{i}")
                last = i

        near(before - context + 1, before)
        if not deleted:
            out.extend(f"del:{base + i}" for i in range(bases))
        for i in range(start, start + count):
            out.append(f"{'del' if deleted else 'add'}:{i}")
            last = i
        following = (hunks[k + 1][2] if deleted else hunks[k + 1][0]) if k + 1 < len(hunks) else 10**9
        near(before + count + 1, min(before + count + context, following - 1))
    return out


def test_chunk_rows(spark):
    hunks = [
        (1, 0, 1, False, 5, 2, 5, 1), (1, 0, 2, False, 20, 1, 20, 0),  # two distant hunks
        (2, 0, 1, True, 0, 0, 1, 2),  # a deleted file
        (3, 0, 1, False, 1, 6, 0, 0), (3, 0, 2, False, 8, 3, 8, 0),  # a hole of one line
        (9, 0, 1, False, 1, 1, 1, 1),  # no content
    ]
    df = spark.createDataFrame(hunks, HUNK)
    rows = rendering.chunk_rows(df, sides(spark)).collect()
    assert shown(rows, 1) == [*(f"context:{i}" for i in (2, 3, 4)), "del:5", "add:5", "add:6", *(f"context:{i}" for i in (7, 8, 9)), "gap:", *(f"context:{i}" for i in (17, 18, 19)), "add:20", *(f"context:{i}" for i in (21, 22, 23))]
    assert {(r.type, r.text) for r in rows if r.doc_id == 1 and (r.base == 5 or r.head == 5)} == {("del", "base 5"), ("add", "head 5")}
    assert shown(rows, 2) == ["del:1", "del:2", "context:3", "context:4", "context:5"]
    assert shown(rows, 3) == [*(f"add:{i}" for i in range(1, 7)), "context:7", "add:8", "add:9", "add:10", "context:11", "context:12", "context:13"]
    assert shown(rows, 9) == []
    text = rendering.diff_text(rendering.chunk_rows(df, sides(spark)), ("doc_id", "chunk"))
    assert {r.doc_id: r["diff"] for r in text.collect()}[2] == "-base 1\n-base 2\n base 3\n base 4\n base 5"


def test_chunk_rows_equal_a_loop(spark):
    rnd, hunks = random.Random(8), []
    for doc in (1, 2, 3, 4):
        for chunk in range(25):
            at = rnd.randrange(0, 4)
            for no in range(rnd.randrange(1, 6)):
                heads, bases = rnd.choice([(0, 1), (0, 2), (1, 0), (2, 1), (4, 3)])
                at += rnd.randrange(1, 9)
                hunks.append((doc, chunk, no, doc == 4, at, heads, at, bases))
                at += max(heads, bases)
    rows = rendering.chunk_rows(spark.createDataFrame(hunks, HUNK), sides(spark)).collect()
    for doc in (1, 2, 3, 4):
        for chunk in range(25):
            mine = [h[4:] for h in hunks if h[:2] == (doc, chunk)]
            assert shown([r for r in rows if r.chunk == chunk], doc) == plain_rows(mine, 30, doc == 4), (doc, chunk, mine)


def test_oversize_parts_are_cut_before_they_are_dealt(spark):
    parts = spark.createDataFrame([(1, 1, 1, 7, "function", 1, 100, 50), (1, 2, 1, 7, "function", 200, 0, 60)], "doc_id int, hunk_no int, part_no int, sym_id int, sym_kind string, start int, count int, other_count int")
    lines = spark.createDataFrame([(1, i, "" if i == 37 else "x" if i % 10 else "y;") for i in range(1, 101)], "doc_id int, line_no int, text string")
    got = [(r.bucket, r.kind, r.start, r.end, r.n_lines, r.n_parts) for r in chunking.chunks(parts, 40, lines).orderBy("bucket").collect()]
    # 37 ends with a blank line, 70 with a statement, the rest is 30; the part without lines weighs one, whatever its other side has
    assert got == [(0, "method-fragment", 1, 37, 37, 1), (1, "method-fragment", 38, 70, 33, 1), (2, "method-fragment", 71, 100, 30, 2)]


def test_change_types(spark):
    hunks = spark.createDataFrame([(1, 1, 1, 1, 1, 1), (2, 1, 1, 1, 1, 1), (3, 1, 1, 1, 1, 1), (4, 1, 1, 1, 1, 1), (5, 1, 1, 1, 1, 0)], "doc_id int, hunk_no int, start int, count int, other_start int, other_count int")
    blank = [(d, s, 1, t) for d in (1, 2, 3, 4, 5) for s, t in (("head", " \t"), ("base", "code" if d in (2, 4) else "\t"))]
    files = spark.createDataFrame([(1, False, False, None), (2, False, False, None), (3, False, True, None), (4, True, False, None), (5, False, False, "lockfile")], "doc_id int, deleted boolean, submodule boolean, generated_reason string")
    lines = spark.createDataFrame(blank, "doc_id int, side string, line_no int, text string")
    got = {r.doc_id: (r.n_lines, r.change_type) for r in chunking.change_types(hunks, lines, files).collect()}
    assert got == {1: (2, "whitespace"), 2: (2, None), 3: (2, None), 4: (1, None), 5: (1, "generated")}
    prints = {r.doc_id: r.fingerprint for r in chunking.side_fingerprints(hunks, lines, files, F.lower).collect()}
    assert prints == {1: "\n", 2: "\ncode", 3: "\n", 4: "code", 5: ""}


def test_submodule_modes(spark):
    head = "diff --git a/m b/m\n"
    texts = [head + "old mode 100644\nnew mode 160000", head + "index 1111111..2160000", head + "index 111..222 160000", head + "index 111..222 100644"]
    files, _ = readers.parse_diff(spark.createDataFrame(list(enumerate(texts)), "range_id int, text string"))
    assert [r.submodule for r in files.orderBy("range_id").collect()] == [True, False, True, False]


def plain_cycles(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in reach[n] and a != b:
                    reach[n].add(b)
                    todo.insert(0, b)
            todo.pop()
    return {(n, min(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes if n in reach[n]}


def test_cycles_by_colouring(spark):
    rnd, edges = random.Random(6), []
    for r in range(40):
        n = rnd.choice([3, 6, 12])
        edges += [(r, rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(1, 2 * n))]
    df = spark.createDataFrame(edges, "range_id int, src int, dst int")
    got = {(r.range_id, r.node, r.scc) for r in graph.strong(df).collect()}
    assert got == {(r, *x) for r in range(40) for x in plain_cycles({(a, b) for q, a, b in edges if q == r})}
    assert got == {tuple(r) for r in graph.cycles(graph.closure(df)).collect()}
    assert graph.strong(df.limit(0)).collect() == []


def test_test_block_takes_the_earliest_anchor_of_its_importers(spark):
    tests = spark.createDataFrame([(1, t, i) for i, t in enumerate("abcd")], "range_id int, test string, git_rank int")
    own = spark.createDataFrame([(1, "a", 9), (1, "c", 4)], "range_id int, test string, anchor int")
    uses = spark.createDataFrame([(1, "a", "b"), (1, "c", "a"), (1, "d", "d")], "range_id int, src string, dst string")
    got = {r.test: (r.anchor, r.position) for r in story.test_block(tests, own, uses).collect()}
    assert got == {"b": (4, 1), "a": (4, 2), "c": (4, 3), "d": (None, 4)}
