"""Graphs of small ranges by row against loops, with a range of more nodes than a row holds beside them."""

from __future__ import annotations

import random
import time

import pytest

from difflens.operators import graph


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(7), set()
    for g in range(12):
        n = r.choice([2, 3, 5, 8])
        out |= {(g, r.randrange(n), r.randrange(n), r.choice(["calls", "exercises"])) for _ in range(int(n * r.choice([0.7, 1.3, 2])))}
    return sorted(out | {(50, i, (i + 1) % 64, "calls") for i in range(64)})  # one cycle of as many nodes as a row holds


WIDE = [(51, i % 2, i, "calls") for i in range(2, 70)]


def _reach(rows, skip=None):
    out = {}
    for g, a, b, _ in rows:
        if a != b and b != skip:
            out.setdefault((g, a), set()).add(b)
    got = {}
    for g, a in {(g, x) for g, a, b, _ in rows for x in (a, b) if a != b}:
        seen, todo = set(), [a]
        while todo:
            fresh = out.get((g, todo.pop()), set()) - seen
            seen |= fresh
            todo += fresh
        got[g, a] = seen
    return got


def _frame(spark, rows):
    return spark.createDataFrame(rows, "range_id long, src long, dst long, kind string")


def test_cycles_and_depths(spark, rows):
    e, reach = _frame(spark, rows + WIDE), _reach(rows + WIDE)
    sccs = {(g, a, min(b for b in s if a in reach[g, b])) for (g, a), s in reach.items() if a in s}
    assert {(r.range_id, r.node, r.scc) for r in graph.strong(e).collect()} == sccs
    deep = {}
    for g, a in sorted(reach, key=lambda k: len(reach[k] | {k[1]})):
        deep[g, a] = max((deep[g, b] + 1 for b in reach[g, a] if a not in reach[g, b]), default=0)
    assert {(r.range_id, r.node): r.depth for r in graph.depth(e).collect()} == deep


def test_components(spark, rows):
    both = rows + [(g, b, a, k) for g, a, b, k in rows]
    want = {k: min(s | {k[1]}) for k, s in _reach(both).items()} | {(99, 5): 5}
    nodes = spark.createDataFrame(list(want), "range_id long, node long")
    assert {(r.range_id, r.node): r.component for r in graph.components(_frame(spark, rows), nodes).collect()} == want


def test_behind(spark, rows):
    few = [r for r in rows if r[0] != 50] + [(60, 0, 1, "calls"), (60, 1, 0, "calls"), (60, 1, 2, "calls"), (60, 2, 4, "calls")]
    reviewed = spark.createDataFrame([(g, n) for g in range(61) for n in (0, 3, 6)], "range_id long, node long")
    want = set()
    for kind in ("calls", "exercises"):
        for way in ("out", "in"):
            own = [(g, a, b, k) if way == "out" else (g, b, a, k) for g, a, b, k in few if k == kind and a != b]
            for g, f, v, _ in own:
                past = _reach([x for x in own if x[0] == g], skip=f)[g, v] - {f, v}
                want.add((g, f, v, kind, way, len([n for n in past if n not in (0, 3, 6)])))
    got = graph.behind(_frame(spark, few), reviewed).select("range_id", "focus", "node", "kind", "direction", "n").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_a_long_chain_in_a_row_takes_no_rounds(spark):
    began = time.time()
    got = {r.node: r.depth for r in graph.depth(_frame(spark, [(1, i, i + 1, "calls") for i in range(63)])).collect()}
    assert got == {i: 63 - i for i in range(64)} and time.time() - began < 40
