"""Chapter books: a spine over calls, tests woven into it, trailing tests, sections. All keyed by range_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from difflens.operators import book, graph

_LAST = 1 << 30


def layers(before: DataFrame) -> DataFrame:
    """range_id, node, depth: how long a chain of edges (range_id, first, then) leads to a node; nodes of a cycle share a depth."""
    flow = before.select("range_id", F.col("then").alias("src"), F.col("first").alias("dst"))
    return graph.depth(flow)


def spine(chunks: DataFrame, calls: DataFrame, direction: str = "consumer-first") -> DataFrame:
    """chunks with pos (1-based): callers before what they call, or the reverse; a connected part of the call graph stays together.

    Parts go by their best priority, then their earliest chunk; inside, by depth, first call line (consumer-first only), git rank.
    chunks: range_id, chunk, path, git_rank, priority; calls: range_id, src, dst, line between these chunks.
    """
    ends = ("src", "dst") if direction == "consumer-first" else ("dst", "src")
    calls = calls.where("src <> dst")
    depth = layers(calls.select("range_id", F.col(ends[0]).alias("first"), F.col(ends[1]).alias("then"))).withColumnRenamed("node", "chunk")
    line = F.min("line") if direction == "consumer-first" else F.lit(0)
    called = calls.groupBy("range_id", F.col(ends[1]).alias("chunk")).agg(line.alias("call_line"))
    part = graph.components(calls, chunks.select("range_id", F.col("chunk").alias("node"))).withColumnRenamed("node", "chunk")
    d = chunks.join(part, ["range_id", "chunk"]).join(depth, ["range_id", "chunk"], "left").join(called, ["range_id", "chunk"], "left")
    mine = Window.partitionBy("range_id", "component")
    d = d.withColumns({"part_priority": F.min("priority").over(mine), "part_rank": F.min("git_rank").over(mine)})
    order = ("part_priority", "part_rank", F.coalesce("depth", F.lit(0)), F.coalesce("call_line", F.lit(_LAST)), "git_rank")
    return d.select(*chunks.columns, F.row_number().over(Window.partitionBy("range_id").orderBy(*order)).alias("pos"))


def titled(chapters: DataFrame) -> DataFrame:
    """chapters (range_id, pos, chunk, path, chapter) with section_id and anchor_path of each chapter's first chunk."""
    first = F.min_by(F.struct("chunk", "path"), "pos").over(Window.partitionBy("range_id", "chapter"))
    d = chapters.withColumn("lead", first)
    return d.select("range_id", "pos", "chunk", "path", F.concat(F.lit("chapter:"), F.col("lead.chunk").cast("string")).alias("section_id"), F.col("lead.path").alias("anchor_path"))


def exercise_targets(edges: DataFrame, tests: DataFrame, chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """range_id, src, dst: the chunks that a test's references name; else, of a test file's first chunk only, the first chunk of the file it is anchored to.

    edges: range_id, src, dst, kind, source; tests, chunks: range_id, chunk, path, git_rank; anchors: range_id, test, impl (files).
    """
    named = edges.where("kind = 'exercises' and source = 'references'").select("range_id", "src", "dst").distinct()
    named = named.join(tests.select("range_id", F.col("chunk").alias("src")), ["range_id", "src"], "left_semi").join(chunks.select("range_id", F.col("chunk").alias("dst")), ["range_id", "dst"], "left_semi")
    lead = lambda d, path, chunk: d.groupBy("range_id", F.col("path").alias(path)).agg(F.min_by("chunk", "git_rank").alias(chunk))
    rest = anchors.join(lead(tests, "test", "src"), ["range_id", "test"]).join(lead(chunks, "impl", "dst"), ["range_id", "impl"]).select("range_id", "src", "dst").distinct()
    return named.select("range_id", "src", "dst").unionByName(rest.join(named.select("range_id", "src"), ["range_id", "src"], "left_anti"))


def woven(chapters: DataFrame, tests: DataFrame, targets: DataFrame, placement: str) -> DataFrame:
    """chapters with the tests that have a target: before its first (git order), after its last (reverse git order), or, with placement end, none.

    Returns range_id, slot, chunk, path, section_id, anchor_path.
    """
    rows = chapters.select("*", F.lit(1).alias("side"), F.lit(0).alias("tie"))
    if placement != "end":
        near = F.min("pos") if placement == "before" else F.max("pos")
        at = targets.join(chapters.select("range_id", F.col("chunk").alias("dst"), "pos"), ["range_id", "dst"]).groupBy("range_id", F.col("src").alias("chunk")).agg(near.alias("pos"))
        side, sign = (0, 1) if placement == "before" else (2, -1)
        beside = tests.join(at, ["range_id", "chunk"]).join(chapters.select("range_id", "pos", "section_id", "anchor_path"), ["range_id", "pos"])
        rows = rows.unionByName(beside.select("range_id", "pos", "chunk", "path", "section_id", "anchor_path", F.lit(side).alias("side"), (F.col("git_rank") * sign).cast("int").alias("tie")))
    slot = F.row_number().over(Window.partitionBy("range_id").orderBy("pos", "side", "tie"))
    return rows.select("range_id", slot.alias("slot"), "chunk", "path", "section_id", "anchor_path")


def trailing_tests(tests: DataFrame, placed: DataFrame, imports: DataFrame) -> DataFrame:
    """range_id, file_pos, chunk, path, git_rank: tests that stand nowhere yet, by file: helpers before what imports them, e2e files last of a depth, then git order.

    tests: range_id, chunk, path, git_rank, e2e; placed: range_id, chunk; imports: range_id, src, dst (files).
    """
    left = tests.join(placed.select("range_id", "chunk"), ["range_id", "chunk"], "left_anti")
    files = left.groupBy("range_id", "path").agg(F.min("git_rank").alias("file_rank"), F.bool_or("e2e").alias("e2e"))
    end = lambda c: files.select("range_id", F.col("path").alias(c))
    inner = imports.where("src <> dst").select("range_id", "src", "dst").distinct().join(end("src"), ["range_id", "src"], "left_semi").join(end("dst"), ["range_id", "dst"], "left_semi")
    depth = layers(inner.select("range_id", F.col("dst").alias("first"), F.col("src").alias("then"))).withColumnRenamed("node", "path")
    w = Window.partitionBy("range_id").orderBy(F.coalesce("depth", F.lit(0)), "e2e", "file_rank")
    files = files.join(depth, ["range_id", "path"], "left").select("range_id", "path", F.row_number().over(w).alias("file_pos"))
    return left.join(files, ["range_id", "path"]).select("range_id", "file_pos", "chunk", "path", "git_rank")


def sections(slots: DataFrame, trailing: DataFrame, rest: DataFrame) -> DataFrame:
    """range_id, section_no, section_id, pos, chunk, label: woven slots in runs of one chapter, trailing test files, low-signal files, leftovers.

    label: the chunk's file where it isn't its chapter's. rest: range_id, chunk, path, git_rank, bucket (low-signal or leftover).
    """
    part = lambda block, a, b: [F.lit(block).alias("block"), a.cast("int").alias("a"), b.cast("int").alias("b")]
    none = F.lit(None).cast("string").alias("label")
    label = F.when(F.col("path") != F.col("anchor_path"), F.col("path")).alias("label")
    rows = slots.select("range_id", "chunk", "section_id", label, *part(0, F.col("slot"), F.lit(0)))
    rows = rows.unionByName(trailing.select("range_id", "chunk", F.concat(F.lit("chapter:test:"), "path").alias("section_id"), none, *part(1, F.col("file_pos"), F.col("git_rank"))))
    low = F.col("bucket") == "low-signal"
    first = F.min("git_rank").over(Window.partitionBy("range_id", "bucket", "path"))
    rows = rows.unionByName(rest.select("range_id", "chunk", F.when(low, F.col("path")).otherwise("leftovers").alias("section_id"), none, F.when(low, 2).otherwise(3).alias("block"), F.when(low, first).otherwise(0).cast("int").alias("a"), F.col("git_rank").cast("int").alias("b")))
    w = Window.partitionBy("range_id").orderBy("block", "a", "b")
    new = F.coalesce((F.col("section_id") != F.lag("section_id").over(w)).cast("int"), F.lit(1))
    rows = rows.withColumns({"new": new, "pos": F.row_number().over(w)})
    return rows.select("range_id", F.sum("new").over(Window.partitionBy("range_id").orderBy("pos")).cast("int").alias("section_no"), "section_id", "pos", "chunk", "label")


def composed(spine_: DataFrame, overlay: DataFrame, stamps: DataFrame) -> DataFrame:
    """chapters (as titled gives them) of the overlays that are fresh and hold each chunk of the spine exactly once; other ranges have none.

    overlay: range_id, chapter (number), members (array, in order), fingerprint; stamps: range_id, fingerprint.
    """
    seen = overlay.join(stamps, ["range_id", "fingerprint"], "left_semi")
    check = book.partition_check(spine_.select("range_id", F.col("chunk").alias("key")), seen.select("range_id", "chapter", "members"))
    good = check.where("missing = 0 and unknown = 0 and duplicated = 0 and empty = 0").select("range_id").join(seen.select("range_id").distinct(), "range_id", "left_semi")
    rows = seen.join(good, "range_id", "left_semi").select("range_id", "chapter", F.posexplode("members").alias("i", "chunk"))
    pos = F.row_number().over(Window.partitionBy("range_id").orderBy("chapter", "i"))
    return titled(rows.withColumn("pos", pos).join(spine_.select("range_id", "chunk", "path"), ["range_id", "chunk"]).select("range_id", "pos", "chunk", "path", "chapter"))


def test_block(tests: DataFrame, own: DataFrame, imports: DataFrame) -> DataFrame:
    """range_id, test, anchor, position: a test takes the earliest anchor among itself and all tests that import it, directly or not; helpers come first, then git rank.

    tests: range_id, test, git_rank; own: range_id, test, anchor (a position; tests without one are absent); imports: range_id, src, dst between tests.
    """
    e = imports.where("src <> dst").select("range_id", "src", "dst").distinct()
    way = F.lit(0).alias("way")
    nodes = e.select("range_id", F.col("src").alias("test")).union(e.select("range_id", "dst")).union(own.select("range_id", "test")).distinct()
    first = nodes.join(own.groupBy("range_id", "test").agg(F.min("anchor").alias("anchor")), ["range_id", "test"], "left")
    best = graph.least_along(e.select("range_id", way, F.col("src").alias("at"), F.col("dst").alias("to")), first.select("range_id", way, F.col("test").alias("node"), F.col("anchor").alias("label")), follow=False)
    best = best.select("range_id", F.col("node").alias("test"), F.col("label").alias("anchor"))
    depth = graph.depth(e).withColumnRenamed("node", "test")
    d = tests.join(best, ["range_id", "test"], "left").join(depth, ["range_id", "test"], "left")
    w = Window.partitionBy("range_id").orderBy(F.col("anchor").asc_nulls_last(), F.coalesce("depth", F.lit(0)), "git_rank")
    return d.select("range_id", "test", "anchor", F.row_number().over(w).alias("position"))
