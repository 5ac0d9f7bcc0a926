"""Checks of a book's order, edge counts, and what of stored overlays still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflens.operators import freshness, graph


def edge_counts(edges: DataFrame) -> DataFrame:
    """kind, n: distinct edges of all graphs by kind, without self-edges."""
    return edges.where("src <> dst").select(*graph.KEYS, "kind").distinct().groupBy("kind").agg(F.count("*").alias("n"))


def chapter_order(edges: DataFrame, positions: DataFrame, nodes: DataFrame, sccs: DataFrame, modes: list[tuple[str, str]]) -> DataFrame:
    """direction, placement, range_id, kind, src, dst, category of the edges that a book's order goes against, for each mode (direction, placement).

    Calls go by direction: consumer-first wants the caller earlier, dependency-first later. Of exercise edges only those from
    a test to what is none count, by placement: before or after what they test, or, with end, not at all. Low-signal chunks and
    chunks without a position are left out. category: cycle if both chunks reach each other by calls, else inversion or
    test-order.

    positions: range_id, chunk, pos (of the first occurrence); nodes: range_id, chunk, is_test, low_signal; sccs: cycles of
    the calls between chunks with a position (range_id, node, scc).
    """
    known = positions.join(nodes, ["range_id", "chunk"]).where("not low_signal")
    end = lambda c: known.select("range_id", F.col("chunk").alias(c), F.col("pos").alias(f"{c}_pos"), F.col("is_test").alias(f"{c}_test"))
    e = edges.where("src <> dst and kind in ('calls', 'exercises')").select(*graph.KEYS, "kind").distinct()
    e = e.join(end("src"), ["range_id", "src"]).join(end("dst"), ["range_id", "dst"])
    later, tests = F.col("src_pos") > F.col("dst_pos"), F.col("src_test") & ~F.col("dst_test")
    e = e.withColumn("mode", F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.lit(p).alias("placement")) for d, p in modes))))
    wrong = F.when(F.col("kind") == "calls", later == (F.col("mode.direction") == "consumer-first"))
    wrong = wrong.otherwise(tests & (F.col("mode.placement") != "end") & (later == (F.col("mode.placement") == "before")))
    at = lambda c: sccs.select("range_id", F.col("node").alias(c), F.col("scc").alias(f"{c}_scc"))
    category = F.when(F.col("src_scc") == F.col("dst_scc"), "cycle").when(F.col("kind") == "calls", "inversion").otherwise("test-order")
    return e.where(wrong).join(at("src"), ["range_id", "src"], "left").join(at("dst"), ["range_id", "dst"], "left").select("mode.direction", "mode.placement", "range_id", "kind", "src", "dst", category.alias("category"))


def file_order(edges: DataFrame, files: DataFrame) -> DataFrame:
    """range_id, src, dst, category of the imports whose file stands before what it imports: cycle if both lie on one cycle, test-order from a test to what is none, else inversion.

    Files among the leftovers have no position: imports from or to them don't count, nor do paths through them. Files of
    low-signal chunks alone are exempt, but paths may lead through them. edges: range_id, src, dst; files: range_id, file,
    pos, leftover, low_signal, is_test.
    """
    placed = files.where("not leftover")
    end = lambda c: placed.select("range_id", F.col("file").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("pos", "low_signal", "is_test")))
    e = edges.where("src <> dst").select(*graph.KEYS).distinct().join(end("src"), ["range_id", "src"]).join(end("dst"), ["range_id", "dst"])
    sccs = graph.strong(e)
    at = lambda c: sccs.select("range_id", F.col("node").alias(c), F.col("scc").alias(f"{c}_scc"))
    wrong = e.where("src_pos < dst_pos and not src_low_signal and not dst_low_signal").join(at("src"), ["range_id", "src"], "left").join(at("dst"), ["range_id", "dst"], "left")
    category = F.when(F.col("src_scc") == F.col("dst_scc"), "cycle").when(F.col("src_is_test") & ~F.col("dst_is_test"), "test-order").otherwise("inversion")
    return wrong.select(*graph.KEYS, category.alias("category"))


def unit_fingerprints(members: DataFrame, keys: list[str], of: str) -> DataFrame:
    """keys, fingerprint: digest of a unit's sorted member fingerprints, repeated ones too."""
    joined = F.array_join(F.array_sort(F.collect_list(of)), "|")
    return members.groupBy(*keys).agg(F.md5(F.concat(F.lit("unit:"), joined)).alias("fingerprint"))


def overlay_fresh(version: Column, stored: Column, book_key: Column, story_key: Column) -> Column:
    """Whether an overlay's key is the live one of its version: 1 the book's, 2 the composition's. A book of the other mode lacks that key, so its overlay is stale."""
    return F.coalesce(stored == F.when(version == 2, story_key).when(version == 1, book_key), F.lit(False))


def fresh_graph(edges: DataFrame, stores: DataFrame, live: DataFrame) -> DataFrame:
    """The edges of the stores (range_id, version, fingerprint) of version 1 whose fingerprint is live; a stale store has none."""
    good = freshness.fresh(stores.where("version = 1"), live, ["range_id"]).select("range_id").distinct()
    return edges.join(good, "range_id", "left_semi")


def fresh_narration(books: DataFrame, entries: DataFrame, live: DataFrame, openers: DataFrame) -> DataFrame:
    """book, version, entries (sorted keys that are still live), opener_key, opener of every overlay.

    Version 1 holds sections and an opener, whose text goes and whose key moves on if the book's live key (null: none) is
    another; version 2 holds chunks only. books: book, version, opener_key, opener; entries: book, key, fingerprint; live:
    book, key, fingerprint; openers: book, live_key.
    """
    kept = freshness.fresh(entries, live, ["book", "key"]).groupBy("book").agg(F.array_sort(F.collect_set("key")).alias("entries"))
    b = books.join(openers, "book", "left").join(kept, "book", "left")
    first, same = F.col("version") == 1, F.col("opener_key").eqNullSafe(F.col("live_key"))
    none = F.array().cast(kept.schema["entries"].dataType)
    return b.select("book", "version", F.coalesce("entries", none).alias("entries"), F.when(first, F.col("live_key")).alias("opener_key"), F.when(first, F.when(same, F.col("opener")).otherwise("")).alias("opener"))
