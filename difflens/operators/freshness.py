"""Fingerprints, fresh filters and work plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_fingerprint(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys, fingerprint: digest of the sorted distinct members."""
    return rows.groupBy(*keys).agg(F.md5(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), "\n")).alias("fingerprint"))


def _digest(*parts: Column) -> Column:
    """Of columns and arrays, line by line."""
    return F.md5(F.concat_ws("\n", *parts))


def graph_print(head: Column, version: str) -> Column:
    """What a range's graph depends on."""
    return _digest(head, F.lit(version))


def fingerprints(heads: DataFrame, sections: DataFrame, chapters: DataFrame, version: str) -> DataFrame:
    """range_id, kind, key, fingerprint of all that is stored of a range, each with what it depends on, in order.

    graph: head and version; context and chunk: these and the chunk (key); section: these, its id (key) and its chunks in
    order, wherever it stands; opener: the sorted distinct fingerprints of the sections; book: sections with their chunks,
    all in order; chapter: the chapters' chunks in order, tests left out by the caller. Chunk ids hold their content.

    heads: range_id, head; sections: range_id, section_no, section, pos, chunk; chapters: range_id, chapter_no, pos, chunk.
    """
    ids = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    version_ = F.lit(version)
    of = lambda d, kind, key, print_: d.select("range_id", F.lit(kind).alias("kind"), key.cast("string").alias("key"), print_.alias("fingerprint"))
    none = F.lit("")
    chunk = sections.select("range_id", "chunk").distinct().join(heads, "range_id")
    each = _digest("head", version_, F.col("chunk").cast("string"))
    by = sections.groupBy("range_id", "section_no", "section").agg(F.transform(ids("pos", "chunk"), lambda x: x["chunk"].cast("string")).alias("chunks")).join(heads, "range_id")
    by = by.withColumn("fingerprint", _digest("head", version_, F.col("section").cast("string"), "chunks"))
    opener = by.groupBy("range_id").agg(F.array_sort(F.collect_set("fingerprint")).alias("all"))
    book = by.groupBy("range_id", "head").agg(F.flatten(F.transform(ids("section_no", "section", "chunks"), lambda x: F.concat(F.array(x["section"].cast("string")), x["chunks"]))).alias("all"))
    story = chapters.groupBy("range_id", "chapter_no").agg(F.transform(ids("pos", "chunk"), lambda x: x["chunk"].cast("string")).alias("chunks"))
    story = story.groupBy("range_id").agg(F.flatten(F.transform(ids("chapter_no", "chunks"), lambda x: F.concat(F.array(F.lit("|")), x["chunks"]))).alias("all"))
    story = heads.join(story, "range_id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<string>")))
    out = of(heads, "graph", none, graph_print(F.col("head"), version))
    for d in (of(chunk, "context", F.col("chunk"), each), of(chunk, "chunk", F.col("chunk"), each), of(by, "section", F.col("section"), F.col("fingerprint")), of(opener, "opener", none, _digest("all")), of(book, "book", none, _digest("head", version_, "all")), of(story, "chapter", none, _digest("head", version_, F.lit("chapter"), "all"))):
        out = out.unionByName(d)
    return out


def fresh(stored: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """stored rows whose keys and fingerprint are live."""
    return stored.join(live.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_semi")


def work_plan(planned: DataFrame, active: DataFrame, failed: DataFrame, done: DataFrame, forced: bool = False) -> DataFrame:
    """unit, skip: null for what is to run, else active, failed or fresh. planned, done: unit, fingerprint; active, failed: unit."""
    mark = lambda d, name, keys: d.select(*keys).distinct().withColumn(name, F.lit(True))
    j = planned.join(mark(active, "is_active", ["unit"]), "unit", "left").join(mark(failed, "is_failed", ["unit"]), "unit", "left").join(mark(done, "is_fresh", ["unit", "fingerprint"]), ["unit", "fingerprint"], "left")
    skip = F.when(F.col("is_active"), "active")
    if not forced:
        skip = skip.when(F.col("is_failed"), "failed")
    return j.select("unit", skip.when(F.col("is_fresh"), "fresh").alias("skip"))


def orphans(jobs: DataFrame, active: DataFrame) -> DataFrame:
    """unit, status: stored `running` without an active unit is failed; an active unit is running whatever is stored."""
    on = active.select("unit").distinct().withColumn("on", F.lit(True))
    return jobs.join(on, "unit", "left").select("unit", F.when(F.col("on"), "running").when(F.col("status") == "running", "failed").otherwise(F.col("status")).alias("status"))


def fill_counters(units: DataFrame) -> DataFrame:
    """range_id, total, done, computed, skipped, capped, capped_count of units (range_id, pos, outcome: fresh, ok, error, full).

    Units are taken in order: fresh ones are skipped, errors leave theirs undone, and the first that finds the store full ends the run.
    """
    ended = F.min(F.when(F.col("outcome") == "full", F.col("pos"))).over(Window.partitionBy("range_id"))
    ran = F.col("ended").isNull() | (F.col("pos") < F.col("ended"))
    count = lambda *o: F.count_if(F.col("outcome").isin(*o) & ran)
    g = units.withColumn("ended", ended).groupBy("range_id").agg(F.count("*").alias("total"), count("fresh", "ok").alias("done"), count("ok").alias("computed"), count("fresh").alias("skipped"), F.bool_or(F.col("ended").isNotNull()).alias("capped"))
    return g.withColumn("capped_count", F.when(F.col("capped"), F.col("total") - F.col("done")).otherwise(0))


def narratable_sections(chunks: DataFrame) -> DataFrame:
    """section, narratable: not the leftovers, and not of low-signal chunks alone. chunks: section, leftover, low_signal."""
    return chunks.groupBy("section").agg((~F.bool_or("leftover") & ~F.bool_and("low_signal")).alias("narratable"))


def auto_run(enabled: Column, fresh_overlay: Column, in_flight: Column, failed: Column) -> Column:
    return enabled & ~fresh_overlay & ~in_flight & ~failed
