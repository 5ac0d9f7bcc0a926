"""Incremental state, each as a batch job and as a stream with the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("unseen", "seen", "reviewed")
MOST_DT, LEAST_DWELL, MOST_DWELL, DWELL_A_LINE = 700, 1500, 8000, 300


def review_state(patches: DataFrame) -> DataFrame:
    """range_id, chunk_id and the last supplied valid value of each field; a patch with an unknown state counts for nothing.

    An aggregation of one row a key, so it runs on a stream (update mode) as on a table.
    """
    valid = patches.where(F.col("state").isNull() | F.col("state").isin(*STATES))
    via = F.when(F.col("reviewed_via").isin("explicit", "auto"), F.col("reviewed_via"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    fields = {"state": F.col("state"), "auto_read": F.col("auto_read"), "expanded": F.col("expanded"), "reviewed_via": via}
    return valid.groupBy("range_id", "chunk_id").agg(*(last(c).alias(n) for n, c in fields.items()))


def dwell(ticks: DataFrame) -> DataFrame:
    """key, banked, current, cleared of ticks (key, seq, accruing, spike, dt, lines). A spike empties the running stretch; leaving banks it."""
    w = Window.partitionBy("key").orderBy("seq")
    run = F.sum(F.coalesce((F.col("accruing") != F.lag("accruing").over(w)).cast("int"), F.lit(1))).over(w)
    t = ticks.withColumn("run", run)
    t = t.withColumn("spikes_left", F.sum(F.col("spike").cast("int")).over(Window.partitionBy("key", "run").orderBy(F.desc("seq"))))
    kept = F.sum(F.when(F.col("accruing") & (F.col("spikes_left") == 0), F.least(F.col("dt"), F.lit(MOST_DT))).otherwise(0))
    runs = t.groupBy("key", "run").agg(kept.alias("ms"), F.max("lines").alias("lines"))
    last = F.col("run") == F.max("run").over(Window.partitionBy("key"))
    open_ = t.groupBy("key").agg(F.max_by("accruing", "seq").alias("open"))
    s = runs.withColumn("last", last).join(open_, "key")
    now = F.col("last") & F.col("open")
    g = s.groupBy("key").agg(F.sum(F.when(now, 0).otherwise(F.col("ms"))).alias("banked"), F.sum(F.when(now, F.col("ms")).otherwise(0)).alias("current"), F.max("lines").alias("lines"))
    need = F.least(F.greatest(F.col("lines") * DWELL_A_LINE, F.lit(LEAST_DWELL)), F.lit(MOST_DWELL))
    return g.select("key", "banked", "current", (F.col("banked") + F.col("current") >= need).alias("cleared"))


#: Fixed value: from which visible fraction on a row counts as seen.
MIN_VISIBLE = 0.6


def visible_fraction(top: Column, bottom: Column, view_top: Column, view_bottom: Column) -> Column:
    """The share of a row's height within the view, 0 to 1; 0 for a row without height."""
    height, overlap = bottom - top, F.least(bottom, view_bottom) - F.greatest(top, view_top)
    return F.when(height <= 0, F.lit(0.0)).otherwise(F.greatest(F.least(overlap, height), F.lit(0.0)) / height)


def newly(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys in after that weren't in before."""
    return after.select(key).distinct().join(before.select(key), key, "left_anti")


def latest_by_id(changes: DataFrame) -> DataFrame:
    """The last change (seq) of each id, deletions (op delete) left out."""
    return changes.groupBy("id").agg(F.max_by(F.struct("op", "value"), "seq").alias("x")).where("x.op <> 'delete'").select("id", "x.value")


def first_of_key(rows: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """One row a key: on a stream within the watermark's delay."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def running_spend(ledger: DataFrame, delay: str = "1 hour") -> DataFrame:
    """day, kind, calls, input, cost."""
    rows = ledger.withWatermark("ts", delay) if ledger.isStreaming else ledger
    g = rows.groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("calls"), F.sum("input").alias("input"), F.round(F.sum("cost"), 4).alias("cost"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "kind", "calls", "input", "cost")


def poll_interval_ms(pending: DataFrame, now) -> DataFrame:
    """poll_ms: null without anything pending, 3000 while the youngest (created) is under 30 s old, else 8000."""
    return pending.agg(F.max("created").alias("m")).select(F.when(F.col("m").isNull(), F.lit(None).cast("int")).when(F.unix_timestamp(F.lit(now)) - F.unix_timestamp("m") < 30, 3000).otherwise(8000).alias("poll_ms"))


def poll_intervals(deferrals: DataFrame, now) -> DataFrame:
    """key, poll_ms of deferrals (key, pending, created): null without anything pending, 3000 while the youngest pending one is under 30 s old, else 8000. now: a column aggregated from them or a literal."""
    youngest = F.max(F.when(F.col("pending"), F.col("created")))
    g = deferrals.groupBy("key").agg(youngest.alias("m"), now.alias("now"))
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("m").cast("timestamp"))
    return g.select("key", F.when(F.col("m").isNull(), F.lit(None).cast("int")).when(age < 30_000_000, 3000).otherwise(8000).alias("poll_ms"))
