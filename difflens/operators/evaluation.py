"""Progress, spend, review statistics and evaluation rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from difflens.functions import text


def section_progress(chunks: DataFrame) -> DataFrame:
    """section, done, total, status of chunks (section, reviewed)."""
    g = chunks.groupBy("section").agg(F.count_if("reviewed").alias("done"), F.count("*").alias("total"))
    return g.withColumn("status", F.when(F.col("done") == 0, "untouched").when(F.col("done") < F.col("total"), "partial").otherwise("complete"))


def batchable_sections(chunks: DataFrame) -> DataFrame:
    """section, n_chunks, reasons, stubs, read: sections whose unreviewed chunks are all stubs or auto-read. chunks: section, chunk_id, reviewed, auto_read, stub_reason."""
    open_ = chunks.where("not reviewed")
    g = open_.groupBy("section").agg(F.bool_and(F.coalesce("auto_read", F.lit(False)) | F.col("stub_reason").isNotNull()).alias("ok"), F.count_distinct("chunk_id").alias("n_chunks"), F.array_sort(F.collect_set("stub_reason")).alias("reasons"), F.count_distinct(F.when(F.col("stub_reason").isNotNull(), F.col("chunk_id"))).alias("stubs"))
    g = g.withColumn("read", F.col("n_chunks") - F.col("stubs"))
    return g.where("ok").drop("ok")


def spend(ledger: DataFrame, *keys: str) -> DataFrame:
    """keys, calls, input, output, cost (null where no entry has one)."""
    return ledger.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.round(F.sum("cost"), 6).alias("cost"))


def size_stats(rows: DataFrame, group: str, value: str, small: int = 10) -> DataFrame:
    """group, n, least, p50, p90 (interpolated), most, mean, small_share."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("least"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), F.round(F.avg((F.col(value) <= small).cast("double")), 6).alias("small_share"))


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """unit, outcome of attempts (unit, seq, result): a final result stands; one more try after invalid output, two more after a transient fault."""
    ranked = attempts.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("seq", "result"))).alias("log"))
    start = F.struct(F.lit(0).alias("invalid"), F.lit(0).alias("transient"), F.lit(None).cast("string").alias("end"))

    def step(acc, x):
        invalid = acc["invalid"] + (x["result"] == "invalid-output").cast("int")
        transient = acc["transient"] + (x["result"] == "transient").cast("int")
        end = F.when(x["result"].isin("done", "gate-failed", "refused"), x["result"]).when((invalid > 1) | (transient > 2), "failed")
        return F.when(acc["end"].isNotNull(), acc).otherwise(F.struct(invalid.alias("invalid"), transient.alias("transient"), end.alias("end")))

    return ranked.select("unit", F.coalesce(F.aggregate("log", start, step)["end"], F.lit("pending")).alias("outcome"))


def judge_gate(scores: DataFrame, group: str) -> DataFrame:
    """group, register, orientation (medians), faithfulness (least), passed."""
    g = scores.groupBy(group).agg(F.median("register").alias("register"), F.median("orientation").alias("orientation"), F.min("faithfulness").alias("faithfulness"))
    return g.withColumn("passed", (F.col("register") >= 4) & (F.col("orientation") >= 4) & (F.col("faithfulness") >= 4))


def pairwise_tally(trials: DataFrame) -> DataFrame:
    """winner, trials: trials (answer A or B, a_is) name the book that A stood for; other answers are invalid."""
    book = F.when(F.col("answer") == "A", F.col("a_is")).when(F.col("answer") == "B", F.when(F.col("a_is") == "model", "plain").otherwise("model")).otherwise("invalid")
    return trials.groupBy(book.alias("winner")).agg(F.count("*").alias("trials"))


def stub_states(deferrals: DataFrame) -> DataFrame:
    """chunk_id, n, state (ready, answering, failed, note: the first that any has), first_seq. deferrals: chunk_id, seq, kind, status."""
    state = F.when(F.bool_or(F.col("status") == "done"), "ready").when(F.bool_or(F.col("status") == "running"), "answering").when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("note")
    return deferrals.groupBy("chunk_id").agg(F.count("*").alias("n"), state.alias("state"), F.min("seq").alias("first_seq"))


def status_counts(units: DataFrame) -> DataFrame:
    """kind, queued, running, done, failed. units: kind, status."""
    return units.groupBy("kind").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "done", "failed")))


def floor_percentiles(rows: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """group, share, value: the sorted values' element number floor(share * n). Equal values are counted first; nothing is collected."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(value)
    c = counts.withColumn("upto", F.sum("n").over(w)).join(counts.groupBy(group).agg(F.sum("n").alias("total")), group)
    d = c.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    at = F.least(F.floor(F.col("share") * F.col("total")), F.col("total") - 1)
    return d.where(F.col("upto") > at).groupBy(group, "share").agg(F.min(value).alias("value"))


def narration_coverage(units: DataFrame, jobs: DataFrame) -> DataFrame:
    """section, kind (null while nothing is engaged, partial, complete), narrated, narratable. units: section, narrated; jobs: section, status."""
    g = units.groupBy("section").agg(F.count_if("narrated").alias("narrated"), F.count("*").alias("narratable")).join(jobs, "section", "left")
    engaged = F.col("status").isNotNull() | (F.col("narrated") > 0)
    kind = F.when(engaged, F.when((F.col("status") == "running") | (F.col("narrated") < F.col("narratable")), "partial").otherwise("complete"))
    return g.select("section", kind.alias("kind"), "narrated", "narratable")


def valid_scores(scores: DataFrame, floor: int = 4) -> DataFrame:
    """scores with valid: each of orientation, register, faithfulness is 1 to 5, and a faithfulness below the floor has a quote."""
    whole = [F.coalesce((F.col(c) == F.floor(c)) & F.col(c).between(1, 5), F.lit(False)) for c in ("orientation", "register", "faithfulness")]
    quoted = (F.col("faithfulness") >= floor) | (F.trim(F.coalesce("quote", F.lit(""))) != "")
    return scores.withColumn("valid", whole[0] & whole[1] & whole[2] & quoted)


def label_precision(labels: DataFrame, group: str, gate: float = 0.9) -> DataFrame:
    """group, n, precision, passed. labels: relevant."""
    g = labels.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(F.col("relevant").cast("double")), 6).alias("precision"))
    return g.withColumn("passed", F.col("precision") >= gate)


def deferral_clusters(deferrals: DataFrame) -> DataFrame:
    """key, deferred (distinct chunks), ready, answering, failed, arriving, text. deferrals: key, chunk_id, inline, ai, status; inline ones count only as arriving."""
    out, open_ = ~F.col("inline"), F.col("ai") & ~F.coalesce(F.col("status").isin("done", "failed"), F.lit(False))
    status = lambda s: F.coalesce(F.col("status") == s, F.lit(False))
    g = deferrals.groupBy("key").agg(
        F.count_distinct(F.when(out, F.col("chunk_id"))).alias("deferred"), F.count_if(out & F.col("ai") & status("done")).alias("ready"), F.count_if(out & open_).alias("answering"),
        F.count_if(out & F.col("ai") & status("failed")).alias("failed"), F.count_if(open_).alias("arriving"),
    )
    n = lambda c: F.col(c).cast("string")
    ready = F.concat(F.lit(" · "), n("ready"), F.when(F.col("ready") == 1, " answer ready").otherwise(" answers ready"))
    wait = F.concat(F.lit(" · "), n("answering"), F.lit(" answering"))
    tail = F.when(F.col("ready") > 0, ready).when((F.col("failed") == 0) & (F.col("answering") > 0), wait).otherwise("")
    bad = F.when(F.col("failed") > 0, F.concat(F.lit(" · "), n("failed"), F.lit(" failed"))).otherwise("")
    return g.withColumn("text", F.when(F.col("deferred") > 0, F.concat(n("deferred"), F.lit(" deferred"), tail, bad)).otherwise(""))


def deferred_chunks(deferrals: DataFrame) -> DataFrame:
    """key, chunk_id, place (in order of first appearance), n, first_range (the first that any has). deferrals: key, seq, chunk_id, inline, line_range."""
    g = deferrals.where(~F.col("inline")).groupBy("key", "chunk_id").agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.min_by("line_range", F.when(F.col("line_range").isNotNull(), F.col("seq"))).alias("first_range"))
    return g.select("key", "chunk_id", F.row_number().over(Window.partitionBy("key").orderBy("first")).alias("place"), "n", "first_range")


def label_eval(entries: DataFrame, live: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, narrated, missing, stale, gate_failures, judged, invalid, register, grounding (medians), flags, floor_met.

    entries: keys, id, badge, line, fingerprint (those without either text don't count); live: id, expected; results: id, register, grounding, faithfulness (all null if the judge's answer was none).
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    e = entries.where(~(blank("badge") & blank("line"))).join(live, "id", "left").join(results.withColumn("answered", F.lit(True)), "id", "left")
    missing, narrated = F.col("expected").isNull(), F.coalesce(F.col("fingerprint") == F.col("expected"), F.lit(False))
    checks = F.when(blank("line"), 0).otherwise((F.size(text.register_failures(F.col("line"), F.lit("chunk"))) > 0).cast("int")) + F.when(blank("badge"), 0).otherwise((F.size(text.badge_failures(F.col("badge"))) > 0).cast("int"))
    judged = narrated & F.col("register").isNotNull()
    g = e.groupBy(*keys).agg(
        F.count_if(narrated).alias("narrated"), F.count_if(missing).alias("missing"), F.count_if(~missing & ~narrated).alias("stale"), F.sum(F.when(narrated, checks).otherwise(0)).alias("gate_failures"),
        F.count_if(judged).alias("judged"), F.count_if(narrated & F.col("answered") & F.col("register").isNull()).alias("invalid"), F.median(F.when(judged, F.col("register"))).alias("register"),
        F.median(F.when(judged, F.col("grounding"))).alias("grounding"), F.count_if(judged & (F.col("faithfulness") == "FLAG")).alias("flags"),
    )
    return g.withColumn("floor_met", (F.col("flags") == 0) & (F.col("judged") > 0))
