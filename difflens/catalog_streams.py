"""Queries that run as streams, fed in steps with a restart between them, against the SQL of all their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from difflens.catalog import SQL, query
from difflens.sources import corpus
from difflens.streaming import live, state

STEPS = 3


def _events(spark: SparkSession, sf_dir: str, steps: int = STEPS) -> tuple[DataFrame, Column]:
    """The events, and the step in which each comes if all come in the order of their ids."""
    e = corpus.events(spark, sf_dir)
    n = (e.agg(F.max("event_id")).first()[0] or 0) + 1
    return e, F.expr(f"cast(event_id * {steps} div {n} as int)")


@query()
def st2_dwell_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2 on a stream: state by key, its changes merged into a table."""
    e, _ = _events(spark, sf_dir)
    kind, seq = F.col("event_type"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ticks = e.select(F.col("user_id").alias("key"), seq.cast("long").alias("seq"), kind.isin("view", "click", "error").alias("accruing"), (kind == "error").alias("spike"), (10 * F.col("k")).alias("dt"), (F.col("user_id") % 30).cast("int").alias("lines"))
    step = F.least(F.expr("cast((seq - 1) div 20 as int)"), F.lit(STEPS - 1))  # another number of ticks a step for each key
    changes = lambda s: live.dwell(s).withColumnRenamed("key", "id").withColumn("op", F.lit("upsert"))
    out = live.merged_stream(ticks.withColumn("batch", step), STEPS, changes, "update", "dwell")
    return out.select(F.col("id").alias("key"), "banked", "current", "cleared")


_MARKS = f"""m as (select user_id as section, k % 3 as chunk_id, event_id as seq, event_type in ('click', 'view', 'purchase') as reviewed, event_id * {STEPS} // ((select max(event_id) from events) + 1) as batch from c_events),
l as (select section, chunk_id, batch, max(seq) as seq, arg_max(reviewed, seq)::int as done from m group by all),
s as (select *, done - lag(done, 1, 0) over (partition by section, chunk_id order by batch) as step from l),
b as (select section, batch, max(seq) as seq, sum(step) as step from s group by all),
r as (select *, sum(step) over (partition by section order by batch) as done from b)
select section, seq from r where done >= 3 and done - step < 3"""


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, step = _events(spark, sf_dir)
    return e.select(F.col("user_id").alias("section"), (F.col("k") % 3).alias("chunk_id"), F.col("event_id").alias("seq"), F.col("event_type").isin("click", "view", "purchase").alias("reviewed"), F.lit(3).alias("total"), step.alias("batch"))


@query(f"with {_MARKS}")
def st3_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3 as a batch job: each step's snapshot against the one before."""
    return live.completions_of_batches(_marks(spark, sf_dir))


@query(f"with {_MARKS}")
def st3_completions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3 on a stream: a section is told once when it becomes complete."""
    return live.appended_stream(_marks(spark, sf_dir), STEPS, live.completions, "completions", "update")


@query()
def st5_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-5: changes that come out of order, merged into a stored table step by step."""
    e = corpus.events(spark, sf_dir)
    rows = e.select(F.col("k").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "value")
    return live.merged_stream(rows.withColumn("batch", (F.col("seq") % STEPS).cast("int")), STEPS, lambda s: s, "append", "latest").select("id", "value")


#: Every seventh event comes a step late; the watermark waits three days. Days that the last watermark hasn't passed aren't told yet.
@query("""with b as (select *, least(event_id * 4 // ((select max(event_id) from events) + 1) + (event_id % 7 = 0)::int, 3) as step from c_events),
w as (select step, max(max(ts)) over (order by step) - interval 3 day as mark from b group by step),
d as (select b.*, date_trunc('day', ts) + interval 1 day as day_end, w.mark from b left join w on w.step = b.step - 1)
select strftime(ts, '%Y-%m-%d') as day, event_type as kind, count(*) as calls, sum(k) as input, round(sum(value), 4) as cost from d
where (mark is null or day_end > mark) and day_end <= (select max(mark) from w) group by all""")
def st6_spend_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-6 on a stream in append mode: late rows count until the watermark passes their day."""
    e, step = _events(spark, sf_dir, 4)
    late = F.least(step + (F.col("event_id") % 7 == 0).cast("int"), F.lit(3))
    ledger = e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("k").alias("input"), F.col("value").alias("cost"), late.alias("batch"))
    return live.appended_stream(ledger, 4, lambda s: state.running_spend(s, "3 days"), "spend")


SQL |= {"st2_dwell_stream": SQL["st2_dwell"], "st5_merged": SQL["st5_latest"]}
