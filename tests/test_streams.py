"""Streams against their batch jobs: any split into batches, restarts, replays and late rows."""

import datetime as dt
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from difflens.sources.scratch import shared_path
from difflens.streaming import live, state

TICK = "key long, seq long, accruing boolean, spike boolean, dt int, lines int, batch int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_dwell_stream_equals_batch_under_a_random_split(spark):
    rnd, ticks = random.Random(2), []
    for key in range(6):
        cuts = sorted(rnd.choices(range(40), k=2))
        for seq in range(40):
            accruing = rnd.random() < 0.7
            ticks.append((key, seq, accruing, accruing and rnd.random() < 0.1, rnd.choice([0, 50, 400, 2000]), rnd.randrange(12), sum(seq >= c for c in cuts)))
    t = spark.createDataFrame(ticks, TICK)
    out = live.merged_stream(t, 3, lambda s: live.dwell(s).withColumnRenamed("key", "id").withColumn("op", F.lit("upsert")), "update", "dwell-test")
    assert rows(out.select("id", "banked", "current", "cleared")) == rows(state.dwell(t.drop("batch")))


def test_merge_of_replayed_and_broken_batches(spark):
    table = live.Merged(spark, shared_path(spark, "merge-test"), buckets=3)
    kind = "id long, seq long, op string, value string"
    first = spark.createDataFrame([(1, 1, "upsert", "a"), (2, 2, "upsert", "b"), (3, 3, "delete", None)], kind)
    second = spark.createDataFrame([(2, 5, "delete", None), (3, 1, "upsert", "too old"), (4, 6, "upsert", "d")], kind)
    table.merge(first, 0)
    assert rows(table.read()) == [(1, 1, "a"), (2, 2, "b")]
    table.merge(spark.createDataFrame([(9, 9, "upsert", "other")], kind), 0)  # replayed: changes nothing, whatever it holds
    assert rows(table.read()) == [(1, 1, "a"), (2, 2, "b")]
    second.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table.path}/data/1")  # a crash before the manifest
    assert rows(table.read()) == [(1, 1, "a"), (2, 2, "b")]
    table.merge(second, 1)
    table.merge(first, 0)
    table.merge(second, 1)
    assert rows(table.read()) == [(1, 1, "a"), (4, 6, "d")]
    assert rows(table.read().select("id", "value")) == rows(state.latest_by_id(first.unionByName(second)))
    table.merge(spark.createDataFrame([(k, 7, "upsert", "n") for k in range(50)], kind), 2)
    table.clean()
    assert len(rows(table.read())) == 50


def test_late_rows(spark):
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    ledger = [(at(1), "a", 1, 1.0, 0), (at(5), "a", 1, 1.0, 0), (at(4, 12), "a", 10, 1.0, 1), (at(1, 5), "a", 100, 1.0, 1), (at(9), "b", 1, 1.0, 1), (at(9), "a", 1, 1.0, 2)]
    df = spark.createDataFrame(ledger, "ts timestamp, kind string, input long, cost double, batch int")
    path, held = shared_path(spark, "late-test"), []
    held += live.in_batches(df, 3, lambda s: state.running_spend(s, "2 days").writeStream.outputMode("append").format("parquet").option("path", path), "late-test")
    told = {(r.day, r.kind): r.input for r in spark.read.parquet(path).collect()}
    assert told == {("2024-01-01", "a"): 1, ("2024-01-04", "a"): 10, ("2024-01-05", "a"): 1}  # the first day was closed, the fourth not
    assert held[-1] == 2  # only the ninth's two rows of state are left


def test_first_of_key_within_the_watermark(spark):
    at = lambda day: dt.datetime(2024, 1, day)
    units = [("k", "f", at(1), 0), ("k", "f", at(2), 1), ("k", "g", at(9), 1), ("k", "f", at(10), 2), ("k", "g", at(10), 2)]
    df = spark.createDataFrame(units, "kind string, fingerprint string, ts timestamp, batch int")
    out = live.appended_stream(df, 3, lambda s: state.first_of_key(s, ["kind", "fingerprint"], "ts", "3 days"), "first-test")
    # f's state had gone by the tenth, so it counts as new again; g is still held
    assert sorted((r.fingerprint, r.ts.day) for r in out.collect()) == [("f", 1), ("f", 10), ("g", 9)]


def test_completions(spark):
    marks = [(1, "a", 1, True, 2, 0), (1, "b", 2, True, 2, 0), (1, "b", 3, False, 2, 1), (1, "b", 4, True, 2, 2), (2, "a", 5, True, 2, 1), (2, "b", 6, True, 2, 1), (2, "b", 7, False, 2, 1)]
    df = spark.createDataFrame(marks, "section long, chunk_id string, seq long, reviewed boolean, total int, batch int")
    assert rows(live.completions_of_batches(df)) == [(1, 2), (1, 4)]
    assert rows(live.appended_stream(df, 3, live.completions, "completions-test", "update")) == [(1, 2), (1, 4)]


def test_rows_of_all_steps_are_computed_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def step(key):
        asked.add(1)
        return key % 3

    t = spark.range(30).select(F.col("id"), F.col("id").alias("seq"), F.lit("upsert").alias("op"), step("id").alias("batch"))
    out = live.merged_stream(t, 4, lambda s: s, "append", "once-test")  # the last step has no rows
    assert [r[0] for r in rows(out.select("id"))] == list(range(30)) and asked.value == 30


def test_dwell_reads_and_writes_a_keys_state_once_a_step():
    class Held:
        value, asked = None, []

        def get(self):
            self.asked.append("get")
            return self.value

        def update(self, value):
            self.asked.append("update")
            self.value = value

    dwell = live._Dwell(None)
    dwell.held = Held()
    tick = lambda seq, accruing, spike, dt, lines: Row(key=7, seq=seq, accruing=accruing, spike=spike, dt=dt, lines=lines)
    first = list(dwell.handleInputRows((7,), iter([tick(2, True, False, 1000, 1), tick(1, True, False, 50, 3)]), None))
    assert first == [Row(key=7, seq=2, banked=0, current=state.MOST_DT + 50, cleared=False)]
    second = list(dwell.handleInputRows((7,), iter([tick(3, False, False, 0, 1), tick(4, True, False, 700, 1), tick(5, True, False, 700, 1)]), None))
    assert second == [Row(key=7, seq=5, banked=750, current=1400, cleared=True)]
    assert Held.asked == ["get", "update"] * 2 and dwell.held.value == (True, 750, 1400, 3)
