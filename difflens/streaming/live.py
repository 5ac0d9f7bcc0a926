"""State kept by streams: dwell, completions and merged tables, each with the result that the batch job has on all rows so far.

A stream's changes go to a stored table by merge(), which a replayed batch leaves as it is, so a restart after a crash
counts nothing twice. Rows of one key come in the order of their seq from batch to batch (within a batch in any order).
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from difflens.sources.scratch import shared_path
from difflens.streaming.state import DWELL_A_LINE, LEAST_DWELL, MOST_DT, MOST_DWELL

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within may hold arbitrary keyed state."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


# ---- ST-2


class _Dwell(StatefulProcessor):
    """Takes rows, not data frames: a step brings a key few ticks, for which making a data frame costs more than the ticks."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("dwell", "accruing boolean, banked long, current long, lines int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        accruing, banked, current, lines = self.held.get() or (False, 0, 0, 0)
        for tick in sorted(rows, key=lambda r: r["seq"]):
            if not tick["accruing"]:
                banked, current = banked + current, 0
            elif tick["spike"]:
                current = 0
            else:
                current += min(int(tick["dt"]), MOST_DT)
            accruing, lines = bool(tick["accruing"]), max(lines, tick["lines"])
        self.held.update((accruing, banked, current, lines))
        need = min(max(lines * DWELL_A_LINE, LEAST_DWELL), MOST_DWELL)
        yield Row(key=key[0], seq=tick["seq"], banked=banked, current=current, cleared=banked + current >= need)

    def close(self) -> None:
        pass


def dwell(ticks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """key, seq, banked, current, cleared after each batch, for the keys it holds. ticks: a stream of state.dwell()'s rows.

    A key without ticks for ttl_ms is forgotten; such a stream watches the clock, so it needs a trigger by processing time
    (availableNow would not end).
    """
    kind = ticks.schema["key"].dataType.simpleString()
    return ticks.groupBy("key").transformWithState(
        _Dwell(ttl_ms), f"key {kind}, seq long, banked long, current long, cleared boolean", "Update", "ProcessingTime" if ttl_ms else "None")


# ---- ST-3


class _Completion(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("reviewed", "chunk_id string", "seq long, reviewed boolean")
        self.count = handle.getValueState("count", "reviewed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        news = pd.concat(list(rows)).sort_values("seq").drop_duplicates("chunk_id", keep="last")
        count = before = self.count.get()[0] if self.count.exists() else 0
        for chunk, seq, reviewed in zip(news["chunk_id"].astype(str), news["seq"], news["reviewed"], strict=True):
            old = self.done.getValue((chunk,)) if self.done.containsKey((chunk,)) else (-1, False)
            if seq > old[0]:
                count += int(bool(reviewed)) - int(old[1])
                self.done.updateValue((chunk,), (int(seq), bool(reviewed)))
        self.count.update((count,))
        total = int(news["total"].max())
        if before < total <= count:
            yield pd.DataFrame({"section": [key[0]], "seq": [int(news["seq"].max())]})

    def close(self) -> None:
        pass


def completions(marks: DataFrame) -> DataFrame:
    """section, seq: sections that a batch completes, at its last mark; once, until they are open again. marks: a stream of section, chunk_id, seq, reviewed and total (chunks of the section)."""
    kind = marks.schema["section"].dataType.simpleString()
    return marks.groupBy("section").transformWithStateInPandas(_Completion(), f"section {kind}, seq long", "Update", "None")


def completions_of_batches(marks: DataFrame) -> DataFrame:
    """completions() of a table with the number of the batch of each row: the difference of each batch's snapshot to the one before."""
    last = marks.groupBy("section", "chunk_id", "batch").agg(F.max_by("reviewed", "seq").alias("reviewed"), F.max("seq").alias("seq"), F.max("total").alias("total"))
    before = F.lag("reviewed", 1, False).over(Window.partitionBy("section", "chunk_id").orderBy("batch"))
    moved = last.withColumn("step", F.col("reviewed").cast("int") - before.cast("int"))
    by_batch = moved.groupBy("section", "batch").agg(F.sum("step").alias("step"), F.max("seq").alias("seq"), F.max("total").alias("total"))
    done = by_batch.withColumn("done", F.sum("step").over(Window.partitionBy("section").orderBy("batch")))
    return done.where((F.col("done") >= F.col("total")) & (F.col("done") - F.col("step") < F.col("total"))).select("section", "seq")


# ---- ST-5


class Merged:
    """A stored table of the last change (seq) of each id, in buckets by the id's hash; a deletion stays as a mark, so that a change older than it doesn't bring the id back.

    A batch rewrites the buckets it touches under its own number; a manifest names each bucket's folder and the last batch.
    It is renamed into place when all is written: before that, the batch counts as not done; after it, as done.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _hadoop(self):
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        """batch (-1 without any), and the folder of each bucket that has rows."""
        fs, root = self._hadoop(), self._at("manifest")
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit()] if fs.exists(root) else []
        if not numbers:
            return {"batch": -1, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{max(numbers)}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        fs, draft = self._hadoop(), self._at(f"manifest/.{manifest['batch']}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.rename(draft, self._at(f"manifest/{manifest['batch']}"))

    def _stored(self, folders: list[str], schema) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def merge(self, changes: DataFrame, batch: int) -> None:
        """Takes a batch of changes (id, seq, op and any values; op delete deletes) in; foreachBatch's function. A batch that was taken in before is left out."""
        now = self._manifest()
        if batch <= now["batch"]:
            return
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        changes = changes.persist()
        try:
            touched = sorted(r[0] for r in changes.select(bucket).distinct().collect())  # at most `buckets` numbers
            old = self._stored([now["folders"][str(b)] for b in touched if str(b) in now["folders"]], changes.schema)
            rows = changes if old is None else old.unionByName(changes)
            last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "seq").alias("x")).select("id", "x.*").select(*changes.columns)
            last.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch}")
        finally:
            changes.unpersist()
        self._commit({"batch": batch, "folders": now["folders"] | {str(b): f"data/{batch}/bucket={b}" for b in touched}, "schema": changes.schema.jsonValue()})

    def read(self) -> DataFrame:
        """The rows that aren't deleted, with their seq."""
        now = self._manifest()
        return self._stored(sorted(set(now["folders"].values())), StructType.fromJson(now["schema"])).where("op <> 'delete'").drop("op")

    def clean(self) -> None:
        """Removes what the manifest no longer names; no reader may be on an older one."""
        now, fs = self._manifest(), self._hadoop()
        used = {f.split("/")[1] for f in now["folders"].values()}
        for s in fs.listStatus(self._at("data")) if fs.exists(self._at("data")) else []:
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)


# ---- running a stream over a table


def in_batches(rows: DataFrame, batches: int, job: Callable[[DataFrame], object], name: str) -> list[int]:
    """Feeds rows to a stream in steps by their column `batch` (0 to batches - 1): each step's rows are put into the shared folder, then the stream starts anew from its checkpoint and takes them in. rows are computed once for all steps.

    job gets the streaming DataFrame and returns a DataStreamWriter without checkpoint and trigger. Returns the rows of state that the stream held after each step.
    """
    held = []
    spark, root = rows.sparkSession, shared_path(rows.sparkSession, name)
    plain = rows.drop("batch")
    rows.write.partitionBy("batch").parquet(f"{root}/steps")
    steps = spark.read.schema(rows.schema).parquet(f"{root}/steps")
    with keyed_state(spark):
        for i in range(batches):
            steps.where(F.col("batch") == i).select(*plain.columns).write.mode("append").parquet(f"{root}/in")
            source = spark.readStream.schema(plain.schema).parquet(f"{root}/in")
            query = job(source).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            held.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) if query.lastProgress else 0)
    return held


def merged_stream(rows: DataFrame, batches: int, changes: Callable[[DataFrame], DataFrame], mode: str, name: str) -> DataFrame:
    """The table that a stream of changes leaves: changes gets the streaming rows and returns id, seq, op and values."""
    table = Merged(rows.sparkSession, shared_path(rows.sparkSession, f"{name}-table"))
    in_batches(rows, batches, lambda s: changes(s).writeStream.outputMode(mode).foreachBatch(table.merge), name)
    return table.read()


def appended_stream(rows: DataFrame, batches: int, result: Callable[[DataFrame], DataFrame], name: str, mode: str = "append") -> DataFrame:
    """The rows that a stream appends (with a watermark, once it has passed them)."""
    path = shared_path(rows.sparkSession, f"{name}-out")
    kept: list = []

    def job(source: DataFrame):
        out = result(source)
        kept[:] = [out.schema]
        if mode == "append":
            return out.writeStream.outputMode(mode).format("parquet").option("path", path)
        return out.writeStream.outputMode(mode).foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}"))

    in_batches(rows, batches, job, name)
    return rows.sparkSession.read.schema(kept[0]).parquet(path).select(kept[0].names)
