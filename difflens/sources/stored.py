"""A stored table that follows its inputs: what depends on a changed fingerprint is rebuilt, the rest stays as it was written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART, PRINT, HELD, BUILT = "_part", "_fingerprint", "_held", "_built"


def refresh(spark: SparkSession, path: str, live: DataFrame, build: Callable[[DataFrame], DataFrame], keys: list[str], schema: str, parts: int = 64) -> DataFrame:
    """The rows of all live keys, after those without a stored, equal fingerprint were built anew into path.

    live: keys, fingerprint, one row a key. build takes the stale keys and returns their rows, no others (keys and the
    columns of schema); a key may have none. Stored rows lie in directories by a hash of the first key; only those that hold a stale key
    are written again, with their fresh rows as they are, by dynamic overwrite, each in its place by one rename. Every key has
    a row of its own beside its results, so that a key without any counts as built. Those rows live and die with their
    directory: a directory that a lost job didn't bring back holds no keys, which makes them stale for the next run. Running
    again with the same live builds and writes nothing. Keys that are no longer live aren't returned, and go when their
    directory is next written. A null key equals a null key.

    One writer a path at a time. parts is the path's for good: as many as keep a directory at some 128 MB to 1 GB.
    """
    part = F.pmod(F.xxhash64(keys[0]), F.lit(parts)).cast("int").alias(PART)
    of_key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in live.select(*keys).schema)
    columns = f"{of_key}, {PRINT} string, {HELD} boolean, {schema}, {PART} int"
    stored = _read(spark, path, columns)
    now = live.select(*keys, F.col("fingerprint").alias(PRINT))
    if stored is None:
        told = now.withColumn(BUILT, F.lit(False))
    else:
        marks = stored.where(f"not {HELD}").select(*keys, PRINT, F.lit(True).alias("_mark"))
        told = _matched(now, marks, [*keys, PRINT], "left").withColumn(BUILT, F.coalesce("_mark", F.lit(False))).drop("_mark")
    told = told.persist(StorageLevel.DISK_ONLY)
    try:
        if told.where(~F.col(BUILT)).count():  # goes through all rows, so that all are kept and Spark knows their size
            stale = told.where(~F.col(BUILT)).select(*keys, PRINT, part)
            # a key's fingerprint is on its own row alone: a digest on every result would be most of what is shuffled and written
            fresh = build(stale.select(*keys)).withColumn(HELD, F.lit(True)).withColumn(PART, part)
            rows = stale.withColumn(HELD, F.lit(False)).unionByName(fresh, allowMissingColumns=True)
            if stored is not None:
                old = stored.join(F.broadcast(stale.select(PART).distinct()), PART, "left_semi")  # at most parts rows
                rows = _matched(old, told.where(BUILT).select(*keys), keys, "left_semi").unionByName(rows, allowMissingColumns=True)
            # rebalanced by directory: a hot one is split among tasks, small ones share a task
            rows.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
            stored = _read(spark, path, columns)
    finally:
        told.unpersist()
    if stored is None:
        return spark.createDataFrame([], f"{of_key}, {schema}")
    # a live key's results are of its fingerprint by now
    return _matched(stored.where(HELD), now.select(*keys), keys, "left_semi").drop(PART, PRINT, HELD)


def _matched(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """left joined to right where all names are equal, nulls too; names come from left alone."""
    other = right.withColumnsRenamed({n: f"_right{n}" for n in names}).hint("merge")  # keys may be many more than Spark thinks from the file's size
    on = [F.col(n).eqNullSafe(F.col(f"_right{n}")) for n in names]
    return left.join(other, on, how).drop(*(f"_right{n}" for n in names))


def refresh_graph(spark: SparkSession, path: str, prints: DataFrame, build: Callable[[DataFrame], DataFrame], schema: str, parts: int = 64) -> DataFrame:
    """Stored graphs by range_id, one a range; prints as freshness.fingerprints gives them."""
    return refresh(spark, path, prints.where("kind = 'graph'").select("range_id", "fingerprint"), build, ["range_id"], schema, parts)


def refresh_chunks(spark: SparkSession, path: str, prints: DataFrame, kind: str, build: Callable[[DataFrame], DataFrame], schema: str, parts: int = 64) -> DataFrame:
    """Stored contexts (kind context), narration (chunk) or sections (section) by range_id and key; prints as freshness.fingerprints gives them."""
    return refresh(spark, path, prints.where(F.col("kind") == kind).select("range_id", "key", "fingerprint"), build, ["range_id", "key"], schema, parts)


def _read(spark: SparkSession, path: str, columns: str) -> DataFrame | None:
    """What is stored; None before anything is."""
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
