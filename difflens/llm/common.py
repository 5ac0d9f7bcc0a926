"""What the training-data operators share: the shared folder, written intermediate tables, words and their hashes."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: space and \t \n \v \f \r.
SPACES = (9, 10, 11, 12, 13, 32)
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes that a Python task works on at a time.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (in tests) a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='difflens-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths in the shared folder with what removes them, oldest first; the rest go when the driver's Python ends.
_paths: dict[str, Callable[[], None]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/difflens-{name}-{uuid.uuid4().hex}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop():
        with contextlib.suppress(Exception):  # the JVM may have ended
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hadoop).delete(p, True)

    if not _paths:
        atexit.register(lambda: forget(*_paths))
    _paths[path] = drop
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*held: DataFrame | str) -> None:
    """Removes materialised tables, or paths, that nothing reads any more."""
    for x in held:
        if drop := _paths.pop(x if isinstance(x, str) else x.scratch, None):
            drop()


@contextlib.contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Adds to `paths` what is written in the shared folder within the block."""
    before = set(_paths)
    try:
        yield
    finally:
        paths += [p for p in _paths if p not in before]


def stable(docs: DataFrame) -> DataFrame:
    """docs, if it is a plain read of files (projected or filtered), whose partitions hold the same rows each time; else docs written and read again."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    nodes = [line.strip(" +-:*()0123456789") for line in plan.splitlines() if line.strip()]
    plain = all(re.match(r"Project|Filter|FileScan|ColumnarToRow|WholeStageCodegen|InputAdapter", x) for x in nodes) and any(x.startswith("FileScan") for x in nodes)
    return docs if plain else materialise(docs, "docs")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's text modulo mod; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def label_sample(labels: DataFrame, value: str, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id and value (0 or 1; of several the largest) of about `rows` ids of each value, 4 * rows in all at the very most, and the ids of each value.

    Ids are dealt by their hash, before any text is read; a null id is none.
    """
    ids = labels.where(f"doc_id is not null and {value} in (0, 1)").groupBy("doc_id").agg(F.max(F.col(value).cast("int")).alias(value))
    counts = {r[value]: r["count"] for r in ids.groupBy(value).count().collect()}
    share = F.when(F.col(value) == 1, F.lit(rows / counts.get(1, 1))).otherwise(F.lit(rows / counts.get(0, 1)))
    return ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).limit(4 * rows), counts


def texts_of_sample(docs: DataFrame, sample: DataFrame, value: str) -> DataFrame:
    """doc_id, text, value of the sampled ids (of several rows with one id the smallest text), written: docs' texts don't move but for these."""
    few = F.broadcast(sample.withColumnRenamed("doc_id", "s_id"))  # label_sample bounds it
    met = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("s_id"))
    return materialise(met.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max(value).alias(value)), "sample")


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES):
    """Consecutive parts of a batch with about `most` bytes of text each (a longer text stands alone)."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group, first = np.cumsum(sizes) // most, 0
    for last in [*np.flatnonzero(np.diff(group)) + 1, len(sizes)]:
        if last > first:
            yield batch.slice(first, last - first)
        first = last


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column's values in UTF-8; null is empty."""
    return [v or b"" for v in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, size=64 * 256, dtype=np.uint64)
_FAR = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _segment_hashes(part: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hashes of consecutive stretches of bytes; by place in the stretch and byte, added up and mixed."""
    offset = np.cumsum(lens) - lens
    pos = np.arange(part.size, dtype=np.int64) - np.repeat(offset, lens)
    value = _TABLE[((pos & 63) << 8) + part]
    if lens.max() > 64:
        with np.errstate(over="ignore"):
            value = value * (((pos >> 6).astype(np.uint64) * _FAR) | np.uint64(1))
    return mix(np.add.reduceat(value, offset) + lens.astype(np.uint64))


def word_hashes(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words of all values in order, and per value the index of its first word (one more at the end)."""
    joined = b"\n".join(values).lower() + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    begins = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) + 1 for v in values], out=begins[1:])
    hashes, starts, at = [], [], 0
    while at < data.size:
        end = min(at + (1 << 20), data.size)
        if end < data.size and not _IS_SPACE[data[end - 1]]:  # up to the end of the word; the last byte is a space
            while not _IS_SPACE[data[end - 1]]:
                step = _IS_SPACE[data[end : end + 4096]]
                end += int(step.argmax()) + 1 if step.any() else step.size
        part = data[at:end]
        solid = ~_IS_SPACE[part]
        edge = np.flatnonzero(np.diff(solid, prepend=False))
        first, lens = edge[::2], edge[1::2] - edge[::2]
        if first.size:
            hashes.append(_segment_hashes(part[solid], lens))
            starts.append(first + at)
        at = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, begins)


def stretch_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of bytes that begin at starts (the first is 0) and fill data."""
    ends, out, at = np.append(starts[1:], data.size), [], 0
    while at < starts.size:
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), "right")))
        out.append(_segment_hashes(data[starts[at] : ends[to - 1]], ends[at:to] - starts[at:to]))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; of all words as one run if there are fewer; none of none."""
    if h.size == 0:
        return h
    n = min(n, h.size)
    with np.errstate(over="ignore"):
        out = np.full(h.size - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out = mix(out * _ODD[i % 5] + h[i : h.size - n + 1 + i])
    return out
