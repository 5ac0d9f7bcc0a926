"""Looking up something for every word of every text without moving a row per word.

Words go by their 64-bit hashes. Texts are gathered in blocks, some tens of MB of consecutive rows of one input task. Each
block sends its distinct words, packed and rising, to buckets by ranges of the hash; a bucket sees a word at most once a
block, so no word is hot. Buckets answer with one packed value list per block, and the answers meet the block's texts
again, compressed, for one last pass.

Blocks are named by input partition and number, so both passes must read the same partitions: docs must be a plain read
of a table (or be written first). A word without an answer raises an error, so a differing read can't go unseen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BLOCK_BYTES = 10 << 20
CHUNK_BYTES = 2 << 20
PACKED = "block long, bucket int, words binary, counts binary, tokens long"


def buckets_of(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(a: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of numbers, first bytes first, so that they compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(data: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def bucket_starts(buckets: int) -> np.ndarray:
    """The smallest hash of each bucket: equal ranges of all 64-bit hashes."""
    return np.array([(i << 64) // buckets for i in range(buckets)], dtype=np.uint64)


def batches_by_block(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES, text: str = "text") -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive row runs of a task with about `most` bytes of text, and their block numbers."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        first, col = 0, batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield task << 32 | number, [*held, batch.slice(first, i - first)]
                number, held, size, first = number + 1, [], 0, i
            size += int(n)
        held.append(batch.slice(first))
    if held:
        yield task << 32 | number, held


def texts_of(parts: list[pa.RecordBatch], text: str = "text") -> list[bytes]:
    return [v or b"" for p in parts for v in p.column(p.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]


def block_words(docs: DataFrame, count: Callable[[list[pa.RecordBatch]], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """PACKED rows: a block's distinct word hashes in a bucket, rising, with counts; tokens: the counts' sum. count gives both for a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in batches_by_block(batches):
            words, counts = count(parts)
            cuts = np.searchsorted(words, bucket_starts(buckets))
            rows = [(block, b, words[x:y].tobytes(), pack(counts[x:y].astype(np.uint32).tobytes()), int(counts[x:y].sum())) for b, (x, y) in enumerate(zip(cuts, [*cuts[1:], len(words)])) if y > x]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["block", "bucket", "words", "counts", "tokens"])

    return docs.mapInArrow(run, PACKED)


def compressed_blocks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, bucket (-1), data: the rows of each block as compressed Arrow streams of about chunk_bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in batches_by_block(batches, block_bytes):
            for p in pa.Table.from_batches(parts).combine_chunks().to_batches():
                for s in slices(p, "text", chunk_bytes):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, s.schema) as out:
                        out.write_batch(s)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([pack(sink.getvalue().to_pybytes())], pa.binary())], ["block", "bucket", "data"])

    return docs.mapInArrow(run, "block long, bucket int, data binary")


def meet(docs: DataFrame, answers: DataFrame, finish: Callable[[dict[int, bytes]], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """answers: block, bucket, data. finish gets a block's answers by bucket and returns what is applied to its rows, some MB at a time."""
    # the blocks come first in the union, so that their tasks have the numbers of docs' partitions
    rows = compressed_blocks(docs, chunk_bytes, block_bytes).unionByName(answers.select("block", "bucket", "data"))
    rows = rows.repartition(buckets_of(docs), "block").sortWithinPartitions("block", F.desc("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for batch in batches:
                yield from zip(*(batch[c] for c in ("block", "bucket", "data")))

        block, told, state = None, {}, None
        for at, bucket, data in chunks():
            at, bucket, data = at.as_py(), bucket.as_py(), data.as_py()
            if at != block:
                block, told, state = at, {}, None
            if bucket >= 0:
                told[bucket] = data
                continue
            if state is None:
                state = finish(told)
            with pa.ipc.open_stream(unpack(data)) as source:
                for part in source:
                    yield from state(part)

    return rows.mapInArrow(run, schema)
