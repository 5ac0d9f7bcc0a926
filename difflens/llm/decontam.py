"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words; its hash ignores the positions that the mask leaves out, so a passage with some
words replaced still shares hashes with its source. Hashes of all benchmark positions form a table and a Bloom bitmap of
fixed size; a pass over the texts keeps the hashes that the bitmap knows, with the words around them; Spark joins these
with the benchmark's table, and each (passage, item, diagonal) is verified: the item's words are equal to LEAST_SHARE of
all, or some stretch has LEAST_WORDS equal ones and as large a share.

Benchmark items shorter than the longest mask are searched by the masks that fit and as exact runs of all their words. Null and empty texts
and items hold nothing; repeated rows and ids each get a row of their own; an empty benchmark finds nothing. Columns
other than doc_id, text, item_id aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialise, mix, slices, word_hashes

#: Masks of seven or eight words; words around a hit that are kept at least; equal words that make a leak, and their share of a stretch or a whole item.
MASKS = ("11101011011", "110110010111", "1011000111011", "11110111")
AROUND = 80
LEAST_WORDS, LEAST_SHARE = 20, (4, 5)
BITS = 1 << 25
SPAN = max(map(len, MASKS))
_SALT = np.uint64(0x9E3779B97F4A7C15)


def seeds(h: np.ndarray, mask: tuple[int, ...], span: int, number: int) -> np.ndarray:
    """The seed's hash at each position."""
    n = h.size - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, number + 1, dtype=np.uint64)
        for i in mask:
            out = (out ^ h[i : i + n]) * _SALT
            out ^= out >> np.uint64(29)
    return mix(out)


def _kept(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def benchmark_items(bench: DataFrame) -> DataFrame:
    """item (its number as a row), item_id, n, tokens (64-bit word hashes) of the items that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch):
                h, first = word_hashes(as_bytes(part))
                rows = [(part_id << 40 | row + i, v, int(first[i + 1] - first[i]), h[first[i] : first[i + 1]].tobytes()) for i, v in enumerate(part["item_id"].to_pylist())]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), part["item_id"].type, pa.int32(), pa.binary()))], ["item", "item_id", "n", "tokens"])

    return bench.select("item_id", "text").mapInArrow(run, f"item long, item_id {bench.schema['item_id'].dataType.simpleString()}, n int, tokens binary").where("n > 0")


def item_seeds(items: DataFrame) -> DataFrame:
    """h, item, at: every seed of every item by the masks that fit; of an item shorter than the longest also the run of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, tokens in zip(batch["item"].to_pylist(), batch["tokens"].to_pylist()):
                t = np.frombuffer(tokens, dtype=np.uint64)
                every = [seeds(t, _kept(m), len(m), i) for i, m in enumerate(MASKS)]  # none of a mask that is longer
                if t.size < SPAN:
                    every.append(seeds(t, tuple(range(t.size)), t.size, 1000 + t.size))
                h = np.concatenate(every)
                at = np.concatenate([np.arange(x.size) for x in every]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(h.size, item)), pa.array(at)], ["h", "item", "at"])

    return items.mapInArrow(run, "h long, item long, at int")


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BITS - 1)).astype(np.int64), (h >> np.uint64(39)).astype(np.int64)


def seed_bitmap(table: DataFrame) -> np.ndarray:
    """A Bloom bitmap of BITS bits (4 MB) of the seeds' hashes: made in tasks, at most eight of them, and combined here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BITS // 8, dtype=np.uint8)
        for batch in batches:
            for b in _bits(batch["h"].to_numpy().view(np.uint64)):
                np.bitwise_or.at(held, b >> 3, (1 << (b & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([held.tobytes()], pa.binary())})

    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in table.select("h").repartition(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def passages(docs: DataFrame, bitmap: np.ndarray, short: list[int], around: int = AROUND) -> DataFrame:
    """Rows of every document: row, doc_id, key, and for each passage around known hashes first, tokens, hs, ats; one row without any."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)
    every = [(tuple(range(n)), n, 1000 + n) for n in short] + [(_kept(m), len(m), i) for i, m in enumerate(MASKS)]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part_id, row = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch):
                h, first = word_hashes(as_bytes(part))
                hit_at, hit_h = [], []
                for mask, span, number in every:
                    s = seeds(h, mask, span, number)
                    a, b = _bits(s)
                    found = np.flatnonzero((known[a >> 3] >> (a & 7).astype(np.uint8)) & 1)
                    b = b[found]
                    found = found[((known[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)]
                    # a seed lies within one text
                    found = found[np.searchsorted(first, found, "right") == np.searchsorted(first, found + span - 1, "right")]
                    hit_at.append(found)
                    hit_h.append(s[found])
                at, hs = np.concatenate(hit_at), np.concatenate(hit_h)
                order = np.argsort(at, kind="stable")
                at, hs = at[order], hs[order].view(np.int64)
                of = np.searchsorted(first, at, "right") - 1
                out = []
                ids, keys = part["doc_id"].to_pylist(), part["key"].to_pylist()
                begin = np.searchsorted(of, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    me = (part_id << 40 | row + i, ids[i], keys[i])
                    lo, hi = begin[i], begin[i + 1]
                    if lo == hi:
                        out.append((*me, None, None, None, None))
                        continue
                    cuts = [lo, *(np.flatnonzero(np.diff(at[lo:hi]) > 2 * around) + 1 + lo), hi]
                    for x, y in zip(cuts, cuts[1:]):
                        start, end = max(first[i], at[x] - around), min(first[i + 1], at[y - 1] + SPAN + around)
                        out.append((*me, int(start - first[i]), h[start:end].tobytes(), hs[x:y].tolist(), (at[x:y] - start).tolist()))
                row += part.num_rows
                kinds = (pa.int64(), part["doc_id"].type, pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["row", "doc_id", "key", "first", "tokens", "hs", "ats"])

    d = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    return d.mapInArrow(run, f"row long, doc_id {id_type}, key long, first long, tokens binary, hs array<long>, ats array<int>")


def leaked_words(a: np.ndarray, b: np.ndarray, shift: int) -> int:
    """Equal words of the largest leak of item b in passage a, where a[i] stands at b[i + shift]; 0 if it is none."""
    lo, hi = max(0, -shift), min(a.size, b.size - shift)
    if hi <= lo:
        return 0
    up, down = LEAST_SHARE
    same = np.concatenate([[0], np.cumsum(a[lo:hi] == b[lo + shift : hi + shift])]).astype(np.int64)
    # from i to j a stretch has the share if over[j] >= over[i]; for each j the first such i has the most equal words
    over = down * same - up * np.arange(same.size)
    first = np.searchsorted(-np.minimum.accumulate(over), -over)
    most = int((same - same[first]).max())
    whole = int(same[-1]) if down * same[-1] >= up * b.size else 0
    return max(most if most >= LEAST_WORDS else 0, whole)


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per row of docs: row, doc_id, key, items (the ids of the items that it holds, sorted), words (equal words of the longest leak)."""
    items = materialise(benchmark_items(bench), "items")
    table = materialise(item_seeds(items), "seeds")
    short = sorted(r[0] for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())  # fewer lengths than SPAN
    longest = items.agg(F.max("n")).first()[0] or 0
    found = materialise(passages(docs, seed_bitmap(table), short, max(AROUND, longest)), "passages")
    hits = found.where("tokens is not null").select("row", "first", F.explode(F.arrays_zip("hs", "ats")).alias("x")).select("row", "first", F.col("x.hs").alias("h"), F.col("x.ats").alias("pos"))
    pairs = hits.join(table, "h").groupBy("row", "first", "item", (F.col("at") - F.col("pos")).alias("shift")).agg(F.count("*").alias("seeds"))
    held = found.where("tokens is not null").select("row", "first", F.col("tokens").alias("a"))
    texts = items.select("item", "item_id", "n", F.col("tokens").alias("b"))
    full = pairs.join(held, ["row", "first"]).join(texts, "item").select("row", "item_id", "n", "shift", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [leaked_words(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), s) for a, b, s in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["shift"].to_pylist())]
            ok, words = np.array(got, dtype=np.int64) > 0, pa.array(got, pa.int32())
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (batch["row"], batch["item_id"], words)], ["row", "item_id", "words"])

    id_type = bench.schema["item_id"].dataType.simpleString()
    proven = full.mapInArrow(verify, f"row long, item_id {id_type}, words int")
    # a text's items: at most as many as the items that it holds passages of
    by_row = materialise(proven.groupBy(F.col("row").alias("of_row")).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("words").alias("words")), "leaks")
    rows = found.where("tokens is null or first is not null").select("row", "doc_id", "key").distinct()
    return rows.join(by_row, F.col("row") == F.col("of_row"), "left").select("row", "doc_id", "key", F.coalesce("items", F.array().cast(f"array<{id_type}>")).alias("items"), F.coalesce("words", F.lit(0)).alias("words"))


def drop_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage."""
    bad = leaks(docs, bench).where(F.size("items") > 0).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    bad = materialise(bad, "bad")
    # the whole row is one column, so that no name of its own can clash
    d = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_key"), F.struct("*").alias("row"))
    return d.join(bad, F.col("d_id").eqNullSafe(F.col("bad_id")) & (F.col("d_key") == F.col("bad_key")), "left_anti").select("row.*")
