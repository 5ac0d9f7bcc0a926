"""Packing of documents into sequences of bounded length, as few as can be, by best-fit decreasing with certificates.

Documents are encoded and cut within tasks; only their pieces' sizes are packed. Parts of some PART pieces are packed each
for itself, best fit first, the longest pieces first. Dual feasible functions of the sizes give lower bounds: a function f
with f(x1) + f(x2) + ... <= 1 for sizes that fit one sequence says that at least the sum of f over all pieces is needed. As
long as all parts together take more sequences than the bound of the whole, parts whose count is above the plain value of
every such function offer their emptiest sequences; FAN parts at a time pack what they offered anew, and keep the new
packing if it has fewer sequences. What a part doesn't offer is done.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise, slices

#: Tokens of a sequence, and the token that ends a document.
LENGTH, END = 2048, 0
#: Pieces of a part on average, parts that exchange pieces in one task, and sequences that a part offers at most in a round (those it keeps stay packed).
PART, FAN, OFFERED = 4096, 16, 16


# --- encoding

#: Byte-level models write bytes as characters: printable ones as they are, the others in order from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers, for a byte-level vocabulary of the tokenizers library whose ids rise in the order of its merges.

    The same merges run some five times as fast in tiktoken, so it gets the vocabulary's ranks and encodes texts of
    printable characters up to U+024F, space, tab and line ends, where both libraries' character classes agree; a text
    with any other character goes to the tokenizers library itself.
    """

    ODD = re.compile("[^\t\n\r -~\xa1-\xac\xae-ɏ]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {bytes(_BYTE[c] for c in t): i for t, i in self.library.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.ODD.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of a document's pieces: only a longer one is cut; all its pieces but the first are full."""
    first = n if n <= length else n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def tokenised(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, a number `row` of each piece's own and, if asked for, its ids."""
    kind = next(f.dataType for f in docs.schema if f.name == "doc_id").simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                owner, rows, ids = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    held = encoder.ids(text or "") + END.to_bytes(4, "little")
                    for k, (start, size) in enumerate(cuts(len(held) // 4, length)):
                        piece = held[4 * start : 4 * (start + size)]
                        owner.append(i)
                        rows.append((k, start, size, zlib.crc32(piece), row))
                        row += 1
                        if keep_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), *columns, *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", "row", *(["ids"] if keep_ids else [])])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * keep_ids)


# --- bounds

def bound(counts: np.ndarray, length: int) -> tuple[int, int]:
    """How many sequences any packing needs, from how many pieces there are of each size (0 to length), and that number again if a function reaches it without rounding up, else 0.

    Functions: sizes below e count nothing and those above length - e as full; sizes rounded down to kths of k + 1; sizes
    from e to half of length as one of floor(length / e). Whole numbers throughout.
    """
    size = np.arange(length + 1)
    many, weight = np.cumsum(counts), np.cumsum(counts * size)
    e = np.arange(1, length // 2 + 1)
    values = [((many[-1] - many[length - e]) * length + weight[length - e] - weight[e - 1], np.full(e.size, length))]
    for k in range(1, 21):
        up = (k + 1) * size
        values.append((np.array([(counts * np.where(up % length == 0, size * k, up // length * length)).sum()]), np.array([k * length])))
    per = length // e
    large = np.flatnonzero((counts > 0) & (2 * size > length))
    half = many[length // 2] - many[e - 1]
    big = np.array([(counts[large] * (p - (length - large) // x)).sum() for x, p in zip(e.tolist(), per.tolist(), strict=True)])
    values.append((half + big, per))
    top, bottom = (np.concatenate(v) for v in zip(*values, strict=True))
    best = int((-(-top // bottom)).max())
    return best, best if ((top == best * bottom).any()) else 0


def best_fit(sizes: list[int], length: int) -> list[int]:
    """The bin of each piece, taken in the order given (the longest first): the fullest in which it fits, else a new one."""
    bins, free, held, n = [], 0, [[] for _ in range(length + 1)], 0
    for s in sizes:
        fits = free >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            b = held[f].pop()
            if not held[f]:
                free ^= 1 << f
        else:
            f, b, n = length, n, n + 1
        rest = f - s
        held[rest].append(b)
        free |= 1 << rest
        bins.append(b)
    return bins


# --- Spark

@dataclass(frozen=True)
class Packed:
    """What pack() returns: the pieces with their places, how many sequences there are and how many any packing needs."""

    pieces: DataFrame
    sequences: int
    bound: int


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part, which follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column("part").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                if held and held[0].column("part")[0].as_py() != part[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _packed(pieces: DataFrame, length: int) -> DataFrame:
    """Packs each part: sequence_id (the row of its first piece), offset, and whether the sequence is offered for exchange. Parts packed before keep that packing if the new one has as many sequences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _parts(batches):
            size, row = table.column("length").to_numpy(), table.column("row").to_numpy()
            before = table.column("sequence_id").to_numpy()  # NaN or -1 where not packed yet
            bins = np.array(best_fit(size.tolist(), length))
            n = int(bins.max()) + 1
            old, known = np.unique(before, return_inverse=True)
            if before[0] >= 0 and old.size <= n:
                bins, n, order = known, old.size, np.lexsort((table.column("offset").to_numpy(), known))
            else:
                order = np.argsort(bins, kind="stable")
            first = np.flatnonzero(np.diff(bins[order], prepend=-1))
            fill = np.bincount(bins, weights=size, minlength=n).astype(np.int64)
            ends = np.cumsum(size[order])
            offset, name = np.empty_like(size), np.empty_like(row)
            offset[order] = ends - size[order] - np.repeat(ends[first] - size[order][first], np.diff([*first, size.size]))
            name[order] = np.repeat(row[order][first], np.diff([*first, size.size]))
            _, tight = bound(np.bincount(size, minlength=length + 1), length)
            offered = np.zeros(n, dtype=bool)
            if tight < n:
                emptiest = np.lexsort((np.arange(n), fill))[:OFFERED]
                offered[emptiest[fill[emptiest] < length]] = True
            for name_, values in (("sequence_id", name), ("offset", offset), ("offered", offered[bins])):
                table = table.set_column(table.schema.get_field_index(name_), name_, pa.array(values))
            yield from table.combine_chunks().to_batches(max_chunksize=1 << 14)

    dealt = pieces.repartition("part").sortWithinPartitions("part", F.desc("length"), "row")
    return dealt.mapInArrow(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = False) -> Packed:
    """Packs the whole text of every row: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids of each piece.

    A null or empty text is its end token alone. Repeated rows and rows with a null doc_id are documents of their own; other
    columns aren't read; an empty table gives no pieces. The driver sees a count for each of the `length` sizes.
    """
    pieces = materialise(tokenised(docs, tokenizer, length, keep_ids), "pieces")
    counts = np.zeros(length + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    least, short = bound(counts, length)[0], int(counts[:length].sum())
    full = pieces.where(F.col("length") == length).select("*", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    columns = [c for c in full.columns if c != "row"]
    done, total, parts = [full.select(columns)], int(counts[length]), max(1, -(-short // PART))
    level = pieces.where(F.col("length") < length).select("*", F.lit(-1).cast("long").alias("sequence_id"), F.lit(-1).cast("long").alias("offset"), F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"), F.lit(False).alias("offered"))
    while short:
        level = materialise(_packed(level, length), "packed")
        kept, open_ = level.where(~F.col("offered")), level.where("offered")
        heads = level.where("offset = 0").groupBy("offered").count().collect()
        n = {r["offered"]: r["count"] for r in heads}
        total += n.get(False, 0)
        if total + n.get(True, 0) <= least or parts == 1 or not n.get(True, 0):
            done.append(level.select(columns))
            total += n.get(True, 0)
            break
        done.append(kept.select(columns))
        parts = -(-parts // FAN)
        level = open_.withColumn("part", F.expr(f"part div {FAN}"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return Packed(out, total, least)


def sequences(packed: Packed) -> DataFrame:
    """sequence_id and ids (their documents' ids one after another) of every sequence; pack() must have kept the ids."""
    met = packed.pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return met.select("sequence_id", F.flatten("held.ids").alias("ids"))
