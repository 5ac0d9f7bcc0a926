"""SentencePiece encoding and decoding over a relational lattice.

A text becomes units that no piece crosses: it is cut at newlines, before a run of spaces (pieces hold the space sign only
at their beginning), and between characters whose bytes never stand side by side in a piece. The distinct units of all
texts are numbered and encoded once: their substrings of bounded length are exploded and equi-joined to the piece table,
the edges are grouped by unit, and a fold over them (Spark's `aggregate`) picks the path. For unigram models it is the
Viterbi path. A BPE model's encoder doesn't maximise a sum of scores, so there the fold applies the edges in the order of
their scores to the unit's set of boundaries, as the merges do. Characters outside the table become byte pieces.

Texts are dealt in blocks. A block sends its distinct units, packed, to buckets by ranges of their hash, so that no unit is
hot; the buckets number units and answer with each block's ids, which meet the block's texts, then lists of unit indices.

A null or empty text has no pieces. The boundaries of a unit are a 64-bit set; longer units (over LONG characters: long
runs without a space) and units that hold pieces of equal scores (runs of spaces), whose merges don't follow one order of
the edges, take a heap or an array instead, with the same result. Repeated rows get equal ids; an empty table gives an
empty result. Only doc_id and text are read. docs that aren't a plain read of files are written first.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dictionary as dic
from .common import materialise, stable, stretch_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 60
#: Bytes of text in a block; a block's units and ids are in a task's memory at once.
BLOCK_BYTES = 5 << 20
#: Bits of a unit's number within its bucket.
BUCKET_BITS = 40


@dataclass(frozen=True)
class Pieces:
    """A piece table: texts by id, scores, ids of byte pieces by byte, kind (bpe or unigram)."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    kind: str = "bpe"

    @property
    def longest(self) -> int:
        return max(len(t) for t, n in zip(self.texts, self.normal) if n)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, float(s)) for i, (t, s, n) in enumerate(zip(self.texts, self.scores, self.normal)) if n]
        return spark.createDataFrame(rows, "piece string, id int, score double")

    def joints(self) -> np.ndarray:
        """Whether bytes a and b stand side by side in some piece, at 256 * a + b; between others no piece reaches."""
        held = np.zeros(1 << 16, dtype=bool)
        for t, n in zip(self.texts, self.normal):
            raw = np.frombuffer(t.replace(SPACE, " ").encode(), np.uint8).astype(np.int64) if n else np.zeros(0, np.int64)
            held[raw[:-1] << 8 | raw[1:]] = True
        return held

    def bytes_of(self) -> list[bytes]:
        """What each id decodes to."""
        out = [t.replace(SPACE, " ").encode() if n else b"" for t, n in zip(self.texts, self.normal)]
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def load(path: str = MODEL) -> Pieces:
    """The piece table of a SentencePiece model file (identity normalisation with a space put before the text)."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    texts = tuple(p.id_to_piece(i) for i in range(n))
    normal = tuple(not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)) for i in range(n))
    crossing = [t for t, ok in zip(texts, normal) if ok and (SPACE in t.lstrip(SPACE) or "\n" in t)]
    if crossing:
        raise ValueError(f"pieces cross words: {crossing[:5]}")
    by = {p.id_to_piece(i): i for i in range(n) if p.is_byte(i)}
    return Pieces(texts, tuple(p.get_score(i) for i in range(n)), normal, tuple(by[f"<0x{b:02X}>"] for b in range(256)), p.unk_id())


def units_of(texts: list[bytes], joints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts (a space before each that isn't empty), where units begin, and the unit at which each text begins (one more at the end)."""
    held = [b" " + t.replace(SPACE.encode(), b" ") if t else b"" for t in texts]
    data = np.frombuffer(b"".join(held), dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64)
    space, line = data == 32, data == 10
    start = line.copy()
    apart = ~joints[data[:-1].astype(np.int64) << 8 | data[1:]] & ((data[1:] & 0xC0) != 0x80)
    start[1:] |= line[:-1] | (space[1:] & ~space[:-1]) | apart
    start[begins[:-1][np.diff(begins) > 0]] = True
    starts = np.flatnonzero(start)
    return data, starts, np.searchsorted(starts, begins)


def distinct_units(texts: list[bytes], joints: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct units but the newline, by rising hash; their hashes; each unit's index among them (the number of them: a newline); text starts."""
    data, starts, begins = units_of(texts, joints)
    h = stretch_hashes(data, starts)
    newline = data[starts] == 10 if starts.size else np.zeros(0, bool)
    u, first, back = np.unique(h, return_index=True, return_inverse=True)
    keep = ~newline[first]
    ends = np.append(starts[1:], data.size)
    raw = data.tobytes()
    units = [raw[starts[i] : ends[i]] for i in first[keep]]
    index = np.where(keep, np.cumsum(keep) - 1, len(units))[back]
    return units, u[keep], index, begins


def _packed_units(docs: DataFrame, joints: np.ndarray, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in dic.batches_by_block(batches, BLOCK_BYTES):
            units, hashes, _, _ = distinct_units(dic.texts_of(parts), joints)
            cuts = np.searchsorted(hashes, dic.bucket_starts(buckets))
            rows = [(block, b, dic.pack(b"\n".join(units[x:y]))) for b, (x, y) in enumerate(zip(cuts, [*cuts[1:], len(units)])) if y > x]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["block", "bucket", "units"])

    return docs.mapInArrow(run, "block long, bucket int, units binary")


def number_units(packed: DataFrame, buckets: int) -> DataFrame:
    """kind 0: block, bucket, data, the packed numbers of the block's units there. kind 1: uid, unit (spaces as space signs), plain (no byte of it was replaced): each unit once.

    A unit's number counts the bucket's units in the order of the blocks, so that a repeated task numbers alike.
    """
    names = ["kind", "bucket", "block", "data", "uid", "unit", "plain"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, {}
        for batch in batches:
            rows = []
            for bucket, block, units in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist(), batch["units"].to_pylist()):
                if bucket != now:
                    now, seen = bucket, {}
                units, known = dic.unpack(units).split(b"\n"), len(seen)
                numbers = np.fromiter((seen.setdefault(u, len(seen)) for u in units), np.int64, len(units))
                rows.append((0, bucket, block, dic.pack(dic.planes(numbers, 4)), None, None, None))
                for u, i in zip(units, numbers.tolist()):
                    if i >= known:
                        text = u.decode("utf-8", "replace")
                        rows.append((1, bucket, None, None, bucket << BUCKET_BITS | i, text.replace(" ", SPACE), text.encode() == u))
            for i in range(0, len(rows), 20000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20000]), kinds)], names)

    by = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    return by.mapInArrow(run, "kind int, bucket int, block long, data binary, uid long, unit string, plain boolean")


def lattice(units: DataFrame, pieces: Pieces, least: int) -> DataFrame:
    """uid and `edges`, an array by order of all pieces in the unit with `least` characters or more: for BPE (order, ends, inner), the bits of an edge's two ends and of the places between; else (order, start, end)."""
    # rows all the way: starts, then lengths, then the substring
    starts = units.withColumn("n", F.length("unit")).where(F.col("n") >= least).select("uid", "unit", "n", F.explode(F.sequence(F.lit(0), F.col("n") - least)).alias("s"))
    cut = starts.select("uid", "unit", "s", F.explode(F.sequence(F.lit(least), F.least(F.lit(pieces.longest), F.col("n") - F.col("s")))).alias("k"))
    cut = cut.select("uid", "s", (F.col("s") + F.col("k")).alias("e"), F.substring("unit", F.col("s") + 1, F.col("k")).alias("piece"))
    # the piece table has a fixed size, that of the model
    met = cut.join(F.broadcast(pieces.frame(units.sparkSession)), "piece")
    order = (-F.col("score")).alias("order")
    if pieces.kind == "bpe":
        edge = F.struct(order, (_bit(F.col("s")).bitwiseOR(_bit(F.col("e")))).alias("ends"), (_bit(F.col("e")) - _bit(F.col("s") + 1)).alias("inner"))
    else:
        edge = F.struct(order, F.col("s").alias("start"), F.col("e").alias("end"))
    return met.groupBy("uid").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def fold_merges(edges: Column, length: Column) -> Column:
    """The boundaries (bits) that merging leaves, best score first and then from the left; no two pieces of a unit have equal scores."""

    def step(held: Column, e: Column) -> Column:
        # both ends are boundaries and one boundary lies between
        fits = (held.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(held.bitwiseAND(e["inner"])) == 1)
        return F.when(fits, held.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(held)

    return F.aggregate(edges, _bit(length + 1) - 1, step)


def fold_viterbi(edges: Column, length: Column, unknown: float) -> Column:
    """Boundaries (bits) of the path with the largest sum of scores; single characters outside the table cost `unknown`."""
    bit = _bit
    state = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(F.lit(-1e18)).alias("score"), bit(i).alias("cuts")))
    by_end = F.array_sort(F.concat(F.transform(edges, lambda e: F.struct(e["end"].alias("end"), e["start"].alias("start"), (-e["order"]).alias("score"))), F.transform(F.sequence(F.lit(1), length), lambda i: F.struct(i.alias("end"), (i - 1).alias("start"), F.lit(unknown).alias("score")))))

    def step(held, e):
        here, to = F.get(held, e["start"]), F.get(held, e["end"])
        better = here["score"] + e["score"] > to["score"]
        new = F.struct((here["score"] + e["score"]).alias("score"), here["cuts"].bitwiseOR(bit(e["end"])).alias("cuts"))
        return F.when(better, F.transform(held, lambda x, i: F.when(i == e["end"], new).otherwise(x))).otherwise(held)

    return F.element_at(F.aggregate(by_end, state, step), -1)["cuts"]


def path_ids(units: DataFrame, pieces: Pieces) -> DataFrame:
    """uid, ids, same: of units of at most LONG characters. Every boundary but the first ends a piece; what isn't in the table is spelt in bytes."""
    known = lattice(units, pieces, 2 if pieces.kind == "bpe" else 1).withColumnRenamed("uid", "l_uid")
    n, none = F.length("unit"), F.array().cast(known.schema["edges"].dataType)
    edges = F.coalesce("edges", none)
    cuts = fold_merges(edges, n) if pieces.kind == "bpe" else fold_viterbi(edges, n, min(pieces.scores) - 10)
    folded = units.join(known, F.col("uid") == F.col("l_uid"), "left").select("uid", "unit", "plain", cuts.alias("cuts"))
    table = {t: i for i, (t, ok) in enumerate(zip(pieces.texts, pieces.normal)) if ok}

    def cut(unit: str, cuts: int) -> list[str]:
        at = [i for i in range(len(unit) + 1) if cuts >> i & 1]
        return [unit[s:e] for s, e in zip(at, at[1:])]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _coded(batch, [cut(u, c) for u, c in zip(batch["unit"].to_pylist(), batch["cuts"].to_pylist())], table, pieces)

    return folded.mapInArrow(finish, CODED)


CODED = "uid long, ids array<int>, same boolean"


def _coded(batch: pa.RecordBatch, cut: list[list[str]], table: dict[str, int], pieces: Pieces) -> pa.RecordBatch:
    """CODED rows of units cut into pieces; same: the ids decode to the unit."""
    ids = [[k for t in parts for k in ((table[t],) if t in table else [pieces.byte_ids[b] for b in t.replace(SPACE, " ").encode()])] for parts in cut]
    spelt = pieces.bytes_of()
    same = [ok and b"".join(map(spelt.__getitem__, x)) == u.replace(SPACE, " ").encode() for x, u, ok in zip(ids, batch["unit"].to_pylist(), batch["plain"].to_pylist())]
    return pa.RecordBatch.from_arrays([batch["uid"], pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["uid", "ids", "same"])


def merge_long(unit: str, rank: dict[str, float]) -> list[str]:
    """The pieces of a unit by BPE with a heap of adjacent pairs; rank: the pieces' scores."""
    text = list(unit)
    after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap: list = []

    def offer(i):
        j = after[i]
        if j < len(text) and (r := rank.get(text[i] + text[j])) is not None:
            heapq.heappush(heap, (-r, i, j, text[i] + text[j]))

    for i in range(len(text) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if text[i] is None or after[i] != j or text[j] is None or text[i] + text[j] != both:
            continue
        text[i], text[j], after[i] = both, None, after[j]
        if after[j] < len(text):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [t for t in text if t is not None]


def viterbi_long(unit: str, rank: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The pieces of a long unit on the path with the largest sum of scores, with an array of its ends."""
    best, start = [0.0] + [-1e18] * len(unit), [0] * (len(unit) + 1)
    for e in range(1, len(unit) + 1):
        for s in range(max(0, e - longest), e):
            score = rank.get(unit[s:e], unknown if e == s + 1 else -1e18)
            if best[s] + score > best[e]:
                best[e], start[e] = best[s] + score, s
    out, e = [], len(unit)
    while e:
        out.append(unit[start[e] : e])
        e = start[e]
    return out[::-1]


def holds_tied(unit: Column, pieces: Pieces) -> Column:
    """Whether a unit holds a piece whose score others share (runs of spaces): the fold's order of edges isn't that of the merges there."""
    if pieces.kind != "bpe":
        return F.lit(False)
    long = [(t, s) for t, s, ok in zip(pieces.texts, pieces.scores, pieces.normal) if ok and len(t) > 1]
    often = Counter(s for _, s in long)
    tied: list[str] = []
    for t in sorted((t for t, s in long if often[s] > 1), key=len):
        if not any(x in t for x in tied):
            tied.append(t)
    return F.lit(False) if not tied else F.exists(F.array(*map(F.lit, tied)), lambda t: F.contains(unit, t))


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """CODED rows of distinct units (uid, unit, plain)."""
    folds = (F.length("unit") <= LONG) & ~holds_tied(F.col("unit"), pieces)
    short = path_ids(units.where(folds), pieces)
    table = {t: i for i, (t, ok) in enumerate(zip(pieces.texts, pieces.normal)) if ok}
    rank = {t: s for t, s, ok in zip(pieces.texts, pieces.scores, pieces.normal) if ok}
    longest, unknown = pieces.longest, min(pieces.scores) - 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["unit"].to_pylist()
            yield _coded(batch, [merge_long(u, rank) if pieces.kind == "bpe" else viterbi_long(u, rank, longest, unknown) for u in texts], table, pieces)

    return short.unionByName(units.where(~folds).mapInArrow(run, CODED))


def _answers(numbered: DataFrame, coded: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, data: for each packed list of units their numbers of ids (with `same` in the lowest bit) and the ids."""
    rows = numbered.where("kind = 0").select("bucket", F.lit(1).alias("kind"), "block", "data", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("boolean").alias("same"))
    told = coded.select(F.shiftright("uid", BUCKET_BITS).cast("int").alias("bucket"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("data"), "uid", "ids", "same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size, start, flat = None, [], None, None, None
        for batch in batches:
            bucket, kind = (batch[c].to_numpy() for c in ("bucket", "kind"))
            cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1), len(bucket)]
            for s, e in zip(cuts, cuts[1:]):
                if e == s:
                    continue
                if bucket[s] != now:
                    now, parts = bucket[s], []
                if kind[s] == 0:
                    x = batch.slice(s, e - s)
                    n = pa.compute.list_value_length(x["ids"]).to_numpy(zero_copy_only=False).astype(np.int64)
                    parts.append((x["uid"].to_numpy() & ((1 << BUCKET_BITS) - 1), n << 1 | x["same"].to_numpy(zero_copy_only=False), x["ids"].flatten().to_numpy()))
                    continue
                if parts:  # all of the bucket's units are here: their ids by number
                    number, held, flat = (np.concatenate(c) for c in zip(*parts))
                    begin = np.cumsum(held >> 1) - (held >> 1)
                    size, start = np.zeros(number.size, np.int64), np.zeros(number.size, np.int64)
                    size[number], start[number] = held, begin
                    parts = []
                for block, data in zip(batch["block"].slice(s, e - s).to_pylist(), batch["data"].slice(s, e - s).to_pylist()):
                    data = dic.unpack(data)
                    asked = dic.unplaned(data, len(data) // 4, 4, 0).astype(np.int64)
                    n = size[asked] >> 1
                    ids = flat[np.repeat(start[asked] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    out = len(asked).to_bytes(8, "big") + dic.planes(size[asked], 4) + dic.planes(ids, 4)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([now], pa.int32()), pa.array([dic.pack(out)], pa.binary())], ["block", "bucket", "data"])

    return rows.unionByName(told).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, "block long, bucket int, data binary")


def _indexed_blocks(docs: DataFrame, joints: np.ndarray) -> DataFrame:
    """block, bucket (-1), data: a block's rows as their ids, their numbers of units, and the units' indices among the block's distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in dic.batches_by_block(batches, BLOCK_BYTES):
            units, _, index, begins = distinct_units(dic.texts_of(parts), joints)
            rows = pa.Table.from_batches(parts).select(["doc_id"]).append_column("n", pa.array(np.diff(begins), pa.int64()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            head = sink.getvalue().to_pybytes()
            data = len(head).to_bytes(8, "big") + len(units).to_bytes(8, "big") + head + dic.planes(index, 4)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([dic.pack(data)], pa.binary())], ["block", "bucket", "data"])

    return docs.mapInArrow(run, "block long, bucket int, data binary")


def encode(docs: DataFrame, pieces: Pieces, id_name: str = "doc_id") -> DataFrame:
    """id, ids (array of int), n_ids, decoded_equal (decoding gives the text back, space signs as spaces; decoding joins what the ids spell, so it is tested unit by unit)."""
    d = stable(docs.select(F.col(id_name).alias("doc_id"), "text"))
    buckets = dic.buckets_of(docs)
    joints = pieces.joints()
    numbered = materialise(number_units(_packed_units(d, joints, buckets), buckets), "units")
    units = numbered.where("kind = 1").select("uid", "unit", "plain").repartition(buckets, "uid")
    answers = _answers(numbered, encode_units(units, pieces), buckets)
    newline = pieces.byte_ids[10]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told = None, {}
        for batch in batches:
            for block, bucket, data in zip(*(batch[c] for c in ("block", "bucket", "data"))):
                block, bucket, data = block.as_py(), bucket.as_py(), dic.unpack(data.as_py())
                if block != now:
                    now, told = block, {}
                if bucket >= 0:
                    told[bucket] = data
                    continue
                sizes, flat = [], []
                for b in sorted(told):
                    n = int.from_bytes(told[b][:8], "big")
                    sizes.append(dic.unplaned(told[b], n, 4, 8))
                    flat.append(dic.unplaned(told[b], (len(told[b]) - 8) // 4 - n, 4, 8 + 4 * n))
                size = np.concatenate([*sizes, [3]]).astype(np.int64)  # a newline is one id
                ids = np.concatenate([*flat, [newline]]).astype(np.int32)
                head, n_units = (int.from_bytes(data[i : i + 8], "big") for i in (0, 8))
                if len(size) != n_units + 1:
                    raise ValueError("a block holds other units than when they were gathered")
                with pa.ipc.open_stream(data[16 : 16 + head]) as source:
                    rows = source.read_all().combine_chunks()
                index = dic.unplaned(data, (len(data) - 16 - head) // 4, 4, 16 + head).astype(np.int64)
                begins = np.concatenate([[0], np.cumsum(rows["n"].to_numpy())])
                bad = np.concatenate([[0], np.cumsum(1 - (size & 1)[index])])
                size >>= 1
                at, each = np.cumsum(size) - size, size[index]
                offset = np.concatenate([[0], np.cumsum(each)])
                out = ids[np.repeat(at[index] - offset[:-1], each) + np.arange(offset[-1])]
                ends = offset[begins]
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))
                yield pa.RecordBatch.from_arrays([pa.chunked_array(rows["doc_id"]).combine_chunks(), column, pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(bad[begins]) == 0)], ["doc_id", "ids", "n_ids", "decoded_equal"])

    # the blocks come first in the union, so that their tasks have the numbers of docs' partitions
    rows = _indexed_blocks(d, joints).unionByName(answers).repartition(buckets, "block").sortWithinPartitions("block", F.desc("bucket"))
    return rows.mapInArrow(finish, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_ids long, decoded_equal boolean")


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """encoded with `text`: what the ids spell, without the space put before it; bytes that are no UTF-8 become U+FFFD; null ids give null."""
    spelt = pieces.bytes_of()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else b"".join(map(spelt.__getitem__, x)).decode("utf-8", "replace").removeprefix(" ") for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.mapInArrow(run, schema)
