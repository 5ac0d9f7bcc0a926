"""N-gram Jaccard join with signature trees.

Texts with the same set of shingles are one class. In one order of all shingles (common ones last, else by hash), two
linked classes share a shingle among the first of each (all but the last ceil(share * size) - 1), so these prefixes route
classes to each other: that is the tree's upper level, spread over tasks. Each shingle's group is a signature tree: a node
holds the OR of its classes' bitmaps and their range of sizes and of bits, and a dual traversal drops a pair of nodes if
even the largest possible overlap is too small. First, in the groups of each class's ROUTES
rarest shared shingles, a class is paired with the nearest class before it (largest possible overlap), so that a group of n
copies costs n comparisons; these pairs are verified on whole sets. Then the trees of all groups that still hold several
components are traversed, pairs of nodes within one component being dropped, and every surviving pair is verified. A group
with many classes is dealt in blocks; the last traversal gives each pair of blocks to a task.

Common shingles are found by counting all; a shingle counts as common with a share of 2**-20 of all occurrences, so their
list holds at most 2**20 hashes. The order and the first traversals only move work; links are complete for any of them.

A null or empty text has no shingles, links with nothing and is its own component (by its doc_id; null if that is null).
With fewer than n words the whole sequence is one shingle. Equal rows fall into one class. An empty table gives an empty
result. Shingles are compared by 64-bit hashes. Only doc_id and text are read; keep_one passes all columns on, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, forget, materialise, mix, shingle_hashes, slices, word_hashes

COMMON_SHARE = 2.0**-20
#: Share of all occurrences from which on a shingle's rows are spread over tasks before its trees are built.
HOT_SHARE = 2.0**-17
#: Classes of a group that one tree holds at most; larger groups are dealt in blocks of about so many.
BLOCK = 512
LEAF = 8
BLOOM_BITS = 1 << 23
#: Words or shingles that are hashed at a time, so that the steps' arrays stay in a core's cache.
STEP = 1 << 15
#: Shared shingles of a class by which the first traversal meets it; pairs of one class that a task verifies at once.
ROUTES, FAN = 4, 1024
#: Further first traversals, of all open groups and between components, before the whole one.
ROUNDS = 1
#: Rows of a shingle that are compared by size alone before any tree is built.
WIDE = 64
#: Places of a bitmap a shingle: of those in the trees, and of those that a pair must pass before whole sets move.
COARSE, FINE = 2, 8


def _sets(part: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Shingles of all texts are hashed together; those that reach into the next text are left out."""
    h, first = word_hashes(as_bytes(part))
    every = max(h.size - n + 1, 0)
    runs = [shingle_hashes(h[s : min(s + STEP, every) + n - 1], n) for s in range(0, every, STEP)]
    runs = np.concatenate(runs) if runs else h[:0]
    return [_distinct(runs[a : b - n + 1] if b - a >= n else shingle_hashes(h[a:b], n)) for a, b in zip(first.tolist(), first[1:].tolist())]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if x.size else x


def classes_of(sets: list[np.ndarray]) -> list[int]:
    """Each set's class: a hash of the whole set, as a signed 64-bit number; 0 for the empty set."""
    size = np.array([s.size for s in sets], np.int64)
    out, full = np.zeros(len(sets), np.int64), size > 0
    if full.any():
        flat = np.concatenate(sets)
        near, far = (np.concatenate([mix(flat[s : s + STEP] ^ np.uint64(x)) for s in range(0, flat.size, STEP)]) for x in (0, 0xA5A5A5A5A5A5A5A5))
        begin = (np.cumsum(size) - size)[full]
        with np.errstate(over="ignore"):
            total = np.add.reduceat(near, begin) + np.add.reduceat(far, begin) * np.uint64(0x9E3779B97F4A7C15)
            found = mix(total + size[full].astype(np.uint64)).view(np.int64)
        out[full] = np.where(found == 0, 1, found)
    return out.tolist()


def bitmap(s: np.ndarray, times: int = 1) -> bytes:
    """A bit for each shingle in a bitmap `times` as wide as the set (a power of two, 64 at least)."""
    width = times << max(6, int(s.size - 1).bit_length())
    flags = np.zeros(width, dtype=bool)
    flags[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def classes(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: doc_id, row_key (hash of the text), cls, size, sig of each row. kind 1: cls is a shingle that occurs often in a stretch of rows, size its number there. kind 2: size is the number of shingles of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=8 << 20):
                sets = _sets(part, n)
                rows = [(0, i, k, c, s.size, bitmap(s, COARSE)) for i, k, c, s in zip(part["doc_id"].to_pylist(), part["row_key"].to_pylist(), classes_of(sets), sets)]
                u, c = np.unique(np.concatenate(sets), return_counts=True)
                rows += [(1, None, None, int(h), int(k), None) for h, k in zip(u[c >= 4].view(np.int64), c[c >= 4])]
                rows.append((2, None, None, 0, sum(s.size for s in sets), None))
                kinds = (pa.int32(), part["doc_id"].type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "doc_id", "row_key", "cls", "size", "sig"])

    d = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    return d.mapInArrow(run, f"kind int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key long, cls long, size long, sig binary")


def prefix_length(size: int, pct: int) -> int:
    """Shingles of a set that a linked set can't miss all: size - ceil(size * pct / 100) + 1."""
    return size - -(-size * pct // 100) + 1


def prefixes(docs: DataFrame, n: int, pct: int, common: np.ndarray, hot: np.ndarray) -> DataFrame:
    """token, cls, size, room (shingles from this one on, itself included), often (the token is hot): each row's prefix shingles."""
    shared = docs.sparkSession.sparkContext.broadcast((common, np.isin(common, hot)))  # at most 1 / COMMON_SHARE hashes; hot ones are common, too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot_known = shared.value
        for batch in batches:
            for part in slices(batch):
                sets = [s for s in _sets(part, n) if s.size]
                if not sets:
                    continue
                flat = np.concatenate(sets)
                at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
                often = known[at] == flat if len(known) else np.zeros(flat.size, bool)
                hottest = often & hot_known[at] if len(known) else often
                out, begin = [], 0
                seen = set()
                for s, cls in zip(sets, classes_of(sets)):
                    o, hs = often[begin : begin + s.size], hottest[begin : begin + s.size]
                    begin += s.size
                    if cls not in seen:
                        seen.add(cls)
                        order = np.argsort(o, kind="stable")[: prefix_length(s.size, pct)]  # uncommon ones first
                        token = s[order]
                        out.append((token, np.full(token.size, cls), np.full(token.size, s.size), s.size - np.arange(token.size), hs[order]))
                if out:
                    token, cls, size, room, common = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(cls, pa.int64()), pa.array(size, pa.int32()), pa.array(room, pa.int32()), pa.array(common)], ["token", "cls", "size", "room", "often"])

    return docs.select("text").mapInArrow(run, "token long, cls long, size int, room int, often boolean")


def with_partner(rows: pa.RecordBatch, pct: int) -> np.ndarray:
    """Of rows (token, cls, size, room, often, comp) by token, each (token, cls) once: which can be linked with a row of their token in another component, by size and room.

    Common tokens' rows all stay, as do those of groups of more than WIDE rows, whose trees tell.
    """
    token, often, comp = (rows[c].to_numpy(zero_copy_only=False) for c in ("token", "often", "comp"))
    size, room = (rows[c].to_numpy().astype(np.int64) for c in ("size", "room"))
    new = np.concatenate([[True], token[1:] != token[:-1]])
    begin = np.flatnonzero(new)
    m = np.diff(np.append(begin, len(token)))
    end = np.repeat(begin + m, m)
    keep = often.astype(bool) | np.repeat(m > WIDE, m)
    i = np.flatnonzero(np.repeat((m > 1) & (m <= WIDE), m))
    for d in range(1, WIDE):
        i = i[i + d < end[i]]
        if not i.size:
            break
        j = i + d
        ok = (comp[i] != comp[j]) & (100 * size[i] >= pct * size[j]) & (100 * size[j] >= pct * size[i]) & linkable(size[i], size[j], np.minimum(room[i], room[j]), pct)
        keep[i[ok]] = keep[j[ok]] = True
    return keep


def shared_tokens(tokens: DataFrame, pct: int) -> DataFrame:
    """The rows of `tokens` (token, cls, size, room, often, comp), once each, that have a possible partner; common tokens' rows are spread by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = None, False  # the last group so far; told: it is a wide one, of which only the last row is held, and that is out already
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
            if not rows:
                continue
            token, cls = (rows[0][c].to_numpy() for c in ("token", "cls"))
            rows = rows[0].filter(pa.array(np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])))
            token = rows["token"].to_numpy()
            last = int(np.searchsorted(token, token[-1]))
            first = 0
            if told:  # the rest of a wide group, as it is
                first = int(np.searchsorted(token, token[0], "right"))
                if first > 1:
                    yield rows.slice(1, first - 1)
                if first == len(token):
                    held = rows.slice(first - 1)
                    continue
            told = len(token) - last > WIDE
            if last > first:
                done = rows.slice(first, last - first)
                yield done.filter(pa.array(with_partner(done, pct)))
            if told:
                yield rows.slice(last)
            held = rows.slice(len(token) - 1 if told else last)
        if held is not None and not told:
            yield held.filter(pa.array(with_partner(held, pct)))

    spread = F.when(F.col("often"), F.pmod("cls", F.lit(64))).otherwise(F.lit(0))
    by = tokens.withColumn("spread", spread).repartition("token", "spread").sortWithinPartitions("token", "spread", "cls")
    by = by.select("token", "cls", "size", "room", "often", "comp")
    return by.mapInArrow(run, "token long, cls long, size int, room int, often boolean, comp long")


def _places(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a Bloom bitmap that each key sets."""
    k = keys.to_numpy().view(np.uint64)
    return tuple((x % np.uint64(BLOOM_BITS)).astype(np.int64) for x in (k, k >> np.uint64(32)))


def whole_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """cls, size, fine (a bitmap FINE times as wide as the set), held (packed shingle hashes) of the classes of the texts that `wanted` (row_key, the text's hash) names, once each, and some others that its Bloom bitmap lets pass. Other texts aren't read into words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(BLOOM_BITS, dtype=bool)
        for batch in batches:
            for at in _places(batch["row_key"]):
                flags[at] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)  # eight bitmaps of 1 MB come here, whatever the input
    for row in wanted.select("row_key").repartition(8).mapInArrow(mark, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, sent = np.unpackbits(shared.value).astype(bool), set()
        for batch in batches:
            one, two = _places(batch["row_key"])
            for part in slices(batch.filter(pa.array(flags[one] & flags[two]))):
                out, sets = [], _sets(part, n)
                for s, cls in zip(sets, classes_of(sets)):
                    if cls and cls not in sent:
                        sent.add(cls)
                        out.append((cls, s.size, bitmap(s, FINE), s.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["cls", "size", "fine", "held"])

    found = docs.select("text", F.xxhash64("text").alias("row_key")).mapInArrow(run, "cls long, size int, fine binary, held binary")
    return found.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("size", "fine", "held")))


def verified(docs: DataFrame, n: int, pct: int, pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked; keys: cls, row_key of a text of each class. A set moves once a pair, to its partner with more pairs; one with many meets them in parts."""
    ends = pairs.select(F.col("a").alias("e")).union(pairs.select("b")).groupBy("e").agg(F.count("*").alias("n"))
    ends = materialise(ends, "ends")
    known = pairs.join(ends.toDF("e_a", "n_a"), F.col("a") == F.col("e_a")).join(ends.toDF("e_b", "n_b"), F.col("b") == F.col("e_b"))
    pairs = known.select(F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("n_a") >= F.col("n_b"), F.col("b")).otherwise(F.col("a")).alias("b"))
    fans = pairs.groupBy(F.col("a").alias("f_a")).agg(F.ceil(F.count("*") / FAN).alias("fans"))
    dealt = pairs.join(fans, F.col("a") == F.col("f_a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("fans")).alias("fan"))
    dealt = materialise(dealt, "dealt")
    sets = materialise(whole_sets(docs, n, keys.join(dealt.select(F.col("a").alias("cls")).union(dealt.select("b")).distinct(), "cls")), "sets")

    def possible(x: tuple, y: tuple) -> bool:
        s, t = np.frombuffer(x[1], np.uint8), np.frombuffer(y[1], np.uint8)
        width = min(s.size, t.size)
        s, t = (np.bitwise_or.reduce(v.reshape(-1, width), axis=0) for v in (s, t))
        bits = lambda v: int(np.bitwise_count(v.view(np.uint64)).sum())
        return bool(linkable(x[0], y[0], overlap_bound(x[0], bits(s), y[0], bits(t), bits(s & t)), pct))

    def linked(x: tuple, y: tuple) -> bool:
        s, t = np.frombuffer(x[1], np.uint64), np.frombuffer(y[1], np.uint64)
        same = int((s[np.minimum(np.searchsorted(s, t), s.size - 1)] == t).sum())
        return 100 * same >= pct * (s.size + t.size - same)

    near = materialise(_at_hub(dealt, sets.select("cls", "size", F.col("fine").alias("held")), possible), "possible")
    found = materialise(_at_hub(near, sets.select("cls", "size", "held"), linked).select("a", "b"), "linked")
    forget(ends, dealt, sets, near)
    return found


def _at_hub(pairs: DataFrame, sets: DataFrame, test: Callable[[tuple, tuple], bool]) -> DataFrame:
    """The pairs (a, b, fan) that pass test((size, held) of a, of b); each a meets its b by fans."""
    sent = pairs.select(F.col("a").alias("hub"), "fan", F.lit(1).alias("role"), F.col("b").alias("cls"))
    sent = sent.unionByName(pairs.select(F.col("a").alias("hub"), "fan", F.lit(0).alias("role"), F.col("a").alias("cls")).distinct())
    met = sent.join(sets.withColumnRenamed("cls", "s_cls"), F.col("cls") == F.col("s_cls")).select("hub", "fan", "role", "cls", "size", "held")
    met = met.repartition("hub", "fan").sortWithinPartitions("hub", "fan", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for batch in batches:
            out = []
            for hub, fan, role, cls, size, held in zip(*(batch[c].to_pylist() for c in ("hub", "fan", "role", "cls", "size")), batch["held"]):
                y = (size, held.as_buffer())
                if role == 0:
                    x = (size, held.as_py())
                elif test(x, y):
                    out.append((hub, cls, fan))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "fan"])

    return met.mapInArrow(run, "a long, b long, fan long")


def overlap_bound(size_a, bits_a, size_b, bits_b, both):
    """The largest possible overlap: each bit of one side that the other lacks is a shingle that the other lacks."""
    return np.minimum(size_a - (bits_a - both), size_b - (bits_b - both))


# A pair needs to be met only at its first common shingle, and there its overlap is at most the smaller `room`: the shingles
# from there on. Where that is too little, the pair is dropped; at its first common shingle it isn't, if it is linked.


def linkable(size_a, size_b, bound, pct: int):
    """Whether an overlap of `bound` could link sets of these sizes (of nodes: their smallest)."""
    return (100 + pct) * bound >= pct * (size_a + size_b)


class Tree:
    """A signature tree over classes: rows sorted by size and bitmap, leaves of LEAF rows, two children a node."""

    def __init__(self, size: np.ndarray, comp: np.ndarray, room: np.ndarray, sig: np.ndarray):
        self.levels = []
        count = np.bitwise_count(sig).sum(1).astype(np.int64)
        level = {"or": sig, "lo": size, "hi": size, "bits_lo": count, "room": room, "comp": comp}
        self.rows = level
        step = LEAF
        while True:
            n = len(level["lo"])
            if n == 1 and self.levels:
                break
            cuts = np.arange(0, n, step)
            same = np.minimum.reduceat(level["comp"], cuts) == np.maximum.reduceat(level["comp"], cuts)
            level = {
                "or": np.bitwise_or.reduceat(level["or"], cuts, axis=0),
                "lo": np.minimum.reduceat(level["lo"], cuts),
                "hi": np.maximum.reduceat(level["hi"], cuts),
                "bits_lo": np.minimum.reduceat(level["bits_lo"], cuts),
                "room": np.maximum.reduceat(level["room"], cuts),
                "comp": np.where(same & (level["comp"][cuts] >= 0), level["comp"][cuts], -1),
            }
            self.levels.append((level, step))
            step = 2


def tree_pairs(a: Tree, b: Tree, pct: int, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components that the dual traversal leaves, a whole level of node pairs at a time."""
    depth = max(len(a.levels), len(b.levels))
    rows = lambda t, k: t.rows if k == 0 else t.levels[min(k, len(t.levels)) - 1][0]
    top_a, top_b = rows(a, depth), rows(b, depth)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(top_a["lo"])), np.arange(len(top_b["lo"])), indexing="ij"))

    def kept(x, y, i, j, leaf):
        if itself:
            ok = (i < j) if leaf else (i <= j)
            i, j = i[ok], j[ok]
        ok = (100 * x["hi"][i] >= pct * y["lo"][j]) & (100 * y["hi"][j] >= pct * x["lo"][i])
        ok &= (x["comp"][i] != y["comp"][j]) | (x["comp"][i] < 0)
        ok &= linkable(x["lo"][i], y["lo"][j], np.minimum(x["room"][i], y["room"][j]), pct)
        i, j = i[ok], j[ok]
        if not i.size:
            return i, j
        ok = np.zeros(i.size, bool)
        for s in range(0, i.size, 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            both = np.bitwise_count(x["or"][p] & y["or"][q]).sum(1).astype(np.int64)
            # a row below has bits_lo bits or more, and at most `both` of them are known to the other side
            bound = np.minimum(x["hi"][p] - np.maximum(x["bits_lo"][p] - both, 0), y["hi"][q] - np.maximum(y["bits_lo"][q] - both, 0))
            ok[s : s + (1 << 16)] = linkable(x["lo"][p], y["lo"][q], bound, pct)
        return i[ok], j[ok]

    i, j = kept(top_a, top_b, i, j, depth == 0)
    for k in range(depth - 1, -1, -1):
        def children(t, i):
            if k >= len(t.levels):
                return i[:, None], np.ones((i.size, 1), bool)
            step = t.levels[k][1]
            c = i[:, None] * step + np.arange(step)
            return c, c < len(rows(t, k)["lo"])

        ci, vi = children(a, i)
        cj, vj = children(b, j)
        ok = vi[:, :, None] & vj[:, None, :]
        gi = np.broadcast_to(ci[:, :, None], ok.shape)[ok]
        gj = np.broadcast_to(cj[:, None, :], ok.shape)[ok]
        i, j = kept(rows(a, k), rows(b, k), gi, gj, k == 0)
    return i, j


def _folded(sigs: list[bytes], size: np.ndarray) -> np.ndarray:
    """All bitmaps at the narrowest width among them: a wider one is folded by OR, which keeps the bound true."""
    width = min(map(len, sigs))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(s, np.uint8).reshape(-1, width), axis=0) for s in sigs])


def nearest(first: np.ndarray, second: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Of pairs, for each `second` the one with the largest bound (of equal ones that with the smallest `first`)."""
    order = np.lexsort((first, -bound, second))
    return order[np.concatenate([[True], second[order][1:] != second[order][:-1]])] if order.size else order


def leaf_pairs(rows: pa.RecordBatch, begin: np.ndarray, end: np.ndarray, pct: int, near_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct candidate pairs of many groups of at most LEAF rows, trees of a single leaf each: all leaves are compared in one go."""
    size, room, cls, comp = (rows[c].to_numpy().astype(np.int64) for c in ("size", "room", "cls", "comp"))
    inside = np.repeat(begin, end - begin) + np.arange((end - begin).sum()) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
    stop = np.repeat(end, end - begin)
    near = [(inside[k], inside[k] + d) for d in range(1, LEAF) if (k := inside + d < stop).any()]
    if not near:
        return cls[:0], cls[:0]
    i, j = (np.concatenate(x) for x in zip(*near))
    ok = (comp[i] != comp[j]) & (100 * size[i] >= pct * size[j]) & (100 * size[j] >= pct * size[i])
    ok &= linkable(size[i], size[j], np.minimum(room[i], room[j]), pct)
    i, j = i[ok], j[ok]
    at = size - room  # shingles before this one: of a text and its altered copies the text has the fewest
    later = (at[i] > at[j]) | ((at[i] == at[j]) & (cls[i] > cls[j]))
    a, b = np.where(later, cls[j], cls[i]), np.where(later, cls[i], cls[j])
    order = np.lexsort((b, a))
    once = order[np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])] if order.size else order
    i, j, a, b = i[once], j[once], a[once], b[once]
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    sigs = rows["sig"].take(pa.array(used)).to_pylist()
    p, q = back[: i.size], back[i.size :]
    width = np.array([len(x) for x in sigs], dtype=np.int64)
    most = np.zeros(i.size, np.int64)
    for wide in {(int(x), int(y)) for x, y in zip(width[p], width[q])}:
        at = np.flatnonzero((width[p] == wide[0]) & (width[q] == wide[1]))
        for s in range(0, at.size, 4096):
            k = at[s : s + 4096]
            x, y = (np.bitwise_or.reduce(np.frombuffer(b"".join([sigs[r] for r in side[k]]), np.uint8).reshape(k.size, -1, min(wide)), axis=1) for side in (p, q))
            bits = lambda m: np.bitwise_count(m).sum(1).astype(np.int64)
            m, n = size[i[k]], size[j[k]]
            most[k] = overlap_bound(m, bits(x), n, bits(y), bits(x & y))
    keep = np.flatnonzero(linkable(size[i], size[j], most, pct))
    if near_only:
        keep = keep[nearest(a[keep], b[keep], most[keep])]
    return a[keep], b[keep]


def tree_candidates(rows: DataFrame, pct: int, near_only: bool = False) -> DataFrame:
    """a, b: candidate pairs of the groups in rows (token, cls, size, room, comp, sig, m); m: classes in the group.

    near_only: b once a group, with the nearest class before it. There blocks are trees of their own, and rows with a
    `block` belong to that block.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    d = rows.withColumn("block", F.coalesce("block", own) if "block" in rows.columns else own)
    d = d.withColumn("other", F.col("block") if near_only else F.explode(F.sequence(F.lit(0), blocks - 1)))
    d = d.select("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cls", "size", "room", "comp", "sig")
    d = d.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "size", "cls")

    def pairs_of(group: pa.RecordBatch, x: int, y: int):
        size, room, cls, comp, block = (group[c].to_numpy() for c in ("size", "room", "cls", "comp", "block"))
        size, room = size.astype(np.int64), room.astype(np.int64)
        _, comp = np.unique(comp, return_inverse=True)
        if len(size) < 2 or comp.max() == 0:
            return None
        sigs = group["sig"].to_pylist()
        widths = np.array([len(s) for s in sigs])
        found = []
        # neighbours in size have widths that differ by one step of two at most: a tree for each width and the next
        for w in np.unique(widths):
            near = np.flatnonzero((widths == w) | (widths == 2 * w))
            if len(near) < 2:
                continue
            sig = _folded([sigs[k] for k in near], size[near])
            order = np.lexsort((sig[:, 0], size[near]))
            near, sig = near[order], sig[order]
            if x == y:
                t = Tree(size[near], comp[near], room[near], sig)
                p, q = tree_pairs(t, t, pct, True)
                sig_p = sig_q = sig
                i, j = near[p], near[q]
            else:
                left = block[near] == x
                if left.all() or not left.any():
                    continue
                sig_p, sig_q = sig[left], sig[~left]
                p, q = tree_pairs(Tree(size[near[left]], comp[near[left]], room[near[left]], sig_p), Tree(size[near[~left]], comp[near[~left]], room[near[~left]], sig_q), pct, False)
                i, j = near[left][p], near[~left][q]
            if near_only and i.size:
                bits_p, bits_q = (np.bitwise_count(v).sum(1).astype(np.int64) for v in (sig_p, sig_q))
                both = np.concatenate([np.bitwise_count(sig_p[p[k : k + 65536]] & sig_q[q[k : k + 65536]]).sum(1) for k in range(0, p.size, 65536)]).astype(np.int64)
                bound = overlap_bound(size[i], bits_p[p], size[j], bits_q[q], both)
                at = size - room
                later = (at[i] > at[j]) | ((at[i] == at[j]) & (cls[i] > cls[j]))
                i, j = np.where(later, j, i), np.where(later, i, j)
                best = nearest(cls[i], j, bound)
                i, j = i[best], j[best]
            found.append((cls[i], cls[j]))
        if not found:
            return None
        return tuple(np.concatenate(c) for c in zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            if not held:
                return
            group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            found = pairs_of(group, group["x"][0].as_py(), group["y"][0].as_py())
            if found is not None and found[0].size:
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        held, now = [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("token", "x", "y")], axis=1)
            cuts = np.array([0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)])
            s, e = cuts[:-1], cuts[1:]
            # neither the first nor the last, which can reach beyond this batch
            small = (e - s <= LEAF) & (keys[s, 1] == keys[s, 2]) & (s > 0) & (e < len(keys)) if len(keys) else np.zeros(len(s), bool)
            if small.any():
                a, b = leaf_pairs(batch, s[small], e[small], pct, near_only)
                if a.size:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            for s, e in zip(s[~small].tolist(), e[~small].tolist()):
                if e > s:
                    if now is not None and (keys[s] != now).any():
                        yield from out(held)
                        held = []
                    now = keys[s]
                    held.append(batch.slice(s, e - s))
        yield from out(held)

    return d.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """cls, comp (its component's smallest class) of all ends of links (a, b): labels pass along links and to the labels' own labels until none changes."""
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        seen = edges.join(labels, F.col("b") == F.col("cls")).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(seen, F.col("cls") == F.col("a")).select("cls", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("cls").alias("l_cls"), F.col("comp").alias("l_comp"))
        new = materialise(step.join(jump, F.col("low") == F.col("l_cls"), "left").select("cls", F.least("low", F.coalesce("l_comp", "low")).alias("comp"), F.col("comp").alias("old")), "labels")
        forget(labels)
        if new.where("comp <> old").isEmpty():
            forget(edges)
            return new.select("cls", "comp")
        labels = new


def near_pairs(met: DataFrame, sigs: DataFrame, pct: int) -> DataFrame:
    """a, b: each class b with the nearest class before it, in the groups of its ROUTES rarest shared shingles."""
    first = met.withColumn("i", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("room"), "token"))).where(F.col("i") <= ROUTES)
    routed = first.join(sigs.withColumnRenamed("cls", "g_cls"), F.col("cls") == F.col("g_cls")).select("token", "cls", "size", "room", F.col("cls").alias("comp"), "sig")
    routed = materialise(routed, "routed")
    # of a large group, dealt in blocks, the class with the fewest rare shingles before this one goes to every block
    head = F.min(F.struct((F.col("size") - F.col("room")).alias("at"), "cls", "size", "room", "sig")).alias("head")
    groups = materialise(routed.groupBy("token").agg(F.count("*").alias("m"), head).where("m > 1"), "groups")
    rows = routed.join(groups.select(F.col("token").alias("g_token"), "m", F.col("head.cls").alias("h_cls")), F.col("token") == F.col("g_token"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    heads = groups.where(F.col("m") > BLOCK).select("token", *(F.col(f"head.{c}").alias(c) for c in ("cls", "size", "room")), F.col("head.cls").alias("comp"), F.col("head.sig").alias("sig"), "m", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    rows = rows.where((F.col("m") <= BLOCK) | (F.col("cls") != F.col("h_cls"))).select("token", "cls", "size", "room", "comp", "sig", "m", F.lit(None).cast("int").alias("block"))
    found = materialise(tree_candidates(rows.unionByName(heads), pct, True), "near")
    forget(routed, groups)
    return found


def links_of(docs: DataFrame, n: int, pct: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_key, cls, size), and cls, comp of the classes that are linked with others."""
    found = materialise(classes(docs, n), "classes")
    rows = found.where("kind = 0").select("doc_id", "row_key", "cls", "size")
    total = found.where("kind = 2").agg(F.sum("size")).first()[0] or 0
    often = found.where("kind = 1").groupBy("cls").agg(F.sum("size").alias("n")).where(F.col("n") >= max(8, total * COMMON_SHARE))
    held = [(r["cls"], r["n"]) for r in often.toLocalIterator()]
    common = np.sort(np.array([h for h, _ in held], np.int64).view(np.uint64))
    hot = np.sort(np.array([h for h, k in held if k >= max(WIDE, total * HOT_SHARE)], np.int64).view(np.uint64))
    met = materialise(shared_tokens(prefixes(docs, n, pct, common, hot).withColumn("comp", F.col("cls")), pct), "met")
    sigs = materialise(found.where("kind = 0 and cls <> 0").groupBy("cls").agg(F.first("sig").alias("sig"), F.min("row_key").alias("row_key")), "sigs")
    keys = sigs.select("cls", "row_key")
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = near_pairs(met, sigs, pct)
    links = verified(docs, n, pct, tried, keys)
    comps, tried = components(links), tried.select(*pair)
    for near_only in [True] * ROUNDS + [False]:
        # what is left: shingles whose classes lie in several components
        labelled = met.drop("comp").join(comps.withColumnsRenamed({"cls": "c_cls"}), F.col("cls") == F.col("c_cls"), "left").withColumn("comp", F.coalesce("comp", "cls"))
        rest = materialise(shared_tokens(labelled, pct), "rest")
        open_ = rest.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select(F.col("token").alias("o_token"), "m")
        held = rest.join(open_, F.col("token") == F.col("o_token")).join(sigs.withColumnRenamed("cls", "g_cls"), F.col("cls") == F.col("g_cls")).select("token", "cls", "size", "room", "comp", "sig", "m")
        found = tree_candidates(held, pct, near_only).select(*pair).distinct()
        left = materialise(found.join(tried.toDF("t_a", "t_b"), (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")), "left_anti"), "left")
        forget(rest)
        if left.isEmpty():
            continue
        new = verified(docs, n, pct, left, keys)
        links, tried = links.union(new), tried.union(left)
        comps = components(links)
    forget(met, sigs)
    return rows, comps


def _labelled_rows(docs: DataFrame, n: int, pct: int) -> DataFrame:
    """doc_id, row_key, n_shingles, cls of every row, head (smallest doc_id of its component) and comp of those with shingles."""
    rows, comps = links_of(docs, n, pct)
    comps = comps.withColumnsRenamed({"cls": "c_cls"})
    rows = rows.withColumnRenamed("size", "n_shingles")
    labelled = materialise(rows.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("least")).join(comps, F.col("cls") == F.col("c_cls"), "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp")), "least")
    heads = labelled.groupBy(F.col("comp").alias("h_comp")).agg(F.min("least").alias("head"))
    named = materialise(labelled.join(materialise(heads, "heads"), F.col("comp") == F.col("h_comp")).select(F.col("cls").alias("n_cls"), "head", "comp"), "named")
    return rows.join(named, F.col("cls") == F.col("n_cls"), "left").select("doc_id", "row_key", "n_shingles", "cls", "head", "comp")


def jaccard_components(docs: DataFrame, n: int = 5, pct: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), cls of every row."""
    return _labelled_rows(docs, n, pct).select("doc_id", "n_shingles", F.when(F.col("cls") == 0, F.col("doc_id")).otherwise(F.col("head")).alias("component_id"), "cls")


def keep_one(docs: DataFrame, n: int = 5, pct: int = 80) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null ids last), then the smallest class and hash of the text, then the smallest text and row.

    Rows without shingles all stay. Texts move once, to meet the ids and hashes of the rows that go.
    """
    # each id and text of a component once, with its number of rows
    keys = materialise(_labelled_rows(docs, n, pct).where("cls <> 0").groupBy("comp", "doc_id", "cls", "row_key").agg(F.count("*").alias("m")), "keys")
    best = keys.groupBy(F.col("comp").alias("b_comp")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls", "row_key")).alias("best"))
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key"))
    marked = keys.join(best, F.col("comp") == F.col("b_comp")).select(F.col("doc_id").alias("k_id"), F.col("row_key").alias("k_key"), chosen.alias("chosen"), "m")
    marks = materialise(marked.where("not chosen or m > 1"), "marks")
    forget(keys)
    # the whole row is one column, so that no name of its own can clash
    d = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_key"), F.struct("*").alias("row"))
    same = F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_key") == F.col("k_key"))
    if marks.where("chosen").isEmpty():
        return d.join(marks, same, "left_anti").select("row.*")
    met = materialise(d.join(marks, same, "left").where("chosen is null or chosen").select("d_id", "d_key", "row", "chosen"), "met")
    row = F.col("row")
    once = F.min_by(row, F.struct(row["text"], F.xxhash64("row"), F.to_json("row"))).alias("row")
    repeated = met.where("chosen").groupBy("d_id", "d_key").agg(once).select("row.*")
    return met.where("chosen is null").select("row.*").unionByName(repeated)
