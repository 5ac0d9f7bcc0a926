"""Language-model scores from Elias-Fano n-gram tries, one a part of the contexts.

Unigrams: every word's count among all training tokens, looked up for every text's words (see dictionary.py). Bigrams and
trigrams: every one of the training texts is kept, at any corpus size. Each block of texts sends its distinct pairs and
their successors, packed, to parts by ranges of the pair's hash; the number of parts grows with the tokens. A pair is a
bigram and the context of trigrams at once, so its count is the sum over its successors (END's is a mark). A task
adds up a part, builds its trie and answers each block with one-byte codes; the pairs of each word are counted with the
words. Nothing but totals reaches the driver.
Probabilities interpolate by absolute discounting: P(w | h) = (c(hw) - D) / c(h) + g(h) P(w | shorter h), g(h) = D N(h) / c(h)
with N(h) distinct successors, down to (c + 0.1) / (N + 0.1 (V + 1)). Unseen n-grams add nothing, unseen contexts have g = 1.

A part's trie: its contexts' hashes, rising, and the successors as one Elias-Fano coded sequence (context, 40 bits of the
word's hash). The first summands and the weights g are quantised to one byte by a fixed code, so that no result depends
on how the corpus is cut into blocks and parts.

A null or empty text is one end token. Repeated rows count and score each; an empty table gives an empty result; if no
row is for training, N = V = 0 and all scores are those of unseen words. Only doc_id and text are read.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionary as dic
from .common import as_bytes, forget, materialise, mix, slices, stable, word_hashes

#: Stands for the hash of a text's end.
END = np.uint64(0x5BD1E995A1C3F7E5)
DISCOUNT = 0.5
ADD = 0.1
#: Bits of a successor's hash beside its pair; training tokens a part; entries of a part that are added up at once.
WORD_BITS, PART_TOKENS, MERGE = 40, 1 << 20, 1 << 21
#: Codes of shares from 1 to 1e-12, finer for the larger ones; NOTHING stands for 0.
NOTHING = 255
_STEPS = 254
SHARES = np.append(10.0 ** (-12 * (np.arange(_STEPS + 1) / _STEPS) ** 2), 0.0)
_COUNTS = np.append(1 / SHARES[:-1], 0.0)
#: Bucket numbers of the parts in a block's answers begin here; those of the words are below.
PARTS = 1 << 24
#: Block number of what a part says of words, and words that a task gathers before it says so.
OF_WORDS, GATHERED = -2, 1 << 20


class EliasFano:
    """A strictly or weakly increasing sequence of numbers below `bound`."""

    FIELDS = ("high", "ones", "zeros", "low")

    def __init__(self, n: int, bits: int, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.n, self.bits, self.high, self.ones, self.zeros, self.low = n, bits, high, ones, zeros, low

    @classmethod
    def of(cls, values: np.ndarray, bound: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(np.log2(max(1.0, bound / max(1, n)))))
        v = values.astype(np.uint64)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = ((bound >> bits) + n + 2 + 63) // 64 * 64
        flags = np.zeros(size, dtype=bool)
        flags[at] = True
        high = np.packbits(flags, bitorder="little")
        per = flags.reshape(-1, 64).sum(1)
        ones = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(64 - per)]).astype(np.int64)
        low = np.zeros(n * bits, dtype=bool)
        for b in range(bits):
            low[b::bits] = (v >> np.uint64(b)) & np.uint64(1)
        return cls(n, bits, high, ones, zeros, np.packbits(np.concatenate([low, np.zeros(64, bool)]), bitorder="little"))

    def _select(self, i: np.ndarray, sums: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the i-th one (or zero) in the high bits."""
        word = np.searchsorted(sums, i, "right") - 1
        bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1, bitorder="little")
        bits = 1 - bits if flip else bits
        rank = np.cumsum(bits, axis=1, dtype=np.int8)
        return word * 64 + (rank > (i - sums[word])[:, None]).argmax(1)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        byte = at >> 3
        got = np.zeros(len(i), np.uint64)
        for k in range((self.bits + 14) // 8):
            got |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return ((got >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, self.ones, False) - i) << self.bits) | self.lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 if it isn't there: a successor search within its high part."""
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.n or not len(values):
            return out
        high, low = values >> self.bits, values & ((1 << self.bits) - 1)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - high + 1, 0)
        stop = self._select(high, self.zeros, True) - high
        end, todo = stop.copy(), np.flatnonzero(start < stop)
        while todo.size:  # halves what is left, as a frequent context has many successors
            mid = (start[todo] + end[todo]) >> 1
            below = self.lows(mid) < low[todo]
            start[todo[below]] = mid[below] + 1
            end[todo[~below]] = mid[~below]
            todo = todo[start[todo] < end[todo]]
        at = np.flatnonzero(start < stop)
        at = at[self.lows(start[at]) == low[at]]
        out[at] = start[at]
        return out


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one byte and the 256 values that they stand for (means of equally filled bins)."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 257)[1:-1]))
    code = np.searchsorted(edges, values, "right")
    total, n = np.bincount(code, values, 256), np.bincount(code, minlength=256)
    return code.astype(np.uint8), total / np.maximum(n, 1)


class Trie:
    """Levels by name, all numpy arrays; frequent words are numbers below `words`."""

    def __init__(self, levels: dict[str, np.ndarray]):
        self.levels = levels
        self.words, self.most = int(levels["shape"][0]), int(levels["shape"][1])
        ef = lambda k: EliasFano(int(levels[f"{k}.n"][0]), int(levels[f"{k}.n"][1]), *(levels[f"{k}.{x}"] for x in EliasFano.FIELDS))
        self.pairs, self.pointers, self.triples = ef("pairs"), ef("pointers"), ef("triples")

    @classmethod
    def build(cls, counts: np.ndarray, prior: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray]) -> Trie:
        """counts, prior: of the words as contexts, and their unigram probabilities. pairs, triples: sorted keys (base `words`) and counts."""
        n = len(counts)
        (k2, c2), (k3, c3) = pairs, triples
        levels: dict[str, np.ndarray] = {}

        def put(name: str, ef: EliasFano):
            levels[f"{name}.n"] = np.array([ef.n, ef.bits], dtype=np.int64)
            levels.update({f"{name}.{x}": getattr(ef, x) for x in EliasFano.FIELDS})

        left, right = k2 // max(n, 1), k2 % max(n, 1)
        starts = np.searchsorted(left, np.arange(n + 1))
        put("pairs", EliasFano.of(k2, n * n + 1))
        put("pointers", EliasFano.of(starts, len(k2) + 1))
        base = np.maximum(c2 - DISCOUNT, 0) / np.maximum(counts[left], 1)
        g1 = np.clip(1 - np.bincount(left, base, n), 1e-9, 1)
        g1_code, g1_book = quantised(g1)
        p2 = base + g1_book[g1_code][left] * prior[right]
        p2_code, p2_book = quantised(np.log10(np.maximum(p2, 1e-300)))
        # a trigram's context is a kept pair, and so is its end
        node = np.searchsorted(k2, k3 // max(n, 1))
        end = np.searchsorted(k2, k3 % max(n * n, 1))
        rank = end - starts[right[node]] if len(k3) else np.zeros(0, np.int64)
        most = int(np.diff(starts).max(initial=0)) + 1
        key = node * most + rank
        put("triples", EliasFano.of(key, len(k2) * most + 1))
        base3 = np.maximum(c3 - DISCOUNT, 0) / np.maximum(c2[node], 1) if len(k3) else np.zeros(0)
        g2 = np.clip(1 - np.bincount(node, base3, len(k2)), 1e-9, 1) if len(k2) else np.zeros(0)
        g2_code, g2_book = quantised(g2)
        p3 = base3 + g2_book[g2_code][node] * 10 ** p2_book[p2_code][end] if len(k3) else np.zeros(0)
        p3_code, p3_book = quantised(np.log10(np.maximum(p3, 1e-300)))
        levels |= {"shape": np.array([n, most], dtype=np.int64), "g1": g1_code, "g1.book": np.log10(np.maximum(g1_book, 1e-12)), "g2": g2_code, "g2.book": np.log10(np.maximum(g2_book, 1e-12)), "p2": p2_code, "p2.book": p2_book, "p3": p3_code, "p3.book": p3_book}
        return cls(levels)

    def to_bytes(self) -> tuple[bytes, list]:
        index, parts, at = [], [], 0
        for name, a in self.levels.items():
            pad = -at % 16
            parts += [b"\0" * pad, a.tobytes()]
            index.append((name, a.dtype.str, len(a), at + pad))
            at += pad + a.nbytes
        return b"".join(parts), index

    @classmethod
    def mapped(cls, data: bytes, index: list) -> Trie:
        with tempfile.TemporaryFile() as f:  # it has no name; the mapping keeps it
            f.write(data or b"\0")
            f.flush()
            held = mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ)
        return cls({name: np.frombuffer(held, dtype=kind, count=n, offset=at) if n else np.zeros(0, kind) for name, kind, n, at in index})

    def log10(self, ids: np.ndarray, first: np.ndarray, log_prior: np.ndarray) -> np.ndarray:
        """log10 P of each token. ids: numbers of frequent words, else -1; first: where a text begins; log_prior: of the unigrams."""
        n = len(ids)
        out = log_prior.copy()
        if n < 2 or not self.words:
            return out
        prev = np.concatenate([[-1], ids[:-1]])
        prev[first] = -1
        at = np.flatnonzero(prev >= 0)
        out[at] += self.levels["g1.book"][self.levels["g1"][prev[at]]]
        node = np.full(n, -1, dtype=np.int64)
        both = at[ids[at] >= 0]
        keys, back = np.unique(prev[both] * self.words + ids[both], return_inverse=True)
        node[both] = self.pairs.find(keys)[back]
        hit = both[node[both] >= 0]
        out[hit] = self.levels["p2.book"][self.levels["p2"][node[hit]]]
        context = np.concatenate([[-1], node[:-1]])
        context[first] = -1
        at = np.flatnonzero(context >= 0)
        out[at] += self.levels["g2.book"][self.levels["g2"][context[at]]]
        both = at[node[at] >= 0]
        begins = self.pointers.access(np.arange(self.words + 1)) if both.size else np.zeros(1, np.int64)
        keys, back = np.unique(context[both] * self.most + node[both] - begins[prev[both]], return_inverse=True)
        found = self.triples.find(keys)[back]
        hit = both[found >= 0]
        out[hit] = self.levels["p3.book"][self.levels["p3"][found[found >= 0]]]
        return out


def tokens_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words with END after each text, and where each text begins."""
    h, first = word_hashes(as_bytes(part))
    return np.insert(h, first[1:], END), first[:-1] + np.arange(part.num_rows)


def count_block(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct words, all of them, with their counts in its training rows."""
    words, counts = [], []
    for p in parts:
        for part in slices(p):
            h, first = tokens_of(part)
            train = np.repeat(part["train"].to_numpy(zero_copy_only=False).astype(bool), np.diff([*first, len(h)]))
            u, n = np.unique(h[train], return_counts=True)
            rest = np.unique(h[~train])
            words += [u, rest]
            counts += [n, np.zeros(len(rest), np.int64)]
    return summed(words, counts)


def summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, rising, with the sums of their counts."""
    w, c = np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(w, kind="stable")
    w, c = w[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    return w[start], np.add.reduceat(c, start) if len(w) else c


def total_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """PACKED rows: a block's words with their totals over all blocks, then with their numbers of distinct successors;
    with block -1, a bucket's number of distinct training words (as tokens). packed: block, bucket, words, counts, and
    rows of word_successors."""
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())

    def answers(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        told = [(w, c.astype(np.int64)) for block, w, c in rows if block != OF_WORDS]
        words, total = summed([w for w, _ in told], [c for _, c in told])
        heads, n = summed([w for block, w, _ in rows if block == OF_WORDS], [c.astype(np.int64) for block, _, c in rows if block == OF_WORDS])
        at = numbered(words & _HEAD, heads)
        after = np.where(at >= 0, np.append(n, 0)[at], 0)
        out = [(-1, bucket, b"", b"", int((total > 0).sum()))]
        for block, w, _ in rows:
            if block != OF_WORDS:
                at = np.searchsorted(words, w)
                out.append((block, bucket, w.tobytes(), dic.pack(np.concatenate([total[at], after[at]]).tobytes()), 0))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["block", "bucket", "words", "counts", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for block, bucket, words, counts in zip(*(batch[c].to_pylist() for c in ("block", "bucket", "words", "counts"))):
                if bucket != now and rows:
                    yield answers(now, rows)
                    rows = []
                now = bucket
                if block == OF_WORDS:
                    heads, n = np.frombuffer(dic.unpack(words), np.uint32).reshape(2, -1)
                    rows.append((block, heads.astype(np.uint64) << np.uint64(32), n))
                else:
                    rows.append((block, np.frombuffer(words, np.uint64), np.frombuffer(dic.unpack(counts), np.uint32)))
        if rows:
            yield answers(now, rows)

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, dic.PACKED)


def word_successors(heads: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Rows (OF_WORDS, bucket, data): numbers of distinct successors of words by the first half of their hashes. One that two buckets share goes to both."""
    starts = dic.bucket_starts(buckets)
    low, high = (np.searchsorted(starts, (heads << np.uint64(32)) | rest, "right") - 1 for rest in (np.uint64(0), np.uint64(0xFFFFFFFF)))
    out = []
    for b in np.unique(np.concatenate([low, high])).tolist():
        x, y = np.searchsorted(high, b), np.searchsorted(low, b, "right")
        out.append((OF_WORDS, b, dic.pack(heads[x:y].astype(np.uint32).tobytes() + n[x:y].astype(np.uint32).tobytes())))
    return out


def numbered(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index in `known` (rising) of each hash, -1 if it isn't there."""
    if not len(known):
        return np.full(len(h), -1, np.int64)
    u, back = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(known, u), len(known) - 1)
    return np.where(known[at] == u, at, -1)[back]


def gram_keys(h: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs within texts: the pair's hash, the bits of the word after it (0 after END), place of the pair's second word.

    The hash: `bits` of the second word's (they tell one of 2**bits parts, so that no word is hot), the first half of the
    first word's, then the rest of 32 bits of the second's.
    """
    place = np.arange(len(h)) - np.repeat(first, np.diff([*first, len(h)]))
    at = np.flatnonzero(place >= 1)
    after = np.append(h[1:], END) >> np.uint64(64 - WORD_BITS)
    after[np.append(first[1:], len(h)) - 1] = 0
    with np.errstate(over="ignore"):
        second = mix(h[at - 1] * _PAIR + h[at]) >> np.uint64(32)
    rest = np.uint64(32 - bits)
    part = (second >> rest) << np.uint64(64 - bits) if bits else np.uint64(0)
    return part | (h[at - 1] >> np.uint64(32)) << rest | (second & np.uint64((1 << 32 - bits) - 1)), after[at], at


_PAIR, _HEAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFF00000000)


def _starts(v: np.ndarray) -> np.ndarray:
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    return new


def grouped(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts, rising; where the successors of each begin (one more at the end); the distinct successors, rising in each; index of every given n-gram among them."""
    order = np.argsort(context)
    sorted_ = context[order]
    new = _starts(sorted_)
    contexts, rank = sorted_[new], np.cumsum(new) - 1
    if len(contexts) < 1 << 64 - WORD_BITS:
        key = (rank.astype(np.uint64) << np.uint64(WORD_BITS)) | word[order]
        by = np.argsort(key)
        order, key = order[by], key[by]
        first = _starts(key)
    else:  # of one very long text
        order = np.lexsort((word, context))
        first = _starts(context[order]) | _starts(word[order])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(first) - 1
    held = order[first]
    return contexts, np.append(np.flatnonzero(_starts(context[held])), len(held)), word[held], back


def pack_grams(contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = np.diff(contexts, prepend=np.uint64(0))
    return dic.pack(len(contexts).to_bytes(8, "big") + len(words).to_bytes(8, "big") + dic.planes(gaps, 8) + dic.planes(sizes, 4) + dic.planes(words, WORD_BITS // 8) + dic.planes(counts, 4), 1)


def unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = dic.unpack(data)
    n, m = int.from_bytes(raw[:8], "big"), int.from_bytes(raw[8:16], "big")
    with np.errstate(over="ignore"):
        contexts = np.cumsum(dic.unplaned(raw, n, 8, 16), dtype=np.uint64)
    return contexts, dic.unplaned(raw, n, 4, 16 + 8 * n).astype(np.int64), dic.unplaned(raw, m, WORD_BITS // 8, 16 + 12 * n), dic.unplaned(raw, m, 4, 16 + 12 * n + WORD_BITS // 8 * m).astype(np.int64)


def coded(shares: np.ndarray) -> np.ndarray:
    """One-byte codes of shares above 0 up to 1."""
    return np.rint(np.sqrt(np.clip(-np.log10(shares), 0, 12) / 12) * _STEPS).astype(np.uint8)


class Part:
    """The trie of a part of the contexts, from all its n-grams with their counts."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray):
        """Distinct n-grams, rising by context and word."""
        new = _starts(context)
        self.contexts = context[new]
        begin = np.flatnonzero(new)
        if len(begin) >= 1 << 63 - WORD_BITS:
            raise ValueError("a part has too many contexts")
        rank = np.cumsum(new) - 1
        of = np.add.reduceat(count, begin) if len(begin) else count
        self.share = coded((count - DISCOUNT) / of[rank])
        self.rest = coded(DISCOUNT * np.diff(np.append(begin, len(context))) / of)
        self.often = coded(1 / of)
        self.successors = EliasFano.of((rank << WORD_BITS) | word.astype(np.int64), max(1, len(begin) << WORD_BITS))

    def codes(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> bytes:
        """Weights of the contexts, then one by their counts, then shares of the n-grams."""
        at = np.full(len(contexts), -1, np.int64)
        if len(self.contexts):
            near = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
            at = np.where(self.contexts[near] == contexts, near, -1)
        rest, often, share = np.zeros(len(contexts), np.uint8), np.full(len(contexts), NOTHING, np.uint8), np.full(len(words), NOTHING, np.uint8)
        rest[at >= 0] = self.rest[at[at >= 0]]
        often[at >= 0] = self.often[at[at >= 0]]
        owner = np.repeat(at, sizes)
        asked = np.flatnonzero(owner >= 0)
        for i in range(0, len(asked), 1 << 15):
            some = asked[i : i + (1 << 15)]
            found = self.successors.find((owner[some] << WORD_BITS) | words[some].astype(np.int64))
            share[some[found >= 0]] = self.share[found[found >= 0]]
        return rest.tobytes() + often.tobytes() + share.tobytes()

    def heads(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of the contexts (pairs), by the first half of their hashes, rising, and their numbers of contexts."""
        head = (self.contexts >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)
        begin = np.flatnonzero(_starts(head))
        return head[begin], np.diff(np.append(begin, len(head)))


def added(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams (context, word, count), rising, with the sums of their counts."""
    context, word, count = (np.concatenate(c) for c in zip(*rows))
    contexts, begin, words, back = grouped(context, word)
    return np.repeat(contexts, np.diff(begin)), words, np.bincount(back, count, len(words)).astype(np.int64)


def block_grams(docs: DataFrame, bits: int) -> DataFrame:
    """block, bucket (one of 2**bits parts), data: a block's distinct n-grams of a part with their counts in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in dic.batches_by_block(batches):
            tokens, begins, train, n = [], [], [], 0
            for p in held:
                for part in slices(p):
                    h, first = tokens_of(part)
                    tokens.append(h)
                    begins.append(first + n)
                    train.append(np.repeat(part["train"].to_numpy(zero_copy_only=False).astype(bool), np.diff([*first, len(h)])))
                    n += len(h)
            context, word, at = gram_keys(np.concatenate(tokens), np.concatenate(begins), bits)
            contexts, begin, words, back = grouped(context, word)
            counts = np.bincount(back[np.concatenate(train)[at]], minlength=len(words))
            cuts = [*np.searchsorted(contexts, dic.bucket_starts(1 << bits)), len(contexts)]
            sizes = np.diff(begin)
            for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
                if y > x:
                    data = pack_grams(contexts[x:y], sizes[x:y], words[begin[x] : begin[y]], counts[begin[x] : begin[y]])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([b], pa.int32()), pa.array([data], pa.binary())], ["block", "bucket", "data"])

    return docs.mapInArrow(run, "block long, bucket int, data binary")


def gram_answers(grams: DataFrame, buckets: int, bits: int) -> DataFrame:
    """block, bucket (PARTS and the part), data: codes of the block's contexts and n-grams in the part, in their order; and rows of word_successors."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def row(block: int, bucket: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], ["block", "bucket", "data"])

    def built(rows: list[tuple[int, bytes]]) -> Part:
        total, new, size = none, [], 0
        for _, data in rows:
            contexts, sizes, words, counts = unpack_grams(data)
            seen = counts > 0
            new.append((np.repeat(contexts, sizes)[seen], words[seen], counts[seen]))
            size += int(seen.sum())
            if size >= max(MERGE, len(total[0])):
                total, new, size = added([total, *new]), [], 0
        return Part(*(added([total, *new]) if new else total))

    def answers(part: int, trie: Part, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for block, data in rows:
            contexts, sizes, words, _ = unpack_grams(data)
            yield row(block, PARTS + part, len(contexts).to_bytes(8, "big") + dic.pack(trie.codes(contexts, sizes, words)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
        now, rows = None, []
        for batch in batches:
            for block, bucket, data in zip(*(batch[c].to_pylist() for c in ("block", "bucket", "data"))):
                if bucket != now and rows:
                    yield now, rows
                    rows = []
                now = bucket
                rows.append((block, data))
        if rows:
            yield now, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, n = none[0], none[2]  # of all parts of the task
        for part, rows in parts(batches):
            trie = built(rows)
            yield from answers(part, trie, rows)
            new, m = trie.heads(bits)
            heads, n = summed([heads, new], [n, m])
            if len(heads) > GATHERED:
                yield from (row(*x) for x in word_successors(heads, n, buckets))
                heads, n = none[0], none[2]
        if len(heads):
            yield from (row(*x) for x in word_successors(heads, n, buckets))

    return grams.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "block long, bucket int, data binary")


def lm_scores(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows where `train` holds."""
    d = stable(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), train.alias("train")))
    buckets = dic.buckets_of(docs)
    packed = materialise(dic.block_words(d, count_block, buckets), "words")
    n_train = packed.agg(F.sum("tokens")).first()[0] or 0
    bits = (max(buckets, -(-n_train // PART_TOKENS)) - 1).bit_length()
    grams = materialise(gram_answers(block_grams(d, bits), buckets, bits), "grams")
    successors = grams.where(F.col("block") == OF_WORDS).select("block", "bucket", F.col("data").alias("words"), F.lit(b"").alias("counts"))
    totals = materialise(total_counts(packed.select("block", "bucket", "words", "counts").unionByName(successors), buckets), "totals")
    forget(packed)
    distinct = totals.where("block = -1").agg(F.sum("tokens")).first()[0] or 0
    bottom = n_train + ADD * (distinct + 1)

    def finish(told: dict[int, bytes]):
        words, total, after = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rest, often, share = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
        for b in sorted(told):  # by ranges of hashes, so that all of a kind rise
            n, data = int.from_bytes(told[b][:8], "big"), told[b][8:]
            if b < PARTS:
                words.append(np.frombuffer(data[:n], np.uint64))
                told_of = np.frombuffer(dic.unpack(data[n:]), np.int64).reshape(2, -1)
                total.append(told_of[0])
                after.append(told_of[1])
            else:
                codes = np.frombuffer(dic.unpack(data), np.uint8)
                rest.append(codes[:n])
                often.append(codes[n : 2 * n])
                share.append(codes[2 * n :])
        words, total, after, rest, often, share = (np.concatenate(x) for x in (words, total, after, rest, often, share))
        prior = (total + ADD) / bottom
        weight = np.where(total > 0, DISCOUNT * after / np.maximum(total, 1), 1.0)  # of a word as context

        def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            h, first = tokens_of(part)
            at = numbered(h, words)
            context, word, place = gram_keys(h, first, bits)
            contexts, begin, held, back = grouped(context, word)
            if (at < 0).any() or len(contexts) != len(rest) or len(held) != len(share):
                raise ValueError("a block holds other words than when they were counted; write the documents first")
            p = prior[at]
            base = np.log10(p)
            of = np.repeat(np.arange(len(contexts)), np.diff(begin))[back]
            pairs = np.maximum(_COUNTS[often[of]] - DISCOUNT, 0) / np.maximum(total[at[place - 1]], 1)
            p[place] = pairs + weight[at[place - 1]] * p[place]
            more = np.flatnonzero(h[place] != END)  # trigrams build on bigrams
            p[place[more] + 1] = SHARES[share[back[more]]] + SHARES[rest[of[more]]] * p[place[more] + 1]
            each = np.log10(p)
            n = np.diff([*first, len(h)])
            rows = [part["doc_id"], pa.array(n, pa.int64()), pa.array(np.add.reduceat((total[at] > 0).astype(np.int64), first)), pa.array(np.full(len(n), n_train, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(each, first))]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return run

    size = F.octet_length("words").cast("long")
    answers = totals.where("block >= 0").select("block", "bucket", F.concat(F.unhex(F.lpad(F.hex(size), 16, "0")), "words", "counts").alias("data"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # a block is one piece, as its codes stand in the order of its distinct n-grams
    return dic.meet(d.select("doc_id", "text"), answers.unionByName(grams.where("block >= 0")), finish, schema, chunk_bytes=1 << 60)
