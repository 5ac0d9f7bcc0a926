"""Periodic runs: stretches of a text that repeat themselves word by word, found by seeds on diagonals.

A run of period q is a maximal stretch of words in which words q apart are equal, with q its smallest period and at least
max(LEAST, 2 * q) words. On the diagonal of lag q it therefore covers at least max(LEAST - q, q) pairs of equal words, so
a k-gram of that many words stands q words apart in it. Lags below LEAST are seeded by k-grams of LEAST / 2 words, lags of
K to 2 * K - 1 by those of K words, for K = LEAST, 2 * LEAST and so on.

Pairs of places of a k-gram stay linear in the text: places less than K / 2 apart make the k-gram itself periodic, so
of others at most three follow within 2 * K words. Where all k-grams of a stretch are periodic, both of its copies lie
in two touching runs of one shorter period, known by then; their phases give the lags.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

#: Words of the shortest run; grams are joined from one to two, three and six words, which is half of it.
LEAST = 12


def _named(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins neighbouring grams: a number for each place whose pair of numbers stands elsewhere too, else -1; those places by number, in order; their numbers."""
    out = np.full(first.size, -1, dtype=np.int64)
    live = np.flatnonzero((first >= 0) & (second >= 0))
    key = first[live] * (first.size + second.size + 1) + second[live]
    order = np.argsort(key, kind="stable")
    places, key = live[order], key[order]
    fresh = np.diff(key, prepend=-1) != 0
    group = np.cumsum(fresh) - 1
    again = np.bincount(group, minlength=1)[group] > 1 if key.size else np.zeros(0, dtype=bool)
    places, group = places[again], group[again]
    out[places] = group
    return out, places, group


def _pairs(places: np.ndarray, group: np.ndarray, within: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lags, places) of a gram's place and the 1st to within-th one after it, for lags of low to high - 1."""
    out = []
    for t in range(1, within + 1):
        same = group[:-t] == group[t:]
        if not same.any():
            break
        lag = places[t:] - places[:-t]
        ok = same & (lag >= low) & (lag < high)
        out.append((lag[ok], places[:-t][ok]))
    return out


def _common(x: np.ndarray, a: int, b: int) -> int:
    """How many words from a on equal those from b on; a < b."""
    n, step, done = x.size - b, 32, 0
    while done < n:
        to = min(done + step, n)
        same = x[a + done : a + to] == x[b + done : b + to]
        if not same.all():
            return done + int(same.argmin())
        done, step = to, step * 2
    return n


def _touching(x: np.ndarray, by_period: dict[int, list], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lags, places) of lags k to 2 * k - 1 between touching runs of one period of at most k / 2."""
    for p, found in by_period.items():
        if 2 * p > k or len(found) < 2:
            continue
        for (a1, b1), (a2, b2) in itertools.pairwise(sorted(found)):
            if a2 > b1 or min(b1 - a1, b2 - a2) < k:
                continue
            sought, held, at = x[a2 : a2 + p].tobytes(), x[a1 : a1 + 2 * p].tobytes(), -1
            while (at := held.find(sought, at + 1)) > 0 and at % x.itemsize:
                pass
            if at < 0:
                continue
            lag = a2 - a1 - at // x.itemsize
            lags = np.arange(k + (lag - k) % p, 2 * k, p)
            starts = np.maximum(a1, a2 - lags)
            ok = np.minimum(b1, b2 - lags) - starts >= lags
            yield lags[ok], starts[ok]


def _extended(x: np.ndarray, seeds: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
    """(lag, start, end) of the widest stretches of words equal to those a lag after them that hold a seed, by lag; per lag the furthest covered word keeps a stretch from being extended again."""
    if not seeds:
        return
    lags, at = (np.concatenate(v) for v in zip(*seeds, strict=True))
    order = np.lexsort((at, lags))
    lags, at = lags[order], at[order]
    first = (np.diff(lags, prepend=-1) != 0) | (np.diff(at, prepend=-2) > 1)  # neighbouring places lie in one stretch
    covered: dict[int, int] = {}
    for q, i in zip(lags[first].tolist(), at[first].tolist(), strict=True):
        floor = covered.get(q, 0)
        if i < floor:
            continue
        covered[q], start = i + _common(x, i, i + q), i
        while start > floor and x[start - 1] == x[start - 1 + q]:
            start -= 1
        yield q, start, covered[q]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a text's words as (start, length, period), by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    seen: dict[bytes, int] = {}
    x = np.fromiter(map(seen.setdefault, words, range(n)), dtype=np.int64, count=n)  # a word is known by its first place
    one = np.where(np.bincount(x, minlength=n)[x] > 1, x, -1)
    two = _named(one[:-1], one[1:])[0]
    three = _named(two[:-1], one[2:])[0]
    grams, places, group = _named(three[:-3], three[3:])
    found: dict[tuple[int, int], int] = {}
    by_period: dict[int, list] = defaultdict(list)
    k, low, high, within = LEAST // 2, 1, LEAST, LEAST - 1
    while places.size:
        seeds = _pairs(places, group, within, low, high)
        if low > 1:
            seeds += _touching(x, by_period, k)
        for q, start, end in _extended(x, seeds):
            stretch = (start, end + q)
            if end + q - start >= max(LEAST, 2 * q) and stretch not in found:  # else its smallest period divides q
                found[stretch] = q
                by_period[q].append(stretch)
        if n < 2 * high:
            break
        grams, places, group = _named(grams[: grams.size - k], grams[k:])
        k, low, high, within = 2 * k, high, 2 * high, 3
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period) and collapsed (kept words joined by one space) of every row's whole text.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows each give their row, a
    null doc_id stays null, other columns aren't read, an empty table gives none. Texts stay in their tasks, one at a time.
    """
    kind = next(f.dataType for f in docs.schema if f.name == "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for part in slices(batch):
                n, runs, kept = [], [], []
                for text in as_bytes(part):
                    words = text.split()  # bytes part at [\x20\x09-\x0D]
                    mine = runs_of(words)
                    n.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in mine])
                    kept.append(b" ".join(collapsed(words, mine)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, of which those whose crc32(doc_id) is divisible by 10 repeat a stretch of their words up to their end; a null doc_id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.expr("h div 10"), F.col("n")
    words = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    sized = words.withColumn("n", F.size("words")).withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)"))
    text = F.expr("concat_ws(' ', slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), cast(1 + (n - a) div p as int)))), 1, n))")
    return sized.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, its longest run and digests of its runs and of its collapsed text."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as before, -r.period as shorter)))")
    listed = F.expr("concat_ws('', transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')))")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", F.expr("-best.before as start"), "best.length", F.expr("-best.shorter as period"), F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
