"""Toxicity from a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts and full-width forms to plain Latin, digits and
signs that stand for letters to those letters, whatever isn't a letter to a space. The lexicon holds whole words and
stems (beginnings of words) with weights: log-odds of the label among a bounded sample of labelled rows that hold them.
One Aho-Corasick automaton finds its entries and the exception phrases; an entry inside an exception phrase doesn't
count. A logistic curve, fitted on the same sample, maps the weights' sum over a slowly growing power of the length, and
the largest weight, to a score.

Null and empty texts hold nothing and get the score of a text without matches; without labelled rows every score is 0.
Repeated rows get equal scores. Only doc_id and text are read for a score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import label_sample, slices, texts_of_sample

#: Letters that look like Latin ones (Cyrillic, Greek and others), and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝпткмвнгαβεικνορτυχωıłøđðſɑɡ", "aeopcyxijshdqwntkmbhraβeiknoptyxwiloddsag")) | {"β": "b"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which words of abuse are harmless.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "take out the trash", "clown fish", "circus clown", "sore loser", "pathetic fallacy")
#: Labelled rows of each label that the fit uses (about; twice that at most), rows with an entry and its weight at least, lengths of stems.
ROWS_A_LABEL, LEAST_ROWS, LEAST_WEIGHT, STEMS = 6000, 4, 3, range(4, 9)
THRESHOLD = 0.7

_table = None


def fold(text: str) -> str:
    """The folded text with a space at each end; at most as long as the text and 2 more."""
    global _table
    if _table is None:
        t = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                wide = unicodedata.normalize("NFKC", c).lower()
                c = wide if len(wide) == 1 else c.lower()[:1]
                t[i] = ord(HOMOGLYPHS.get(c, c))
        for c, to in SUBSTITUTES.items():
            t[ord(c)] = ord(to)
        _table = t
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return f" {_table[code].tobytes().decode('utf-32-le', 'replace')} "


def entries_of(folded: str) -> set[str]:
    """The words (' word ') and stems (' stem') of a folded text."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for n in STEMS:
            if len(w) > n:
                out.add(f" {w[:n]}")
    return out


def automaton(lexicon: dict[str, float], exceptions=EXCEPTIONS) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in exceptions:
        a.add_word(key := f" {phrase} ", (len(key), None))
    for entry, weight in lexicon.items():
        a.add_word(entry, (len(entry), weight))
    if len(a):
        a.make_automaton()
    return a


def evidence(a: ahocorasick.Automaton, text: str | None) -> tuple[float, float, int]:
    """Sum of the weights over length ** 0.25, largest weight, matches. Of entries that begin at a place the heaviest counts."""
    if not text or not len(a):
        return 0.0, 0.0, 0
    folded, best, excused = fold(text), {}, []
    for end, (size, weight) in a.iter(folded):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if excused:
        best = {s: w for s, w in best.items() if not any(x <= s < y for x, y in excused)}
    if not best:
        return 0.0, 0.0, 0
    return sum(best.values()) / (1 + len(folded) / 100) ** 0.25, max(best.values()), len(best)


class Model:
    def __init__(self, lexicon: dict[str, float], curve: np.ndarray):
        self.lexicon, self.curve = lexicon, curve

    def score(self, found: tuple[float, float, int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve @ [1.0, found[0], found[1]], -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_A_LABEL) -> Model | None:
    """docs: doc_id, text; labels: doc_id, toxic. Ids are sampled before a text is read; the driver gets the entries and three figures a sampled row."""
    ids, counts = label_sample(labels, "toxic", rows)
    if len(counts) < 2:
        return None
    sample = texts_of_sample(docs, ids, "toxic")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    total = {k: max(1, n.get(k, 0)) for k in (0, 1)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                seen: dict[str, list[int]] = {}
                for t, toxic in zip(part["text"].to_pylist(), part["toxic"].to_pylist()):
                    for e in entries_of(fold(t)):
                        seen.setdefault(e, [0, 0])[toxic] += 1
                yield pa.RecordBatch.from_pydict({"entry": pa.array(list(seen), pa.string()), "n0": pa.array([v[0] for v in seen.values()], pa.int64()), "n1": pa.array([v[1] for v in seen.values()], pa.int64())})

    by = sample.mapInArrow(count, "entry string, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # up to two imagined rows without the label for each entry, so that chance and copies of a few rows give none
    weight = F.log((F.col("n1") / total[1]) / ((F.col("n0") + min(2.0, total[0] / 3000)) / total[0]))
    found = by.where(f"n1 >= {LEAST_ROWS}").withColumn("w", F.least(weight, F.lit(6.0))).where(F.col("w") > LEAST_WEIGHT).collect()
    lexicon = {r["entry"]: float(r["w"]) for r in found}
    model = Model(lexicon, np.zeros(3))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(shared.value.lexicon)
        for batch in batches:
            e = [evidence(a, t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in e], pa.float64()), "b": pa.array([x[1] for x in e], pa.float64()), "toxic": batch["toxic"]})

    got = np.array(sorted((r["a"], r["b"], r["toxic"]) for r in sample.mapInArrow(measure, "a double, b double, toxic int").collect())).reshape(-1, 3)
    model.curve = _logistic(np.column_stack([np.ones(len(got)), got[:, :2]]), got[:, 2])
    return model


def score(docs: DataFrame, model: Model | None, exceptions=EXCEPTIONS) -> DataFrame:
    """doc_id, score, matches of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # entries of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        a = automaton(m.lexicon, exceptions) if m else None
        for batch in batches:
            for part in slices(batch):
                e = [evidence(a, t) for t in part["text"].to_pylist()] if m else [(0.0, 0.0, 0)] * part.num_rows
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([m.score(x) if m else 0.0 for x in e], pa.float64()), pa.array([x[2] for x in e], pa.int64())], ["doc_id", "score", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, matches long")


def toxicity(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """doc_id, score, matches; learns from the labelled rows where `train` (over doc_id) holds."""
    return score(docs, fit(docs, labels.where(train)))
