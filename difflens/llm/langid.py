"""Language identification with blended-spectrum presence kernels.

A text's features are the character n-grams of 1 to 3 letters that it holds (lower case; whatever isn't a letter counts
as a space), each hashed to one of 2**18 places. The kernel of two texts is the number of n-grams in both over the
geometric mean of their numbers. A bounded sample of labelled rows gives landmarks for a Nyström map and the rows of a
one-versus-rest kernel ridge regression; every text is scored by its kernel row times one coefficient matrix, batch by batch.

Null texts and texts without a letter are `und` with score 0; without labelled rows all texts are. Repeated rows get equal
rows. Only doc_id and text are read for a prediction; other columns pass untouched in `identify`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PLACES = 1 << 18
UNKNOWN = "und"
#: Labelled rows that the fit uses for a language (about; twice that at most) and landmarks of those.
ROWS_A_LANGUAGE, LANDMARKS_A_LANGUAGE = 150, 32
RIDGE = 1e-3

_letters = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def grams(text: str) -> np.ndarray | None:
    """Presence of the places; None for a text without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return None
    c = np.where(letter, code, 32).astype(np.uint32)
    found = np.zeros(PLACES, dtype=bool)
    one = c * np.uint32(2654435761)
    found[one >> np.uint32(14)] = True
    if c.size > 1:
        two = (one[:-1] ^ (c[1:] + np.uint32(0x9E3779B9))) * np.uint32(2246822519)
        found[two >> np.uint32(14)] = True
        if c.size > 2:
            three = (two[:-1] ^ (c[2:] + np.uint32(0x85EBCA6B))) * np.uint32(3266489917)
            found[three >> np.uint32(14)] = True
    return found


@dataclass
class Model:
    languages: list[str]
    places: np.ndarray  # those that some landmark holds
    landmarks: np.ndarray  # landmarks x places, normalised
    weights: np.ndarray  # landmarks x languages
    least_covered: float  # a text with a smaller share of its n-grams in `places` is near no learned language

    def scores(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        kernel = (x @ self.landmarks.T) / norms[:, None]
        return kernel @ self.weights


def labelled_sample(docs: DataFrame, rows: int = ROWS_A_LANGUAGE) -> DataFrame:
    """About `rows` rows of each language, dealt by a hash of the row; docs: doc_id, text, lang without nulls."""
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return docs.limit(0)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, rows / n)])
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20)).limit(2 * rows * len(counts))


def fit(labelled: DataFrame) -> Model | None:
    """labelled: doc_id, text, lang. What comes to the driver is at most 300 rows a language of packed n-gram sets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [(lang, g) for lang, t in zip(part["lang"].to_pylist(), part["text"].to_pylist()) if (g := grams(t)) is not None]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in got], pa.string()), "held": pa.array([np.flatnonzero(g).astype(np.uint32).tobytes() for _, g in got], pa.binary())})

    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    # by language, then dealt by a hash of the n-grams
    rows = sorted((r["lang"], zlib.crc32(r["held"]), bytes(r["held"])) for r in labelled_sample(rows).mapInArrow(pack, "lang string, held binary").collect())
    if not rows:
        return None
    languages = sorted({lang for lang, *_ in rows})
    y = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, *_ in rows])
    sets = [np.frombuffer(held, dtype=np.uint32) for *_, held in rows]
    marks = [i for x in languages for i in [k for k, (lang, *_) in enumerate(rows) if lang == x][:LANDMARKS_A_LANGUAGE]]
    places = np.unique(np.concatenate([sets[i] for i in marks]))
    norms = np.sqrt([len(s) for s in sets])
    x = np.zeros((len(sets), len(places)), dtype=np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(places, s)
        at[at == len(places)] = 0
        x[i, at[places[at] == s]] = 1
    landmarks = x[marks] / norms[marks][:, None].astype(np.float32)
    kernel = (x @ landmarks.T) / norms[:, None]
    values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = kernel @ root
    balance = (1 / (y > 0).sum(0))[(y > 0).argmax(1)]  # each language weighs the same
    weighted = phi * balance[:, None]
    w = np.linalg.solve(phi.T @ weighted + RIDGE * np.eye(len(marks)) * balance.sum() / len(sets), weighted.T @ y)
    # half of what all but the oddest hundredth of the labelled rows that are no landmarks have
    covered = np.delete(x.sum(1) / norms**2, marks)
    least = float(np.quantile(covered, 0.01)) / 2 if covered.size else 0.0
    return Model(languages, places, landmarks.astype(np.float32), (root @ w).astype(np.float32), least)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and covered (share of the text's n-grams that a landmark has) added; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "covered")
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # LANDMARKS_A_LANGUAGE rows a language of at most PLACES
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string", "score double", "covered double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                said, sure, known = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                texts = part["text"].to_pylist() if m else []
                for first in range(0, len(texts), 128):  # a batch of rows for a product
                    found = [(i, g) for i, t in enumerate(texts[first : first + 128], first) if t and (g := grams(t)) is not None]
                    if found:
                        x = np.stack([g[m.places] for _, g in found]).astype(np.float32)
                        sizes = np.array([float(g.sum()) for _, g in found])
                        s = m.scores(x, np.sqrt(sizes))
                        known[[i for i, _ in found]] = x.sum(1) / sizes
                        best = s.argmax(1)
                        for (i, _), b, v in zip(found, best, np.clip((s.max(1) + 1) / 2, 0, 1)):
                            said[i], sure[i] = m.languages[b], float(v)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string()), pa.array(sure, pa.float64()), pa.array(known, pa.float64())], [*part.schema.names, "lang_pred", "score", "covered"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, train: Column) -> DataFrame:
    """docs (doc_id, text, lang) with lang_pred, score and covered; learns from the rows where `train` holds."""
    return predict(docs, fit(docs.where(train)))
