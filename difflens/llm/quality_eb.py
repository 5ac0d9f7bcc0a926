"""Quality from a document classifier and its site, by hierarchical empirical Bayes.

A logistic classifier, fitted on a bounded sample of labelled rows, gives each text q, the probability that it is good.
Hosts and paths (a host's sections) are beta-binomial groups of q: the global mean is a host's prior, a host's posterior
mean its paths' prior. The prior strengths come from the observed spread between groups by the method of moments, so
sparse sites shrink to what stands above them. A document's score is its own evidence moved by how far the posterior of
its path, itself left out, lies from the global mean (in log-odds, at most `most_shift`).

Null texts are empty texts; null hosts or paths form a group of their own; repeated rows get equal scores; without
labelled rows of both classes q is 0.5; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, label_sample, materialise, slices, texts_of_sample

#: Labelled rows of each label that the fit uses at most (in expectation; twice that at the very most).
ROWS_A_LABEL = 4000
THRESHOLD, MOST_SHIFT = 0.5, 1.5
_SIGNS = b"|!%$&*#<>"


def features(text: bytes) -> np.ndarray:
    """Shares of kinds of bytes and of repeated words and lines in the whole text."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    same_next = sum(a == b for a, b in zip(words, words[1:]))
    return np.array(
        [
            1.0,
            counts[65:91].sum() / size * 5,
            counts[48:58].sum() / size * 10,
            *(min(2.0, counts[c] / n * 4) for c in _SIGNS),
            min(3.0, size / n / 5),
            min(3.0, np.log1p(n) / 4),
            len(set(words)) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            same_next / n * 4,
            min(2.0, counts[10] / n * 10),
        ]
    )


N_FEATURES = len(features(b""))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_A_LABEL) -> np.ndarray | None:
    """docs: doc_id, text; labels: doc_id, quality. Ids are sampled before a text is read; the driver gets the features of at most about 2 * rows rows."""
    ids, counts = label_sample(labels, "quality", rows)
    if len(counts) < 2:
        return None
    sample = texts_of_sample(docs, ids, "quality")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in as_bytes(batch)]
            yield pa.RecordBatch.from_pydict({"x": pa.array([v.tolist() for v in x], pa.list_(pa.float64())), "y": batch["quality"].cast(pa.int32())})

    got = sorted((r["x"], r["y"]) for r in sample.select("text", "quality").mapInArrow(measure, "x array<double>, y int").collect())
    if not got:
        return None
    x, y = np.array([r[0] for r in got]), np.array([r[1] for r in got], dtype=float)
    weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))  # back to the labels' true shares
    weight /= weight.mean()
    w = np.zeros(N_FEATURES)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(N_FEATURES), x.T @ (weight * (y - p)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def evidence(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id, host, path and q, the classifier's probability (0.01 to 0.99)."""
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.stack([features(t) for t in as_bytes(part)])
                q = np.full(len(x), 0.5) if weights is None else np.clip(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))), 0.01, 0.99)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["host"], part["path"], pa.array(q)], ["doc_id", "host", "path", "q"])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(run, f"doc_id {kind['doc_id']}, host string, path string, q double")


def _strength(groups: DataFrame, mean: float) -> float:
    """The prior's weight in rows: groups (n, s, ss) whose means spread no more than chance explains give a large one."""
    g = groups.where("n >= 2").agg(F.count("*"), F.avg(F.pow(F.col("s") / F.col("n") - mean, 2)), F.avg((F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)) / (F.col("n") - 1))).first()
    if not g[0]:
        return 100.0
    between = max(g[1] - g[2], 1e-6)
    return float(np.clip(mean * (1 - mean) / between - 1, 1.0, 1e6))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD, most_shift: float = MOST_SHIFT) -> DataFrame:
    """doc_id, q, n_path, host_post, path_post, score, kept of every row of docs (doc_id, text and what host and path need)."""
    d = docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    q = materialise(evidence(d, fit(docs, labels)), "evidence")
    sums = [F.count("*").alias("n"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss")]
    paths = materialise(q.groupBy("host", "path").agg(*sums), "paths")  # sums a task first: a hot host is no hot task
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = float(np.clip(0.5 if total is None else total, 0.01, 0.99))
    m_host, m_path = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select(F.col("host").alias("h_host"), ((F.col("s") + m_host * mean) / (F.col("n") + m_host)).alias("host_post"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), F.col("n").alias("n_path"), F.col("s").alias("s_path_sum"), "host_post")
    out = q.join(materialise(sites, "sites"), F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    rest = (F.col("s_path_sum") - F.col("q") + m_path * F.col("host_post")) / (F.col("n_path") - 1 + m_path)
    shift = F.least(F.greatest(_logit(F.col("path_post")) - float(np.log(mean / (1 - mean))), F.lit(-most_shift)), F.lit(most_shift))
    out = out.withColumn("path_post", rest).withColumn("score", 1 / (1 + F.exp(-(_logit(F.col("q")) + shift))))
    return out.select("doc_id", "q", "n_path", "host_post", "path_post", "score", (F.col("score") >= threshold).alias("kept"))
