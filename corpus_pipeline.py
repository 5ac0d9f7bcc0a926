"""A corpus pipeline of five stages over the documents: each works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); its result is written before the next stage is called, which then removes what
the stages before it left in the shared folder. Stages but the last return the columns of docs, whatever their names, and
of rows that stay all values but masked texts as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difflens.llm import decontam, langid, ngram_jaccard, pieces, secret_scan
from difflens.llm.common import crc_mod, forget, noted, shared_path, stable

_left: list[str] = []  # paths in the shared folder that the last stage's result may read


def stage(f: Callable) -> Callable:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs, old = stable(docs), list(_left)  # docs that aren't a plain read are written before anything goes
        forget(*old)
        _left.clear()
        with noted(_left):
            return f(spark, docs, sf_dir)

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and texts near no learned language.

    Repeated rows fare alike. Without any labelled row nothing can be judged, and all rows stay.
    """
    train = F.coalesce(crc_mod(F.col("doc_id"), 3) != 1, F.lit(True))
    model = langid.fit(docs.where(train))
    if model is None:
        return docs
    found = langid.predict(docs.select("text", F.struct("*").alias("row")), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("covered") >= model.least_covered)).select("row.*")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts linked by five-word shingles with a similarity of 0.8 or more: that with the smallest doc_id (null last).

    Ties, as of repeated rows, go by the text; null and empty texts all stay.
    """
    return ngram_jaccard.keep_one(docs, n=5, pct=80)


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a passage of the benchmark; null and empty texts hold none."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every row stays, null texts as they are."""
    return secret_scan.redact(docs)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, decoded_equal of every row; null and empty texts have no ids."""
    return pieces.encode(docs, pieces.load())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("secrets", secrets), ("encoded", encoded)]
#: SQL can't express these stages; tests/llm holds them against hand cases, and their operators against brute force where it exists.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's result is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES:
        path = shared_path(spark, f"stage-{name}")
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            forget(before)
        before = path
    return docs
