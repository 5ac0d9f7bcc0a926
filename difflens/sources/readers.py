"""Readers and writers: diff text, overlays that fail open, ledgers, range-partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_diff(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (range_id, file_no, path, base_path, status, binary, submodule) and hunks of texts (range_id, text), diffs without context."""
    lines = texts.select("range_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    header = F.col("line").startswith("diff --git ")
    w = Window.partitionBy("range_id").orderBy("n")
    lines = lines.withColumn("file_no", F.sum(header.cast("int")).over(w)).where("file_no > 0")
    line, pick = F.col("line"), lambda p: F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1))
    f = lines.groupBy("range_id", "file_no").agg(
        F.max(pick(r"^diff --git a/.* b/(.*)$")).alias("named"),
        F.max(pick(r"^rename from (.*)$")).alias("base_path"),
        F.coalesce(F.max(pick(r"^rename to (.*)$")), F.max(pick(r"^\+\+\+ b/(.*)$"))).alias("to"),
        F.max(pick(r"^--- a/(.*)$")).alias("from"),
        F.bool_or(line.startswith("new file mode")).alias("added"),
        F.bool_or(line.startswith("deleted file mode")).alias("deleted"),
        F.bool_or(line.rlike("^(Binary files |GIT binary patch)")).alias("binary"),
        F.bool_or(line.rlike(r"^(index [0-9a-f]+\.\.[0-9a-f]+|(old|new|new file|deleted file) mode) 160000$")).alias("submodule"),
    )
    status = F.when(F.col("added"), "added").when(F.col("deleted"), "deleted").when(F.col("base_path").isNotNull(), "renamed").otherwise("modified")
    path = F.coalesce(F.when(F.col("deleted"), F.col("from")), F.col("to"), F.col("named"))
    files = f.select("range_id", F.col("file_no").cast("int").alias("file_no"), path.alias("path"), "base_path", status.alias("status"), "binary", "submodule").where("path <> ''")
    at = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    number = lambda i, d=None: F.coalesce(F.expr("nullif(regexp_extract(line, '%s', %d), '')" % (at.replace("\\", "\\\\"), i)).cast("int"), F.lit(d))
    hunks = lines.where(line.rlike(at)).select("range_id", F.col("file_no").cast("int").alias("file_no"), number(1).alias("base_start"), number(2, 1).alias("base_count"), number(3).alias("head_start"), number(4, 1).alias("head_count"))
    return files, hunks


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines; blank and malformed ones are left out."""
    return spark.read.schema("ts timestamp, kind string, unitKey string, usage struct<input:bigint,output:bigint,cost:double>").option("mode", "DROPMALFORMED").json(path)


def read_overlay(spark: SparkSession, path: str, fields: str, version: int) -> DataFrame:
    """Overlay rows of the version; wrong versions and malformed lines count as absent."""
    d = spark.read.schema(f"version int, {fields}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return d.where(f"version = {version} and _corrupt is null").drop("_corrupt", "version")


def write_ranges(df: DataFrame, path: str) -> None:
    """Overwrites only the ranges that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range_id").parquet(path)


def content_lines(files: DataFrame, head: DataFrame, base: DataFrame) -> DataFrame:
    """doc_id, side, line_no, text of changed files: base alone of deleted ones, head alone of added ones, neither of binary files and submodules; a renamed file's base is read from its old path.

    files: range_id, doc_id, path, base_path, status, binary, submodule; head, base: range_id, path, text.
    """
    shown = files.where(~F.col("binary") & ~F.col("submodule"))
    old = shown.where("status <> 'added'").select("range_id", "doc_id", F.coalesce("base_path", "path").alias("path")).join(base, ["range_id", "path"])
    new = shown.where("status <> 'deleted'").select("range_id", "doc_id", "path").join(head, ["range_id", "path"])
    both = new.select("doc_id", F.lit("head").alias("side"), "text").unionByName(old.select("doc_id", F.lit("base").alias("side"), "text"))
    return both.select("doc_id", "side", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", "side", (F.col("p") + 1).alias("line_no"), "text")


def write_books(books: DataFrame, path: str) -> None:
    """One text file a range, of books (range_id, text)."""
    books.select("range_id", "text").write.mode("overwrite").partitionBy("range_id").text(path)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """range_id, text of what write_books wrote."""
    return spark.read.text(path, wholetext=True).select(F.col("range_id").cast("long").alias("range_id"), F.regexp_replace("value", r"\n\z", "").alias("text"))
