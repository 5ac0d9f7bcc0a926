"""The change corpus as tables, derived from the driver's documents by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """range_id, file_no, doc_id, path, base_path, status: one file a document, forty a range."""
    d = table(spark, sf_dir, "documents")
    kind, s = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    other = (F.col("doc_id") - 1).cast("string")
    name = (
        F.when(kind == 0, F.concat(F.lit("src/routes/p"), s, F.lit(".ts")))
        .when(kind == 1, F.concat(F.lit("src/lib/m"), s, F.lit(".ts")))
        .when(kind == 2, F.concat(F.lit("src/lib/m"), other, F.lit(".test.ts")))
        .when(kind == 3, F.concat(F.lit("src/Api/S"), s, F.lit(".cs")))
        .when(kind == 4, F.concat(F.lit("tests/e2e/j"), s, F.lit(".spec.ts")))
        .when(kind == 5, F.concat(F.lit("generated-types/t"), s, F.lit(".ts")))
        .when(kind == 6, F.concat(F.lit("locales/fr"), s, F.lit(".po")))
        .when(kind == 7, F.concat(F.lit("pkg"), s, F.lit("/pnpm-lock.yaml")))
        .when(kind == 8, F.concat(F.lit("src/lib/c"), s, F.lit(".svelte")))
        .otherwise(F.concat(F.lit("conf/c"), s, F.lit(".json")))
    )
    status = F.when(F.col("doc_id") % 17 == 0, "deleted").when(F.col("doc_id") % 13 == 0, "added").when(F.col("doc_id") % 11 == 0, "renamed").otherwise("modified")
    d = d.select(F.expr("doc_id div 40").alias("range_id"), (F.col("doc_id") % 40).cast("int").alias("file_no"), "doc_id", name.alias("path"), status.alias("status"))
    return d.withColumn("base_path", F.when(F.col("status") == "renamed", F.concat(F.lit("old/"), F.col("path"))))


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (1-based), text; some blocks of lines are blank."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "raw"))
    n = F.col("p") + 1
    return d.select("doc_id", n.cast("int").alias("line_no"), F.when((F.col("doc_id") + F.floor(n / 6)) % 9 == 0, "").otherwise(F.col("raw")).alias("text"))


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, side, line_no, text: the head's lines, and the base's, of which every third is another text."""
    head = file_lines(spark, sf_dir)
    other = F.when((F.col("doc_id") + F.col("line_no")) % 3 == 0, F.concat(F.lit("~"), "text")).otherwise(F.col("text"))
    return head.select("doc_id", F.lit("head").alias("side"), "line_no", "text").unionByName(head.select("doc_id", F.lit("base").alias("side"), "line_no", other.alias("text")))


def is_changed():
    return (F.col("line_no") + F.col("doc_id")) % 11 < 6


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, hunk_no, start, count (primary side), other_start, other_count: islands of changed lines, and hunks without a primary line."""
    lines = file_lines(spark, sf_dir).select("doc_id", "line_no")
    changed = lines.where(is_changed())
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    h = changed.withColumn("g", island).groupBy("doc_id", "g").agg(F.min("line_no").alias("start"), F.count("*").cast("int").alias("count")).drop("g")
    none = lines.where((F.col("line_no") + F.col("doc_id")) % 11 == 8).select("doc_id", F.col("line_no").alias("start"), F.lit(0).alias("count"))
    h = h.unionByName(none).withColumn("hunk_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "count")))
    other = F.when(F.col("count") == 0, 1).otherwise((F.col("hunk_no") + F.col("doc_id")) % 3).cast("int")
    return h.select("doc_id", "hunk_no", "start", "count", F.col("start").alias("other_start"), other.alias("other_count"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sym_id, depth, name, kind, start_line, end_line: types of eleven lines with two functions each."""
    n = file_lines(spark, sf_dir).groupBy("doc_id").agg(F.max("line_no").alias("n"))
    k = n.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 12).cast("int"))).alias("k"))
    name = lambda i: F.concat(F.lit("f"), ((F.col("doc_id") * 3 + 2 * F.col("k") + i) % 20).cast("string"))
    one = lambda depth, label, kind, a, b, i: F.struct((F.col("k") * 3 + i).alias("sym_id"), F.lit(depth).alias("depth"), label.alias("name"), F.lit(kind).alias("kind"), (12 * F.col("k") + a).alias("start_line"), (12 * F.col("k") + b).alias("end_line"))
    every = F.array(one(0, F.concat(F.lit("T"), (F.col("k") % 5).cast("string")), "type", 1, 11, 0), one(1, name(0), "function", 2, 5, 1), one(1, name(1), "function", 7, 10, 2))
    return k.select("doc_id", F.explode(every).alias("s")).select("doc_id", "s.*")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """range_id, src, dst, kind, source, line: graphs with cycles, from line items."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "exercises").otherwise("file-imports")
    source = F.when(F.col("l_linestatus") == "O", "references").otherwise("test-anchor")
    return li.select(F.col("l_orderkey").alias("range_id"), (F.col("l_partkey") % 8).alias("src"), (F.col("l_suppkey") % 8).alias("dst"), kind.alias("kind"), source.alias("source"), F.col("l_linenumber").alias("line"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with k out of their properties."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def review_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """range_id, chunk_id, seq, state, auto_read, expanded, reviewed_via."""
    e, kind = events(spark, sf_dir), F.col("event_type")
    state = F.when(kind == "view", "seen").when(kind == "click", "reviewed").when(kind == "signup", "bogus")
    via = F.when(kind == "click", F.when(F.col("event_id") % 3 == 0, "explicit").when(F.col("event_id") % 3 == 1, "auto").otherwise("bad"))
    return e.select((F.col("user_id") % 20).alias("range_id"), F.col("k").alias("chunk_id"), F.col("event_id").alias("seq"), state.alias("state"), F.when(kind == "purchase", True).alias("auto_read"), F.when(kind == "error", F.col("event_id") % 2 == 0).alias("expanded"), via.alias("reviewed_via"))
