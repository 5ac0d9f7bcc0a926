"""Chunking: changed lines, their symbols, chunks, coverage and leftovers. Everything is keyed by file (doc_id) and line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_merge(grown: DataFrame) -> DataFrame:
    """grown (rows made by explode) for a join by sorting. Spark goes by the size before the explode and would broadcast it, past the driver's memory."""
    return grown.hint("merge")


def changed_lines(hunks: DataFrame) -> DataFrame:
    """doc_id, hunk_no, line_no: the primary-side lines of each hunk."""
    return hunks.where("count > 0").select("doc_id", "hunk_no", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("line_no"))


def symbol_lines(symbols: DataFrame) -> DataFrame:
    """symbols with line_no: a row for each line that a symbol spans. Lines then meet their symbols by equality, in as many rows as there are lines times the depth of nesting."""
    return symbols.withColumn("line_no", F.explode(F.sequence("start_line", "end_line")))


def innermost_symbol(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """lines with sym_id, sym_kind of the deepest symbol around each line, null outside all."""
    deepest = F.max_by(F.struct("sym_id", F.col("kind").alias("sym_kind")), F.struct("depth", -F.col("sym_id")))
    around = symbol_lines(symbols).groupBy("doc_id", "line_no").agg(deepest.alias("s"))
    return lines.join(by_merge(around), ["doc_id", "line_no"], "left").select(*lines.columns, "s.sym_id", "s.sym_kind")


def parts(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """doc_id, hunk_no, part_no, sym_id, sym_kind, start, count, other_count: hunks split where the symbol changes.

    The other side's lines stay with the first part. A hunk without primary lines is a part of the symbol at its anchor.
    """
    at = innermost_symbol(changed_lines(hunks), symbols)
    w = Window.partitionBy("doc_id", "hunk_no").orderBy("line_no")
    new = F.coalesce((~F.col("sym_id").eqNullSafe(F.lag("sym_id").over(w))).cast("int"), F.lit(1))
    runs = at.withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("part_no", F.sum("new").over(w).cast("int"))
    runs = runs.groupBy("doc_id", "hunk_no", "part_no").agg(F.first("sym_id").alias("sym_id"), F.first("sym_kind").alias("sym_kind"), F.min("line_no").alias("start"), F.count("*").cast("int").alias("count"))
    anchors = hunks.where("count = 0").select("doc_id", "hunk_no", F.greatest(F.lit(1), "start").alias("line_no"))
    anchored = innermost_symbol(anchors, symbols).select("doc_id", "hunk_no", F.lit(1).alias("part_no"), "sym_id", "sym_kind", F.col("line_no").alias("start"), F.lit(0).alias("count"))
    other = hunks.select(F.col("doc_id").alias("h_doc"), F.col("hunk_no").alias("h_no"), F.col("other_count").alias("all_other"))
    joined = runs.unionByName(anchored).join(other, (F.col("doc_id") == F.col("h_doc")) & (F.col("hunk_no") == F.col("h_no")))
    return joined.select("doc_id", "hunk_no", "part_no", "sym_id", "sym_kind", "start", "count", F.when(F.col("part_no") == 1, F.col("all_other")).otherwise(0).alias("other_count"))


def split_oversize(hunks: DataFrame, lines: DataFrame, cap: int = 40, reach: int = 8) -> DataFrame:
    """doc_id, hunk_no, piece_no, start, count, other_count: hunks of more than cap lines in pieces of at most cap.

    A piece ends after the last blank line among its last `reach` ones, else after the last that ends a statement, else at the cap.
    The other side's lines stay with the first piece. lines: doc_id, line_no, text.
    """
    small = hunks.where(F.col("count") <= cap).select("doc_id", "hunk_no", F.lit(1).alias("piece_no"), "start", "count", "other_count")
    flag = F.when(~F.col("text").rlike(r"\S"), 2).when(F.col("text").rlike(r"[;{}]\s*$"), 1).otherwise(0)
    held = by_merge(changed_lines(hunks.where(F.col("count") > cap))).join(lines, ["doc_id", "line_no"]).select("doc_id", "hunk_no", "line_no", flag.alias("flag"))
    g = held.groupBy("doc_id", "hunk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "flag"))), lambda r: r["flag"]).alias("flags"))
    n = F.size("flags")

    def step(acc, _):
        ideal = acc["at"] + cap
        cuts = F.sequence(ideal, F.greatest(F.least(acc["at"] + 2, ideal), ideal - reach + 1), F.lit(-1))
        ends = lambda f: F.get(F.filter(cuts, lambda c: F.get("flags", c - 1) == f), F.lit(0))
        to = F.when(ideal >= n, n).otherwise(F.coalesce(ends(2), ends(1), ideal))
        grown = F.array_append(acc["out"], F.struct(acc["at"].alias("from"), to.alias("to")))
        return F.when(acc["at"] >= n, acc).otherwise(F.struct(to.alias("at"), grown.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("out"))
    rounds = F.sequence(F.lit(1), F.ceil(n / max(cap - reach + 1, 1)).cast("int"))
    cut = g.select("doc_id", "hunk_no", F.posexplode(F.aggregate(rounds, start, step, lambda acc: acc["out"])).alias("i", "p"))
    j = cut.join(hunks.select("doc_id", "hunk_no", F.col("start").alias("top"), "other_count"), ["doc_id", "hunk_no"])
    other = F.when(F.col("i") == 0, F.col("other_count")).otherwise(0)
    return small.unionByName(j.select("doc_id", "hunk_no", (F.col("i") + 1).alias("piece_no"), (F.col("top") + F.col("p.from")).alias("start"), (F.col("p.to") - F.col("p.from")).alias("count"), other.alias("other_count")))


def fragment_label(bucket: Column, n_buckets: Column) -> Column:
    """`fragment N` of a symbol in several buckets, else null."""
    return F.when(n_buckets > 1, F.concat(F.lit("fragment "), (bucket + 1).cast("string")))


def bucketize(weights: Column, cap: int) -> Column:
    """Bucket number of each weight: filled in order up to cap, a new one where the next doesn't fit."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("bucket"), F.lit(0).alias("held"), none.alias("out"))

    def step(acc, w):
        full = (acc["held"] > 0) & (acc["held"] + w > cap)
        bucket = F.when(full, acc["bucket"] + 1).otherwise(acc["bucket"])
        held = F.when(full, w).otherwise(acc["held"] + w)
        return F.struct(bucket.alias("bucket"), held.alias("held"), F.array_append(acc["out"], bucket).alias("out"))

    return F.aggregate(weights, start, step, lambda acc: acc["out"])


def cut_parts(parts_: DataFrame, lines: DataFrame, cap: int) -> DataFrame:
    """parts_ with those of more than cap lines in pieces (split_oversize), which keep their part's number and symbol."""
    named = parts_.select("doc_id", F.struct("hunk_no", "part_no").alias("hunk_no"), "start", "count", "other_count")
    pieces = split_oversize(named, lines, cap).select("doc_id", "hunk_no.*", "start", "count", "other_count")
    return pieces.join(parts_.select("doc_id", "hunk_no", "part_no", "sym_id", "sym_kind"), ["doc_id", "hunk_no", "part_no"]).select(*parts_.columns)


def chunks(parts_: DataFrame, cap: int = 40, lines: DataFrame | None = None) -> DataFrame:
    """doc_id, sym_id, bucket, kind, n_lines, start, end, n_parts, n_buckets: parts by symbol, dealt into buckets of at most cap lines.

    With lines (doc_id, line_no, text) longer parts are cut first. A part without lines weighs one.
    """
    if lines is not None:
        parts_ = cut_parts(parts_, lines, cap)
    rows = F.array_sort(F.collect_list(F.struct("start", "hunk_no", "part_no", "count", F.greatest("count", F.lit(1)).alias("weight"))))
    g = parts_.groupBy("doc_id", "sym_id", "sym_kind").agg(rows.alias("rows"))
    g = g.withColumn("buckets", bucketize(F.transform("rows", lambda r: r["weight"]), cap)).withColumn("n_buckets", F.array_max("buckets") + 1)
    one = g.select("doc_id", "sym_id", "sym_kind", "n_buckets", F.explode(F.arrays_zip("rows", "buckets")).alias("x"))
    kind = F.when(F.col("sym_kind").isNull(), "other").when(F.col("sym_kind") == "function", F.when(F.col("n_buckets") > 1, "method-fragment").otherwise("method")).otherwise("other")
    lines = F.col("x.rows.count") > 0
    return one.groupBy("doc_id", "sym_id", F.col("x.buckets").alias("bucket"), kind.alias("kind"), "n_buckets").agg(
        F.sum("x.rows.count").alias("n_lines"), F.min(F.when(lines, F.col("x.rows.start"))).alias("start"), F.max(F.when(lines, F.col("x.rows.start") + F.col("x.rows.count") - 1)).alias("end"), F.count("*").alias("n_parts")
    )


def coverage(expected: DataFrame, owned: DataFrame) -> DataFrame:
    """doc_id, line_no, owners: changed lines that no chunk or several own. Both: doc_id, line_no."""
    n = owned.groupBy("doc_id", "line_no").agg(F.count("*").alias("owners"))
    both = expected.select("doc_id", "line_no").distinct().join(by_merge(n), ["doc_id", "line_no"], "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    return both.where("owners <> 1")


def leftovers(expected: DataFrame, owned: DataFrame) -> DataFrame:
    """doc_id, start, end: contiguous runs of lines that no chunk owns."""
    free = expected.select("doc_id", "line_no").distinct().join(by_merge(owned.select("doc_id", "line_no").distinct()), ["doc_id", "line_no"], "left_anti")
    g = free.withColumn("g", F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    return g.groupBy("doc_id", "g").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end")).drop("g")


def _trimmed(text: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def both_sides(hunks: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """doc_id, hunk_no, part (0 primary, 1 other side), side, line_no of a hunk's changed lines: head before base; of a deleted file (doc_ids) the base side alone."""
    h = hunks if deleted is None else hunks.join(deleted.select("doc_id", F.lit(True).alias("gone")), "doc_id", "left")
    gone = F.lit(False) if deleted is None else F.coalesce("gone", F.lit(False))
    span = lambda start, n: F.when(F.col(n) > 0, F.sequence(F.col(start), F.col(start) + F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda part, side, ns: F.transform(ns, lambda i: F.struct(F.lit(part).alias("part"), side.alias("side"), i.cast("int").alias("line_no")))
    other = F.when(gone, F.array().cast("array<int>")).otherwise(span("other_start", "other_count"))
    rows = F.concat(one(0, F.when(gone, "base").otherwise("head"), span("start", "count")), one(1, F.lit("base"), other))
    return h.select("doc_id", "hunk_no", F.explode(rows).alias("r")).select("doc_id", "hunk_no", "r.*")


def change_types(hunks: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, hunk_no, n_lines, change_type: generated if the file has a reason for it, else whitespace if all changed lines of both sides are blank and the file is no submodule, else null.

    lines: doc_id, side, line_no, text; files: doc_id, deleted, submodule, generated_reason.
    """
    j = both_sides(hunks, files.where("deleted")).join(lines, ["doc_id", "side", "line_no"], "left")
    g = j.groupBy("doc_id", "hunk_no").agg(F.count("*").alias("n_lines"), F.bool_and(_trimmed(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    kind = F.when(F.col("generated_reason").isNotNull(), "generated").when(F.col("blank") & ~F.col("submodule"), "whitespace")
    return g.join(files, "doc_id").select("doc_id", "hunk_no", "n_lines", kind.alias("change_type"))


def side_fingerprints(hunks: DataFrame, lines: DataFrame, files: DataFrame, digest) -> DataFrame:
    """doc_id, hunk_no, fingerprint: digest of the trimmed changed lines of both sides, head before base."""
    j = both_sides(hunks, files.where("deleted")).join(lines, ["doc_id", "side", "line_no"], "left")
    rows = j.groupBy("doc_id", "hunk_no").agg(F.array_sort(F.collect_list(F.struct("part", "line_no", _trimmed(F.coalesce("text", F.lit(""))).alias("t")))).alias("rows"))
    return rows.select("doc_id", "hunk_no", digest(F.array_join(F.transform("rows", lambda r: r["t"]), "\n")).alias("fingerprint"))


def whitespace_only(hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, hunk_no, n_lines, whitespace_only: whether all changed lines of a hunk are blank."""
    j = by_merge(changed_lines(hunks)).join(lines, ["doc_id", "line_no"])
    return j.groupBy("doc_id", "hunk_no").agg(F.count("*").alias("n_lines"), F.bool_and(_trimmed(F.col("text")) == "").alias("whitespace_only"))


def fingerprints(hunks: DataFrame, lines: DataFrame, digest) -> DataFrame:
    """doc_id, hunk_no, fingerprint: digest of the trimmed changed lines in order."""
    j = by_merge(changed_lines(hunks)).join(lines, ["doc_id", "line_no"]).select("doc_id", "hunk_no", "line_no", _trimmed(F.col("text")).alias("t"))
    rows = j.groupBy("doc_id", "hunk_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "t"))).alias("rows"))
    return rows.select("doc_id", "hunk_no", digest(F.array_join(F.transform("rows", lambda r: r["t"]), "\n")).alias("fingerprint"))
