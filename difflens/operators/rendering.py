"""Diff rows as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unified_rows(hunks: DataFrame, lines: DataFrame, context: int = 3) -> DataFrame:
    """doc_id, row_no, type (gap, context, add), line_no, text: each file's changed lines with context around them.

    No line comes twice; a context line between two hunks is claimed once; a gap row stands where lines are left out.
    """
    changed = hunks.where("count > 0").select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("line_no")).withColumn("own", F.lit(1))
    near = hunks.where("count > 0").select("doc_id", F.explode(F.sequence(F.col("start") - context, F.col("start") + F.col("count") - 1 + context)).alias("line_no")).withColumn("own", F.lit(0))
    shown = changed.unionByName(near).groupBy("doc_id", "line_no").agg(F.max("own").alias("own")).join(lines, ["doc_id", "line_no"])
    w = Window.partitionBy("doc_id").orderBy("line_no")
    shown = shown.withColumn("gap", F.col("line_no") > F.lag("line_no").over(w) + 1)
    row = F.struct(F.when(F.col("own") == 1, "add").otherwise("context").alias("type"), F.col("line_no"), F.col("text"))
    gap = F.struct(F.lit("gap").alias("type"), F.lit(None).cast("int").alias("line_no"), F.lit("").alias("text"))
    d = shown.select("doc_id", "line_no", F.posexplode(F.when(F.col("gap"), F.array(gap, row)).otherwise(F.array(row))).alias("p", "r"))
    order = Window.partitionBy("doc_id").orderBy("line_no", "p")
    return d.select("doc_id", F.row_number().over(order).alias("row_no"), "r.type", F.col("r.line_no").alias("line_no"), "r.text")


def chunk_rows(hunks: DataFrame, lines: DataFrame, context: int = 3) -> DataFrame:
    """doc_id, chunk, row_no, type (gap, context, del, add), head, base (line numbers), text: each chunk's hunks in both sides' coordinates.

    Hunks go by their start on the primary side: head, or base in a deleted file, whose own lines are all deletions. Context
    comes from the primary side and never twice; after a hunk it ends before the next one. Deleted lines stand before added
    ones. A gap stands where the next context begins beyond the last line shown. Files without content have no rows.

    hunks: doc_id, chunk, hunk_no, deleted, head_start, head_count, base_start, base_count (with a count of 0 a start is the
    line before); lines: doc_id, side (head, base), line_no, text.
    """
    main = F.when(F.col("deleted"), "base").otherwise("head")
    h = hunks.withColumns({"main": main, "start": F.when(F.col("deleted"), F.col("base_start")).otherwise(F.col("head_start")), "count": F.when(F.col("deleted"), F.col("base_count")).otherwise(F.col("head_count"))})
    tall = lines.groupBy("doc_id", F.col("side").alias("main")).agg(F.max("line_no").alias("n"))
    w = Window.partitionBy("doc_id", "chunk").orderBy("start", "hunk_no")
    before, last = F.when(F.col("count") > 0, F.col("start") - 1).otherwise(F.col("start")), F.col("before") + F.col("count")
    h = h.join(tall, ["doc_id", "main"]).withColumn("before", before)
    h = h.withColumn("upto", F.least(last + context, F.lead("start").over(w) - 1, "n"))
    shown = F.greatest(F.least("before", "n"), F.when(F.col("count") > 0, last), "upto")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumns({"place": F.row_number().over(w), "shown": F.greatest(F.coalesce(F.max(shown).over(earlier), F.lit(0)), F.lit(0))})
    dels = F.when(F.col("deleted"), 0).otherwise(F.col("base_count"))

    def stretch(phase, kind, side, from_, to):
        ns = F.when(from_ <= to, F.sequence(from_.cast("int"), to.cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(ns, lambda n: F.struct(F.lit(phase).alias("phase"), kind.alias("type"), side.alias("side"), n.alias("line_no")))

    side, own = F.col("main"), F.when(F.col("deleted"), "del").otherwise("add")
    body = F.concat(
        stretch(1, F.lit("context"), side, F.greatest(F.col("before") - context + 1, F.col("shown") + 1), F.least("before", "n")),
        stretch(2, F.lit("del"), F.lit("base"), F.col("base_start"), F.col("base_start") + dels - 1),
        stretch(3, own, side, F.col("start"), F.col("start") + F.col("count") - 1),
        stretch(4, F.lit("context"), side, F.greatest(last + 1, F.col("shown") + 1), F.col("upto")),
    )
    h = h.withColumn("body", body).withColumn("begun", F.coalesce(F.max(F.size("body") > 0).over(earlier), F.lit(False)))
    none = F.array().cast("array<struct<phase:int,type:string,side:string,line_no:int>>")
    gap = F.array(F.struct(F.lit(0).alias("phase"), F.lit("gap").alias("type"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("int").alias("line_no")))
    skipped = F.col("begun") & (F.col("before") - context > F.col("shown"))
    r = h.select("doc_id", "chunk", "place", F.explode(F.concat(F.when(skipped, gap).otherwise(none), F.col("body"))).alias("r")).select("doc_id", "chunk", "place", "r.*")
    met = r.join(lines, ["doc_id", "side", "line_no"], "left")
    order = F.row_number().over(Window.partitionBy("doc_id", "chunk").orderBy("place", "phase", "line_no"))
    on = lambda s: F.when(F.col("side") == s, F.col("line_no")).alias(s)
    return met.select("doc_id", "chunk", order.alias("row_no"), "type", on("head"), on("base"), F.coalesce("text", F.lit("")).alias("text"))


def diff_text(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, diff: rows as text with +, - and space signs, … for a gap."""
    sign = F.when(F.col("type") == "add", F.concat(F.lit("+"), "text")).when(F.col("type") == "del", F.concat(F.lit("-"), "text")).when(F.col("type") == "gap", F.lit("…")).otherwise(F.concat(F.lit(" "), "text"))
    lines = rows.select(*keys, "row_no", sign.alias("line")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("rows"))
    return lines.select(*keys, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("diff"))


def changed_span(rows: DataFrame) -> DataFrame:
    """doc_id, start, end of the changed lines."""
    return rows.where("type in ('add', 'del')").groupBy("doc_id").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end"))


def scope(selection: DataFrame, span: DataFrame) -> DataFrame:
    """doc_id, scope: whole without a selection or where it covers the changed span, else slice. selection: doc_id, from_line, to_line."""
    part = (F.col("from_line") > F.col("start")) | (F.col("to_line") < F.col("end"))
    return selection.join(span, "doc_id", "left").select("doc_id", F.when(part, "slice").otherwise("whole").alias("scope"))


def slice_rows(rows: DataFrame, selection: DataFrame, context: int = 3) -> DataFrame:
    """doc_id, row_no, type, line_no: rows near the selection; of the gaps between kept rows one stays, outer ones go."""
    near = F.col("line_no").between(F.col("from_line") - context, F.col("to_line") + context)
    d = rows.join(selection, "doc_id").withColumn("gaps", F.sum((F.col("type") == "gap").cast("int")).over(Window.partitionBy("doc_id").orderBy("row_no"))).where(near)
    cut = F.col("gaps") > F.lag("gaps").over(Window.partitionBy("doc_id").orderBy("row_no"))
    row = F.struct("type", "line_no")
    gap = F.struct(F.lit("gap").alias("type"), F.lit(None).cast("int").alias("line_no"))
    both = d.withColumn("cut", cut).select("doc_id", "row_no", F.posexplode(F.when(F.col("cut"), F.array(gap, row)).otherwise(F.array(row))).alias("p", "r"))
    return both.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no", "p")).alias("row_no"), "r.type", F.col("r.line_no").alias("line_no"))


def book_text(rows: DataFrame, title: str = "Reading order") -> DataFrame:
    """range_id, text of rows (range_id, pos, heading, body): markdown with fences one back-tick longer than any in the body."""
    runs = F.transform(F.regexp_extract_all("body", F.lit("`+"), F.lit(0)), lambda x: F.length(x))
    fence = F.repeat(F.lit("`"), F.greatest(F.coalesce(F.array_max(runs), F.lit(0)) + 1, F.lit(3)))
    part = rows.select("range_id", "pos", F.concat_ws("\n", F.concat(F.lit("## "), "heading"), fence, "body", fence).alias("part"))
    g = part.groupBy("range_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    return g.select("range_id", F.concat(F.lit(f"# {title}\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n")).alias("text"))


def recolored(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """rows (doc_id, line_no, type, …) whose context lines that another chunk changes are add, or del where the file is deleted. changed: doc_id, line_no, deleted."""
    c = changed.select("doc_id", "line_no", "deleted").distinct()
    other = F.when((F.col("type") == "context") & F.col("deleted").isNotNull(), F.when(F.col("deleted"), "del").otherwise("add"))
    return rows.join(c, ["doc_id", "line_no"], "left").select(*(F.coalesce(other, "type").alias("type") if n == "type" else n for n in rows.columns))


def book_markdown(sections: DataFrame, chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """range_id, text: title, counts, sections with their note, chunks with their origin, kind and size, note and fenced body.

    sections: range_id, section_no, title, intro; chunks: range_id, section_no, pos, title, origin (null in its own section), kind, added, removed, reason, note, body (null if there is none); heads: range_id, title, head.
    """
    quote = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("\n\n> AI: "), c)).otherwise("")
    runs = F.transform(F.regexp_extract_all("body", F.lit("`+"), F.lit(0)), lambda x: F.length(x))
    fence = F.repeat(F.lit("`"), F.greatest(F.coalesce(F.array_max(runs), F.lit(0)) + 1, F.lit(3)))
    block = F.coalesce(F.concat(fence, F.lit("diff\n"), "body", F.lit("\n"), fence), F.lit("_content not available (binary or submodule)_"))
    origin = F.coalesce(F.concat(F.lit(" — from "), "origin"), F.lit(""))
    size = F.concat(F.lit("\n\n"), "kind", F.lit(" · +"), F.col("added").cast("string"), F.lit(" -"), F.col("removed").cast("string"))
    low = F.coalesce(F.concat(F.lit(" · low-signal ("), "reason", F.lit(")")), F.lit(""))
    part = F.concat(F.lit("### "), "title", origin, size, low, quote(F.col("note")), F.lit("\n\n"), block)
    rows = chunks.select("range_id", "section_no", "pos", part.alias("part")).unionByName(sections.select("range_id", "section_no", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("## "), "title", quote(F.col("intro"))).alias("part")))
    g = rows.groupBy("range_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "pos", "part"))).alias("parts"), F.count_if(F.col("pos") >= 0).alias("n"), F.count_if(F.col("pos") < 0).alias("m"))
    top = F.concat(F.lit("# Code story — "), "title", F.lit("\n\n"), F.col("n").cast("string"), F.lit(" chunks · "), F.col("m").cast("string"), F.lit(" sections · head "), F.substring("head", 1, 8), F.lit("\n\n"))
    return g.join(heads, "range_id").select("range_id", F.concat(top, F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"), F.lit("\n")).alias("text"))
