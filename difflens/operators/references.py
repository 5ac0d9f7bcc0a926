"""References to definitions: names in a chunk's lines, the one span that defines each, and the chunk that owns it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflens.functions import text
from difflens.operators.chunking import by_merge, symbol_lines

#: Names that say nothing.
NOISE = ("console", "JSON", "Math", "Object", "Array", "String", "Number", "Promise", "Set", "Map", "parseInt", "structuredClone", "nameof", "var", "ToString", "Equals", "GetHashCode")


def in_scope(refs: DataFrame, owned: DataFrame) -> DataFrame:
    """doc_id, sym, name, line (the first): references (doc_id, line_no, name) on the lines of a chunk (owned: doc_id, line_no, sym)."""
    telling = refs.where((F.length("name") > 1) & ~F.col("name").isin(*NOISE))
    return telling.join(owned, ["doc_id", "line_no"]).groupBy("doc_id", "sym", "name").agg(F.min("line_no").alias("line"))


def resolve(scoped: DataFrame, spans: DataFrame, imports: DataFrame) -> DataFrame:
    """scoped with to_doc, to_sym, to_line: the name's span in its own or an imported file (imports: doc_id, to_doc), if a file has one such span and one file is left."""
    one = spans.groupBy(F.col("doc_id").alias("to_doc"), "name").agg(F.count("*").alias("n"), F.min("sym_id").alias("to_sym"), F.min("start_line").alias("to_line")).where("n = 1").drop("n")
    tries = scoped.withColumn("to_doc", F.col("doc_id")).unionByName(scoped.join(imports, "doc_id"))
    met = tries.join(by_merge(one), ["to_doc", "name"]).groupBy("doc_id", "sym", "name", "line")
    return met.agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("to_doc", "to_sym", "to_line"))).where("n = 1").drop("n")


def edges(resolved: DataFrame, owned: DataFrame, files: DataFrame, is_test) -> DataFrame:
    """range_id, doc_id, sym, to_doc, to_chunk, kind, line: references to another chunk, which owns the line where the span begins."""
    owner = owned.select(F.col("doc_id").alias("to_doc"), F.col("line_no").alias("to_line"), F.col("sym").alias("to_chunk"))
    met = resolved.join(owner, ["to_doc", "to_line"]).where("doc_id <> to_doc or sym <> to_chunk").join(files.select("doc_id", "range_id", "path"), "doc_id")
    kind = F.when(is_test(F.col("path")), "exercises").otherwise("calls")
    return met.groupBy("range_id", "doc_id", "sym", "to_doc", "to_chunk", kind.alias("kind")).agg(F.min("line").alias("line"))


def unresolved(scoped: DataFrame, resolved: DataFrame) -> DataFrame:
    """doc_id, sym, names (sorted) without a definition."""
    left = scoped.join(resolved.select("doc_id", "sym", "name"), ["doc_id", "sym", "name"], "left_anti")
    return left.groupBy("doc_id", "sym").agg(F.array_sort(F.collect_set("name")).alias("names"))


def context_definitions(scoped: DataFrame, owned: DataFrame, changed: tuple[DataFrame, DataFrame], unchanged: tuple[DataFrame, DataFrame], lines: DataFrame, most: int = 80, reach: int = 5) -> DataFrame:
    """doc_id, sym, name, to_doc, to_sym, changed, body: the definition of each name (scoped: doc_id, sym, name) that the chunk's reader can't see.

    Changed files come first: the chunk's own, where spans on its own lines (owned: doc_id, line_no, sym) don't count, and
    those it imports. Names that they leave open are sought in imported files that the diff doesn't touch. In either case a
    file counts with its only span of the name, and just one file may be left. changed, unchanged: spans and imports
    (doc_id, to_doc). Bodies are capped at `most` lines (text.cap_body).
    """

    def single(names: DataFrame, spans: DataFrame, imports: DataFrame, own: bool) -> DataFrame:
        one = spans.groupBy(F.col("doc_id").alias("to_doc"), "name").agg(F.count("*").alias("n"), F.min_by(F.struct("sym_id", "start_line", "end_line"), "sym_id").alias("span")).where("n = 1").drop("n")
        tries = names.join(imports.distinct(), "doc_id").where("doc_id <> to_doc")
        if own:
            tries = tries.unionByName(names.withColumn("to_doc", F.col("doc_id")))
        met = tries.join(by_merge(one), ["to_doc", "name"]).select("doc_id", "sym", "name", "to_doc", "span.*")
        if own:
            inside = by_merge(met.where("doc_id = to_doc").withColumn("line_no", F.explode(F.sequence("start_line", "end_line")))).join(owned, ["doc_id", "line_no", "sym"], "left_semi").select("doc_id", "sym", "name", "to_doc").distinct()
            met = met.join(inside, ["doc_id", "sym", "name", "to_doc"], "left_anti")
        left = met.groupBy("doc_id", "sym", "name").agg(F.count("*").alias("n"), F.min(F.struct("to_doc", "sym_id", "start_line", "end_line")).alias("x")).where("n = 1")
        return left.select("doc_id", "sym", "name", "x.to_doc", F.col("x.sym_id").alias("to_sym"), "x.start_line", "x.end_line", F.lit(own).alias("changed"))

    names = scoped.select("doc_id", "sym", "name").distinct()
    first = single(names, *changed, own=True)
    second = single(names.join(first, ["doc_id", "sym", "name"], "left_anti"), *unchanged, own=False)
    found = first.unionByName(second)
    span = found.select("to_doc", "to_sym", "start_line", "end_line").distinct().withColumn("line_no", F.explode(F.sequence("start_line", "end_line")))
    rows = by_merge(span).join(lines.withColumnRenamed("doc_id", "to_doc"), ["to_doc", "line_no"]).groupBy("to_doc", "to_sym").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"))
    body = text.cap_body(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), most, reach)
    return found.join(rows.select("to_doc", "to_sym", body.alias("body")), ["to_doc", "to_sym"]).select("doc_id", "sym", "name", "to_doc", "to_sym", "changed", "body")


def definitions(resolved: DataFrame, spans: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, sym, to_doc, to_sym, body: each definition of a chunk once, without those that the chunk itself declares; bodies are capped."""
    wanted = resolved.where("doc_id <> to_doc or sym <> to_sym").select("doc_id", "sym", "to_doc", "to_sym").distinct()
    span = spans.select(F.col("doc_id").alias("to_doc"), F.col("sym_id").alias("to_sym"), F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    told = wanted.select("to_doc", "to_sym").distinct().join(by_merge(span), ["to_doc", "to_sym"])
    told = by_merge(told).join(lines.withColumnRenamed("doc_id", "to_doc"), ["to_doc", "line_no"])
    rows = told.groupBy("to_doc", "to_sym").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"))
    body = text.cap_body(F.array_join(F.transform("rows", lambda r: r["text"]), "\n"))
    return wanted.join(rows.select("to_doc", "to_sym", body.alias("body")), ["to_doc", "to_sym"])


def visible(defs: DataFrame, owned: DataFrame, spans: DataFrame) -> DataFrame:
    """Definitions (to_doc, to_sym) whose span doesn't begin on a changed line of the diff."""
    inside = by_merge(spans).join(owned.select("doc_id", F.col("line_no").alias("start_line")), ["doc_id", "start_line"]).select(F.col("doc_id").alias("to_doc"), F.col("sym_id").alias("to_sym"))
    return defs.join(by_merge(inside), ["to_doc", "to_sym"], "left_anti")


def widened(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, hunk_no, start, end: each range grown to the smallest span around it."""
    s = symbol_lines(spans.select("doc_id", "start_line", "end_line")).withColumnRenamed("line_no", "start")
    inside = F.col("end_line") >= F.col("end")
    best = F.min_by(F.when(inside, F.struct("start_line", "end_line")), F.when(inside, F.struct(F.col("end_line") - F.col("start_line"), "start_line")))
    grown = ranges.join(by_merge(s), ["doc_id", "start"], "left").groupBy("doc_id", "hunk_no", "start", "end").agg(best.alias("s"))
    return grown.select("doc_id", "hunk_no", F.coalesce("s.start_line", "start").alias("start"), F.coalesce("s.end_line", "end").alias("end"))


def namespaces(usings: DataFrame, declared: DataFrame, ancestors) -> DataFrame:
    """range_id, src, dst: files to those that declare a namespace they use (not one of their own), or an ancestor of their own. usings, declared: range_id, path, namespace."""
    own = declared.select("range_id", "path", "namespace")
    used = usings.join(own, ["range_id", "path", "namespace"], "left_anti")
    above = declared.select("range_id", "path", F.explode(ancestors(F.col("namespace"))).alias("namespace"))
    to = declared.select("range_id", "namespace", F.col("path").alias("dst"))
    met = used.select("range_id", "path", "namespace").union(above).join(to, ["range_id", "namespace"])
    return met.where("path <> dst").select("range_id", F.col("path").alias("src"), "dst").distinct()
