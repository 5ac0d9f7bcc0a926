"""Books: anchors of sections, tests beside what they test, chapters, buckets, replies keyed by chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from difflens.functions import paths


def anchors(chunks: DataFrame) -> DataFrame:
    """doc_id, sym: the first chunk of each file. chunks: doc_id, sym, start."""
    return chunks.groupBy("doc_id").agg(F.min_by("sym", F.struct("start", "sym")).alias("sym"))


def lifted(imports: DataFrame, anchors_: DataFrame) -> DataFrame:
    """doc_id, sym, to_doc, to_sym: imports between files (doc_id, to_doc) as edges between their first chunks."""
    return imports.where("doc_id <> to_doc").join(anchors_, "doc_id").join(anchors_.toDF("to_doc", "to_sym"), "to_doc").select("doc_id", "sym", "to_doc", "to_sym")


def test_anchors(tests: DataFrame, impls: DataFrame, imports: DataFrame) -> DataFrame:
    """range_id, test, impl: the imported implementation that stands last, else the longest match of stems (equal, or a prefix of four characters or more; then the later one).

    tests: range_id, path; impls: range_id, path, pos; imports: range_id, src, dst.
    """
    placed = impls.select("range_id", F.col("path").alias("dst"), "pos")
    imported = tests.select("range_id", F.col("path").alias("src")).join(imports, ["range_id", "src"]).join(placed, ["range_id", "dst"]).groupBy("range_id", F.col("src").alias("path")).agg(F.max_by("dst", "pos").alias("near"))
    bare = F.regexp_replace(F.regexp_replace(paths.stem(F.col("path")), r"\.(test|spec)$", ""), "tests?$", "")
    starts = F.array_distinct(F.concat(F.array(bare), F.transform(F.sequence(F.lit(4), F.greatest(F.length(bare), F.lit(4))), lambda k: F.substring(bare, 1, k))))
    stems = tests.select("range_id", "path", F.explode(starts).alias("stem"))
    match = stems.join(impls.select("range_id", F.col("path").alias("impl"), "pos", paths.stem(F.col("path")).alias("stem")), ["range_id", "stem"])
    match = match.groupBy("range_id", "path").agg(F.max_by("impl", F.struct(F.length("stem"), "pos")).alias("like"))
    j = tests.select("range_id", "path").join(imported, ["range_id", "path"], "left").join(match, ["range_id", "path"], "left")
    return j.select("range_id", F.col("path").alias("test"), F.coalesce("near", "like").alias("impl")).where("impl is not null")


def resolved_keys(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """reply, n_keys, accepted, ids (sorted): keys name a chunk by its id or a part of it after `::` that only one id ends in; one unknown key rejects the reply. keys: reply, key; ids: reply, chunk_id."""
    k = keys.select("reply", F.monotonically_increasing_id().alias("n"), F.regexp_replace("key", "^chunk ", "").alias("key"))
    parts = F.split("chunk_id", "::")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "::").alias("key"), (i == 1).alias("whole")))
    known = ids.select("reply", "chunk_id", F.explode(ends).alias("e")).select("reply", "chunk_id", "e.*")
    met = k.join(known, ["reply", "key"], "left").groupBy("reply", "n").agg(F.max(F.when(F.col("whole"), F.col("chunk_id"))).alias("exact"), F.count_distinct("chunk_id").alias("m"), F.min("chunk_id").alias("only"))
    met = met.select("reply", F.coalesce("exact", F.when(F.col("m") == 1, F.col("only"))).alias("id"))
    g = met.groupBy("reply").agg(F.count("*").alias("n_keys"), F.bool_and(F.col("id").isNotNull()).alias("accepted"), F.array_sort(F.collect_set("id")).alias("ids"))
    return g.withColumn("ids", F.when(F.col("accepted"), F.col("ids")).otherwise(F.array().cast("array<string>")))


def section_order(files: DataFrame) -> DataFrame:
    """range_id, path, position: implementations in order, each followed by its tests, then tests without one, unconnected files, low-signal ones. files: range_id, path, role, pos, anchor_pos."""
    block = F.when((F.col("role") == "impl") | ((F.col("role") == "test") & F.col("anchor_pos").isNotNull()), 0).when(F.col("role") == "test", 1).when(F.col("role") == "periphery", 2).otherwise(3)
    beside = F.when(block == 0, F.coalesce("anchor_pos", "pos")).otherwise(F.col("pos"))
    w = Window.partitionBy("range_id").orderBy(block, beside, (F.col("role") == "test").cast("int"), "pos")
    return files.select("range_id", "path", F.row_number().over(w).alias("position"))


def chapters(spine: DataFrame, calls: DataFrame) -> DataFrame:
    """spine (range_id, pos, chunk, path) with chapter: a new one unless the chunk before calls or is called by this one, or shares its file."""
    w = Window.partitionBy("range_id").orderBy("pos")
    s = spine.withColumn("before", F.lag("chunk").over(w)).withColumn("same", F.coalesce(F.col("path") == F.lag("path").over(w), F.lit(False)))
    both = calls.select("range_id", F.col("src").alias("before"), F.col("dst").alias("chunk")).union(calls.select("range_id", "dst", "src")).distinct().withColumn("linked", F.lit(True))
    j = s.join(both, ["range_id", "before", "chunk"], "left")
    new = (~(F.col("same") | F.coalesce("linked", F.lit(False)))).cast("int")
    return j.select("range_id", "pos", "chunk", "path", F.sum(new).over(w).alias("chapter"))


def bucket(path: Column, low_signal: Column, leftover: Column) -> Column:
    return F.when(leftover, "leftover").when(low_signal, "low-signal").when(paths.is_test(path) | paths.is_e2e(path), "test").otherwise("story")


def flattened(occurrences: DataFrame) -> DataFrame:
    """occurrences (range_id, section_no, occ_no, chunk) with pos, ordinal (of the chunk's occurrences), key and first_pos."""
    w = Window.partitionBy("range_id").orderBy("section_no", "occ_no")
    d = occurrences.withColumn("pos", F.row_number().over(w) - 1)
    mine = Window.partitionBy("range_id", "chunk")
    return d.withColumns({"ordinal": F.row_number().over(mine.orderBy("pos")), "first_pos": F.min("pos").over(mine)}).withColumn("key", F.concat_ws("#", F.col("chunk").cast("string"), F.col("ordinal").cast("string")))


def remapped(cursors: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """range_id, at: each cursor's occurrence in another order, 0 where it is gone. before, after: range_id, pos, key."""
    j = cursors.withColumnRenamed("at", "pos").join(before, ["range_id", "pos"], "left").select("range_id", "key")
    return j.join(after.select("range_id", "key", F.col("pos").alias("to")), ["range_id", "key"], "left").select("range_id", F.coalesce("to", F.lit(0)).alias("at"))


def some_and_more(values: Column, most: int) -> Column:
    """The first values, and how many more there are."""
    more = F.size(values) - most
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))


def partition_check(keys: DataFrame, chapters_: DataFrame) -> DataFrame:
    """range_id, missing, unknown, duplicated, empty: counts. keys: range_id, key; chapters_: range_id, chapter, members (array)."""
    said = chapters_.select("range_id", F.explode("members").alias("key")).groupBy("range_id", "key").agg(F.count("*").alias("said"))
    have = keys.select("range_id", "key").distinct().withColumn("have", F.lit(True))
    j = have.join(said, ["range_id", "key"], "full_outer").groupBy("range_id").agg(F.count_if(F.col("said").isNull()).alias("missing"), F.count_if(F.col("have").isNull()).alias("unknown"), F.count_if(F.col("said") > 1).alias("duplicated"))
    none = chapters_.groupBy("range_id").agg(F.count_if(F.size("members") == 0).alias("empty"))
    return j.join(none, "range_id", "left").withColumn("empty", F.coalesce("empty", F.lit(0)))


def ai_line(*texts: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts))


def _joined(rows: DataFrame, keys: list[str], order: list[str], line: str, sep: str) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, line))).alias("rows"))
    return g.select(*keys, F.array_join(F.transform("rows", lambda r: r[line]), sep).alias("text"))


def order_manifest(sections: DataFrame, chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """range_id, text, tokens: a block a story section (key, role, imports of other story sections, chunk lines), then how many sections are pinned.

    sections: range_id, path, role, pos, pinned; chunks: range_id, path, pos, title, kind, lines, stub; imports: range_id, src, dst.
    """
    story = sections.where(~F.col("pinned"))
    end = lambda c: story.select("range_id", F.col("path").alias(c))
    into = imports.where("src <> dst").join(end("src"), ["range_id", "src"], "left_semi").join(end("dst"), ["range_id", "dst"], "left_semi")
    into = into.groupBy("range_id", F.col("src").alias("path")).agg(F.concat(F.lit(" imports: "), F.array_join(F.array_sort(F.collect_set("dst")), ", ")).alias("into"))
    line = F.concat(F.lit("  - "), "title", F.lit(" ("), "kind", F.lit(", ~"), F.col("lines").cast("string"), F.lit(" lines)"), F.coalesce(F.concat(F.lit(" [stub: "), "stub", F.lit("]")), F.lit("")))
    listed = _joined(chunks.select("range_id", "path", "pos", line.alias("line")), ["range_id", "path"], ["pos"], "line", "\n").withColumnRenamed("text", "lines")
    d = story.join(into, ["range_id", "path"], "left").join(listed, ["range_id", "path"], "left")
    block = F.concat_ws("\n", F.concat("path", F.lit(" ["), "role", F.lit("]"), F.coalesce("into", F.lit(""))), "lines")
    n = F.count_if("pinned")
    tail = sections.groupBy("range_id").agg(F.concat(n.cast("string"), F.lit(" pinned tail section"), F.when(n == 1, "").otherwise("s"), F.lit(" (not reorderable)")).alias("tail"))
    g = _joined(d.select("range_id", "pos", block.alias("block")), ["range_id"], ["pos"], "block", "\n\n")
    whole = tail.join(g, "range_id", "left").select("range_id", F.concat_ws("\n\n", "text", "tail").alias("text"))
    return whole.withColumn("tokens", F.ceil(F.length("text") / 4))


#: The last line of a chunk manifest, the markers of a prompt's diffs, the heading of its definitions.
REGROUP = "The grouping above is a starting point; regroup and reorder the chunks into chapters."
OMITTED = "  (diff omitted — over token budget)"
NO_DIFF = "  (no diff content available)"
CONTEXT = "context — not part of the diff"


def chunk_manifest(chunks: DataFrame, calls: DataFrame) -> DataFrame:
    """range_id, text: chunks in order, calls with their first line (0 if unknown), chapters by number.

    chunks: range_id, chunk, pos, chapter, title, kind, lines, path; calls: range_id, src, dst, line.
    """
    s = lambda c: F.col(c).cast("string")
    line = F.concat(s("chunk"), F.lit(" — "), "title", F.lit(" ("), "kind", F.lit(", ~"), s("lines"), F.lit(" lines) ["), "path", F.lit("]"))
    first = _joined(chunks.select("range_id", "pos", line.alias("line")), ["range_id"], ["pos"], "line", "\n").withColumnRenamed("text", "listed")
    call = F.concat(s("src"), F.lit(" -> "), s("dst"), F.lit(" (line "), F.coalesce(s("line"), F.lit("0")), F.lit(")"))
    said = _joined(calls.where("src <> dst").select("range_id", "src", "dst", call.alias("call")), ["range_id"], ["src", "dst"], "call", "\n").withColumnRenamed("text", "said")
    parts = _joined(chunks.select("range_id", "chapter", "pos", s("chunk").alias("id")), ["range_id", "chapter"], ["pos"], "id", ", ")
    numbered = _joined(parts.select("range_id", "chapter", F.concat(s("chapter"), F.lit(". "), "text").alias("line")), ["range_id"], ["chapter"], "line", "\n").withColumnRenamed("text", "numbered")
    j = first.join(numbered, "range_id").join(said, "range_id", "left")
    return j.select("range_id", F.concat_ws("\n\n", "listed", F.concat(F.lit("calls:\n"), F.coalesce("said", F.lit("(none)"))), "numbered", F.lit(REGROUP)).alias("text"))


def prompt_inputs(sections: DataFrame, chunks: DataFrame, definitions: DataFrame, cap: int, definitions_cap: int) -> DataFrame:
    """section, text, omitted, definitions_omitted, tokens: header, then each chunk's facts with its diff or a marker, then definitions, each (path, name) once.

    Two budgets in tokens of four characters, one on top of the other. cap bounds header and chunks: a diff takes its
    marker's place while the whole, with markers for all later chunks, holds at most cap; from the first that doesn't, all keep
    their markers, even those that would fit. definitions_cap bounds the block of definitions, the count of those left out
    included, in the same way. A section whose markers alone pass cap shows no diff; tokens is the whole text's size.

    sections: section, role, imports, imported_by (arrays); chunks: section, pos, id, title, kind, lines, diff; definitions: section, pos, path, name, body.
    """
    list_ = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    header = F.concat_ws("\n", F.concat("section", F.lit(" ["), "role", F.lit("]")), list_("imports: ", "imports"), list_("imported by: ", "imported_by"))
    heads = sections.select("section", header.alias("header"))
    meta = F.concat(F.lit("chunk "), "id", F.lit("\n  "), "title", F.lit(" ("), "kind", F.lit(", ~"), F.col("lines").cast("string"), F.lit(" lines)"))
    shown = F.when(F.col("diff") == "", F.lit(NO_DIFF)).otherwise(F.col("diff"))
    c = chunks.select("section", "pos", "id", meta.alias("meta"), shown.alias("shown")).join(heads.select("section", F.length("header").alias("size")), "section")
    every, upto = Window.partitionBy("section"), Window.partitionBy("section").orderBy("pos", "id")
    least = F.col("size") + F.sum(F.length("meta") + len(OMITTED) + 3).over(every)  # a line break, and an empty line before each chunk
    c = c.withColumn("total", least + F.sum(F.length("shown") - len(OMITTED)).over(upto)).withColumn("kept", F.max("total").over(upto) <= 4 * cap)
    c = c.select("section", "pos", "id", "kept", F.concat_ws("\n", "meta", F.when(F.col("kept"), F.col("shown")).otherwise(F.lit(OMITTED))).alias("block"))
    blocks = c.groupBy("section").agg(_lines("block", "pos", "id").alias("blocks"), F.count_if(~F.col("kept")).alias("omitted"))

    once = definitions.groupBy("section", "path", "name").agg(F.min_by("body", "pos").alias("body"), F.min("pos").alias("pos"))
    once = once.withColumn("line", F.concat("name", F.lit(" — "), "path", F.lit("\n"), "body"))
    first = Window.partitionBy("section").orderBy("pos", "path", "name")
    after = F.count("*").over(every) - F.row_number().over(first)
    d = once.withColumn("total", len(CONTEXT) + F.sum(F.length("line") + 2).over(first) + F.coalesce(F.length(_left_out(after)) + 2, F.lit(0)))
    d = d.withColumn("kept", F.max("total").over(first) <= 4 * definitions_cap)
    d = d.groupBy("section").agg(_lines("line", "pos", "path", "name", where=F.col("kept")).alias("lines"), F.count_if(~F.col("kept")).alias("definitions_omitted"))
    said = d.select("section", "definitions_omitted", F.concat_ws("\n\n", F.lit(CONTEXT), F.when(F.col("lines") != "", F.col("lines")), _left_out(F.col("definitions_omitted"))).alias("said"))
    none = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    out = heads.join(blocks, "section", "left").join(said, "section", "left").select("section", F.concat_ws("\n\n", "header", "blocks", "said").alias("text"), none("omitted"), none("definitions_omitted"))
    return out.withColumn("tokens", F.ceil(F.length("text") / 4).cast("long"))


def _lines(line: str, *order: str, where: Column | None = None) -> Column:
    """The group's lines in order, an empty line between them; those that where leaves out never enter the list."""
    one = F.struct(*order, line)
    rows = F.array_sort(F.collect_list(one if where is None else F.when(where, one)))
    return F.array_join(F.transform(rows, lambda x: x[line]), "\n\n")


def _left_out(n: Column) -> Column:
    """The count of definitions left out; null for none."""
    return F.when(n > 0, F.concat(F.lit("… ("), n.cast("string"), F.lit(" more definition"), F.when(n > 1, "s").otherwise(""), F.lit(" omitted — over context budget)")))
