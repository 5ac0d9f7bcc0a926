"""Registered queries of sources and sinks, fragments, manifests, prompts, runs and deferrals, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difflens.catalog import _RESOLVED, FIXTURE, SQL, _imports, query, tx_register_gates
from difflens.catalog_book import _TEST
from difflens.catalog_story import _Book
from difflens.functions import paths, text
from difflens.operators import book, chunking, evaluation, freshness, imports, items, rendering
from difflens.sources import corpus, readers
from difflens.sources.scratch import shared_path
from difflens.streaming import state

def _id() -> F.Column:
    return F.col("doc_id")


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ---- sources and sinks (IO-*)


@query("""with f as (select *, case when status = 'renamed' then 'old/' || path else path end as old from c_files where doc_id % 10 <> 6 and doc_id % 30 <> 7)
select doc_id, 'head' as side, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as text from f join documents using (doc_id) where status <> 'deleted'
union all select doc_id, 'base', unnest(range(1, len(string_split(text, chr(10))) + 1)), unnest(string_split(old || ':' || text, chr(10))) from f join documents using (doc_id) where status <> 'added'""")
def io2_content_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-2: .po files are binary, every third lock file a submodule; a base's text begins with its path."""
    f = corpus.files(spark, sf_dir).withColumns({"binary": F.col("path").endswith(".po"), "submodule": _id() % 30 == 7})
    head = f.select("doc_id", "range_id", "path", F.coalesce("base_path", "path").alias("old")).join(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return readers.content_lines(f, head.select("range_id", "path", "text"), head.select("range_id", F.col("old").alias("path"), F.concat("old", F.lit(":"), "text").alias("text")))


@query("select event_type as kind, 'u' || user_id as unit, k as input, event_id as output, value as cost from c_events where event_id % 7 > 0 and event_id % 11 > 0")
def io4_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-4: the events written as ledger lines, some cut off and some blank, and read again."""
    e, path = corpus.events(spark, sf_dir), shared_path(spark, "ledger")
    usage = F.struct(F.col("k").alias("input"), F.col("event_id").alias("output"), F.col("value").alias("cost"))
    line = F.to_json(F.struct("ts", F.col("event_type").alias("kind"), F.concat(F.lit("u"), _s("user_id")).alias("unitKey"), usage.alias("usage")))
    e.select(F.when(F.col("event_id") % 7 == 0, F.lit('{"ts":')).when(F.col("event_id") % 11 == 0, "").otherwise(line).alias("value")).write.text(path)
    return readers.read_ledger(spark, path).select("kind", F.col("unitKey").alias("unit"), "usage.input", "usage.output", "usage.cost")


@query("select 'k' || event_id as key, user_id as value from events where event_id % 4 = 0 and event_id % 7 > 0")
def io5_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-5: of four entries one has the version, two have another, one has none; every seventh line is malformed."""
    e, path = corpus.table(spark, sf_dir, "events"), shared_path(spark, "overlay")
    version = F.when(F.col("event_id") % 4 == 0, 2).when(F.col("event_id") % 4 < 3, 1)
    line = F.to_json(F.struct(version.alias("version"), F.concat(F.lit("k"), _s("event_id")).alias("key"), F.col("user_id").alias("value")))
    e.select(F.when(F.col("event_id") % 7 == 0, F.expr("'{\"version\":2,'")).otherwise(line).alias("value")).write.text(path)
    return readers.read_overlay(spark, path, "key string, value long", 2)


@query("""with b as (select f.*, doc_id % 10 // 5 as section_no, text || case when doc_id % 5 = 0 then chr(10) || '`````' else '' end as body from c_files f join documents using (doc_id)),
p as (select range_id, section_no, doc_id as pos, '### ' || path || case when doc_id % 3 = 0 then ' — from src/x.ts' else '' end || chr(10) || chr(10) || 'method · +' || doc_id || ' -' || doc_id % 7 || case when doc_id % 10 = 7 then ' · low-signal (lockfile)' else '' end || case when doc_id % 4 = 0 then chr(10) || chr(10) || '> AI: note' else '' end || chr(10) || chr(10) ||
 case when doc_id % 10 = 6 then '_content not available (binary or submodule)_' else repeat('`', m) || 'diff' || chr(10) || body || chr(10) || repeat('`', m) end as part from (select *, greatest(coalesce(list_max(list_transform(regexp_extract_all(body, '`+'), lambda x: length(x))), 0) + 1, 3) as m from b)
 union all select distinct range_id, section_no, -1, '## part ' || section_no || case when section_no = 1 then chr(10) || chr(10) || '> AI: intro' else '' end from b)
select range_id, '# Code story — r' || range_id || chr(10) || chr(10) || count(*) filter (pos >= 0) || ' chunks · ' || count(*) filter (pos < 0) || ' sections · head ' || substr(md5(range_id::varchar), 1, 8) || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) order by section_no, pos) || chr(10) as text from p group by range_id""")
def io6_book_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-6: two sections a range, a chunk a file with its whole text; written as one text file a range and read again."""
    f = corpus.files(spark, sf_dir).join(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("section_no", F.expr("doc_id % 10 div 5"))
    body = F.when(_id() % 10 == 6, None).otherwise(F.concat("text", F.when(_id() % 5 == 0, "\n`````").otherwise("")))
    chunks = f.select(
        "range_id", "section_no", _id().alias("pos"), F.col("path").alias("title"), F.when(_id() % 3 == 0, "src/x.ts").alias("origin"), F.lit("method").alias("kind"), _id().alias("added"), (_id() % 7).alias("removed"),
        F.when(_id() % 10 == 7, "lockfile").alias("reason"), F.when(_id() % 4 == 0, "note").alias("note"), body.alias("body"),
    )
    sections = f.select("range_id", "section_no", F.concat(F.lit("part "), _s("section_no")).alias("title"), F.when(F.col("section_no") == 1, "intro").alias("intro")).distinct()
    heads = f.select("range_id", F.concat(F.lit("r"), _s("range_id")).alias("title"), F.md5(_s("range_id")).alias("head")).distinct()
    path = shared_path(spark, "books")
    readers.write_books(rendering.book_markdown(sections, chunks, heads), path)
    return readers.read_books(spark, path)


@query("select range_id, path, case when range_id % 2 = 0 then 2 else 1 end as version from c_files where range_id % 2 = 1 or doc_id % 2 = 0")
def io7_range_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-7: all ranges are written, then even ones again with half of their rows."""
    f, path = corpus.files(spark, sf_dir).select("range_id", "path", "doc_id"), shared_path(spark, "ranges")
    readers.write_ranges(f.select("range_id", "path", F.lit(1).alias("version")), path)
    readers.write_ranges(f.where("range_id % 2 = 0 and doc_id % 2 = 0").select("range_id", "path", F.lit(2).alias("version")), path)
    return spark.read.parquet(path).select(F.col("range_id").cast("long").alias("range_id"), "path", "version")


@query("select doc_id, case doc_id % 4 when 0 then 'My-repo' when 1 then 'r_' when 2 then 'p.' else 'a-b' end || doc_id || '-' || substr(md5(doc_id::varchar), 1, 12) as repo_id from documents")
def io8_repo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-8: web and ssh origins with and without .git and closing slashes, and none."""
    n, s = _id() % 4, _s(_id())
    origin = F.when(n == 0, F.concat(F.lit("https://h/x/My repo"), s, F.lit(".git"))).when(n == 1, F.concat(F.lit("git@h:team/r_"), s, F.lit(".git/"))).when(n == 3, F.concat(F.lit("https://h/a+b"), s))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", paths.repo_id(origin, F.concat(F.lit("/work/p."), s), F.md5(s)).alias("repo_id"))


# ---- scalars (SC-9, SC-15), roles (GR-4), imports (JN-1)


@query("select conv_id, turn, lower(to_base(list_reduce(list_prepend(2166136261::ubigint, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)::ubigint)), lambda h, c: (xor(h, c) * 16777619::ubigint) % 4294967296::ubigint)::bigint, 36)) as digest from conversations")
def sc9_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-9."""
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fnv1a(F.col("text")).alias("digest"))


@query("""with c as (select event_id, case event_id % 5 when 0 then 'dependency-first' else case when event_id % 2 = 0 then 'consumer-first' else 'dependency-first' end end as direction, case event_id % 5 when 0 then 'after' when 2 then 'end' else case when event_id % 3 = 0 then 'before' else 'after' end end as placement from events)
select *, direction || '/' || placement as key, direction = 'dependency-first' and placement = 'after' as file_mode from c""")
def sc15_story_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-15: whole, unknown, partial, broken and absent settings over four bases."""
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, '{"direction":"dependency-first","testPlacement":"after"}').when(i % 5 == 1, '{"direction":"sideways","testPlacement":7}').when(i % 5 == 2, '{"testPlacement":"end"}').when(i % 5 == 3, "nonsense")
    config = items.story_config(raw, F.when(i % 2 == 0, "consumer-first").otherwise("dependency-first"), F.when(i % 3 == 0, "before").otherwise("after"))
    return corpus.table(spark, sf_dir, "events").select("event_id", config.alias("c")).select("event_id", "c.*")


_ROLE = f"case when doc_id % 10 in (5, 6, 7) then 'low-signal' when {_TEST} then 'test' when (range_id, path) in (select range_id, path from {_RESOLVED} where path <> target union all select range_id, target from {_RESOLVED} where path <> target) then 'impl' else 'periphery' end"


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = corpus.files(spark, sf_dir)
    edges = imports.import_graph(_imports(spark, sf_dir), f)[0]
    return imports.roles(f.select("range_id", "path", (_id() % 10).isin(5, 6, 7).alias("low_signal")), edges), edges


@query(f"select range_id, path, {_ROLE} as role from c_files")
def gr4_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir)[0]


_SOURCES = """(select range_id, path, doc_id % 10 as n, case doc_id % 10 when 8 then '<p>import ''./no''</p>' || chr(10) || '<script lang="ts">' || chr(10) || 'import b from ''./z' || doc_id || '''' || chr(10) || '</script>' || chr(10)
 when 3 then 'using A.B' || doc_id || ';' || chr(10) || '  global using static C.D;' || chr(10) || 'namespace N' || doc_id || ' {' || chr(10) else 'import a from "./x' || doc_id || '";' || chr(10) || 'import ''./y' || doc_id || '''' || chr(10) end || text as t from c_files join documents using (doc_id))"""
_FROM, _SIDE = r"""'\bfrom\s*[''"]([^''"]+)[''"]'""", r"""'(?:^|[\n;])\s*import\s*[''"]([^''"]+)[''"]'"""


@query(rf"""with s as {_SOURCES}, m as (select range_id, path, case when n = 8 then array_to_string(regexp_extract_all(t, '<script[^>]*>([\s\S]*?)</script>', 1), chr(10)) else t end as t from s where n in (0, 1, 2, 4, 5, 8))
select range_id, path, 'specifier' as kind, unnest(regexp_extract_all(t, {_FROM}, 1)) as specifier from m union all select range_id, path, 'specifier', unnest(regexp_extract_all(t, {_SIDE}, 1)) from m
union all select range_id, path, 'specifier', unnest(regexp_extract_all(t, '(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*;', 1)) from s where n = 3 union all select range_id, path, 'namespace', unnest(regexp_extract_all(t, '(?m)^\s*namespace\s+([A-Za-z_][A-Za-z0-9_.]*)\s*[;{{]', 1)) from s where n = 3""")
def jn1_specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-1: modules, Svelte and C# sources: import lines before each document's whole text."""
    s, n = _s(_id()), _id() % 10
    svelte = F.concat(F.lit("<p>import './no'</p>\n<script lang=\"ts\">\nimport b from './z"), s, F.lit("'\n</script>\n"))
    sharp = F.concat(F.lit("using A.B"), s, F.lit(";\n  global using static C.D;\nnamespace N"), s, F.lit(" {\n"))
    module = F.concat(F.lit('import a from "./x'), s, F.lit("\";\nimport './y"), s, F.lit("'\n"))
    d = corpus.files(spark, sf_dir).join(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return imports.extract(d.select("range_id", "path", F.concat(F.when(n == 8, svelte).when(n == 3, sharp).otherwise(module), "text").alias("text")))


# ---- fragments (CH-6, CH-8), rows (RN-2)

FIXTURE |= {
    "c_ends": r"c_ends as (select doc_id, line_no, case when not regexp_matches(t, '\S') then 2 when regexp_matches(t, '[;{}]\s*$') then 1 else 0 end as flag from (select doc_id, line_no, case when (line_no + doc_id) % 5 = 0 and text <> '' then text || ';' else text end as t from c_lines))",
    "c_snap": "c_snap as (select e.doc_id, i.line_no as ideal, coalesce(max(e.line_no) filter (e.flag = 2), max(e.line_no) filter (e.flag = 1), i.line_no) as cut from c_ends i join c_ends e on e.doc_id = i.doc_id and e.line_no between i.line_no - 7 and i.line_no group by e.doc_id, i.line_no)",
    "c_tall": "c_tall as (select doc_id, max(line_no) as n from c_lines group by doc_id)",
    "c_cut": "c_cut as (select doc_id, 1 as piece_no, 0 as top, case when n <= 12 then n else cut end as bottom, n from c_tall left join (select doc_id, cut from c_snap where ideal = 12) using (doc_id) union all select c.doc_id, c.piece_no + 1, c.bottom, case when c.bottom + 12 >= c.n then c.n else s.cut end, c.n from c_cut c left join c_snap s on s.doc_id = c.doc_id and s.ideal = c.bottom + 12 where c.bottom < c.n)",
    "c_marks": r"c_marks as (select doc_id, line_no, case when not regexp_matches(text, '\S') then 2 when regexp_matches(text, '[;{}]\s*$') then 1 else 0 end as flag from c_lines)",
    "c_halves": "c_halves as (select p.doc_id, p.hunk_no, p.part_no, coalesce(max(line_no) filter (flag = 2), max(line_no) filter (flag = 1), any_value(start) + 3) - any_value(start) + 1 as k from c_parts p left join c_marks m on m.doc_id = p.doc_id and m.line_no between start + 1 and start + 3 where count > 4 group by all)",
    "c_pieces": "c_pieces as (select doc_id, hunk_no, part_no, sym_id, sym_kind, start + x.a as start, x.b - x.a as count, case when x.a = 0 then other_count else 0 end as other_count from (select p.*, unnest(case when k is null then [{'a': 0, 'b': count}] else [{'a': 0, 'b': k}, {'a': k, 'b': count}] end) as x from c_parts p left join c_halves using (doc_id, hunk_no, part_no)))",
    "c_lots": "c_lots as (select *, coalesce(sym_id, -1) as sym, greatest(count, 1) as w, row_number() over (partition by doc_id, coalesce(sym_id, -1) order by start, hunk_no, part_no) as i from c_pieces)",
    "c_dealt": "c_dealt as (select doc_id, sym, i, 0 as bucket, w as held from c_lots where i = 1 union all select l.doc_id, l.sym, l.i, case when d.held + l.w > 4 then d.bucket + 1 else d.bucket end, case when d.held + l.w > 4 then l.w else d.held + l.w end from c_dealt d join c_lots l on l.doc_id = d.doc_id and l.sym = d.sym and l.i = d.i + 1)",
    "c_frags": """c_frags as (select l.doc_id, l.sym_id, d.bucket, case when any_value(l.sym_kind) = 'function' then case when any_value(t.n_buckets) > 1 then 'method-fragment' else 'method' end else 'other' end as kind, any_value(t.n_buckets) as n_buckets, sum(l.count) as n_lines, min(l.start) filter (l.count > 0) as start, max(l.start + l.count - 1) filter (l.count > 0) as "end", count(*) as n_parts
 from c_lots l join c_dealt d on d.doc_id = l.doc_id and d.sym = l.sym and d.i = l.i join (select doc_id, sym, max(bucket) + 1 as n_buckets from c_dealt group by all) t on t.doc_id = l.doc_id and t.sym = l.sym group by l.doc_id, l.sym_id, d.bucket)""",
}


@query("select doc_id, 1 as hunk_no, piece_no, top + 1 as start, bottom - top as count, case when piece_no = 1 then doc_id % 5 else 0 end as other_count from c_cut")
def ch6_oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-6: each document is one hunk, in pieces of at most twelve lines; every fifth line ends a statement."""
    lines = corpus.file_lines(spark, sf_dir)
    ended = F.when(((F.col("line_no") + _id()) % 5 == 0) & (F.col("text") != ""), F.concat("text", F.lit(";"))).otherwise(F.col("text"))
    hunks = lines.groupBy("doc_id").agg(F.lit(1).alias("hunk_no"), F.lit(1).alias("start"), F.max("line_no").alias("count")).withColumn("other_count", (_id() % 5).cast("int"))
    return chunking.split_oversize(hunks, lines.withColumn("text", ended), cap=12)


@query("""select doc_id, sym_id, bucket, case when n_buckets > 1 then 'fragment ' || (bucket + 1) end as label from c_frags""")
def ch8_fragment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-8."""
    c = chunking.chunks(chunking.parts(corpus.hunks(spark, sf_dir), corpus.symbols(spark, sf_dir)), cap=4, lines=corpus.file_lines(spark, sf_dir))
    return c.select("doc_id", "sym_id", "bucket", chunking.fragment_label(F.col("bucket"), F.col("n_buckets")).alias("label"))


SQL["ch7_fragments"] = SQL["ch8_fragment_labels"].replace("select doc_id, sym_id, bucket, case when n_buckets > 1 then 'fragment ' || (bucket + 1) end as label from c_frags", "select * from c_frags")


@query("""with o as (select doc_id, hunk_no, line_no, max(own) as own from (select doc_id, hunk_no, line_no, 1 as own from c_hunk_lines union all select doc_id, hunk_no, unnest(range(start - 3, start + count + 3)), 0 from c_hunks where count > 0) join c_lines using (doc_id, line_no) group by all)
select o.doc_id, o.hunk_no, o.line_no, case when own = 0 and (o.line_no + o.doc_id) % 11 >= 6 then 'context' when o.doc_id % 17 = 0 then 'del' else 'add' end as type from o""")
def rn2_recolored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RN-2: each hunk with three lines around it; lines that other hunks change aren't context."""
    h, lines = corpus.hunks(spark, sf_dir).where("count > 0"), corpus.file_lines(spark, sf_dir).select("doc_id", "line_no")
    near = h.select("doc_id", "hunk_no", "start", "count", F.explode(F.expr("sequence(start - 3, start + count + 2)")).alias("line_no")).join(lines, ["doc_id", "line_no"])
    own = F.col("line_no").between(F.col("start"), F.col("start") + F.col("count") - 1)
    rows = near.select("doc_id", "hunk_no", "line_no", F.when(own, F.when(_id() % 17 == 0, "del").otherwise("add")).otherwise("context").alias("type"))
    return rendering.recolored(rows, lines.where(corpus.is_changed()).withColumn("deleted", _id() % 17 == 0))


# ---- texts (TX-*)

FIXTURE["c_gates"] = f"c_gates as ({SQL['tx_register_gates']})"


@query("""select conv_id as section, coalesce(list(kind || ' ' || turn order by turn, kind) filter (len(failures) = 0), []) as kept, coalesce(list(kind || ' ' || turn || ': ' || array_to_string(failures, ',') order by turn, kind, failures) filter (len(failures) > 0), []) as dropped from c_gates group by conv_id""")
def tx5_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-5: a conversation's turns as the texts of a section."""
    t = tx_register_gates(spark, sf_dir)
    return text.salvage(t.select(F.col("conv_id").alias("section"), F.col("turn").alias("seq"), F.concat_ws(" ", "kind", _s("turn")).alias("key"), "failures"))


@query(f"""with r as (select *, {_ROLE} as role from c_files), c as (select doc_id, string_agg(line, chr(10) order by sym) as lines from (select doc_id, coalesce(sym_id, -1) as sym, '  - sym ' || coalesce(sym_id, -1) || ' (' || case when any_value(sym_kind) = 'function' then 'method' else 'other' end || ', ~' || sum(count) || ' lines)' || case when sum(count) = 0 then ' [stub: empty]' else '' end as line from c_parts group by doc_id, sym_id) group by doc_id),
i as (select e.range_id, e.path, ' imports: ' || string_agg(distinct e.target, ', ' order by e.target) as into_ from {_RESOLVED} e join r s on s.range_id = e.range_id and s.path = e.path and s.role <> 'low-signal' join r t on t.range_id = e.range_id and t.path = e.target and t.role <> 'low-signal' where e.path <> e.target group by e.range_id, e.path),
b as (select r.range_id, string_agg(r.path || ' [' || role || ']' || coalesce(into_, '') || coalesce(chr(10) || lines, ''), chr(10) || chr(10) order by file_no) as t from r left join c using (doc_id) left join i on i.range_id = r.range_id and i.path = r.path where role <> 'low-signal' group by r.range_id),
n as (select range_id, count(*) filter (role = 'low-signal') as n from r group by range_id)
select range_id, text, cast(ceil(length(text) / 4) as bigint) as tokens from (select n.range_id, coalesce(t || chr(10) || chr(10), '') || n || ' pinned tail section' || case when n = 1 then '' else 's' end || ' (not reorderable)' as text from n left join b on b.range_id = n.range_id)""")
def tx7_order_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-7, by file; low-signal files are the pinned tail."""
    f = corpus.files(spark, sf_dir)
    roles, edges = _roles(spark, sf_dir)
    sections = roles.join(f.select("range_id", "path", F.col("file_no").alias("pos")), ["range_id", "path"]).withColumn("pinned", F.col("role") == "low-signal")
    sym = F.coalesce("sym_id", F.lit(-1))
    c = chunking.chunks(chunking.parts(corpus.hunks(spark, sf_dir), corpus.symbols(spark, sf_dir)), cap=1 << 30).join(f.select("doc_id", "range_id", "path"), "doc_id")
    c = c.select("range_id", "path", sym.alias("pos"), F.concat(F.lit("sym "), _s(sym)).alias("title"), "kind", F.col("n_lines").alias("lines"), F.when(F.col("n_lines") == 0, "empty").alias("stub"))
    return book.order_manifest(sections, c, edges).withColumn("tokens", F.col("tokens").cast("long"))


@query("""with c as (select range_id, string_agg(chunk || ' — c' || chunk || ' (method, ~' || (chunk + 1) || ' lines) [' || path || ']', chr(10) order by pos) as a from s_run group by range_id),
p as (select range_id, string_agg(t, chr(10) order by chapter) as p from (select range_id, chapter, chapter || '. ' || string_agg(chunk::varchar, ', ' order by pos) as t from s_run group by range_id, chapter) group by range_id),
e as (select range_id, string_agg(src || ' -> ' || dst || ' (line ' || line || ')', chr(10) order by src, dst) as e from s_calls group by range_id)
select c.range_id, a || chr(10) || chr(10) || 'calls:' || chr(10) || coalesce(e, '(none)') || chr(10) || chr(10) || p || chr(10) || chr(10) || 'The grouping above is a starting point; regroup and reorder the chunks into chapters.' as text from c join p on p.range_id = c.range_id left join e on e.range_id = c.range_id""")
def tx7_chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-7, by chunk, over the chapters of the spine."""
    b = _Book(spark, sf_dir)
    rows = book.chapters(b.spine().select("range_id", "pos", "chunk", "path"), b.calls)
    return book.chunk_manifest(rows.select("*", F.concat(F.lit("c"), _s("chunk")).alias("title"), F.lit("method").alias("kind"), (F.col("chunk") + 1).alias("lines")), b.calls)


@query(f"""with l as (select coalesce(a.range_id, b.range_id) as range_id, coalesce(a.path, b.path) as path, o, i from (select range_id, path, string_agg(distinct target, ', ' order by target) as o from {_RESOLVED} where path <> target group by all) a full join (select range_id, target as path, string_agg(distinct path, ', ' order by path) as i from {_RESOLVED} where path <> target group by all) b on a.range_id = b.range_id and a.path = b.path),
h as (select f.path, f.doc_id, f.path || ' [impl]' || coalesce(chr(10) || 'imports: ' || o, '') || coalesce(chr(10) || 'imported by: ' || i, '') as head from c_files f left join l on l.range_id = f.range_id and l.path = f.path),
d as (select doc_id, hunk_no, row_number() over (partition by doc_id order by hunk_no) as i, 'chunk ' || hunk_no || chr(10) || '  hunk ' || hunk_no || ' (other, ~' || count || ' lines)' as meta, case when coalesce(diff, '') = '' then '  (no diff content available)' else diff end as shown from c_hunks left join (select doc_id, hunk_no, string_agg('+' || text, chr(10) order by line_no) as diff from c_hunk_lines join c_lines using (doc_id, line_no) group by all) using (doc_id, hunk_no)),
k(doc_id, i, whole, block, over_) as (select h.doc_id, cast(0 as bigint), head || coalesce(string_agg(chr(10) || chr(10) || meta || chr(10) || '  (diff omitted — over token budget)', '' order by d.i), ''), '', false from h left join d on d.doc_id = h.doc_id group by h.doc_id, head
  union all select doc_id, i, case when o then whole else tried end, meta || chr(10) || case when o then '  (diff omitted — over token budget)' else shown end, o from (select d.*, whole, tried, over_ or length(tried) > 600 as o from (select k.doc_id, k.i + 1 as j, k.whole, k.over_, replace(k.whole, d.meta || chr(10) || '  (diff omitted — over token budget)', d.meta || chr(10) || d.shown) as tried from k join d on d.doc_id = k.doc_id and d.i = k.i + 1) t join d on d.doc_id = t.doc_id and d.i = t.j)),
b as (select doc_id, arg_max(whole, i) as whole, count(*) filter (over_) as omitted from k group by doc_id),
t as (select doc_id, row_number() over (partition by doc_id order by min(sym_id)) as i, count(*) over (partition by doc_id) as n, 'T' || t || ' — p' || p || chr(10) || 'body ' || t as line from (select doc_id, sym_id // 3 % 5 as t, sym_id % 2 as p, sym_id from c_symbols where depth = 0) group by doc_id, t, p),
e(doc_id, i, n, said) as (select distinct doc_id, cast(0 as bigint), n, 'context — not part of the diff' from t union all select e.doc_id, t.i, e.n, said || chr(10) || chr(10) || line from e join t on t.doc_id = e.doc_id and t.i = e.i + 1 where length(said || chr(10) || chr(10) || line || case e.n - t.i when 0 then '' when 1 then chr(10) || chr(10) || '… (1 more definition omitted — over context budget)' else chr(10) || chr(10) || '… (' || (e.n - t.i) || ' more definitions omitted — over context budget)' end) <= 120),
s as (select doc_id, n - i as more, said || case n - i when 0 then '' when 1 then chr(10) || chr(10) || '… (1 more definition omitted — over context budget)' else chr(10) || chr(10) || '… (' || (n - i) || ' more definitions omitted — over context budget)' end as said from (select doc_id, any_value(n) as n, max(i) as i, arg_max(said, i) as said from e group by doc_id))
select h.path as section, whole || coalesce(chr(10) || chr(10) || said, '') as text, omitted, coalesce(more, 0) as definitions_omitted, cast(ceil(length(whole || coalesce(chr(10) || chr(10) || said, '')) / 4) as bigint) as tokens from h join b on b.doc_id = h.doc_id left join s on s.doc_id = h.doc_id""")
def tx8_prompt_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-8, OR-19: a file is a section, its hunks the chunks, its types the definitions; 150 tokens a section, and 30 of definitions on top."""
    f, none = corpus.files(spark, sf_dir), F.array().cast("array<string>")
    lists = imports.import_lists(imports.import_graph(_imports(spark, sf_dir), f)[0])
    sections = f.join(lists, ["range_id", "path"], "left").select(F.col("path").alias("section"), F.lit("impl").alias("role"), F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))
    h = corpus.hunks(spark, sf_dir)
    lines = chunking.changed_lines(h).join(corpus.file_lines(spark, sf_dir), ["doc_id", "line_no"]).groupBy("doc_id", "hunk_no").agg(F.array_sort(F.collect_list(F.struct("line_no", F.concat(F.lit("+"), "text").alias("t")))).alias("r"))
    diff = F.coalesce(F.array_join(F.transform("r", lambda x: x["t"]), "\n"), F.lit(""))
    c = h.join(lines, ["doc_id", "hunk_no"], "left").join(f.select("doc_id", F.col("path").alias("section")), "doc_id")
    c = c.select("section", F.col("hunk_no").alias("pos"), _s("hunk_no").alias("id"), F.concat(F.lit("hunk "), _s("hunk_no")).alias("title"), F.lit("other").alias("kind"), F.col("count").alias("lines"), diff.alias("diff"))
    d = corpus.symbols(spark, sf_dir).where("depth = 0").join(f.select("doc_id", F.col("path").alias("section")), "doc_id")
    d = d.select("section", F.col("sym_id").alias("pos"), F.concat(F.lit("p"), _s(F.col("sym_id") % 2)).alias("path"), "name", F.concat(F.lit("body "), F.expr("substring(name, 2)")).alias("body"))
    return book.prompt_inputs(sections, c, d, cap=150, definitions_cap=30)


# ---- runs (FR-13 to 15), polls (ST-8), deferrals and labels (AG-9, 10, 16)


@query("""with u as (select range_id, file_no as pos, case when doc_id % 5 = 0 then 'fresh' when doc_id % 7 = 0 then 'error' when range_id % 3 = 0 and file_no >= 30 then 'full' else 'ok' end as o from c_files), m as (select range_id, min(pos) as stop from u where o = 'full' group by range_id)
select range_id, count(*) as total, count(*) filter (r and o in ('fresh', 'ok')) as done, count(*) filter (r and o = 'ok') as computed, count(*) filter (r and o = 'fresh') as skipped, bool_or(stop is not null) as capped, case when bool_or(stop is not null) then count(*) - count(*) filter (r and o in ('fresh', 'ok')) else 0 end as capped_count from (select range_id, pos, o, stop, stop is null or pos < stop as r from u left join m using (range_id)) group by range_id""")
def fr13_fill_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-13: in every third range the store is full at the thirtieth file."""
    outcome = F.when(_id() % 5 == 0, "fresh").when(_id() % 7 == 0, "error").when((F.col("range_id") % 3 == 0) & (F.col("file_no") >= 30), "full").otherwise("ok")
    return freshness.fill_counters(corpus.files(spark, sf_dir).select("range_id", F.col("file_no").alias("pos"), outcome.alias("outcome")))


@query("select range_id || '/' || doc_id % 8 as section, any_value(doc_id % 8) <> 3 and count(*) filter (doc_id % 10 not in (5, 6, 7)) > 0 as narratable from c_files group by range_id, doc_id % 8")
def fr14_narratable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-14: files by id; section 3 of a range holds its leftovers."""
    section = F.concat_ws("/", _s("range_id"), _s(_id() % 8))
    return freshness.narratable_sections(corpus.files(spark, sf_dir).select(section.alias("section"), (_id() % 8 == 3).alias("leftover"), (_id() % 10).isin(5, 6, 7).alias("low_signal")))


@query("select o_orderkey, o_orderstatus <> 'P' and o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 and md5(o_custkey::varchar) not in (select md5(c_custkey::varchar) from customer where c_acctbal < 0) as run from orders")
def fr15_auto_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-15: an order's book has its customer's fingerprint; those of customers in debt have failed before."""
    k, digest = F.col("o_orderkey"), lambda c: F.md5(_s(c)).alias("fingerprint")
    bad = corpus.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(digest("c_custkey"), F.lit(True).alias("failed")).distinct()
    d = corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", digest("o_custkey")).join(bad, "fingerprint", "left")
    return d.select("o_orderkey", freshness.auto_run(F.col("o_orderstatus") != "P", k % 3 == 0, k % 5 == 0, F.coalesce("failed", F.lit(False))).alias("run"))


@query("select user_id as key, case when m is null then null when epoch_us(n) - epoch_us(m) < 30000000 then 3000 else 8000 end as poll_ms from (select user_id, max(ts) filter (event_type in ('view', 'click')) as m, max(ts) + interval (any_value(user_id % 3) * 20) second as n from events group by user_id)")
def st8_poll_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-8: views and clicks are pending; now is up to 40 s after a user's last event."""
    now = F.max(F.col("ts") + F.make_dt_interval(secs=F.col("user_id") % 3 * 20))
    return state.poll_intervals(corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "user_id", "ts", F.col("event_type").isin("view", "click").alias("pending"), F.col("ts").alias("created")), now)


def _deferrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, i = F.col("event_type"), F.col("event_id")
    status = F.when(kind == "view", "done").when(kind == "click", "failed").when(kind == "error", "running")
    return corpus.events(spark, sf_dir).select(F.col("user_id").alias("key"), i.alias("seq"), F.col("k").alias("chunk_id"), (i % 5 == 0).alias("inline"), (i % 2 == 0).alias("ai"), status.alias("status"), F.when(i % 3 == 0, F.concat(F.lit("L"), _s(i))).alias("line_range"))


@query("""with g as (select user_id as key, count(distinct k) filter (event_id % 5 > 0) as deferred, count(*) filter (event_id % 5 > 0 and event_id % 2 = 0 and event_type = 'view') as ready, count(*) filter (event_id % 5 > 0 and event_id % 2 = 0 and event_type not in ('view', 'click')) as answering, count(*) filter (event_id % 5 > 0 and event_id % 2 = 0 and event_type = 'click') as failed, count(*) filter (event_id % 2 = 0 and event_type not in ('view', 'click')) as arriving from c_events group by user_id)
select *, case when deferred = 0 then '' else deferred || ' deferred' || case when ready = 1 then ' · 1 answer ready' when ready > 1 then ' · ' || ready || ' answers ready' when failed = 0 and answering > 0 then ' · ' || answering || ' answering' else '' end || case when failed > 0 then ' · ' || failed || ' failed' else '' end end as text from g""")
def ag9_deferral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.deferral_clusters(_deferrals(spark, sf_dir))


@query("select key, chunk_id, row_number() over (partition by key order by first) as place, n, first_range from (select user_id as key, k as chunk_id, min(event_id) as first, count(*) as n, arg_min('L' || event_id, event_id) filter (event_id % 3 = 0) as first_range from c_events where event_id % 5 > 0 group by all)")
def ag10_deferred_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.deferred_chunks(_deferrals(spark, sf_dir))


@query("""with e as (select source, doc_id, doc_id % 11 = 0 as missing, doc_id % 11 > 0 and doc_id % 7 > 0 as narrated, case when doc_id % 5 = 0 then 1 else 0 end + case when doc_id % 5 = 1 then 1 else 0 end as checks from documents where doc_id % 4 > 0),
j as (select e.*, l.doc_id is not null as answered, case when quality = 0 and e.doc_id % 6 = 0 then null when l.doc_id is not null then 1 + e.doc_id % 5 end as register, 1 + e.doc_id // 5 % 5 as grounding, toxic from e left join labels l using (doc_id))
select *, flags = 0 and judged > 0 as floor_met from (select source, count(*) filter (narrated) as narrated, count(*) filter (missing) as missing, count(*) filter (not missing and not narrated) as stale, coalesce(sum(checks) filter (narrated), 0) as gate_failures, count(*) filter (narrated and register is not null) as judged, count(*) filter (narrated and answered and register is null) as invalid,
 median(register) filter (narrated and register is not null) as register, median(grounding) filter (narrated and register is not null) as grounding, count(*) filter (narrated and register is not null and toxic = 1) as flags from j group by source)""")
def ag16_label_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-16, by source: every fourth document has no label, every fifth a banned line or a placeholder badge, every seventh a stale fingerprint; every eleventh is gone."""
    d = corpus.table(spark, sf_dir, "documents").select("source", "doc_id")
    has = _id() % 4 > 0
    entries = d.select("source", _id().alias("id"), F.when(has, F.when(_id() % 5 == 1, "misc").otherwise("Reads rows")).alias("badge"), F.when(has, F.when(_id() % 5 == 0, "simply reads rows").otherwise("reads rows")).alias("line"), F.when(_id() % 7 == 0, "b").otherwise("a").alias("fingerprint"))
    live = d.where("doc_id % 11 > 0").select(_id().alias("id"), F.lit("a").alias("expected"))
    none = (F.col("quality") == 0) & (_id() % 6 == 0)
    results = corpus.table(spark, sf_dir, "labels").select(_id().alias("id"), F.when(none, None).otherwise(1 + _id() % 5).alias("register"), F.when(none, None).otherwise(1 + F.expr("doc_id div 5") % 5).alias("grounding"), F.when(F.col("toxic") == 1, "FLAG").otherwise("OK").alias("faithfulness"))
    return evaluation.label_eval(entries, live, results, ["source"])
