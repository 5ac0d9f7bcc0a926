"""All registered queries of the change-review operators and their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from difflens.functions import paths, text
from difflens.operators import chunking, evaluation, freshness, graph, imports, ordering, rendering
from difflens.sources import corpus, readers
from difflens.streaming import state

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) as a query, with its DuckDB twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            used = _used(sql)
            tables = ", ".join(FIXTURE[n] for n in FIXTURE if n in used)
            more = f", {sql[5:]}" if sql.startswith("with ") else f" {sql}"
            SQL[f.__name__] = f"with recursive {tables}{more}" if tables else sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# The corpus of difflens/sources/corpus.py in DuckDB SQL; a query takes what it names, and what that names.
FIXTURE = {
    "c_files": """c_files as (select doc_id // 40 as range_id, doc_id % 40 as file_no, doc_id, case doc_id % 10 when 0 then 'src/routes/p' || doc_id || '.ts' when 1 then 'src/lib/m' || doc_id || '.ts'
 when 2 then 'src/lib/m' || (doc_id - 1) || '.test.ts' when 3 then 'src/Api/S' || doc_id || '.cs' when 4 then 'tests/e2e/j' || doc_id || '.spec.ts' when 5 then 'generated-types/t' || doc_id || '.ts'
 when 6 then 'locales/fr' || doc_id || '.po' when 7 then 'pkg' || doc_id || '/pnpm-lock.yaml' when 8 then 'src/lib/c' || doc_id || '.svelte' else 'conf/c' || doc_id || '.json' end as path,
 case when doc_id % 17 = 0 then 'deleted' when doc_id % 13 = 0 then 'added' when doc_id % 11 = 0 then 'renamed' else 'modified' end as status from documents)""",
    "c_lines": """c_lines as (select doc_id, line_no, case when (doc_id + line_no // 6) % 9 = 0 then '' else raw end as text from (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents))""",
    "c_changed": """c_changed as (select doc_id, line_no from c_lines where (line_no + doc_id) % 11 < 6)""",
    "c_islands": """c_islands as (select doc_id, min(line_no) as start, count(*) as count from (select *, line_no - row_number() over (partition by doc_id order by line_no) as g from c_changed) group by doc_id, g)""",
    "c_hunks": """c_hunks as (select doc_id, row_number() over (partition by doc_id order by start, count) as hunk_no, start, count from (select * from c_islands union all select doc_id, line_no, 0 from c_lines where (line_no + doc_id) % 11 = 8))""",
    "c_hunks2": """c_hunks2 as (select *, case when count = 0 then 1 else (hunk_no + doc_id) % 3 end as other_count from c_hunks)""",
    "c_hunk_lines": """c_hunk_lines as (select doc_id, hunk_no, unnest(range(start, start + count)) as line_no from c_hunks where count > 0)""",
    "c_blocks": """c_blocks as (select doc_id, unnest(range(0, n // 12 + 1)) as k from (select doc_id, max(line_no) as n from c_lines group by doc_id))""",
    "c_symbols": """c_symbols as (select doc_id, k * 3 as sym_id, 0 as depth, 'type' as kind, 12 * k + 1 as a, 12 * k + 11 as b from c_blocks union all select doc_id, k * 3 + 1, 1, 'function', 12 * k + 2, 12 * k + 5 from c_blocks union all select doc_id, k * 3 + 2, 1, 'function', 12 * k + 7, 12 * k + 10 from c_blocks)""",
    "c_at": """c_at as (select l.doc_id, l.hunk_no, l.line_no, arg_max(s.sym_id, s.depth) as sym_id, arg_max(s.kind, s.depth) as sym_kind from c_hunk_lines l left join c_symbols s on s.doc_id = l.doc_id and l.line_no between s.a and s.b group by all)""",
    "c_anchor": """c_anchor as (select h.doc_id, h.hunk_no, 1 as part_no, arg_max(s.sym_id, s.depth) as sym_id, arg_max(s.kind, s.depth) as sym_kind, h.start, 0 as count from c_hunks h left join c_symbols s on s.doc_id = h.doc_id and h.start between s.a and s.b where h.count = 0 group by h.doc_id, h.hunk_no, h.start)""",
    "c_runs": """c_runs as (select *, sum(new) over (partition by doc_id, hunk_no order by line_no) as part_no from (select *, case when row_number() over w = 1 or sym_id is distinct from lag(sym_id) over w then 1 else 0 end as new from c_at window w as (partition by doc_id, hunk_no order by line_no)))""",
    "c_parts": """c_parts as (select p.doc_id, p.hunk_no, p.part_no, p.sym_id, p.sym_kind, p.start, p.count, case when p.part_no = 1 then h.other_count else 0 end as other_count from (select doc_id, hunk_no, part_no, any_value(sym_id) as sym_id, any_value(sym_kind) as sym_kind, min(line_no) as start, count(*) as count from c_runs group by doc_id, hunk_no, part_no union all select * from c_anchor) p join c_hunks2 h using (doc_id, hunk_no))""",
    "c_edges": """c_edges as (select l_orderkey as range_id, l_partkey % 8 as src, l_suppkey % 8 as dst, case l_returnflag when 'A' then 'calls' when 'N' then 'exercises' else 'file-imports' end as kind, case l_linestatus when 'O' then 'references' else 'test-anchor' end as source, l_linenumber as line from lineitem)""",
    "c_dist": """c_dist as (select distinct range_id, src, dst from c_edges where src <> dst)""",
    "c_reach": """c_reach as (select range_id, src, dst from c_dist union select r.range_id, r.src, e.dst from c_reach r join c_dist e on e.range_id = r.range_id and e.src = r.dst)""",
    "c_scc": """c_scc as (select a.range_id, a.src as node, least(min(a.dst), a.src) as scc from c_reach a join c_reach b on a.range_id = b.range_id and a.src = b.dst and a.dst = b.src group by a.range_id, a.src)""",
    "c_events": """c_events as (select *, cast(json_extract_string(props, '$.k') as int) as k from events)""",
    "c_patches": """c_patches as (select user_id % 20 as range_id, k as chunk_id, event_id as seq, case event_type when 'view' then 'seen' when 'click' then 'reviewed' when 'signup' then 'bogus' end as state, case when event_type = 'purchase' then true end as auto_read, case when event_type = 'error' then event_id % 2 = 0 end as expanded, case when event_type = 'click' then case event_id % 3 when 0 then 'explicit' when 1 then 'auto' else 'bad' end end as reviewed_via from c_events)""",
    "c_state": """c_state as (select range_id, chunk_id, arg_max(state, seq) filter (state is not null) as state, arg_max(auto_read, seq) filter (auto_read is not null) as auto_read, arg_max(expanded, seq) filter (expanded is not null) as expanded, arg_max(reviewed_via, seq) filter (reviewed_via in ('explicit', 'auto')) as reviewed_via from c_patches where state is null or state in ('unseen', 'seen', 'reviewed') group by all)""",
}


def _used(sql: str) -> set[str]:
    """The corpus tables that a query names, and those that these name."""
    found, todo = set(), [sql]
    while todo:
        named = set(re.findall(r"\w+", todo.pop())) & FIXTURE.keys() - found
        found |= named
        todo += [FIXTURE[n].split(" as ", 1)[1] for n in named]
    return found


# ---- paths, classes, texts (SC-*, TX-*)


@query(r"""select path, regexp_extract(path, '[^/]*$') as base, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as dir,
lower(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1')) as stem, regexp_replace(path, '(\.(ts|tsx|js|jsx|mjs|cjs|svelte))+$', '') as stripped,
regexp_matches(path, '(?i)(^|/)(tests?|__tests__)/') or regexp_matches(regexp_extract(path, '[^/]*$'), '\.(test|spec)\.|Tests?\.cs$') as test,
regexp_matches(path, '(?i)(^|/)(e2e|playwright)/') as e2e, regexp_matches(path, '(^|/)(routes|pages)/') as route, regexp_extract(path, '\.([^.]*)$', 1) in ('json', 'yaml') as config from c_files""")
def sc_path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-2, 3, 4, 5, 11, 12."""
    p = F.col("path")
    return corpus.files(spark, sf_dir).select("path", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.stem(p).alias("stem"), paths.strip_code_extensions(p).alias("stripped"), paths.is_test(p).alias("test"), paths.is_e2e(p).alias("e2e"), paths.is_route(p).alias("route"), paths.is_config(p).alias("config"))


@query(r"""select path, case when path like '%pnpm-lock.yaml' then 'lockfile' when path like '%.po' then 'translations' when path like 'generated-types/%' then 'generated' when regexp_matches(lower(h), '<auto-generated|@generated|\bgenerated by\b|do not edit') then 'generated' end as reason
from c_files join (select doc_id, string_agg(text, chr(10) order by line_no) as h from c_lines where line_no <= 5 group by doc_id) using (doc_id)""")
def sc1_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = corpus.file_lines(spark, sf_dir).where("line_no <= 5").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"))
    head = head.select("doc_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("h"))
    return corpus.files(spark, sf_dir).join(head, "doc_id").select("path", paths.generated_reason(F.col("path"), F.col("h")).alias("reason"))


@query(r"""select page_id, case when page_id % 2 = 0 then 'https://h/x/pull/' || page_id || '/files' end as files_url, array_to_string(list_filter([case when page_id % 3 = 0 then 'a' end, case when page_id % 5 = 0 then 'b' end, 'c'], lambda x: x is not null), '/') as plain,
case when length(f) > 42 then substr(f, 1, 42) || '…' else f end as preview, cast(ceil(length(html) / 4) as bigint) as tokens from (select *, trim(regexp_replace(html, '\s+', ' ', 'g')) as f from pages)""")
def sc_links_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-9, SC-11, SC-16, SC-18."""
    d, i = corpus.table(spark, sf_dir, "pages"), F.col("page_id")
    url = F.when(i % 2 == 0, F.concat(F.lit("https://h/x/pull/"), i.cast("string"), F.when(i % 4 == 0, "/").otherwise(""))).otherwise(F.col("url"))
    messy = F.concat(F.when(i % 3 == 0, "./a/").otherwise("../"), F.when(i % 5 == 0, "b/./").otherwise("z/../"), F.lit("c"))
    return d.select("page_id", paths.files_changed_url(url).alias("files_url"), paths.normalize(messy).alias("plain"), text.preview(F.col("html")).alias("preview"), text.token_estimate(F.col("html")).cast("long").alias("tokens"))


@query(r"""with t as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) || case (conv_id + turn) % 9 when 0 then ' simply' when 1 then ' looks good' when 2 then ' simplify' else '' end as t, case turn % 3 when 0 then 'opener' when 1 then 'section' else 'chunk' end as kind from conversations),
s as (select *, list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') as s from t),
m as (select *, coalesce(list_max(list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')))), 0) as longest, regexp_matches(t, '(?i)\b(as expected|clean refactor|correctly|elegant|just a|looks good|no issues|perfect|safe to|simply|trivial)\b') as bad from s)
select conv_id, turn, kind, list_filter([case when length(t) > case kind when 'opener' then 320 when 'section' then 200 else 110 end then 'chars' end, case when len(s) > case kind when 'opener' then 3 when 'section' then 2 else 1 end then 'sentences' end, case when kind <> 'chunk' and longest > 22 then 'long-sentence' end, case when bad then 'banned' end], lambda x: x is not null) as failures,
list_filter([case when t = '' then 'blank' end, case when length(t) > 340 then 'chars' end, case when len(s) > 3 then 'sentences' end, case when longest > 22 then 'long-sentence' end, case when bad then 'banned' end], lambda x: x is not null) as note_failures from m""")
def tx_register_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-1, TX-2."""
    d, n = corpus.table(spark, sf_dir, "conversations"), (F.col("conv_id") + F.col("turn")) % 9
    t = F.concat(F.trim(F.regexp_replace("text", r"\s+", " ")), F.when(n == 0, " simply").when(n == 1, " looks good").when(n == 2, " simplify").otherwise(""))
    d = d.select("conv_id", "turn", t.alias("t"), F.when(F.col("turn") % 3 == 0, "opener").when(F.col("turn") % 3 == 1, "section").otherwise("chunk").alias("kind"))
    return d.select("conv_id", "turn", "kind", text.register_failures(F.col("t"), F.col("kind")).alias("failures"), text.review_note_failures(F.col("t")).alias("note_failures"))


@query(r"""with b as (select conv_id, turn, array_to_string((list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))[1 : (conv_id % 5) + 1], ' ') as raw from conversations), t as (select conv_id, turn, case when turn % 3 = 0 then translate(raw, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') else raw end as t from b)
select conv_id, turn, list_filter([case when t = '' then 'blank' end, case when lower(t) in ('misc', 'n/a', 'na', 'no change', 'none', 'nothing', 'other') then 'placeholder' end, case when length(t) > 30 then 'chars' end, case when len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) > 4 then 'words' end, case when t <> '' and not regexp_matches(t, '^[A-Z]') then 'case' end, case when len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: regexp_matches(x, '^[A-Z]{6,}$'))) > 0 then 'shout' end], lambda x: x is not null) as failures from t""")
def tx3_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "conversations")
    raw = F.array_join(F.slice(text.words(F.col("text")), F.lit(1), (F.col("conv_id") % 5 + 1).cast("int")), " ")
    return d.select("conv_id", "turn", text.badge_failures(F.when(F.col("turn") % 3 == 0, F.translate(raw, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(raw)).alias("failures"))


@query(r"""with w as (select doc_id, list_filter(list_transform(regexp_split_to_array(t, '\s+'), lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: x <> '') as w, len(list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '')) as s from (select doc_id, text as t from documents))
select doc_id, case when len(w) > 0 then round(206.835 - 1.015 * (len(w) / greatest(s, 1)) - 84.6 * (list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(regexp_replace(x, 'e$', ''), '[aeiouy]+'))))) / len(w)), 6) end as score from w""")
def tx4_flesch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", text.flesch(F.col("text")).alias("score"))


# ---- chunking (CH-*)


@query("select doc_id, hunk_no, part_no, sym_id, sym_kind, start, count, other_count from c_parts")
def ch3_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-1, 2, 3, 4."""
    return chunking.parts(corpus.hunks(spark, sf_dir), corpus.symbols(spark, sf_dir))


@query("""select doc_id, sym_id, sum(count) as n_lines, min(start) filter (count > 0) as start, max(start + count - 1) filter (count > 0) as "end", count(*) as n_parts from c_parts group by doc_id, sym_id""")
def ch5_symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-5, 11, 13: without a cap, one chunk a symbol."""
    return chunking.chunks(chunking.parts(corpus.hunks(spark, sf_dir), corpus.symbols(spark, sf_dir)), cap=1 << 30).select("doc_id", "sym_id", "n_lines", "start", "end", "n_parts")


@query()
def ch7_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-6, CH-7: parts over four lines cut, then greedy buckets of at most four lines; tests compare it with a loop too."""
    return chunking.chunks(chunking.parts(corpus.hunks(spark, sf_dir), corpus.symbols(spark, sf_dir)), cap=4, lines=corpus.file_lines(spark, sf_dir))


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of lines, some missing and some twice on purpose."""
    lines = chunking.changed_lines(corpus.hunks(spark, sf_dir)).select("doc_id", "line_no")
    return lines.where("(doc_id + line_no) % 7 <> 0").unionByName(lines.where("(doc_id + line_no) % 13 = 0"))


_OWNED = "(select * from c_hunk_lines where (doc_id + line_no) % 7 <> 0 union all select * from c_hunk_lines where (doc_id + line_no) % 13 = 0)"


@query(f"select e.doc_id, e.line_no, coalesce(n, 0) as owners from (select distinct doc_id, line_no from c_hunk_lines) e left join (select doc_id, line_no, count(*) as n from {_OWNED} group by all) o using (doc_id, line_no) where coalesce(n, 0) <> 1")
def ch14_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.coverage(chunking.changed_lines(corpus.hunks(spark, sf_dir)), _owned(spark, sf_dir))


@query("select range_id, count(*) as expected, count(*) filter (owners = 1) as covered, bool_and(coalesce(owners = 1, false)) as ok from c_hunk_lines join c_files using (doc_id) left join (select doc_id, line_no, count(*) as owners from (select doc_id, unnest(range(start, start + count)) as line_no from c_parts where count > 0) group by all) o using (doc_id, line_no) group by range_id")
def ch14_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the parts of every range own each changed line exactly once."""
    h = corpus.hunks(spark, sf_dir)
    p = chunking.parts(h, corpus.symbols(spark, sf_dir)).where("count > 0")
    owned = p.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("line_no")).groupBy("doc_id", "line_no").agg(F.count("*").alias("owners"))
    lines = chunking.changed_lines(h).join(chunking.by_merge(owned), ["doc_id", "line_no"], "left").join(corpus.files(spark, sf_dir), "doc_id")
    return lines.groupBy("range_id").agg(F.count("*").alias("expected"), F.count_if(F.col("owners") == 1).alias("covered")).withColumn("ok", F.col("expected") == F.col("covered"))


@query("""select doc_id, min(line_no) as start, max(line_no) as "end" from (select *, line_no - row_number() over (partition by doc_id order by line_no) as g from (select distinct doc_id, line_no from c_hunk_lines where (doc_id + line_no) % 7 = 0 and (doc_id + line_no) % 13 <> 0)) group by doc_id, g""")
def ch15_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.leftovers(chunking.changed_lines(corpus.hunks(spark, sf_dir)), _owned(spark, sf_dir))


@query("select doc_id, hunk_no, count(*) as n_lines, bool_and(trim(text) = '') as whitespace_only from c_hunk_lines join c_lines using (doc_id, line_no) group by all")
def ch9_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.whitespace_only(corpus.hunks(spark, sf_dir), corpus.file_lines(spark, sf_dir))


_BOTH = """b as (select doc_id, hunk_no, 0 as part, case when doc_id % 17 = 0 then 'base' else 'head' end as side, line_no from c_hunk_lines
  union all select doc_id, hunk_no, 1, 'base', unnest(range(start, start + other_count)) from c_hunks2 where doc_id % 17 > 0),
t as (select b.*, coalesce(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), '') as t from b left join c_sides using (doc_id, side, line_no))"""
FIXTURE["c_sides"] = "c_sides as (select doc_id, 'head' as side, line_no, text from c_lines union all select doc_id, 'base', line_no, case when (doc_id + line_no) % 3 = 0 then '~' || text else text end from c_lines)"


def _typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, i = corpus.files(spark, sf_dir), F.col("doc_id")
    return f.select("doc_id", (F.col("status") == "deleted").alias("deleted"), (i % 29 == 0).alias("submodule"), F.when(i % 23 == 0, "lockfile").alias("generated_reason"))


@query(f"with {_BOTH} select doc_id, hunk_no, count(*) as n_lines, case when max(doc_id) % 23 = 0 then 'generated' when bool_and(t = '') and max(doc_id) % 29 > 0 then 'whitespace' end as change_type from t group by doc_id, hunk_no")
def ch9_change_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-9: both sides' lines, files with a reason, submodules."""
    return chunking.change_types(corpus.hunks(spark, sf_dir), corpus.sides(spark, sf_dir), _typed_files(spark, sf_dir))


@query(f"with {_BOTH} select doc_id, hunk_no, md5(string_agg(t, chr(10) order by part, line_no)) as fingerprint from t group by all")
def ch10_side_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-10: head lines, then base lines."""
    return chunking.side_fingerprints(corpus.hunks(spark, sf_dir), corpus.sides(spark, sf_dir), _typed_files(spark, sf_dir), F.md5)


@query("select doc_id, hunk_no, md5(string_agg(trim(text), chr(10) order by line_no)) as fingerprint from c_hunk_lines join c_lines using (doc_id, line_no) group by all")
def ch10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fingerprints(corpus.hunks(spark, sf_dir), corpus.file_lines(spark, sf_dir), F.md5)


# ---- imports (JN-*)


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifiers to the file one and three further on, some bare package names, some aliases."""
    f = corpus.files(spark, sf_dir).where(F.col("path").rlike(paths.CODE_EXTENSION))
    to = corpus.files(spark, sf_dir).select("range_id", F.col("file_no").alias("to_no"), F.col("path").alias("to_path"))
    d = f.select("range_id", "path", "doc_id", "file_no", F.explode(F.array(F.lit(1), F.lit(3), F.lit(-2))).alias("step"))
    j = d.join(to, (d.range_id == to.range_id) & (d.file_no + d.step == to.to_no)).drop(to.range_id)
    up = F.repeat(F.lit("../"), F.size(F.split("path", "/")) - 1)
    spec = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("pkg"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("$x/"), paths.strip_code_extensions(F.col("to_path")))).otherwise(F.concat(F.lit("./"), up, paths.strip_code_extensions(F.col("to_path"))))
    return j.select("range_id", "path", spec.alias("specifier"))


_IMPORTS = r"""(select f.range_id, f.path, f.doc_id, t.path as to_path, regexp_replace(t.path, '(\.(ts|tsx|js|jsx|mjs|cjs|svelte))+$', '') as bare from (select *, unnest([1, 3, -2]) as step from c_files where regexp_matches(path, '(\.(ts|tsx|js|jsx|mjs|cjs|svelte))+$')) f join c_files t on t.range_id = f.range_id and t.file_no = f.file_no + f.step)"""
_TRIES = "['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.svelte']"
_RESOLVED = rf"""(select range_id, path, bare, doc_id, target from (select i.*, k.path as target, row_number() over (partition by i.range_id, i.path, i.bare, i.doc_id order by i.r) as n from (select distinct range_id, path, bare, doc_id, bare || unnest({_TRIES}) as try, unnest(range(8)) as r from {_IMPORTS} where doc_id % 7 <> 0 and doc_id % 5 <> 0) i join (select distinct range_id, path from c_files) k on k.range_id = i.range_id and k.path = i.try) where n = 1
union all select range_id, path, bare, doc_id, min(target) from (select distinct i.range_id, i.path, i.bare, i.doc_id, k.path as target from {_IMPORTS} i join c_files k on k.range_id = i.range_id and ('/' || regexp_replace(k.path, '(\.(ts|tsx|js|jsx|mjs|cjs|svelte))+$', '')) like ('%/' || i.bare) where i.doc_id % 7 <> 0 and i.doc_id % 5 = 0 and contains(i.bare, '/')) group by all having count(*) = 1)"""


@query(f"select distinct range_id, path as src, target as dst from {_RESOLVED} where path <> target")
def jn_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-2, 3, 5."""
    return imports.import_graph(_imports(spark, sf_dir), corpus.files(spark, sf_dir))[0]


@query(f"select i.range_id, count(*) as unresolved from {_IMPORTS} i left join (select distinct range_id, path, bare, doc_id from {_RESOLVED}) r on r.range_id = i.range_id and r.path = i.path and r.bare = i.bare and r.doc_id = i.doc_id where r.path is null group by all")
def jn5_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.import_graph(_imports(spark, sf_dir), corpus.files(spark, sf_dir))[1]


@query(f"select coalesce(a.range_id, b.range_id) as range_id, coalesce(a.path, b.path) as path, coalesce(imports, []) as imports, coalesce(imported_by, []) as imported_by from (select range_id, src as path, list(dst order by dst) as imports from (select distinct range_id, path as src, target as dst from {_RESOLVED} where path <> target) group by all) a full join (select range_id, dst as path, list(src order by src) as imported_by from (select distinct range_id, path as src, target as dst from {_RESOLVED} where path <> target) group by all) b on a.range_id = b.range_id and a.path = b.path")
def jn6_import_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.import_lists(imports.import_graph(_imports(spark, sf_dir), corpus.files(spark, sf_dir))[0])


# ---- graphs (GR-*, OR-12)


@query("""select range_id, src, dst, kind, min(source) as source, count(*) as n_ranges from (select range_id, src, dst, kind, source_ as source, g from (select *, line - row_number() over (partition by range_id, src, dst, kind order by line) as g, min(source) over (partition by range_id, src, dst, kind) as source_ from (select range_id, src, dst, kind, line, min(source) as source from c_edges where src <> dst group by all)) group by all) group by range_id, src, dst, kind""")
def gr1_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-1, 2."""
    return graph.assemble(corpus.edges(spark, sf_dir))


@query("select range_id, src as node, dst as other, kind, 'out' as direction from (select distinct range_id, src, dst, kind from c_edges where src <> dst) union all select range_id, dst, src, kind, 'in' from (select distinct range_id, src, dst, kind from c_edges where src <> dst)")
def gr3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(corpus.edges(spark, sf_dir))


@query("select * from c_reach")
def gr5_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(corpus.edges(spark, sf_dir))


@query("select range_id, node, scc from c_scc")
def gr6_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong(corpus.edges(spark, sf_dir))


@query("select range_id, scc, min(node) as first_node from c_scc where (range_id, scc) not in (select e.range_id, b.scc from c_dist e join c_scc b on b.range_id = e.range_id and b.node = e.dst left join c_scc a on a.range_id = e.range_id and a.node = e.src where a.scc is null or a.scc <> b.scc) group by all")
def gr7_source_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.edges(spark, sf_dir)
    return graph.source_cycles(e, graph.strong(e))


@query("select e.range_id, e.src, e.dst, case when r.src is null then 'inversion' else 'cycle' end as category from c_dist e left join c_reach r on r.range_id = e.range_id and r.src = e.dst and r.dst = e.src where e.src < e.dst")
def or12_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR-12."""
    e = corpus.edges(spark, sf_dir)
    return graph.order_check(e, graph.strong(e))


@query("select e.range_id, count(*) as interactions, count(*) filter ((e.src % 3 = 0) <> (e.dst % 3 = 0)) as frontier from (select distinct range_id, src, dst, kind from c_edges where src <> dst and kind in ('calls', 'exercises')) e group by e.range_id")
def gr10_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-10, 11: every third node is reviewed."""
    e = corpus.edges(spark, sf_dir)
    nodes = e.select("range_id", F.col("src").alias("node")).union(e.select("range_id", "dst")).distinct().where("node % 3 = 0")
    return graph.frontier(e, nodes)


@query("select range_id, node, count(*) filter (other < node) as glances from (select range_id, src as node, dst as other from c_dist union select range_id, dst, src from c_dist) group by all")
def gr13_free_glances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.free_glances(corpus.edges(spark, sf_dir))


@query("""select range_id, count(*) as n, min(glances) as least, round(quantile_cont(glances, 0.5), 6) as median, round(quantile_cont(glances, 0.9), 6) as p90, max(glances) as most, round(avg(glances), 6) as mean, round(count(*) filter (glances > 0) / count(*), 6) as share from (select range_id, node, count(*) filter (q.at_ < p.at_) as glances from (select range_id, node, min(at_) as at_ from (select range_id, src as node, 10 * line + src as at_ from c_edges union all select range_id, dst, 100 + 10 * line + dst from c_edges) group by all) p
left join (select range_id, src as node, dst as other from c_dist union select range_id, dst, src from c_dist) n using (range_id, node) left join (select range_id, node as other, min(at_) as at_ from (select range_id, src as node, 10 * line + src as at_ from c_edges union all select range_id, dst, 100 + 10 * line + dst from c_edges) group by all) q using (range_id, other) group by range_id, node) group by range_id""")
def gr13_glance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-13: a chunk occurs with each line of its edges, targets a hundred later than sources; its first occurrence counts."""
    e = corpus.edges(spark, sf_dir)
    places = e.select("range_id", F.explode(F.array(F.struct(F.col("src").alias("node"), (10 * F.col("line") + F.col("src")).alias("pos")), F.struct(F.col("dst").alias("node"), (100 + 10 * F.col("line") + F.col("dst")).alias("pos")))).alias("at"))
    return graph.glance_summary(e, places.select("range_id", "at.node", "at.pos"))


@query("select event_id, case when h <= 0 then 0 else round(greatest(least(least(t + h, v + 30) - greatest(t, v), h), 0) / h, 6) end as fraction, h > 0 and least(t + h, v + 30) - greatest(t, v) >= 0.6 * h as visible from (select event_id, cast(event_id % 90 as double) as t, cast(user_id % 50 - 5 as double) as h, cast(event_id // 7 % 60 as double) as v from events)")
def sc22_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-22: rows of many heights, some of none, in a view of thirty."""
    e, number = corpus.table(spark, sf_dir, "events"), lambda c: F.expr(c).cast("double")
    top, view = number("event_id % 90"), number("event_id div 7 % 60")
    seen = state.visible_fraction(top, top + number("user_id % 50 - 5"), view, view + 30)
    return e.select("event_id", F.round(seen, 6).alias("fraction"), (seen >= state.MIN_VISIBLE).alias("visible"))


@query("select kind, range_id, src, dst from (select *, row_number() over (partition by kind order by md5('s|' || range_id || '|' || src || '|' || dst)) as r from (select distinct kind, range_id, src, dst from c_edges where src <> dst)) where r <= 30")
def gr14_edge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_sample(corpus.edges(spark, sf_dir))


# ---- order, budgets, sets (OR-*, SE-*)


@query("select range_id, file_no, row_number() over w as piece, count(*) over (partition by range_id) as pieces, lag(file_no) over w as previous, lead(file_no) over w as next from c_files window w as (partition by range_id order by file_no)")
def or14_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR-10, 14, 15."""
    return ordering.piece_index(corpus.files(spark, sf_dir).select("range_id", "file_no"), ["range_id"], ["file_no"])


@query("select range_id, doc_id, sum(length(text)) over (partition by range_id order by doc_id) <= 20000 as kept from c_files join (select doc_id, text from documents) using (doc_id)")
def or19_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 40).alias("range_id"), "doc_id", F.length("text").alias("n"))
    return ordering.prefix_budget(d, "range_id", "doc_id", "n", 20000).drop("n")


@query("""with b as (select range_id, file_no as pos, doc_id % 3 = 0 as done, count(*) over (partition by range_id) as n, range_id % 7 as cur from c_files)
select range_id, arg_min(pos, (pos - cur - 1 + n) % n) as forward, arg_max(pos, (pos - cur - 1 + n) % n - case when pos = cur then n else 0 end) as back from b where not done group by all""")
def or17_next_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    book = f.select("range_id", F.col("file_no").alias("pos"), (F.col("doc_id") % 3 == 0).alias("reviewed"))
    return ordering.next_unreviewed(book, f.select("range_id", (F.col("range_id") % 7).cast("int").alias("at")).distinct())


def _overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sections and a proposed reverse order of them: a key dropped in some ranges, a stale fingerprint in others."""
    f = corpus.files(spark, sf_dir).select("range_id", F.col("path").alias("key"), "file_no")
    last = F.max("file_no").over(Window.partitionBy("range_id"))
    sections = f.select("range_id", "key", F.col("file_no").alias("pos"), F.md5(F.col("range_id").cast("string")).alias("fingerprint"))
    proposed = f.select("range_id", "key", "file_no", (last - F.col("file_no")).alias("new_pos"), F.when(F.col("range_id") % 3 == 2, "stale").otherwise(F.md5(F.col("range_id").cast("string"))).alias("seen"))
    return sections, proposed.where("not (range_id % 3 = 1 and file_no = 0)").drop("file_no")


@query("select range_id, path as key, case when range_id % 3 = 0 then max(file_no) over (partition by range_id) - file_no else file_no end as position from c_files")
def fr6_apply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE-1, FR-5, FR-6."""
    sections, overlay = _overlay(spark, sf_dir)
    return ordering.apply_permutation(sections, overlay, ordering.permutation_check(sections, overlay))


@query("select range_id, case when range_id % 3 = 1 then list(path order by path) filter (file_no = 0) else [] end as missing, cast([] as varchar[]) as unknown, cast([] as varchar[]) as duplicated from c_files group by range_id")
def se1_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.permutation_check(*_overlay(spark, sf_dir))


@query("(select user_id, event_type, 'left' as side from events where event_id % 2 = 0 except all select user_id, event_type, 'left' from events where event_id % 2 = 1) union all (select user_id, event_type, 'right' as side from events where event_id % 2 = 1 except all select user_id, event_type, 'right' from events where event_id % 2 = 0)")
def se3_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    half = lambda r: e.where(F.col("event_id") % 2 == r).select("user_id", "event_type")
    return ordering.multiset_diff(half(0), half(1))


# ---- freshness and plans (FR-*)


@query("select range_id, md5(string_agg(path, chr(10) order by path)) as fingerprint from (select distinct range_id, path from c_files) group by range_id")
def fr1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-1."""
    return freshness.set_fingerprint(corpus.files(spark, sf_dir), ["range_id"], "path")


@query("select path, md5(path) as fingerprint from c_files where substr(md5(path), 1, 1) >= '4'")
def fr2_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-2."""
    live = corpus.files(spark, sf_dir).select("path", F.md5("path").alias("fingerprint"))
    stored = live.withColumn("fingerprint", F.when(F.substring("fingerprint", 1, 1) < "4", "old").otherwise(F.col("fingerprint")))
    return freshness.fresh(stored, live, ["path"])


@query("select doc_id as unit, case when doc_id % 7 = 0 then 'active' when doc_id % 5 = 0 then 'failed' when doc_id % 2 = 0 then 'fresh' end as skip from documents")
def fr9_work_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.md5(F.col("doc_id").cast("string")).alias("fingerprint"))
    return freshness.work_plan(d, d.where("unit % 7 = 0"), d.where("unit % 5 = 0"), d.where("unit % 2 = 0"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    result = F.when(kind == "view", "done").when(kind == "click", "gate-failed").when(kind == "error", "transient").when(kind == "signup", "invalid-output").otherwise("refused")
    return corpus.events(spark, sf_dir).select(F.concat_ws("/", F.col("user_id").cast("string"), F.floor(F.col("k") / 20).cast("string")).alias("unit"), F.col("event_id").alias("seq"), result.alias("result"))


@query("""with a as (select user_id || '/' || k // 20 as unit, event_id as seq, case event_type when 'view' then 'done' when 'click' then 'gate-failed' when 'error' then 'transient' when 'signup' then 'invalid-output' else 'refused' end as result from c_events),
n as (select *, case when result in ('done', 'gate-failed', 'refused') then result when sum((result = 'invalid-output')::int) over w > 1 or sum((result = 'transient')::int) over w > 2 then 'failed' end as e from a window w as (partition by unit order by seq))
select unit, coalesce(arg_min(e, seq) filter (e is not null), 'pending') as outcome from n group by unit""")
def fr10_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.attempt_outcomes(_attempts(spark, sf_dir))


# ---- progress and evaluation (AG-*)


@query("select range_id as section, count(*) filter (state = 'reviewed') as done, count(*) as total, case when count(*) filter (state = 'reviewed') = 0 then 'untouched' when count(*) filter (state = 'reviewed') < count(*) then 'partial' else 'complete' end as status from c_state group by all")
def ag1_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-1, AG-2."""
    s = state.review_state(corpus.review_patches(spark, sf_dir))
    return evaluation.section_progress(s.select(F.col("range_id").alias("section"), F.coalesce(F.col("state") == "reviewed", F.lit(False)).alias("reviewed")))


@query("select event_type as kind, count(*) as calls, sum(k) as input, sum(event_id % 500) as output, round(sum(case when event_type <> 'signup' then value end), 6) as cost from c_events group by all")
def ag7_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.events(spark, sf_dir)
    ledger = e.select(F.col("event_type").alias("kind"), F.col("k").cast("long").alias("input"), (F.col("event_id") % 500).alias("output"), F.when(F.col("event_type") != "signup", F.col("value")).alias("cost"))
    return evaluation.spend(ledger, "kind")


@query("select range_id, count(*) as n, min(n_lines) as least, round(quantile_cont(n_lines, 0.5), 6) as p50, round(quantile_cont(n_lines, 0.9), 6) as p90, max(n_lines) as most, round(avg(n_lines), 6) as mean, round(avg((n_lines <= 10)::int), 6) as small_share from (select f.range_id, l.doc_id, count(*) as n_lines from c_lines l join c_files f using (doc_id) group by all) group by range_id")
def ag12_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus.file_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines")).join(corpus.files(spark, sf_dir), "doc_id")
    return evaluation.size_stats(n, "range_id", "n_lines")


@query("select range_id, median(1 + doc_id % 5) as register, median(1 + doc_id // 5 % 5) as orientation, min(3 + quality + 1 - toxic) as faithfulness, median(1 + doc_id % 5) >= 4 and median(1 + doc_id // 5 % 5) >= 4 and min(3 + quality + 1 - toxic) >= 4 as passed from (select *, doc_id // 40 as range_id from labels) group by range_id")
def ag15_judge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-15."""
    d = corpus.table(spark, sf_dir, "labels")
    d = d.select(F.floor(F.col("doc_id") / 40).alias("range_id"), (1 + F.col("doc_id") % 5).alias("register"), (1 + F.floor(F.col("doc_id") / 5) % 5).alias("orientation"), (4 + F.col("quality") - F.col("toxic")).alias("faithfulness"))
    return evaluation.judge_gate(d, "range_id")


@query("select case when event_id % 4 = 3 then 'invalid' when (event_id % 4 = 0) = (event_id % 3 = 0) then 'model' else 'plain' end as winner, count(*) as trials from events group by all")
def ag14_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    d = corpus.table(spark, sf_dir, "events").select(F.when(i % 4 == 3, "C").when(i % 4 == 0, "A").otherwise("B").alias("answer"), F.when(i % 3 == 0, "model").otherwise("plain").alias("a_is"))
    return evaluation.pairwise_tally(d)


@query("select user_id as chunk_id, count(*) as n, case when bool_or(event_type = 'view') then 'ready' when bool_or(event_type = 'error') then 'answering' when bool_or(event_type = 'click') then 'failed' else 'note' end as state, min(event_id) as first_seq from events group by all")
def ag11_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-11: every event is a deferral."""
    kind = F.col("event_type")
    d = corpus.table(spark, sf_dir, "events")
    return evaluation.stub_states(d.select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("seq"), F.lit("ai").alias("kind"), F.when(kind == "view", "done").when(kind == "error", "running").when(kind == "click", "failed").alias("status")))


# ---- state (ST-*)


@query("select * from c_state")
def st1_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.review_state(corpus.review_patches(spark, sf_dir))


@query("""with t as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) as seq, event_type in ('view', 'click', 'error') as accruing, event_type = 'error' as spike, least(10 * k, 700) as dt, user_id % 30 as lines from c_events),
r as (select *, sum(new) over (partition by key order by seq) as run from (select *, case when accruing is distinct from lag(accruing) over (partition by key order by seq) then 1 else 0 end as new from t)),
s as (select *, sum(spike::int) over (partition by key, run order by seq desc) as after, run = max(run) over (partition by key) as last from r),
g as (select key, coalesce(sum(dt) filter (accruing and after = 0 and not last), 0) as banked, coalesce(sum(dt) filter (accruing and after = 0 and last), 0) as current, max(lines) as lines from s group by key)
select key, banked, current, banked + current >= least(greatest(lines * 300, 1500), 8000) as cleared from g""")
def st2_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2, SC-22."""
    kind = F.col("event_type")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return state.dwell(corpus.events(spark, sf_dir).select(F.col("user_id").alias("key"), seq.alias("seq"), kind.isin("view", "click", "error").alias("accruing"), (kind == "error").alias("spike"), (10 * F.col("k")).alias("dt"), (F.col("user_id") % 30).alias("lines")))


@query("select k as id, arg_max(value, event_id) as value from c_events group by k having arg_max(event_type, event_id) <> 'error'")
def st5_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.events(spark, sf_dir)
    return state.latest_by_id(e.select(F.col("k").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), "value"))


@query("select strftime(ts, '%Y-%m-%d') as day, event_type as kind, count(*) as calls, sum(k) as input, round(sum(value), 4) as cost from c_events group by all")
def st6_running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.running_spend(corpus.events(spark, sf_dir).select("ts", F.col("event_type").alias("kind"), F.col("k").alias("input"), F.col("value").alias("cost")))


@query("select distinct k from c_events where ts < timestamp '2024-01-20' and event_type = 'click' and k not in (select k from c_events where ts < timestamp '2024-01-01 01:00:00' and event_type = 'click')")
def st4_newly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3, ST-4."""
    done = corpus.events(spark, sf_dir).where("event_type = 'click'")
    return state.newly(done.where("ts < timestamp '2024-01-01 01:00:00'"), done.where("ts < timestamp '2024-01-20'"), "k")


# ---- rendering and diff text (RN-*, IO-*)


@query("""with s as (select doc_id, line_no, max(own) as own from (select doc_id, line_no, 1 as own from c_hunk_lines union all select doc_id, unnest(range(start - 3, start + count + 3)), 0 from c_hunks where count > 0) group by all),
r as (select s.*, l.text, line_no > lag(line_no) over (partition by doc_id order by line_no) + 1 as gap from s join c_lines l using (doc_id, line_no)),
x as (select doc_id, line_no as ord, 1 as p, case when own = 1 then 'add' else 'context' end as type, line_no, text from r union all select doc_id, line_no, 0, 'gap', null, '' from r where gap)
select doc_id, row_number() over (partition by doc_id order by ord, p) as row_no, type, line_no, text from x""")
def rn1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RN-1, CH-16."""
    return rendering.unified_rows(corpus.hunks(spark, sf_dir), corpus.file_lines(spark, sf_dir))


def _chunk_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as hunks of their symbols' chunks; in deleted files the primary side is the base."""
    p = chunking.parts(corpus.hunks(spark, sf_dir), corpus.symbols(spark, sf_dir)).join(corpus.files(spark, sf_dir).select("doc_id", (F.col("status") == "deleted").alias("deleted")), "doc_id")
    main = lambda a, b: F.when(F.col("deleted"), F.col(a)).otherwise(F.col(b))
    return p.select("doc_id", F.coalesce("sym_id", F.lit(-1)).alias("chunk"), (F.col("hunk_no") * 1000 + F.col("part_no")).alias("hunk_no"), "deleted", F.col("start").alias("head_start"), F.col("start").alias("base_start"), main("other_count", "count").alias("head_count"), main("count", "other_count").alias("base_count"))


#: Every line is shown by the first stretch that reaches it; gaps by what earlier stretches of the chunk have shown.
FIXTURE |= {
    "r_hunks": """r_hunks as (select p.doc_id, coalesce(sym_id, -1) as chunk, status = 'deleted' as del, row_number() over w as o, start, count, other_count, case when count > 0 then start - 1 else start end as before, lead(start) over w as nxt, n
  from c_parts p join c_files using (doc_id) join (select doc_id, max(line_no) as n from c_lines group by doc_id) using (doc_id) window w as (partition by p.doc_id, coalesce(sym_id, -1) order by start, hunk_no, part_no))""",
    "r_own": "r_own as (select doc_id, chunk, o, del, unnest(range(start, start + count)) as line_no from r_hunks)",
    "r_near": """r_near as (select * from (select doc_id, chunk, o, del, 1 as phase, unnest(range(before - 2, before + 1)) as line_no, n from r_hunks union all
  select doc_id, chunk, o, del, 4, unnest(range(before + count + 1, least(before + count + 3, coalesce(nxt - 1, 1073741824)) + 1)), n from r_hunks) where line_no between 1 and n qualify row_number() over (partition by doc_id, chunk, line_no order by o, phase) = 1)""",
    "r_context": "r_context as (select * from r_near c where not exists (select 1 from r_own w where w.doc_id = c.doc_id and w.chunk = c.chunk and w.line_no = c.line_no and (w.o < c.o or w.o = c.o and c.phase = 4)))",
    "r_rows": """r_rows as (select doc_id, chunk, o, phase, 'context' as type, case when del then 'base' else 'head' end as side, line_no from r_context union all
  select doc_id, chunk, o, 3, case when del then 'del' else 'add' end, case when del then 'base' else 'head' end, line_no from r_own union all
  select doc_id, chunk, o, 2, 'del', 'base', unnest(range(start, start + other_count)) from r_hunks where not del)""",
    "r_gaps": """r_gaps as (select h.doc_id, h.chunk, h.o from r_hunks h join r_rows r on r.doc_id = h.doc_id and r.chunk = h.chunk and r.o < h.o group by h.doc_id, h.chunk, h.o, h.before having h.before - 3 > coalesce(max(r.line_no) filter (r.phase <> 2), 0))""",
    "r_all": """r_all as (select x.doc_id, x.chunk, row_number() over (partition by x.doc_id, x.chunk order by o, phase, x.line_no) as row_no, type, case when x.side = 'head' then x.line_no end as head, case when x.side = 'base' then x.line_no end as base, coalesce(text, '') as text
  from (select * from r_rows union all select doc_id, chunk, o, 0, 'gap', null, null from r_gaps) x left join c_sides s on s.doc_id = x.doc_id and s.side = x.side and s.line_no = x.line_no)""",
}


@query("select * from r_all")
def rn1_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RN-1: every symbol's chunk with deleted lines, deleted files and the clamp before the next hunk."""
    return rendering.chunk_rows(_chunk_hunks(spark, sf_dir), corpus.sides(spark, sf_dir))


@query("select doc_id, chunk, string_agg(case type when 'gap' then '…' when 'add' then '+' || text when 'del' then '-' || text else ' ' || text end, chr(10) order by row_no) as diff from r_all group by doc_id, chunk")
def rn3_chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.diff_text(rendering.chunk_rows(_chunk_hunks(spark, sf_dir), corpus.sides(spark, sf_dir)), ("doc_id", "chunk"))


def _diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as diff text, one text a range."""
    f, h = corpus.files(spark, sf_dir), corpus.hunks(spark, sf_dir)
    at = F.concat(F.lit("@@ -"), F.col("other_start").cast("string"), F.lit(","), F.col("other_count").cast("string"), F.lit(" +"), F.col("start").cast("string"), F.lit(","), F.col("count").cast("string"), F.lit(" @@"))
    hs = h.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("hunk_no", at.alias("t")))).alias("hs"))
    mode = F.when(F.col("status") == "added", "\nnew file mode 100644").when(F.col("status") == "deleted", "\ndeleted file mode 100644").when(F.col("status") == "renamed", F.concat(F.lit("\nrename from "), "base_path", F.lit("\nrename to "), "path")).otherwise("")
    one = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", mode, F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"), F.array_join(F.transform(F.coalesce("hs", F.array()), lambda x: x["t"]), "\n"))
    d = f.join(hs, "doc_id", "left").select("range_id", "file_no", one.alias("t"))
    return d.groupBy("range_id").agg(F.array_sort(F.collect_list(F.struct("file_no", "t"))).alias("ts")).select("range_id", F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("text"))


@query("select range_id, path, status, case when status = 'renamed' then 'old/' || path end as base_path from c_files")
def io1_diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-1: the corpus written as diff text and parsed again."""
    return readers.parse_diff(_diff_texts(spark, sf_dir))[0].select("range_id", "path", "status", "base_path")


@query("select f.range_id, count(*) as hunks, sum(h.count) as head_lines, sum(h.other_count) as base_lines from c_hunks2 h join c_files f using (doc_id) group by all")
def io1_diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_diff(_diff_texts(spark, sf_dir))[1].groupBy("range_id").agg(F.count("*").alias("hunks"), F.sum("head_count").alias("head_lines"), F.sum("base_count").alias("base_lines"))


from difflens import catalog_book, catalog_checks, catalog_items, catalog_story, catalog_streams, catalog_work  # noqa: E402,F401  register their queries here
