"""Registered queries of references, books, chips, coverage of notes and slices, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difflens.catalog import _RESOLVED, FIXTURE, _imports, query
from difflens.functions import paths
from difflens.operators import book, checks, chunking, evaluation, freshness, graph, imports, ordering, references, rendering
from difflens.sources import corpus
from difflens.streaming import state

FIXTURE |= {
    "c_owned": "c_owned as (select doc_id, line_no, coalesce(sym_id, -1) as sym from c_at)",
    "c_named": "c_named as (select *, case when sym_id % 3 = 0 then 'T' || ((sym_id // 3) % 5) else 'f' || ((doc_id * 3 + 2 * (sym_id // 3) + sym_id % 3 - 1) % 20) end as name from c_symbols)",
    "c_pairs": f"c_pairs as (select distinct s.doc_id, t.doc_id as to_doc from {_RESOLVED} e join c_files s on s.range_id = e.range_id and s.path = e.path join c_files t on t.range_id = e.range_id and t.path = e.target where s.doc_id <> t.doc_id)",
    "c_scoped": "c_scoped as (select r.doc_id, o.sym, 'f' || ((r.line_no * 5 + r.doc_id) % 20) as name, min(r.line_no) as line from c_changed r join c_owned o using (doc_id, line_no) where (r.line_no + r.doc_id) % 2 = 0 group by all)",
    "c_unique": "c_unique as (select doc_id as to_doc, name, min(sym_id) as to_sym, min(a) as to_line from c_named group by all having count(*) = 1)",
    "c_known": "c_known as (select s.doc_id, s.sym, s.name, s.line, min(u.to_doc) as to_doc, min(u.to_sym) as to_sym, min(u.to_line) as to_line from c_scoped s join (select doc_id, to_doc from c_pairs union select doc_id, doc_id from c_files) p on p.doc_id = s.doc_id join c_unique u on u.to_doc = p.to_doc and u.name = s.name group by s.doc_id, s.sym, s.name, s.line having count(*) = 1)",
    "c_first": "c_first as (select doc_id, arg_min(sym, start * 100000 + sym + 1) as sym from (select doc_id, coalesce(sym_id, -1) as sym, start from c_parts) group by doc_id)",
    "c_shown": "c_shown as (select s.*, line_no > lag(line_no) over (partition by doc_id order by line_no) + 1 as gap from (select doc_id, line_no, max(own) as own from (select doc_id, line_no, 1 as own from c_hunk_lines union all select doc_id, unnest(range(start - 3, start + count + 3)), 0 from c_hunks where count > 0) group by all) s join c_lines l using (doc_id, line_no))",
    "c_rows": "c_rows as (select doc_id, row_number() over (partition by doc_id order by ord, p) as row_no, type, line_no from (select doc_id, line_no as ord, 1 as p, case when own = 1 then 'add' else 'context' end as type, line_no from c_shown union all select doc_id, line_no, 0, 'gap', null from c_shown where gap))",
}
_TEST = r"(regexp_matches(path, '(?i)(^|/)(tests?|__tests__)/') or regexp_matches(regexp_extract(path, '[^/]*$'), '\.(test|spec)\.|Tests?\.cs$'))"


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = chunking.innermost_symbol(chunking.changed_lines(corpus.hunks(spark, sf_dir)), corpus.symbols(spark, sf_dir))
    return at.select("doc_id", "line_no", F.coalesce("sym_id", F.lit(-1)).alias("sym"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.file_lines(spark, sf_dir).where(corpus.is_changed()).where("(line_no + doc_id) % 2 = 0")
    return d.select("doc_id", "line_no", F.concat(F.lit("f"), ((F.col("line_no") * 5 + F.col("doc_id")) % 20).cast("string")).alias("name"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, to_doc: imports between files."""
    f = corpus.files(spark, sf_dir).select("range_id", "path", "doc_id")
    e = imports.import_graph(_imports(spark, sf_dir), f)[0]
    return e.join(f.toDF("range_id", "src", "doc_id"), ["range_id", "src"]).join(f.toDF("range_id", "dst", "to_doc"), ["range_id", "dst"]).select("doc_id", "to_doc").distinct()


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scoped = references.in_scope(_refs(spark, sf_dir), _owned(spark, sf_dir))
    return scoped, references.resolve(scoped, corpus.symbols(spark, sf_dir), _pairs(spark, sf_dir))


# ---- references (JN-*)


@query("select doc_id, sym, name, line, to_doc, to_sym, to_line from c_known")
def jn10_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-8, 9, 10."""
    return _known(spark, sf_dir)[1]


@query(f"select f.range_id, k.doc_id, k.sym, k.to_doc, o.sym as to_chunk, case when {_TEST} then 'exercises' else 'calls' end as kind, min(k.line) as line from c_known k join c_owned o on o.doc_id = k.to_doc and o.line_no = k.to_line join c_files f on f.doc_id = k.doc_id where k.doc_id <> k.to_doc or k.sym <> o.sym group by all")
def jn12_reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11, 12."""
    return references.edges(_known(spark, sf_dir)[1], _owned(spark, sf_dir), corpus.files(spark, sf_dir), paths.is_test)


@query("select doc_id, sym, list(name order by name) as names from c_scoped where (doc_id, sym, name) not in (select doc_id, sym, name from c_known) group by all")
def jn16_unresolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.unresolved(*_known(spark, sf_dir))


_DEFS = "(select distinct doc_id, sym, to_doc, to_sym from c_known where doc_id <> to_doc or sym <> to_sym)"


@query(f"select d.*, b.body from {_DEFS} d join (select n.doc_id as to_doc, n.sym_id as to_sym, string_agg(l.text, chr(10) order by l.line_no) as body from c_named n join c_lines l on l.doc_id = n.doc_id and l.line_no between n.a and n.b group by all) b using (to_doc, to_sym)")
def jn14_context_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14, SC-14: no body here reaches the cap."""
    return references.definitions(_known(spark, sf_dir)[1], corpus.symbols(spark, sf_dir), corpus.file_lines(spark, sf_dir))


#: Files whose id leaves 1 by 4 aren't in the diff. Test files' ranges grow to the span around them.
FIXTURE |= {
    "j_scope": f"""j_scope as (select distinct o.doc_id, o.sym, l.line_no from (select o.*, {_TEST} as test from c_owned o join c_files using (doc_id) where doc_id % 4 <> 1) o join c_lines l on l.doc_id = o.doc_id
  and (l.line_no = o.line_no or o.test and exists (select 1 from c_symbols s where s.doc_id = o.doc_id and o.line_no between s.a and s.b and l.line_no between s.a and s.b and s.depth = 1)))""",
    "j_names": "j_names as (select distinct doc_id, sym, case when line_no % 3 = 0 then 'T' || (line_no % 5) else 'f' || ((line_no * 5 + doc_id) % 20) end as name from j_scope where (line_no + doc_id) % 2 = 0)",
    "j_spans": "j_spans as (select doc_id, name, any_value(sym_id) as sym_id, any_value(a) as a, any_value(b) as b from c_named group by doc_id, name having count(*) = 1)",
    "j_one": """j_one as (select n.*, s.doc_id as to_doc, s.sym_id, s.a, s.b from j_names n join j_spans s on s.name = n.name and (s.doc_id = n.doc_id or exists (select 1 from c_pairs p where p.doc_id = n.doc_id and p.to_doc = s.doc_id)) where s.doc_id % 4 <> 1
  and not (s.doc_id = n.doc_id and exists (select 1 from c_owned o where o.doc_id = n.doc_id and o.sym = n.sym and o.line_no between s.a and s.b)) qualify count(*) over (partition by n.doc_id, n.sym, n.name) = 1)""",
    "j_two": """j_two as (select n.*, s.doc_id as to_doc, s.sym_id, s.a, s.b from (select * from j_names where (doc_id, sym, name) not in (select doc_id, sym, name from j_one)) n join c_pairs p on p.doc_id = n.doc_id join j_spans s on s.name = n.name and s.doc_id = p.to_doc where s.doc_id % 4 = 1 qualify count(*) over (partition by n.doc_id, n.sym, n.name) = 1)""",
    "j_body": """j_body as (select *, coalesce((list_filter(range(5, 8), lambda i: trim(coalesce(t[i + 1], 'x')) = ''))[1], (list_filter(range(5, 8), lambda i: regexp_matches(coalesce(t[i + 1], ''), '[;{}]\\s*$')))[1] + 1, 5) as cut from (select d.doc_id, d.sym, d.name, d.to_doc, d.sym_id as to_sym, d.changed, list(l.text order by l.line_no) as t
  from (select *, true as changed from j_one union all select *, false from j_two) d join c_lines l on l.doc_id = d.to_doc and l.line_no between d.a and d.b group by all))""",
}


@query("select doc_id, sym, name, to_doc, to_sym, changed, case when len(t) <= 5 then array_to_string(t, chr(10)) else array_to_string(t[1 : cut], chr(10)) || chr(10) || '… (' || (len(t) - cut) || case when len(t) - cut = 1 then ' more line)' else ' more lines)' end end as body from j_body")
def jn14_both_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13, JN-14, SC-14: changed files first, then files the diff doesn't touch; bodies of more than five lines are cut.

    What is read many times is stored once: the driver keeps the whole plan again for each of its stages.
    """
    spans, pairs, files = graph.cut(corpus.symbols(spark, sf_dir)), graph.cut(_pairs(spark, sf_dir)), corpus.files(spark, sf_dir)
    out = "doc_id % 4 = 1"
    owned = graph.cut(_owned(spark, sf_dir).where(f"not ({out})"))
    tests = owned.join(files.where(paths.is_test(F.col("path"))).select("doc_id"), "doc_id").select("doc_id", "sym", F.col("line_no").alias("start"), F.col("line_no").alias("end"), F.col("line_no").alias("hunk_no"))
    grown = references.widened(tests.select("doc_id", F.struct("sym", "hunk_no").alias("hunk_no"), "start", "end"), spans.where("depth = 1"))
    wide = grown.select("doc_id", "hunk_no.sym", F.explode(F.sequence("start", "end")).alias("line_no"))
    scope = owned.select("doc_id", "sym", "line_no").unionByName(wide).distinct().join(corpus.file_lines(spark, sf_dir).select("doc_id", "line_no"), ["doc_id", "line_no"])
    name = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("T"), (F.col("line_no") % 5).cast("string"))).otherwise(F.concat(F.lit("f"), ((F.col("line_no") * 5 + F.col("doc_id")) % 20).cast("string")))
    names = graph.cut(scope.where("(line_no + doc_id) % 2 = 0").select("doc_id", "sym", name.alias("name")).distinct())
    by = lambda d, c, yes: d.where(f"{c} % 4 = 1" if yes else f"{c} % 4 <> 1")
    return references.context_definitions(names, owned, (by(spans, "doc_id", False), by(pairs, "to_doc", False)), (by(spans, "doc_id", True), by(pairs, "to_doc", True)), corpus.file_lines(spark, sf_dir), most=5, reach=2)


@query(f"select d.* from {_DEFS} d where (to_doc, to_sym) not in (select n.doc_id, n.sym_id from c_named n join c_owned o on o.doc_id = n.doc_id and o.line_no = n.a)")
def jn15_visible_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = corpus.symbols(spark, sf_dir)
    defs = _known(spark, sf_dir)[1].where("doc_id <> to_doc or sym <> to_sym").select("doc_id", "sym", "to_doc", "to_sym").distinct()
    return references.visible(defs, _owned(spark, sf_dir), spans)


@query(f"""select h.doc_id, h.hunk_no, coalesce(arg_min(s.a, s.b - s.a), h.start) as start, coalesce(arg_min(s.b, s.b - s.a), h.start + h.count - 1) as "end" from c_hunks h join c_files f using (doc_id) left join c_symbols s on s.doc_id = h.doc_id and s.a <= h.start and s.b >= h.start + h.count - 1 where h.count > 0 and {_TEST} group by h.doc_id, h.hunk_no, h.start, h.count""")
def jn13_test_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = corpus.files(spark, sf_dir).where(paths.is_test(F.col("path"))).select("doc_id")
    h = corpus.hunks(spark, sf_dir).where("count > 0").join(tests, "doc_id").select("doc_id", "hunk_no", "start", (F.col("start") + F.col("count") - 1).alias("end"))
    return references.widened(h, corpus.symbols(spark, sf_dir))


@query("""with n as (select range_id, path, 'N.R' || range_id || case when doc_id // 10 % 2 = 1 then '.S' else '' end as namespace from c_files where doc_id % 10 = 3), u as (select range_id, path, 'N.R' || range_id as namespace from n union all select range_id, path, 'System' from n)
select distinct range_id, src, dst from (select u.range_id, u.path as src, t.path as dst from u join n t on t.range_id = u.range_id and t.namespace = u.namespace where (u.range_id, u.path, u.namespace) not in (select range_id, path, namespace from n) union all select n.range_id, n.path, t.path from n join n t on t.range_id = n.range_id and n.namespace like t.namespace || '.%') where src <> dst""")
def jn4_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir).where("doc_id % 10 = 3")
    name = F.concat(F.lit("N.R"), F.col("range_id").cast("string"))
    declared = f.select("range_id", "path", F.concat(name, F.when(F.floor(F.col("doc_id") / 10) % 2 == 1, ".S").otherwise("")).alias("namespace"))
    usings = f.select("range_id", "path", F.explode(F.array(name, F.lit("System"))).alias("namespace"))
    return references.namespaces(usings, declared, paths.ancestor_namespaces)


@query(f"select distinct e.range_id, e.path, e.target from {_RESOLVED} e join c_files t on t.range_id = e.range_id and t.path = e.target where t.doc_id % 3 = 0 and e.path <> e.target")
def jn7_unchanged_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-7, IO-3: imports resolved over all paths at head, less the changed files (two of three)."""
    f = corpus.files(spark, sf_dir)
    e = imports.import_graph(_imports(spark, sf_dir), f)[0].select("range_id", F.col("src").alias("path"), F.col("dst").alias("target"))
    return e.join(f.where("doc_id % 3 <> 0").select("range_id", F.col("path").alias("target")), ["range_id", "target"], "left_anti").select("range_id", "path", "target")


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chunking.parts(corpus.hunks(spark, sf_dir), corpus.symbols(spark, sf_dir))
    return book.anchors(p.select("doc_id", F.coalesce("sym_id", F.lit(-1)).alias("sym"), "start"))


@query("select p.doc_id, a.sym, p.to_doc, b.sym as to_sym from c_pairs p join c_first a on a.doc_id = p.doc_id join c_first b on b.doc_id = p.to_doc")
def jn18_lifted_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-17, 18."""
    return book.lifted(_pairs(spark, sf_dir), _anchors(spark, sf_dir))


_ANCHORED = rf"""(select t.range_id, t.path as test, coalesce(near, alike) as impl from (select * from c_files where {_TEST}) t
left join (select e.range_id, e.path, arg_max(e.target, f.file_no) as near from {_RESOLVED} e join c_files f on f.range_id = e.range_id and f.path = e.target where f.doc_id % 10 in (0, 1, 8) group by all) n on n.range_id = t.range_id and n.path = t.path
left join (select t.range_id, t.path, arg_max(i.path, length(i.stem) * 1000 + i.file_no) as alike from (select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(path, '[^/]*$')), '(.)\.[^.]*$', '\1'), '\.(test|spec)$', ''), 'tests?$', '') as stem from c_files where {_TEST}) t join (select *, regexp_replace(lower(regexp_extract(path, '[^/]*$')), '(.)\.[^.]*$', '\1') as stem from c_files where doc_id % 10 in (0, 1, 8)) i on i.range_id = t.range_id and (i.stem = t.stem or (length(i.stem) >= 4 and starts_with(t.stem, i.stem))) group by all) s on s.range_id = t.range_id and s.path = t.path where coalesce(near, alike) is not null)"""


def _test_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.files(spark, sf_dir)
    impls = f.where("doc_id % 10 in (0, 1, 8)").select("range_id", "path", F.col("file_no").alias("pos"))
    return book.test_anchors(f.where(paths.is_test(F.col("path"))).select("range_id", "path"), impls, imports.import_graph(_imports(spark, sf_dir), f)[0])


@query(f"select range_id, test, impl from {_ANCHORED}")
def jn19_test_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_anchors(spark, sf_dir)


@query("""with i as (select range_id, path || '::' || doc_id % 7 || '::' || doc_id as id, doc_id from c_files), k as (select range_id, doc_id, id, case doc_id % 4 when 0 then id when 1 then 'chunk ' || id when 2 then doc_id::varchar else case when range_id % 3 = 0 then 'x' else doc_id % 7 || '::' || doc_id end end as key from i)
select range_id as reply, count(*) as n_keys, bool_and(key <> 'x') as accepted, case when bool_and(key <> 'x') then list(id order by id) else [] end as ids from k group by range_id""")
def jn20_reply_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-20: keys as whole ids, labelled ids, and ends of ids; an unknown key in every third reply."""
    n, s = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    f = corpus.files(spark, sf_dir).select(F.col("range_id").alias("reply"), "doc_id", F.concat_ws("::", "path", n.cast("string"), s).alias("chunk_id"))
    kind = F.col("doc_id") % 4
    key = F.when(kind == 0, F.col("chunk_id")).when(kind == 1, F.concat(F.lit("chunk "), "chunk_id")).when(kind == 2, s).when(F.col("reply") % 3 == 0, "x").otherwise(F.concat_ws("::", n.cast("string"), s))
    return book.resolved_keys(f.select("reply", key.alias("key")), f.select("reply", "chunk_id"))


# ---- graphs (GR-*)


def _third(e: DataFrame) -> DataFrame:
    return e.select("range_id", F.col("src").alias("node")).union(e.select("range_id", "dst")).distinct().where("node % 3 = 0")


_HOPS = "(select distinct range_id, src as node, dst as other, kind, 'out' as direction from c_edges where src <> dst union all select distinct range_id, dst, src, kind, 'in' from c_edges where src <> dst)"


@query(f"with h as {_HOPS}, r as (select range_id, node as focus, other as node, kind, direction, other as at_ from h union select r.range_id, r.focus, r.node, r.kind, r.direction, h.other from r join h on h.range_id = r.range_id and h.node = r.at_ and h.kind = r.kind and h.direction = r.direction where h.other <> r.focus) select range_id, focus, node, kind, direction, count(*) filter (at_ <> node and at_ % 3 <> 0) as n from r group by all")
def gr8_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.edges(spark, sf_dir)
    return graph.behind(e, _third(e))


@query("""with e as (select range_id, src, dst, kind, min(source) as source from c_edges where src <> dst group by all), b as (select range_id, src as focus, dst as node, kind, source, 'out' as direction from e union all select range_id, dst, src, kind, source, 'in' from e),
c as (select *, kind = 'exercises' and source = 'test-anchor' as reveal from b)
select range_id, focus, node, kind, direction, case when reveal then 'reveal' else 'jump' end as action, reveal or kind = 'file-imports' as file_level, case when node % 3 = 0 then 'reviewed' else 'unreviewed' end as state, not reveal and kind <> 'file-imports' and (node % 3 = 0) <> (focus % 3 = 0) as frontier, row_number() over (partition by range_id, focus order by list_position(['calls:out', 'calls:in', 'exercises:in', 'exercises:out', 'file-imports:out', 'file-imports:in'], kind || ':' || direction), node) as rank from c""")
def gr9_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.edges(spark, sf_dir)
    return graph.chips(e, _third(e))


@query("select range_id, count(*) as nodes, count(*) filter (linked is null) as alone, round(count(*) filter (linked is null) / count(*), 6) as share from (select range_id, src as node from c_edges union select range_id, dst from c_edges) left join (select distinct range_id, node, true as linked from (select range_id, src as node, dst, src, kind from c_edges union all select range_id, dst, dst, src, kind from c_edges) where src <> dst and kind <> 'file-imports') using (range_id, node) group by all")
def gr15_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.edges(spark, sf_dir)
    return graph.islands(e, e.select("range_id", F.col("src").alias("node")).union(e.select("range_id", "dst")))


# ---- books (OR-*, SE-2)


@query(rf"""with p as (select f.*, case when doc_id % 10 in (5, 6, 7) then 'low-signal' when {_TEST} then 'test' when doc_id % 10 in (0, 1, 8) then 'impl' else 'periphery' end as role from c_files f), a as (select x.range_id, x.test as path, i.file_no as anchor_pos from {_ANCHORED} x join c_files i on i.range_id = x.range_id and i.path = x.impl),
q as (select p.*, anchor_pos, case when role = 'impl' or (role = 'test' and anchor_pos is not null) then 0 when role = 'test' then 1 when role = 'periphery' then 2 else 3 end as block from p left join a using (range_id, path))
select range_id, path, row_number() over (partition by range_id order by block, case when block = 0 then coalesce(anchor_pos, file_no) else file_no end, role = 'test', file_no) as position from q""")
def or2_section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, kind = corpus.files(spark, sf_dir), F.col("doc_id") % 10
    role = F.when(kind.isin(5, 6, 7), "low-signal").when(paths.is_test(F.col("path")), "test").when(kind.isin(0, 1, 8), "impl").otherwise("periphery")
    at = _test_anchors(spark, sf_dir).join(f.select("range_id", F.col("path").alias("impl"), F.col("file_no").alias("anchor_pos")), ["range_id", "impl"]).select("range_id", F.col("test").alias("path"), "anchor_pos")
    return book.section_order(f.select("range_id", "path", role.alias("role"), F.col("file_no").alias("pos")).join(at, ["range_id", "path"], "left"))


@query("""with s as (select range_id, line as pos, min(src) as chunk from c_edges group by all), t as (select *, 'f' || chunk // 3 as path, lag(chunk) over (partition by range_id order by pos) as before from s), u as (select distinct range_id, src, dst from c_edges where kind = 'calls' union select range_id, dst, src from c_edges where kind = 'calls')
select range_id, pos, chunk, path, sum(case when coalesce(path = 'f' || before // 3, false) or u.range_id is not null then 0 else 1 end) over (partition by range_id order by pos) as chapter from t left join u on u.range_id = t.range_id and u.src = t.before and u.dst = t.chunk""".replace("select range_id, pos, chunk, path, sum", "select t.range_id, pos, chunk, path, sum").replace("partition by range_id order by pos) as chapter", "partition by t.range_id order by pos) as chapter"))
def or5_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR-5: the spine of a range is the first source of each line of its edges; three chunks a file."""
    e = corpus.edges(spark, sf_dir)
    s = e.groupBy("range_id", F.col("line").alias("pos")).agg(F.min("src").alias("chunk")).withColumn("path", F.concat(F.lit("f"), F.floor(F.col("chunk") / 3).cast("string")))
    return book.chapters(s, e.where("kind = 'calls'"))


@query(rf"select path, case when doc_id % 19 = 0 then 'leftover' when doc_id % 10 in (5, 6, 7) then 'low-signal' when {_TEST} or regexp_matches(path, '(?i)(^|/)(e2e|playwright)/') then 'test' else 'story' end as bucket from c_files")
def or11_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).select("path", book.bucket(F.col("path"), (F.col("doc_id") % 10).isin(5, 6, 7), F.col("doc_id") % 19 == 0).alias("bucket"))


_FLAT = "(select *, min(pos) over (partition by range_id, chunk) as first_pos, row_number() over (partition by range_id, chunk order by pos) as ordinal from (select l_orderkey as range_id, l_linenumber as section_no, l_partkey as occ_no, l_partkey % 4 as chunk, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as pos from lineitem))"


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = corpus.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("range_id"), F.col("l_linenumber").alias("section_no"), F.col("l_partkey").alias("occ_no"), (F.col("l_partkey") % 4).alias("chunk"))


@query(f"select range_id, section_no, occ_no, chunk, pos, ordinal, first_pos, chunk || '#' || ordinal as key from {_FLAT}")
def or16_flat_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.flattened(_occurrences(spark, sf_dir))


@query(f"select range_id, coalesce(max(a.first_pos), 0) as at from (select range_id, max(chunk) as want from {_FLAT} where pos = 1 group by all) b right join (select distinct l_orderkey as range_id from lineitem) using (range_id) left join (select range_id, chunk, first_pos from {_FLAT} where ordinal = 1) a using (range_id) where want is null or a.chunk = want group by range_id")
def or18_remapped_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR-18: from the second row of a book without repeated chunks, to the same book."""
    flat = book.flattened(_occurrences(spark, sf_dir)).withColumn("key", F.concat(F.col("chunk").cast("string"), F.lit("#1")))
    cursors = flat.select("range_id").distinct().withColumn("at", F.lit(1))
    return book.remapped(cursors, flat.select("range_id", "pos", "key"), flat.where("ordinal = 1").select("range_id", "pos", "key"))


@query("select range_id, array_to_string((list(path order by path))[1:4], ', ') || case when count(*) > 4 then ' +' || (count(*) - 4) || ' more' else '' end as label from c_files group by range_id")
def or20_some_and_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus.files(spark, sf_dir).groupBy("range_id").agg(F.array_sort(F.collect_list("path")).alias("ps"))
    return g.select("range_id", book.some_and_more(F.col("ps"), 4).alias("label"))


@query("select range_id, count(*) filter (range_id % 3 = 1 and file_no = 0) as missing, case when range_id % 3 = 2 then 1 else 0 end as unknown, 0 as duplicated, case when range_id % 2 = 0 then 1 else 0 end as empty from c_files group by range_id")
def se2_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE-2: chapters of five files; a file dropped, a foreign key or an empty chapter in some ranges."""
    f = corpus.files(spark, sf_dir).select("range_id", F.col("path").alias("key"), "file_no")
    c = f.where("not (range_id % 3 = 1 and file_no = 0)").groupBy("range_id", F.floor(F.col("file_no") / 5).alias("chapter")).agg(F.collect_list("key").alias("members"))
    each = f.select("range_id").distinct()
    foreign = each.where("range_id % 3 = 2").select("range_id", F.lit(98).cast("long").alias("chapter"), F.array(F.lit("x")).alias("members"))
    none = each.where("range_id % 2 = 0").select("range_id", F.lit(99).cast("long").alias("chapter"), F.array().cast("array<string>").alias("members"))
    return book.partition_check(f, c.union(foreign).union(none))


# ---- notes, progress, evaluation (FR-*, TX-*, AG-*, ST-*)


@query("select doc_id as unit, case when doc_id % 3 = 0 then 'running' when doc_id % 4 = 1 then 'failed' when doc_id % 4 = 3 then 'failed' else 'done' end as status from documents")
def fr11_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.when(F.col("doc_id") % 4 == 1, "running").when(F.col("doc_id") % 4 == 3, "failed").otherwise("done").alias("status"))
    return freshness.orphans(d, d.where("unit % 3 = 0"))


@query("select conv_id, turn, case when turn % 3 = 0 then case when trim(text) <> '' then trim(text) end else case when conv_id % 2 = 0 then 'r' || conv_id end end as line from conversations")
def tx6_ai_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-6: an intro in every third turn, a rationale in the other turns of every second conversation."""
    third, even = F.col("turn") % 3 == 0, F.col("conv_id") % 2 == 0
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", book.ai_line(F.when(third, F.col("text")).otherwise("  "), F.when(~third & even, F.concat(F.lit("r"), F.col("conv_id").cast("string")))).alias("line"))


@query("with u as (select *, chunk_id % 4 < 2 as stub from c_state where coalesce(state, 'unseen') <> 'reviewed') select range_id * 10 + chunk_id // 10 as section, count(*) as n_chunks, coalesce(list_sort(list_distinct(list(case chunk_id % 4 when 0 then 'lockfile' when 1 then 'generated' end) filter (stub))), []) as reasons, count(*) filter (stub) as stubs, count(*) filter (not stub) as read from u group by range_id * 10 + chunk_id // 10 having bool_and(stub or coalesce(auto_read, false))")
def ag3_batchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-3, AG-4."""
    s = state.review_state(corpus.review_patches(spark, sf_dir))
    reason = F.when(F.col("chunk_id") % 4 == 0, "lockfile").when(F.col("chunk_id") % 4 == 1, "generated")
    return evaluation.batchable_sections(s.select((F.col("range_id") * 10 + F.floor(F.col("chunk_id") / 10)).alias("section"), "chunk_id", F.coalesce(F.col("state") == "reviewed", F.lit(False)).alias("reviewed"), "auto_read", reason.alias("stub_reason")))


@query("select doc_id, count(*) as pieces, count(*) filter (part_no % 2 = 1) as reviewed, sum(count) as added, sum(other_count) as removed from c_parts group by doc_id")
def ag5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chunking.parts(corpus.hunks(spark, sf_dir), corpus.symbols(spark, sf_dir))
    return p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.count_if(F.col("part_no") % 2 == 1).alias("reviewed"), F.sum("count").alias("added"), F.sum("other_count").alias("removed"))


@query("select range_id as section, case when range_id % 4 = 1 or n > 0 then case when range_id % 4 = 1 or n < m then 'partial' else 'complete' end end as kind, n as narrated, m as narratable from (select range_id, count(*) filter (doc_id % 3 = 0 and range_id % 3 > 0 or range_id % 5 = 0) as n, count(*) as m from c_files group by all)")
def ag6_note_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = corpus.files(spark, sf_dir).select(F.col("range_id").alias("section"), F.expr("doc_id % 3 = 0 and range_id % 3 > 0 or range_id % 5 = 0").alias("narrated"))
    return evaluation.narration_coverage(u, u.select("section").distinct().where("section % 4 = 1").withColumn("status", F.lit("running")))


@query("select event_type as kind, count(*) filter (event_id % 4 = 0) as queued, count(*) filter (event_id % 4 = 1) as running, count(*) filter (event_id % 4 = 2) as done, count(*) filter (event_id % 4 = 3) as failed from events group by all")
def ag8_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return evaluation.status_counts(corpus.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), status.alias("status")))


@query("select event_type, share, v[least(floor(share * len(v))::int, len(v) - 1) + 1] as value from (select event_type, list(value order by value) as v from events where value is not null group by event_type), (select unnest([0.5::double, 0.9::double]) as share)")
def ag13_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.floor_percentiles(corpus.table(spark, sf_dir, "events"), "event_type", "value", (0.5, 0.9))


@query("select doc_id, doc_id % 7 between 1 and 5 and (3 + quality - toxic >= 4 or doc_id % 2 = 0) and 3 + quality - toxic between 1 and 5 as valid from labels")
def ag17_valid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 7).alias("orientation"), F.lit(3).alias("register"), (3 + F.col("quality") - F.col("toxic")).alias("faithfulness"), F.when(F.col("doc_id") % 2 == 0, "q").otherwise(" ").alias("quote"))
    return evaluation.valid_scores(d).select("doc_id", "valid")


@query("select kind, count(*) as n, round(avg((line % 7 <> 0)::int), 6) as precision, round(avg((line % 7 <> 0)::int), 6) >= 0.9 as passed from c_edges group by all")
def ag18_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.label_precision(corpus.edges(spark, sf_dir).select("kind", (F.col("line") % 7 != 0).alias("relevant")), "kind")


@query("select f.range_id, coalesce(sym_kind, 'none') as kind, count(*) as parts from c_parts join c_files f using (doc_id) group by all")
def ag19_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chunking.parts(corpus.hunks(spark, sf_dir), corpus.symbols(spark, sf_dir)).join(corpus.files(spark, sf_dir), "doc_id")
    return p.groupBy("range_id", F.coalesce("sym_kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("parts"))


@query("select range_id, count(*) as n_refs, count(to_doc) as n_defs, round(count(to_doc) / count(*), 6) as rate from c_scoped s join c_files using (doc_id) left join (select doc_id, sym, name, to_doc from c_known) k using (doc_id, sym, name) group by all")
def ag20_resolve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped, known = _known(spark, sf_dir)
    j = scoped.join(known.select("doc_id", "sym", "name", "to_doc"), ["doc_id", "sym", "name"], "left").join(corpus.files(spark, sf_dir).select("doc_id", "range_id"), "doc_id")
    return j.groupBy("range_id").agg(F.count("*").alias("n_refs"), F.count("to_doc").alias("n_defs"), F.round(F.count("to_doc") / F.count("*"), 6).alias("rate"))


@query("select distinct event_type as kind, k as fingerprint from c_events")
def st7_unit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.events(spark, sf_dir).select(F.col("event_type").alias("kind"), F.col("k").alias("fingerprint"), "ts")
    return state.first_of_key(e, ["kind", "fingerprint"], "ts").drop("ts")


# ---- slices (RN-*)


@query("""select doc_id, min(line_no) as start, max(line_no) as "end" from c_hunk_lines join c_lines using (doc_id, line_no) group by doc_id""")
def rn5_changed_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.changed_span(rendering.unified_rows(corpus.hunks(spark, sf_dir), corpus.file_lines(spark, sf_dir)))


@query("select doc_id, case when 4 > min(line_no) or 9 < max(line_no) then 'slice' else 'whole' end as scope from documents left join c_hunk_lines using (doc_id) group by doc_id")
def rn5_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendering.unified_rows(corpus.hunks(spark, sf_dir), corpus.file_lines(spark, sf_dir))
    selection = corpus.table(spark, sf_dir, "documents").select("doc_id", F.lit(4).alias("from_line"), F.lit(9).alias("to_line"))
    return rendering.scope(selection, rendering.changed_span(rows))


@query("""with s as (select *, line_no > lag(line_no) over (partition by doc_id order by line_no) + 1 as cut from c_rows where line_no between 2 and 27), x as (select doc_id, line_no as ord, 1 as p, type, line_no from s union all select doc_id, line_no, 0, 'gap', null from s where cut)
select doc_id, row_number() over (partition by doc_id order by ord, p) as row_no, type, line_no from x""")
def rn4_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendering.unified_rows(corpus.hunks(spark, sf_dir), corpus.file_lines(spark, sf_dir))
    selection = corpus.table(spark, sf_dir, "documents").select("doc_id", F.lit(5).alias("from_line"), F.lit(24).alias("to_line"))
    return rendering.slice_rows(rows, selection)


@query("select doc_id, string_agg(case when r.type = 'add' then '+' || l.text when r.type = 'gap' then '…' else ' ' || l.text end, chr(10) order by r.row_no) as diff from c_rows r left join c_lines l using (doc_id, line_no) group by doc_id")
def rn3_diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.diff_text(rendering.unified_rows(corpus.hunks(spark, sf_dir), corpus.file_lines(spark, sf_dir)))


# ---- file order (OR-12), fingerprints of all kinds (FR-1)

FIXTURE |= {
    "f_edges": "f_edges as (select distinct f.range_id, x.src, x.dst from (select doc_id as src, to_doc as dst from c_pairs union all select to_doc, doc_id from c_pairs where (doc_id + to_doc) % 4 = 0) x join c_files f on f.doc_id = x.src where src % 19 > 0 and dst % 19 > 0)",
    "f_reach": "f_reach as (select range_id, src, dst from f_edges union select r.range_id, r.src, e.dst from f_reach r join f_edges e on e.range_id = r.range_id and e.src = r.dst)",
    "f_files": f"f_files as (select *, doc_id % 10 in (5, 7) as low, {_TEST} as test from c_files)",
}


@query("""select e.range_id, e.src, e.dst, case when r.src is not null then 'cycle' when a.test and not b.test then 'test-order' else 'inversion' end as category
from f_edges e join f_files a on a.doc_id = e.src join f_files b on b.doc_id = e.dst left join f_reach r on r.range_id = e.range_id and r.src = e.dst and r.dst = e.src where a.file_no < b.file_no and not a.low and not b.low""")
def or12_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR-12: files in their own order; every nineteenth is a leftover, generated ones and lockfiles are low-signal."""
    f = corpus.files(spark, sf_dir)
    pairs = _pairs(spark, sf_dir).select(F.col("doc_id").alias("src"), F.col("to_doc").alias("dst"))
    both = pairs.unionByName(pairs.where("(src + dst) % 4 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = both.join(f.select("range_id", F.col("doc_id").alias("src")), "src")
    files = f.select("range_id", F.col("doc_id").alias("file"), F.col("file_no").alias("pos"), (F.col("doc_id") % 19 == 0).alias("leftover"), (F.col("doc_id") % 10).isin(5, 7).alias("low_signal"), paths.is_test(F.col("path")).alias("is_test"))
    return checks.file_order(edges, files)


FIXTURE["k_rows"] = "k_rows as (select doc_id // 40 as range_id, md5(cast(doc_id // 40 as varchar)) as head, doc_id % 5 as section_no, 's' || doc_id % 5 as section, doc_id as chunk, doc_id % 3 as test from documents)"
FIXTURE["k_sections"] = "k_sections as (select range_id, head, section_no, section, string_agg(chunk, chr(10) order by chunk desc) as chunks, md5(concat_ws(chr(10), head, '7', section, string_agg(chunk, chr(10) order by chunk desc))) as fingerprint from k_rows group by range_id, head, section_no, section)"


@query("""select distinct range_id, 'graph' as kind, '' as key, md5(head || chr(10) || '7') as fingerprint from k_rows
union all select range_id, kind, cast(chunk as varchar), md5(concat_ws(chr(10), head, '7', chunk)) from k_rows, (select unnest(['context', 'chunk']) as kind)
union all select range_id, 'section', section, fingerprint from k_sections
union all select range_id, 'opener', '', md5(string_agg(distinct fingerprint, chr(10) order by fingerprint)) from k_sections group by range_id
union all select range_id, 'book', '', md5(concat_ws(chr(10), any_value(head), '7', string_agg(section || chr(10) || chunks, chr(10) order by section_no))) from k_sections group by range_id
union all select range_id, 'chapter', '', md5(concat_ws(chr(10), any_value(head), '7', 'chapter', string_agg('|' || chr(10) || chunks, chr(10) order by section_no))) from (select range_id, any_value(head) as head, section_no, string_agg(chunk, chr(10) order by chunk desc) as chunks from k_rows where test > 0 group by range_id, section_no) group by range_id""")
def fr1_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-1: the seven kinds; sections run backwards through a range's documents, every third document is a test."""
    i = F.col("doc_id")
    d = corpus.table(spark, sf_dir, "documents").select(F.expr("doc_id div 40").alias("range_id"), (i % 5).alias("section_no"), (-i).alias("pos"), i.alias("chunk"), (i % 3).alias("test"))
    heads = d.select("range_id", F.md5(F.col("range_id").cast("string")).alias("head")).distinct()
    sections = d.withColumn("section", F.concat(F.lit("s"), F.col("section_no").cast("string")))
    return freshness.fingerprints(heads, sections.drop("test"), d.where("test > 0").select("range_id", F.col("section_no").alias("chapter_no"), "pos", "chunk"), "7")
