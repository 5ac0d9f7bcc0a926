"""Registered queries of order checks, edge counts and overlay freshness, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difflens.catalog import FIXTURE, query
from difflens.catalog_story import _Book, _edges, _layers, _nodes, _sections
from difflens.operators import checks, freshness, graph
from difflens.sources import corpus, stored
from difflens.sources.scratch import shared_path


@query("select kind, count(*) as n from (select distinct range_id, src, dst, kind from c_edges where src <> dst) group by kind")
def gr12_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.edge_counts(corpus.edges(spark, sf_dir))


FIXTURE |= _layers("o13", "select range_id, src as a, dst as b from s_edges where kind = 'calls'")
FIXTURE["o13_modes"] = "o13_modes as (select * from (values ('consumer-first', 'before'), ('dependency-first', 'after'), ('consumer-first', 'end')) m(direction, placement))"


@query(f"""with p as (select range_id, chunk, pos from {_sections("before")}) select m.direction, m.placement, e.range_id, e.kind, e.src, e.dst, case when x.a is not null and y.a is not null then 'cycle' when e.kind = 'calls' then 'inversion' else 'test-order' end as category
from (select distinct range_id, kind, src, dst from s_edges where src <> dst and kind in ('calls', 'exercises') and src % 8 <> 6 and dst % 8 <> 6) e cross join o13_modes m
join p a on a.range_id = e.range_id and a.chunk = e.src join p b on b.range_id = e.range_id and b.chunk = e.dst
left join o13_path x on x.range_id = e.range_id and x.a = e.src and x.b = e.dst left join o13_path y on y.range_id = e.range_id and y.a = e.dst and y.b = e.src
where case when e.kind = 'calls' then (a.pos > b.pos) = (m.direction = 'consumer-first') else m.placement <> 'end' and e.src % 8 in (2, 5) and e.dst % 8 not in (2, 5) and (a.pos > b.pos) = (m.placement = 'before') end""")
def or13_chapter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR-13: the book with tests before, held against three configurations."""
    b, e = _Book(spark, sf_dir), _edges(spark, sf_dir)
    positions = b.sections(b.chapters(b.spine())).groupBy("range_id", "chunk").agg(F.min("pos").alias("pos"))
    nodes = _nodes(e).select("range_id", "chunk", (F.col("bucket") == "test").alias("is_test"), (F.col("bucket") == "low-signal").alias("low_signal"))
    sccs = graph.strong(e.where("kind = 'calls'"))
    return checks.chapter_order(e, positions, nodes, sccs, [("consumer-first", "before"), ("dependency-first", "after"), ("consumer-first", "end")])


_D = "(select doc_id, doc_id // 10 as book, 1 + doc_id // 10 % 2 as version, md5(coalesce(text, '')) as fingerprint from documents)"


@query(f"""select book, version, coalesce(list(doc_id order by doc_id) filter (where doc_id % 7 > 0 and doc_id % 3 > 0), []) as entries, case when version = 1 then md5(book || case when book % 4 = 0 then 'moved' else '' end) end as opener_key, case when version = 1 then case when book % 4 = 0 then '' else 'opener ' || book end end as opener from {_D} group by book, version""")
def fr3_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-3: documents are sections (or, of version 2, chunks) of books of ten; of seven one has another key now, of three one another text; of four books one has another opener."""
    d, book = corpus.table(spark, sf_dir, "documents"), F.expr("doc_id div 10")
    live = d.select(book.alias("book"), F.when(F.col("doc_id") % 7 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"))
    entries = d.select(book.alias("book"), F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.md5(F.coalesce("text", F.lit("")))).alias("fingerprint"))
    name = F.col("book").cast("string")
    every = d.select(book.alias("book")).distinct()
    stored = every.select("book", (1 + F.col("book") % 2).alias("version"), F.md5(name).alias("opener_key"), F.concat(F.lit("opener "), name).alias("opener"))
    openers = every.select("book", F.md5(F.concat(name, F.when(F.col("book") % 4 == 0, "moved").otherwise(""))).alias("live_key"))
    return checks.fresh_narration(stored, entries, live, openers)


@query("select distinct range_id, src, dst, kind from c_edges where src <> dst and range_id % 5 > 0 and range_id % 3 > 0")
def fr4_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-4: of five stores one is of another version, of three one of another head."""
    e, key = corpus.edges(spark, sf_dir), F.col("range_id")
    edges = e.where("src <> dst").select(*graph.KEYS, "kind").distinct()
    live = edges.select("range_id", F.md5(key.cast("string")).alias("fingerprint")).distinct()
    stores = live.select("range_id", F.when(key % 5 == 0, 2).otherwise(1).alias("version"), F.when(key % 3 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return checks.fresh_graph(edges, stores, live)


@query("""with g as (select range_id, src, dst, kind, count(*) as n, max(line) as last_line from c_edges where src <> dst and (range_id % 3 = 0 or range_id % 5 = 0 or line > 1) group by all) select range_id, src, dst, kind, n, last_line, case when range_id % 3 = 0 or range_id % 5 = 0 then 2 else 1 end as run from g where range_id % 7 > 0""")
def fr4_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-1, FR-4: stored graphs follow their ranges' heads. A first run stores the graphs of edges past the first line, without every fifth range. In
    the second, every third range has another head, every fifth is new, every seventh is gone; run tells which run built an edge."""
    e, i = corpus.edges(spark, sf_dir), F.col("range_id")
    ranges, path = e.select("range_id").distinct(), shared_path(spark, "graphs")

    def run(no: int, live: DataFrame, edges: DataFrame) -> DataFrame:
        heads = live.select("range_id", F.concat_ws(":", i.cast("string"), F.when((i % 3 == 0) & F.lit(no > 1), "moved")).alias("head"))
        prints = heads.select("range_id", F.lit("graph").alias("kind"), freshness.graph_print(F.col("head"), "7").alias("fingerprint"))
        count = lambda stale: edges.where("src <> dst").join(stale, "range_id", "left_semi").groupBy(*graph.KEYS, "kind").agg(F.count("*").alias("n"), F.max("line").alias("last_line"), F.lit(no).alias("run"))
        return stored.refresh_graph(spark, path, prints, count, "src long, dst long, kind string, n long, last_line int, run int", parts=16)

    run(1, ranges.where(i % 5 > 0), e.where("line > 1"))
    return run(2, ranges.where(i % 7 > 0), e)


@query("select range_id, mode, version, fresh and (mode = 'chapter') = (version = 2) as fresh from (select distinct range_id, case when range_id % 2 = 1 then 'chapter' else 'file' end as mode, 1 + range_id // 2 % 2 as version, range_id % 5 > 0 as fresh from c_files)")
def fr5_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-5: odd ranges show chapters, others files; every second pair of ranges has overlays of version 2; of five ranges one has changed."""
    books, key = freshness.set_fingerprint(corpus.files(spark, sf_dir), ["range_id"], "path"), F.col("range_id")
    chapter = key % 2 == 1
    version, stored = 1 + F.expr("range_id div 2") % 2, F.when(key % 5 == 0, "old").otherwise(F.col("fingerprint"))
    fresh = checks.overlay_fresh(version, stored, F.when(~chapter, F.col("fingerprint")), F.when(chapter, F.col("fingerprint")))
    return books.select("range_id", F.when(chapter, "chapter").otherwise("file").alias("mode"), version.alias("version"), fresh.alias("fresh"))


@query("select range_id, path, md5('unit:' || string_agg(fingerprint, '|' order by fingerprint)) as fingerprint from (select range_id, path, md5(range_id || '/' || chunk) as fingerprint from s_nodes) group by range_id, path")
def fr8_unit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-8: of each file of a range, from its chunks' fingerprints."""
    n = _nodes(_edges(spark, sf_dir))
    members = n.select("range_id", "path", F.md5(F.concat_ws("/", F.col("range_id").cast("string"), F.col("chunk").cast("string"))).alias("member"))
    return checks.unit_fingerprints(members, ["range_id", "path"], "member")
