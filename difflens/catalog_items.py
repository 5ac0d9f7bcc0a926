"""Registered queries of titles, ids, reply checks, decisions and guards, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from difflens.catalog import query
from difflens.operators import items
from difflens.sources import corpus


def _title_parts() -> tuple:
    """An order as a chunk: its number, symbol path and file."""
    key = F.col("o_orderkey")
    path = F.when(key % 3 == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(F.array().cast("array<string>"))
    return key, path, F.concat(F.lit("src/f"), key.cast("string"), F.lit(".ts"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then o_orderstatus || '.' || o_orderpriority when o_orderkey % 3 = 1 then 'lines ' || o_custkey || '–' || (o_custkey + o_orderkey % 9) else 'src/f' || o_orderkey || '.ts' end as title from orders")
def sc7_chunk_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-7."""
    key, path, file = _title_parts()
    start = F.when(key % 3 == 1, F.col("o_custkey"))
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", items.chunk_title(path, start, start + key % 9, file).alias("title"))


@query("select o_orderkey, 'src/f' || o_orderkey || '.ts::' || case when o_orderkey % 3 = 0 then o_orderstatus || '.' || o_orderpriority else '' end || '::' || printf('%x', o_custkey) as chunk_id from orders")
def sc10_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-10."""
    _, path, file = _title_parts()
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", items.chunk_id(file, path, F.lower(F.hex("o_custkey"))).alias("chunk_id"))


@query("select event_id, case when event_id % 9 = 0 then 0 else cast(greatest(0, epoch(timestamp '2024-01-15 00:00:00') - epoch(date_trunc('second', ts))) as bigint) end as seconds from events")
def sc17_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-17: some creation times are no times, some lie after now."""
    created = F.when(F.col("event_id") % 9 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return corpus.table(spark, sf_dir, "events").select("event_id", items.elapsed_seconds(created, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("seconds"))


@query("select event_id, case when event_id % 5 < 2 then user_id end as input_tokens, case when event_id % 5 < 2 then event_id end as output_tokens, case when event_id % 5 = 0 then 0.25 end as cost from events")
def sc19_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-19: envelopes with and without cost, without a count, with a count as text, and broken ones."""
    i = F.col("event_id") % 5
    form = F.when(i == 0, '{"usage":{"input_tokens":%d,"output_tokens":%d},"total_cost_usd":0.25}').when(i == 1, '{"usage":{"input_tokens":%d,"output_tokens":%d},"total_cost_usd":"x"}')
    form = form.when(i == 2, '{"usage":{"input_tokens":%d},"n":%d}').when(i == 3, '{"usage":{"input_tokens":"%d","output_tokens":%d}}').otherwise('{"usage":%d,%d')
    d = corpus.table(spark, sf_dir, "events").select("event_id", items.usage(F.call_function("format_string", form, F.col("user_id"), F.col("event_id"))).alias("u"))
    return d.select("event_id", "u.input_tokens", "u.output_tokens", "u.cost")


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then 'none' when o_orderkey % 5 = 0 then 'apply' when o_orderkey % 7 = 0 then 'none'
 when o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') then 'offer' else 'apply' end as decision from orders""")
def sc21_order_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-21: a range is an order, its chunks the lines; a returned line is reviewed."""
    seen = corpus.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("started"))
    d = corpus.table(spark, sf_dir, "orders").select("o_orderkey").join(seen, "o_orderkey", "left")
    key = F.col("o_orderkey")
    return d.select("o_orderkey", items.order_decision(key % 4 > 0, key % 5 == 0, key % 7 == 0, F.col("started")).alias("decision"))


@query("select event_id, case when event_id % 2 = 0 and event_type <> 'click' then 'auto' when event_type = 'click' then 'reviewed' when event_type = 'view' then 'seen' else 'unseen' end as glyph from events")
def sc23_glyph_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-23."""
    state = F.when(F.col("event_type") == "click", "reviewed").when(F.col("event_type") == "view", "seen")
    return corpus.table(spark, sf_dir, "events").select("event_id", items.glyph_class(state, F.col("event_id") % 2 == 0).alias("glyph"))


@query("select doc_id, '(binary)' as title, 'other' as kind, 1 as chunks from documents where doc_id % 10 = 6 union all select doc_id, 'hunks' as title, 'text' as kind, count(*) as chunks from c_hunks where doc_id % 10 <> 6 group by doc_id")
def ch12_binary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH-12: a binary file (here the .po ones) is one chunk, whatever its hunks; a text file without hunks has none."""
    binary = corpus.files(spark, sf_dir).where(F.col("path").endswith(".po")).select("doc_id", F.lit("(binary)").alias("title"), F.lit("other").alias("kind"), F.lit(1).cast("long").alias("chunks"))
    rest = corpus.hunks(spark, sf_dir).join(binary.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return binary.unionByName(rest.select("doc_id", F.lit("hunks").alias("title"), F.lit("text").alias("kind"), "chunks"))


@query("""with b as (select conv_id as batch, turn, 'c' || row_number() over (partition by conv_id order by turn, text) as alias from conversations),
 r as (select conv_id as batch, 'c' || (turn + case when conv_id % 6 = 0 then 40 else 1 end) as alias, conv_id % 5 = 0 and turn = 0 as odd from conversations)
select r.batch, bool_and(b.alias is not null and not odd) as ok, count(distinct b.turn) filter (b.alias is not null) as entries from r left join (select distinct batch, alias, turn from b) b on b.batch = r.batch and b.alias = r.alias group by r.batch""")
def jn21_alias_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-21: chunks of a batch by alias; a reply with an alias that the batch lacks, or a field that is no string, is rejected whole."""
    d = corpus.table(spark, sf_dir, "conversations")
    order = Window.partitionBy("batch").orderBy("turn", "text")
    batches = d.select(F.col("conv_id").alias("batch"), "turn", "text").withColumn("alias", F.concat(F.lit("c"), F.row_number().over(order).cast("string")))
    replies = d.select(F.col("conv_id").alias("batch"), F.concat(F.lit("c"), (F.col("turn") + F.when(F.col("conv_id") % 6 == 0, 40).otherwise(1)).cast("string")).alias("alias"), ((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0)).alias("odd"))
    met = replies.join(batches.select("batch", "alias", "turn"), ["batch", "alias"], "left")
    return met.groupBy("batch").agg(F.bool_and(F.col("turn").isNotNull() & ~F.col("odd")).alias("ok"), F.count_distinct("turn").alias("entries"))


@query("""select event_id, case when event_id % 6 = 0 then 'no object' when event_id % 6 = 1 then 'no intro' when event_id % 6 = 2 then 'no chunks object'
 when event_id % 6 = 3 then case when user_id % 2 = 0 then 'unknown chunk' end when event_id % 6 = 4 then 'line is no string' end as error from events""")
def se5_reply_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE-5."""
    i = F.col("event_id") % 6
    form = F.when(i == 0, "[%d]").when(i == 1, '{"intro":%d}').when(i == 2, '{"intro":"a","chunks":[%d]}').when(i == 3, '{"intro":"a","chunks":{"c%d":"x"}}').when(i == 4, '{"intro":"a","chunks":{"c1":%d}}').otherwise('{"intro":"a%d"}')
    reply = F.call_function("format_string", form, F.when(i == 3, F.col("user_id") % 2).otherwise(F.col("user_id")))
    return corpus.table(spark, sf_dir, "events").select("event_id", items.reply_error(reply, F.array(F.lit("c1"))).alias("error"))


@query("""select range_id, chunk, min(event_id) as first_at from (select user_id % 20 as range_id, k as chunk, event_id from c_events where event_type <> 'error' and k % 7 <> 0) group by all""")
def fr12_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-12: chunks outside the leftovers (here errors) and not of low signal, once each, by their first place."""
    d = corpus.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("range_id"), F.get_json_object("props", "$.k").cast("int").alias("chunk"), "event_id", "event_type")
    return d.where((F.col("event_type") != "error") & (F.col("chunk") % 7 != 0)).groupBy("range_id", "chunk").agg(F.min("event_id").alias("first_at"))


@query("select source, lang, cast(ceil(sum(length(text)) / 4) as bigint) as tokens, count(*) as items, ceil(sum(length(text)) / 4) > 32000 as too_large, count(*) < 3 as too_few from documents group by all")
def fr16_manifest_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FR-16: a manifest of too many tokens or too few items is refused."""
    d = corpus.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.ceil(F.sum(F.length("text")) / 4).alias("tokens"), F.count("*").alias("items"))
    return d.withColumns({"too_large": F.col("tokens") > items.MOST_TOKENS, "too_few": F.col("items") < items.FEWEST_ITEMS})
