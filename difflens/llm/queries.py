"""The registered queries of the training-data operators and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lm, ngram_jaccard, packing, periodic, pieces, quality_eb, quality_rules, repair, secret_scan, toxicity, warc
from .common import ASCII_LOWER, ASCII_UPPER, crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is(mod: int, rest: int):
    """Whether crc32 of the id is `rest` modulo mod; false for a null id."""
    return F.coalesce(crc_mod(F.col("doc_id"), mod) == rest, F.lit(False))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"), n=4, pct=85)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), pieces.load())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~_is(3, 1)))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", _is(3, 1).alias("held_out"), "lang_pred", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_eb.quality(docs, labels, host=F.col("source"), path=F.concat_ws("/", "source", "lang"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~_is(3, 1))
    return found.select("doc_id", _is(3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.lm_scores(_table(spark, sf_dir, "documents"), ~_is(10, 0))
    return found.select("doc_id", _is(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "words")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.planted(_table(spark, sf_dir, "documents"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(*repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return packed.pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (op1_ngram_jaccard, op2_sentencepiece, op3_language_id, op4_quality_classifier, op5_quality_rules, op6_toxicity, op7_secret_scans, op8_warc, op9_lm_scoring, op10_decontamination, op11_periodic_runs, op12_conversation_repair, op13_best_fit_packing, pipeline)
    return {f.__name__: f for f in every}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _op1_sql() -> str:
    return rf"""
with recursive d as (select row_number() over (order by doc_id) as rid, doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}')")} as w from documents),
s as (select distinct rid, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[p : p + 3], ' ') end as g
      from (select rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as p from d where len(w) > 0)),
n as (select rid, count(*) as n from s group by rid),
pair as (select a.rid as x, b.rid as y, count(*) as i from s a join s b on a.g = b.g and a.rid < b.rid group by 1, 2),
link as (select x, y from pair join n na on na.rid = x join n nb on nb.rid = y where 100 * i >= 85 * (na.n + nb.n - i)),
edge as (select x, y from link union select y, x from link),
reach(rid, other) as (select rid, rid from d union select r.rid, e.y from reach r join edge e on e.x = r.other)
select d.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(o.doc_id) as component_id
from d left join n using (rid) join reach r on r.rid = d.rid join d o on o.rid = r.other group by d.rid, d.doc_id"""


def _op5_sql() -> str:
    a, delta = quality_rules.ALPHA, quality_rules.DELTA
    grid = " union all ".join(f"select rid, stratum, '{r}' as rule, cast({c} as double) as cutoff, cast({e} > {c} as int) as hit from b where good" for r, (e, cs) in quality_rules.RULES.items() for c in cs)
    fires = " or ".join(f"coalesce({e} > (select cutoff from taken t where t.stratum = b.stratum and t.rule = '{r}'), false)" for r, (e, _) in quality_rules.RULES.items())
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (select *, {_WORDS.format("t")} as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] as g from (select rid, ws, unnest(range(1, len(ws) - 1)) as p from w where len(ws) > 2)),
again as (select rid, g from win group by rid, g having count(*) > 1),
cover as (select rid, count(distinct q) as n from (select rid, unnest([p, p + 1, p + 2]) as q from win semi join again using (rid, g)) group by rid),
m as (select rid, doc_id, stratum, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  cast(coalesce(cover.n, 0) as bigint) as n_repeat_words, len(ls) as n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_upper,
  length(t) - length(replace(t, '!', '')) as n_exclaim from w left join cover using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and doc_id in (select doc_id from labels where quality = 1) as good from m),
hits as ({grid}),
counts as (select stratum, rule, cutoff, count(*) as n, sum(hit) as k from hits group by all),
tests as (select *, case when k < n * {a} then (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln(1 - {a}))) from (select unnest(range(0, cast(k as bigint) + 1)) as i)) else 1 end as p from counts),
ranked as (select *, row_number() over (order by p, stratum, rule, cutoff) as i, count(*) over () as m from tests),
holm as (select *, max(cast(p > {delta} / (m - i + 1) as int)) over (order by p, stratum, rule, cutoff) as failed from ranked),
taken as (select stratum, rule, min(cutoff) as cutoff from holm where failed = 0 group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({fires}) as kept from b"""


def _op7_sql() -> str:
    parts = []
    for number, r in enumerate(secret_scan.RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(
            f"select rid, '{r.kind}' as kind, {number} as number, {str(r.base).lower()} as base, s, s + length(m[i]) as e from (select rid, i, m, g, cast(list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) as bigint) as s "
            f"from (select *, unnest(range(1, len(m) + 1)) as i from (select rid, string_split_regex(t, {p}) as gaps, regexp_extract_all(t, {p}) as m, regexp_extract_all(t, {p}, {r.group}) as g from d))) where length(g[i]) >= {r.least}"
        )
    say = "kind || ':' || s || ':' || e"
    count = lambda k: f"cast(count(*) filter (kind = '{k}') as bigint) as n_{k}"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(parts)})
select d.doc_id, {count("assign")}, {count("access")}, {count("hex")},
  sha256(coalesce(string_agg({say}, ',' order by s, number, e) filter (base), '')) as base_sha256,
  coalesce(string_agg({say}, ',' order by s, number, e) filter (kind is not null), '') as spans
from d left join f using (rid) group by d.rid, d.doc_id"""


def _op8_sql() -> str:
    return f"""
with p as (select page_id, sha1(coalesce(html, '')) as digest, octet_length(encode(coalesce(html, ''))) as n from pages),
g as (select digest, max(page_id) as first_id from p where n >= {warc.LEAST} group by digest)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
  case when g.first_id is null or p.page_id = g.first_id then 'response' else 'revisit' end as record_type,
  case when p.page_id <> g.first_id then g.first_id end as refers_to
from p left join g on p.digest = g.digest and p.n >= {warc.LEAST}"""


#: crc32 of a text of single bytes, by the table of its polynomial.
_CRC_TABLE = """bits(i, k, v) as (select i, 0, i from (select unnest(range(256))::bigint as i) union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) as tab from bits where k = 8)"""


def _crc(text: str) -> str:
    """Over rows joined with crc."""
    codes = f"list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint)::bigint"


def _op11_sql() -> str:
    return rf"""
with recursive {_CRC_TABLE},
d as (select *, cast(len(w0) as bigint) as n from (select row_number() over () as rid, doc_id, {_WORDS.format("coalesce(text, '')")} as w0, {_crc("cast(doc_id as varchar)")} as h from documents, crc)),
p as (select *, h % 10 = 0 and n > 0 as plant, case when n > 0 then h // 10 % n end as a from d),
v as (select rid, doc_id, case when plant then list_transform(range(n), lambda i: w0[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + h // 10 % 8)) end + 1]) else w0 end as w from p),
t as (select rid, unnest(w) as word, unnest(range(len(w))) as i from v),
six as (select rid, i, array_to_string(w[i + 1 : i + 6], ' ') as g from (select rid, w, unnest(range(len(w) - 5)) as i from v where len(w) >= 12)),
diagonal as (select a.rid, b.i - a.i as q, a.i from six a join six b on a.rid = b.rid and a.g = b.g and a.i < b.i),
island as (select rid, q, min(i) as s, max(i) + 6 + q as e from (select *, i - row_number() over (partition by rid, q order by i) as k from diagonal) group by rid, q, k),
run as (select rid, s, e, min(q) as q from island where e - s >= greatest(12, 2 * q) group by rid, s, e),
says as (select rid, count(*) as n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' order by s, q) as runs from run group by rid),
best as (select rid, s, e - s as n, q from run qualify row_number() over (partition by rid order by e - s desc, s, q) = 1),
gone as (select distinct rid, unnest(range(s + q, e)) as i from run),
kept as (select rid, string_agg(word, ' ' order by i) as words from t anti join gone using (rid, i) group by rid)
select doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(best.s as bigint) as start, cast(best.n as bigint) as length, cast(best.q as bigint) as period,
  cast(1000 * best.n // best.q as bigint) as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from v left join says using (rid) left join best using (rid) left join kept using (rid)"""


def _op12_sql() -> str:
    return rf"""
with recursive {_CRC_TABLE},
c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k from conversations, crc),
ids as (select row_number() over () as cid, conv_id from (select distinct conv_id from conversations)),
harm as (select cid, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy from c join ids on ids.conv_id is not distinct from c.conv_id),
marked as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ends, left(role, 1) as first,
  row_number() over (partition by cid order by turn nulls first, role, sha256(text), copy) as p,
  row_number() over (partition by cid, role, text order by turn nulls first, copy) > 1 as again from harm),
row as (select *, case when ends = '' then 'blank' when again then 'duplicate' when right(ends, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
  lag(first) over (partition by cid order by p) as before from marked),
lead(role, i, j) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
extra(i, j, cost, audit, said) as (values (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
  (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (3, 3, 10, 'II', ['user:', 'assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:'])),
edit as (select cid, p, i, i as j, 2 as cost, 'D' as audit, []::varchar[] as said from row, (select unnest(range(4)) as i)
  union all select cid, p, i, j, (first <> lead.role)::int + 5 * (fault = 'truncated')::int, case when first = lead.role then 'K' else 'R' end,
    [case when first = lead.role then row.role when lead.role = 'u' then 'user' else 'assistant' end || ':' || text]
  from row, lead where fault in ('', 'truncated') and (first = lead.role or lead.role <> 's')),
way(cid, p, i, cost, audit, said) as (select cid, cast(0 as bigint), 0, 0, '', []::varchar[] from ids
  union all select cid, p, j, cost, audit, said from (select w.cid, e.p, e.j, w.cost + x.cost + e.cost as cost, w.audit || x.audit || e.audit as audit, w.said || x.said || e.said as said
    from way w join extra x on x.i = w.i join edit e on e.cid = w.cid and e.p = w.p + 1 and e.i = x.j) qualify row_number() over (partition by cid, j order by cost, audit) = 1),
done as (select w.cid, w.cost + x.cost as cost, w.audit || x.audit as audit, w.said || x.said as said from way w join extra x on x.i = w.i and x.j in (0, 3)
  where w.p = (select count(*) from row where row.cid = w.cid) qualify row_number() over (partition by w.cid order by w.cost + x.cost, w.audit || x.audit) = 1),
counts as (select cid, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || first not in ('su', 'ua', 'au')) as illegal from row group by cid)
select conv_id, {", ".join(f"cast(coalesce({x}, 0) as bigint) as {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))}, audit, sha256(array_to_string(said, chr(10))) as repaired_sha256
from ids join done using (cid) left join counts using (cid)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": _op1_sql(), "op5_quality_rules": _op5_sql(), "op7_secret_scans": _op7_sql(), "op8_warc": _op8_sql(), "op11_periodic_runs": _op11_sql(), "op12_conversation_repair": _op12_sql()}
