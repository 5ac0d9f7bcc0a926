"""Secret scans over a trigram index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams of the lower-cased text: an OR of clauses, each an AND
of trigrams that any match must hold. The documents' postings for the queries' trigrams are intersected clause by clause;
only documents left for a rule are scanned for it. Rules without mandatory trigrams scan every document.

A null text is empty. Rows are told apart by id and text, so repeated rows each get their (equal) result, null ids too.
An empty table gives an empty result; columns other than doc_id and text aren't touched.
"""

from __future__ import annotations

import re._constants as op
import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A match counts if its group `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Kinds, patterns and lengths. Of access and hex the length stands in the pattern: a shorter run can hold no match.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
#: Larger character classes end a run of known characters; more alternatives give no query.
CLASS_MOST, ALTERNATIVES_MOST = 8, 256


def trigram_clauses(pattern: str) -> list[frozenset[str]] | None:
    """The OR of ANDs of trigrams that every match of the pattern holds in lower case; None: no query, scan everything."""

    def closed(alts):
        return {(grams | {run[i : i + 3] for i in range(len(run) - 2)}, "") for grams, run in alts}

    def chars(items):
        out = set()
        for kind, value in items:
            if kind is op.LITERAL:
                out.add(chr(value).lower())
            elif kind is op.RANGE and value[1] - value[0] < CLASS_MOST:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= CLASS_MOST else None

    def after(alts, parsed):
        for kind, value in parsed:
            if kind is op.LITERAL:
                alts = {(grams, run + chr(value).lower()) for grams, run in alts}
            elif kind is op.IN and (found := chars(value)):
                alts = {(grams, run + c) for grams, run in alts for c in found}
            elif kind is op.SUBPATTERN:
                alts = after(alts, value[-1])
            elif kind is op.BRANCH:
                alts = set().union(*(after(alts, branch) for branch in value[1]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                low, high, inner = value
                for _ in range(min(low, 3)):
                    alts = after(alts, inner)
                if low == 0 and high == 1:
                    alts = alts | after(alts, inner)
                elif high != low or low > 3:
                    alts = closed(alts)
            elif kind is not op.AT:
                alts = closed(alts)
            if len(alts) > ALTERNATIVES_MOST:
                alts = closed(alts)
        return alts

    found = {frozenset(grams) for grams, _ in closed(after({(frozenset(), "")}, regex_parser.parse(pattern)))}
    if frozenset() in found or len(found) > ALTERNATIVES_MOST:
        return None
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def row_key(text: Column) -> dict[str, Column]:
    return {"k_id": F.col("doc_id"), "k_hash": F.xxhash64(text), "k_len": F.length(text)}


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """gram, k_id, k_hash, k_len: which rows' lower-cased text holds which of the given trigrams."""
    keyed = docs.select(*[c.alias(n) for n, c in row_key(F.col("text")).items()], F.lower("text").alias("low"))
    present = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    return keyed.select(F.explode(present).alias("gram"), "k_id", "k_hash", "k_len")


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """k_id, k_hash, k_len, kinds: the rules with a query of which some clause's trigrams are all there."""
    clauses = [(f"{r.kind}#{i}", r.kind, g, len(c)) for r in rules for i, c in enumerate(trigram_clauses(r.pattern) or ()) for g in sorted(c)]
    grams = sorted({c[2] for c in clauses})
    # the clauses come from the rules alone, some hundred rows at most
    table = docs.sparkSession.createDataFrame(clauses, "clause string, kind string, gram string, need int")
    hits = postings(docs, grams).join(F.broadcast(table), "gram")
    met = hits.groupBy("k_id", "k_hash", "k_len", "kind", "clause", "need").agg(F.count_distinct("gram").alias("n")).where("n = need")
    return met.groupBy("k_id", "k_hash", "k_len").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end, kind) of the rule's leftmost non-overlapping matches, in code points.

    What stands between the matches gives their places: lengths of gaps and matches are summed in a fold.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.zip_with(found, tested, lambda m, g: F.struct(F.length(m).alias("n"), (F.length(g) >= rule.least).alias("ok")))
    parts = F.zip_with(parts, F.slice(gaps, F.lit(1), F.size(found)), lambda p, gap: F.struct(F.length(gap).alias("gap"), p["n"].alias("n"), p["ok"].alias("ok")))
    empty = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")

    def step(acc, p):
        start = acc["at"] + p["gap"]
        end = start + p["n"]
        one = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(p["ok"], F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _scanned(docs: DataFrame, rules) -> DataFrame:
    """row (docs' columns as one struct, so that no name of theirs can clash) and secret_spans of every row."""
    d = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in row_key(F.col("text")).items()])
    c = candidates(docs, rules).withColumnsRenamed({k: f"c_{k[2:]}" for k in ("k_id", "k_hash", "k_len")})
    same = [d[f"k_{x}"].eqNullSafe(c[f"c_{x}"]) for x in ("id", "hash", "len")]
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    each = [F.when(F.array_contains("kinds", r.kind) if trigram_clauses(r.pattern) else text.rlike(r.pattern), spans(text, r, i)).otherwise(none) for i, r in enumerate(rules)]
    found = F.sort_array(F.concat(*[F.coalesce(x, none) for x in each]))
    return d.join(c, same, "left").select("row", found.alias("secret_spans"))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Every row of docs with `secret_spans`: array of (start, number, end, kind), by start and then rule. All columns are kept but one of that name."""
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "secret_spans"]
    return _scanned(docs, rules).select(*kept, "secret_spans")


def digest_columns(found: DataFrame, rules=RULES) -> DataFrame:
    base = [r.kind for r in rules if r.base]
    say = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    joined = F.array_join(F.transform(F.filter("secret_spans", lambda s: s["kind"].isin(base)), say), ",")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined, 256).alias("base_sha256"), F.array_join(F.transform("secret_spans", say), ",").alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", rules=RULES) -> DataFrame:
    """docs with each stretch of overlapping spans in `text` replaced by the mask; all other columns and rows as they are."""
    own = F.col("row")["text"]
    text = F.coalesce(own, F.lit(""))

    def step(acc, s):
        start = F.greatest(acc["at"], s["start"])
        gap = F.substring(text, acc["at"] + 1, start - acc["at"])
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    masked = F.when(F.size("secret_spans") > 0, done).otherwise(own)
    return _scanned(docs, rules).select(*[(masked if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
