"""Column expressions over texts: digests, gates, scores, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that a generated note may not hold, placeholder badges, and the caps by kind (characters, sentences).
BANNED = ("as expected", "clean refactor", "correctly", "elegant", "just a", "looks good", "no issues", "perfect", "safe to", "simply", "trivial")
PLACEHOLDERS = ("misc", "n/a", "na", "no change", "none", "nothing", "other")
CAPS = {"opener": (320, 3), "section": (200, 2), "chunk": (110, 1)}
MOST_WORDS = 22


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 code units, in base 36."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("bigint"))
    h = F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def salvage(texts: DataFrame) -> DataFrame:
    """section, kept (keys of passing texts, in order), dropped (`key: checks`, in order). texts: section, seq, key, failures.

    A text fails alone: the section keeps its other ones.
    """
    bad = F.concat("key", F.lit(": "), F.array_join("failures", ","))
    rows = F.array_sort(F.collect_list(F.struct("seq", "key", F.when(F.size("failures") > 0, bad).alias("bad"))))
    g = texts.groupBy("section").agg(rows.alias("rows"))
    return g.select("section", F.transform(F.filter("rows", lambda r: r["bad"].isNull()), lambda r: r["key"]).alias("kept"), F.transform(F.filter("rows", lambda r: r["bad"].isNotNull()), lambda r: r["bad"]).alias("dropped"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def longest_sentence(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(sentences(text), lambda s: F.size(words(s)))), F.lit(0))


def banned_in(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?i)\b(" + "|".join(BANNED) + r")\b"))


def register_failures(text: Column, kind: Column) -> Column:
    """Names of the checks that a text of kind opener, section or chunk fails."""
    chars = F.when(kind == "opener", CAPS["opener"][0]).when(kind == "section", CAPS["section"][0]).otherwise(CAPS["chunk"][0])
    most = F.when(kind == "opener", CAPS["opener"][1]).when(kind == "section", CAPS["section"][1]).otherwise(CAPS["chunk"][1])
    return F.array_compact(
        F.array(
            F.when(F.length(text) > chars, F.lit("chars")),
            F.when(F.size(sentences(text)) > most, F.lit("sentences")),
            F.when((kind != "chunk") & (longest_sentence(text) > MOST_WORDS), F.lit("long-sentence")),
            F.when(banned_in(text), F.lit("banned")),
        )
    )


def review_note_failures(text: Column) -> Column:
    return F.array_compact(F.array(F.when(F.trim(text) == "", F.lit("blank")), F.when(F.length(text) > 340, F.lit("chars")), F.when(F.size(sentences(text)) > 3, F.lit("sentences")), F.when(longest_sentence(text) > MOST_WORDS, F.lit("long-sentence")), F.when(banned_in(text), F.lit("banned"))))


def badge_failures(text: Column) -> Column:
    t = F.trim(text)
    return F.array_compact(
        F.array(
            F.when(t == "", F.lit("blank")),
            F.when(F.lower(t).isin(*PLACEHOLDERS), F.lit("placeholder")),
            F.when(F.length(t) > 30, F.lit("chars")),
            F.when(F.size(words(t)) > 4, F.lit("words")),
            F.when((t != "") & ~t.rlike("^[A-Z]"), F.lit("case")),
            F.when(F.exists(words(t), lambda w: w.rlike("^[A-Z]{6,}$")), F.lit("shout")),
        )
    )


def flesch(text: Column) -> Column:
    """Reading ease; a back-ticked span counts as one word of one syllable."""
    plain = F.regexp_replace(text, "`[^`]*`", "x")
    ws = F.filter(F.transform(words(plain), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")), lambda w: w != "")
    syllables = F.aggregate(F.transform(ws, lambda w: F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(w, "e$", ""), F.lit("[aeiouy]+")))), F.lit(0), lambda a, x: a + x)
    n = F.size(ws)
    score = 206.835 - 1.015 * (n / F.greatest(F.size(sentences(plain)), F.lit(1))) - 84.6 * (syllables / F.greatest(n, F.lit(1)))
    return F.when(n > 0, F.round(score, 6))


def preview(text: Column, most: int = 42) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def cap_body(body: Column, most: int = 80, reach: int = 5) -> Column:
    """At most `most` lines; cut at the first blank line within reach, else the first that ends in ; } or {, else at most."""
    lines = F.split(body, "\n")
    n = F.size(lines)
    near = F.sequence(F.lit(most), F.lit(most + reach))
    blank = F.array_min(F.filter(near, lambda i: F.trim(F.get(lines, i)) == ""))
    close = F.array_min(F.filter(near, lambda i: F.get(lines, i).rlike(r"[;{}]\s*$")))
    cut = F.coalesce(blank, close + 1, F.lit(most))
    left = n - cut
    more = F.concat(F.lit("… ("), left.cast("string"), F.when(left == 1, F.lit(" more line)")).otherwise(F.lit(" more lines)")))
    return F.when(n <= most, body).otherwise(F.array_join(F.array_append(F.slice(lines, F.lit(1), cut), more), "\n"))
