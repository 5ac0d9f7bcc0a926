"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule measures a text and rejects it beyond a cutoff. Cutoffs come from labelled rows: for each stratum (language),
rule and cutoff of a fixed grid, the false rejections k among n good rows give the exact binomial p-value of "the rule
rejects at least alpha of the good rows". With Holm's step-down correction over all tests, the strictest cutoff whose
hypothesis is refuted is taken; a rule without one stays off in that stratum. With probability 1 - delta, every cutoff
taken rejects less than alpha of the good rows of its stratum.

Nulls and empty texts have no word and fail the base rule; a null stratum is a stratum of its own; repeated rows each get
a row; an empty table gives an empty result; columns other than id, text and stratum aren't touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, materialise

#: Rule: expression over the measures, and the grid of cutoffs from strict to lax; a text is rejected above the cutoff.
RULES = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8]),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5]),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", [0.02, 0.05, 0.1, 0.2, 0.3, 0.4]),
    "upper_share": ("n_upper / greatest(word_chars, 1)", [0.1, 0.2, 0.3, 0.45, 0.6]),
    "exclaim_per_word": ("n_exclaim / greatest(n_words, 1)", [0.05, 0.1, 0.25, 0.5, 1.0]),
    "long_words": ("word_chars / greatest(n_words, 1)", [9.0, 10.0, 12.0, 15.0, 20.0]),
}
ALPHA, DELTA = 0.02, 0.05


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the measures of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # measures of the text itself; then of its words, so that neither is carried further than it is needed
    d = d.select(
        "doc_id",
        "stratum",
        F.trim("t", F.lit(" \t\n\x0b\x0c\r")).alias("edged"),
        lines.alias("l"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
    )
    d = d.withColumn("n_lines", F.size("l").cast("long")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("l"))).drop("l")
    d = d.withColumn("w", F.when(F.col("edged") == "", F.array().cast("array<string>")).otherwise(F.split("edged", GAP))).drop("edged")
    windows = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    h = F.slice(windows, F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))
    d = d.withColumns({"n_words": F.size("w").cast("long"), "word_chars": F.length(F.array_join("w", "")).cast("long"), "h": h}).drop("w")
    # windows by hash, equal ones side by side; only texts that have equal ones are sorted
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop("h")
    hit = F.filter("s", lambda x, i: F.coalesce(x["h"] == F.get("s", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("s", i + 1)["h"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))
    d = d.withColumn("n_repeat_words", F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    return d.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")


def binomial_below(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in log space so that large n can't underflow to a false 0."""
    first = n * F.lit(math.log1p(-p))
    step = F.lit(math.log(p) - math.log1p(-p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(n - i + 1) - F.log(i.cast("double")) + step
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    ks = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(ks, F.struct(first.alias("term"), first.alias("total")), add, lambda a: a["total"]))


def cutoffs(measured: DataFrame, labels: DataFrame, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: what holds with the guarantee. measured: with the base verdict `base_failed`."""
    good = labels.where("quality = 1").groupBy("doc_id").count().select("doc_id")
    rows = measured.where("not base_failed").join(good, "doc_id", "left_semi")
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (F.expr(e) > c).cast("int").alias("hit")) for r, (e, cs) in rules.items() for c in cs])
    tests = rows.select("stratum", F.explode(grid).alias("g")).groupBy("stratum", F.col("g.rule").alias("rule"), F.col("g.cutoff").alias("cutoff")).agg(F.count("*").alias("n"), F.sum("g.hit").cast("long").alias("k"))
    tests = tests.withColumn("p", F.when(F.col("k") < F.col("n") * alpha, binomial_below(F.col("k"), F.col("n"), alpha)).otherwise(F.lit(1.0)))
    # Holm: the i-th smallest of m p-values is refuted if it and all before it are at most delta / (m - i + 1); the grid is small and fixed for a stratum
    by_p, all_of = Window.orderBy("p", "stratum", "rule", "cutoff"), Window.partitionBy()
    tests = tests.withColumn("i", F.row_number().over(by_p)).withColumn("m", F.count("*").over(all_of))
    tests = tests.withColumn("failed", F.max((F.col("p") > delta / (F.col("m") - F.col("i") + 1)).cast("int")).over(by_p))
    return tests.where("failed = 0").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per row of docs (doc_id, text, lang): the measures, base_failed, the rules that fired, and kept."""
    m = measures(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    m = materialise(m, "measures")
    taken = cutoffs(m, labels, rules, alpha, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    # at most one row a stratum; Spark broadcasts it when it is small
    out = m.join(taken, "stratum", "left")
    fired = F.array_compact(F.array(*[F.when(F.expr(e) > F.try_element_at("cut", F.lit(r)), F.lit(r)) for r, (e, _) in rules.items()]))
    out = out.withColumn("fired", F.when(F.col("cut").isNull(), F.array().cast("array<string>")).otherwise(fired))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("fired") == 0)).alias("kept"), "fired")
