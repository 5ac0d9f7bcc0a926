"""Cutoffs, posteriors and decontamination against plain Python on tables where the methods have something to decide."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from difflens.llm import decontam, quality_eb, quality_rules


def below(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def plain_cutoffs(rows, grid, alpha, delta):
    """The laxest-to-strictest choice by Holm's procedure over all strata, rules and cutoffs."""
    tests = []
    for stratum in {r[0] for r in rows}:
        good = [r for r in rows if r[0] == stratum]
        for rule, (at, cuts) in grid.items():
            for c in cuts:
                k = sum(r[at] / 100 > c for r in good)
                tests.append((below(k, len(good), alpha) if k < alpha * len(good) else 1.0, stratum, rule, c))
    tests.sort()
    taken = {}
    for i, (p, stratum, rule, c) in enumerate(tests):
        if p > delta / (len(tests) - i):
            break
        taken[stratum, rule] = min(c, taken.get((stratum, rule), math.inf))
    return taken, [t for t in tests if t[0] <= delta and (t[1], t[2]) not in taken]


def test_cutoffs_equal_plain_holm(spark):
    rng, rows = random.Random(3), []
    for stratum, n, odd in (("en", 900, 0.004), ("fr", 300, 0.004), ("de", 180, 0.0), ("", 500, 0.3)):
        for _ in range(n):
            rows.append((stratum, rng.choice((8, 30, 60)) if rng.random() < odd else 1, rng.choice((8, 30)) if rng.random() < 0.004 else 0))
    rules = {"symbols": ("n_symbols / greatest(n_words, 1)", [0.05, 0.2, 0.5]), "bangs": ("n_exclaim / greatest(n_words, 1)", [0.05, 0.2])}
    measured = spark.createDataFrame([(i, *r, 100, False) for i, r in enumerate(rows)] + [(9999, "en", 99, 99, 100, True)], "doc_id long, stratum string, n_symbols long, n_exclaim long, n_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, 1) for i in range(len(rows))] * 2 + [(9999, 1)], "doc_id long, quality int")
    want, lost = plain_cutoffs(rows, {"symbols": (1, [0.05, 0.2, 0.5]), "bangs": (2, [0.05, 0.2])}, 0.02, 0.05)
    got = {(r.stratum, r.rule): r.cutoff for r in quality_rules.cutoffs(measured, labels, rules, 0.02, 0.05).collect()}
    assert got == want
    assert ("en", "symbols") in want and not any(s == "de" for s, _ in want) and ("", "symbols") not in want
    assert lost, "the correction has to turn something down here"


def test_rules_reject_rows(spark):
    """With enough labelled rows the cutoffs come into effect: texts full of symbols go, though they pass the base rule."""
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(900)]
    noisy = [(1000 + i, " ".join(f"# w{i}x{j}" for j in range(60)), "en") for i in range(20)]
    elsewhere = [(2000, noisy[0][1], None)]
    docs = spark.createDataFrame(clean + noisy + elsewhere, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(900)], "doc_id long, quality int")
    kept = {r.doc_id: (r.kept, r.base_failed, r.fired) for r in quality_rules.quality_rules(docs, labels).collect()}
    assert all(kept[i][0] for i in range(900)) and len(kept) == 921
    assert all(not kept[1000 + i][0] and not kept[1000 + i][1] and "symbols_per_word" in kept[1000 + i][2] for i in range(20))
    assert kept[2000][0]  # a stratum without labelled rows has no cutoff


def logit(p):
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def strength(groups, mean):
    g = [x for x in groups if len(x) >= 2]
    if not g:
        return 100.0
    between = max(np.mean([(np.mean(x) - mean) ** 2 for x in g]) - np.mean([np.var(x) / (len(x) - 1) for x in g]), 1e-6)
    return float(np.clip(mean * (1 - mean) / between - 1, 1.0, 1e6))


def test_posteriors_equal_plain_sums_and_hold_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    host = F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 50 == 1, None).otherwise(F.concat(F.lit("h"), (F.col("doc_id") % 97).cast("string")))
    path = (F.col("doc_id") % 7).cast("string")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = quality_eb.quality(d, labels.where(~held), host, path).collect()
    assert len(got) == d.count()
    of = lambda i: "big" if i % 3 == 0 else None if i % 50 == 1 else f"h{i % 97}"
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[of(r.doc_id)].append(r.q)
        paths[of(r.doc_id), r.doc_id % 7].append(r.q)
    assert min(map(len, paths.values())) == 1  # sparse sites are there
    mean = float(np.clip(np.mean([r.q for r in got]), 0.01, 0.99))
    m_host, m_path = strength(hosts.values(), mean), strength(paths.values(), mean)
    for r in got:
        h, p = hosts[of(r.doc_id)], paths[of(r.doc_id), r.doc_id % 7]
        host_post = (sum(h) + m_host * mean) / (len(h) + m_host)
        path_post = (sum(p) - r.q + m_path * host_post) / (len(p) - 1 + m_path)
        shift = min(max(logit(path_post) - math.log(mean / (1 - mean)), -1.5), 1.5)
        assert r.n_path == len(p) and math.isclose(r.host_post, host_post, rel_tol=1e-6) and math.isclose(r.path_post, path_post, rel_tol=1e-6)
        assert math.isclose(r.score, 1 / (1 + math.exp(-(logit(r.q) + shift))), rel_tol=1e-6)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    unseen = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(unseen) > 50 and np.mean([r.kept == (truth[r.doc_id] == 1) for r in unseen]) > 0.9


def test_decontamination_recall(spark):
    """Items of 15 to 59 words with up to a tenth of their words replaced, amid other words: at least nine in ten are found, and no clean text."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(20000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(150)]
    docs = []
    for i, text in items:
        ws = text.split()
        for j in rng.sample(range(len(ws)), len(ws) // 10):
            ws[j] = word()
        docs.append((i, " ".join([word() for _ in range(80)] + ws + [word() for _ in range(80)])))
    docs += [(1000 + i, " ".join(word() for _ in range(250))) for i in range(150)]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    ids = {r.doc_id for r in found.where(F.size("items") > 0).collect()}
    assert len([i for i in ids if i < 1000]) >= 135 and not any(i >= 1000 for i in ids)
