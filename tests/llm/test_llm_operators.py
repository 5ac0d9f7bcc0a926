"""The training-data operators against brute force, round trips and edge cases on small tables."""

import functools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from difflens.llm import common, decontam, dictionary, langid, lm, ngram_jaccard, pieces, quality_eb, quality_rules, secret_scan, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, cls string, row string"
LABELS = "doc_id long, quality int, toxic int"


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "x9"]
    long = " ".join(rng.choice(words) for _ in range(30000))
    base = " ".join(f"w{i}" for i in range(200))
    texts = [None, "", "  \n\t ", "one", "one", "héllo wörld", base, base, base.replace("w5 ", "q "), base + " tail", long, "x" * 5000, "password = hunter22x", "1 2 3 !!"]
    rows = [(i, t, "en", "s", 0, 1.0, "c", "r") for i, t in enumerate(texts)]
    rows += [(None, "null id text", None, None, None, None, None, None), rows[3], rows[3]]
    return written(spark.createDataFrame(rows, SCHEMA), tmp_path_factory.mktemp("odd") / "d")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark.createDataFrame([], SCHEMA), tmp_path_factory.mktemp("empty") / "d")


def brute_components(rows, n, pct):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= pct * (len(sets[a]) + len(sets[b]) - k):
                parent[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(low.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def test_jaccard_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ngram_jaccard.jaccard_components(odd, 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 4, 85)
    assert ngram_jaccard.jaccard_components(empty, 4, 85).count() == 0


def test_jaccard_altered_copies(spark, tmp_path):
    rng, rows = random.Random(1), []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(150)]
        for c in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[: len(w) - rng.randrange(0, 12)])))
    d = written(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "d")
    got = ngram_jaccard.jaccard_components(d, 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 4, 85)


def test_keep_one_of_repeated_null_and_shared_ids(spark, tmp_path):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (1, a), (2, a), (2, b), (None, c), (None, c), (5, ""), (5, "")]
    d = written(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "d")
    got = Counter((r.doc_id, r.text) for r in ngram_jaccard.keep_one(d).collect())
    assert got == Counter({(1, a): 1, (2, b): 1, (None, c): 1, (5, ""): 2})


def test_jaccard_sets_of_many_texts(spark, monkeypatch):
    """Texts are hashed together, to the sets that each has alone; only texts that are asked for are cut into shingles."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefg"), int(k))) for k in rng.integers(0, 9, 200)] + [None, " ", "a b c d e f"] * 2
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    alone = [common.shingle_hashes(common.word_hashes([(t or "").encode()])[0], 4) for t in texts]
    calls, whole = [], ngram_jaccard.shingle_hashes
    monkeypatch.setattr(ngram_jaccard, "shingle_hashes", lambda h, n: calls.append(h.size) or whole(h, n))
    sets = ngram_jaccard._sets(batch, 4)
    assert [s.tolist() for s in sets] == [sorted(set(x.tolist())) for x in alone]
    assert sum(k >= 4 for k in calls) == 1
    classes = ngram_jaccard.classes_of(sets)
    assert classes == [ngram_jaccard.classes_of([s])[0] for s in sets]
    assert all((c == 0) == (s.size == 0) for c, s in zip(classes, sets)) and len(set(classes)) == len({tuple(s.tolist()) for s in sets})

    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    wanted = docs.where("text = 'a b c d e f'").select(F.xxhash64("text").alias("row_key")).distinct()
    found = ngram_jaccard.whole_sets(docs, 4, wanted).collect()
    assert [(r.cls, r.size, bytes(r.held)) for r in found] == [(classes[-1], 3, sets[-1].tobytes())]


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < p], rng.integers(0, 2**63, int(k), dtype=np.uint64)])) for p, k in zip(rng.uniform(0.7, 1, 80), rng.integers(0, 40, 80))]
    order = np.argsort([s.size for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    size = np.array([s.size for s in sets])
    sig = ngram_jaccard._folded([ngram_jaccard.bitmap(s) for s in sets], size)
    t = ngram_jaccard.Tree(size, np.arange(80), size.copy(), sig)
    found = set(zip(*(x.tolist() for x in ngram_jaccard.tree_pairs(t, t, 85, True))))
    for a in range(80):
        for b in range(a + 1, 80):
            k = np.intersect1d(sets[a], sets[b]).size
            if 100 * k >= 85 * (size[a] + size[b] - k):
                assert (a, b) in found
    assert len(found) < 80 * 79 / 2


def test_leaves_lose_no_pair():
    """Many small groups in one go: every linked pair of two components is found, once."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sets, rows, begin = {}, [], []
    for g in range(60):
        begin.append(len(rows))
        base = rng.integers(0, 1 << 63, int(rng.integers(20, 300))).astype(np.uint64)
        for _ in range(int(rng.integers(1, ngram_jaccard.LEAF + 1))):
            s = np.unique(np.concatenate([base[rng.random(base.size) > 0.06], rng.integers(0, 1 << 63, 2).astype(np.uint64)]))
            cls = len(sets)
            sets[cls] = s
            rows.append((s.size, s.size, cls, cls // 2, ngram_jaccard.bitmap(s)))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["size", "room", "cls", "comp", "sig"])
    end = [*begin[1:], len(rows)]
    found = list(zip(*(c.tolist() for c in ngram_jaccard.leaf_pairs(batch, np.array(begin), np.array(end), 85, False))))
    assert len(found) == len(set(found))
    both = lambda a, b: np.intersect1d(sets[a], sets[b]).size
    linked = {(a, b) for s, e in zip(begin, end) for a in range(s, e) for b in range(a + 1, e) if a // 2 != b // 2 and 100 * both(a, b) >= 85 * (sets[a].size + sets[b].size - both(a, b))}
    assert linked and linked <= {tuple(sorted(p)) for p in found}


def test_pieces_equal_the_library(odd, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    table = pieces.load()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode(odd, table)
    texts = Counter((r.doc_id, tuple(model.encode(r.text or ""))) for r in odd.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == texts
    back = {(r.doc_id, r.text) for r in pieces.decode(got.select("doc_id", "ids"), table).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert pieces.encode(empty, table).count() == 0


def test_runs_of_spaces_equal_the_library(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = [(100 * k + i, a + " " * k + b) for k in range(1, 61) for i, (a, b) in enumerate((("", "x"), ("def f():\n", "return 1"), ("a", "")))]
    d = written(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / "d")
    got = {r.doc_id: list(r.ids) for r in pieces.encode(d, pieces.load()).collect()}
    assert got == {i: model.encode(t) for i, t in rows}


def test_viterbi_equals_all_paths(spark):
    texts = ("a", "b", "ab", "ba", "aba", "bb", "▁a")
    table = pieces.Pieces(texts + ("<u>",) + tuple(f"<{i}>" for i in range(256)), (-3.0, -3.1, -4.0, -4.5, -5.2, -7.0, -3.3) + (0.0,) * 257, (True,) * 7 + (False,) * 257, tuple(range(8, 264)), 7, "unigram")
    units = ["ab", "abab", "babba", "▁aba", "aabb", "▁" + "ab" * 40]
    rows = spark.createDataFrame([(i, u, True) for i, u in enumerate(units)], "uid long, unit string, plain boolean")
    got = {units[r.uid]: r.ids for r in pieces.encode_units(rows, table).collect()}

    @functools.cache
    def best(u):
        if not u:
            return 0.0, []
        out = [(table.scores[i] + s, [i, *ids]) for i, t in enumerate(texts) if u.startswith(t) for s, ids in [best(u[len(t) :])]]
        return max(out, default=(-1e9, []))

    for u in units:
        assert math.isclose(sum(table.scores[i] for i in got[u]), best(u)[0])


def test_language_held_out(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d.where(common.crc_mod(F.col("doc_id"), 3) != 1))
    held = langid.predict(d, model).where(common.crc_mod(F.col("doc_id"), 3) == 1)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    said = {r.text: r for r in langid.predict(odd.select("doc_id", "text"), model).collect()}
    assert all(said[t].lang_pred == "und" and said[t].score == 0 for t in (None, ""))
    assert langid.predict(empty.select("doc_id", "text"), langid.fit(empty)).count() == 0


def test_toxicity(spark, odd, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = F.coalesce(common.crc_mod(F.col("doc_id"), 3) != 1, F.lit(True))
    got = toxicity.toxicity(d, labels, train).join(labels, "doc_id").where(common.crc_mod(F.col("doc_id"), 3) == 1)
    r = got.agg(F.avg(F.when(F.col("toxic") == 0, (F.col("score") >= 0.7).cast("int"))), F.avg(F.when(F.col("toxic") == 1, (F.col("score") >= 0.7).cast("int")))).first()
    assert r[0] < 0.05 and r[1] > 0.6
    a = toxicity.automaton({" idiot ": 5.0, " trash ": 4.0})
    assert toxicity.evidence(a, "An ID10T, surely")[2] == 1 and toxicity.evidence(a, "іdiоt")[2] == 1
    assert toxicity.evidence(a, "the trash can")[2] == 0 and toxicity.evidence(a, "trash")[2] == 1
    assert toxicity.toxicity(odd, spark.createDataFrame([], LABELS), F.lit(True)).count() == odd.count()
    assert toxicity.toxicity(empty, labels, F.lit(True)).count() == 0


def test_quality(spark, odd, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_eb.quality(d, labels, F.col("source"), F.col("lang")).join(labels, "doc_id")
    assert got.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.9
    assert quality_eb.quality(odd, spark.createDataFrame([], LABELS), F.col("source"), F.col("lang")).count() == odd.count()
    assert quality_eb.quality(empty, labels, F.col("source"), F.col("lang")).count() == 0


def test_quality_rules(spark, odd, empty):
    p = spark.createDataFrame([(k, n) for n in (1, 50, 400) for k in (0, 1, 5) if k <= n], "k long, n long")
    for r in p.withColumn("p", quality_rules.binomial_below(F.col("k"), F.col("n"), 0.02)).collect():
        assert math.isclose(r.p, sum(math.comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)), rel_tol=1e-9)
    got = quality_rules.quality_rules(odd, spark.createDataFrame([], LABELS))
    for r, t in zip(sorted(map(repr, got.select("doc_id", "n_words", "word_chars").collect())), sorted(repr((x.doc_id, x.text)) for x in odd.collect())):
        assert r
    words = {(r.doc_id, r.n_words, r.word_chars) for r in got.collect()}
    assert words == {(x.doc_id, len((x.text or "").split()), sum(map(len, (x.text or "").split()))) for x in odd.collect()}
    repeat = spark.createDataFrame([(1, "a b c d a b c e"), (2, "a a a a")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.measures(repeat).collect()} == {1: 6, 2: 4}
    assert quality_rules.quality_rules(empty, spark.createDataFrame([], LABELS)).count() == 0


def test_secrets(spark, odd, empty):
    t = "ü token: 'abcdef1' x AKIA" + "A1" * 9 + " 0123456789abcdef01234567 password=abc"
    d = spark.createDataFrame([(1, t), (1, t), (2, None), (3, "pass word")], "doc_id long, text string")
    got = secret_scan.digest_columns(secret_scan.scan(d)).collect()
    first = next(r for r in got if r.doc_id == 1)
    spans = [x.split(":") for x in first.spans.split(",")]
    assert [(k, t[int(s) : int(e)]) for k, s, e in spans] == [("assign", "token: 'abcdef1"), ("access", "AKIA" + "A1" * 9), ("hex", "0123456789abcdef01234567")]
    assert len(got) == 4 and (first.n_assign, first.n_access, first.n_hex) == (1, 1, 1)
    assert secret_scan.redact(d).where("doc_id = 1").first()["text"] == "ü [SECRET]' x [SECRET] [SECRET] password=abc"
    assert secret_scan.scan(odd.drop("row")).count() == odd.count() and secret_scan.scan(empty).count() == 0
    assert secret_scan.trigram_clauses("[0-9a-f]{24,}") is None


def test_warc(spark, tmp_path):
    big = "<p>" + "é" * 1000
    rows = [(1, "http://a/b c", big), (5, "u", big), (3, None, big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (None, "u", "z" * 2000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.round_trip(d)
    got = {r.page_id: r for r in found.collect()}
    assert len(got) == 7 and {k: r.refers_to for k, r in got.items()} == {1: 5, 5: None, 3: 5, 7: None, 8: None, 9: None, None: None}
    assert got[1].payload_digest == got[5].payload_digest and got[1].payload_bytes == len(big.encode()) and got[1].record_type == "revisit"
    path = common.shared_path(spark, "test")
    manifest = warc.write_archives(warc.marked(d), path)
    split = warc.read_archives(spark, path, manifest, range_bytes=97)
    assert sorted(str(r.page_id) for r in split.collect()) == sorted(map(str, got))
    assert warc.round_trip(d.limit(0)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, bound in ((1, 5), (100, 120), (1000, 10**9), (3000, 3001)):
        v = np.sort(rng.choice(bound, n, replace=False)) if bound < 10**6 else np.unique(rng.integers(0, bound, n))
        ef = lm.EliasFano.of(v, bound)
        assert (ef.access(np.arange(len(v))) == v).all()
        asked = np.concatenate([v, rng.integers(0, bound, 200)])
        want = np.array([np.searchsorted(v, x) if x in set(v.tolist()) else -1 for x in asked])
        assert (ef.find(asked) == want).all()


def test_lm(spark, odd, empty, tmp_path):
    d = written(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3), tmp_path / "d")
    train = F.coalesce(common.crc_mod(F.col("doc_id"), 10) != 0, F.lit(True))
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), b""]) for r in d.collect()]
    count = Counter(w for i, ws in rows if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.lm_scores(d, train).collect()}
    for i, ws in rows:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].n_tokens == len(ws) and got[i].train_tokens == n and got[i].n_known == sum(count[w] > 0 for w in ws)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert lm.lm_scores(odd, F.lit(True)).count() == odd.count()
    assert lm.lm_scores(odd, F.lit(False)).where("train_tokens = 0").count() == odd.count()
    assert lm.lm_scores(empty, F.lit(True)).count() == 0


@pytest.mark.parametrize("part_tokens", [1 << 20, 5000])
def test_lm_keeps_every_ngram(spark, tmp_path, monkeypatch, part_tokens):
    """Scores by all n-grams, those that occur once too, whatever the corpus's size and its parts."""
    monkeypatch.setattr(lm, "PART_TOKENS", part_tokens, raising=False)
    d = written(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(2), tmp_path / "d")
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), b""]) for r in d.collect()]
    one, grams, after = Counter(), Counter(), {}
    for i, ws in rows:
        if i % 10:
            one.update(ws)
            for k in (1, 2):
                for j in range(k, len(ws)):
                    grams[tuple(ws[j - k : j + 1])] += 1
    of = Counter()
    for g, n in grams.items():
        of[g[:-1]] += n
        after[g[:-1]] = after.get(g[:-1], 0) + 1
    bottom = sum(one.values()) + 0.1 * (len(one) + 1)
    for r in lm.lm_scores(d, F.col("doc_id") % 10 != 0).collect():
        ws = dict(rows)[r.doc_id]
        total = 0.0
        for j, w in enumerate(ws):
            p = (one[w] + 0.1) / bottom
            for h in (tuple(ws[j - 1 : j]), tuple(ws[j - 2 : j])):
                if len(h) and j >= len(h) and h in of:
                    p = max(grams[(*h, w)] - 0.5, 0) / of[h] + 0.5 * after[h] / of[h] * p
            total += math.log10(p)
        assert abs(r.score - total) < 0.02 * len(ws), r.doc_id


def test_trie_probabilities_sum_to_about_one():
    rng = np.random.default_rng(4)
    text = rng.zipf(1.5, 4000) % 12
    counts = np.bincount(text, minlength=12)
    prior = (counts + 0.1) / (counts + 0.1).sum()
    k2, c2 = np.unique(text[:-1] * 12 + text[1:], return_counts=True)
    k3, c3 = np.unique((text[:-2] * 12 + text[1:-1]) * 12 + text[2:], return_counts=True)
    data, index = lm.Trie.build(counts, prior, (k2, c2), (k3, c3)).to_bytes()
    t = lm.Trie.mapped(data, index)
    seen = [k // 12 for k in k3[:20]]
    for pair in seen:
        total = sum(10 ** t.log10(np.array([pair // 12, pair % 12, w]), np.array([0]), np.log10(prior[[pair // 12, pair % 12, w]]))[2] for w in range(12))
        assert 0.85 < total < 1.15


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(40))), (2, "only five words in here"), (3, None), (4, "")], "item_id long, text string")
    item = [f"b{i}" for i in range(40)]
    swapped = list(item)
    swapped[7] = swapped[23] = "other"
    rows = [(1, "pre " + " ".join(item) + " post"), (2, "pre " + " ".join(swapped) + " post"), (3, " ".join(item[:12])), (4, "x ONLY five words in here y"), (5, None), (6, "clean text of no interest")]
    got = {r.doc_id: list(r["items"]) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [2], 5: [], 6: []}
    assert decontam.leaks(odd, bench).count() == odd.count() and decontam.leaks(odd, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontam.leaks(empty, bench).count() == 0 and decontam.drop_leaks(odd, bench).count() == odd.count()


def test_decontamination_of_altered_copies(spark):
    """Mismatches near the ends, runs parted by other words, and items shorter than the longest mask."""
    item = lambda k, n: [f"i{k}w{i}" for i in range(n)]

    def altered(words, places):
        return " ".join("other" if i in places else w for i, w in enumerate(words))

    bench = spark.createDataFrame([(k, " ".join(item(k, n))) for k, n in ((1, 20), (2, 83), (3, 12), (4, 40))], "item_id long, text string")
    rows = [(1, altered(item(1, 20), {1, 3, 16, 18})), (2, altered(item(2, 83), {*range(21, 31), *range(52, 62)})), (3, altered(item(3, 12), {0, 1})), (4, altered(item(1, 20), {1, 2, 3, 16, 18})), (5, " ".join(item(4, 40)[:19]))]
    got = {r.doc_id: list(r["items"]) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [], 5: []}


def test_pipeline_keeps_clean_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "ids", "n_ids", "decoded_equal"} == set(out.columns)
    assert 0.5 * docs.count() < out.count() <= docs.count() and out.where("not decoded_equal").count() == 0


def test_blocks_cover_all_rows():
    assert dictionary.bucket_starts(7)[0] == 0 and len(set(dictionary.bucket_starts(7).tolist())) == 7


CLASHING = "doc_id long, text string, lang string, score double, lang_pred string, covered double, kinds string, k_id long, k_hash string, gone_id long, bad_id long, d_key string, row string, secret_spans string, cls long"


def clashing(spark, path, texts):
    rows = [(i, t, "en", -7.0, "p", 1.0, "k", 5, "h", 1, 2, "d", "r", "s", 3) for i, t in texts]
    return written(spark.createDataFrame(rows, CLASHING), path)


def test_stages_keep_clashing_columns_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    base = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [(1, base), (2, base), (2, base), (None, base), (3, None), (4, ""), (5, "12 34 !!"), (6, base + " password = hunter22x"), (7, "γειά σου κόσμε " * 20)]
    bench = spark.createDataFrame([(1, " ".join(base.split()[5:45]))], "item_id long, text string")
    d = clashing(spark, tmp_path / "d", texts)
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    said = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        rows = out.collect()
        said[name] = Counter((r.doc_id, r.text) for r in rows)
        assert all(tuple(r)[2:] == ("en", -7.0, "p", 1.0, "k", 5, "h", 1, 2, "d", "r", "s", 3) for r in rows), name
    every = Counter(texts)
    assert all(not n or said["language"][k] == n for k, n in ((k, 0 if k[0] in (3, 4, 5) else n) for k, n in every.items() if k[0] != 7))
    assert not {3, 4, 5} & {i for i, _ in said["language"]}
    assert said["near_duplicates"] == Counter([texts[0], *texts[4:7], texts[8]])  # 6 differs from 1 by four shingles of 60
    assert said["benchmark_leaks"] == Counter({k: n for k, n in every.items() if k[0] in (3, 4, 5, 7)})
    assert said["secrets"] == Counter([(i, t.replace("password = hunter22x", "[SECRET]") if t else t) for i, t in texts])
    out = corpus_pipeline.encoded(spark, d, str(tmp_path))
    assert out.where("decoded_equal").count() == len(texts) and out.columns == ["doc_id", "ids", "n_ids", "decoded_equal"]
    none = written(d.limit(0), tmp_path / "none")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, str(tmp_path)).count() == 0, name


def test_language_rejects_an_unlearned_script(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d.where(common.crc_mod(F.col("doc_id"), 3) != 1))
    other = spark.createDataFrame([(1, "съешь ещё этих мягких французских булок да выпей чаю " * 5), (2, "我能吞下玻璃而不伤身体" * 9), (3, "γειά σου κόσμε " * 20)], "doc_id long, text string")
    assert langid.predict(other, model).where(F.col("covered") >= model.least_covered).count() == 0
    known = langid.predict(d, model).where(common.crc_mod(F.col("doc_id"), 3) == 1)
    assert known.agg(F.avg((F.col("covered") >= model.least_covered).cast("double"))).first()[0] > 0.99


def test_kernel_against_plain_sets(spark):
    """Scores from hashed presence vectors equal those from plain sets of places."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "a"), ("le chat est sur le tapis", "b"), ("a dog in the house", "a"), ("un chien dans la maison", "b")] * 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    sets = [set(np.flatnonzero(g).tolist()) for g in model.landmarks > 0]
    for r in langid.predict(d, model).collect():
        own = set(np.flatnonzero(langid.grams(r.text)).tolist())
        at = {int(p): k for k, p in enumerate(model.places)}
        mine = {at[p] for p in own if p in at}
        kernel = np.array([len(mine & s) / math.sqrt(len(own) * len(s)) for s in sets])
        assert math.isclose(r.score, np.clip(((kernel @ model.weights).max() + 1) / 2, 0, 1), abs_tol=1e-4) and r.lang_pred == r.lang
