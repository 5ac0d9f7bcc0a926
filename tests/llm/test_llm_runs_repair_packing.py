"""Periodic runs, conversation repair and best-fit packing against brute force and on odd rows."""

import hashlib
import heapq
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from difflens.llm import packing, periodic, repair

DOCS = "doc_id long, text string, lang string, runs string, n_words int, collapsed string, head string"


# --- op11

def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=90), st.integers(1, 7))
def test_runs_of_random_words(words, times):
    assert periodic.runs_of(words) == plain_runs(words)
    assert periodic.runs_of(words * times) == plain_runs(words * times)


def test_runs_between_touching_runs_of_one_shorter_period():
    for n, tail in itertools.product((5, 12, 30), ([b"a"], [b"b", b"a"], [b"a", b"a"])):
        words = ([b"a", b"b"] * n + tail) * 3
        assert periodic.runs_of(words) == plain_runs(words)
    assert periodic.runs_of([b"x"] * 50_000) == [(0, 50_000, 1)]


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a " * 12), (4, "a b " * 6 + "c"), (4, "a b " * 6 + "c"), (5, "é " * 3000), (6, "one two three")]
    docs = spark.createDataFrame([(i, t, "x", "y", 7, "z", "h") for i, t in rows], DOCS)
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect())
    four = (4, 13, [(0, 12, 2)], "a b c")
    assert got == [(0, 12, [(0, 12, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), four, four, (5, 3000, [(0, 3000, 1)], "é"), (6, 3, [], "one two three")]
    digest = {r.doc_id: r for r in periodic.digests(periodic.periodic_runs(docs)).collect()}
    assert digest[4].n_runs == 1 and digest[4].exponent_milli == 6000 and digest[4].runs_sha256 == hashlib.sha256(b"0,12,2\n").hexdigest()
    assert digest[1].start is None and digest[1].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert periodic.digests(periodic.periodic_runs(docs.limit(0))).collect() == []


def test_planted_runs(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(200)] + [(None, "a b"), (7, None)]
    for r in periodic.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id is None or r.text is None:
            continue
        h, w = zlib.crc32(str(r.doc_id).encode()), dict(rows)[r.doc_id]
        if h % 10 == 0 and w:
            w, g = w.split(), h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = " ".join(x if i < a else w[a + (i - a) % p] for i, x in enumerate(w))
        assert r.text == w or r.doc_id == 7


# --- op12

def plain_repair(turns):
    """Cheapest, then least edits of one conversation's turns (role, text, fault), by search over (turn, state)."""
    todo, seen = [(0, "", 0, 0, ())], set()
    while todo:
        cost, audit, at, state, said = heapq.heappop(todo)
        if at == len(turns) and state in (0, 3):
            return cost, audit, "\n".join(said)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        for r in "ua":
            if (to := repair.LEADS[r].get(state)) is not None:
                heapq.heappush(todo, (cost + 5, audit + "I", at, to, (*said, repair.NAMES[r] + ":")))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(todo, (cost + 2, audit + "D", at + 1, state, said))
            if fault in ("", "truncated"):
                for r in "sua":
                    to = repair.LEADS[r].get(state)
                    if to is not None and (role[:1] == r or r != "s"):
                        same = role[:1] == r
                        heapq.heappush(todo, (cost + (not same) + 5 * (fault != ""), audit + ("K" if same else "R"), at + 1, to, (*said, f"{role if same else repair.NAMES[r]}:{text}")))


def plain_faults(turns):
    seen, out = set(), []
    for role, text in turns:
        end = text.rstrip(repair.SPACE)
        out.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def check_repair(spark, convs):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in repair.digests(turns).collect()}
    said = {}
    for r in repair.repaired(turns).collect():
        said.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    assert sorted(got) == sorted(convs)
    for c, held in convs.items():
        marked = plain_faults(held)
        cost, audit, text = plain_repair(marked)
        r = got[c]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
        assert "\n".join(x for _, x in sorted(said.get(c, []))) == text
        assert [r.blank, r.duplicate, r.truncated] == [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held)) and r.gaps == 0


@pytest.mark.parametrize("block", [1024, 3])  # with 3, blocks multiply over several levels
def test_repair_of_random_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", 4 if block == 3 else 64)
    rnd = random.Random(block)
    texts = ["Yes.", "No!", "cut off", "", " \n", "What? ", "More.", "so", "And."]
    convs = {c: [(rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "u2"]), rnd.choice(texts) if rnd.random() < 0.5 else f"t{rnd.random()}.") for _ in range(rnd.choice([1, 2, 3, 5, 8, 40]))] for c in range(60)}
    check_repair(spark, convs)


def test_repair_of_odd_rows(spark):
    kind = "conv_id long, turn long, role string, text string, head string, place int, digest string"
    rows = [(1, None, None, None, "h", 1, "d"), (1, 5, "user", "Hi.", "h", 1, "d"), (1, 9, "assistant", "Yo.", "h", 1, "d"), (None, 0, "user", "Hi.", "h", 1, "d"), (2, 3, "user", "Hi.", "h", 1, "d"), (2, 3, "user", "Hi.", "h", 1, "d")]
    turns = spark.createDataFrame(rows, kind)
    got = {r.conv_id: r[1:] for r in repair.digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == (3, 1, 0, 0, 1, 2, "DKK", hashlib.sha256(b"user:Hi.\nassistant:Yo.").hexdigest())
    assert got[None] == (0, 0, 0, 0, 0, 2, "D", empty)
    assert got[2] == (0, 0, 1, 0, 1, 4, "DD", empty)
    gone = repair.digests(turns, turns["conv_id"] == 1)
    assert {r.conv_id: r[1:] for r in gone.collect()}[2] == (0, 0, 0, 0, 0, 0, "", empty)
    assert repair.digests(turns.limit(0)).collect() == []


def test_rules_are_products_of_their_symbols():
    rules = [("ua", chr(repair.RULE)), (chr(repair.RULE) * 2, chr(repair.RULE + 1)), ("X" + chr(repair.RULE + 1), chr(repair.RULE + 2))]
    made = repair.rule_matrices(rules)[chr(repair.RULE + 2)]
    plain = repair.IDENTITY
    for x in "Xuaua":
        plain = repair.product(plain, repair.symbol_matrix(x))
    said = lambda m: [w and (w[0], repair.text_of(w[1])) for w in m]
    assert said(made) == said(plain) and said(made)[3] == (2, "DKKKK")


# --- op13

TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def fewest(sizes, length):
    """The true optimum, by search over the largest piece's bin."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in sorted(set(bins)):
            if k + sizes[i] <= length:
                j = bins.index(k)
                place(i + 1, [*bins[:j], k + sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_hold_and_best_fit_is_sound(sizes):
    sizes = sorted(sizes, reverse=True)
    least, tight = packing.bound(np.bincount(sizes, minlength=21), 20)
    bins = packing.best_fit(sizes, 20)
    true = fewest(sizes, 20)
    assert least <= true <= max(bins) + 1 and tight in (0, least)
    assert np.bincount(bins, weights=sizes).max() <= 20


def test_bounds_above_the_mean():
    assert packing.bound(np.bincount([11] * 8, minlength=21), 20) == (8, 8)  # no two fit
    assert packing.bound(np.bincount([7] * 9, minlength=21), 20)[0] == 5  # two fit, three don't


def test_packing_of_odd_rows(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [None, "", "<|endoftext|>", "a\x1c b\x85c 漢字 😀  \n\n x", "it's  the\tend\r\n  ", "word " * 900] + [" ".join(rnd.choice(["été", "Zug", "x1", "!?", "(a)", "the"]) for _ in range(rnd.randrange(80))) for _ in range(150)]
    rows = [(None if i == 4 else i % 100, t, "x", "y", 7, "z", "h") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(packing, "PART", 10)  # many parts, two rounds of exchange
    packed = packing.pack(docs, TOKENIZER, length=64, keep_ids=True)
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    want = sorted((-1 if r[0] is None else r[0], a, n, tuple(ids[a : a + n])) for r in rows for ids in [[*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]] for a, n in packing.cuts(len(ids), 64))
    got = packed.pieces.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.length, tuple(r.ids)) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    held = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == len(held.setdefault(r.sequence_id, []))
        held[r.sequence_id] += r.ids
    assert max(map(len, held.values())) <= 64 and len(held) == packed.sequences
    assert packed.bound <= packed.sequences <= 1.01 * packed.bound
    assert {r.sequence_id: r.ids for r in packing.sequences(packed).collect()} == held
    assert packing.pack(docs.limit(0), TOKENIZER).pieces.collect() == []


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(4, 4) == [(0, 4)] and packing.cuts(1, 4) == [(0, 1)]
