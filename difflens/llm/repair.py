"""Repair of conversations: the cheapest edits that make the roles alternate and drop blank and repeated turns.

Every turn is one symbol: its role's initial (s, u, a, else o), upper case if its text is cut off, or X if it has to go. A
min-plus matrix over the states of the role grammar `(s?(ua)+)?` says for a symbol what each way through costs and which
edits it takes; matrices multiply along a sequence. Re-Pair over all distinct sequences gives rules that many
conversations share: each rule's matrix is the product of its two symbols', its audits ropes of theirs, evaluated once,
bottom-up. A conversation then multiplies the few symbols that the rules leave of it.

Of two ways with one start, end and cost neither audit begins with the other (each inserted turn costs more), so the least
audit of a product is made of least audits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialise

#: What an edit costs; a cut-off turn that stays adds CUT.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user's, after an assistant's; which role leads where.
STATES, ENDS = 4, (0, 3)
LEADS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NAMES = {"u": "user", "a": "assistant"}
#: Turns of a block: a longer conversation is cut into blocks, whose matrices multiply again, FAN at a time.
BLOCK, FAN = 1024, 64
#: Rules found in one pass over the sequences, passes, and the share of all symbols that a pass's first pair must reach.
RULES_A_PASS, PASSES, LEAST_SHARE = 64, 12, 0.001
SPACE = " \t\n\x0b\x0c\r"
#: First of the code points that stand for rules (private use; the bounds above need fewer than there are).
RULE = 0xE000


# --- transfer matrices

def text_of(rope) -> str:
    """The letters of a rope: a string or a pair of ropes."""
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += (x[1], x[0])
    return "".join(out)


def least(ways: list[tuple]) -> tuple | None:
    """The cheapest (cost, rope), of several the one whose letters come first."""
    if not ways:
        return None
    cost = min(w[0] for w in ways)
    ways = [w for w in ways if w[0] == cost]
    return ways[0] if len(ways) == 1 else min(ways, key=lambda w: text_of(w[1]))


def product(a: list, b: list) -> list:
    """Of two matrices; entry i * STATES + j is (cost, rope) or None."""
    across = range(STATES)
    return [least([(x[0] + y[0], (x[1], y[1])) for k in across if (x := a[i * STATES + k]) and (y := b[k * STATES + j])]) for i in across for j in across]


IDENTITY = [(0, "") if i == j else None for i in range(STATES) for j in range(STATES)]


def _inserts() -> list:
    """Ways from state to state by inserted turns alone: at most two, as a third leads back."""
    one = [(INSERT, "I") if any(LEADS[r].get(i) == j for r in "ua") else None for i in range(STATES) for j in range(STATES)]
    two = product(one, one)
    return [least([w for w in ways if w]) for ways in zip(IDENTITY, one, two, strict=True)]


INSERTS = _inserts()


def symbol_matrix(symbol: str) -> list:
    """Of one turn: inserted turns before it, then what is done with it."""
    role, cut = symbol.lower(), CUT if symbol.isupper() else 0
    done: list[list] = [[] for _ in range(STATES * STATES)]
    for i in range(STATES):
        done[i * STATES + i].append((DELETE, "D"))
        if symbol != "X":
            if (j := LEADS.get(role, {}).get(i)) is not None:
                done[i * STATES + j].append((cut, "K"))
            for r in "ua":
                if r != role and (j := LEADS[r].get(i)) is not None:
                    done[i * STATES + j].append((REROLE + cut, "R"))
    return product(INSERTS, [least(w) for w in done])


# --- grammar

def grammar(sequences: DataFrame) -> list[tuple[str, str]]:
    """Re-Pair over `seq`, weighted by `weight`: rules (pair of symbols, symbol) in the order in which they were made.

    A pass counts all neighbouring pairs of all sequences and makes a rule of each of the most frequent ones, unless it
    could overlap one made before in that pass; so counts stay true within it. The driver sees RULES_A_PASS counts a pass.
    """
    rules: list[tuple[str, str]] = []
    held = None
    for _ in range(PASSES):
        symbols = sequences.select("weight", F.regexp_extract_all("seq", F.lit("(?s)."), F.lit(0)).alias("c")).where(F.size("c") > 1)
        pairs = symbols.select("weight", F.explode(F.expr("transform(slice(c, 1, size(c) - 1), (x, i) -> concat(x, c[i + 1]))")).alias("pair"))
        counts = pairs.groupBy("pair").agg(F.sum("weight").alias("n"))
        top = [r for r in counts.select("pair", "n").orderBy(F.desc("n"), "pair").limit(RULES_A_PASS).collect() if r["n"] > 1]
        if not top or top[0]["n"] < LEAST_SHARE * counts.agg(F.sum("n")).first()[0]:
            break
        made = []
        for r in top:
            x, y = r["pair"]
            if not any(x == other[1] or y == other[0] for other, _ in made) and (x != y or not made):
                made.append((r["pair"], chr(RULE + len(rules) + len(made))))
        rules += made
        seq = F.col("seq")
        for pair, symbol in made:
            seq = F.replace(seq, F.lit(pair), F.lit(symbol))
        sequences = materialise(sequences.select(seq.alias("seq"), "weight"), "repair-sequences")
        if held is not None:
            forget(held)
        held = sequences
    if held is not None:
        forget(held)
    return rules


def rule_matrices(rules: list[tuple[str, str]]) -> dict[str, list]:
    """Matrices of all symbols, rules bottom-up; a rule's audits are ropes of its parts'."""
    out = {x: symbol_matrix(x) for x in "suaoSUAOX"}
    for pair, symbol in rules:
        out[symbol] = product(out[pair[0]], out[pair[1]])
    return out


# --- Spark

def _order() -> tuple[Column, ...]:
    return F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")


def _blocks(turns: DataFrame, live: Column) -> DataFrame:
    """Per conversation and block of its turns: seq and what counts of its faults need."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    slim = turns.select("conv_id", F.col("turn"), "role", F.unhex(F.sha2("text", 256)).alias("digest"), initial.alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"), live.alias("live"))
    by = ["conv_id", "live"]
    w, same = Window.partitionBy(*by).orderBy(*_order()), Window.partitionBy(*by, "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    dealt = slim.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    dealt = dealt.withColumns({"place": F.row_number().over(w), "last_initial": F.lag("initial").over(w), "last_turn": F.lag("turn").over(w)})
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "X").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    dealt = dealt.withColumn("fault", fault).withColumn("symbol", symbol)
    is_live = lambda c: F.sum(F.when(F.col("live") & c, 1).otherwise(0)).cast("long")
    bad = F.col("last_initial").isNotNull() & ~F.concat("last_initial", "initial").isin("su", "ua", "au")
    fresh = F.col("turn").isNotNull() & (F.col("last_turn").isNull() | (F.col("last_turn") != F.col("turn")))
    return dealt.groupBy("conv_id", F.expr(f"cast((place - 1) div {BLOCK} as long)").alias("block")).agg(
        F.expr("concat_ws('', transform(array_sort(collect_list(if(live, struct(place, symbol), null))), x -> x.symbol))").alias("seq"),
        F.min(F.when(F.col("live"), F.col("turn"))).alias("low"), F.max(F.when(F.col("live"), F.col("turn"))).alias("high"), is_live(fresh).alias("turns"),
        *[is_live(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], is_live(bad).alias("illegal"))


_PRODUCT = f"""transform(sequence(0, {STATES * STATES - 1}), e -> array_min(transform(sequence(0, {STATES - 1}), k ->
  if(acc[{STATES} * (e div {STATES}) + k] is null or x[{STATES} * k + e % {STATES}] is null, null, struct(
    acc[{STATES} * (e div {STATES}) + k].cost + x[{STATES} * k + e % {STATES}].cost as cost, concat(acc[{STATES} * (e div {STATES}) + k].audit, x[{STATES} * k + e % {STATES}].audit) as audit)))))"""


def _joined(blocks: DataFrame) -> DataFrame:
    """Multiplies the matrices of FAN neighbouring blocks and adds up their counts."""
    blocks = blocks.groupBy("conv_id", F.expr(f"block div {FAN}").alias("block")).agg(
        F.expr("transform(array_sort(collect_list(struct(block, matrix))), x -> x.matrix)").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")])
    return blocks.withColumn("matrix", F.expr(f"aggregate(slice(m, 2, size(m)), m[0], (acc, x) -> {_PRODUCT})")).drop("m")


def audits(turns: DataFrame, live: Column | None = None) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost (long) and audit (a letter an edit: Keep, Rerole, Delete, Insert).

    Reads conv_id, turn, role and text, other columns not. Null roles and texts count as one space; turns go by turn (null
    first), ties by role, then by the text's digest. Rows that aren't `live` only name their conversation, which may have
    no turns: zeros and an empty audit. Rows with a null conv_id make one conversation. An empty table gives none. A
    conversation's turns pass through one task, sorted on disk where need be; what stays together is its audit.
    """
    blocks = materialise(_blocks(_plain(turns), F.lit(True) if live is None else live), "repair-blocks")
    distinct = materialise(blocks.where("seq <> ''").groupBy("seq").agg(F.count("*").alias("weight")), "repair-distinct")
    rules = grammar(distinct)
    forget(distinct)
    matrices = rule_matrices(rules)

    kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=1 << 14)
        def solved(seq: str) -> list:
            for pair, symbol in rules:
                seq = seq.replace(pair, symbol)
            out = matrices[seq[0]] if seq else IDENTITY
            for symbol in seq[1:]:
                out = product(out, matrices[symbol])
            return [w and {"cost": w[0], "audit": text_of(w[1])} for w in out]

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = pa.array([solved(s) for s in part.column("seq").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "matrix"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
    level = blocks.mapInArrow(work, f"{fields}, matrix array<struct<cost:long,audit:string>>").drop("seq")
    most = blocks.agg(F.max("block")).first()[0] or 0
    while most > 0:
        level, most = _joined(level), most // FAN
    ways = ", ".join(f"if(matrix[{j}] is null, null, struct(matrix[{j}].cost + {INSERTS[j * STATES + e][0]} as cost, concat(matrix[{j}].audit, '{text_of(INSERTS[j * STATES + e][1])}') as audit))" for j in range(STATES) for e in ENDS if INSERTS[j * STATES + e])
    gaps = F.coalesce((F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long"), F.lit(0))
    return level.withColumn("best", F.expr(f"array_min(array({ways}))")).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


def _plain(turns: DataFrame) -> DataFrame:
    return turns.withColumns({c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")})


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of conversations' heads, each followed by its turns: ("head", row), then ("turn", role, text) of each repaired turn; one batch is held at a time."""
    audit, at, state = "", 0, 0

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = "a" if state == 2 else "u"
            at, state = at + 1, LEADS[role][state]
            yield ("turn", NAMES[role], "")

    for batch in batches:
        for row in batch.to_pylist():
            if row["head"] is not None:
                yield from inserted()
                audit, at, state = row["head"]["audit"], 0, 0
                yield ("head", row["conv_id"], row["head"])
                continue
            yield from inserted()
            edit, role = audit[at], row["role"]
            at += 1
            if edit == "D":
                continue
            first = role[:1] if edit == "K" else "a" if state == 2 else "u"
            state = LEADS[first][state]
            yield ("turn", role if edit == "K" else NAMES[first], row["text"])
    yield from inserted()


def _sorted(turns: DataFrame, found: DataFrame, live: Column | None) -> DataFrame:
    """Each conversation's head (what audits() says) before its turns, all in one task and in order."""
    rows = _plain(turns if live is None else turns.where(live)).select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    head = found.select("conv_id", F.struct(*[c for c in found.columns if c != "conv_id"]).alias("head"))
    met = head.unionByName(rows, allowMissingColumns=True).repartition("conv_id")
    return met.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("head").isNull(), *_order()).select("conv_id", "head", "role", "text")


def repaired(turns: DataFrame, live: Column | None = None) -> DataFrame:
    """The repaired conversations' turns: conv_id, place (from 0), role, text; see audits()."""
    met = _sorted(turns, audits(turns, live), live)
    kind = met.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out = None, 0, []

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((id_type, pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text"])
            out.clear()
            return made

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field("conv_id").type
        for event in _walked(b for some in ([first], batches) for b in some):
            if event[0] == "head":
                conv, place = event[1], 0
            else:
                out.append((conv, place, event[1], event[2]))
                place += 1
                if len(out) == 1024:
                    yield flush()
        yield flush()

    return met.mapInArrow(work, f"conv_id {kind}, place long, role string, text string")


def digests(turns: DataFrame, live: Column | None = None) -> DataFrame:
    """audits() with repaired_sha256: of a repaired conversation's `role:text` lines, joined by newlines, fed one by one."""
    found = audits(turns, live)
    met = _sorted(turns, found, live)
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in found.schema]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, conv, head, sha, begun = [], None, None, None, False

        def flush():
            heads = pa.array([r[1] for r in rows], head_type).flatten()
            made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), *heads, pa.array([r[2] for r in rows], pa.string())], names=["conv_id", *head_type.names, "repaired_sha256"])
            rows.clear()
            return made

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        id_type, head_type = first.schema.field("conv_id").type, first.schema.field("head").type
        for event in _walked(b for some in ([first], batches) for b in some):
            if event[0] == "head":
                if head is not None:
                    rows.append((conv, head, sha.hexdigest()))
                    if len(rows) == 1024:
                        yield flush()
                _, conv, head = event
                sha, begun = hashlib.sha256(), False
            else:
                sha.update(f"{chr(10) if begun else ''}{event[1]}:{event[2]}".encode())
                begun = True
        if head is not None:
            rows.append((conv, head, sha.hexdigest()))
        yield flush()

    return met.mapInArrow(work, ", ".join([*columns, "repaired_sha256 string"]))


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """conversations with every twentieth turn or so dropped, emptied, cut off, repeated or given to the user, by crc32 of conv_id:turn; and which rows are live (a dropped one only names its conversation)."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    k = F.crc32(F.concat_ws(":", *said).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), k.alias("k"))
    rows = rows.withColumns({"role": F.when(F.col("k") == 4, "user").otherwise(F.col("role")), "text": F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))})
    copies = F.when(F.col("k") == 0, F.array().cast("array<int>")).when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", "role", "text", F.explode_outer(copies).alias("copy")), F.col("copy").isNotNull()
