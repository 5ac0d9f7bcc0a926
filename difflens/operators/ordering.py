"""Positions, budgets, permutations and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def git_rank(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with git_rank, 1-based within the group."""
    return rows.withColumn("git_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def piece_index(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with piece, pieces, previous and next (the last of the order's columns before and after)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumns({"piece": F.row_number().over(w), "pieces": F.count("*").over(Window.partitionBy(*group)).cast("int"), "previous": F.lag(order[-1]).over(w), "next": F.lead(order[-1]).over(w)})


def prefix_budget(rows: DataFrame, group: str, order: str, size: str, cap: int) -> DataFrame:
    """rows with kept: up to the first whose running total passes the cap; from there on none is kept, even if it would fit."""
    return rows.withColumn("kept", F.sum(size).over(Window.partitionBy(group).orderBy(order)) <= cap)


def sticky_budget(sizes: Column, cap: int) -> Column:
    """How many of an array's sizes fit from the start."""
    step = lambda acc, x: F.struct((acc["total"] + x).alias("total"), (acc["n"] + F.when(acc["total"] + x <= cap, 1).otherwise(0)).alias("n"))
    return F.aggregate(sizes, F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def next_unreviewed(book: DataFrame, cursor: DataFrame) -> DataFrame:
    """range_id, forward, back: nearest unreviewed positions after and before the cursor, wrapping. book: range_id, pos (0-based), reviewed; cursor: range_id, at."""
    n = book.groupBy("range_id").agg(F.count("*").alias("n"))
    j = book.join(n, "range_id").join(cursor, "range_id").where("not reviewed")
    ahead = F.pmod(F.col("pos") - F.col("at") - 1, F.col("n"))
    return j.groupBy("range_id").agg(F.min_by("pos", ahead).alias("forward"), F.max_by("pos", ahead - F.when(F.col("pos") == F.col("at"), F.col("n")).otherwise(0)).alias("back"))


def permutation_check(keys: DataFrame, proposed: DataFrame) -> DataFrame:
    """range_id, missing, unknown, duplicated: sorted arrays of at most five. Both: range_id, key."""
    a = keys.groupBy("range_id", "key").agg(F.count("*").alias("have"))
    b = proposed.groupBy("range_id", "key").agg(F.count("*").alias("said"))
    j = a.join(b, ["range_id", "key"], "full_outer")
    some = lambda c: F.slice(F.array_sort(F.collect_set(F.when(c, F.col("key")))), 1, 5)
    return j.groupBy("range_id").agg(some(F.col("said").isNull()).alias("missing"), some(F.col("have").isNull()).alias("unknown"), some(F.col("said") > 1).alias("duplicated"))


def apply_permutation(sections: DataFrame, overlay: DataFrame, checked: DataFrame) -> DataFrame:
    """range_id, key, position: in the overlay's order where it is fresh and a permutation, else unchanged. sections: range_id, key, pos, fingerprint; overlay: range_id, key, new_pos, seen."""
    good = checked.where("size(missing) = 0 and size(unknown) = 0 and size(duplicated) = 0").select("range_id", F.lit(True).alias("valid"))
    placed = overlay.groupBy("range_id", "key").agg(F.min("new_pos").alias("new_pos"), F.min("seen").alias("seen"))
    j = sections.join(placed, ["range_id", "key"], "left").join(good, "range_id", "left")
    use = F.col("valid") & (F.col("seen") == F.col("fingerprint"))
    whole = F.min(F.coalesce(use, F.lit(False)).cast("int")).over(Window.partitionBy("range_id")) == 1
    return j.select("range_id", "key", F.when(whole, F.col("new_pos")).otherwise(F.col("pos")).alias("position"))


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """What only a holds and what only b holds, copies counted, with side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def weave_tests(tests: DataFrame, placement: str) -> DataFrame:
    """range_id, chunk_id, position key: before its first target (git order) or after its last (reverse git order). tests: range_id, chunk_id, git_rank, target_pos."""
    agg = tests.groupBy("range_id", "chunk_id", "git_rank").agg(F.min("target_pos").alias("lo"), F.max("target_pos").alias("hi"))
    key = (F.col("lo"), F.col("git_rank")) if placement == "before" else (F.col("hi") + 1, -F.col("git_rank"))
    return agg.select("range_id", "chunk_id", F.row_number().over(Window.partitionBy("range_id").orderBy(*key)).alias("position"))
