"""Choosing and splitting datasets: hash splits, caps, folds, leakage guards, deduplication, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.operators.rounds import cut

from crateflow.functions.text import chat_normal, fnv1a


def hash_split(text: Column) -> Column:
    """train, valid or test (70, 10, 20) by a hash of the text: equal texts always fall together."""
    n = F.pmod(fnv1a(text), F.lit(10))
    return F.when(n < 7, "train").when(n < 8, "valid").otherwise("test")


def share_bucket(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def first_of(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_leaks(train: DataFrame, held: DataFrame, text: str = "text") -> DataFrame:
    """Training rows whose normalized text is not that of a held-out row."""
    seen = held.select(chat_normal(F.col(text)).alias("_k")).distinct()
    return train.withColumn("_k", chat_normal(F.col(text))).join(seen, "_k", "left_anti").drop("_k")


def fold_of(df: DataFrame, group: str, is_new: str, folds: int, special: str | None = None) -> DataFrame:
    """(group, fold): old and new groups dealt round-robin apart from each other; the special one is in the last fold."""
    groups = df.groupBy(group).agg(F.max(is_new).alias("_new"))
    w = Window.partitionBy("_new").orderBy(group)
    fold = F.pmod(F.row_number().over(w) - 1, F.lit(folds))
    if special is not None:
        fold = F.when(F.col(group) == special, folds - 1).otherwise(fold)
    return groups.select(group, fold.cast("int").alias("fold"))


def weighted_sample(df: DataFrame, weight: Column, n: int, key: str, seed: int) -> DataFrame:
    """n rows without replacement, likelier with more weight; the draw is a hash of the key, so it repeats."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return df.withColumn("_d", -F.log(u) / weight).orderBy("_d", key).limit(n).drop("_d")


def stratified_with_caps(df: DataFrame, group: str, artist: str, key: str, per_group: int, per_artist: int) -> DataFrame:
    """Groups are served in order; each takes its next per_group rows, by key, whose artist is not used up by all before it.

    Chosen in rounds, by offer and acceptance: every group offers its first per_group rows that have not been turned down, and
    every artist keeps the first per_artist of what is offered, by group and key, and turns the others down for good. When none
    is turned down, the offers are what serving the groups one after another gives. A round is two windows and a join; no task
    holds more than a group's or an artist's offers. is_test marks every fourth row of a group. Keys are distinct in a group.
    """
    w = Window.partitionBy(group, artist).orderBy(key)
    possible = cut(df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_artist).drop("_n"))
    refused = None
    while True:
        left = possible if refused is None else possible.join(refused, [group, key], "left_anti")
        place = F.row_number().over(Window.partitionBy(group).orderBy(key))
        offers = cut(left.withColumn("_place", place).where(F.col("_place") <= per_group))
        rank = F.row_number().over(Window.partitionBy(artist).orderBy(group, key))
        worse = offers.withColumn("_rank", rank).where(F.col("_rank") > per_artist).select(group, key)
        if worse.isEmpty():
            return offers.withColumn("is_test", F.col("_place") % 4 == 0).drop("_place")
        refused = cut(worse if refused is None else refused.unionByName(worse))
