"""Evaluation: rates over heads, weighted and paired summaries, grids of thresholds, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, keys: list[str], columns: list[str], name: str = "head", value: str = "label") -> DataFrame:
    """One row per key and column."""
    return df.unpivot(keys, columns, name, value)


def head_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates over (row, head) pairs of truth and guess, 0 being none: exact rows, recall, wrong labels, false alarms."""
    per_row = rows.groupBy(*by, "row").agg(F.min((F.col("truth") == F.col("guess")).cast("int")).alias("exact"))
    exact = per_row.groupBy(*by).agg(F.avg("exact").alias("exact"))
    real, none = F.col("truth") != 0, F.col("truth") == 0
    rates = rows.groupBy(*by).agg(
        F.avg(F.when(real, (F.col("guess") == F.col("truth")).cast("double"))).alias("recall"),
        F.avg(F.when(real, ((F.col("guess") != F.col("truth")) & (F.col("guess") != 0)).cast("double"))).alias("wrong"),
        F.avg(F.when(none, (F.col("guess") != 0).cast("double"))).alias("false_alarms"),
    )
    return (rates.crossJoin(exact) if not by else rates.join(exact, by)).select(*by, "exact", "recall", "wrong", "false_alarms")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight over the rows that have a value."""
    w = F.when(value.isNotNull(), weight)
    return F.sum(value * w) / F.sum(w)


def paired(rows: DataFrame, key: str, variant: str, value: str, a: str, b: str) -> DataFrame:
    """What variant b changes against a over the keys that have both: median, mean, and how many improve."""
    wide = rows.groupBy(key).agg(F.max(F.when(F.col(variant) == a, F.col(value))).alias("a"), F.max(F.when(F.col(variant) == b, F.col(value))).alias("b"))
    d = wide.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("b") - F.col("a"))
    return d.agg(F.median("d").alias("median"), F.avg("d").alias("mean"), F.count_if(F.col("d") > 0).alias("improved"), F.count("*").alias("n"))


def ensemble(rows: DataFrame, keys: list[str], logit: str) -> DataFrame:
    """Mean of several models' probabilities, as a logit again."""
    p = F.avg(1 / (1 + F.exp(-F.col(logit))))
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return rows.groupBy(*keys).agg(F.log(p / (1 - p)).alias("logit"))


def sdr(rows: DataFrame, keys: list[str], ref: str, est: str, silent: float = 1e-6) -> DataFrame:
    """Signal to distortion in dB per group of samples; null where the reference is silent."""
    r2, d2 = F.sum(F.col(ref) * F.col(ref)), F.sum((F.col(ref) - F.col(est)) * (F.col(ref) - F.col(est)))
    return rows.groupBy(*keys).agg(F.when(r2 > silent, 10 * F.log10((r2 + 1e-12) / (d2 + 1e-12))).alias("sdr"))
