"""Beats to learn from: labels of detected beats by windows over numbered beats, and whether teachers agree with them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from crateflow.operators import signals as G

#: Beats that labels need, how near to the pulse counts as on it, and how near most beats of a grid are.
LEAST, NEAR, CLOSE = 30, 0.05, 0.03


def _pulse(beats: pd.Series) -> pd.DataFrame:
    found = [G.steady_pulse(np.asarray(x, float)) for x in beats]
    return pd.DataFrame([p[:3] if p else (None, None, None) for p in found], columns=["period", "phase", "spread"], dtype=float)


def _agreement(ref: pd.Series, est: pd.Series) -> pd.Series:
    return pd.Series([G.f_measure(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(ref, est)])


def _numbered(t: Column, phase: Column, period: Column) -> tuple[Column, Column]:
    """The number of the pulse next to a time, and how far from it the time is."""
    k = F.floor((t - phase) / period + 0.5)
    return k, F.abs(t - phase - k * period)


def _spans(rows: DataFrame, name: str, begin: Column, end: Column) -> DataFrame:
    """Spans of each series in order, as one array of pairs."""
    return rows.groupBy("series").agg(F.array_sort(F.collect_list(F.array(begin, end))).alias(name))


def beat_labels(tracks: DataFrame) -> DataFrame:
    """(series, kind, bpm, beats, down, mask, gaps, steady, period) from (series, beats, down), ascending arrays of seconds.

    Of tracks with 30 beats or more. Where four in five lie within 0.03 s of a steady pulse that deviates by 0.015 s at most, the
    labels are that pulse (kind grid): stretches of two or more beats off it are masked, silences of more than 2.5 pulses
    are gaps, and first beats are every fourth if 0.85 of those near the pulse agree on which (steady), else the detected
    ones moved onto it. Otherwise labels are the beats as detected (kind free). bpm is 0 without a pulse.
    """
    t = tracks.where(F.size("beats") >= LEAST).withColumn("p", pandas_udf(_pulse, "struct<period:double,phase:double,spread:double>")("beats")).select("series", "beats", "down", "p.period", "p.phase", "p.spread")
    each = t.where("period IS NOT NULL").select("series", "period", "phase", F.posexplode("beats").alias("i", "t"))
    number, off = _numbered(F.col("t"), F.col("phase"), F.col("period"))
    each = each.select("series", "period", "i", "t", off.alias("distance"), (off > NEAR).alias("off"))
    share = each.groupBy("series").agg(F.avg((F.col("distance") <= CLOSE).cast("double")).alias("share"))
    # beats off the pulse in a row have the same difference of their number and their rank among such beats
    run = F.col("i") - F.row_number().over(Window.partitionBy("series", "off").orderBy("i"))
    runs = each.withColumn("run", run).where("off").groupBy("series", "run", "period").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count("*").alias("n"))
    mask = _spans(runs.where("n > 1"), "mask", F.col("a") - F.col("period"), F.col("z") + F.col("period"))
    after = each.withColumn("after", F.lead("t").over(Window.partitionBy("series").orderBy("i"))).where(F.col("after") - F.col("t") > 2.5 * F.col("period"))
    gaps = _spans(after, "gaps", F.col("t") + F.col("period") / 2, F.col("after") - F.col("period") / 2)
    number, off = _numbered(F.col("d"), F.col("phase"), F.col("period"))
    bars = t.where("period IS NOT NULL").select("series", "period", "phase", F.explode("down").alias("d")).where(off <= NEAR).select("series", number.alias("k"))
    votes = bars.groupBy("series", F.pmod("k", F.lit(4)).alias("place")).agg(F.count("*").alias("n")).groupBy("series")
    votes = votes.agg(F.max(F.struct("n", (-F.col("place")).alias("place"))).alias("top"), F.sum("n").alias("all"))
    moved = bars.groupBy("series").agg(F.array_sort(F.collect_set("k")).alias("moved"))
    out = t
    for more in (share, mask, gaps, votes, moved):
        out = out.join(more, "series", "left")
    grid = (F.col("spread") <= 0.015) & (F.col("share") >= 0.8)
    first, last = F.element_at("beats", 1), F.element_at("beats", -1)
    numbers = F.sequence(F.ceil((first - F.col("phase")) / F.col("period") - 0.5), F.floor((last - F.col("phase")) / F.col("period") + 0.5))
    steady = F.coalesce(F.col("top.n") / F.col("all") >= 0.85, F.lit(False))
    place = -F.col("top.place")
    chosen = F.when(steady, F.filter(numbers, lambda k: F.pmod(k - place, F.lit(4)) == 0)).otherwise(F.coalesce("moved", F.array().cast("array<bigint>")))
    timed = lambda ks: F.transform(ks, lambda k: F.col("phase") + k * F.col("period"))
    none = F.array().cast("array<array<double>>")
    on_grid = F.coalesce(grid, F.lit(False))
    return out.select(
        "series", F.when(on_grid, "grid").otherwise("free").alias("kind"), F.coalesce(60 / F.col("period"), F.lit(0.0)).alias("bpm"), F.when(on_grid, timed(numbers)).otherwise(F.col("beats")).alias("beats"),
        F.when(on_grid, timed(chosen)).otherwise(F.col("down")).alias("down"), F.when(on_grid, F.coalesce("mask", none)).otherwise(none).alias("mask"), F.when(on_grid, F.coalesce("gaps", none)).otherwise(none).alias("gaps"),
        (steady | ~on_grid).alias("steady"), "period",
    )


def teachers_agree(labels: DataFrame, teachers: DataFrame) -> DataFrame:
    """(series, agree) for every labelled track from teachers (series, teacher, down: array of first beats).

    On a grid each teacher's first beats near it vote, 0.7 or more of them, for the place of the labels' own first beat, which are
    steady; on free beats the f-measure is 0.9 or more. A track without teachers agrees.
    """
    met = labels.select("series", "kind", "steady", "period", "beats", F.col("down").alias("own")).join(teachers.select("series", "teacher", "down"), "series")
    origin = F.element_at("beats", 1)
    bar = F.pmod(_numbered(F.element_at("own", 1), origin, F.col("period"))[0], F.lit(4))
    number, off = _numbered(F.col("d"), F.col("origin"), F.col("period"))
    grid = met.where("kind = 'grid'").select("series", "teacher", "period", F.when(F.col("steady") & (F.size("own") > 0), bar).alias("bar"), origin.alias("origin"), F.explode_outer("down").alias("d"))
    votes = grid.withColumn("place", F.when(off <= NEAR, F.pmod(number, F.lit(4)))).groupBy("series", "teacher", "bar", "place").agg(F.count("place").alias("n")).groupBy("series", "teacher", "bar")
    votes = votes.agg(F.max(F.struct("n", (-F.col("place")).alias("place"))).alias("top"), F.sum("n").alias("all"))
    same = (F.col("all") > 0) & (-F.col("top.place") == F.col("bar")) & (F.col("top.n") / F.col("all") >= 0.7)
    by_teacher = votes.select("series", F.coalesce(same, F.lit(False)).alias("ok"))
    free = met.where("kind = 'free'").select("series", (pandas_udf(_agreement, "double")("own", "down") >= 0.9).alias("ok"))
    agree = by_teacher.unionByName(free).groupBy("series").agg(F.bool_and("ok").alias("agree"))
    return labels.select("series").join(agree, "series", "left").select("series", F.coalesce("agree", F.lit(True)).alias("agree"))
