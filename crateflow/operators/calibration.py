"""Choosing the shift of a detector's scores by how well its events agree with a reference: a sweep over all shifts at once.

A shift moves all scores alike, so the peaks stay where they are: a peak counts from the shift on that lifts it over zero. A beat is
an event from the first of its peaks on, and a reference event is met from the first beat in its window on. Scores of all
shifts follow from counts of these entries, so that peaks are picked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames on either side that a peak is highest among, seconds between events that agree, and seconds left out at the start.
REACH, NEAR, SKIP = 3, 0.07, 5.0


def peaks(frames: DataFrame) -> DataFrame:
    """(series, t, score) of the peaks of (series, idx, t, score): frames highest among REACH on either side; frames next to each
    other are one peak, at their mean time."""
    w = Window.partitionBy("series").orderBy("idx")
    top = frames.withColumn("top", F.max("score").over(w.rowsBetween(-REACH, REACH))).where("score = top")
    run = F.col("idx") - F.row_number().over(Window.partitionBy("series").orderBy("idx"))
    return top.withColumn("run", run).groupBy("series", "run").agg(F.avg("t").alias("t"), F.max("score").alias("score")).drop("run")


def nearest(points: DataFrame, beats: DataFrame) -> DataFrame:
    """points with `beat`, the time of the nearest of the series' beats, the earlier of two; without a beat they are left out."""
    both = points.withColumn("_b", F.lit(None).cast("double")).unionByName(beats.select("series", F.col("t")).distinct().withColumn("_b", F.col("t")), allowMissingColumns=True)
    w = Window.partitionBy("series").orderBy("t")
    before = F.last("_b", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_b", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_before", before).withColumn("_after", after).where("_b IS NULL")
    beat = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull() | (F.col("t") - F.col("_before") <= F.col("_after") - F.col("t")), F.col("_before")).otherwise(F.col("_after"))
    return found.withColumn("beat", beat).where("beat IS NOT NULL").select(*points.columns, "beat")


def agreement_by_shift(peaks_: DataFrame, beats: DataFrame, reference: DataFrame, shifts: list[float]) -> DataFrame:
    """(shift, score): the mean over all series of the reference of the f-measure of events at each shift.

    peaks_: series, t, score; beats and reference: series, t. Events are the beats nearest to peaks whose score plus the shift is over
    zero. Events of the reference lie more than twice NEAR apart. The first SKIP seconds don't count. A series without events in either
    agrees (1), without events in one does not (0).
    """
    spark = reference.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(s),) for s in shifts], "shift double"))
    entered = nearest(peaks_, beats).groupBy("series", "beat").agg(F.max("score").alias("score")).where(F.col("beat") >= SKIP)
    events = reference.where(F.col("t") >= SKIP).select("series", F.col("t").alias("r")).distinct()
    # an event and a beat that agree are in the same or a neighbouring cell
    cells = entered.select("series", "beat", "score", F.explode(F.array(*[F.floor(F.col("beat") / (2 * NEAR)) + k for k in (-1, 0, 1)])).alias("cell"))
    met = events.withColumn("cell", F.floor(F.col("r") / (2 * NEAR))).join(cells, ["series", "cell"]).where(F.abs(F.col("r") - F.col("beat")) <= NEAR)
    met = met.groupBy("series", "r").agg(F.max("score").alias("score"))
    over = lambda rows, name: rows.crossJoin(grid).where(F.col("score") + F.col("shift") > 0).groupBy("series", "shift").agg(F.count("*").alias(name))
    all_ = reference.select("series").distinct().crossJoin(grid)
    counts = all_.join(over(entered, "found"), ["series", "shift"], "left").join(over(met, "hit"), ["series", "shift"], "left").join(events.groupBy("series").agg(F.count("*").alias("wanted")), "series", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("found", "hit", "wanted")}
    f = F.when(n["found"] + n["wanted"] == 0, 1.0).otherwise(2 * n["hit"] / (n["found"] + n["wanted"]))
    return counts.groupBy("shift").agg(F.round(F.avg(f), 9).alias("score"))


def chosen(scores: DataFrame, least_gain: float = 0.01) -> DataFrame:
    """(shift, score) of the best shift, the one nearest to zero of equals; shift zero, unless the best gains least_gain over it."""
    at: Column = F.struct("score", (-F.abs("shift")).alias("near"), "shift")
    best = scores.agg(F.max(at).alias("b"), F.max(F.when(F.col("shift") == 0, F.struct("score", "shift"))).alias("z"))
    stay = F.col("b.score") - F.col("z.score") < least_gain
    pick = lambda c: F.when(stay, F.col(f"z.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return best.select(pick("shift"), pick("score"))
