"""Queries: signal transforms, sequential algorithms and set planning. Tests hold them against numpy and invariants."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crateflow import adapters as A
from crateflow.functions import music
from crateflow.operators import labels as L
from crateflow.operators import planning as P
from crateflow.operators import series as R
from crateflow.operators import signals as G
from crateflow.operators import transitions as T
from crateflow.plans.core import query

RATE = 64.0


def _arrays(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "embeddings").select("vec_id", "embedding")


def _mapped(function, kind: str, name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _arrays(spark, sf).select("vec_id", G.array_map(function, kind, F.col("embedding")).alias(name))

    return run


#: Rate at which a vector is read as sound, and the same of all vectors of a label one after another.
SOUND = 8000.0
_A1, _A2 = (1 - math.exp(-2 * math.pi * f / SOUND) for f in (220, 2800))


@query("sig02_band_waveform", f"""WITH x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i)),
f AS (SELECT a.vec_id, a.i, any_value(a.v) AS v, sum(b.v * {_A1!r} * pow(1 - {_A1!r}, a.i - b.i)) AS l, sum(b.v * {_A2!r} * pow(1 - {_A2!r}, a.i - b.i)) AS h FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i <= a.i GROUP BY 1, 2),
p AS (SELECT vec_id, i // 53 AS bin, max(abs(v)) AS peak, sqrt(avg(l * l)) AS low, sqrt(avg((h - l) * (h - l))) AS mid, sqrt(avg((v - h) * (v - h))) AS high FROM f GROUP BY 1, 2)
SELECT vec_id, CAST(bin AS INT) AS bin, round(peak / max(peak) OVER w, 6) AS peak, round(low / max(greatest(low, mid, high)) OVER w, 6) AS low, round(mid / max(greatest(low, mid, high)) OVER w, 6) AS mid, round(high / max(greatest(low, mid, high)) OVER w, 6) AS high FROM p WINDOW w AS (PARTITION BY vec_id)""")
def sig02(spark: SparkSession, sf: str) -> DataFrame:
    w = _arrays(spark, sf).select("vec_id", G.array_map(lambda x: list(G.band_waveform(x, SOUND)), "array<array<double>>", F.col("embedding")).alias("w"))
    bins = w.select("vec_id", F.posexplode(F.arrays_zip(*[F.col("w")[k] for k in range(4)])).alias("bin", "x"))
    return bins.select("vec_id", "bin", *[F.round(F.col("x")[str(k)], 6).alias(n) for k, n in enumerate(("peak", "low", "mid", "high"))])


def _sounds(spark: SparkSession, sf: str, function, schema: str) -> DataFrame:
    """function(all vectors of a label in order, as one sound) -> one row behind the label."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key, *function(np.concatenate(pdf["embedding"].to_list()).astype(float)))])

    return G.per_track(A.frames(spark, sf), "track", "idx", run, f"track int, {schema}")


@query("sig04_onset_envelope")
def sig04(spark: SparkSession, sf: str) -> DataFrame:
    def envelope(x: np.ndarray) -> tuple:
        o = G.onset_envelope(x, SOUND, 256, 32)
        return o.all.round(6), o.low.round(6), o.rate

    return _sounds(spark, sf, envelope, "envelope array<double>, low array<double>, rate double")


@query("sig05_tempo")
def sig05(spark: SparkSession, sf: str) -> DataFrame:
    return _sounds(spark, sf, lambda x: G.tempo_of(G.onset_envelope(x, 500.0, 64, 8)), "bpm double, first_beat double, confidence double")


#: Frames of 32 vectors, 2048 samples, whose bins of 55 to 2000 Hz count for a pitch class.
_BINS = "SELECT k, CAST(floor(n + 0.5e0) AS INT) % 12 AS pitch, 1 - 2 * abs(n - floor(n + 0.5e0)) AS w FROM (SELECT k, 69 + 12 * log2(k * 8000e0 / 2048 / 440) AS n FROM (SELECT unnest(range(15, 513)) AS k)) WHERE abs(n - floor(n + 0.5e0)) <= 0.35e0"


def _chroma(spark: SparkSession, sf: str) -> DataFrame:
    """(track, pitch, v): shares of pitch classes of a track's frames, added up; a frame is a row."""
    f = A.frames(spark, sf).groupBy("track", F.floor(F.col("idx") / 32).alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", "embedding"))).alias("x")).where("size(x) = 32")
    shares = f.select("track", G.array_map(lambda x: G.frame_chroma(x, SOUND), "array<double>", F.flatten("x.embedding")).alias("c"))
    return shares.select("track", F.posexplode("c").alias("pitch", "v")).groupBy("track", "pitch").agg(F.sum("v").alias("v"))


@query("sig06_chroma", f"""WITH {A.FRAMES_SQL}, b AS ({_BINS}), x AS (SELECT track, idx // 32 AS part, (idx % 32) * 64 + d - 1 AS i, embedding[d]::DOUBLE AS v FROM frames, (SELECT unnest(range(1, 65)) AS d)), w AS (SELECT track, part, list(v * (0.5e0 - 0.5e0 * cos(6.283185307179586e0 * i / 2047)) ORDER BY i) AS v FROM x GROUP BY 1, 2 HAVING count(*) = 2048),
c AS (SELECT k, any_value(pitch) AS pitch, any_value(w) AS w, list(cos(6.283185307179586e0 * ((k * i) % 2048) / 2048) ORDER BY i) AS co, list(sin(6.283185307179586e0 * ((k * i) % 2048) / 2048) ORDER BY i) AS si FROM b, (SELECT unnest(range(2048)) AS i) GROUP BY k),
m AS (SELECT track, part, pitch, sum(c.w * sqrt(pow(list_inner_product(v, co), 2) + pow(list_inner_product(v, si), 2))) AS e FROM w, c GROUP BY 1, 2, 3), s AS (SELECT *, sum(e) OVER (PARTITION BY track, part) AS total FROM m)
SELECT track, pitch, round(sum(e / total), 5) AS v FROM s GROUP BY track, pitch""")
def sig06(spark: SparkSession, sf: str) -> DataFrame:
    return _chroma(spark, sf).select("track", "pitch", F.round("v", 5).alias("v"))


@query("sig06_key")
def sig06_key(spark: SparkSession, sf: str) -> DataFrame:
    """The key of each track by its pitch classes."""
    whole = _chroma(spark, sf).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("pitch", "v"))).getField("v").alias("c"))
    key = G.array_map(lambda c: [float(x) for x in G.key_of(c)], "array<double>", F.col("c"))
    return whole.select("track", key.alias("k")).select("track", F.col("k")[0].cast("int").alias("tonic"), (F.col("k")[1] > 0).alias("is_minor"), F.round(F.col("k")[2], 6).alias("fit"))


query("sig08_log_mel")(_mapped(lambda x: G.log_mel(x, SOUND, 32, 16, 8).ravel(), "array<double>", "mel"))


@query("sig11_separation")
def sig11(spark: SparkSession, sf: str) -> DataFrame:
    """The slow part of each label's sound, separated in overlapping chunks put together again, and the mix without it."""

    def separate(x: np.ndarray) -> tuple:
        starts = G.chunk_starts(len(x), 1024, 256)
        slow = G.overlap_add([G.split_bands(x[s : s + 1024])[0] for s in starts], starts, len(x))
        return slow.round(6), (x - slow).round(6)

    return _sounds(spark, sf, separate, "slow array<double>, rest array<double>")


@query("sig03_spectrum", """WITH x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i)), k AS (SELECT unnest(range(0, 33, 8)) AS k)
SELECT vec_id, CAST(k AS INT) AS k, round(sqrt(pow(sum(v * cos(6.283185307179586e0 * k * i / 64)), 2) + pow(sum(v * sin(6.283185307179586e0 * k * i / 64)), 2)), 6) AS mag FROM x, k GROUP BY 1, 2""")
def sig03(spark: SparkSession, sf: str) -> DataFrame:
    mags = _arrays(spark, sf).select("vec_id", G.array_map(lambda x: np.abs(np.fft.rfft(x)), "array<double>", F.col("embedding")).alias("m"))
    return mags.select("vec_id", F.posexplode("m").alias("k", "mag")).where("k % 8 = 0").select("vec_id", "k", F.round("mag", 6).alias("mag"))


@query("sig07_full_analysis")
def sig07(spark: SparkSession, sf: str) -> DataFrame:
    """Tempo, loudness, energy level and structure of every series, its beats' values as the sound's envelope."""

    def tempo(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["v"].to_numpy()
        return pd.DataFrame([(key, *G.tempo_of(G.Onsets(v, v, 8.0, 0.0)))], columns=["series", "bpm", "phase", "confidence"])

    beats = A.beats(spark, sf)
    power = F.avg(F.col("v") * F.col("v"))
    bars = beats.groupBy("series", F.floor(F.col("idx") / 4).alias("bar")).agg(F.sqrt(power).alias("energy"))
    loud = beats.groupBy("series").agg(F.sqrt(power).alias("rms"))
    found = G.per_track(beats, "series", "idx", tempo, "series long, bpm double, phase double, confidence double").join(loud, "series").join(R.structure(bars, "series"), "series")
    level = music.energy_level(20 * F.log10(F.col("rms") / 330 + 1e-9), F.col("sustained"))
    return found.select("series", "bpm", "phase", "confidence", "rms", level.alias("level"), "bars", "intro", "outro", "mix_out", "sustained")


@query("sig09_chunks", f"""WITH {A.FRAMES_SQL}, f AS (SELECT track, count(*) AS n FROM frames GROUP BY track) SELECT track, CAST(s AS INT) AS start FROM (SELECT track, n, unnest(list_concat(range(0, greatest(n - 24, 0), 20), [greatest(n - 24, 0)])) AS s FROM f)""")
def sig09(spark: SparkSession, sf: str) -> DataFrame:
    n = A.frames(spark, sf).groupBy("track").agg(F.count("*").alias("n"))
    last = F.greatest(F.col("n") - 24, F.lit(0))
    step = F.filter(F.sequence(F.lit(0).cast("long"), last, F.lit(20).cast("long")), lambda s: s < last)
    return n.select("track", F.explode(F.array_append(step, last)).alias("s")).select("track", F.col("s").cast("int").alias("start"))


@query("sig09_chunk_merge", f"WITH {A.FRAMES_SQL} SELECT track, idx AS frame, CAST(d - 1 AS INT) AS dim, round(embedding[d]::DOUBLE, 6) AS v FROM frames, (SELECT unnest(range(1, 65)) AS d)")
def sig09b(spark: SparkSession, sf: str) -> DataFrame:
    frames = A.frames(spark, sf).select("track", "idx", "embedding")
    starts = sig09(spark, sf)
    parts = frames.join(starts, "track").where("idx >= start AND idx < start + 24")
    kept = parts.groupBy("track", F.col("idx").alias("frame")).agg(F.min_by("embedding", "start").alias("e"))
    return kept.select("track", "frame", F.posexplode("e").alias("dim", "v")).select("track", "frame", "dim", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("sig10_beat_grid")
def sig10(spark: SparkSession, sf: str) -> DataFrame:
    def grid(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.cumsum(0.48 + 0.002 * (pdf["v"].to_numpy() % 7 - 3))
        g = G.beat_grid(t, t[::4])
        return pd.DataFrame([(key, g["bpm"], g["offset"], g["confidence"])], columns=["series", "bpm", "beat_offset", "confidence"])

    return G.per_track(A.beats(spark, sf), "series", "idx", grid, "series long, bpm double, beat_offset double, confidence double")


@query("sig12_vocal_entry", f"WITH {A.BEATS_SQL}, b AS (SELECT series, idx // 4 AS bar, sqrt(avg(v * v)) AS e FROM beats GROUP BY 1, 2), m AS (SELECT *, max(e) OVER (PARTITION BY series) AS top FROM b) SELECT series, CAST(coalesce(min(bar) FILTER (e > 0.3e0 * top), 0) // 4 * 4 AS BIGINT) AS entry_bar FROM m GROUP BY series")
def sig12(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    b = A.beats(spark, sf).groupBy("series", F.floor(F.col("idx") / 4).alias("bar")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("e"))
    m = b.withColumn("top", F.max("e").over(Window.partitionBy("series")))
    first = F.coalesce(F.min(F.when(F.col("e") > 0.3 * F.col("top"), F.col("bar"))), F.lit(0))
    return m.groupBy("series").agg((F.floor(first / 4) * 4).alias("entry_bar"))


@query("sig13_pooled_features", f"WITH {A.FRAMES_SQL} SELECT track, CAST(idx // 4 AS BIGINT) AS beat, CAST(d - 1 AS INT) AS dim, round(avg(embedding[d]::DOUBLE), 6) AS mean FROM frames, (SELECT unnest(range(1, 65)) AS d) GROUP BY 1, 2, 3")
def sig13(spark: SparkSession, sf: str) -> DataFrame:
    f = A.frames(spark, sf).select("track", F.floor(F.col("idx") / 4).alias("beat"), F.posexplode("embedding").alias("dim", "x"))
    return f.groupBy("track", "beat", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("sig13_beat_features")
def sig13_beats(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen vectors in a row as one track's signal, pooled over eight beats."""
    kinds = ["chroma", "mel", "band", "fine"]

    def features(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate(pdf["embedding"].to_numpy()).astype(float)
        rate, beats = 22050.0, np.arange(8) * len(x) / 8 / 22050.0
        frames = G.frame_features(x, rate, 256, 64)
        pooled = {k: np.round(G.pooled_by_beat(v, rate / 64, beats, len(x) / rate), 5).tolist() for k, v in frames.items()}
        return pd.DataFrame({"track": key, "beat": range(8), **pooled})

    tracks = A.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("track"), "vec_id", "embedding")
    return G.per_track(tracks, "track", "vec_id", features, "track long, beat int, " + ", ".join(f"{k} array<double>" for k in kinds))


@query("sig15_track_alignment")
def sig15_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Every 64 vectors in a row as a mix of three overlapping parts of it, each with small errors: where each is played."""

    def align(key, pdf: pd.DataFrame) -> pd.DataFrame:
        unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
        mix = np.stack(pdf["embedding"].to_numpy()).astype(float)
        parts = [mix[int(len(mix) * f) : int(len(mix) * t)] for f, t in ((0, 0.4), (0.3, 0.7), (0.6, 1))]
        similar, found = [], []
        for n, x in enumerate(parts):
            s = unit(x + 0.01 * np.sin(np.arange(x.size).reshape(x.shape) + n)) @ unit(mix).T
            similar.append(s - s.mean(1, keepdims=True) - s.mean(0, keepdims=True) + s.mean() if s.size else s)
            found.append(G.diagonal_candidates(similar[-1], 4, 10, 4))
        pick = G.monotone_choice([np.array([d.z for d in f]) for f in found], [np.array([d.shift for d in f]) for f in found])
        rows = []
        for n, c in enumerate(pick):
            if c < 0:
                rows.append((key, n, None, None, None, None))
                continue
            played = G.played_segments(similar[n], found[n][c], 4, 2, 2)
            rows.append((key, n, found[n][c].shift, round(found[n][c].z, 4), played[0][0], played[-1][1]))
        return pd.DataFrame(rows, columns=["mix", "part", "shift", "z", "first", "last"])

    mixes = A.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("mix"), "vec_id", "embedding")
    return G.per_track(mixes, "mix", "vec_id", align, "mix long, part int, shift int, z double, first int, last int")


@query("sig16_band_gains")
def sig16_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Every 24 frames of a track as a transition of two of its parts, by a fader that moves from beat 6 to 18."""
    x = F.transform("embedding", lambda v: F.abs(v.cast("double")) + 0.05)
    fade = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (18 - F.col("beat")) / 12))
    frames = A.frames(spark, sf).select(F.concat_ws(":", "track", F.floor(F.col("idx") / 24)).alias("transition"), (F.col("idx") % 24).alias("beat"), x.alias("x"))
    rows = frames.select("transition", F.col("beat").alias("step"), F.slice("x", 1, 30).alias("a"), F.slice("x", 31, 30).alias("b"), fade.alias("fade"), (F.col("beat") < 6).alias("alone_a"), (F.col("beat") >= 18).alias("alone_b"))
    rows = rows.withColumn("mix", F.zip_with("a", "b", lambda a, b: F.col("fade") * a + (1 - F.col("fade")) * b)).drop("fade")
    got = T.band_gains(rows, [0] * 10 + [1] * 10 + [2] * 10)
    gains = [F.round(F.col(f"gain_{d}")[i], 5).alias(f"gain_{d}_{x}") for d in "ab" for i, x in enumerate(("low", "mid", "high"))]
    names = ["crossfader", *(f"eq_{d}_{x}" for d in "ab" for x in ("low", "mid", "high"))]
    got = got.withColumn("_c", music.mixer_controls(F.col("gain_a"), F.col("gain_b")))
    return got.select(F.col("transition").alias("part"), F.col("step").alias("beat"), *gains, *[F.round(F.col("_c")[i], 5).alias(n) for i, n in enumerate(names)])


_HEARD = ["series", "idx AS beat", "CASE WHEN idx > n - 3 - series % 11 THEN 0e0 ELSE v / 330e0 END AS gain_a", "CASE WHEN idx < series % 7 THEN 0e0 ELSE v / 330e0 END AS gain_b", "idx + CAST(series % 5 AS INT) AS place"]


@query("sig17_audible_windows", f"""WITH {A.BEATS_SQL}, h AS (SELECT {", ".join(_HEARD)} FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM beats)),
b AS (SELECT series, beat AS e, place FROM h WHERE gain_b > 0.1e0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY beat) = 1), a AS (SELECT series, max(beat) AS z FROM h WHERE gain_a > 0.1e0 GROUP BY 1), n AS (SELECT series, count(*) AS n FROM h GROUP BY 1),
w AS (SELECT series, greatest(0, e - place % 4) AS beg, least(n, z + 4) AS fin FROM b JOIN a USING (series) JOIN n USING (series))
SELECT series, CAST(beg AS INT) AS "begin", CAST(least(fin - beg, 256) AS INT) AS length, CAST(fin - beg AS INT) AS whole FROM w WHERE fin - beg >= 16""")
def sig17_windows(spark: SparkSession, sf: str) -> DataFrame:
    b = A.beats(spark, sf).selectExpr("*", "count(*) OVER (PARTITION BY series) AS n")
    return R.audible_windows(b.selectExpr(*_HEARD), "series")


def _track_beats(spark: SparkSession, sf: str) -> DataFrame:
    """Beats of the series as tracks, each with the vector (vec_id) that tells its powers."""
    n = A.table(spark, sf, "embeddings").agg(F.count("*").alias("_n"))
    last = F.max("t").over(Window.partitionBy("series"))
    beats = A.beats(spark, sf).withColumn("duration", last + 1).crossJoin(F.broadcast(n))
    return beats.select(F.col("series").alias("track"), F.col("idx").alias("beat"), "t", "v", "duration", F.pmod(F.col("series") * 37 + F.col("idx"), "_n").alias("vec_id"))


def _powers(x: Column) -> Column:
    return F.transform(x, lambda v: F.abs(v.cast("double")) + 0.05)


def _deck() -> dict[str, Column]:
    """What an example tells of a track's beat, by its name."""
    level = F.col("v") / 330
    wave = F.array(level, level * 0.5, level * 0.3, level * level)
    return {"track": F.col("track"), "beat": F.col("beat"), "t": F.col("t"), "bar": F.floor(F.col("beat") / 4), "place": F.col("beat") % 4, "duration": F.col("duration"), "wave": wave}


def _fade() -> Column:
    shift = F.col("track") % 5 * 40
    return F.least(F.lit(1.0), F.when(shift > 0, (F.col("beat") + 1) / 16).otherwise(1.0), F.greatest(F.lit(0.0), (60 - F.col("beat")) / 16))


def _neighbours(tracks: DataFrame) -> DataFrame:
    """Each track and the next of its mix, with where they were found in it."""
    size = tracks.groupBy("track").agg((F.max("beat") + 1).cast("int").alias("n"))
    a, b = size.selectExpr("track AS track_a", "n AS n_a"), size.selectExpr("track AS track_b", "n AS n_b")
    pairs = a.join(b, (F.col("track_b") == F.col("track_a") + 1) & (F.floor(F.col("track_b") / 5) == F.floor(F.col("track_a") / 5)))
    at = (F.col("track_a") % 5 * 40).cast("int")
    return pairs.select(
        F.col("track_a").alias("transition"), F.floor(F.col("track_a") / 5).alias("mix_id"), "track_a", "track_b", at.alias("shift_a"), (at + 40).alias("shift_b"),
        at.alias("begin_a"), (at + F.least("n_a", F.lit(58))).alias("end_a"), (at + 42).alias("begin_b"), (at + 40 + F.least("n_b", F.lit(58))).alias("end_b"),
    )


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Five series to a mix, each entering 40 beats after the one before: (pairs, mixes, tracks). A beat's powers are an
    embedding's, its time and wave the events'; tracks fade in over 16 beats and out from beat 44 to 60."""
    vectors = A.table(spark, sf, "embeddings").select("vec_id", _powers(F.col("embedding")).alias("power"))
    tracks = _track_beats(spark, sf).join(vectors, "vec_id").select(*[c.alias(k) for k, c in _deck().items()], "power")
    shift = F.col("track") % 5 * 40
    # the fade is a column of its own: in a lambda `beat` would be the mix's, named beside it
    placed = tracks.withColumn("fade", _fade()).select(F.floor(F.col("track") / 5).alias("mix_id"), (F.col("beat") + shift).alias("at"), "track", F.transform("power", lambda p: p * F.col("fade")).alias("power"))
    each = placed.groupBy("mix_id", F.col("at").alias("beat")).agg(F.array_sort(F.collect_list(F.struct("track", "power")))["power"].alias("s"))
    mixes = each.select("mix_id", "beat", F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("power"))
    return _neighbours(tracks), mixes, tracks


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """_mixed's tables as (pairs, sets, tracks): the beats of all tracks of a mix are dealt together once, with the vectors as they are stored."""
    tracks = _track_beats(spark, sf)
    placed = tracks.withColumn("mix_id", F.floor(F.col("track") / 5)).withColumn("at", F.col("beat") + F.col("track") % 5 * 40)
    placed = placed.join(A.table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id").drop("vec_id")
    # as many tasks as are set, not as few as the bytes would allow: rows with powers are made of these there
    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mix_id")
    deck = F.struct(*[c.alias(k) for k, c in _deck().items()])
    return _neighbours(tracks), dealt.select("mix_id", "at", "track", _fade().alias("fade"), _powers(F.col("embedding")).alias("power"), deck.alias("deck")), tracks


#: Three bands of the 64 places of a power.
_PLACES = [0] * 16 + [1] * 32 + [2] * 16


@query("sig17_transition_examples")
def sig17(spark: SparkSession, sf: str) -> DataFrame:
    got = T.set_examples(*_sets(spark, sf), _PLACES)
    digits = lambda name: F.transform(name, lambda r: F.transform(r, lambda v: F.round(v, 4))).alias(name)
    return got.select("transition", "begin", "length", "whole", digits("x"), digits("y"), digits("power"), "mask")


@query("sig18_synthetic_transitions")
def sig18(spark: SparkSession, sf: str) -> DataFrame:
    u = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / float(1 << 30) for k in range(3)]
    length = F.element_at(F.array(*[F.lit(n) for n in (16, 32, 64)]), (F.floor(u[0] * 3) + 1).cast("int"))
    curve = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (i / length - u[1] * 0.3) / (0.4 + u[2] * 0.3))), 6))
    return A.tracks(spark, sf).select("id", length.alias("beats"), curve.alias("curve"))


@query("sig20_f_measure", f"WITH {A.BEATS_SQL} SELECT series, CASE WHEN count(*) FILTER (idx >= 10) = 0 THEN 1e0 ELSE round(count(*) FILTER (idx >= 10 AND v <= 80)::DOUBLE / count(*) FILTER (idx >= 10), 6) END AS f FROM beats GROUP BY series")
def sig20(spark: SparkSession, sf: str) -> DataFrame:
    def measure(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.arange(len(pdf)) * 0.5
        est = t + np.where(pdf["v"].to_numpy() > 80, 0.2, 0.03)
        return pd.DataFrame([(key, round(G.f_measure(t, est), 6))], columns=["series", "f"])

    return G.per_track(A.beats(spark, sf), "series", "idx", measure, "series long, f double")


@query("sig23_beat_labels")
def sig23_beats(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all series: beats half a second apart, with small errors, some far off and some missing; every third
    series drifts. The teacher of every fifth has its bars a beat later."""
    i, v = F.col("idx"), F.col("v")
    t = i * 0.5 + (v % 1 - 0.5) * 0.02 + F.when(v > 100, 0.1).otherwise(0.0) + F.when(F.col("series") % 3 == 0, 0.0002 * i * i).otherwise(0.0)
    b = A.beats(spark, sf).select("series", "idx", t.alias("t"))
    times = lambda kept: F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("idx", "t")))), lambda x: x["t"])
    late = F.pmod(i - F.when(F.col("series") % 5 == 0, 1).otherwise(0), F.lit(4)) == 0
    tracks = b.groupBy("series").agg(times(F.floor(i / 4) % 9 != 5).alias("beats"), times(i % 4 == 0).alias("down"), times(late).alias("teacher"))
    labels = L.beat_labels(tracks)
    agree = L.teachers_agree(labels, tracks.select("series", F.lit(0).alias("teacher"), F.col("teacher").alias("down")))
    digits = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(c)
    spans = lambda c: F.transform(c, lambda x: F.transform(x, lambda y: F.round(y, 6))).alias(c)
    return labels.join(agree, "series").select("series", "kind", F.round("bpm", 6).alias("bpm"), digits("beats"), digits("down"), spans("mask"), spans("gaps"), "agree")


@query("win05_longest_run", f"""WITH {A.BEATS_SQL}, t AS (SELECT series, idx, sum(CASE WHEN v > 90 THEN 0.67e0 ELSE 0.5e0 END) OVER w AS t, sum(CASE WHEN v > 90 AND idx > 0 THEN 1 ELSE 0 END) OVER w AS island FROM beats WINDOW w AS (PARTITION BY series ORDER BY idx))
SELECT series, CAST(n AS INT) AS n, first, last FROM (SELECT series, island, count(*) AS n, round(min(t), 6) AS first, round(max(t), 6) AS last FROM t GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, island) = 1""")
def win05(spark: SparkSession, sf: str) -> DataFrame:
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.cumsum(0.5 + np.where(pdf["v"].to_numpy() > 90, 0.17, 0.0))
        n, times = G.longest_run(t, 0.5)
        return pd.DataFrame([(key, len(n), round(float(times[0]), 6), round(float(times[-1]), 6))], columns=["series", "n", "first", "last"])

    return G.per_track(A.beats(spark, sf), "series", "idx", run, "series long, n int, first double, last double")


@query("win06_merged_peaks", f"""WITH RECURSIVE {A.BEATS_SQL}, p AS (SELECT series, idx, row_number() OVER (PARTITION BY series ORDER BY idx) AS n FROM (SELECT series, idx FROM beats QUALIFY v > 0 AND v = max(v) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))),
s AS (SELECT series, n, idx::DOUBLE AS total, 1 AS k, 0 AS g FROM p WHERE n = 1 UNION ALL
 SELECT p.series, p.n, CASE WHEN p.idx - s.total / s.k <= 2 THEN s.total + p.idx ELSE p.idx END, CASE WHEN p.idx - s.total / s.k <= 2 THEN s.k + 1 ELSE 1 END, CASE WHEN p.idx - s.total / s.k <= 2 THEN s.g ELSE s.g + 1 END FROM s JOIN p ON p.series = s.series AND p.n = s.n + 1)
SELECT series, round(arg_max(total / k, n), 6) AS peak FROM s GROUP BY series, g""")
def win06(spark: SparkSession, sf: str) -> DataFrame:
    peaks = R.local_peaks(A.beats(spark, sf), "series", "idx", "v", 1)
    groups = peaks.groupBy("series").agg(F.sort_array(F.collect_list("idx")).alias("at"))  # one track's peaks
    return groups.select("series", F.explode(G.merged_peaks(F.col("at"), 2)).alias("peak")).select("series", F.round("peak", 6).alias("peak"))


def _spaced_sql(k: int, apart: int) -> str:
    """The best row, then the best of those far enough from all chosen before, k times."""
    steps = []
    for i in range(k):
        far = " AND ".join(f"abs(b.idx - p{j}.idx) >= {apart}" for j in range(i))
        joined = " ".join(f"JOIN p{j} ON p{j}.series = b.series" for j in range(i))
        steps.append(f"p{i} AS (SELECT b.series, {i} AS place, b.idx, b.v FROM beats b {joined} {'WHERE ' + far if far else ''} QUALIFY row_number() OVER (PARTITION BY b.series ORDER BY b.v DESC, b.idx) = 1)")
    return f"WITH {A.BEATS_SQL}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT series, place, CAST(idx AS INT) AS idx, v FROM p{i}" for i in range(k))


@query("win13_spaced_best", _spaced_sql(5, 8))
def win13(spark: SparkSession, sf: str) -> DataFrame:
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        best = G.spaced_best(pdf["v"].to_numpy(), pdf["idx"].to_numpy(), 5, 8)
        return pd.DataFrame({"series": key, "place": range(len(best)), "idx": pdf["idx"].to_numpy()[best], "v": pdf["v"].to_numpy()[best]})

    return G.per_track(A.beats(spark, sf), "series", "idx", run, "series long, place int, idx int, v double")


@query("joi16_lag_similarity")
def joi16(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out vectors (ids divisible by 20) against all training ones, over all lags with 40 signs in common."""
    bits = F.zip_with(F.slice("embedding", 2, 62), F.slice("embedding", 1, 62), lambda a, b: F.when(a > b, 1).otherwise(-1).cast("tinyint"))
    v = _arrays(spark, sf).select("vec_id", bits.alias("bits"))
    return G.similar_signs(v.where("vec_id % 20 = 0"), v.where("vec_id % 20 <> 0"), 40, 0.75)


@query("joi17_probes")
def joi17(spark: SparkSession, sf: str) -> DataFrame:
    """Frames at eight places of each track looked up in all frames; places of two probes that agree are kept."""
    f = A.frames(spark, sf)
    n = f.groupBy("track").agg(F.count("*").alias("n"))
    at = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.floor(i / 9 * F.col("n")).cast("int"))
    probes = n.select("track", F.explode(F.array_distinct(at)).alias("idx")).join(f, ["track", "idx"]).select("track", F.col("idx").alias("probe"), F.col("embedding").alias("p"))
    dot = F.aggregate(F.zip_with("p", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    # a probe is compared with the frames of its own mix, which is what it was taken for
    scored = probes.join(f, "track").select("track", "probe", "idx", dot.alias("s"))
    z = R.robust_z(scored.withColumn("k", F.concat_ws(":", "track", "probe")), "k", "s").where("z > 3")
    d = z.select("track", "probe", "idx", (F.col("idx") - F.col("probe")).alias("d"))
    return d.groupBy("track", F.floor(F.col("d") / 4).alias("diagonal")).agg(F.countDistinct("probe").alias("probes"), F.min("idx").alias("first")).where("probes >= 2")


@query("top04_greedy_set")
def top04(spark: SparkSession, sf: str) -> DataFrame:
    return P.sets_per_group(A.keyed(spark, sf), "genre", 20, "rise")


@query("top04_first_step", f"WITH {A.KEYED_SQL} SELECT genre, arg_min(id, abs(energy - 5) * 1000000 + id) AS id FROM keyed GROUP BY genre")
def top04b(spark: SparkSession, sf: str) -> DataFrame:
    return P.sets_per_group(A.keyed(spark, sf), "genre", 1, "rise").select("genre", "id")


@query("str06_set_course")
def str06(spark: SparkSession, sf: str) -> DataFrame:
    t = A.keyed(spark, sf)
    return P.set_course(P.sets_per_group(t, "genre", 10), t, "genre")


@query("mus_f14_live_gestures", f"""WITH {A.BEATS_SQL}, b AS (SELECT series, list(v / 100 ORDER BY idx) AS e FROM beats GROUP BY series),
m AS (SELECT series, len(e) AS n, list_avg(e[9:16]) AS bef, list_avg(e[17:24]) AS aft, (series * 37 % 101) / 101e0 AS u, (series * 53 % 97) / 97e0 AS p FROM b),
w AS (SELECT *, CASE WHEN aft - bef > 0.1e0 THEN 3 ELSE 1 END AS r, CASE WHEN aft - bef < -0.1e0 THEN 3 ELSE 1 END AS f, CASE WHEN aft - bef < -0.1e0 AND bef >= 0.8e0 THEN 3 ELSE 0 END AS x FROM m),
a AS (SELECT series, CASE WHEN 2 * n < 64 THEN NULL WHEN u > 0.45e0 THEN 'none' WHEN p * (2 * r + f + x) <= r THEN 'roll' WHEN p * (2 * r + f + x) <= 2 * r THEN 'build' WHEN p * (2 * r + f + x) <= 2 * r + f THEN 'echo' ELSE 'repeat' END AS action FROM w)
SELECT series, action, CASE action WHEN 'roll' THEN 31.5e0 WHEN 'build' THEN 28e0 WHEN 'echo' THEN 31e0 WHEN 'repeat' THEN 32e0 END AS at, CASE WHEN action IS NOT NULL THEN 32e0 END AS until, CAST(CASE WHEN action = 'repeat' THEN -32 WHEN action <> 'none' THEN 0 END AS INT) AS jump_beats FROM a""")
def mus_f14(spark: SparkSession, sf: str) -> DataFrame:
    bars = A.beats(spark, sf).groupBy("series").agg(F.sort_array(F.collect_list(F.struct("idx", (F.col("v") / 100).alias("e")))).alias("b"))  # one track's bars
    tracks = bars.selectExpr("series", "b.e AS bar_energy", "20D AS position", "120D AS bpm", "0D AS grid_offset", "2D * size(b) AS duration", "CAST(NULL AS DOUBLE) AS next_mix", "CAST(NULL AS STRING) AS last")
    planned = P.plan_gestures(tracks, (F.col("series") * 37 % 101) / 101.0, (F.col("series") * 53 % 97) / 97.0)
    return planned.select("series", "action", "at", "until", "jump_beats")


@query("nlu11_set_from_description")
def nlu11(spark: SparkSession, sf: str) -> DataFrame:
    """A set for each genre as a description asks for it: the description is read by the rules for messages."""
    from crateflow.operators import interpreter as I

    description = spark.createDataFrame([("Crea una scaletta di 8 brani a onde, tra 90 e 160 bpm",)], "text string")
    asked = dict(x.split("=", 1) for x in I.actions(description, "text").where("kind = 'buildSet'").first()["value"].split(";"))
    low, high = (int(x) for x in asked["bpm"].split("-"))
    return P.sets_per_group(A.keyed(spark, sf).where(F.col("bpm").between(low, high)), "genre", int(asked["length"]), asked["strategy"])
