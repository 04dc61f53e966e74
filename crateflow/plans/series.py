"""Queries: ordered series, windows, nearest and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crateflow import adapters as A
from crateflow.operators import series as R
from crateflow.operators.signals import MAJOR, MINOR
from crateflow.plans.core import query

_B = f"WITH {A.BEATS_SQL}"


def _beats(spark: SparkSession, sf: str) -> DataFrame:
    return A.beats(spark, sf)


@query("win01_cap_per_artist", f"WITH {A.TRACKS_SQL} SELECT id, artist FROM tracks WHERE bpm > 0 QUALIFY row_number() OVER (PARTITION BY artist ORDER BY id) <= 3")
def win01(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).where("bpm > 0").withColumn("n", F.row_number().over(R.over("artist", "id")))
    return t.where("n <= 3").select("id", "artist")


@query("win02_interleave", f"WITH {A.TRACKS_SQL}, q AS (SELECT id, id % 3 AS style, id % 5 = 0 AS done, row_number() OVER (PARTITION BY id % 3 ORDER BY id) AS rn FROM tracks) SELECT id, CAST(rn AS INT) AS rn FROM q ORDER BY done DESC, rn, CASE style WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END LIMIT 200")
def win02(spark: SparkSession, sf: str) -> DataFrame:
    q = A.tracks(spark, sf).selectExpr("id", "id % 3 AS style", "id % 5 = 0 AS done")
    q = R.numbered(q, "style", "id", "rn")
    rank = F.when(F.col("style") == 1, 0).when(F.col("style") == 0, 1).otherwise(2)
    return q.orderBy(F.desc("done"), "rn", rank).limit(200).select("id", F.col("rn").cast("int").alias("rn"))


@query("win03_monotone_cues", f"{_B} SELECT series, idx, CASE WHEN m IS NULL OR v >= m THEN v END AS v FROM (SELECT *, max(v) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM beats)")
def win03(spark: SparkSession, sf: str) -> DataFrame:
    return R.monotone(_beats(spark, sf), "series", "idx", "v").select("series", "idx", "v")


@query("win04_local_peaks", f"{_B} SELECT series, idx, v FROM beats QUALIFY v > 0 AND v = max(v) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def win04(spark: SparkSession, sf: str) -> DataFrame:
    return R.local_peaks(_beats(spark, sf), "series", "idx", "v").select("series", "idx", "v")


@query("win04_detrended", f"{_B} SELECT series, idx, round(greatest(0e0, v - avg(v) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)), 8) AS level FROM beats")
def win04b(spark: SparkSession, sf: str) -> DataFrame:
    return R.detrended(_beats(spark, sf), "series", "idx", "v").select("series", "idx", F.round("level", 8).alias("level"))


@query("win07_buckets", f"{_B} SELECT series, CAST(floor(t / 86400) AS BIGINT) AS day, count(*) AS n, round(avg(v), 6) AS mean FROM beats GROUP BY 1, 2")
def win07(spark: SparkSession, sf: str) -> DataFrame:
    return _beats(spark, sf).groupBy("series", F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("win07_ragged_edges", f"""{_B}, e AS (SELECT series, t AS lo, lead(t) OVER (PARTITION BY series ORDER BY idx) AS hi, idx AS eid FROM beats WHERE idx % 5 = 0)
SELECT e.series, e.eid, round(avg(b.v), 6) AS mean FROM e JOIN beats b ON b.series = e.series AND b.t >= e.lo AND b.t < coalesce(e.hi, 1e18) GROUP BY e.series, e.eid""")
def win07b(spark: SparkSession, sf: str) -> DataFrame:
    edge = F.last(F.when(F.col("idx") % 5 == 0, F.col("idx")), ignorenulls=True).over(R.over("series", "idx").rowsBetween(Window.unboundedPreceding, 0))
    return _beats(spark, sf).withColumn("eid", edge).groupBy("series", "eid").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("win08_thinned", f"{_B} SELECT series, idx, v FROM beats b JOIN (SELECT series, CAST(ceil(count(*) / 16e0) AS BIGINT) AS step FROM beats GROUP BY series) s USING (series) WHERE idx % step = 0")
def win08(spark: SparkSession, sf: str) -> DataFrame:
    return R.thinned(_beats(spark, sf), ["series"], "idx", 16).select("series", "idx", "v")


@query("win09_first_drop", f"""{_B}, p AS (SELECT series, idx // 8 AS phrase, avg(v) AS e FROM beats GROUP BY 1, 2), q AS (SELECT *, lag(e) OVER (PARTITION BY series ORDER BY phrase) AS before, max(e) OVER (PARTITION BY series) AS top, max(phrase) OVER (PARTITION BY series) AS last FROM p)
SELECT series, CAST(min(phrase) AS BIGINT) AS phrase FROM q WHERE e >= 0.85e0 * top AND before < 0.85e0 * e AND phrase + 2 <= last GROUP BY series""")
def win09(spark: SparkSession, sf: str) -> DataFrame:
    p = _beats(spark, sf).groupBy("series", F.floor(F.col("idx") / 8).alias("phrase")).agg(F.avg("v").alias("e"))
    all_of = Window.partitionBy("series")
    q = p.withColumn("before", F.lag("e").over(R.over("series", "phrase"))).withColumn("top", F.max("e").over(all_of)).withColumn("last", F.max("phrase").over(all_of))
    return q.where("e >= 0.85 * top AND before < 0.85 * e AND phrase + 2 <= last").groupBy("series").agg(F.min("phrase").alias("phrase"))


@query("win10_crossings", f"""{_B}, d AS (SELECT series, idx, v - avg(v) OVER (PARTITION BY series) AS x FROM beats), c AS (SELECT series, idx, x, lag(x) OVER (PARTITION BY series ORDER BY idx) AS b FROM d)
SELECT series, min(CASE WHEN x >= 0 AND b < 0 THEN idx END) AS first_up, count(*) FILTER (sign(x) <> sign(b)) AS changes FROM c GROUP BY series""")
def win10(spark: SparkSession, sf: str) -> DataFrame:
    d = _beats(spark, sf).withColumn("x", F.col("v") - F.avg("v").over(Window.partitionBy("series"))).withColumn("b", F.lag("x").over(R.over("series", "idx")))
    return d.groupBy("series").agg(F.min(F.when((F.col("x") >= 0) & (F.col("b") < 0), F.col("idx"))).alias("first_up"), F.count_if(F.signum("x") != F.signum("b")).alias("changes"))


@query("win11_bars", f"""{_B}, k AS (SELECT series, idx, idx >= 5 AND (CAST(floor(v) AS BIGINT) + idx) % 4 = 0 AS is_down FROM beats), n AS (SELECT *, sum(is_down::INT) OVER (PARTITION BY series ORDER BY idx) - 1 AS b, min(CASE WHEN is_down THEN idx END) OVER (PARTITION BY series) AS f FROM k),
r AS (SELECT *, CAST(CASE WHEN b >= 0 THEN b ELSE -1 - floor(coalesce(f - idx - 1, 0) / 4e0) END AS INT) AS bar FROM n)
SELECT series, idx, bar, CAST(CASE WHEN b >= 0 THEN least(row_number() OVER (PARTITION BY series, bar ORDER BY idx) - 1, 3) ELSE 3 - coalesce(f - idx - 1, 0) % 4 END AS INT) AS beat_in_bar FROM r""")
def win11(spark: SparkSession, sf: str) -> DataFrame:
    k = _beats(spark, sf).withColumn("is_down", F.expr("idx >= 5 AND (CAST(floor(v) AS BIGINT) + idx) % 4 = 0"))
    return R.bars(k, "series", "idx", "is_down").select("series", "idx", "bar", "beat_in_bar")


_SIM = f"""{A.FRAMES_SQL}, s AS (SELECT a.track, a.idx // 64 AS part, a.idx AS i, b.idx AS j, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM frames a JOIN frames b ON a.track = b.track AND a.idx // 64 = b.idx // 64)"""


def _similarity(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of frames in parts of 64 frames of a track: a part's matrix is bounded, and every frame is in one."""
    f = A.frames(spark, sf).withColumn("part", F.floor(F.col("idx") / 64))
    a = f.select("track", "part", F.col("idx").alias("i"), F.col("embedding").alias("x"))
    b = f.select("track", "part", F.col("idx").alias("j"), F.col("embedding").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return a.join(b, ["track", "part"]).select("track", "part", "i", "j", dot.alias("s"))


@query("win12_diagonal_means", f"WITH {_SIM} SELECT track, i, j, round(m, 6) AS m FROM (SELECT track, i, j, avg(s) OVER w AS m, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY track, part, j - i ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4")
def win12(spark: SparkSession, sf: str) -> DataFrame:
    s = _similarity(spark, sf).withColumn("d", F.col("j") - F.col("i"))
    w = Window.partitionBy("track", "part", "d").orderBy("i").rowsBetween(0, 3)
    return s.withColumn("m", F.round(F.avg("s").over(w), 6)).withColumn("n", F.count("*").over(w)).where("n = 4").select("track", "i", "j", "m")


@query("sig14_double_centred", """WITH frames AS (SELECT label AS track, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) - 1 AS idx, embedding FROM embeddings),
s AS (SELECT a.track, a.idx AS i, b.idx AS j, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM frames a JOIN frames b ON a.track = b.track)
SELECT track, i, j, round(s - avg(s) OVER (PARTITION BY track, i) - avg(s) OVER (PARTITION BY track, j) + avg(s) OVER (PARTITION BY track), 6) AS c FROM s""")
def sig14(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of a label in a row are a track; all pairs of its frames."""
    f = R.numbered(A.table(spark, sf, "embeddings").select(F.col("label").alias("track"), "vec_id", "embedding"), "track", "vec_id", "_n")
    return R.double_centred(f.select("track", (F.col("_n") - 1).cast("int").alias("idx"), "embedding"))


@query("win14_interpolated", f"""{_B}, c AS (SELECT series, t AS time, v AS value FROM beats WHERE idx % 7 = 0), p AS (SELECT series, CAST(idx AS BIGINT) AS pid, t FROM beats WHERE idx % 7 <> 0)
SELECT p.series, p.pid, round(CASE WHEN a.time IS NULL THEN b.value WHEN b.time IS NULL OR b.time = a.time THEN a.value ELSE a.value + (b.value - a.value) * (p.t - a.time) / (b.time - a.time) END, 6) AS value
FROM p ASOF LEFT JOIN c a ON p.series = a.series AND p.t >= a.time ASOF LEFT JOIN c b ON p.series = b.series AND p.t <= b.time""")
def win14(spark: SparkSession, sf: str) -> DataFrame:
    b = _beats(spark, sf)
    curve = b.where("idx % 7 = 0").select("series", F.col("t").alias("time"), F.col("v").alias("value"))
    points = b.where("idx % 7 <> 0").select("series", F.col("idx").cast("bigint").alias("pid"), "t")
    return R.interpolated(points, curve, "series").select("series", "pid", F.round("value", 6).alias("value"))


@query("win15_extended_ranges", f"{_B} SELECT series, idx, round(greatest(coalesce(lag(t + 3600) OVER w, 0e0), t - 1800), 3) AS lo, round(least(coalesce(lead(t) OVER w, 1e12), t + 5400), 3) AS hi FROM beats WINDOW w AS (PARTITION BY series ORDER BY idx)")
def win15(spark: SparkSession, sf: str) -> DataFrame:
    w = R.over("series", "idx")
    lo = F.greatest(F.coalesce(F.lag(F.col("t") + 3600).over(w), F.lit(0.0)), F.col("t") - 1800)
    hi = F.least(F.coalesce(F.lead("t").over(w), F.lit(1e12)), F.col("t") + 5400)
    return _beats(spark, sf).select("series", "idx", F.round(lo, 3).alias("lo"), F.round(hi, 3).alias("hi"))


@query("win16_window_ladder", f"WITH {A.PLAYLISTS_SQL}, e AS (SELECT playlist, max(pos) AS n FROM playlists GROUP BY playlist) SELECT playlist, pre, CAST(greatest(0, n - pre) AS INT) AS len FROM e, (SELECT CAST(unnest([0, 2, 4]) AS INT) AS pre) WHERE n > pre")
def win16(spark: SparkSession, sf: str) -> DataFrame:
    e = A.playlists(spark, sf).groupBy("playlist").agg(F.max("pos").alias("n"))
    return e.withColumn("pre", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4)))).where("n > pre").select("playlist", "pre", F.greatest(F.lit(0), F.col("n") - F.col("pre")).alias("len"))


@query("win17_bar_encodings", f"{_B} SELECT series, idx, round(sin(2 * 3.141592653589793e0 * (b % 8) / 8e0), 6) + 0e0 AS sin8, round(cos(2 * 3.141592653589793e0 * (b % 16) / 16e0), 6) + 0e0 AS cos16, CASE WHEN b % 4 = 2 THEN 1 ELSE 0 END AS third, least(b / 32e0, 1e0) AS age FROM (SELECT series, idx, idx // 4 AS b FROM beats)")
def win17(spark: SparkSession, sf: str) -> DataFrame:
    b = F.floor(F.col("idx") / 4)
    turn = 2 * 3.141592653589793
    return _beats(spark, sf).select("series", "idx", (F.round(F.sin(turn * F.pmod(b, F.lit(8)) / 8), 6) + 0.0).alias("sin8"), (F.round(F.cos(turn * F.pmod(b, F.lit(16)) / 16), 6) + 0.0).alias("cos16"), F.when(b % 4 == 2, 1).otherwise(0).alias("third"), F.least(b / 32.0, F.lit(1.0)).alias("age"))


@query("win18_off_grid_runs", f"""{_B}, f AS (SELECT series, idx, v > 50 AS f FROM beats), g AS (SELECT series, idx, f, row_number() OVER (PARTITION BY series ORDER BY idx) - row_number() OVER (PARTITION BY series, f ORDER BY idx) AS g FROM f)
SELECT series, min(idx) AS "first", max(idx) AS "last", count(*) AS n FROM g WHERE f GROUP BY series, g HAVING count(*) >= 2""")
def win18(spark: SparkSession, sf: str) -> DataFrame:
    return R.runs(_beats(spark, sf), "series", "idx", F.col("v") > 50)


@query("win18_gaps", f"{_B}, d AS (SELECT series, idx, t, lag(t) OVER (PARTITION BY series ORDER BY idx) AS b FROM beats), m AS (SELECT series, median(t - b) AS p FROM d GROUP BY series) SELECT d.series, d.idx, round(b + 0.5e0 * p, 3) AS lo, round(t - 0.5e0 * p, 3) AS hi FROM d JOIN m USING (series) WHERE t - b > 2.5e0 * p")
def win18b(spark: SparkSession, sf: str) -> DataFrame:
    d = _beats(spark, sf).withColumn("b", F.lag("t").over(R.over("series", "idx")))
    m = d.groupBy("series").agg(F.median(F.col("t") - F.col("b")).alias("p"))
    return d.join(m, "series").where("t - b > 2.5 * p").select("series", "idx", F.round(F.col("b") + 0.5 * F.col("p"), 3).alias("lo"), F.round(F.col("t") - 0.5 * F.col("p"), 3).alias("hi"))


@query("win19_outro", f"{_B}, p AS (SELECT series, idx // 4 AS bar, avg(v) AS e FROM beats GROUP BY 1, 2), m AS (SELECT series, median(e) AS mid FROM p GROUP BY series) SELECT p.series, CAST(max(bar) FILTER (e > mid) + 1 AS BIGINT) AS outro FROM p JOIN m USING (series) GROUP BY p.series")
def win19(spark: SparkSession, sf: str) -> DataFrame:
    p = _beats(spark, sf).groupBy("series", F.floor(F.col("idx") / 4).alias("bar")).agg(F.avg("v").alias("e"))
    m = p.groupBy("series").agg(F.median("e").alias("mid"))
    return p.join(m, "series").groupBy("series").agg((F.max(F.when(F.col("e") > F.col("mid"), F.col("bar"))) + 1).alias("outro"))


@query("agg11_loudness", f"{_B} SELECT series, round(sqrt(avg(v * v)), 6) AS rms, max(abs(v)) AS peak, round(20 * log10(sqrt(avg(v * v)) / 100 + 1e-9), 6) AS db, round(greatest(0.25e0, least(4e0, 30 / (sqrt(avg(v * v)) + 1e-9))), 6) AS gain FROM beats WHERE idx % 4 = 0 GROUP BY series")
def agg11(spark: SparkSession, sf: str) -> DataFrame:
    rms = F.sqrt(F.avg(F.col("v") * F.col("v")))
    return _beats(spark, sf).where("idx % 4 = 0").groupBy("series").agg(F.round(rms, 6).alias("rms"), F.max(F.abs("v")).alias("peak"), F.round(20 * F.log10(rms / 100 + 1e-9), 6).alias("db"), F.round(F.greatest(F.lit(0.25), F.least(F.lit(4.0), 30 / (rms + 1e-9))), 6).alias("gain"))


@query("agg12_structure", f"""{_B}, p AS (SELECT series, idx // 4 AS bar, sqrt(avg(v * v)) AS e FROM beats GROUP BY 1, 2), n AS (SELECT series, bar, e / greatest(max(e) OVER (PARTITION BY series), 1e-9) AS x FROM p),
m AS (SELECT series, count(*) AS n, list_sort(list(x))[CAST(floor(count(*) / 2e0) AS INT) + 1] AS mid FROM n GROUP BY series),
b AS (SELECT series, any_value(n) AS n, any_value(mid) AS mid, min(CASE WHEN x >= 0.8e0 * mid THEN bar END) AS f, max(CASE WHEN x >= 0.8e0 * mid THEN bar END) AS l, avg(CASE WHEN x > 0.7e0 THEN 1e0 ELSE 0e0 END) AS sustained FROM n JOIN m USING (series) GROUP BY series),
o AS (SELECT *, CASE WHEN ceil((l + 1) / 8e0) * 8 <= n THEN ceil((l + 1) / 8e0) * 8 WHEN n >= 8 THEN floor(n / 8e0) * 8 ELSE n END AS o FROM b)
SELECT series, CAST(n AS BIGINT) AS bars, round(mid, 6) AS mid, CAST(CASE WHEN f < 4 THEN 0 ELSE f END AS BIGINT) AS intro, CAST(o AS BIGINT) AS outro,
CAST(CASE WHEN n < 24 THEN greatest(0, n - 8) ELSE greatest(floor(n / 2e0), floor(least(o, n - 16) / 8e0) * 8) END AS BIGINT) AS mix_out, round(sustained, 6) AS sustained FROM o""")
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    p = _beats(spark, sf).groupBy("series", F.floor(F.col("idx") / 4).alias("bar")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("energy"))
    return R.structure(p, "series").select("series", "bars", F.round("mid", 6).alias("mid"), "intro", "outro", "mix_out", F.round("sustained", 6).alias("sustained"))


@query("agg13_robust_z", f"{_B}, m AS (SELECT series, median(v) AS med FROM beats GROUP BY series), d AS (SELECT b.*, med, abs(v - med) AS dev FROM beats b JOIN m USING (series)), a AS (SELECT series, median(dev) AS mad FROM d GROUP BY series) SELECT d.series, d.idx, round((v - med) / (1.4826e0 * mad + 1e-6), 6) AS z FROM d JOIN a USING (series)")
def agg13(spark: SparkSession, sf: str) -> DataFrame:
    return R.robust_z(_beats(spark, sf), "series", "v").select("series", "idx", F.round("z", 6).alias("z"))


@query("agg14_residue_vote", f"{_B}, c AS (SELECT series, CAST(floor(v) AS BIGINT) % 4 AS r, count(*) AS n FROM beats GROUP BY 1, 2) SELECT series, r, round(n / sum(n) OVER (PARTITION BY series), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, r) = 1")
def agg14(spark: SparkSession, sf: str) -> DataFrame:
    c = _beats(spark, sf).groupBy("series", F.pmod(F.floor("v"), F.lit(4)).alias("r")).agg(F.count("*").alias("n"))
    best = c.groupBy("series").agg(F.max(F.struct("n", (-F.col("r")).alias("m"))).alias("b"), F.sum("n").alias("all"))
    return best.select("series", (-F.col("b.m")).alias("r"), F.round(F.col("b.n") / F.col("all"), 6).alias("share"))


@query("agg15_line_fit", f"{_B}, f AS (SELECT series, regr_slope(v, idx) AS slope, regr_intercept(v, idx) AS intercept FROM beats GROUP BY series) SELECT b.series, round(f.slope, 6) AS slope, round(f.intercept, 6) AS intercept, round(sqrt(avg((v - f.intercept - f.slope * idx) * (v - f.intercept - f.slope * idx))), 6) AS rms FROM beats b JOIN f USING (series) GROUP BY b.series, f.slope, f.intercept")
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    return R.line_fit(_beats(spark, sf), "series", "idx", "v").select("series", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "rms")])


@query("agg16_folded_phase", f"{_B}, h AS (SELECT series, CAST(floor((t / 3600 - floor(t / 3600)) * 24) AS BIGINT) % 24 AS cell, round(sum(v), 6) AS w FROM beats GROUP BY 1, 2) SELECT series, cell, w FROM h QUALIFY row_number() OVER (PARTITION BY series ORDER BY w DESC, cell) = 1")
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.pmod(F.floor((F.col("t") / 3600 - F.floor(F.col("t") / 3600)) * 24), F.lit(24))
    h = _beats(spark, sf).groupBy("series", cell.alias("cell")).agg(F.round(F.sum("v"), 6).alias("w"))
    return h.groupBy("series").agg(F.max(F.struct("w", (-F.col("cell")).alias("m"))).alias("b")).select("series", (-F.col("b.m")).alias("cell"), F.col("b.w").alias("w"))


_TEMPLATES = [(tonic, minor, note, (MINOR if minor else MAJOR)[(note - tonic) % 12]) for minor in (0, 1) for tonic in range(12) for note in range(12)]


@query("agg17_key_by_profile", f"""WITH p AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b}, {c}, {d}e0)' for a, b, c, d in _TEMPLATES)}) AS v(tonic, is_minor, note, w)),
c AS (SELECT vec_id, i - 1 AS note, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 13)) AS i)), r AS (SELECT vec_id, tonic, is_minor, round(corr(x, w), 9) AS r FROM c JOIN p USING (note) GROUP BY 1, 2, 3)
SELECT vec_id, CAST(tonic AS INT) AS tonic, CAST(is_minor AS INT) AS is_minor, round(r, 6) AS r FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, is_minor, tonic) = 1""")
def agg17(spark: SparkSession, sf: str) -> DataFrame:
    p = F.broadcast(spark.createDataFrame(_TEMPLATES, "tonic int, is_minor int, note int, w double"))
    c = A.table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 12)).alias("note", "x"))
    r = c.join(p, "note").groupBy("vec_id", "tonic", "is_minor").agg(F.round(F.corr(F.col("x").cast("double"), "w"), 9).alias("r"))
    best = r.groupBy("vec_id").agg(F.max(F.struct("r", (-F.col("is_minor")).alias("m"), (-F.col("tonic")).alias("t"))).alias("b"))
    return best.select("vec_id", (-F.col("b.t")).alias("tonic"), (-F.col("b.m")).alias("is_minor"), F.round("b.r", 6).alias("r"))


@query("agg19_dip_share", f"{_B}, m AS (SELECT series, median(v) AS med FROM beats GROUP BY series) SELECT round(sum(CASE WHEN v < 0.5e0 * med THEN 1e0 ELSE 0e0 END) / count(*), 6) AS dips, round(sum(CASE WHEN v > 3 * med THEN 1e0 ELSE 0e0 END) / count(*), 6) AS clips FROM beats JOIN m USING (series)")
def agg19(spark: SparkSession, sf: str) -> DataFrame:
    b = _beats(spark, sf)
    d = b.join(b.groupBy("series").agg(F.median("v").alias("med")), "series")
    return d.agg(F.round(F.avg(F.when(F.col("v") < 0.5 * F.col("med"), 1.0).otherwise(0.0)), 6).alias("dips"), F.round(F.avg(F.when(F.col("v") > 3 * F.col("med"), 1.0).otherwise(0.0)), 6).alias("clips"))


@query("agg20_ewma", f"WITH RECURSIVE {A.BEATS_SQL}, e AS (SELECT series, idx, v AS x FROM beats WHERE idx = 0 UNION ALL SELECT b.series, b.idx, e.x * 0.85e0 + b.v * 0.15e0 FROM e JOIN beats b ON b.series = e.series AND b.idx = e.idx + 1) SELECT series, round(arg_max(x, idx), 6) AS ewma FROM e GROUP BY series")
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    values = F.sort_array(F.collect_list(F.struct("idx", "v"))).getField("v")
    folded = F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), F.col("x")[0], lambda acc, v: acc * 0.85 + v * 0.15)
    return _beats(spark, sf).groupBy("series").agg(values.alias("x")).select("series", F.round(folded, 6).alias("ewma"))


@query("agg21_tap_tempo", f"{_B}, d AS (SELECT series, idx, t, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS gap, count(*) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n, avg(t - g) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS mean FROM (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY t) AS g FROM beats)) SELECT series, idx, round(60 / mean, 9) AS bpm FROM d WHERE n >= 4 AND mean > 0")
def agg21(spark: SparkSession, sf: str) -> DataFrame:
    w = R.over("series", "t")
    d = _beats(spark, sf).withColumn("gap", F.col("t") - F.lag("t").over(w))
    recent = w.rangeBetween(-86400, 0)
    return d.withColumn("n", F.count("*").over(recent)).withColumn("mean", F.avg("gap").over(recent)).where("n >= 4 AND mean > 0").select("series", "idx", F.round(60 / F.col("mean"), 9).alias("bpm"))


_SPLIT = f"{_B}, l AS (SELECT series, idx, t FROM beats WHERE idx % 3 = 0), r AS (SELECT series, t FROM beats WHERE idx % 3 = 1)"


@query("joi11_nearest_beat", f"""{_SPLIT} SELECT l.series, l.idx, round(CASE WHEN a.t IS NULL THEN b.t WHEN b.t IS NULL OR l.t - a.t <= b.t - l.t THEN a.t ELSE b.t END, 6) AS near FROM l ASOF LEFT JOIN r a ON l.series = a.series AND l.t >= a.t ASOF LEFT JOIN r b ON l.series = b.series AND l.t <= b.t""")
def joi11(spark: SparkSession, sf: str) -> DataFrame:
    b = _beats(spark, sf)
    got = R.nearest(b.where("idx % 3 = 0").select("series", "idx", "t"), b.where("idx % 3 = 1").select("series", "t"), "series", "t")
    return got.select("series", "idx", F.round("near", 6).alias("near"))


@query("joi12_nearest_within", f"""{_SPLIT}, n AS (SELECT l.series, l.idx, l.t, CASE WHEN a.t IS NULL THEN b.t WHEN b.t IS NULL OR l.t - a.t <= b.t - l.t THEN a.t ELSE b.t END AS near FROM l ASOF LEFT JOIN r a ON l.series = a.series AND l.t >= a.t ASOF LEFT JOIN r b ON l.series = b.series AND l.t <= b.t)
SELECT series, idx, CASE WHEN abs(near - t) <= 20000 THEN round(near, 6) ELSE -1e0 END AS near FROM n""")
def joi12(spark: SparkSession, sf: str) -> DataFrame:
    b = _beats(spark, sf)
    got = R.nearest(b.where("idx % 3 = 0").select("series", "idx", "t"), b.where("idx % 3 = 1").select("series", "t"), "series", "t")
    return got.select("series", "idx", F.when(F.abs(F.col("near") - F.col("t")) <= 20000, F.round("near", 6)).otherwise(-1.0).alias("near"))


@query("joi13_active_interval", f"""{_B}, p AS (SELECT series, CAST(idx AS BIGINT) AS pid, t FROM beats WHERE idx % 2 = 1), i AS (SELECT series, CAST(idx AS BIGINT) AS iid, t AS b, t + 50000 + v * 10 AS e FROM beats WHERE idx % 4 = 0)
SELECT p.series, p.pid, i.iid FROM p LEFT JOIN i ON i.series = p.series AND p.t >= i.b AND p.t < i.e QUALIFY row_number() OVER (PARTITION BY p.series, p.pid ORDER BY i.b DESC NULLS LAST) = 1""")
def joi13(spark: SparkSession, sf: str) -> DataFrame:
    b = _beats(spark, sf)
    points = b.where("idx % 2 = 1").selectExpr("series", "CAST(idx AS BIGINT) AS pid", "t")
    intervals = b.where("idx % 4 = 0").selectExpr("series", "CAST(idx AS BIGINT) AS iid", "t AS begin", "t + 50000 + v * 10 AS finish")
    return R.active_interval(points, intervals, "series", 50_000.0).select("series", "pid", "iid")


@query("joi14_bounded_candidates", f"""{_B}, c AS (SELECT series, idx, t, lead(t) OVER (PARTITION BY series ORDER BY idx) AS nxt FROM beats WHERE idx % 5 = 0), x AS (SELECT series, idx AS cand, t AS ct FROM beats WHERE idx % 5 = 2)
SELECT c.series, c.idx, x.cand FROM c JOIN x ON x.series = c.series AND x.ct BETWEEN c.t - 45 AND coalesce(c.nxt, c.t + 240) + 45""")
def joi14(spark: SparkSession, sf: str) -> DataFrame:
    b = _beats(spark, sf)
    c = b.where("idx % 5 = 0").withColumn("hi", F.coalesce(F.lead("t").over(R.over("series", "idx")), F.col("t") + 240) + 45).select("series", "idx", (F.col("t") - 45).alias("lo"), "hi")
    x = b.where("idx % 5 = 2").select("series", F.col("idx").alias("cand"), F.col("t").alias("ct"))
    cell = 86_400.0
    cells = c.withColumn("c", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    return cells.join(x.withColumn("c", F.floor(F.col("ct") / cell)), ["series", "c"]).where("ct BETWEEN lo AND hi").select("series", "idx", "cand")


@query("joi15_consecutive", f"WITH {A.PLAYLISTS_SQL} SELECT playlist, pos, track, nxt FROM (SELECT playlist, pos, track, lead(track) OVER w AS nxt, lead(pos) OVER w AS np FROM playlists WHERE track % 10 <> 0 WINDOW w AS (PARTITION BY playlist ORDER BY pos)) WHERE np = pos + 1")
def joi15(spark: SparkSession, sf: str) -> DataFrame:
    w = "OVER (PARTITION BY playlist ORDER BY pos)"
    p = A.playlists(spark, sf).where("track % 10 <> 0").selectExpr("playlist", "pos", "track", f"lead(track) {w} AS nxt", f"lead(pos) {w} AS np")
    return p.where("np = pos + 1").select("playlist", "pos", "track", "nxt")


@query("str05_burst_suppression", "WITH e AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS b FROM events) SELECT event_id, user_id FROM e WHERE b IS NULL OR ts - b > INTERVAL 6 HOUR")
def str05(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts")
    e = A.table(spark, sf, "events").withColumn("b", F.lag("ts").over(w))
    return e.where("b IS NULL OR ts - b > INTERVAL '6' HOUR").select("event_id", "user_id")


@query("str04_wheel_deltas", "WITH e AS (SELECT event_id, user_id, ts, CAST((event_id * 37) % 128 AS INT) AS raw FROM events), l AS (SELECT *, lag(raw) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM e) SELECT event_id, CASE WHEN (raw - b + 128) % 128 > 64 THEN (raw - b + 128) % 128 - 128 ELSE (raw - b + 128) % 128 END AS delta FROM l")
def str04(spark: SparkSession, sf: str) -> DataFrame:
    from crateflow.functions.wire import wheel_delta

    e = A.table(spark, sf, "events").selectExpr("event_id", "user_id", "ts", "CAST((event_id * 37) % 128 AS INT) AS raw")
    return e.withColumn("b", F.lag("raw").over(R.over("user_id", "ts"))).select("event_id", wheel_delta(F.col("raw"), F.col("b")).alias("delta"))


@query("str07_temporary_settings", f"WITH {A.PLAYLISTS_SQL}, s AS (SELECT playlist, pos, CASE WHEN track % 7 = 0 THEN track END AS o FROM playlists), c AS (SELECT playlist, pos, last_value(o IGNORE NULLS) OVER w AS setting, last_value(CASE WHEN o IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS since FROM s WINDOW w AS (PARTITION BY playlist ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT playlist, pos, CASE WHEN pos < since + 3 THEN setting END AS setting FROM c")
def str07(spark: SparkSession, sf: str) -> DataFrame:
    w = R.over("playlist", "pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("track") % 7 == 0, F.struct("pos", "track"))
    p = A.playlists(spark, sf).withColumn("last", F.last(own, ignorenulls=True).over(w))
    return p.select("playlist", "pos", F.when(F.col("pos") < F.col("last.pos") + 3, F.col("last.track")).alias("setting"))


@query("str11_block_index", f"{_B} SELECT series, CAST(idx // 16 AS BIGINT) AS block, count(*) AS n, round(sum(v), 6) AS s FROM beats GROUP BY 1, 2")
def str11(spark: SparkSession, sf: str) -> DataFrame:
    return _beats(spark, sf).groupBy("series", F.floor(F.col("idx") / 16).alias("block")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("s"))
