"""Queries: evaluation metrics and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow import adapters as A
from crateflow.operators import calibration as C
from crateflow.operators import metrics as M
from crateflow.operators import requests as N
from crateflow.plans.core import query

_EVAL = "e AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, CAST(d.n_chars > 800 AS INT) AS q, CAST(d.n_chars % 7 = 0 AS INT) AS x FROM documents d JOIN labels l USING (doc_id))"
_LONG = "l AS (SELECT doc_id, lang, 'quality' AS head, quality AS truth, q AS guess FROM e UNION ALL SELECT doc_id, lang, 'toxic', toxic, x FROM e)"


def _eval(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").selectExpr("doc_id", "lang", "source", "CAST(n_chars > 800 AS INT) AS q", "CAST(n_chars % 7 = 0 AS INT) AS x")
    return d.join(A.table(spark, sf, "labels"), "doc_id")


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("quality").alias("head"), F.col("quality").alias("truth"), F.col("q").alias("guess")), F.struct(F.lit("toxic").alias("head"), F.col("toxic").alias("truth"), F.col("x").alias("guess")))
    return _eval(spark, sf).select(F.col("doc_id").alias("row"), "lang", F.inline(pairs))


_RATES = "round(avg(CASE WHEN truth <> 0 THEN (guess = truth)::INT END), 6) AS recall, round(avg(CASE WHEN truth <> 0 THEN (guess <> truth AND guess <> 0)::INT END), 6) AS wrong, round(avg(CASE WHEN truth = 0 THEN (guess <> 0)::INT END), 6) AS false_alarms"


@query("agg04_rollup_top", f"WITH {A.TRACKS_SQL} SELECT coalesce(genre, 'total') AS genre, count(*) AS n, count(*) FILTER (bpm > 0) AS known, count(*) FILTER (key_idx IS NULL) AS keyless FROM tracks GROUP BY ROLLUP (genre) ORDER BY n DESC, genre LIMIT 11")
def agg04(spark: SparkSession, sf: str) -> DataFrame:
    r = A.tracks(spark, sf).rollup("genre").agg(F.count("*").alias("n"), F.count_if(F.col("bpm") > 0).alias("known"), F.count_if(F.col("key_idx").isNull()).alias("keyless"))
    return r.withColumn("genre", F.coalesce("genre", F.lit("total"))).orderBy(F.desc("n"), "genre").limit(11)


@query("agg05_head_rates", f"WITH {_EVAL}, {_LONG}, x AS (SELECT lang, avg(ok) AS exact FROM (SELECT lang, doc_id, min((truth = guess)::INT) AS ok FROM l GROUP BY 1, 2) GROUP BY lang), r AS (SELECT lang, {_RATES} FROM l GROUP BY lang) SELECT r.lang, round(x.exact, 6) AS exact, recall, wrong, false_alarms FROM r JOIN x USING (lang)")
def agg05(spark: SparkSession, sf: str) -> DataFrame:
    r = M.head_rates(_heads(spark, sf), ["lang"])
    return r.select("lang", *[F.round(c, 6).alias(c) for c in ("exact", "recall", "wrong", "false_alarms")])


@query("agg06_medians", "SELECT event_type, CAST(user_id % 3 AS BIGINT) AS variant, round(median(value), 6) AS mid, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2")
def agg06(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(~F.isnan("value"), F.col("value"))
    return A.table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 3).alias("variant")).agg(F.round(F.median(v), 6).alias("mid"), F.round(F.avg(v), 6).alias("mean"))


@query("agg07_paired", "WITH w AS (SELECT user_id, max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id) SELECT round(median(b - a), 6) AS median, round(avg(b - a), 6) AS mean, count(*) FILTER (b > a) AS improved, count(*) AS n FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def agg07(spark: SparkSession, sf: str) -> DataFrame:
    r = M.paired(A.table(spark, sf, "events"), "user_id", "event_type", "value", "view", "click")
    return r.select(F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"), "improved", "n")


@query("agg08_weighted_means", "SELECT lang, round(sum(x * n_chars) / sum(CASE WHEN x IS NOT NULL THEN n_chars END), 3) AS mean FROM (SELECT lang, n_chars, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 100) / 100e0 END AS x FROM documents) GROUP BY lang")
def agg08(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 100) / 100.0)
    return A.table(spark, sf, "documents").groupBy("lang").agg(F.round(M.weighted_mean(x, F.col("n_chars")), 3).alias("mean"))


@query("agg09_filtered_subsets", f"WITH {_EVAL} SELECT source, round(avg((quality = q)::INT), 6) AS all_rows, round(avg(CASE WHEN doc_id % 2 = 0 THEN (quality = q)::INT END), 6) AS verified, count(*) FILTER (doc_id % 10 >= 7) AS held FROM e GROUP BY source")
def agg09(spark: SparkSession, sf: str) -> DataFrame:
    hit = (F.col("quality") == F.col("q")).cast("int")
    return _eval(spark, sf).groupBy("source").agg(F.round(F.avg(hit), 6).alias("all_rows"), F.round(F.avg(F.when(F.col("doc_id") % 2 == 0, hit)), 6).alias("verified"), F.count_if(F.col("doc_id") % 10 >= 7).alias("held"))


@query("agg10_first_best", f"WITH {A.TRACKS_SQL} SELECT genre, arg_min(id, -energy * 100000 + id) AS id FROM tracks GROUP BY genre")
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    best = F.max(F.struct("energy", (-F.col("id")).alias("n")))
    return A.tracks(spark, sf).groupBy("genre").agg(best.alias("b")).select("genre", (-F.col("b.n")).alias("id"))


@query("agg18_ensemble", "WITH f AS (SELECT label, i, embedding[i]::DOUBLE * 8 AS x FROM embeddings, (SELECT unnest(range(1, 9)) AS i)), p AS (SELECT label, i, greatest(1e-6, least(1 - 1e-6, avg(1 / (1 + exp(-x))))) AS p FROM f GROUP BY 1, 2) SELECT label, CAST(i - 1 AS INT) AS frame, round(ln(p / (1 - p)), 6) AS logit FROM p")
def agg18(spark: SparkSession, sf: str) -> DataFrame:
    f = A.table(spark, sf, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 8)).alias("frame", "x")).select("label", "frame", (F.col("x").cast("double") * 8).alias("x"))
    return M.ensemble(f, ["label", "frame"], "x").select("label", "frame", F.round("logit", 6).alias("logit"))


@query("agg22_benchmark_summary", "SELECT event_type AS config, count(*) FILTER (value > 50) || '/' || count(*) AS hits, round(avg(value), 6) AS mean, round(max(value), 6) AS top, array_to_string(list_sort(list(user_id) FILTER (value > 99.9)), ',') AS misses FROM events GROUP BY event_type")
def agg22(spark: SparkSession, sf: str) -> DataFrame:
    hits = F.concat(F.count_if(F.col("value") > 50).cast("string"), F.lit("/"), F.count("*").cast("string"))
    misses = F.sort_array(F.collect_list(F.when(F.col("value") > 99.9, F.col("user_id"))))
    r = A.table(spark, sf, "events").groupBy(F.col("event_type").alias("config")).agg(hits.alias("hits"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"), misses.alias("m"))
    return r.select("config", "hits", "mean", "top", F.when(F.size("m") > 0, F.array_join(F.col("m").cast("array<string>"), ",")).alias("misses"))


@query("agg23_pivot_table", "SELECT source, round(avg(n_chars) FILTER (lang = 'en'), 6) AS en, round(avg(n_chars) FILTER (lang = 'fr'), 6) AS fr, round(avg(n_chars) FILTER (lang = 'de'), 6) AS de FROM documents GROUP BY source")
def agg23(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").groupBy("source").pivot("lang", ["en", "fr", "de"]).agg(F.round(F.avg("n_chars"), 6))


@query("agg24_by_group", f"WITH {_EVAL} SELECT source IN ('src1', 'src2', 'src3') AS club, count(*) AS n, round(avg((quality = q)::INT), 6) AS hit FROM e GROUP BY 1")
def agg24(spark: SparkSession, sf: str) -> DataFrame:
    e = _eval(spark, sf)
    rows = e.where("held") if "held" in e.columns else e
    return rows.groupBy(F.col("source").isin("src1", "src2", "src3").alias("club")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == F.col("q")).cast("int")), 6).alias("hit"))


@query("sig21_grid_checks", f"WITH {A.TRACKS_SQL} SELECT id, CAST(floor((duration - grid_offset) * bpm / 60) + 1 AS BIGINT) AS points, least((grid_offset + 0.05e0) % (240 / bpm), 240 / bpm - (grid_offset + 0.05e0) % (240 / bpm)) <= 0.07e0 AS on_down FROM tracks WHERE bpm > 0")
def sig21(spark: SparkSession, sf: str) -> DataFrame:
    bar = 240 / F.col("bpm")
    d = F.pmod(F.col("grid_offset") + 0.05, bar)
    return A.tracks(spark, sf).where("bpm > 0").select("id", (F.floor((F.col("duration") - F.col("grid_offset")) * F.col("bpm") / 60) + 1).alias("points"), (F.least(d, bar - d) <= 0.07).alias("on_down"))


@query("sig22_sdr_frames", f"WITH {A.BEATS_SQL} SELECT series, CAST(idx // 16 AS BIGINT) AS frame, round(CASE WHEN sum(v * v) > 1e-6 THEN 10 * log10((sum(v * v) + 1e-12) / (sum((v - round(v, 0)) * (v - round(v, 0))) + 1e-12)) END, 5) AS sdr FROM beats GROUP BY 1, 2")
def sig22(spark: SparkSession, sf: str) -> DataFrame:
    b = A.beats(spark, sf).withColumn("frame", F.floor(F.col("idx") / 16)).withColumn("est", F.round("v", 0))
    return M.sdr(b, ["series", "frame"], "v", "est").select("series", "frame", F.round("sdr", 5).alias("sdr"))


_GRID = "(SELECT range / 10e0 AS threshold FROM range(1, 9))"


_HEADS = ("filters", "option", "control", "talk")
_CLAUSE_GRID, _FULL_GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 1.01), (0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1.01)
#: Four events in a row are a message with its heads; a probability follows from an event's value.
_JUDGED = [
    "CAST(floor(event_id / 4) AS BIGINT) AS message", "event_id % 4 AS h", "CAST(user_id % 3 AS INT) AS truth", "CAST(CASE WHEN event_id % 7 = 0 THEN user_id % 3 ELSE 0 END AS INT) AS rule",
    "1 - (value % 50) / 100e0 AS clause_p", "CAST(CASE WHEN event_id % 5 = 0 THEN NULL WHEN value % 10 < 7 THEN user_id % 3 ELSE 1 + event_id % 2 END AS INT) AS clause_label",
    "1 - (value % 33) / 100e0 AS full_p", "CAST(CASE WHEN value % 9 < 7 THEN user_id % 3 ELSE 2 END AS INT) AS full_label",
]
_MERGED = "CASE WHEN rule > 0 THEN rule WHEN coalesce(clause_label, 0) > 0 AND clause_p >= tc THEN clause_label WHEN full_label > 0 AND full_p >= tf THEN full_label ELSE 0 END"
_SCORED = "sum(CASE WHEN said = truth AND truth > 0 THEN 1 WHEN said > 0 AND said <> truth THEN -3 ELSE 0 END)"
_PICK = "QUALIFY row_number() OVER (PARTITION BY head ORDER BY score DESC, tc, tf) = 1"


@query("nlu05_tuned_threshold", f"""WITH r AS (SELECT *, {list(_HEADS)}[h + 1] AS head FROM (SELECT {", ".join(_JUDGED)} FROM events)), g AS (SELECT * FROM (SELECT unnest({list(_CLAUSE_GRID)}) AS tc), (SELECT unnest({list(_FULL_GRID)}) AS tf)),
s AS (SELECT head, tc, tf, {_SCORED} AS score FROM (SELECT *, {_MERGED} AS said FROM r, g WHERE head <> 'talk') GROUP BY ALL), b AS (SELECT * FROM s {_PICK}),
o AS (SELECT DISTINCT message FROM (SELECT r.*, {_MERGED} AS said FROM r JOIN b USING (head)) WHERE said > 0),
t AS (SELECT head, tc, tf, {_SCORED} AS score FROM (SELECT *, CASE WHEN rule = 0 AND message IN (SELECT message FROM o) THEN 0 ELSE {_MERGED} END AS said FROM r, g WHERE head = 'talk') GROUP BY ALL), u AS (SELECT * FROM t {_PICK})
SELECT head, CAST(tc AS DOUBLE) AS clause, CAST(tf AS DOUBLE) AS "full", CAST(score AS BIGINT) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM u)""")
def nlu05(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "events").selectExpr(*_JUDGED)
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("h") + 1).cast("int"))
    return N.tuned_thresholds(rows.withColumn("head", head), _CLAUSE_GRID, _FULL_GRID)


@query("nlu06_systems_table", f"""WITH {_EVAL}, {_LONG}, s AS (SELECT 'rule' AS system, doc_id, head, truth, CASE WHEN head = 'quality' THEN guess ELSE 0 END AS guess FROM l UNION ALL SELECT 'model', doc_id, head, truth, guess FROM l UNION ALL SELECT 'both', doc_id, head, truth, coalesce(nullif(CASE WHEN head = 'quality' THEN guess ELSE 0 END, 0), guess) FROM l),
x AS (SELECT system, avg(ok) AS exact FROM (SELECT system, doc_id, min((truth = guess)::INT) AS ok FROM s GROUP BY 1, 2) GROUP BY system), r AS (SELECT system, {_RATES} FROM s GROUP BY system) SELECT r.system, round(x.exact, 6) AS exact, recall, wrong, false_alarms FROM r JOIN x USING (system)""")
def nlu06(spark: SparkSession, sf: str) -> DataFrame:
    h = _heads(spark, sf)
    rule = F.when(F.col("head") == "quality", F.col("guess")).otherwise(0)
    both = F.coalesce(F.nullif(rule, F.lit(0)), F.col("guess"))
    systems = F.array(*[F.struct(F.lit(n).alias("system"), g.alias("g")) for n, g in (("rule", rule), ("model", F.col("guess")), ("both", both))])
    rows = h.select("row", "head", "truth", F.inline(systems)).withColumnRenamed("g", "guess")
    r = M.head_rates(rows, ["system"])
    return r.select("system", *[F.round(c, 6).alias(c) for c in ("exact", "recall", "wrong", "false_alarms")])


@query("nlu08_compare_partitions", f"WITH {_EVAL} SELECT CASE WHEN doc_id < 500 THEN 'old' ELSE 'new' END AS part, round(avg((quality = q)::INT), 6) AS first, round(avg((quality = 1)::INT), 6) AS second FROM e GROUP BY 1")
def nlu08(spark: SparkSession, sf: str) -> DataFrame:
    part = F.when(F.col("doc_id") < 500, "old").otherwise("new")
    return _eval(spark, sf).groupBy(part.alias("part")).agg(F.round(F.avg((F.col("quality") == F.col("q")).cast("int")), 6).alias("first"), F.round(F.avg((F.col("quality") == 1).cast("int")), 6).alias("second"))


_SHIFTS = [k / 4 - 3 for k in range(17)]
#: Frames a quarter of a second apart, a beat at every second, a reference's event at every fourth beat.
_FRAME, _BEAT, _EVENT = "idx * 0.25e0 AS t, (v - 100) / 40e0 AS score", "idx * 0.25e0 + 0.03e0 AS t", "idx * 0.25e0 + 0.01e0 AS t"


@query("sig24_calibration", f"""WITH {A.BEATS_SQL}, fr AS (SELECT series, idx, {_FRAME} FROM beats), be AS (SELECT series, {_BEAT} FROM beats WHERE idx % 2 = 0), re AS (SELECT series, {_EVENT} FROM beats WHERE idx % 8 = series % 4 * 2),
tp AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM fr) WHERE score = top), pk AS (SELECT series, avg(t) AS t, max(score) AS score FROM (SELECT *, idx - row_number() OVER (PARTITION BY series ORDER BY idx) AS run FROM tp) GROUP BY series, run),
nb AS (SELECT p.series, p.t, p.score, arg_min(b.t, (abs(b.t - p.t), b.t)) AS bt FROM pk p JOIN be b USING (series) GROUP BY ALL), g AS (SELECT unnest({_SHIFTS}) AS shift),
e AS (SELECT DISTINCT shift, series, bt FROM nb, g WHERE score + shift > 0 AND bt >= 5), n AS (SELECT shift, series, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT DISTINCT series, t FROM re WHERE t >= 5), w AS (SELECT series, count(*) AS w FROM r GROUP BY ALL),
h AS (SELECT shift, e.series, count(DISTINCT r.t) AS h FROM e JOIN r ON e.series = r.series AND abs(r.t - bt) <= 0.07 GROUP BY ALL),
f AS (SELECT shift, CASE WHEN coalesce(n, 0) + coalesce(w, 0) = 0 THEN 1e0 ELSE 2e0 * coalesce(h, 0) / (coalesce(n, 0) + coalesce(w, 0)) END AS f FROM (SELECT * FROM (SELECT DISTINCT series FROM re), g) LEFT JOIN n USING (shift, series) LEFT JOIN w USING (series) LEFT JOIN h USING (shift, series))
SELECT CAST(shift AS DOUBLE) AS shift, round(avg(f), 6) AS score FROM f GROUP BY shift""")
def sig24(spark: SparkSession, sf: str) -> DataFrame:
    b = A.beats(spark, sf)
    frames, beats, events = b.selectExpr("series", "idx", *_parts(_FRAME)), b.where("idx % 2 = 0").selectExpr("series", *_parts(_BEAT)), b.where("idx % 8 = series % 4 * 2").selectExpr("series", *_parts(_EVENT))
    got = C.agreement_by_shift(C.peaks(frames), beats, events, _SHIFTS)
    return got.select("shift", F.round("score", 6).alias("score"))


def _parts(sql: str) -> list[str]:
    return sql.split(", ")


@query("sig25_audible_span", f"WITH {A.BEATS_SQL}, l AS (SELECT series, idx, 20 * log10(v + 1e-9) AS db FROM beats), m AS (SELECT *, max(db) OVER (PARTITION BY series) AS top FROM l) SELECT series, min(idx) AS first, max(idx) AS last FROM m WHERE db > top - 40 GROUP BY series")
def sig25(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    level = A.beats(spark, sf).withColumn("db", 20 * F.log10(F.col("v") + 1e-9))
    top = level.withColumn("top", F.max("db").over(Window.partitionBy("series")))
    return top.where("db > top - 40").groupBy("series").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


@query("sig19_bit_fingerprint", f"WITH {A.BEATS_SQL}, d AS (SELECT series, idx, v - lag(v) OVER w - (lag(v) OVER w - lag(v, 2) OVER w) AS d2 FROM beats WINDOW w AS (PARTITION BY series ORDER BY idx)) SELECT series, idx, CASE WHEN d2 > 0 THEN 1 ELSE -1 END AS bit FROM d WHERE d2 IS NOT NULL")
def sig19(spark: SparkSession, sf: str) -> DataFrame:
    from crateflow.operators.series import over

    w = over("series", "idx")
    d2 = F.col("v") - F.lag("v").over(w) - (F.lag("v").over(w) - F.lag("v", 2).over(w))
    return A.beats(spark, sf).select("series", "idx", d2.alias("d2")).where("d2 IS NOT NULL").select("series", "idx", F.when(F.col("d2") > 0, 1).otherwise(-1).alias("bit"))


@query("sig01_mono", "SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: (embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2 * i)), 6) AS checksum FROM embeddings")
def sig01(spark: SparkSession, sf: str) -> DataFrame:
    mono = F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    weighted = F.transform(mono, lambda x, i: x * (i + 1))
    return A.table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))
