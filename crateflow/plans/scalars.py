"""Queries: scalar rules of tempo, key, energy, grids and controllers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow import adapters as A
from crateflow.functions import music, wire
from crateflow.plans import sqlparts as S
from crateflow.plans.core import query

_PAIR_SQL = f"{A.KEYED_SQL}, pair AS (SELECT a.id, b.id AS other, a.bpm AS abpm, b.bpm AS bbpm, a.camelot_n AS an, a.camelot_l AS al, b.camelot_n AS bn, b.camelot_l AS bl, a.energy AS ae, b.energy AS be, a.genre AS ag, b.genre AS bg FROM keyed a JOIN keyed b ON b.id = (a.id * 13 + 7) % (SELECT count(*) FROM part))"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = A.table(spark, sf, "part").agg(F.count("*").alias("n"))
    t = A.keyed(spark, sf)
    a = t.crossJoin(F.broadcast(n)).select("id", ((F.col("id") * 13 + 7) % F.col("n")).alias("other"), F.col("bpm").alias("abpm"), F.col("camelot_n").alias("an"), F.col("camelot_l").alias("al"), F.col("energy").alias("ae"), F.col("genre").alias("ag"))
    b = t.select(F.col("id").alias("other"), F.col("bpm").alias("bbpm"), F.col("camelot_n").alias("bn"), F.col("camelot_l").alias("bl"), F.col("energy").alias("be"), F.col("genre").alias("bg"))
    return a.join(b, "other")


@query("mus_f01_keys", f"WITH {A.KEYED_SQL} SELECT t.id, t.code, (k.tonic + 5) % 12 AS fifth, o.key AS shifted FROM keyed t JOIN keys k USING (key_idx) JOIN keys o ON o.tonic = (k.tonic + 3) % 12 AND o.minor = k.minor")
def mus_f01(spark: SparkSession, sf: str) -> DataFrame:
    """Every track's key read from its name, and its name three semitones up."""
    parsed = A.keyed(spark, sf).withColumn("p", wire.parse_key(F.col("key"))).where("p IS NOT NULL")
    o = F.broadcast(A.keys(spark).select(F.col("key").alias("shifted"), F.col("tonic").alias("t"), F.col("minor").alias("m")))  # 24 rows
    return parsed.join(o, (F.col("t") == (F.col("p.tonic") + 3) % 12) & (F.col("m") == F.col("p.minor"))).select("id", "code", ((F.col("p.tonic") + 5) % 12).alias("fifth"), "shifted")


@query("mus_f02_tempo_ratio", f"WITH {_PAIR_SQL} SELECT id, other, round({S.ratio('abpm', 'bbpm')}, 9) AS ratio FROM pair")
def mus_f02(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id", "other", F.round(music.tempo_ratio(F.col("abpm"), F.col("bbpm")), 9).alias("ratio"))


@query("mus_f03_bpm_score", f"WITH {_PAIR_SQL} SELECT id, other, round({S.bpm_score('abpm', 'bbpm')}, 6) AS score FROM pair")
def mus_f03(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id", "other", F.round(music.bpm_score(F.col("abpm"), F.col("bbpm")), 6).alias("score"))


@query("mus_f04_key_score", f"WITH {A.KEYED_SQL}, {A.PLAYLISTS_SQL}, p AS (SELECT playlist, pos, track, lead(track) OVER (PARTITION BY playlist ORDER BY pos) AS nxt FROM playlists) SELECT playlist, pos, a.code AS a, b.code AS b, {S.key_score('a.camelot_n', 'a.camelot_l', 'b.camelot_n', 'b.camelot_l')} AS score FROM p JOIN keyed a ON a.id = track JOIN keyed b ON b.id = nxt")
def mus_f04(spark: SparkSession, sf: str) -> DataFrame:
    """How well the keys of neighbours in all playlists go together."""
    t = A.keyed(spark, sf)
    a, b = (t.select(F.col("id").alias(f"_{x}"), F.col("code").alias(x), F.col("camelot_n").alias(f"{x}n"), F.col("camelot_l").alias(f"{x}l")) for x in "ab")
    p = A.playlists(spark, sf).selectExpr("playlist", "pos", "track", "lead(track) OVER (PARTITION BY playlist ORDER BY pos) AS nxt")
    pairs = p.join(a, F.col("track") == F.col("_a")).join(b, F.col("nxt") == F.col("_b"))
    return pairs.select("playlist", "pos", "a", "b", music.key_score(F.col("an"), F.col("al"), F.col("bn"), F.col("bl")).alias("score"))


_WANT = "CASE s WHEN 'rise' THEN least(10e0, cur + CASE WHEN step % 2 = 0 THEN 1 ELSE 0 END) WHEN 'wave' THEN greatest(3e0, least(10e0, 6.5e0 + sin(step / 6e0 * 3.141592653589793e0 * 2) * 3)) WHEN 'chill' THEN least(cur, 5e0) WHEN 'peak' THEN 9e0 ELSE cur END"


@query("mus_f05_target_energy", f"SELECT event_id, s AS strategy, round({_WANT}, 6) AS want FROM (SELECT *, CASE WHEN energy = 0 THEN 6e0 ELSE energy::DOUBLE END AS cur FROM (SELECT event_id, ['steady','rise','wave','chill','peak'][user_id % 5 + 1] AS s, event_id % 11 AS energy, CAST(floor(value) AS BIGINT) % 12 AS step FROM events))")
def mus_f05(spark: SparkSession, sf: str) -> DataFrame:
    """The energy wanted after each event of a set; a user keeps to one strategy."""
    base = A.table(spark, sf, "events").selectExpr("event_id", "user_id % 5 AS k", "CAST(event_id % 11 AS INT) AS energy", "CAST(CAST(floor(value) AS BIGINT) % 12 AS INT) AS step")
    strategies = ("steady", "rise", "wave", "chill", "peak")
    name, want = None, None
    for k, s in enumerate(strategies):
        value = music.target_energy(s, F.col("energy"), F.col("step")).cast("double")
        name = F.when(F.col("k") == k, s) if name is None else name.when(F.col("k") == k, s)
        want = F.when(F.col("k") == k, value) if want is None else want.when(F.col("k") == k, value)
    return base.select("event_id", name.alias("strategy"), F.round(want, 6).alias("want"))


@query("mus_f06_genre_similarity", f"WITH {A.TRACKS_SQL}, g AS (SELECT id, CASE WHEN id % 23 = 0 THEN '' ELSE genre || CASE WHEN id % 2 = 0 THEN ', Club' ELSE '/Radio Mix' END END AS g FROM tracks) SELECT a.id, b.id AS other, {S.genre_similarity('a.g', 'b.g')} AS s FROM g a JOIN g b ON b.id = (a.id * 13 + 7) % (SELECT count(*) FROM part)")
def mus_f06(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("id") % 23 == 0, "").otherwise(F.concat("genre", F.when(F.col("id") % 2 == 0, ", Club").otherwise("/Radio Mix")))
    g = A.tracks(spark, sf).select("id", name.alias("a"))
    n = F.broadcast(g.agg(F.count("*").alias("n")))  # one row
    pairs = g.crossJoin(n).withColumn("other", (F.col("id") * 13 + 7) % F.col("n"))
    return pairs.join(g.select(F.col("id").alias("other"), F.col("a").alias("b")), "other").select("id", "other", music.genre_similarity(F.col("a"), F.col("b")).alias("s"))


@query("mus_f07_candidate_score", f"WITH {A.KEYED_SQL}, p AS (SELECT a.id, b.id AS other, round({S.score('a', 'b')}, 6) AS score FROM keyed a JOIN keyed b ON b.id = (a.id * 13 + 7) % (SELECT count(*) FROM part)) SELECT * FROM p")
def mus_f07(spark: SparkSession, sf: str) -> DataFrame:
    n = A.table(spark, sf, "part").agg(F.count("*").alias("n"))
    names = ("bpm", "camelot_n", "camelot_l", "energy", "genre", "artist")
    t = A.keyed(spark, sf)
    a = t.crossJoin(F.broadcast(n)).select("id", ((F.col("id") * 13 + 7) % F.col("n")).alias("other"), *[F.col(c).alias("a_" + c) for c in names])
    b = t.select(F.col("id").alias("other"), *[F.col(c).alias("b_" + c) for c in names])
    score = music.candidate_score({c: F.col("a_" + c) for c in names}, {c: F.col("b_" + c) for c in names})
    return a.join(b, "other").select("id", "other", F.round(score, 6).alias("score"))


@query("mus_f08_transition", f"WITH {_PAIR_SQL} SELECT id, other, CASE WHEN {S.ratio('abpm', 'bbpm')} = 0 OR abs({S.ratio('abpm', 'bbpm')} - 1) * 100 > 8 THEN 'echo' WHEN {S.key_score('an', 'al', 'bn', 'bl')} < 0.5 THEN 'filter' WHEN be > ae THEN 'bassswap' WHEN be < ae - 2 THEN 'fade' ELSE 'bassswap' END AS kind FROM pair")
def mus_f08(spark: SparkSession, sf: str) -> DataFrame:
    key = music.key_score(F.col("an"), F.col("al"), F.col("bn"), F.col("bl"))
    return _pairs(spark, sf).select("id", "other", music.plan_transition(F.col("abpm"), F.col("bbpm"), key, F.col("ae"), F.col("be")).alias("kind"))


_SWAP = f"CASE WHEN p < 0.5 THEN {S.ease('p / 0.5e0')} * 0.5e0 ELSE 0.5e0 + {S.ease('(p - 0.5e0) / 0.5e0')} * 0.5e0 END"


@query("mus_f09_automation", f"""SELECT event_id, kind, CAST(i AS INT) AS i, round(CASE kind WHEN 'bassswap' THEN {_SWAP} WHEN 'filter' THEN {S.ease('(p - 0.15e0) / 0.85e0')} WHEN 'echo' THEN {S.ease('(p - 0.55e0) / 0.45e0')} WHEN 'cut' THEN CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END WHEN 'rapid' THEN CASE WHEN p >= 0.98 THEN 1e0 ELSE 0e0 END ELSE {S.ease('p')} END, 6) AS xf,
CASE WHEN kind IN ('bassswap', 'rapid') AND p >= 0.5 THEN -1e0 ELSE 0e0 END AS out_low, round(CASE kind WHEN 'filter' THEN {S.ease('p / 0.9e0')} * 0.85e0 WHEN 'rapid' THEN {S.ease('p / 0.9e0')} * 0.6e0 ELSE 0e0 END, 6) AS out_filter, CASE WHEN kind = 'echo' AND p >= 0.6 THEN 0e0 ELSE 1e0 END AS out_level
FROM (SELECT event_id, kind, i, i / 20e0 AS p FROM (SELECT event_id, ['fade','bassswap','filter','echo','cut','rapid'][user_id % 6 + 1] AS kind, CAST(floor(value) AS BIGINT) % 21 AS i FROM events))""")
def mus_f09(spark: SparkSession, sf: str) -> DataFrame:
    """The controls at the place of a transition that each event tells."""
    kinds = F.array(*map(F.lit, ("fade", "bassswap", "filter", "echo", "cut", "rapid")))
    grid = A.table(spark, sf, "events").select("event_id", F.element_at(kinds, (F.col("user_id") % 6 + 1).cast("int")).alias("kind"), (F.floor("value") % 21).cast("int").alias("i"))
    s = music.transition_state(F.col("kind"), F.col("i") / 20.0)
    return grid.select("event_id", "kind", "i", F.round(s["xf"], 6).alias("xf"), s["out_low"].alias("out_low"), F.round(s["out_filter"], 6).alias("out_filter"), s["out_level"].alias("out_level"))


@query("mus_f10_mixer_curves", """SELECT event_id, round(CASE WHEN x <= 0 THEN 1e0 ELSE 1e0 - x END, 6) AS linear_a, round(cos((x + 1) / 2 * 1.5707963267948966e0), 6) AS smooth_a, round(sin((x + 1) / 2 * 1.5707963267948966e0), 6) AS smooth_b, CASE WHEN x < 0.98 THEN 1e0 ELSE 0e0 END AS cut_a, round(((x + 1) / 2) * ((x + 1) / 2), 6) AS fader FROM (SELECT event_id, (CAST(floor(value) AS BIGINT) % 41) / 20e0 - 1 AS x FROM events)""")
def mus_f10(spark: SparkSession, sf: str) -> DataFrame:
    g = A.table(spark, sf, "events").select("event_id", ((F.floor("value") % 41) / 20.0 - 1).alias("x"))
    c = wire.crossfader(F.col("x"))
    return g.select("event_id", *[F.round(v, 6).alias(k) for k, v in c.items()])


@query("mus_f11_energy_level", "SELECT series, round(d, 4) AS db, CAST(floor(1 + 9 * (0.6e0 * greatest(0e0, least(1e0, (d + 24) / 16e0)) + 0.4e0 * greatest(0e0, least(1e0, s))) + 0.5e0) AS INT) AS level FROM (SELECT user_id AS series, 20 * log10(sqrt(avg(value * value)) / 330 + 1e-9) AS d, avg(CASE WHEN value > 80 THEN 1e0 ELSE 0e0 END) AS s FROM events GROUP BY 1)")
def mus_f11(spark: SparkSession, sf: str) -> DataFrame:
    """The level of each series by its loudness and how much of it is loud."""
    v = F.col("value")
    db, share = 20 * F.log10(F.sqrt(F.avg(v * v)) / 330 + 1e-9), F.avg(F.when(v > 80, 1.0).otherwise(0.0))
    g = A.table(spark, sf, "events").groupBy(F.col("user_id").alias("series")).agg(db.alias("d"), share.alias("s"))
    return g.select("series", F.round("d", 4).alias("db"), music.energy_level(F.col("d"), F.col("s")).alias("level"))


_BAR = "(240e0 / bpm)"
_LATEST = f"(duration - 20 * {_BAR} - 0.5e0)"


@query("mus_f12_grid", f"""WITH {A.TRACKS_SQL} SELECT id, round({_BAR}, 6) AS bar, CAST(floor((duration / 2 - grid_offset) / {_BAR} + 0.5e0) + 1 AS INT) AS bar_no,
round(grid_offset + greatest(0, least(greatest(0, floor((duration - grid_offset) / {_BAR}) - 1), floor((duration / 2 - grid_offset) / {_BAR} + 0.5e0) + 8)) * {_BAR}, 6) AS stepped,
round(grid_offset + greatest(0, floor((least(CASE WHEN duration * 0.8e0 < duration - 4 THEN duration * 0.8e0 ELSE {_LATEST} - 8 END, {_LATEST}) - grid_offset) / {_BAR} + 1e-6)) * {_BAR}, 6) AS auto_start FROM tracks WHERE bpm > 0""")
def mus_f12(spark: SparkSession, sf: str) -> DataFrame:
    b, o, d = F.col("bpm"), F.col("grid_offset"), F.col("duration")
    return A.tracks(spark, sf).where("bpm > 0").select(
        "id", F.round(music.bar_length(b), 6).alias("bar"), music.bar_number(d / 2, o, b).alias("bar_no"),
        F.round(music.step_point(d / 2, 8, o, b, d), 6).alias("stepped"), F.round(music.auto_base_start(b, o, d, d * 0.8), 6).alias("auto_start"),
    )


@query("mus_f13_mix_schedule", f"""WITH {A.TRACKS_SQL}, {A.PLAYLISTS_SQL}, p AS (SELECT playlist, pos, bpm, grid_offset, duration, sum(duration - 16 * {_BAR}) OVER (PARTITION BY playlist ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM playlists JOIN tracks ON id = track WHERE bpm > 0)
SELECT playlist, pos, round(coalesce(ahead, 0e0), 4) AS starts, round(grid_offset + floor((duration - 16 * {_BAR} - grid_offset) / {_BAR}) * {_BAR}, 6) AS mix_out FROM p""")
def mus_f13(spark: SparkSession, sf: str) -> DataFrame:
    bar = music.bar_length(F.col("bpm"))
    t = A.tracks(spark, sf).where("bpm > 0").withColumn("bar", bar)
    t = A.playlists(spark, sf).join(t, F.col("track") == F.col("id"))
    ahead = F.expr("sum(duration - 16 * bar) OVER (PARTITION BY playlist ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    out = F.col("grid_offset") + F.floor((F.col("duration") - 16 * F.col("bar") - F.col("grid_offset")) / F.col("bar")) * F.col("bar")
    return t.select("playlist", "pos", F.round(F.coalesce(ahead, F.lit(0.0)), 4).alias("starts"), F.round(out, 6).alias("mix_out"))


@query("mus_f14_rapid_timing", f"""WITH {A.TRACKS_SQL} SELECT id, round(least(greatest(grid_offset + floor((10 + 16 * {_BAR} - grid_offset) / {_BAR} + 0.5e0) * {_BAR}, grid_offset + ceil((20 + {_BAR} + 0.25e0 - grid_offset) / {_BAR}) * {_BAR}), duration - 0.5e0), 6) AS cut FROM tracks WHERE bpm > 0""")
def mus_f14(spark: SparkSession, sf: str) -> DataFrame:
    bar, o = music.bar_length(F.col("bpm")), F.col("grid_offset")
    wanted = o + F.floor((10 + 16 * bar - o) / bar + 0.5) * bar
    earliest = o + F.ceil((20 + bar + 0.25 - o) / bar) * bar
    return A.tracks(spark, sf).where("bpm > 0").select("id", F.round(F.least(F.greatest(wanted, earliest), F.col("duration") - 0.5), 6).alias("cut"))


@query("mus_f15_gain_controls", """WITH g AS (SELECT range AS i, range / 100e0 - 1 AS x FROM range(201)), v AS (SELECT vec_id, embedding[1]::DOUBLE * embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE * embedding[2]::DOUBLE AS b FROM embeddings),
e AS (SELECT vec_id, i, x, abs(a / (a + b) - pow(cos((x + 1) / 2 * 1.5707963267948966e0), 2)) AS err FROM v, g WHERE a + b > 0)
SELECT vec_id, x AS crossfader FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(err, 12), i) = 1""")
def mus_f15(spark: SparkSession, sf: str) -> DataFrame:
    # a grid of 201 places, whatever the data
    g = F.broadcast(spark.range(201).select(F.col("id").alias("i"), (F.col("id") / 100.0 - 1).alias("x")))
    sq = [F.pow(F.col("embedding")[k].cast("double"), 2) for k in (0, 1)]
    v = A.table(spark, sf, "embeddings").select("vec_id", sq[0].alias("a"), sq[1].alias("b")).where("a + b > 0")
    err = F.round(F.abs(F.col("a") / (F.col("a") + F.col("b")) - F.pow(F.cos((F.col("x") + 1) / 2 * 1.5707963267948966), 2)), 12)
    return v.crossJoin(g).groupBy("vec_id").agg(F.min(F.struct(err.alias("e"), "i", "x")).alias("m")).select("vec_id", F.col("m.x").alias("crossfader"))


@query("mus_f16_tempo_accuracy", f"WITH {_PAIR_SQL} SELECT id, other, abs(abpm - bbpm) <= 0.5 AS exact, len(list_filter([1e0, 2e0, 0.5e0, 3e0, 1e0/3], lambda f: abs(abpm - bbpm * f) <= 0.04e0 * bbpm * f)) > 0 AS octave FROM pair WHERE abpm > 0 AND bbpm > 0")
def mus_f16(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf).where("abpm > 0 AND bbpm > 0")
    return p.select("id", "other", (F.abs(F.col("abpm") - F.col("bbpm")) <= 0.5).alias("exact"), music.tempo_right(F.col("abpm"), F.col("bbpm")).alias("octave"))


@query("mus_f17_loops", f"""WITH {A.TRACKS_SQL}, x AS (SELECT id, 60e0 / bpm AS beat, grid_offset AS o, duration AS d, duration / 3 AS p FROM tracks WHERE bpm > 0)
SELECT id, round(o + floor((p - o) / beat + 0.02e0) * beat, 6) AS loop_in, round(least(d, o + floor((p - o) / beat + 0.02e0) * beat + 8 * beat), 6) AS loop_out, round(greatest(0.01e0, least(600e0, 8 * beat * 2)), 6) AS doubled, CAST(floor((p - o) / (8 * beat)) AS INT) AS slice, round(greatest(0e0, least(d, p - 16 * beat)), 6) AS jumped FROM x""")
def mus_f17(spark: SparkSession, sf: str) -> DataFrame:
    beat, o, d = 60 / F.col("bpm"), F.col("grid_offset"), F.col("duration")
    p = d / 3
    start = music.snap_down(p, beat, o)
    return A.tracks(spark, sf).where("bpm > 0").select(
        "id", F.round(start, 6).alias("loop_in"), F.round(F.least(d, start + 8 * beat), 6).alias("loop_out"), F.round(F.greatest(F.lit(0.01), F.least(F.lit(600.0), 16 * beat)), 6).alias("doubled"),
        F.floor((p - o) / (8 * beat)).cast("int").alias("slice"), F.round(F.greatest(F.lit(0.0), F.least(d, p - 16 * beat)), 6).alias("jumped"),
    )


@query("mus_f18_sync", f"""WITH {_PAIR_SQL}, s AS (SELECT id, other, ({S.ratio('bbpm', 'abpm')} - 1) * 100 AS pitch, an, al, bn, bl FROM pair WHERE abpm > 0 AND bbpm > 0),
sh AS (SELECT * FROM (VALUES (0,0),(1,1),(2,-1),(3,2),(4,-2),(5,3),(6,-3),(7,4),(8,-4),(9,5),(10,-5),(11,6)) AS v(ord, shift)),
k AS (SELECT s.id, arg_min(shift, ord) AS shift FROM s, sh WHERE an IS NOT NULL AND bn IS NOT NULL AND (an - 1 + 7 * shift + 84) % 12 + 1 = bn GROUP BY s.id)
SELECT s.id, s.other, round(pitch, 6) AS pitch, CASE WHEN abs(pitch) <= 8 THEN 8 WHEN abs(pitch) <= 16 THEN 16 WHEN abs(pitch) <= 25 THEN 25 WHEN abs(pitch) <= 50 THEN 50 ELSE 100 END AS pitch_range, CAST(k.shift AS INT) AS shift FROM s LEFT JOIN k USING (id)""")
def mus_f18(spark: SparkSession, sf: str) -> DataFrame:
    s = _pairs(spark, sf).where("abpm > 0 AND bbpm > 0")
    pitch = (music.tempo_ratio(F.col("bbpm"), F.col("abpm")) - 1) * 100
    ladder = F.lit(music.PITCH_RANGES[-1])
    for r in reversed(music.PITCH_RANGES[:-1]):
        ladder = F.when(F.abs(pitch) <= r, r).otherwise(ladder)
    shifts = F.array(*[F.lit(x) for x in music.KEY_SHIFTS])
    hit = F.filter(shifts, lambda x: F.pmod(F.col("an") - 1 + 7 * x, F.lit(12)) + 1 == F.col("bn"))
    return s.select("id", "other", F.round(pitch, 6).alias("pitch"), ladder.alias("pitch_range"), F.try_element_at(hit, F.lit(1)).alias("shift"))


@query("midi_f01_decode", "WITH m AS (SELECT event_id, CAST(144 + event_id % 48 AS INT) AS status, CAST((event_id * 7) % 128 AS INT) AS d1, CAST((event_id * 11) % 128 AS INT) AS d2 FROM events) SELECT event_id, CASE status // 16 WHEN 9 THEN 'note' WHEN 11 THEN 'cc' ELSE 'other' END AS kind, status % 16 + 1 AS channel, d1, round(d2 / 127e0, 6) AS value, CASE WHEN d2 = 64 THEN 0 WHEN d2 > 64 THEN d2 - 128 ELSE d2 END AS twos, d2 - 64 AS centred FROM m")
def midi_f01(spark: SparkSession, sf: str) -> DataFrame:
    m = A.table(spark, sf, "events").selectExpr("event_id", "CAST(144 + event_id % 48 AS INT) AS status", "CAST((event_id * 7) % 128 AS INT) AS d1", "CAST((event_id * 11) % 128 AS INT) AS d2")
    c = wire.decode(F.col("status"), F.col("d1"), F.col("d2"))
    return m.select("event_id", c["kind"].alias("kind"), c["channel"].alias("channel"), "d1", F.round(c["value"], 6).alias("value"), wire.relative(F.col("d2"), "twos").alias("twos"), wire.relative(F.col("d2"), "centred").alias("centred"))


@query("src16_wav_samples", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CASE WHEN x < 0 THEN trunc(greatest(x::DOUBLE, -1e0) * 32768) ELSE trunc(least(x::DOUBLE, 1e0) * 32767) END AS INT)), ',') AS samples FROM embeddings")
def src16(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "embeddings").select("vec_id", F.array_join(wire.samples(F.col("embedding")).cast("array<string>"), ",").alias("samples"))
