"""Queries: joins, compatible pairs and entity matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow import adapters as A
from crateflow.operators import matching as M
from crateflow.plans import sqlparts as S
from crateflow.plans.core import query

_PAIRS = f"""known AS (SELECT id, bpm, camelot_n, camelot_l FROM keyed WHERE bpm > 0 AND code IS NOT NULL),
pairs AS (SELECT a.id AS base, b.id AS vocal, round(({S.ratio('a.bpm', 'b.bpm')} - 1) * 100, 6) AS pitch, round({S.key_score('a.camelot_n', 'a.camelot_l', 'b.camelot_n', 'b.camelot_l')} * {S.bpm_score('a.bpm', 'b.bpm')}, 6) AS score
 FROM known a JOIN known b ON a.id <> b.id WHERE {S.key_score('a.camelot_n', 'a.camelot_l', 'b.camelot_n', 'b.camelot_l')} >= 0.9 AND abs(round(({S.ratio('a.bpm', 'b.bpm')} - 1) * 100, 6)) <= 8)"""


@query("joi01_playlist_tracks", f"WITH {A.TRACKS_SQL}, {A.PLAYLISTS_SQL} SELECT p.playlist, p.pos, t.id, t.title FROM playlists p JOIN tracks t ON p.track = t.id WHERE t.id % 9 <> 0")
def joi01(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).where("id % 9 <> 0").select("id", "title")
    return A.playlists(spark, sf).join(t, F.col("track") == F.col("id")).select("playlist", "pos", "id", "title")


@query("joi01_history_tracks", f"WITH {A.TRACKS_SQL}, {A.HISTORY_SQL} SELECT h.event_id, h.played_at, t.title FROM history h JOIN tracks t ON h.id = t.id ORDER BY h.played_at DESC, h.event_id LIMIT 300")
def joi01b(spark: SparkSession, sf: str) -> DataFrame:
    last = A.history(spark, sf).orderBy(F.desc("played_at"), "event_id").limit(300)
    return last.join(A.tracks(spark, sf).select(F.col("id").alias("i"), "title"), F.col("id") == F.col("i")).select("event_id", "played_at", "title")


@query("joi02_mashup_status", f"""WITH {A.TRACKS_SQL}, {A.MASHUPS_SQL} SELECT m.base, m.vocal, CASE WHEN b.bpm = 0 OR v.bpm = 0 THEN 'missing' WHEN (m.base + m.vocal) % 11 = 0 THEN 'preparing' WHEN (m.base + m.vocal) % 13 = 0 THEN 'failed' WHEN (m.base + m.vocal) % 2 = 0 THEN 'ready' ELSE 'todo' END AS status
FROM mashups m LEFT JOIN tracks b ON m.base = b.id LEFT JOIN tracks v ON m.vocal = v.id""")
def joi02(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf)
    m = A.mashups(spark, sf).join(t.select(F.col("id").alias("b"), F.col("bpm").alias("bb")), F.col("base") == F.col("b"), "left")
    m = m.join(t.select(F.col("id").alias("v"), F.col("bpm").alias("vb")), F.col("vocal") == F.col("v"), "left")
    n = F.col("base") + F.col("vocal")
    status = F.when((F.col("bb") == 0) | (F.col("vb") == 0), "missing").when(n % 11 == 0, "preparing").when(n % 13 == 0, "failed").when(n % 2 == 0, "ready").otherwise("todo")
    return m.select("base", "vocal", status.alias("status"))


@query("joi03_untried_pairs", f"WITH {A.KEYED_SQL}, {A.MASHUPS_SQL}, {_PAIRS} SELECT p.base, p.vocal, p.score FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM mashups m WHERE m.base = p.base AND m.vocal = p.vocal) AND p.score >= 0.9")
def joi03(spark: SparkSession, sf: str) -> DataFrame:
    return M.untried_pairs(A.keyed(spark, sf), A.mashups(spark, sf), 0.9).select("base", "vocal", "score")


@query("joi05_suggest_partners", f"WITH {A.KEYED_SQL}, {_PAIRS} SELECT base, vocal, pitch, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY base ORDER BY score DESC, vocal) AS INT) AS place FROM pairs) WHERE place <= 6")
def joi05(spark: SparkSession, sf: str) -> DataFrame:
    return M.suggest_partners(A.keyed(spark, sf)).select("base", "vocal", "pitch", "score", "place")


@query("joi06_best_pair", f"WITH {A.KEYED_SQL}, {_PAIRS} SELECT base, vocal, score FROM pairs ORDER BY score DESC, base, vocal LIMIT 1")
def joi06(spark: SparkSession, sf: str) -> DataFrame:
    return M.best_pair(A.keyed(spark, sf))


_ENTRIES = [(1, "Golden Hour", "Nova Reyes"), (2, "golden hour (Extended)", "Kaito"), (3, "Citta' di Vetro [Remastered]", "Kaito Mori"), (4, "Nothing Here", ""), (5, "Perché no", "Aurélia feat. X"), (6, "Glass", "Kaito Mori")]
_LIBRARY = [(-1, "Golden Hour (Radio Edit)", "Nova Reyes", "/m/a.mp3"), (-2, "Golden Hour", "Kaito Mori", "/m/b.mp3"), (-3, "Città di Vetro", "Kaito Mori", "/m/c.mp3"), (-4, "Perche no", "Aurelia", "/m/d.mp3"), (-5, "Track 05", "", "/m/Kaito Mori - Glass City.mp3")]


def _quote(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


# the whole library and a few odd tracks; as a set-list and as texts, the tracks whose id is divisible by 20 (a stated query set)
_LIBRARY_SQL = f"library AS (SELECT id, title, artist, '/m/' || artist || ' - ' || title || '.mp3' AS path FROM tracks UNION ALL SELECT * FROM (VALUES {_quote(_LIBRARY)}) AS v(id, title, artist, path))"
_ENTRIES_SQL = f"entries AS (SELECT 100 + id AS pos, CASE WHEN id % 40 = 0 THEN upper(title) || ' (Extended Mix)' ELSE title END AS title, CASE WHEN id % 60 = 0 THEN '' ELSE artist END AS artist FROM tracks WHERE id % 20 = 0 UNION ALL SELECT * FROM (VALUES {_quote(_ENTRIES)}) AS v(pos, title, artist))"


def _library(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/m/"), "artist", F.lit(" - "), "title", F.lit(".mp3"))
    return A.tracks(spark, sf).select("id", "title", "artist", path.alias("path")).unionByName(spark.createDataFrame(_LIBRARY, "id long, title string, artist string, path string"))


_FILE = S.normal("regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '')")
_FIT = "(ta = ea OR contains(ta, ea) OR contains(ea, ta))"


@query("joi07_match_setlist", f"""WITH {A.TRACKS_SQL}, {_LIBRARY_SQL}, {_ENTRIES_SQL}, e AS (SELECT pos, {S.normal('title')} AS et, {S.bare('title')} AS eb, {S.bare('artist')} AS ea FROM entries),
t AS (SELECT id, {S.normal('title')} AS tt, {S.bare('title')} AS tb, CASE WHEN {S.bare('artist')} <> '' THEN {S.bare('artist')} ELSE {_FILE} END AS ta, {_FILE} AS tf FROM library),
s AS (SELECT pos, id, ea, ta, CASE WHEN et <> '' AND et = tt THEN 4e0 WHEN eb <> '' AND eb = tb THEN 3e0 WHEN length(et) >= 4 AND length(tt) >= 4 AND (contains(tt, et) OR contains(et, tt)) THEN 1.5e0 WHEN et <> '' AND contains(tf, et) THEN 1.5e0 ELSE 0e0 END AS s FROM e, t),
r AS (SELECT pos, id, CASE WHEN s = 0 THEN 0e0 WHEN ea <> '' AND ta <> '' AND {_FIT} THEN s + 2 WHEN ea <> '' AND ta <> '' THEN s - 1.5e0 ELSE s END AS score FROM s),
b AS (SELECT pos, id, score FROM r WHERE score >= 2.5e0 QUALIFY row_number() OVER (PARTITION BY pos ORDER BY score DESC, id) = 1)
SELECT CAST(e.pos AS BIGINT) AS pos, CAST(b.id AS BIGINT) AS track_id, b.score FROM e LEFT JOIN b ON e.pos = b.pos""")
def joi07(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("id") % 40 == 0, F.concat(F.upper("title"), F.lit(" (Extended Mix)"))).otherwise(F.col("title"))
    asked = A.tracks(spark, sf).where("id % 20 = 0").select((F.col("id") + 100).alias("pos"), title.alias("title"), F.when(F.col("id") % 60 == 0, "").otherwise(F.col("artist")).alias("artist"))
    return M.match_entries(asked.unionByName(spark.createDataFrame(_ENTRIES, "pos long, title string, artist string")), _library(spark, sf))


_TEXTS = [(1, "golden hour"), (2, "Perche no by aurelia"), (3, "kaito mori"), (4, "glass"), (5, "x"), (6, "metti golden hour di nova reyes stasera")]
_CLEAN = "trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^a-z0-9&'' ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _split_hit(sep: str) -> str:
    a, b = f"trim(substr(q, 1, instr(q, '{sep}') - 1))", f"trim(substr(q, instr(q, '{sep}') + {len(sep)}))"
    return f"(instr(q, '{sep}') > 1 AND ((title = {a} AND contains(artist, {b})) OR (artist = {a} AND title = {b})))"


@query("joi08_match_texts", f"""WITH {A.TRACKS_SQL}, {_LIBRARY_SQL}, a AS (SELECT 100 + id AS qid, CASE WHEN id % 40 = 0 THEN artist || ' ' || title ELSE 'play ' || title || ' by ' || artist END AS q FROM tracks WHERE id % 20 = 0 UNION ALL SELECT * FROM (VALUES {_quote(_TEXTS)}) AS v(qid, q)),
q AS (SELECT qid, {_CLEAN.format('q')} AS q FROM a WHERE length(q) >= 2), t AS (SELECT id, {_CLEAN.format('title')} AS title, {_CLEAN.format('artist')} AS artist FROM library),
s AS (SELECT qid, id, title, round(CASE WHEN title = q OR artist || ' ' || title = q OR title || ' ' || artist = q THEN 100e0 WHEN {_split_hit(' di ')} OR {_split_hit(' by ')} OR {_split_hit(' - ')} THEN 95e0
 WHEN length(title) >= 3 AND contains(q, title) AND artist <> '' AND contains(q, artist) THEN 90e0 WHEN length(q) >= 3 AND contains(title, q) THEN 60 + 30 * (length(q)::DOUBLE / length(title)) WHEN length(title) >= 4 AND contains(q, title) THEN 50 + 20 * (length(title)::DOUBLE / length(q)) WHEN artist <> '' AND artist = q THEN 45e0 ELSE 0e0 END, 6) AS score FROM q, t)
SELECT CAST(qid AS BIGINT) AS qid, CAST(id AS BIGINT) AS id, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, length(title), id) AS INT) AS place FROM s WHERE score > 0) WHERE place <= 5""")
def joi08(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("id") % 40 == 0, F.concat_ws(" ", "artist", "title")).otherwise(F.concat(F.lit("play "), "title", F.lit(" by "), "artist"))
    asked = A.tracks(spark, sf).where("id % 20 = 0").select((F.col("id") + 100).alias("qid"), text.alias("q"))
    return M.match_queries(asked.unionByName(spark.createDataFrame(_TEXTS, "qid long, q string")), _library(spark, sf))


@query("joi09_mentioned_titles", f"""WITH m AS (SELECT conv_id * 100 + turn AS tid, {_CLEAN.format('text')} AS t FROM conversations WHERE role = 'user'), w AS (SELECT DISTINCT {_CLEAN.format("split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4)")} AS title FROM conversations WHERE role = 'assistant')
SELECT tid, title FROM m, w WHERE length(title) >= 3 AND contains(' ' || t || ' ', ' ' || title || ' ')""")
def joi09(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "conversations")
    texts = c.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("tid"), "text")
    titles = c.where("role = 'assistant'").select(F.concat(F.split_part("text", F.lit(" "), F.lit(3)), F.lit(" "), F.split_part("text", F.lit(" "), F.lit(4))).alias("title"))
    return M.mentioned_titles(texts, titles).select("tid", "title")


@query("joi10_search_results", f"""WITH {A.TRACKS_SQL}, c AS (SELECT t.id, t.title AS wanted, u.id AS fid, u.title || CASE WHEN u.id % 10 = 0 THEN ' karaoke' ELSE '' END AS found, t.duration AS wd, u.duration AS fd FROM tracks t JOIN tracks u ON t.artist = u.artist AND t.genre = u.genre),
s AS (SELECT id, fid, list_distinct(string_split({S.normal('wanted')}, ' ')) AS w, list_distinct(string_split({S.normal('found')}, ' ')) AS f, wd, fd FROM c),
r AS (SELECT id, fid, CASE WHEN len(list_intersect(w, f)) / len(w)::DOUBLE < 0.5 OR (list_contains(f, 'karaoke') AND NOT list_contains(w, 'karaoke')) OR abs(wd - fd) > 25 THEN 0e0 ELSE len(list_intersect(w, f)) / len(w)::DOUBLE - abs(wd - fd) / 250 END AS score FROM s)
SELECT id, fid, round(score, 6) AS score FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, fid) = 1""")
def joi10(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).select("id", "title", "artist", "genre", "duration")
    found = F.concat("title", F.when(F.col("id") % 10 == 0, " karaoke").otherwise(""))
    u = t.select(F.col("id").alias("fid"), found.alias("found"), "artist", "genre", F.col("duration").alias("fd"))
    return M.best_results(t, u, ["artist", "genre"]).withColumn("score", F.round("score", 6))


_NEEDLES = [(0, "ddj"), (1, "DDJ-400"), (2, "traktor"), (3, "kontrol s2"), (4, "traktor kontrol")]


@query("joi21_device_profiles", f"""WITH n AS (SELECT pos, lower(needle) AS needle FROM (VALUES {_quote(_NEEDLES)}) AS v(pos, needle)), d AS (SELECT DISTINCT 'Unit ' || CASE p_size % 4 WHEN 0 THEN 'DDJ-400 MIDI' WHEN 1 THEN 'Traktor Kontrol S2' WHEN 2 THEN 'ddj-flx' ELSE 'Other' END || ' ' || p_size AS name FROM part)
SELECT name, needle FROM d, n WHERE contains(lower(name), needle) QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(needle) DESC, pos) = 1""")
def joi21(spark: SparkSession, sf: str) -> DataFrame:
    name = "'Unit ' || CASE p_size % 4 WHEN 0 THEN 'DDJ-400 MIDI' WHEN 1 THEN 'Traktor Kontrol S2' WHEN 2 THEN 'ddj-flx' ELSE 'Other' END || ' ' || p_size AS name"
    return M.longest_needle(A.table(spark, sf, "part").selectExpr(name).distinct(), spark.createDataFrame(_NEEDLES, "pos int, needle string"))


_PALETTE = [(1, 0, 0, 0), (2, 255, 0, 0), (3, 0, 255, 0), (4, 0, 0, 255), (5, 255, 255, 255), (6, 128, 128, 128)]


@query("joi22_nearest_color", f"WITH c AS (SELECT p_partkey AS id, CAST((p_partkey * 37) % 256 AS INT) AS r, CAST((p_partkey * 91) % 256 AS INT) AS g, CAST((p_partkey * 53) % 256 AS INT) AS b FROM part), p AS (SELECT * FROM (VALUES {_quote(_PALETTE)}) AS v(code, pr, pg, pb)) SELECT id, CAST(code AS INT) AS code FROM c, p QUALIFY row_number() OVER (PARTITION BY id ORDER BY (r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb), code) = 1")
def joi22(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "part").selectExpr("p_partkey AS id", "CAST((p_partkey * 37) % 256 AS INT) AS r", "CAST((p_partkey * 91) % 256 AS INT) AS g", "CAST((p_partkey * 53) % 256 AS INT) AS b")
    return M.nearest_color(c, spark.createDataFrame(_PALETTE, "code int, r int, g int, b int"))


@query("joi23_layered_lookup", f"WITH {A.TRACKS_SQL} SELECT t.id, coalesce(CASE WHEN t.id % 3 = 0 AND t.id % 6 = 0 THEN 'user' END, CASE WHEN t.id % 2 = 0 THEN 'profile' END) AS action FROM tracks t")
def joi23(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).select("id")
    actions = t.where("id % 6 = 0").select(F.col("id").alias("a"))
    user = t.where("id % 3 = 0").join(actions, F.col("id") == F.col("a"), "left_semi").select(F.col("id").alias("u"), F.lit("user").alias("x"))
    profile = t.where("id % 2 = 0").select(F.col("id").alias("p"), F.lit("profile").alias("y"))
    return t.join(user, F.col("id") == F.col("u"), "left").join(profile, F.col("id") == F.col("p"), "left").select("id", F.coalesce("x", "y").alias("action"))


@query("joi24_templates", "SELECT v || ' something from ' || r_name || ' by ' || n_name AS phrase FROM (SELECT unnest(['play', 'queue', 'skip']) AS v), region JOIN nation ON n_regionkey = r_regionkey")
def joi24(spark: SparkSession, sf: str) -> DataFrame:
    """Templates filled with all values of their places."""
    places = A.table(spark, sf, "nation").join(A.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    verbs = F.explode(F.array(*map(F.lit, ("play", "queue", "skip")))).alias("v")
    return places.select("r_name", "n_name", verbs).select(F.format_string("%s something from %s by %s", "v", "r_name", "n_name").alias("phrase"))


@query("src30_validate_mapping", "SELECT CAST(p_partkey AS BIGINT) AS id, regexp_matches(p_brand, '#[0-9]{2}$') AND p_size <= 40 AS accepted FROM part")
def src30(spark: SparkSession, sf: str) -> DataFrame:
    actions = spark.range(1, 41).select(F.col("id").cast("int").alias("size"))
    p = A.table(spark, sf, "part").join(F.broadcast(actions), F.col("p_size") == F.col("size"), "left")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_brand").rlike("#[0-9]{2}$") & F.col("size").isNotNull()).alias("accepted"))


@query("src31_newest_mapping", f"WITH {A.TRACKS_SQL}, o AS (SELECT id AS k, id % 50 AS a FROM tracks WHERE id % 2 = 0), n AS (SELECT id AS k, id % 50 AS a FROM tracks WHERE id % 7 = 0 AND id % 4 < 3) SELECT k, a, 'new' AS origin FROM n UNION ALL SELECT k, a, 'old' FROM o WHERE k NOT IN (SELECT k FROM n) AND a NOT IN (SELECT a FROM n)")
def src31(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).selectExpr("id AS k", "id % 50 AS a")
    old, new = t.where("k % 2 = 0"), t.where("k % 7 = 0 AND k % 4 < 3")
    kept = old.join(new.select("k"), "k", "left_anti").join(new.select("a").distinct(), "a", "left_anti")
    return new.withColumn("origin", F.lit("new")).unionByName(kept.withColumn("origin", F.lit("old")))
