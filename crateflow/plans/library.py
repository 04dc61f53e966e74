"""Queries: library search, filters, ranking and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow import adapters as A
from crateflow.functions import music, text
from crateflow.operators import library as L
from crateflow.plans import sqlparts as S
from crateflow.plans.core import query

CURRENT = 42
_FILTERS = L.Filters(genres=("STANDARD", "promo", "Économy"), exclude=("small",), bpm_min=80, bpm_max=170)
_FILTER_SQL = "(contains(strip_accents(lower(genre)), 'standard') OR contains(strip_accents(lower(genre)), 'promo') OR contains(strip_accents(lower(genre)), 'economy')) AND NOT contains(strip_accents(lower(genre)), 'small') AND bpm >= 80 AND bpm <= 170"


@query("top03_rank_candidates", f"""WITH {A.KEYED_SQL}, cur AS (SELECT * FROM keyed WHERE id = {CURRENT}),
best AS (SELECT t.*, c.bpm AS cbpm, c.code AS ccode, c.energy AS cenergy, round({S.score('c', 't')}, 6) AS score, {S.ratio('c.bpm', 't.bpm')} AS r
 FROM keyed t, cur c WHERE t.id <> c.id AND t.bpm >= 60 ORDER BY score DESC, t.id LIMIT 12)
SELECT id, title, artist, score, concat_ws('; ', CASE WHEN r <> 0 THEN 'tempo ' || CAST(floor(bpm + 0.5) AS BIGINT) || ' by ' || CAST(CAST(round((r - 1) * 100, 1) AS DECIMAL(6,1)) AS VARCHAR) || ' %' END,
 CASE WHEN code IS NOT NULL THEN 'key ' || coalesce(ccode, '?') || ' to ' || code END, CASE WHEN energy > 0 THEN 'energy ' || coalesce(CAST(cenergy AS VARCHAR), '?') || ' to ' || energy END) AS reasons FROM best""")
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    t = A.keyed(spark, sf)
    return L.rank_candidates(t, t.where(F.col("id") == CURRENT), 12, filters=L.Filters(bpm_min=60))


@query("fil01_search", f"WITH {A.KEYED_SQL} SELECT id, title, artist FROM keyed WHERE contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(artist, ''), coalesce(genre, ''), coalesce(key, ''), coalesce(code, ''), CASE WHEN bpm > 0 THEN CAST(CAST(floor(bpm + 0.5) AS BIGINT) AS VARCHAR) ELSE '' END)), 'a') AND contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(artist, ''), coalesce(genre, ''), coalesce(key, ''), coalesce(code, ''), CASE WHEN bpm > 0 THEN CAST(CAST(floor(bpm + 0.5) AS BIGINT) AS VARCHAR) ELSE '' END)), '12')")
def fil01(spark: SparkSession, sf: str) -> DataFrame:
    return L.search(A.keyed(spark, sf), "A  12").select("id", "title", "artist")


@query("fil02_filters", f"WITH {A.TRACKS_SQL} SELECT id, genre, bpm FROM tracks WHERE {_FILTER_SQL}")
def fil02(spark: SparkSession, sf: str) -> DataFrame:
    return A.tracks(spark, sf).where(_FILTERS.column(F.col("genre"), F.col("bpm"))).select("id", "genre", "bpm")


@query("fil03_filter_algebra", "SELECT * FROM (VALUES (1, 'techno', 'house', 100e0, 130e0), (2, 'techno,trance', 'house', 100e0, 130e0), (3, '', 'house,techno', 100e0, 130e0), (4, 'house', '', 90e0, 140e0), (5, '', '', 0e0, 0e0)) AS t(step, genres, excluded, bpm_min, bpm_max)")
def fil03(spark: SparkSession, sf: str) -> DataFrame:
    f = L.Filters().merged(genres=("techno",), exclude=("house",), bpm_min=130, bpm_max=100)
    states = [f, f.merged(genres=("trance",), add=True), f.merged(exclude=("techno",)), f.merged(genres=("house",), bpm_min=140, bpm_max=90), f.merged(clear=True)]
    rows = [(i, ",".join(s.genres), ",".join(s.exclude), float(s.bpm_min), float(s.bpm_max)) for i, s in enumerate(states, 1)]
    return spark.createDataFrame(rows, "step int, genres string, excluded string, bpm_min double, bpm_max double")


@query("fil04_widening_pool", f"""WITH {A.TRACKS_SQL}, {A.HISTORY_SQL}, recent AS (SELECT DISTINCT id FROM history WHERE played_at >= TIMESTAMP '2024-01-25'), ok AS (SELECT t.id, r.id AS r FROM tracks t LEFT JOIN recent r ON t.id = r.id WHERE {_FILTER_SQL})
SELECT id, 1 AS tier FROM ok WHERE r IS NULL""")
def fil04(spark: SparkSession, sf: str) -> DataFrame:
    recent = A.history(spark, sf).where("played_at >= TIMESTAMP_NTZ '2024-01-25'").select("id").distinct()
    t = A.tracks(spark, sf).withColumn("last_played", F.lit(None).cast("timestamp"))
    return L.widening_pool(t, _FILTERS.column(F.col("genre"), F.col("bpm")), recent, F.col("last_played")).select("id", "tier")


@query("fil05_completeness", f"WITH {A.KEYED_SQL} SELECT status, count(*) AS n FROM (SELECT CASE WHEN bpm > 0 AND key IS NOT NULL THEN 'complete' ELSE 'partial' END AS status FROM keyed) GROUP BY status")
def fil05(spark: SparkSession, sf: str) -> DataFrame:
    return A.keyed(spark, sf).groupBy(L.Missing().column().alias("status")).agg(F.count("*").alias("n"))


_PATHS = "paths AS (SELECT id, '/m/' || artist || '/' || genre || '/' || id || ' - ' || title || '.mp3' AS path FROM tracks)"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return A.tracks(spark, sf).select("id", F.concat(F.lit("/m/"), "artist", F.lit("/"), "genre", F.lit("/"), F.col("id").cast("string"), F.lit(" - "), "title", F.lit(".mp3")).alias("path"))


@query("fil06_folder_scope", f"WITH {A.TRACKS_SQL}, {_PATHS} SELECT id, path FROM paths WHERE starts_with(path, '/m/Brand#1/') ")
def fil06(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).where(F.startswith("path", F.concat(F.lit("/m/Brand#1"), F.lit("/"))))


@query("fil07_snapshot", f"WITH {A.HISTORY_SQL} SELECT event_id, id, played_at FROM history ORDER BY played_at DESC, event_id LIMIT 500")
def fil07(spark: SparkSession, sf: str) -> DataFrame:
    return A.history(spark, sf).orderBy(F.desc("played_at"), "event_id").limit(500).select("event_id", "id", "played_at")


@query("fil08_highlight", f"""WITH {A.KEYED_SQL}, cur AS (SELECT * FROM keyed WHERE id = {CURRENT})
SELECT t.id, coalesce(abs(t.bpm - c.bpm) / c.bpm < 0.06e0, false) AS tempo_near, coalesce(t.camelot_n = c.camelot_n OR (t.camelot_l = c.camelot_l AND abs(t.camelot_n - c.camelot_n) IN (1, 11)), false) AS key_near FROM keyed t, cur c""")
def fil08(spark: SparkSession, sf: str) -> DataFrame:
    t = A.keyed(spark, sf)
    c = t.where(F.col("id") == CURRENT).select(F.col("bpm").alias("cb"), F.col("camelot_n").alias("cn"), F.col("camelot_l").alias("cl"))
    near = F.coalesce(F.abs(F.col("bpm") - F.col("cb")) / F.col("cb") < 0.06, F.lit(False))
    return t.crossJoin(F.broadcast(c)).select("id", near.alias("tempo_near"), music.harmonic_match(F.col("camelot_n"), F.col("camelot_l"), F.col("cn"), F.col("cl")).alias("key_near"))


@query("fil09_catalogue", f"""WITH {A.PLAYLISTS_SQL}, {A.TRACKS_SQL}, c AS (SELECT playlist, list(DISTINCT genre) AS tags, count(*) AS total, count(*) FILTER (bpm > 0) AS identified FROM playlists p JOIN tracks t ON p.track = t.id GROUP BY playlist)
SELECT playlist, CAST(total AS BIGINT) AS total, CAST(identified AS BIGINT) AS identified FROM c WHERE list_has_any(tags, ['PROMO', 'ECONOMY']) AND total >= 4 AND identified >= 0.8e0 * total""")
def fil09(spark: SparkSession, sf: str) -> DataFrame:
    p = A.playlists(spark, sf).join(A.tracks(spark, sf).select("id", "genre", "bpm"), F.col("track") == F.col("id"))
    c = p.groupBy("playlist").agg(F.collect_set("genre").alias("tags"), F.count("*").alias("total"), F.count_if(F.col("bpm") > 0).alias("identified"))
    ok = F.arrays_overlap("tags", F.array(F.lit("PROMO"), F.lit("ECONOMY"))) & (F.col("total") >= 4) & (F.col("identified") >= 0.8 * F.col("total"))
    return c.where(ok).select("playlist", "total", "identified")


@query("fil10_tag_noise", f"WITH {A.TRACKS_SQL}, {_PATHS} SELECT p.id FROM paths p JOIN tracks t USING (id) WHERE t.bpm = 90 AND contains(p.path, 'PROMO')")
def fil10(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).join(A.tracks(spark, sf).where("bpm = 90").select("id"), "id").where(F.contains("path", F.lit("PROMO"))).select("id")


@query("fil11_quality_gates", f"""WITH {A.PLAYLISTS_SQL}, g AS (SELECT playlist, pos, track, lead(track) OVER w AS nxt, lead(pos) OVER w AS npos FROM playlists WINDOW w AS (PARTITION BY playlist ORDER BY pos))
SELECT playlist, pos FROM g WHERE nxt IS NOT NULL AND npos = pos + 1 AND (track * 31 + nxt) % 10 >= 3 AND abs(track - nxt) <= 500""")
def fil11(spark: SparkSession, sf: str) -> DataFrame:
    w = "OVER (PARTITION BY playlist ORDER BY pos)"
    g = A.playlists(spark, sf).selectExpr("playlist", "pos", "track", f"lead(track) {w} AS nxt", f"lead(pos) {w} AS npos")
    return g.where("nxt IS NOT NULL AND npos = pos + 1 AND (track * 31 + nxt) % 10 >= 3 AND abs(track - nxt) <= 500").select("playlist", "pos")


@query("fil12_valid_curves", "SELECT vec_id FROM embeddings WHERE len(embedding) >= 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x) OR abs(x) > 0.35)) = 0")
def fil12(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) <= 0.35))
    return A.table(spark, sf, "embeddings").where((F.size("embedding") >= 64) & ok).select("vec_id")


@query("prj01_analysis_patch", f"WITH {A.KEYED_SQL} SELECT id, nullif(bpm, 0e0) AS bpm, key, CASE WHEN bpm > 0 THEN grid_offset END AS grid_offset, CASE WHEN bpm > 0 THEN 'classic' END AS engine FROM keyed")
def prj01(spark: SparkSession, sf: str) -> DataFrame:
    known = F.col("bpm") > 0
    return A.keyed(spark, sf).select("id", F.nullif(F.col("bpm"), F.lit(0.0)).alias("bpm"), "key", F.when(known, F.col("grid_offset")).alias("grid_offset"), F.when(known, "classic").alias("engine"))


@query("prj02_descriptions", f"WITH {A.KEYED_SQL} SELECT id, artist || ' - ' || title || ' (' || concat_ws(', ', CASE WHEN bpm > 0 THEN CAST(CAST(bpm AS BIGINT) AS VARCHAR) || ' BPM' END, key, lpad(CAST(CAST(duration AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(duration AS BIGINT) % 60 AS VARCHAR), 2, '0')) || ')' AS label FROM keyed")
def prj02(spark: SparkSession, sf: str) -> DataFrame:
    tempo = F.when(F.col("bpm") > 0, F.concat(F.col("bpm").cast("bigint").cast("string"), F.lit(" BPM")))
    label = F.concat("artist", F.lit(" - "), "title", F.lit(" ("), F.concat_ws(", ", tempo, "key", text.clock(F.col("duration"))), F.lit(")"))
    return A.keyed(spark, sf).select("id", label.alias("label"))


@query("top01_column_sort", f"WITH {A.TRACKS_SQL} SELECT id, title, CAST(row_number() OVER (ORDER BY bpm DESC, title, id) AS INT) AS place FROM tracks ORDER BY place LIMIT 100")
def top01(spark: SparkSession, sf: str) -> DataFrame:
    order = (F.coalesce("bpm", F.lit(0.0)).desc(), text.natural_key(F.col("title")), F.col("id"))
    page = A.tracks(spark, sf).orderBy(*order).limit(100)
    return page.select("id", "title", F.expr("row_number() OVER (ORDER BY bpm DESC, title, id)").alias("place"))


@query("top02_most_played", f"WITH {A.HISTORY_SQL} SELECT id, count(*) AS play_count, max(played_at) AS last_played FROM history GROUP BY id ORDER BY play_count DESC, id LIMIT 200")
def top02(spark: SparkSession, sf: str) -> DataFrame:
    return L.most_played(A.history(spark, sf))


@query("top05_priority_pick", f"WITH {A.TRACKS_SQL} SELECT id, prio FROM (SELECT id, CASE WHEN genre = 'PROMO' THEN 0 WHEN bpm = 0 THEN 1 ELSE 2 END AS prio FROM tracks) ORDER BY prio, id LIMIT 50")
def top05(spark: SparkSession, sf: str) -> DataFrame:
    prio = F.when(F.col("genre") == "PROMO", 0).when(F.col("bpm") == 0, 1).otherwise(2)
    return A.tracks(spark, sf).select("id", prio.alias("prio")).orderBy("prio", "id").limit(50)


@query("top06_priority_source_order", f"WITH {A.TRACKS_SQL} SELECT id, genre, bpm > 0 AS known FROM tracks ORDER BY known DESC, genre, id LIMIT 80")
def top06(spark: SparkSession, sf: str) -> DataFrame:
    return A.tracks(spark, sf).select("id", "genre", (F.col("bpm") > 0).alias("known")).orderBy(F.desc("known"), "genre", "id").limit(80)


@query("top12_last_of_list", f"WITH {A.PLAYLISTS_SQL} SELECT playlist, array_to_string(list(track ORDER BY pos)[-3:], ',') AS last FROM playlists GROUP BY playlist")
def top12(spark: SparkSession, sf: str) -> DataFrame:
    items = A.playlists(spark, sf).groupBy("playlist").agg(F.sort_array(F.collect_list(F.struct("pos", "track"))).alias("x"))
    last = F.expr("if(size(x) > 3, slice(x, -3, 3), x).track")
    return items.select("playlist", F.array_join(last.cast("array<string>"), ",").alias("last"))


@query("src02_identity", f"WITH {A.TRACKS_SQL}, {_PATHS} SELECT substr(sha1(path), 1, 16) AS id, regexp_extract(path, '([^/]*)\\.mp3$', 1) AS name, split_part(regexp_extract(path, '([^/]*)\\.mp3$', 1), ' - ', 1) AS artist, substr(regexp_extract(path, '([^/]*)\\.mp3$', 1), instr(regexp_extract(path, '([^/]*)\\.mp3$', 1), ' - ') + 3) AS title FROM paths")
def src02(spark: SparkSession, sf: str) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)\.mp3$", 1)
    at = F.instr(name, F.lit(" - "))
    return _paths(spark, sf).select(F.substring(F.sha1("path"), 1, 16).alias("id"), name.alias("name"), F.substring(name, F.lit(1), at - 1).alias("artist"), F.substring(name, at + 3, F.length(name)).alias("title"))


@query("src03_metadata_overlay", f"WITH {A.TRACKS_SQL} SELECT id, coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE title END, ''), 'file ' || id) AS title, concat_ws(', ', genre, CASE WHEN id % 2 = 0 THEN 'Live' END) AS genre FROM tracks")
def src03(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("title"))
    genre = F.concat_ws(", ", "genre", F.when(F.col("id") % 2 == 0, "Live"))
    return A.tracks(spark, sf).select("id", F.coalesce(F.nullif(tag, F.lit("")), F.concat(F.lit("file "), F.col("id").cast("string"))).alias("title"), genre.alias("genre"))


@query("src04_insert_new", f"WITH {A.TRACKS_SQL} SELECT id, title FROM tracks WHERE id % 2 = 0 UNION ALL SELECT id, 'new ' || title FROM tracks WHERE id % 2 <> 0 AND id % 3 = 0")
def src04(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf)
    more = t.where("id % 3 = 0").select("id", F.concat(F.lit("new "), "title").alias("title"))
    return L.insert_new(t.where("id % 2 = 0").select("id", "title"), more)


@query("src05_rescan", f"""WITH {A.TRACKS_SQL}, s AS (SELECT id, artist AS folder FROM tracks WHERE id % 5 <> 0), d AS (SELECT id, artist AS folder FROM tracks WHERE id % 4 <> 0), o AS (SELECT * FROM (VALUES ('Brand#1'), ('Brand#2'), ('Brand#11')) AS v(folder))
SELECT coalesce(s.id, d.id) AS id, coalesce(s.folder, d.folder) AS folder, CASE WHEN s.id IS NULL THEN 'added' WHEN d.id IS NOT NULL THEN 'kept' WHEN s.folder IN (SELECT folder FROM o) THEN 'offline' ELSE 'removed' END AS change FROM s FULL JOIN d ON s.id = d.id""")
def src05(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).select("id", F.col("artist").alias("folder"))
    off = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#11",)], "folder string")
    return L.reconcile(t.where("id % 5 <> 0"), t.where("id % 4 <> 0"), off)


@query("src06_remove_folder", f"WITH {A.TRACKS_SQL}, {_PATHS} SELECT id FROM paths WHERE NOT starts_with(path, '/m/Brand#12/')")
def src06(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).where(~F.startswith("path", F.lit("/m/Brand#12/"))).select("id")


@query("src07_cascade_playlists", f"WITH {A.PLAYLISTS_SQL} SELECT playlist, track, CAST(row_number() OVER (PARTITION BY playlist ORDER BY pos) AS INT) AS pos FROM playlists WHERE track % 10 <> 3")
def src07(spark: SparkSession, sf: str) -> DataFrame:
    gone = A.tracks(spark, sf).where("id % 10 = 3")
    return L.remove_tracks(A.playlists(spark, sf), A.mashups(spark, sf), gone)[0]


@query("src07_cascade_mashups", f"WITH {A.MASHUPS_SQL} SELECT base, vocal FROM mashups WHERE base % 10 <> 3 AND vocal % 10 <> 3")
def src07b(spark: SparkSession, sf: str) -> DataFrame:
    gone = A.tracks(spark, sf).where("id % 10 = 3")
    return L.remove_tracks(A.playlists(spark, sf), A.mashups(spark, sf), gone)[1]


@query("src08_patch", f"WITH {A.TRACKS_SQL} SELECT id, CASE WHEN id % 7 = 0 THEN 'patched' ELSE title END AS title, CASE WHEN id % 7 = 0 THEN NULL ELSE bpm END AS bpm, energy FROM tracks")
def src08(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).select("id", "title", "bpm", "energy")
    patch = F.create_map(F.lit("title"), F.lit("patched"), F.lit("bpm"), F.lit(None).cast("string"), F.lit("energy"), F.lit("99"))
    return L.patch(t, t.where("id % 7 = 0").select("id", patch.alias("patch")), "id", ["title", "bpm"])


@query("src09_mark_played", f"WITH {A.HISTORY_SQL} SELECT id, count(*) AS play_count, max(played_at) AS last_played FROM history GROUP BY id")
def src09(spark: SparkSession, sf: str) -> DataFrame:
    return L.plays(A.history(spark, sf))


@query("src10_move_item", f"WITH {A.PLAYLISTS_SQL}, l AS (SELECT playlist, list(track ORDER BY pos) AS x FROM playlists GROUP BY playlist) SELECT playlist, array_to_string(CASE WHEN len(x) > 2 THEN list_concat(x[2:3], x[1:1], x[4:]) ELSE x END, ',') AS items FROM l")
def src10(spark: SparkSession, sf: str) -> DataFrame:
    items = A.playlists(spark, sf).groupBy("playlist").agg(F.sort_array(F.collect_list(F.struct("pos", "track"))).alias("x"))
    moved = L.move_item(F.col("x.track"), 0, 2)
    return items.select("playlist", F.array_join(moved.cast("array<string>"), ",").alias("items"))


@query("src11_save_mashups", f"WITH {A.MASHUPS_SQL} SELECT base, vocal, CASE WHEN (base + vocal) % 80 BETWEEN 4 AND 64 THEN CAST((base + vocal) % 80 AS INT) ELSE 16 END AS bars FROM mashups WHERE base % 2 = 0 UNION ALL SELECT base, vocal, 16 FROM mashups WHERE base % 2 <> 0")
def src11(spark: SparkSession, sf: str) -> DataFrame:
    m = A.mashups(spark, sf)
    n = ((F.col("base") + F.col("vocal")) % 80).cast("int")
    new = m.where("base % 2 = 0").withColumn("bars", F.when(n.between(4, 64), n).otherwise(16))
    return L.upsert(m.withColumn("bars", F.lit(16)), new, ["base", "vocal"])


@query("src14_search_urls", f"WITH {A.TRACKS_SQL} SELECT id, 'https://example.org/find?q=' || url_encode(artist || ' ' || title) AS url FROM tracks")
def src14(spark: SparkSession, sf: str) -> DataFrame:
    q = F.replace(F.url_encode(F.concat("artist", F.lit(" "), "title")), F.lit("+"), F.lit("%20"))
    return A.tracks(spark, sf).select("id", F.replace(F.lit("https://example.org/find?q={q}"), F.lit("{q}"), q).alias("url"))


@query("joi04_first_folder", f"""WITH {A.TRACKS_SQL}, {_PATHS}, f AS (SELECT * FROM (VALUES (0, '/m/Brand#11'), (1, '/m/Brand#1'), (2, '/m/Brand#11/PROMO'), (3, '/m')) AS v(pos, folder))
SELECT p.id, p.path, (SELECT f.folder FROM f WHERE starts_with(p.path, f.folder || '/') ORDER BY f.pos LIMIT 1) AS folder FROM paths p""")
def joi04(spark: SparkSession, sf: str) -> DataFrame:
    folders = spark.createDataFrame([(0, "/m/Brand#11"), (1, "/m/Brand#1"), (2, "/m/Brand#11/PROMO"), (3, "/m")], "pos int, folder string")
    return L.first_folder(_paths(spark, sf), folders)
