"""Queries: dataset selection, splits, unions and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crateflow import adapters as A
from crateflow.operators import datasets as D
from crateflow.plans import sqlparts as S
from crateflow.plans.core import query

_N = S.chat_normal("text")


@query("agg01_by_code", f"WITH {A.KEYED_SQL} SELECT code, count(*) AS n, array_to_string(list(id ORDER BY id)[:5], ',') AS firsts FROM keyed WHERE code IS NOT NULL GROUP BY code")
def agg01(spark: SparkSession, sf: str) -> DataFrame:
    k = A.keyed(spark, sf).where("code IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id")))
    firsts = F.sort_array(F.collect_list(F.when(F.col("r") <= 5, F.col("id"))))
    return k.groupBy("code").agg(F.count("*").alias("n"), F.array_join(firsts.cast("array<string>"), ",").alias("firsts"))


@query("agg02_vocabulary", f"WITH {A.TRACKS_SQL}, p AS (SELECT DISTINCT trim(lower(unnest(regexp_split_to_array(genre || ', ' || title, '[,/;]+')))) AS phrase FROM tracks), w AS (SELECT phrase AS term FROM p WHERE length(phrase) >= 3 UNION SELECT unnest(string_split(phrase, ' ')) FROM p) SELECT DISTINCT term, length(term) AS size FROM w WHERE length(term) >= 3 AND term NOT IN ('and', 'the', 'mix', 'music', 'edit', 'remix')")
def agg02(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("genre", F.lit(", "), "title")
    p = A.tracks(spark, sf).select(F.explode(F.split(text, "[,/;]+")).alias("x")).select(F.trim(F.lower("x")).alias("phrase")).distinct()
    terms = p.select("phrase").union(p.select(F.explode(F.split("phrase", " "))))
    stop = F.col("term").isin("and", "the", "mix", "music", "edit", "remix")
    return terms.toDF("term").where((F.length("term") >= 3) & ~stop).distinct().select("term", F.length("term").cast("bigint").alias("size"))


@query("agg03_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def agg03(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("top08_hash_split", f"SELECT conv_id, turn, {S.fnv1a(_N)} AS hash, CASE WHEN {S.fnv1a(_N)} % 10 < 7 THEN 'train' WHEN {S.fnv1a(_N)} % 10 < 8 THEN 'valid' ELSE 'test' END AS part FROM conversations WHERE role = 'user'")
def top08(spark: SparkSession, sf: str) -> DataFrame:
    from crateflow.functions.text import chat_normal, fnv1a

    n = A.messages(spark, sf).withColumn("k", chat_normal(F.col("text")))
    return n.select("conv_id", "turn", fnv1a(F.col("k")).alias("hash"), D.hash_split(F.col("k")).alias("part"))


@query("top08_crc_share")
def top08b(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").groupBy(D.share_bucket(F.col("doc_id"), 100).alias("bucket")).agg(F.count("*").alias("n"))


@query("top07_weighted_sample")
def top07(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf)
    return D.weighted_sample(t, F.col("energy").cast("double"), 100, "id", 7).select("id", "energy")


@query("top09_capped_selection")
def top09(spark: SparkSession, sf: str) -> DataFrame:
    return D.stratified_with_caps(A.tracks(spark, sf).select("id", "genre", "artist"), "genre", "artist", "id", 40, 8)


@query("top10_hash_order", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 100")
def top10(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(100)


@query("top11_first_occurrence", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def top11(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.min(F.struct("doc_id", "source")).alias("m"))
    return d.select("m.doc_id", "m.source")


@query("top13_folds", "WITH g AS (SELECT source, CAST(substr(source, 4) AS INT) % 3 = 0 AS is_new FROM (SELECT DISTINCT source FROM documents)) SELECT source, CAST(CASE WHEN source = 'src7' THEN 4 ELSE (row_number() OVER (PARTITION BY is_new ORDER BY source) - 1) % 5 END AS INT) AS fold FROM g")
def top13(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").select("source").distinct().withColumn("is_new", F.substring("source", 4, 9).cast("int") % 3 == 0)
    return D.fold_of(d, "source", "is_new", 5, "src7")


@query("top14_shards", "SELECT doc_id, part FROM (SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS INT) AS part FROM documents WHERE n_chars > 200) WHERE part = 1")
def top14(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").where("n_chars > 200")
    part = F.pmod(F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1, F.lit(4))
    return d.select("doc_id", part.cast("int").alias("part")).where("part = 1")


@query("set01_union_sources", "SELECT 'doc' AS origin, doc_id AS id, lang, NULL::BIGINT AS turn FROM documents UNION ALL SELECT 'chat', conv_id, NULL, turn FROM conversations")
def set01(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").select(F.lit("doc").alias("origin"), F.col("doc_id").alias("id"), "lang")
    c = A.table(spark, sf, "conversations").select(F.lit("chat").alias("origin"), F.col("conv_id").alias("id"), "turn")
    return d.unionByName(c, allowMissingColumns=True)


@query("set02_keep_unreachable", "SELECT doc_id, 'here' AS state FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT d.doc_id, 'gone' FROM documents d WHERE d.doc_id % 3 = 0 AND d.doc_id IN (SELECT doc_id FROM labels)")
def set02(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").select("doc_id")
    gone = d.where("doc_id % 3 = 0").join(A.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return d.where("doc_id % 3 <> 0").withColumn("state", F.lit("here")).unionByName(gone.withColumn("state", F.lit("gone")))


@query("set03_difference", f"WITH {A.TRACKS_SQL}, {A.HISTORY_SQL} SELECT id, title FROM tracks WHERE id NOT IN (SELECT id FROM history)")
def set03(spark: SparkSession, sf: str) -> DataFrame:
    return A.tracks(spark, sf).join(A.history(spark, sf).select("id").distinct(), "id", "left_anti").select("id", "title")


@query("set04_array_sets", "WITH x AS (SELECT page_id, list_sort(list_distinct(string_split(regexp_extract(url, '//([^/?#]*)', 1), '.'))) AS a, ['www', 'm', 'com', 'org'] AS b FROM pages) SELECT page_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_filter(a, lambda e: NOT list_contains(b, e))), ',') AS rest, list_has_any(a, b) AS meets FROM x")
def set04(spark: SparkSession, sf: str) -> DataFrame:
    a = F.array_distinct(F.split(F.regexp_extract("url", "//([^/?#]*)", 1), r"\."))
    b = F.array(*[F.lit(x) for x in ("www", "m", "com", "org")])
    return A.table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(F.array_intersect(a, b)), ",").alias("both"), F.array_join(F.array_sort(F.array_except(a, b)), ",").alias("rest"), F.arrays_overlap(a, b).alias("meets"))


@query("set05_distinct_in_order", f"WITH {A.PLAYLISTS_SQL}, f AS (SELECT playlist, track % 5 AS g, min(pos) AS p FROM playlists GROUP BY 1, 2) SELECT playlist, array_to_string(list(g ORDER BY p), ',') AS groups FROM f GROUP BY playlist")
def set05(spark: SparkSession, sf: str) -> DataFrame:
    items = A.playlists(spark, sf).groupBy("playlist").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("track") % 5).alias("g")))).alias("x"))
    return items.select("playlist", F.array_join(F.array_distinct(F.col("x.g")).cast("array<string>"), ",").alias("groups"))


@query("joi18_inventory_tags", f"WITH {A.TRACKS_SQL}, k AS (SELECT {S.normal('title')} AS k, id, bpm FROM tracks WHERE bpm > 0), f AS (SELECT k, arg_min(bpm, id) AS bpm FROM k GROUP BY k) SELECT t.id, f.bpm FROM tracks t LEFT JOIN f ON {S.normal('t.title')} = f.k")
def joi18(spark: SparkSession, sf: str) -> DataFrame:
    from crateflow.functions.text import normal

    t = A.tracks(spark, sf).withColumn("k", normal(F.col("title")))
    tags = t.where("bpm > 0").groupBy("k").agg(F.min_by("bpm", "id").alias("tag"))
    return t.join(tags, "k", "left").select("id", F.col("tag").alias("bpm"))


@query("joi19_prediction_alignment", "SELECT d.doc_id, l.quality, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS guess, CASE WHEN l.quality IS NULL THEN 'unlabelled' WHEN l.quality = (CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END) THEN 'right' ELSE 'wrong' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id)")
def joi19(spark: SparkSession, sf: str) -> DataFrame:
    guess = F.when(F.col("n_chars") > 500, 1).otherwise(0)
    d = A.table(spark, sf, "documents").select("doc_id", guess.alias("guess")).join(A.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    outcome = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == F.col("guess"), "right").otherwise("wrong")
    return d.select("doc_id", "quality", "guess", outcome.alias("outcome"))


@query("joi20_leakage_guard", f"WITH h AS (SELECT DISTINCT {_N} AS k FROM conversations WHERE role = 'user' AND conv_id % 4 = 0) SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 4 <> 0 AND {_N} NOT IN (SELECT k FROM h)")
def joi20(spark: SparkSession, sf: str) -> DataFrame:
    m = A.messages(spark, sf)
    return D.without_leaks(m.where("conv_id % 4 <> 0"), m.where("conv_id % 4 = 0")).select("conv_id", "turn")


@query("src28_head_per_genre", f"WITH {A.TRACKS_SQL} SELECT id, genre, title FROM tracks WHERE duration BETWEEN 160 AND 400 QUALIFY row_number() OVER (PARTITION BY genre ORDER BY lower(trim(title)), id) <= 5")
def src28(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).where("duration BETWEEN 160 AND 400")
    w = Window.partitionBy("genre").orderBy(F.lower(F.trim("title")), "id")
    return t.withColumn("n", F.row_number().over(w)).where("n <= 5").select("id", "genre", "title")


@query("str08_job_states", "SELECT CASE WHEN event_type = 'error' AND value > 80 THEN 'systemic' WHEN event_type = 'error' AND value > 40 THEN 'undecodable' WHEN event_type = 'error' THEN 'unreachable' WHEN value < 5 THEN 'retry' ELSE 'done' END AS state, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def str08(spark: SparkSession, sf: str) -> DataFrame:
    error = F.col("event_type") == "error"
    state = F.when(error & (F.col("value") > 80), "systemic").when(error & (F.col("value") > 40), "undecodable").when(error, "unreachable").when(F.col("value") < 5, "retry").otherwise("done")
    return A.table(spark, sf, "events").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("str09_single_flight", "SELECT user_id, event_type, min(event_id) AS leader, count(*) - 1 AS shared FROM events GROUP BY user_id, event_type, date_trunc('hour', ts)")
def str09(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").groupBy("user_id", "event_type", F.date_trunc("hour", "ts")).agg(F.min("event_id").alias("leader"), (F.count("*") - 1).alias("shared")).select("user_id", "event_type", "leader", "shared")
