"""Queries: files, stores and streams. Streams run over the tables' files as they are found, then stop."""

from __future__ import annotations

import os
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateflow import adapters as A
from crateflow.plans.core import query
from crateflow.sources import files
from crateflow.sources.watch import NewFiles
from crateflow.streaming import arrivals as S


def _place(spark: SparkSession, tag: str) -> str:
    """A fresh folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not root:
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="crateflow-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/crateflow/{tag}-{uuid.uuid4().hex}"


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there, written to a shared folder and read back."""
    spark = stream.sparkSession
    out = _place(spark, "stream")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", _place(spark, "offsets")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


@contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """The state store that arbitrary state needs, for the streams started inside; the session's choice is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream, whether it is one file or a folder of them: the pattern stands for either."""
    schema = A.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query("src01_directory_scan", f"WITH {A.TRACKS_SQL} SELECT '/m/' || CASE WHEN id % 11 = 0 THEN '.hidden/' ELSE '' END || artist || '/' || id || CASE id % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.FLAC' WHEN 2 THEN '.txt' ELSE '.part' END AS path, CAST(2 AS INT) - 1 AS depth FROM tracks WHERE id % 11 <> 0 AND id % 4 < 2")
def src01(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/m/"), F.when(F.col("id") % 11 == 0, ".hidden/").otherwise(""), "artist", F.lit("/"), F.col("id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".mp3", ".FLAC", ".txt", ".part")]), (F.col("id") % 4 + 1).cast("int")))
    return files.audio_only(A.tracks(spark, sf).select(path.alias("path")), "/m")


@query("src12_store_defaults", f"WITH {A.TRACKS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN title ELSE 'untitled' END AS title, CAST(CASE WHEN id % 2 = 0 THEN energy ELSE 5 END AS INT) AS energy FROM tracks")
def src12(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).select("id", F.when(F.col("id") % 3 == 0, F.col("title")).alias("title"), F.when(F.col("id") % 2 == 0, F.col("energy")).alias("energy"))
    path = _place(spark, "store")
    files.save_store(t, path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("energy", T.IntegerType())])
    return files.load_store(spark, path, schema, {"title": "untitled", "energy": 5})[0]


@query("src17_stem_store", f"WITH {A.TRACKS_SQL} SELECT id, id % 2 = 0 AS vocals, id % 3 = 0 AS backing FROM tracks")
def src17(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf).select("id")
    stems = t.where("id % 2 = 0").withColumn("kind", F.lit("vocals")).unionByName(t.where("id % 3 = 0").withColumn("kind", F.lit("backing")))
    return files.kinds_present(t, stems, ("vocals", "backing"))


@query("src25_incremental", "SELECT doc_id FROM documents WHERE doc_id % 2 <> 0 AND doc_id % 5 <> 0")
def src25(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").select("doc_id", "source")
    path = _place(spark, "features")
    files.append_features(d.where("doc_id % 2 = 0"), path)
    return files.todo(d.select("doc_id"), spark.read.parquet(path), d.where("doc_id % 5 = 0"), "doc_id")


@query("src26_project_clips", """SELECT 's' || user_id || '.wav' AS path, round(min(event_id) / 8e0, 9) AS sec0, round((max(event_id) - min(event_id)) / 8e0 / (count(*) - 1), 9) AS period, true AS consistent FROM events GROUP BY user_id HAVING count(*) > 1""")
def src26(spark: SparkSession, sf: str) -> DataFrame:
    """A project file of each user with a clip whose markers are the user's first and last event, written twice."""
    e = A.table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("z"), F.count("*").alias("n")).where("n > 1")
    clip = F.format_string('<clip path="s%s.wav"><marker sec="%s" beat="0"/><marker sec="%s" beat="%s"/></clip>', F.col("user_id").cast("string"), (F.col("a") / 8).cast("string"), (F.col("z") / 8).cast("string"), (F.col("n") - 1).cast("string"))
    got = files.project_clips(e.select(F.concat(F.lit("<p>"), clip, clip, F.lit("</p>")).alias("xml")))
    return got.select("path", F.round("sec0", 9).alias("sec0"), F.round("period", 9).alias("period"), "consistent")


@query("str01_settled_files", """WITH e AS (SELECT 'f' || user_id || '.mp3' AS name, CAST(trunc(value / 10) AS BIGINT) AS size, epoch_us(ts) / 1e6 AS t FROM events WHERE user_id % 5 <> 0), n AS (SELECT *, lead(size) OVER w AS ns, lead(t) OVER w AS nt FROM e WINDOW w AS (PARTITION BY name ORDER BY t))
SELECT name, arg_min(size, t) AS size, round(min(t) + 1.2, 3) AS ready FROM n WHERE ns = size AND nt - t >= 1.2 GROUP BY name""")
def str01(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events").selectExpr("concat('f', user_id, if(user_id % 5 = 0, '.part', '.mp3')) AS name", "CAST(value / 10 AS BIGINT) AS size", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS ts", "false AS at_start")
    return S.settled(e, 1.2).select("name", "size", F.round("ready", 3).alias("ready"))


@query("str01_stream_settled", """WITH e AS (SELECT 'f' || user_id || CASE WHEN user_id % 5 = 0 THEN '.part' ELSE '.mp3' END AS name, CAST(floor(value / 100) AS BIGINT) AS size, event_id * 130 AS t FROM events WHERE user_id % 5 <> 0),
c AS (SELECT *, size IS DISTINCT FROM lag(size) OVER (PARTITION BY name ORDER BY t) AS changed FROM e), g AS (SELECT name, size, t AS since, lead(t) OVER (PARTITION BY name ORDER BY t) AS until FROM c WHERE changed)
SELECT name, arg_min(size, since) AS size, CAST(min(since) + 1200 AS BIGINT) AS ready_ms FROM g WHERE size > 0 AND coalesce(until, (SELECT max(t) - 1000 FROM e)) - since >= 1200 GROUP BY name""")
def str01_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").selectExpr("concat('f', user_id, if(user_id % 5 = 0, '.part', '.mp3')) AS name", "CAST(floor(value / 100) AS BIGINT) AS size", "event_id * 130 AS t_ms", "timestamp_millis(event_id * 130) AS at", "false AS at_start")
    with _state_in_rocksdb(spark):
        return _drained(S.settling(e, "1 second"))


@query("src13_new_files", f"""WITH {A.HISTORY_SQL}, f AS (SELECT id % 40 AS k, count(*) AS n FROM history GROUP BY 1)
SELECT k || CASE k % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.flac' ELSE '.zip' END AS name, CAST(n AS BIGINT) AS size, k % 4 < 2 AS wanted FROM f WHERE k % 4 < 3 AND k % 3 > 0""")
def src13(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each of 40 kinds of tracks, as large as the kind was played often, written by the executors while a stream looks at the folder.
    Every third was there before, every fourth has the name of an unfinished download. The stream runs when the query is built."""
    spark.dataSource.register(NewFiles)
    folder = _place(spark, "arrivals").removeprefix("file:")
    os.makedirs(folder)
    ending = F.element_at(F.array(*[F.lit(x) for x in (".mp3", ".flac", ".zip", ".mp3.part")]), (F.col("k") % 4 + 1).cast("int"))
    sizes = A.history(spark, sf).groupBy((F.col("id") % 40).alias("k")).agg(F.count("*").alias("n")).select("k", F.concat(F.col("k").cast("string"), ending).alias("name"), "n")

    def put(it):
        for pdf in it:
            for name, n in zip(pdf["name"], pdf["n"]):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(b"x" * n)
            yield pdf[["n"]]

    def write(rows: DataFrame) -> None:
        rows.select("name", "n").mapInPandas(put, "n long").agg(F.sum("n")).collect()

    write(sizes.where("k % 3 = 0"))
    out = _place(spark, "stream")
    stream = spark.readStream.format("new_files").option("path", folder).load().select("name", "size", "wanted")
    q = stream.writeStream.option("checkpointLocation", _place(spark, "offsets")).trigger(processingTime="100 milliseconds").format("parquet").option("path", out).start()
    try:
        q.processAllAvailable()  # the first look
        write(sizes.where("k % 3 > 0"))
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(out)


@query("str01_idle_stop", """WITH e AS (SELECT user_id AS folder, epoch_us(ts) / 1e6 AS t FROM events), s AS (SELECT folder, min(t) - 3600 AS t FROM e GROUP BY 1),
a AS (SELECT folder, t, 1 AS n FROM e UNION ALL SELECT folder, t, 0 FROM s), x AS (SELECT folder, t FROM (SELECT folder, t, lag(t) OVER (PARTITION BY folder ORDER BY t, n) AS b FROM a) WHERE t - b > 21600)
SELECT folder, CAST(sum(n) AS BIGINT) AS arrived, round(max(t) + 21600, 3) AS stopped FROM a WHERE t < coalesce((SELECT min(t) FROM x WHERE x.folder = a.folder), 1e12) GROUP BY folder""")
def str01_idle(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events").selectExpr("user_id AS folder", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS ts")
    starts = e.groupBy("folder").agg((F.min("ts") - 3600).alias("ts"))
    return S.watched(e, starts, 21600.0).withColumn("stopped", F.round("stopped", 3))


_FADER = [
    "'d' || p % 3 AS device", "CAST(floor(p / 12) % 2 AS INT) AS channel", "CAST(p % 4 + 32 * (event_id % 2) AS INT) AS cc",
    "CAST(floor(value) AS INT) % 128 AS value",
    "CAST(p * 50 + CASE WHEN event_id % 2 = 0 THEN 0 WHEN p % 97 = 0 THEN 45 WHEN user_id % 7 = 0 THEN 20 ELSE 2 END AS DOUBLE) AS t_ms",
]
_PAIR = "CAST(floor(event_id / 2) AS BIGINT) AS p"


@query("str02_learned_pairs", f"""WITH RECURSIVE m AS (SELECT device, channel, cc % 32 AS cc, cc >= 32 AS fine, value, t_ms FROM (SELECT {", ".join(_FADER)} FROM (SELECT *, {_PAIR} FROM events) WHERE event_id % 62 <> 1)),
e AS (SELECT *, row_number() OVER (PARTITION BY device, channel, cc ORDER BY t_ms, fine, value) AS n FROM m),
s AS (SELECT device, channel, cc, fine, t_ms, n, CASE WHEN NOT fine THEN value END AS hi, CASE WHEN NOT fine THEN t_ms END AS since, 0 AS streak, NOT fine AS opened, false AS wide, CASE WHEN NOT fine THEN value / 127e0 END AS v FROM e WHERE n = 1 UNION ALL
 SELECT device, channel, cc, fine, t_ms, n, hi, since, streak, opened, wide, CASE WHEN NOT fine THEN value / 127e0 WHEN wide AND t_ms - since < 40 THEN (hi * 128 + value) / 16383e0 END FROM
 (SELECT *, was_wide OR streak >= 4 AS wide FROM
 (SELECT e.device, e.channel, e.cc, e.fine, e.t_ms, e.n, e.value, s.wide AS was_wide, CASE WHEN e.fine THEN s.hi ELSE e.value END AS hi, CASE WHEN e.fine THEN s.since ELSE e.t_ms END AS since,
 CASE WHEN e.fine AND s.opened AND e.t_ms - s.since < 5 THEN s.streak + 1 WHEN NOT e.fine AND s.opened THEN 0 ELSE s.streak END AS streak,
 CASE WHEN e.fine AND e.t_ms - s.since < 5 THEN false WHEN e.fine THEN s.opened ELSE true END AS opened
 FROM s JOIN e ON e.device = s.device AND e.channel = s.channel AND e.cc = s.cc AND e.n = s.n + 1)))
SELECT device, channel, CAST(cc AS INT) AS cc, t_ms, round(v, 9) AS value, fine FROM s WHERE v IS NOT NULL""")
def str02_learned(spark: SparkSession, sf: str) -> DataFrame:
    m = A.table(spark, sf, "events").where("event_id % 62 <> 1").selectExpr("*", _PAIR).selectExpr(*_FADER)
    return S.learned_pairs(m).withColumn("value", F.round("value", 9))


@query("str03_soft_takeover", """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS control, event_id AS seq, event_type = 'view' AS soft, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT control, seq, n, v AS now, CASE WHEN NOT soft THEN v END AS applied, CASE WHEN NOT soft THEN v END AS hard, NOT soft AS taken FROM e WHERE n = 1 UNION ALL
 SELECT control, seq, n, CASE WHEN soft OR NOT blocked THEN v ELSE now END, CASE WHEN soft OR blocked THEN applied ELSE v END, CASE WHEN soft THEN hard ELSE v END, NOT soft AND NOT blocked
 FROM (SELECT e.control, e.seq, e.n, e.soft, e.v, s.now, s.applied, s.hard, coalesce(abs(s.now - s.applied) > 0.03e0 AND abs(e.v - s.now) > 0.04e0 AND (s.hard - s.now) * (e.v - s.now) > 0, false) AS blocked FROM s JOIN e ON e.control = s.control AND e.n = s.n + 1))
SELECT control, seq, now AS value FROM s WHERE taken""")
def str03(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS control", "event_id AS seq", "if(event_type = 'view', 'software', 'hardware') AS source", "value / 100 AS value")
    with _state_in_rocksdb(spark):
        return _drained(S.soft_takeover(e))


@query("str05_stream_bursts")
def str05(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return _drained(S.bursts(e, ["user_id", "event_type"], "at", "6 hours").select("event_id", "user_id", "event_type"))


@query("ext_plays_per_window", "SELECT event_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def plays_window(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    got = _drained(S.plays_per_window(e, "at", "1 day", "1 hour", "event_type"), "complete")
    return got.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("ext_sessions", """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR AS near FROM events) SELECT user_id, count(*) FILTER (near IS NULL OR NOT near) AS sessions FROM g GROUP BY user_id""")
def play_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    got = _drained(S.sessions(e, "at", "6 hours", "40 days", "user_id"), "complete")
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"))
