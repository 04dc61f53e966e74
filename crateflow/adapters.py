"""The test tables seen as a music library: tracks, keys, history, playlists, beats, frames.

Each view is given twice: as a DataFrame, and as SQL text for `WITH` in the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TRACK = [
    "CAST(p_partkey AS BIGINT) AS id", "p_name AS title", "p_brand AS artist", "p_type AS genre",
    "CASE WHEN p_partkey % 17 = 0 THEN 0e0 ELSE 70e0 + (p_partkey * 7) % 111 END AS bpm",
    "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST((p_partkey * 5) % 24 AS INT) END AS key_idx",
    "CAST(1 + p_size % 10 AS INT) AS energy", "150e0 + p_partkey % 300 AS duration", "(p_partkey % 8) / 16e0 AS grid_offset",
]
_KEY = [
    "key_idx", "CAST(key_idx % 12 AS INT) AS tonic", "key_idx >= 12 AS minor",
    "CAST(1 + ((7 * (key_idx % 12) + CASE WHEN key_idx >= 12 THEN 4 ELSE 7 END) % 12) AS INT) AS camelot_n",
    "CASE WHEN key_idx >= 12 THEN 'A' ELSE 'B' END AS camelot_l",
    "substr('C C#D EbE F F#G AbA BbB ', 1 + 2 * (key_idx % 12), 2) AS note",
]
_KEY_NAME = "trim(note) || CASE WHEN minor THEN 'm' ELSE '' END"

TRACKS_SQL = f"tracks AS (SELECT {', '.join(_TRACK)} FROM part)"
KEYS_SQL = f"keys AS (SELECT key_idx, {_KEY_NAME} AS key, tonic, minor, camelot_n, camelot_l, camelot_n || camelot_l AS code FROM (SELECT {', '.join(_KEY)} FROM (SELECT CAST(range AS INT) AS key_idx FROM range(24))))"
KEYED_SQL = f"{TRACKS_SQL}, {KEYS_SQL}, keyed AS (SELECT t.*, k.key, k.camelot_n, k.camelot_l, k.code FROM tracks t LEFT JOIN keys k USING (key_idx))"
HISTORY_SQL = "history AS (SELECT event_id, CAST(event_id % (SELECT count(*) FROM part) AS BIGINT) AS id, ts AS played_at, user_id FROM events WHERE event_type IN ('view', 'purchase'))"
PLAYLISTS_SQL = "playlists AS (SELECT l_orderkey AS playlist, l_partkey AS track, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS pos FROM lineitem)"
MASHUPS_SQL = f"{PLAYLISTS_SQL}, mashups AS (SELECT DISTINCT base, vocal FROM (SELECT lag(track) OVER (PARTITION BY playlist ORDER BY pos) AS base, track AS vocal FROM playlists) WHERE base IS NOT NULL AND base <> vocal)"
BEATS_SQL = "beats AS (SELECT user_id AS series, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INT) - 1 AS idx, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) AS t, value AS v FROM events)"
#: 64 vectors in a row are a track, so that a track's frames are few however many vectors there are.
FRAMES_SQL = "frames AS (SELECT CAST(floor(vec_id / 64) AS INT) AS track, CAST(row_number() OVER (PARTITION BY floor(vec_id / 64) ORDER BY vec_id) AS INT) - 1 AS idx, vec_id, embedding FROM embeddings)"
MESSAGES_SQL = "messages AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_TRACK)


def keys(spark: SparkSession) -> DataFrame:
    """The 24 keys with their places on the Camelot wheel."""
    rows = spark.range(24).selectExpr("CAST(id AS INT) AS key_idx").selectExpr(*_KEY)
    return rows.selectExpr("key_idx", f"{_KEY_NAME} AS key", "tonic", "minor", "camelot_n", "camelot_l", "camelot_n || camelot_l AS code")


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with their key's name and Camelot code. The keys are 24 rows, always."""
    return tracks(spark, sf_dir).join(F.broadcast(keys(spark).select("key_idx", "key", "camelot_n", "camelot_l", "code")), "key_idx", "left")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    plays = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')")
    return plays.crossJoin(F.broadcast(n)).select("event_id", (F.col("event_id") % F.col("n")).alias("id"), F.col("ts").alias("played_at"), "user_id")


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what PLAYLISTS_SQL orders by besides tells only lines of one number and track apart, which read alike: it need not be shuffled
    rank = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)"
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS playlist", "l_partkey AS track", f"{rank} AS pos")


def mashups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # in the order of playlists() by the lines themselves, as a window over its places would shuffle all lines again; dealt by
    # the base alone, the pairs are not shuffled again either to be brought together by it
    before = "lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)"
    pairs = table(spark, sf_dir, "lineitem").selectExpr(f"{before} AS base", "l_partkey AS vocal")
    return pairs.where("base IS NOT NULL AND base <> vocal").repartition("base").distinct()


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").selectExpr("user_id AS series", "ts", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS s", "value AS v")
    return t.selectExpr("series", "row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS idx", "s - min(s) OVER (PARTITION BY series) AS t", "v")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("CAST(floor(vec_id / 64) AS INT) AS track", "row_number() OVER (PARTITION BY floor(vec_id / 64) ORDER BY vec_id) - 1 AS idx", "vec_id", "embedding")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
