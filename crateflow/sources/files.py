"""Reading and keeping files: directory scans, stores with defaults, incremental features, project files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIO = ("mp3", "m4a", "aac", "flac", "wav", "aif", "aiff", "ogg", "oga", "opus", "wma", "mp4", "alac", "webm")
PARTIAL = ("crdownload", "part", "partial", "download", "tmp", "temp", "opdownload")
MOST_DEPTH = 24


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files below a folder: path, size, modified, depth. Hidden entries and deeper levels are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder)
    return audio_only(found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")), folder)


def audio_only(paths: DataFrame, folder: str) -> DataFrame:
    """Of rows with a path, those that a scan of folder lists."""
    root = folder.rstrip("/")
    inside = F.regexp_replace("path", "^.*?" + _literal(root) + "/", "")
    parts = F.split(inside, "/")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    ok = extension.isin(*AUDIO) & (F.size(parts) <= MOST_DEPTH + 1) & ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    return paths.withColumn("depth", F.size(parts) - 1).where(ok)


def _literal(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in s)


def json_store(spark: SparkSession, path: str, schema: T.StructType, defaults: dict) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt): JSON documents with absent fields set from defaults, and the ones that don't parse."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("v")).select("v.*", F.col("v._corrupt").isNotNull().alias("_bad"))
    rows = parsed.where("NOT _bad").select(*[F.coalesce(F.col(f.name), F.lit(defaults[f.name])).alias(f.name) if f.name in defaults else F.col(f.name) for f in schema.fields])
    return rows, parsed.where("_bad").select(F.col("_corrupt").alias("text"))


def _folder(spark: SparkSession, path: str):
    """A path of any file system that Spark reaches, and that file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def store_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a store that were written to their end, oldest first."""
    at, fs = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    found = sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))
    return [v for v in found if fs.exists(_folder(spark, f"{path}/version-{v}/_SUCCESS")[0])]


def save_store(df: DataFrame, path: str) -> None:
    """Write a new version of a store; the one before stays as its backup, older ones go.

    Readers see the new version when its write has been committed, and until then the one before: nothing is replaced in
    place. One writer at a time.
    """
    spark = df.sparkSession
    before = store_versions(spark, path)
    df.write.mode("overwrite").json(f"{path}/version-{max(before, default=0) + 1}")  # over the rest of a broken write
    for old in before[:-1]:
        at, fs = _folder(spark, f"{path}/version-{old}")
        fs.delete(at, True)


def load_store(spark: SparkSession, path: str, schema: T.StructType, defaults: dict) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt) of a store's newest version whose documents all parse; without one, what parses of the newest.

    corrupt: the texts that don't parse, of all versions passed over. A store never written is empty.
    """
    bad = spark.createDataFrame([], "text string")
    newest = None
    for version in reversed(store_versions(spark, path)):
        rows, corrupt = json_store(spark, f"{path}/version-{version}", schema, defaults)
        newest = newest or rows
        if corrupt.isEmpty():
            return rows, bad
        bad = bad.unionByName(corrupt)
    return newest or spark.createDataFrame([], schema), bad


def todo(wanted: DataFrame, done: DataFrame, skipped: DataFrame, key: str) -> DataFrame:
    """What is neither done nor marked to skip: the input of an incremental run."""
    return wanted.join(done.select(key), key, "left_anti").join(skipped.select(key), key, "left_anti")


def append_features(features: DataFrame, path: str) -> None:
    features.write.mode("append").partitionBy("source").parquet(path)


def kinds_present(tracks: DataFrame, stems: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """tracks with a flag for each kind of derived file that exists."""
    have = stems.groupBy("id").pivot("kind", list(kinds)).agg(F.lit(True))
    return tracks.join(have, "id", "left").select(*tracks.columns, *[F.coalesce(F.col(k), F.lit(False)).alias(k) for k in kinds])


def project_clips(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Clips of project files: path, and first and last warp marker; a path that disagrees with itself is flagged."""
    clip = "ROW<_path: STRING, marker: ARRAY<STRUCT<_sec: DOUBLE, _beat: DOUBLE>>>".replace("ROW<", "STRUCT<")
    doc = F.from_xml(F.col(column), f"STRUCT<clip: ARRAY<{clip}>>")
    clips = xml.select(F.explode(doc["clip"]).alias("c")).select(F.col("c._path").alias("path"), F.col("c.marker").alias("m"))
    first, last = F.col("m")[0], F.element_at("m", -1)
    rows = clips.select("path", first["_sec"].alias("sec0"), ((last["_sec"] - first["_sec"]) / (last["_beat"] - first["_beat"])).alias("period"))
    return rows.groupBy("path").agg(F.first("sec0").alias("sec0"), F.first("period").alias("period"), (F.countDistinct(F.round("period", 6)) == 1).alias("consistent"))
