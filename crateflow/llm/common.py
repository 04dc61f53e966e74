"""What the training-data operators share: shared storage, safe column names, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The one definition of a word: a run of bytes other than ASCII space, tab, LF, VT, FF and CR.
ASCII_SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets one made
    here, and a cluster, whose machines share no temporary folder, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="crateflow-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/crateflow/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def text_bytes(df: DataFrame, name: str = "text") -> Column:
    """UTF-8 bytes of a text column; a null text is an empty one."""
    return F.coalesce(col(df, name), F.lit("")).cast("binary")


def batches_of(it: Iterator[pa.RecordBatch], text_at: int, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most most_bytes of text each (one row at least), to bound a worker's memory."""
    for batch in it:
        sizes = pc.binary_length(batch.column(text_at)).fill_null(0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
