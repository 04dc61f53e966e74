"""Token-id output: shards of raw ids, each with a minimal perfect hash index from document keys to offsets.

A shard row holds `ids` (raw little-endian payload), and its index: a few bit arrays of a minimal perfect hash, and
per slot a 32-bit fingerprint of the key, the first id and the number of ids. A key is looked up in constant time: its
slot, its fingerprint, its offset. Shards are rows of a Parquet table, so they go through any store Spark writes to,
appear only when the job commits, and hold a bounded number of ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crateflow.llm.common import batches_of, col, fresh_path
from crateflow.llm.tokens import encoder

_SHARD = "part int, shard int, nulls int, first_key long, last_key long, n_ids long, keys binary, lengths binary, ids binary, id_bytes int, mph binary, slots binary"
#: Bits of the hash between two stored counts.
BLOCK = 256
_ENTRY = np.dtype([("fingerprint", "<u4"), ("rows", "<u4"), ("first", "<i8"), ("length", "<i8")])


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit finalizer over unsigned integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mph_build(keys: np.ndarray) -> bytes:
    """Minimal perfect hash of distinct unsigned keys: levels of bits, a key in the first level where it stands alone.

    Stored as the number of levels, their sizes in blocks, and per level its blocks of BLOCK bits and, for each block, the
    count of ones in all before it: a slot is a block's count and the ones of a part of one block.
    """
    left, levels, seed = keys.astype(np.uint64), [], 0
    while len(left):
        m = -(-2 * len(left) // BLOCK) * BLOCK
        at = (mix64(left, seed) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        left, seed = left[~alone[at]], seed + 1
    ones = [np.bitwise_count(x).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32) for x in levels]
    ahead = np.concatenate(([0], np.cumsum(np.concatenate(ones)[:-1]))) if ones else np.empty(0)
    return b"".join((struct.pack(f"<{1 + len(levels)}I", len(levels), *map(len, ones)), ahead.astype("<u4").tobytes(), *(x.tobytes() for x in levels)))


def mph_slots(mph: bytes, keys: np.ndarray) -> np.ndarray:
    """The slot of each key in 0 .. n - 1; of a key that was not put in, any slot or -1.

    The work for a key does not depend on how many the hash holds: one block a level, and 1.6 levels in the mean.
    """
    count = struct.unpack_from("<I", mph)[0]
    blocks = np.frombuffer(mph, "<u4", count, 4).astype(np.int64)
    first, at = np.concatenate(([0], np.cumsum(blocks))), 4 + 4 * count
    ahead = np.frombuffer(mph, "<u4", int(first[-1]), at)
    bits = np.frombuffer(mph, np.uint8, offset=at + 4 * int(first[-1])).reshape(-1, BLOCK // 8)
    keys = keys.astype(np.uint64)
    out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for seed in range(count):
        if not len(todo):
            break
        pos = (mix64(keys[todo], seed) % np.uint64(blocks[seed] * BLOCK)).astype(np.int64)
        block, byte, bit = first[seed] + pos // BLOCK, pos % BLOCK // 8, pos % 8
        hit = bits[block, byte] >> bit & 1 == 1
        block, byte, bit = block[hit], byte[hit], bit[hit]
        part = bits[block] & np.where(np.arange(BLOCK // 8) < byte[:, None], 255, np.where(np.arange(BLOCK // 8) == byte[:, None], (1 << bit[:, None]) - 1, 0)).astype(np.uint8)
        out[todo[hit]] = ahead[block].astype(np.int64) + np.bitwise_count(part).sum(1)
        todo = todo[~hit]
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.uint64), 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _shard_row(part: int, shard: int, keys: list[int | None], ids: list[np.ndarray], id_bytes: int) -> tuple:
    """A shard's row; null keys, which come first, are counted and not indexed."""
    nulls = sum(k is None for k in keys)
    key = np.array([0] * nulls + keys[nulls:], "<i8")
    length = np.array([len(x) for x in ids], "<i8")
    first = np.concatenate(([0], np.cumsum(length)[:-1])).astype("<i8")
    distinct, begin, rows = np.unique(key[nulls:], return_index=True, return_counts=True)
    unsigned = distinct.view(np.uint64)
    mph = mph_build(unsigned)
    slots = np.zeros(len(distinct), _ENTRY)
    slot = mph_slots(mph, unsigned)
    slots["fingerprint"][slot], slots["rows"][slot] = fingerprints(unsigned), rows
    slots["first"][slot], slots["length"][slot] = first[begin + nulls], length[begin + nulls]
    known = keys[nulls:] or [None]
    return (part, shard, nulls, known[0], known[-1], int(length.sum()), key.tobytes(), length.tobytes(), b"".join(x.tobytes() for x in ids), id_bytes, mph, slots.tobytes())


def _shards(path: str, end_id: int, shard_ids: int):
    names = [x.split()[0] for x in _SHARD.split(", ")]
    types = [pa.int32()] * 3 + [pa.int64()] * 3 + [pa.binary()] * 3 + [pa.int32()] + [pa.binary()] * 2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def batch() -> pa.RecordBatch:
            row = _shard_row(part, shard, keys, ids, enc.dtype.itemsize)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for b in batches_of(it, 1):
            for d, got in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                if held >= shard_ids:
                    yield batch()
                    shard, held = shard + 1, 0
                    keys.clear()
                    ids.clear()
                keys.append(d)
                ids.append(np.append(got, got.dtype.type(end_id)))
                held += len(got) + 1
        if keys:
            yield batch()

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, shard_ids: int = 1 << 21, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write shards of about shard_ids ids in ascending order of key to path.

    Null texts are empty (their end id only). Rows with a null id can't be looked up and are stored first. Rows that
    share an id are kept, ordered by a hash of their texts; a shard's index leads to its first and counts them. Ranges are
    cut by id and that hash, so neither null nor repeated ids pile up in one task. An empty table writes no shard. Other
    columns are not read.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), F.coalesce(col(docs, text_col), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    rows.mapInArrow(_shards(tokenizer, end_id, shard_ids), _SHARD).write.option("compression", "snappy").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `before`: ids in all shards ahead of each. Only the shards' counts are ordered, not their ids."""
    from pyspark.sql.types import _parse_datatype_string

    shards = spark.read.schema(_parse_datatype_string(_SHARD)).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    heads = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("_own"))
    heads = heads.join(parts, heads["part"] == parts["_part"]).select(F.col("part").alias("_p"), F.col("shard").alias("_s"), (F.col("_ahead") + F.col("_own")).alias("before"))
    # a row of 24 bytes per shard of 2**21 ids or more than 4 MB: a broadcast of 1/170,000 of the payload
    few = heads.count() <= 1_000_000
    return shards.join(F.broadcast(heads) if few else heads, (shards["part"] == F.col("_p")) & (shards["shard"] == F.col("_s"))).drop("_p", "_s")


def look_up(row: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first id, number of ids, rows of the key) of each key in a shard; -1 where the shard does not hold it."""
    slots = np.frombuffer(row["slots"], _ENTRY)
    unsigned = keys.astype("<i8").view(np.uint64)
    slot = mph_slots(row["mph"], unsigned)
    got = slots[np.maximum(slot, 0)] if len(slots) else np.zeros(len(keys), _ENTRY)
    ok = (slot >= 0) & (got["fingerprint"] == fingerprints(unsigned)) & (len(slots) > 0)
    return np.where(ok, got["first"], -1), np.where(ok, got["length"], -1), np.where(ok, got["rows"], 0)


def documents_in(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each found through its shard's index and read from its ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                keys, lengths = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
                first, n, rows = look_up(row, keys)
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                # null keys have no entry; later rows of a repeated id follow the first, which the index leads to
                null = np.arange(len(keys)) < row["nulls"]
                again = (rows > 1) | null
                first, n = np.where(again, starts, first), np.where(again, lengths, n)
                if (n < 0).any():
                    raise ValueError("a stored document is not in its shard's index")
                crc = [zlib.crc32(ids[a : a + m].astype("<u4").tobytes()) for a, m in zip(first.tolist(), n.tolist())]
                doc = pa.array(keys, pa.int64(), mask=null)
                yield pa.RecordBatch.from_arrays([doc, pa.array(first + row["before"], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names)

    wanted = shards.select("nulls", "keys", "lengths", "ids", "id_bytes", "mph", "slots", "before")
    return wanted.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find(shards: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """ids of the wanted keys: (doc_id, ids array<long>), no row for a key that no shard holds.

    Keys meet the shards' key ranges in a range join over a row per shard, then each shard answers by its index: a slot,
    its fingerprint, and a slice of the shard's ids. The unit of reading is a shard (some MB). Of a repeated id the first
    row of each shard that holds it is given.
    """
    wanted = keys.select(col(keys, id_col).cast("long").alias("_key")).where("_key is not null").distinct()
    heads = shards.select("part", "shard", "first_key", "last_key")
    at = wanted.join(heads, (F.col("_key") >= F.col("first_key")) & (F.col("_key") <= F.col("last_key"))).groupBy("part", "shard").agg(F.collect_list("_key").alias("_keys"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                want = np.array(row["_keys"], "<i8")
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
                hits = [(k, ids[a : a + n].tolist()) for k, a, n in zip(want.tolist(), *(x.tolist() for x in look_up(row, want)[:2])) if a >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return shards.join(at, ["part", "shard"]).select("ids", "id_bytes", "mph", "slots", "_keys").mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = 1 << 21) -> DataFrame:
    """Write docs as shards in the shared folder, and return what is read back from them."""
    path = fresh_path(docs.sparkSession, "token-shards")
    write_shards(docs, tokenizer, end_id, path, shard_ids)
    return documents_in(read_shards(docs.sparkSession, path))
