"""Packing: documents become fixed-size training sequences by bounded-space online best fit.

Every partition keeps at most `open_windows` windows. A piece goes to the window it fills best; when none has room
and no more may be opened, the fullest is filled up with the head of the piece (`split`) or left as it is, and emitted.
What is still open at the end of the partitions is packed once more, best fit decreasing, by groups of partitions.
No step needs more than its partition's windows in memory, and one pass over the texts does it all.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import batches_of, col, stored
from crateflow.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIRST = PIECES + ", still_open boolean, part int"
#: Sequence ids: partition << 32 | count; those of merged leftovers carry this bit as well.
MERGED = 1 << 61


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


class OpenWindows:
    """At most `most` windows of `size` ids; place() hands every piece to emit(window, offset, start, ids)."""

    def __init__(self, size: int, most: int, split: bool, emit: Callable):
        self.size, self.most, self.split, self.emit = size, most, split, emit
        self.open: list[tuple[int, int]] = []  # (ids in it, window), ascending
        self.windows = 0

    def _new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, ids: np.ndarray) -> None:
        start, n = 0, len(ids)
        while n - start >= self.size:
            self.emit(self._new(), 0, start, ids[start : start + self.size])
            start += self.size
        while start < n:
            need = n - start
            at = bisect_right(self.open, (self.size - need, 1 << 62)) - 1
            if at >= 0:
                fill, window = self.open.pop(at)
            elif len(self.open) < self.most:
                fill, window = 0, self._new()
            else:
                fill, window = self.open.pop()
                if not self.split:
                    continue
                need = self.size - fill
            self.emit(window, fill, start, ids[start : start + need])
            start += need
            if fill + need < self.size:
                insort(self.open, (fill + need, window))


def _pack_partition(path: str, end_id: int, size: int, most: int, split: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        rows: list[tuple] = []
        doc: list = [None, 0]
        held: dict[int, list[tuple]] = {}

        def emit(window: int, offset: int, start: int, ids: np.ndarray) -> None:
            held.setdefault(window, []).append((doc[0], start, len(ids), crc_of_ids(ids), doc[1], part << 32 | window, offset))
            if offset + len(ids) == size:
                rows.extend(r + (False, part) for r in held.pop(window))

        windows = OpenWindows(size, most, split, emit)
        names = [x.split()[0] for x in _FIRST.split(", ")]
        types = [pa.int64()] * 7 + [pa.bool_(), pa.int32()]

        def batch() -> pa.RecordBatch:
            cols = zip(*rows) if rows else [[]] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
            rows.clear()
            return out

        for b in batches_of(it, 1):
            for d, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                doc[:] = d, len(ids) + 1
                windows.place(np.append(ids, ids.dtype.type(end_id)))
            still = {w for _, w in windows.open}
            for w in [w for w in held if w not in still]:  # emitted with room left: only where pieces aren't split
                rows.extend(r + (False, part) for r in held.pop(w))
            yield batch()
        rows.extend(r + (True, part) for w in held.values() for r in w)
        yield batch()

    return run


def _merge(size: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Best fit decreasing over the pieces of the windows that some partitions left open."""
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        fills: list[tuple[int, int]] = []
        sequence, offset, count = [], [], 0
        for n in pdf["length"]:
            at = bisect_right(fills, (size - n, 1 << 62)) - 1
            fill, window = fills.pop(at) if at >= 0 else (0, count)
            count += window == count
            sequence.append(MERGED | int(key[0]) << 32 | window)
            offset.append(fill)
            insort(fills, (fill + int(n), window))
        return pdf.assign(sequence_id=sequence, offset=offset).drop(columns=["still_open", "part", "_batch"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, open_windows: int = 32, split: bool = True, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it starts in the document and in which sequence, at which offset, it lies.

    size: ids of a sequence. open_windows: windows a partition keeps. split: a piece may be cut to fill the fullest
    window. fan_in: partitions whose leftovers are merged in one task, so that task holds fan_in * open_windows windows
    at most. Null text: an empty document (its end id only). Null ids and repeated rows are packed like any other row.
    An empty table gives no rows; other columns of docs are not read, whatever their names.
    """
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), F.coalesce(col(docs, text_col), F.lit("")).alias("text"))
    first = stored(rows.mapInArrow(_pack_partition(tokenizer, end_id, size, open_windows, split), _FIRST), "packing")
    left = first.where("still_open").withColumn("_batch", F.floor(F.col("part") / fan_in).cast("long"))
    merged = left.groupBy("_batch").applyInPandas(_merge(size), PIECES)
    return first.where("not still_open").drop("still_open", "part").unionByName(merged)
