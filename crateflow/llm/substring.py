"""Exact substring deduplication by seed and extend.

A window is `window` consecutive words of a document. Every window owns one anchor: the least hash among the k-grams
in it (the last, on a tie), so equal windows own equal anchors at equal offsets, and each anchor of a document owns
one run of consecutive windows. Documents are joined on anchors. Where whole runs are equal, that is settled by one
row per run. Where an anchor is shared but runs differ (the ends of a repeat), one copy of each different run is
extended to both sides, word by word, by the hashes of the windows in it. What the windows found cover are the maximal
repeats of at least `window` words; they are removed from all but the first document that holds them.

Hashes of runs and windows are only compared under one anchor's hash: 128 bits together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from crateflow.llm.common import batches_of, col, stored, text_bytes

_ODD, _ODD2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Words of a window and of an anchor: 50 - 16 + 1 anchors to choose from, so runs of about 18 windows.
WINDOW, K_DEFAULT = 50, 16


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)


class Prefix:
    """Hashes of any spans of a word sequence: sums of word hash times a power, modulo 2**64."""

    def __init__(self, h: np.ndarray, base: int):
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(base, len(h)), dtype=np.uint64)))
        self.inverse = _powers(inverse, len(h) + 1)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(32))


def _last_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the place of the least one, the last on a tie."""
    n = len(x)
    at, span = np.arange(n), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at, span = np.where(x[b] <= x[a], b, a), span + step
    return at


def runs_of(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of the run's whole span, first window, windows) of every run of windows with one anchor."""
    if len(h) < window:
        e = np.empty(0, np.int64)
        return e.view(np.uint64), e.view(np.uint64), e, e
    grams = Prefix(h, _ODD)
    first = np.arange(len(h) - k + 1)
    gram = grams.spans(first, first + k)
    owner = _last_least(gram, window - k + 1)
    begin = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
    size = np.diff(np.append(begin, len(owner)))
    anchor = gram[owner[begin]]
    # the anchor's offset in the run belongs to the run's identity
    span = Prefix(h, _ODD2).spans(begin, begin + size + window - 1) ^ ((owner[begin] - begin).astype(np.uint64) * np.uint64(_ODD))
    return anchor, span, begin, size


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _find_runs(window: int, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 2):
            parts = []
            for d, key, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = t.split()
                if len(words) >= window:
                    got = runs_of(word_hashes(words), window, k)
                    parts.append((*got, np.full(len(got[0]), d), np.full(len(got[0]), key)))
            if parts:
                anchor, span, begin, size, doc, key = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(span), pa.array(doc), pa.array(key), pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32))], ["anchor", "span", "doc_id", "key", "begin", "size"])

    return run


def _extend(window: int):
    """Windows of the runs asked for in a document: one row each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 2):
            parts = []
            for d, key, t, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
                h = word_hashes(t.split())
                hashes = Prefix(h, _ODD2)
                size = np.array([w["size"] for w in wanted])
                at = np.repeat(np.array([w["begin"] for w in wanted]) - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                anchor = np.repeat(np.array([w["anchor"] for w in wanted], np.int64), size)
                parts.append((anchor, hashes.spans(at, at + window), np.full(len(at), d), np.full(len(at), key), at))
            if parts:
                anchor, win, doc, key, at = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), _signed(win), pa.array(doc), pa.array(key), pa.array(at.astype(np.int32))], ["anchor", "win", "doc_id", "key", "begin"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key and t: an id and a hash of the text name a row's content, however often it is repeated."""
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("t"))
    return rows.select("doc_id", F.xxhash64("t").alias("key"), "t")


def repeats(docs: DataFrame, window: int = WINDOW, k: int = K_DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, begin, size): runs of windows whose words also start in a document with a smaller id.

    Of windows that a document repeats within itself, one place at least is given.
    """
    rows = _texts(docs, id_col, text_col).where("doc_id is not null")
    runs = stored(rows.mapInArrow(_find_runs(window, k), "anchor long, span long, doc_id long, key long, begin int, size int"), "runs")
    spans = runs.groupBy("anchor", "span").agg(F.min(F.struct("doc_id", "key", "begin", "size")).alias("s"), F.max("doc_id").alias("last"))
    spans = stored(spans.select("anchor", "span", "s.*", "last"), "run-classes")
    groups = spans.groupBy(F.col("anchor").alias("_anchor")).agg(F.count("*").alias("_n"), F.min("doc_id").alias("_low"), F.max("last").alias("_high"))
    groups = stored(groups.where("_n > 1 and _low < _high"), "mixed-anchors")
    whole = spans.where("doc_id < last").select(F.col("anchor").alias("_a"), F.col("span").alias("_s"), F.col("doc_id").alias("_first"))
    equal = runs.join(whole, (F.col("anchor") == F.col("_a")) & (F.col("span") == F.col("_s"))).where("doc_id > _first").select("doc_id", "key", "begin", "size")
    mixed = spans.join(groups, F.col("anchor") == F.col("_anchor"), "left_semi")
    asked = mixed.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("anchor", "begin", "size")).alias("_runs"))
    windows = rows.join(asked, (F.col("doc_id") == F.col("_doc")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "t", "_runs")
    windows = stored(windows.mapInArrow(_extend(window), "anchor long, win long, doc_id long, key long, begin int"), "windows")
    least = windows.groupBy(F.col("anchor").alias("_a"), F.col("win").alias("_w")).agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    least = stored(least.where("_first < _last").drop("_last"), "first-windows")
    ends = windows.join(least, (F.col("anchor") == F.col("_a")) & (F.col("win") == F.col("_w"))).where("doc_id > _first")
    return equal.unionByName(ends.select("doc_id", "key", "begin", F.lit(1).alias("size")))


def _stay(words: list[bytes], ranges: list, window: int) -> np.ndarray:
    """Which words stay, given runs of windows to remove; the same windows elsewhere in the text go too."""
    edge = np.zeros(len(words) - window + 2, np.int64)
    np.add.at(edge, [r["begin"] for r in ranges], 1)
    np.add.at(edge, [r["begin"] + r["size"] for r in ranges], -1)
    found = np.cumsum(edge)[:-1] > 0
    begin = np.arange(len(found))
    win = Prefix(word_hashes(words), _ODD2).spans(begin, begin + window)
    at = np.flatnonzero(np.isin(win, win[found]))
    cover = np.zeros(len(words) + 1, np.int64)
    cover[at] += 1
    cover[at + window] -= 1
    return np.cumsum(cover)[:-1] == 0


def _without(window: int, give_text: bool):
    def kept(text: bytes, ranges: list | None) -> tuple[int, int, bytes]:
        words = text.split()
        left = [w for w, s in zip(words, _stay(words, ranges, window).tolist()) if s] if ranges else words
        return len(words), len(words) - len(left), b" ".join(left)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 1):
            got = [kept(t, r) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            arrays = [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())]
            last = pa.array([g[2] for g in got], pa.binary()) if give_text else pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, last], ["doc_id", "n_words", "n_removed", "kept" if give_text else "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K_DEFAULT, id_col: str = "doc_id", text_col: str = "text", give_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row (with give_text, the kept words themselves as `kept`).

    A word is removed if a window over it also starts in a document with a smaller id. Windows are judged on the
    input. Null and empty texts have no words. Rows with a null id are never a source and keep all their words. Rows
    that share an id are one document to each other: neither removes from the other. Other columns are not read.
    """
    ranges = repeats(docs, window, k, id_col, text_col)
    by_doc = ranges.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("begin", "size")).alias("_ranges"))
    rows = _texts(docs, id_col, text_col)
    joined = rows.join(by_doc, (F.col("doc_id") == F.col("_doc")) & (F.col("key") == F.col("_key")), "left").select("doc_id", "t", "_ranges")
    last = "kept binary" if give_text else "kept_sha256 string"
    return joined.mapInArrow(_without(window, give_text), f"doc_id long, n_words long, n_removed long, {last}")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def cut_repeats(docs: DataFrame, window: int = WINDOW, k: int = K_DEFAULT, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of docs, all columns, with repeated words cut out of the texts; white space after a kept word stays.

    length_col, if there is one, is set to the new text's characters where words were cut. Rows that lose all their
    words are left out; texts that had none, null ones too, stay as they are.
    """
    ranges = repeats(docs, window, k, id_col, text_col)
    by_doc = ranges.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("begin", "size")).alias("_ranges"))
    names = [f"__{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None
    rows = docs.toDF(*names)
    own = F.xxhash64(F.coalesce(F.col(names[at]), F.lit("")).cast("binary"))
    joined = rows.join(by_doc, (F.col(names[docs.columns.index(id_col)]).cast("long") == F.col("_doc")) & (own == F.col("_key")), "left").select(*names, "_ranges")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, at):
            arrays, texts = list(b.columns[:-1]), b.column(at).to_pylist()
            lengths = arrays[length_at].to_pylist() if length_at is not None else []
            keep = np.ones(len(texts), bool)
            for i, r in enumerate(b.column(len(arrays)).to_pylist()):
                if r:
                    spans = _WORD.findall(texts[i].encode())
                    stay = _stay([w.split()[0] for w in spans], r, window).tolist()
                    texts[i] = b"".join(w for w, s in zip(spans, stay) if s).decode().rstrip()
                    keep[i] = any(stay)
                    if length_at is not None:
                        lengths[i] = len(texts[i])
            arrays[at] = pa.array(texts, arrays[at].type)
            if length_at is not None:
                arrays[length_at] = pa.array(lengths, arrays[length_at].type)
            yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(keep))

    return joined.mapInArrow(run, rows.schema).toDF(*docs.columns)
