"""SimHash near-duplicates by anchor-point covering.

The anchors are pairs of codewords of the perfect binary Golay code: bits 0-22 and 23-45 of a fingerprint each lie
within 3 bits of exactly one codeword. A fingerprint's home is that pair. It is replicated to every pair that the home
of a fingerprint within the threshold can be (per block within radius 3 plus the bits that differ there, about 61 of
2**24 anchors at a threshold of two bits), so two fingerprints within the threshold always meet at the home of either.
Anchors that too many fingerprints call home are taken by the trivial covering code instead, all 64-bit words: two
fingerprints at most two bits apart are both within one bit of some word, and at most 65 fingerprints are that near
to one word, so no group can grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from crateflow.llm.common import batches_of, col, stored, text_bytes
from crateflow.llm.components import components

BLOCK = 23
#: Fixed value: generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_MASK = np.uint64((1 << BLOCK) - 1)
#: Threshold in bits that the covering below is laid out for.
THRESHOLD = 2


def shingle_hashes(data: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `words` words (the whole sequence, if shorter), A-Z lower-cased; no words, no hashes."""
    parts = data.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    pairs = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in pairs), np.uint64, len(parts) - k + 1)


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; of no hashes, zero."""
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprint_rows(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long; a null text has no words and fingerprint zero."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 1):
            got = np.array([simhash(shingle_hashes(t, words)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(col(docs, id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Syndromes of the low 12 and high 11 bits, and per syndrome its error patterns: of weight <= 3, 4 and 5."""
    unit = []
    for i in range(BLOCK):
        x = 1 << i
        for j in range(BLOCK - 1, 10, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - 11)
        unit.append(x)
    tables = []
    for width, first in ((12, 0), (11, 12)):
        t = np.zeros(1 << width, np.int64)
        for i in range(width):
            t[(np.arange(1 << width) >> i & 1) == 1] ^= unit[first + i]
        tables.append(t)
    near, lists = np.zeros(2048, np.uint64), [[[], []] for _ in range(2048)]
    for weight in range(6):
        for bits in combinations(range(BLOCK), weight):
            s = e = 0
            for i in bits:
                s ^= unit[i]
                e |= 1 << i
            if weight <= 3:
                near[s] = e
            else:
                lists[s][weight - 4].append(e)
    far = []
    for w in (0, 1):
        most = max(len(x[w]) for x in lists)
        t = np.full((2048, most), -1, np.int64)
        for s, x in enumerate(lists):
            t[s, : len(x[w])] = x[w]
        far.append(t)
    return tables[0], tables[1], near, far


def _syndrome(block: np.ndarray) -> np.ndarray:
    low, high, _, _ = _golay()
    x = block.astype(np.int64)
    return low[x & 4095] ^ high[x >> 12]


def homes(fp: np.ndarray) -> np.ndarray:
    """The anchor of each fingerprint: the codeword next to each of its two blocks."""
    near = _golay()[2]
    a, b = fp & _MASK, (fp >> np.uint64(BLOCK)) & _MASK
    return (a ^ near[_syndrome(a)]) | (b ^ near[_syndrome(b)]) << np.uint64(BLOCK)


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for every anchor that is the home of a fingerprint within THRESHOLD bits."""
    near, far = _golay()[2:]
    blocks = [fp & _MASK, (fp >> np.uint64(BLOCK)) & _MASK]
    levels = []
    for x in blocks:
        s = _syndrome(x)
        word = x.astype(np.int64)[:, None]
        levels.append([word ^ near[s].astype(np.int64)[:, None]] + [np.where(far[w][s] < 0, -1, word ^ far[w][s]) for w in (0, 1)])
    at, anchor = [], []
    for i, j in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)):
        a, b = levels[0][i][:, :, None], levels[1][j][:, None, :]
        full = np.where((a < 0) | (b < 0), -1, a | b << BLOCK).reshape(len(fp), -1)
        r, c = np.nonzero(full >= 0)
        at.append(r)
        anchor.append(full[r, c])
    return np.concatenate(at), np.concatenate(anchor)


def _spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fp), 2048):
            part = fp[k : k + 2048]
            at, anchor = replicas(part)
            home = anchor.view(np.uint64) == homes(part)[at]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[at].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


def _links_at_anchors(it: Iterator[pa.RecordBatch], slice_rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, homes first. Every replica is compared with the homes of its anchor; links within it are
    joined to trees, so an anchor gives fewer edges than rows. Of an anchor with very many replicas, the homes alone are
    kept from one slice to the next."""
    held: list[tuple] = []

    def flush(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        _, begin = np.unique(anchor, return_index=True)
        end = np.append(begin[1:], len(anchor))
        n_home = np.add.reduceat(home.astype(np.int64), begin)
        out_a, out_b = [], []
        for s, e in zip(begin[(n_home > 0) & (end - begin > 1)].tolist(), end[(n_home > 0) & (end - begin > 1)].tolist()):
            x, h = fp[s:e], fp[s:e][home[s:e]]
            label = np.arange(e - s)
            at_home = np.flatnonzero(home[s:e])
            step = max(1, (1 << 21) // len(h))
            for k in range(0, len(x), step):
                i, j = np.nonzero(np.bitwise_count(x[k : k + step, None] ^ h[None, :]) <= THRESHOLD)
                i, j = i + k, at_home[j]
                while len(i):
                    la, lb = label[i], label[j]
                    if (la == lb).all():
                        break
                    np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                    while (label != label[label]).any():
                        label = label[label]
            child = np.flatnonzero(label != np.arange(e - s))
            out_a.append(x[child])
            out_b.append(x[label[child]])
        a = np.concatenate(out_a) if out_a else np.empty(0, np.uint64)
        b = np.concatenate(out_b) if out_b else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for b in it:
        now = (b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False))
        if held:
            now = tuple(np.concatenate(p) for p in zip(held[0], now))
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if cut:
            yield flush(*(x[:cut] for x in now))
        held = [tuple(x[cut:] for x in now)]
        if len(held[0][0]) > slice_rows:
            yield flush(*held[0])
            held = [tuple(x[held[0][2]] for x in held[0])]
    if held and len(held[0][0]):
        yield flush(*held[0])


def _bridges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for b in it:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fp), 2048):
            x = fp[k : k + 2048]
            yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(x, 65).view(np.int64))], ["word", "fp"])


def links(fps: DataFrame, most_at_anchor: int = 2000) -> DataFrame:
    """Edges (a, b) that connect whatever distinct fingerprints `fp` lie within two bits of each other.

    most_at_anchor: an anchor with more homes is taken by bridging words. It is the same at every size; what is known of
    such anchors is joined by key, never broadcast unasked.
    """
    spread = fps.select("fp").mapInArrow(_spread, "anchor long, fp long, home boolean")

    def home(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(homes(x).view(np.int64))], ["anchor"])

    hot = fps.select("fp").mapInArrow(home, "anchor long").groupBy("anchor").count().where(F.col("count") > most_at_anchor).select("anchor")
    hot = stored(hot, "hot-anchors")
    if hot.isEmpty():
        usual, more = spread, None
    else:
        usual = spread.join(hot, "anchor", "left_anti")
        crowd = spread.join(hot, "anchor", "left_semi").select("fp").distinct()
        words = crowd.mapInArrow(_bridges, "word long, fp long")
        least = words.groupBy("word").agg(F.min("fp").alias("b"), F.max("fp").alias("_top"), F.collect_list("fp").alias("_all")).where("b != _top")
        more = least.select(F.explode("_all").alias("a"), "b").where("a != b")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = usual.repartition(n, "anchor").sortWithinPartitions("anchor", F.desc("home")).mapInArrow(_links_at_anchors, "a long, b long")
    return found if more is None else found.unionByName(more)


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id: the smallest doc_id that links of two bits or fewer lead to.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay, each with the same
    values. A null doc_id is never a component's id unless the whole component has none (then null). Extra columns are
    not read. An empty table gives no rows.
    """
    rows = stored(fingerprint_rows(docs, words, id_col, text_col), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    found = components(links(classes))
    linked = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    roots = linked.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "_root")
    of_class = stored(linked.join(roots, F.col("label") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"), "components")
    joined = rows.join(of_class, F.col("fp") == F.col("_fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
