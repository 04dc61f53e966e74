"""Quality by a byte-level convolutional network in numpy.

Filters of eight bytes move over the whole text in steps of two; each filter is a learned table of a value per byte
and offset. Blocks of 256 bytes keep each filter's largest response, two neighbouring blocks make an overlapping chunk
of 512 bytes, and mean, maximum and minimum over all chunks of the text feed a small dense layer and one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import batches_of, col, text_bytes

BLOCK, WIDTH, FILTERS, HIDDEN = 256, 8, 16, 16
#: The limit at which a text counts as good.
GOOD = 0.3


@dataclass
class Model:
    tables: np.ndarray  # (WIDTH, 256, FILTERS): the filters
    bias: np.ndarray
    w1: np.ndarray  # (3 * FILTERS, HIDDEN)
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def paired(self) -> list[np.ndarray]:
        """The filters as tables over pairs of bytes: half the look-ups."""
        return [(self.tables[k + 1][None, :, :] + self.tables[k][:, None, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def head(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(docs @ self.w1 + self.b1, 0)
        return hidden, hidden @ self.w2 + self.b2


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each padded with zeros (WIDTH at least) to whole blocks, and the number of blocks of each."""
    blocks = np.array([(len(t) + WIDTH) // BLOCK + 1 for t in texts])
    data = b"".join(t.ljust(int(n) * BLOCK, b"\0") for t, n in zip(texts, blocks))
    return np.frombuffer(data + bytes(2 * WIDTH), np.uint8), blocks


def _pairs(data: np.ndarray) -> np.ndarray:
    return data.view(">u2").astype(np.int32)


def _responses(paired: list[np.ndarray], bias: np.ndarray, pairs: np.ndarray, lo: int, hi: int, last: np.ndarray) -> np.ndarray:
    """All filters' responses in the blocks lo to hi: (blocks, places, filters).

    last: the texts' last blocks. Their last places, which begin in the padding, would reach into the next text and
    don't count.
    """
    per = BLOCK // 2
    out = np.take(paired[0], pairs[lo * per : hi * per], axis=0)
    for k in range(1, WIDTH // 2):
        out += np.take(paired[k], pairs[lo * per + k : hi * per + k], axis=0)
    out += bias
    out = out.reshape(hi - lo, per, -1)
    out[last[(last >= lo) & (last < hi)] - lo, 1 - WIDTH // 2 :] = -np.inf
    return out


def _documents(pooled: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Mean, maximum and minimum over each text's chunks (a text of one block is one chunk)."""
    ends = np.cumsum(blocks)
    begins = ends - blocks
    chunk = pooled.copy()
    chunk[:-1] = np.maximum(pooled[:-1], pooled[1:])
    last = ends - 1
    chunk[last] = np.where((blocks > 1)[:, None], chunk[np.maximum(last - 1, 0)], pooled[last])
    chunk = np.maximum(chunk, 0)
    return np.concatenate((np.add.reduceat(chunk, begins) / blocks[:, None], np.maximum.reduceat(chunk, begins), np.minimum.reduceat(chunk, begins)), axis=1)


def score(model: Model, paired: list[np.ndarray], texts: list[bytes], step: int = 512) -> np.ndarray:
    """Probabilities of label 1."""
    data, blocks = _joined(texts)
    pairs, total = _pairs(data), int(blocks.sum())
    last = np.cumsum(blocks) - 1
    pooled = np.concatenate([_responses(paired, model.bias, pairs, lo, min(total, lo + step), last).max(1) for lo in range(0, total, step)])
    return 1 / (1 + np.exp(-model.head(_documents(pooled, blocks))[1].astype(np.float64)))


def train(rows: list[tuple[bytes, int]], share: float, seed: int = 3, rounds: int = 12, batch: int = 32) -> Model:
    """Fit by Adam on (text, label) rows. share: label 1 among all labelled rows, to which the last bias is shifted."""
    rng = np.random.default_rng(seed)
    m = Model(
        rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.2, (3 * FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
        rng.normal(0, 0.2, HIDDEN).astype(np.float32), 0.0,
    )
    y_all = np.array([y for _, y in rows], np.float32)
    if len(rows) == 0 or y_all.min() == y_all.max():
        m.w2[:] = 0
        m.b2 = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return m
    values = {"tables": m.tables, "bias": m.bias, "w1": m.w1, "b1": m.b1, "w2": m.w2, "b2": np.zeros(1, np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in values.items()}
    per, t = BLOCK // 2, 0
    order_by_size = np.argsort([len(x) for x, _ in rows], kind="stable")
    batches = np.array_split(order_by_size, max(1, len(rows) // batch))
    for _ in range(rounds):
        for at in rng.permutation(len(batches)):
            some = batches[at]
            y = y_all[some]
            data, blocks = _joined([rows[i][0] for i in some])
            pairs, total = _pairs(data), int(blocks.sum())
            paired, last = m.paired(), np.cumsum(blocks) - 1
            pooled, place = np.empty((total, FILTERS), np.float32), np.empty((total, FILTERS), np.int64)
            for lo in range(0, total, 512):
                r = _responses(paired, m.bias, pairs, lo, min(total, lo + 512), last)
                place[lo : lo + 512] = r.argmax(1)
                pooled[lo : lo + 512] = np.take_along_axis(r, place[lo : lo + 512, None, :], 1)[:, 0]
            docs = _documents(pooled, blocks)
            hidden, logit = values_head(values, docs)
            error = (1 / (1 + np.exp(-logit)) - y) / len(y)
            g = {"w2": hidden.T @ error, "b2": np.array([error.sum()], np.float32)}
            back = (error[:, None] * values["w2"]) * (hidden > 0)
            g["w1"], g["b1"] = docs.T @ back, back.sum(0)
            g_pool = _back_to_blocks(back @ values["w1"].T, docs, pooled, blocks)
            where, f = np.nonzero(g_pool)
            amount = g_pool[where, f]
            g["bias"] = np.bincount(f, weights=amount, minlength=FILTERS).astype(np.float32)
            at_byte = (where * per + place[where, f]) * 2
            g["tables"] = np.stack([np.bincount(data[at_byte + k].astype(np.int64) * FILTERS + f, weights=amount, minlength=256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
            t += 1
            for k, v in values.items():
                a, b = moments[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                v -= (0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(v.dtype)
    drawn = float(y_all.mean())
    m.b2 = float(values["b2"][0] + np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return m


def values_head(values: dict[str, np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(docs @ values["w1"] + values["b1"], 0)
    return hidden, hidden @ values["w2"] + values["b2"][0]


def _back_to_blocks(g_docs: np.ndarray, docs: np.ndarray, pooled: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Gradients of the documents' mean, maximum and minimum, brought back to the block each of them came from."""
    ends = np.cumsum(blocks)
    begins = ends - blocks
    owner = np.repeat(np.arange(len(blocks)), blocks)
    right = np.minimum(np.arange(len(pooled)) + 1, ends[owner] - 1)
    left = np.where(right == np.arange(len(pooled)), np.maximum(right - 1, begins[owner]), np.arange(len(pooled)))
    chunk = np.maximum(np.maximum(pooled[left], pooled[right]), 0)
    mean, top, low = g_docs[:, :FILTERS], g_docs[:, FILTERS : 2 * FILTERS], g_docs[:, 2 * FILTERS :]
    g = (mean / blocks[:, None])[owner]
    for grad, value in ((top, docs[:, FILTERS : 2 * FILTERS]), (low, docs[:, 2 * FILTERS :])):
        hit = chunk == value[owner]
        g = g + np.where(hit, (grad / np.maximum(np.add.reduceat(hit, begins), 1))[owner], 0)
    g = g * (chunk > 0)
    out = np.zeros_like(pooled)
    from_left = pooled[left] >= pooled[right]
    np.add.at(out, left, np.where(from_left, g, 0))
    np.add.at(out, right, np.where(from_left, 0, g))
    return out


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, most_per_class: int = 800, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on about most_per_class labelled rows of each class, drawn by a hash of the id, and their whole texts.

    allowed: which ids (column `i`) may be learned from. Null labels are not used; of repeated labels, their mean counts
    (1 if half or more). Without two classes the score is the share of label 1 (a half without any label).
    """
    rows = labels.select(col(labels, id_col).cast("long").alias("i"), col(labels, label_col).cast("double").alias("y")).where("i is not null and y is not null").where(allowed)
    rows = rows.groupBy("i").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n = sum(counts.values())
    share = counts.get(1, 0) / n if n else 0.5
    draw = F.pmod(F.xxhash64("i"), F.lit(1_000_003))
    of_class = [(F.col("y") == y) & (draw < int(1_000_003 * min(1.0, most_per_class / c)) + 1) for y, c in counts.items()]
    if not of_class:
        return train([], share)
    drawn = rows.where(of_class[0] if len(of_class) == 1 else of_class[0] | of_class[1])
    texts = docs.select(col(docs, id_col).cast("long").alias("j"), text_bytes(docs, text_col).alias("t"))
    # about 2 * most_per_class rows of 12 bytes; of an id with several texts the least is read
    got = texts.join(F.broadcast(drawn), F.col("j") == F.col("i")).groupBy("i", "y").agg(F.min("t").alias("t")).collect()
    return train([(bytes(r["t"]), r["y"]) for r in sorted(got, key=lambda r: (r["i"], r["t"]))], min(max(share, 1e-3), 1 - 1e-3))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row. Null texts are empty texts, which have a score as well. Repeated rows
    give equal rows. Only the text is read; an empty table gives no rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paired = model.paired()
        for b in batches_of(it, 1):
            got = score(model, paired, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(col(docs, id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("t")).mapInArrow(run, "doc_id long, score double")
