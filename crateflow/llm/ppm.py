"""Language-model scores by prediction by partial matching (PPM) over bytes, learned from the corpus.

A text is read as its lower-case words joined by one space, after ORDER line feeds and before one, which is its end: a
line feed is in no word. Every byte is predicted in the context of the ORDER bytes before it. The trie of contexts is a table: a node is a
context with the counts of the bytes that followed it, and its parent is the context without the oldest byte. A byte that
a node has not seen escapes to the parent: each kind of byte seen there gives ESCAPE of one occurrence to that. The bytes the
node has seen are then excluded. Where nothing is left, all other byte values are equally likely.

Texts never meet the whole trie. Map tasks read documents into blocks of bounded size, each kept as one compressed value, and
give a block's lexicon: its distinct runs of ORDER + 1 bytes and its distinct words, with their counts in the documents
learned from. Runs are scored once each, by joins with the nodes, words are counted, and only what a block's own lexicon
asks for comes back to it. Words are named by their XXH64 there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from crateflow.llm.common import col, stored, text_bytes

#: Six bytes of a run and the place of a text in its batch fit a 64-bit word, so 5 is the most.
ORDER = 5
#: What each kind of byte gives to the escape. On held-out documents of sf0.01 and sf0.1, 0.3 was better than 0.4, 0.5 and method C.
ESCAPE = 0.3
#: Bytes of text in a block, and in what is sorted at once.
BLOCK, BATCH = 32 << 20, 1 << 20
#: Values a byte can have.
KINDS = 256
END = b"\n"

_PIECES = "block long, texts binary, gram long, word binary, n long"
_TEXTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("t", pa.binary())])
_KEPT = pa.schema([("block", pa.int64()), ("texts", pa.binary()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
_ZSTD = pa.Codec("zstd")


def pieces(text: bytes, order: int, most: int) -> Iterator[bytes]:
    """A text as it is predicted, in pieces of about `most` bytes that end at a word's end; each has its left context before it."""
    s = END * order + b" ".join(text.lower().split()) + END
    begin = order
    while begin < len(s):
        space = s.find(b" ", begin + most) + 1
        end = space or len(s)
        yield s[begin - order : end]
        begin = end


def grams(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of order + 1 bytes that end at the predicted bytes of each part, and the part's place."""
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    key = buffer[: len(buffer) - order].astype(np.uint64)
    for i in range(1, order + 1):
        key <<= np.uint64(8)
        key |= buffer[i : len(buffer) - order + i]
    last = np.cumsum(size)[:-1]
    whole = np.ones(len(key), bool)
    whole[(last[:, None] - np.arange(1, order + 1)).ravel()] = False
    return key[whole], np.repeat(np.arange(len(parts), dtype=np.uint64), size - order)


def _heads(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    return np.flatnonzero(np.concatenate(([len(x) > 0], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*counts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = _heads(key)
    return key[head], np.add.reduceat(n, head)


class _Block:
    """What a task gathers until a block is full."""

    def __init__(self, order: int):
        self.order = order
        self.size = 0
        self.sink = pa.BufferOutputStream()
        self.texts = pa.ipc.new_stream(self.sink, _TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.rows: list[tuple] = []
        self.waiting: dict[bool, list[bytes]] = {False: [], True: []}
        self.bytes = 0
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: Counter = Counter()
        self.other: set[bytes] = set()

    def add(self, row: int, doc_id: int | None, held: bool, part: bytes) -> None:
        self.rows.append((row, doc_id, held, part))
        words = words_of(part, self.order)
        self.other.update(words) if held else self.words.update(words)
        self.waiting[held].append(part)
        self.size += len(part)
        self.bytes += len(part)
        if self.bytes >= BATCH:
            self._put()

    def _put(self) -> None:
        self.texts.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _TEXTS)], schema=_TEXTS))
        for held in (False, True):
            if self.waiting[held]:
                key = np.sort(grams(self.waiting[held], self.order)[0])
                head = _heads(key)
                self.counts.append((key[head], np.zeros(len(head), np.int64) if held else np.diff(np.append(head, len(key)))))
                self.waiting[held] = []
        self.rows, self.bytes = [], 0
        if len(self.counts) > 8:
            self.counts = [_merged(self.counts)]

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self._put()
        self.texts.close()
        yield _batch(block, 1, texts=pa.array([self.sink.getvalue().to_pybytes()], pa.binary()))
        key, n = _merged(self.counts)
        yield _batch(block, len(key), gram=pa.array(key.astype(np.int64)), n=pa.array(n))
        words = sorted(self.words.keys() | self.other)
        for i in range(0, len(words), 100_000):
            some = words[i : i + 100_000]
            yield _batch(block, len(some), word=pa.array(some, pa.binary()), n=pa.array([self.words[w] for w in some], pa.int64()))


def words_of(part: bytes, order: int) -> list[bytes]:
    """The words of a piece, and the end if it has it."""
    words = part[order:].split()
    if part.endswith(END):
        words.append(END)
    return words


def _batch(block: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    first = pa.array(np.full(rows, block))
    return pa.RecordBatch.from_arrays([first, *(columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in list(_KEPT)[1:])], schema=_KEPT)


def _blocks(order: int, most: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        row, number, block = 0, 0, _Block(order)
        for b in it:
            for doc_id, held, text in zip(*(b.column(i) for i in range(3))):
                for part in pieces(text.as_py(), order, most):
                    block.add(task + row, doc_id.as_py(), held.as_py(), part)
                    if block.size >= most:
                        yield from block.batches(task + number)
                        number, block = number + 1, _Block(order)
                row += 1
        if block.size:
            yield from block.batches(task + number)

    return run


def _low(gram: Column, n: int) -> Column:
    """The last n bytes of a run."""
    return gram.bitwiseAND(F.lit((1 << 8 * n) - 1))


def trie(runs: DataFrame, order: int = ORDER) -> dict[int, DataFrame]:
    """The nodes of each order's contexts, from (gram, c) of all runs of order + 1 bytes that were learned from.

    node: the context; total, kinds: occurrences and kinds of bytes after it; shared: occurrences of those kinds in the
    parent, which an escape excludes; bytes: the counts by byte, 256 at most.
    """
    nodes, level = {}, runs.where("c > 0").select("gram", "c")
    for k in range(order, -1, -1):
        lower = None
        if k:
            lower = stored(level.groupBy(_low(F.col("gram"), k).alias("gram")).agg(F.sum("c").alias("c")), "ppm-level")
            seen = lower.select(F.col("gram").alias("_g"), F.col("c").alias("_c"))
            level = level.join(seen, _low(F.col("gram"), k) == F.col("_g"))
        shared = F.sum("_c") if k else F.lit(0).cast("long")
        each = F.map_from_entries(F.collect_list(F.struct(_low(F.col("gram"), 1).alias("b"), "c")))
        found = level.groupBy(F.shiftright("gram", 8).alias("node")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), shared.alias("shared"), each.alias("bytes"))
        nodes[k] = stored(found, "ppm-nodes")
        level = lower
    return nodes


def run_scores(runs: DataFrame, nodes: dict[int, DataFrame], order: int = ORDER, escape: float = ESCAPE) -> DataFrame:
    """(gram, value): log10 of the probability of each run's last byte after the others."""
    top = nodes[order].select("node", "total")
    seen = runs.where("c > 0").join(top, F.shiftright("gram", 8) == F.col("node"))
    seen = seen.select("gram", F.log10((F.col("c") - escape) / F.col("total")).alias("value"))
    rest = runs.where("c = 0").select("gram", F.lit(0.0).alias("value"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("gone_kinds"))
    for k in range(order, -1, -1):
        rest = rest.join(nodes[k], F.shiftright(_low(F.col("gram"), k + 1), 8) == F.col("node"), "left")
        n = F.try_element_at("bytes", _low(F.col("gram"), 1))
        total, kinds = F.col("total") - F.col("gone"), F.col("kinds") - F.col("gone_kinds")
        step = F.when(F.col("done") | F.col("node").isNull() | (kinds <= 0), 0.0).otherwise(F.log10(F.coalesce(n - escape, kinds * escape) / total))
        rest = rest.select(
            "gram", (F.col("value") + step).alias("value"), (F.col("done") | n.isNotNull()).alias("done"),
            F.coalesce("shared", "gone").alias("gone"), F.coalesce("kinds", "gone_kinds").alias("gone_kinds"),
        )
    equal = F.when(F.col("done"), 0.0).otherwise(-F.log10(F.lit(float(KINDS)) - F.col("gone_kinds")))
    return seen.unionByName(rest.select("gram", (F.col("value") + equal).alias("value")))


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, is_word, n, keys, values, distinct) from rows of (block, is_word, key, value, first): many rows of a block as one."""
    waiting: list[pa.RecordBatch] = []

    def given() -> pa.RecordBatch:
        block, is_word, key, value, first = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in waiting]) for i in range(5))
        waiting.clear()
        order = np.lexsort((key, is_word, block))
        block, is_word, key, value, first = (x[order] for x in (block, is_word, key, value, first))
        ends = np.append(_heads(block * 2 + is_word), len(block))
        out = []
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):
            keys = np.diff(key[a:z], prepend=np.int64(0))
            out.append((block[a], is_word[a], z - a, _ZSTD.compress(keys.tobytes(), asbytes=True), _ZSTD.compress(value[a:z].tobytes(), asbytes=True), int(first[a:z].sum())))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["block", "is_word", "n", "keys", "values", "distinct"])

    rows = 0
    for b in it:
        if b.num_rows:
            waiting.append(b)
            rows += b.num_rows
        if rows >= 1 << 19:
            yield given()
            rows = 0
    if waiting:
        yield given()


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, values = [np.empty(0, np.int64)], [np.empty(0)]
    for n, k, v in zip(*(rows.column(c).to_pylist() for c in ("n", "keys", "values"))):
        keys.append(np.cumsum(np.frombuffer(_ZSTD.decompress(k, n * 8), np.int64)))
        values.append(np.frombuffer(_ZSTD.decompress(v, n * 8), np.float64))
    key, value = np.concatenate(keys).view(np.uint64), np.concatenate(values)
    order = np.argsort(key)
    return key[order], value[order]


def _sums(order: int, smooth: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums over the pieces of one block; base_score is given without the words' common divisor."""
        is_word = right.column("is_word")
        key, value = _unpacked(right.filter(pc.invert(is_word)))
        names, counts = _unpacked(right.filter(is_word))
        of_word: dict[bytes, float] = {}
        unknown: set[bytes] = set()
        distinct, out = sum(right.column("distinct").to_pylist()), []
        for blob in left.column("texts").to_pylist():
            for batch in pa.ipc.open_stream(blob):
                texts = batch.column("t").to_pylist()
                score = np.zeros(len(texts))
                for begin in range(0, len(texts), 1 << 16):
                    gram, place = grams(texts[begin : begin + (1 << 16)], order)
                    both = np.sort(gram << np.uint64(16) | place)
                    gram, place = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
                    head = _heads(gram)
                    each = np.repeat(value[np.searchsorted(key, gram[head])], np.diff(np.append(head, len(gram))))
                    score[begin : begin + (1 << 16)] = np.bincount(place, each, min(1 << 16, len(texts) - begin))
                words = [words_of(t, order) for t in texts]
                new = list({w for ws in words for w in ws} - of_word.keys())
                count = counts[np.searchsorted(names, np.fromiter((xxh64_intdigest(w, 42) for w in new), np.uint64, len(new)))]
                of_word.update(zip(new, np.log10(count + smooth).tolist()))
                unknown.update(w for w, c in zip(new, count.tolist()) if not c)
                known = [len(ws) - sum(map(unknown.__contains__, ws)) if unknown else len(ws) for ws in words]
                base = [sum(map(of_word.__getitem__, ws)) for ws in words]
                columns = {c: batch.column(c) for c in ("row", "doc_id", "held_out")}
                out.append(pa.table({**columns, "n_tokens": pa.array(map(len, words), pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score), "distinct": pa.array([distinct] + [0] * (len(texts) - 1), pa.int64())}))
                distinct = 0
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, held_out: Column, order: int = ORDER, escape: float = ESCAPE, block_bytes: int = BLOCK, smooth: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    score is log10 of the text's probability as its lower-case words (A-Z) and an end, by the trie of the rows where held_out
    is false; base_score the same by the words' own smoothed shares. A null text is empty: its end alone is scored. A null
    held_out counts as false. Repeated rows and ids are scored each, and learned from each. An empty table gives no
    row; where nothing may be learned from, all bytes are equally likely. Other columns are not read.
    A very long text is scored in pieces; a task holds one block, or one word if that is longer.
    """
    if not 1 <= order <= 5:
        raise ValueError("order is 1 to 5")
    if not 0 < escape < 1:
        raise ValueError("escape is between 0 and 1")
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_bytes(docs, text_col).alias("t"))
    read = stored(rows.mapInArrow(_blocks(order, block_bytes), _PIECES), "ppm-blocks", "zstd")
    counts = stored(read.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("c")), "ppm-runs")
    runs = stored(run_scores(counts, trie(counts, order), order, escape), "ppm-run-scores")
    by_run = read.where("gram is not null").select("block", F.col("gram").alias("_g")).join(runs, F.col("_g") == F.col("gram"))
    by_run = by_run.select("block", F.lit(False).alias("is_word"), F.col("gram").alias("key"), "value", F.lit(False).alias("first"))
    # a word has a row in each block at most; it is counted as distinct in the first of them
    of_word = Window.partitionBy("key")
    words = read.where("word is not null").select("block", F.xxhash64("word").alias("key"), "n")
    words = words.select("block", "key", F.sum("n").over(of_word).alias("c"), F.min("block").over(of_word).alias("_first"))
    words = words.select("block", F.lit(True).alias("is_word"), "key", F.col("c").cast("double").alias("value"), ((F.col("block") == F.col("_first")) & (F.col("c") > 0)).alias("first"))
    packed = "block long, is_word boolean, n long, keys binary, values binary, distinct long"
    lexicon = by_run.mapInArrow(_packed, packed).unionByName(words.mapInArrow(_packed, packed)).withColumnRenamed("block", "at")
    texts = read.where("texts is not null").select("block", "texts")
    sums = texts.groupBy("block").cogroup(lexicon.groupBy("at")).applyInArrow(_sums(order, smooth), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, distinct long")
    sums = stored(sums, "ppm-sums")
    n = read.where("word is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    v = sums.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()["v"]
    each = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    found = sums.groupBy("row", "doc_id", "held_out").agg(*each)
    base = F.col("base_score") - F.col("n_tokens") * F.log10(F.lit(n + smooth * (v + 1)))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
