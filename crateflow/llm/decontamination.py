"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Every n-gram of a test item is a seed. One pass notes where seeds stand in the documents. Seeds that few items share are joined
to passages as a table, by document, item and diagonal. A seed that many items share (a stock phrase of the benchmark) would
join most documents with most items, so the benchmark is then a query set that meets documents in blocks: for each
document, the block's items with a seed of it are looked through at once, and only those that could score by the words it
holds become candidates. How often a seed stands in the documents doesn't matter: what an edited copy keeps may be
what all its copies keep. Each candidate is aligned with its item, word by word, so edited and paraphrased copies score as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from crateflow.llm.common import batches_of, col, stored, text_bytes

_BASE = np.uint64(0x9E3779B97F4A7C15)
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items (of different texts) that may share a seed which is joined as a table; those that share a commoner one meet in blocks.
MOST_ITEMS = 64
#: Words of a block of such items, and bytes of the documents that meet one at a time.
BLOCK_WORDS, PART_BYTES = 1 << 21, 32 << 20
#: Places of seeds in a document and in items that are put together at once.
PLACES_AT_ONCE = 1 << 20
#: Bits of the table of seeds that every task holds (128 MB at most), and bits for each seed: a foreign n-gram is taken for one
#: of 32 million seeds in 1 of 250 cases, and is sorted out when seeds are joined.
LEAST_BITS, MOST_BITS, BITS_A_SEED = 20, 30, 32
#: Words of items that are aligned with one document in one row, and cells of a step of the alignment.
WORDS_AT_ONCE, CELLS_AT_ONCE = 1 << 16, 1 << 18


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each word, A-Z lower-cased and stripped of ASCII punctuation at its ends."""
    words = [w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in text.lower().split()]
    words = [w for w in words if w]
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ (out >> np.uint64(31))) * _BASE + h[i : i + len(out)]
        return out ^ (out >> np.uint64(29))


def _bits(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a gram in a table of 2**bits."""
    with np.errstate(over="ignore"):
        again = g * np.uint64(0xBF58476D1CE4E5B9)
    return tuple((x >> np.uint64(64 - bits)).astype(np.int64) for x in (g, again ^ (again >> np.uint64(31))))


def _known(g: np.ndarray, table: np.ndarray, coarse: np.ndarray, bits: int) -> np.ndarray:
    """Places of the grams whose bits are both set; coarse: whether any of 16 neighbouring bits is."""
    at = np.flatnonzero(coarse[(g >> np.uint64(68 - bits)).view(np.int64)])
    for k in (0, 1):
        found = _bits(g[at], bits)[k]
        at = at[table[found >> 6] >> (found & 63).view(np.uint64) & np.uint64(1) == 1]
    return at


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs of word sequences, where each best local alignment ends and begins in b.

    All pairs go through the recurrence together, one word of `a` a step; gaps along b are resolved by a running
    maximum, so a step is a handful of array operations. Returns (score, first word in b, word after the last).
    """
    rows, m, n = len(a), max(map(len, a)), max(map(len, b))
    x, y = np.zeros((rows, m), np.uint64), np.ones((rows, n), np.uint64)
    for i, (p, q) in enumerate(zip(a, b)):
        x[i, : len(p)] = p
        y[i, : len(q)] = q
    have_x = np.arange(m) < np.array([len(p) for p in a])[:, None]
    have_y = np.arange(n) < np.array([len(q) for q in b])[:, None]
    place = np.arange(n + 1)
    score, origin = np.zeros((rows, n + 1), np.int64), np.broadcast_to(place, (rows, n + 1)).copy()
    best, first, last = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(m):
        same = (x[:, i : i + 1] == y) & have_x[:, i : i + 1] & have_y
        diagonal = score[:, :-1] + np.where(same, MATCH, MISMATCH)
        up = score[:, 1:] + GAP
        new, new_origin = np.zeros_like(score), np.broadcast_to(place, (rows, n + 1)).copy()
        take = diagonal >= up
        cell = np.where(take, diagonal, up)
        start = np.where(take, origin[:, :-1], origin[:, 1:])
        ok = cell > 0
        new[:, 1:] = np.where(ok, cell, 0)
        new_origin[:, 1:] = np.where(ok, start, new_origin[:, 1:])
        # a gap along b from place j to k costs k - j: the best is a running maximum of score + place
        lifted = (new - GAP * place) * (n + 2) + (n + 1 - place)
        run = np.maximum.accumulate(lifted, axis=1)
        from_at = n + 1 - run % (n + 2)
        reached = run // (n + 2) + GAP * place
        better = (reached > new) & (reached > 0)
        new_origin = np.where(better, np.take_along_axis(new_origin, from_at, 1), new_origin)
        new = np.where(better, reached, new)
        new = np.where(have_x[:, i : i + 1], new, 0)
        top = new.argmax(1)
        value = new[np.arange(rows), top]
        gain = value > best
        best, last = np.where(gain, value, best), np.where(gain, top, last)
        first = np.where(gain, new_origin[np.arange(rows), top], first)
        score, origin = new, new_origin
    return best, first, last


def _worded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as hashes of their words, and a hash of those: items of equal words are compared once."""
    for b in batches_of(it, 1):
        h = [word_hashes(t) for t in b.column(1).to_pylist()]
        same = np.array([xxh64_intdigest(x.tobytes(), 1) for x in h], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same), pa.array([x.view(np.int64) for x in h], pa.list_(pa.int64()))], ["item_id", "item", "words"])


def _all_grams(n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for item, words in zip(b.column(0).to_pylist(), b.column(1)):
                h = words.values.to_numpy().view(np.uint64)
                w = min(n, len(h))
                g = grams(h, w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), item)), pa.array(np.full(len(g), w, np.int32)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g.view(np.int64))], ["item", "w", "place", "gram"])

    return run


def _with_seeds(table, bits: int, widths: list[int]):
    """The documents that hold runs the table of seeds knows, with those runs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine = table.value
        coarse = fine.view("<u2") != 0
        for b in batches_of(it, 2):
            rows, ends, found = [], [0], []
            for r, t in enumerate(b.column(2).to_pylist()):
                hits, h = [], word_hashes(t)
                for w in widths:
                    g = grams(h, w)
                    at = _known(g, fine, coarse, bits)
                    if len(at):
                        hits.append((np.full(len(at), w, np.int32), at.astype(np.int32), g[at].view(np.int64)))
                if hits:
                    rows.append(r)
                    found += hits
                    ends.append(ends[-1] + sum(len(x[0]) for x in hits))
            if rows:
                fields = [pa.array(np.concatenate(x)) for x in zip(*found)]
                hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["w", "at", "gram"]))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows)).columns, hits], ["doc_id", "key", "t", "hits"])

    return run


def numbered(h: np.ndarray) -> np.ndarray:
    """Words with the number of their occurrence: what two of these have in common is what an alignment can match at most."""
    order = np.argsort(h, kind="stable")
    x = h[order]
    head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    nth = np.empty(len(h), np.uint64)
    nth[order] = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
    with np.errstate(over="ignore"):
        return h ^ (nth * _BASE)


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of each range, and the range each is from."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[which], which


def _best_spans(matched: np.ndarray, which: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What an alignment of each item can score at most, if the marked ones of its words match: the best span of them, in which
    every other word costs a mismatch or a gap."""
    apart = (MATCH - MISMATCH + 1) * (int(size.max()) + 1)  # sums of an item stay below those of the item before
    ends = np.cumsum(np.where(matched, MATCH, max(MISMATCH, GAP))) - which * apart
    begins = np.concatenate(([0], ends[:-1]))
    head = np.cumsum(size) - size
    begins[head[1:]] = np.cumsum(np.add.reduceat(np.where(matched, MATCH, max(MISMATCH, GAP)), head))[:-1] - which[head[1:]] * apart
    return np.maximum.reduceat(ends - np.minimum.accumulate(begins), head)


def _in_blocks(least: float):
    """Candidates among a block of items and a part of the documents: (doc_id, key, item, low, high)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        items = right.filter(pc.is_valid(right.column("words"))).combine_chunks()
        postings = right.filter(pc.is_null(right.column("words")))
        ids = items.column("item").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        words = [np.array(items.column("words")[int(i)].values, np.int64).view(np.uint64) for i in order]
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size) - size
        vocabulary, word = np.unique(np.concatenate([numbered(w) for w in words]), return_inverse=True) if words else (np.empty(0, np.uint64), None)
        gram, place = postings.column("gram").to_numpy(), postings.column("place").to_numpy()
        owner = np.searchsorted(ids, postings.column("item").to_numpy())
        order = np.argsort(gram, kind="stable")
        gram, place, owner = gram[order], place[order], owner[order]
        held, out = np.zeros(len(vocabulary), bool), []
        for d, key, t, hits in zip(*(left.column(c).to_pylist() for c in ("doc_id", "key", "t", "hits"))) if words else ():
            at = np.array([x["at"] for x in hits])
            found = np.array([x["gram"] for x in hits], np.int64)
            low, high = np.searchsorted(gram, found, "left"), np.searchsorted(gram, found, "right")
            distinct = np.unique(found)
            among = np.unique(owner[_ranges(np.searchsorted(gram, distinct, "left"), np.searchsorted(gram, distinct, "right"))[0]])
            if not len(among):
                continue
            own = numbered(word_hashes(t))
            mine = np.searchsorted(vocabulary, own)
            mine = mine[mine < len(vocabulary)]
            mine = mine[np.isin(vocabulary[mine], own)]
            held[mine] = True
            spread, which = _ranges(begin[among], begin[among] + size[among])
            best = _best_spans(held[word[spread]], which, size[among])
            held[mine] = False
            good = np.zeros(len(ids), bool)
            good[among[best >= least * MATCH * size[among] - 1e-9]] = True
            if not good.any():
                continue
            step = np.floor(np.cumsum(high - low) / PLACES_AT_ONCE)
            for s in np.unique(step):
                some = step == s
                spread, which = _ranges(low[some], high[some])
                spread, which = spread[good[owner[spread]]], which[good[owner[spread]]]
                first = at[some][which] - place[spread]
                pairs = pd.DataFrame({"item": ids[owner[spread]], "cell": first // 32, "low": first})
                pairs = pairs.groupby(["item", "cell"])["low"].agg(["min", "max"]).reset_index()
                out.append(pa.table({"doc_id": pa.array([d] * len(pairs), pa.int64()), "key": pa.array([key] * len(pairs), pa.int64()), "item": pairs["item"].to_numpy(), "low": pairs["min"].to_numpy(np.int64), "high": pairs["max"].to_numpy(np.int64)}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "key", "item", "low", "high")})

    return run


def _scored(least: float):
    """Aligns each document's candidate passages with their items, many at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 2):
            todo, found = [], []
            for d, key, t, places in zip(*(b.column(i).to_pylist() for i in range(4))):
                h = word_hashes(t)
                for p in places:
                    item = np.array(p["words"], np.int64).view(np.uint64)
                    slack = len(item) // 2 + 2
                    lo, hi = max(0, p["low"] - slack), min(len(h), p["high"] + len(item) + slack)
                    # an alignment scores MATCH times its matches at most: fewer of the item's words can't reach least
                    if np.isin(item, h[lo:hi]).sum() >= least * len(item) - 1e-9:
                        todo.append((d, key, lo, item, h[lo:hi], p["item"]))
            todo.sort(key=lambda x: len(x[4]))
            while todo:
                k = max(1, min(len(todo), CELLS_AT_ONCE // len(todo[0][4])))
                while k > 1 and k * len(todo[k - 1][4]) > CELLS_AT_ONCE:
                    k = (k + 1) // 2
                some, todo = todo[:k], todo[k:]
                score, first, last = align([x[3] for x in some], [x[4] for x in some])
                for x, s, f, e in zip(some, score.tolist(), first.tolist(), last.tolist()):
                    if s >= least * MATCH * len(x[3]):
                        found.append((x[0], x[1], x[5], x[2] + f, e - f, s / (MATCH * len(x[3]))))
            cols = zip(*found) if found else [[]] * 6
            types = [pa.int64()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "key", "item", "start", "length", "score"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, length and score of every passage that aligns with a test item.

    score: the local alignment's share of a perfect one (2 a match, -1 a mismatch or gap), least or more. start and
    length count words (as word_hashes takes them). n: words of a seed; a copy is found if it keeps one n-gram of the item
    that at most MOST_ITEMS items share, or of a commoner one the doubled run that they share. Items with fewer than n
    words are one seed of their own length. Per document and item the best passage is given, the first on a tie. Null or
    empty texts, null ids of items and an empty benchmark give nothing; rows with a null doc_id are judged too. Items that
    share an id are one item with several texts. Other columns are not read.
    """
    items, out = _passages(docs, benchmark, n, least, id_col, text_col, item_id_col, item_text_col)
    names = items.select("item_id", F.col("item").alias("_item")).distinct()
    out = out.join(names, F.col("item") == F.col("_item")).select("doc_id", "item_id", "start", "length", "score")
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "start", "length")
    return out.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def without_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no passage aligns with a test item; rows with a null id are judged too."""
    found = _passages(docs, benchmark, n, least, id_col, text_col, "item_id", "text")[1].select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).distinct()
    names = [f"__{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    own = F.xxhash64(F.coalesce(F.col(names[docs.columns.index(text_col)]), F.lit("")).cast("binary"))
    same = F.col(names[docs.columns.index(id_col)]).cast("long").eqNullSafe(F.col("__doc")) & (own == F.col("__key"))
    return rows.join(found, same, "left_anti").toDF(*docs.columns)


def seeds_of(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(items, seeds): item_id, item (one for equal words) and words; gram, w, item, place and how many items share the gram."""
    texts = benchmark.select(col(benchmark, id_col).cast("long").alias("item_id"), text_bytes(benchmark, text_col).alias("t")).where("item_id is not null")
    items = stored(texts.mapInArrow(_worded, "item_id long, item long, words array<long>").where("size(words) > 0"), "items")
    each = items.select("item", "words").dropDuplicates(["item"])
    all_of = stored(each.mapInArrow(_all_grams(n), "item long, w int, place int, gram long"), "item-grams")
    shared = all_of.groupBy(F.col("w").alias("_w"), F.col("gram").alias("_g")).agg(F.countDistinct("item").alias("shared"))
    known = all_of.join(shared, (F.col("w") == F.col("_w")) & (F.col("gram") == F.col("_g")))
    return items, stored(known.select("gram", "w", "item", "place", "shared"), "seeds")


def _passages(docs: DataFrame, benchmark: DataFrame, n: int, least: float, id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """The items, and doc_id, key (a hash of the text), item, start, length and score of all passages that score."""
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("t")).select("doc_id", F.xxhash64("t").alias("key"), "t")
    items, seeds = seeds_of(benchmark, n, item_id_col, item_text_col)
    places = candidates(rows, items, seeds, least)
    # a document's candidates in rows of a bounded number of items' words
    words = items.select(F.col("item").alias("_item"), "words").dropDuplicates(["_item"])
    asked = places[1].join(words, F.col("item") == F.col("_item"))
    so_far = F.sum(F.size("words")).over(Window.partitionBy("doc_id", "key").orderBy("item", "low").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = asked.withColumn("_chunk", F.floor(so_far / WORDS_AT_ONCE))
    asked = asked.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_chunk").agg(F.collect_list(F.struct("item", "low", "high", "words")).alias("_places"))
    joined = places[0].join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "t", "_places")
    return items, joined.mapInArrow(_scored(least), "doc_id long, key long, item long, start long, length long, score double")


def _table_of(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Which n-grams may be seeds: two bits for each, in a table that grows with the seeds up to 2**MOST_BITS bits."""
    n = seeds.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_A_SEED).bit_length()))

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(b.column(0).to_numpy().view(np.uint64), bits)))], ["b"])

    marked = seeds.select("gram").mapInArrow(places, "b long")
    # a word of the table to a row
    filled = marked.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[filled["at"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return table, bits


def candidates(rows: DataFrame, items: DataFrame, seeds: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(documents with seeds, candidates): doc_id, key and t; doc_id, key, item and where its first word would stand."""
    table, bits = _table_of(seeds)
    widths = sorted(r["w"] for r in seeds.select("w").distinct().collect())  # n at most
    shared = rows.sparkSession.sparkContext.broadcast(table)
    held = stored(rows.mapInArrow(_with_seeds(shared, bits, widths), "doc_id long, key long, t binary, hits array<struct<w:int,at:int,gram:bigint>>"), "documents-with-seeds")
    hits = held.select("doc_id", "key", F.inline("hits"))
    rare = seeds.where(F.col("shared") <= MOST_ITEMS).select(F.col("w").alias("_w"), F.col("gram").alias("_g"), "item", "place")
    met = hits.join(rare, (F.col("w") == F.col("_w")) & (F.col("gram") == F.col("_g")))
    met = met.select("doc_id", "key", "item", (F.col("at") - F.col("place")).alias("low"))
    found = met.groupBy("doc_id", "key", "item", F.floor(F.col("low") / 32).alias("_cell")).agg(F.min("low").cast("long").alias("low"), F.max("low").cast("long").alias("high"))
    found = found.select("doc_id", "key", "item", "low", "high")
    common = seeds.where(F.col("shared") > MOST_ITEMS)
    if not common.isEmpty():
        found = found.unionByName(_common(held, items, common, least))
    return held.drop("hits"), found


def _common(held: DataFrame, items: DataFrame, common: DataFrame, least: float) -> DataFrame:
    """Candidates by seeds that many items share: blocks of items against parts of the documents that hold such seeds."""
    grams_ = common.select(F.col("gram").alias("_g")).distinct()
    hits = held.select("doc_id", "key", F.inline("hits")).join(grams_, F.col("gram") == F.col("_g"))
    hits = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("at", "gram")).alias("hits"))
    texts = held.select("doc_id", "key", "t").dropDuplicates(["doc_id", "key"])
    docs = stored(texts.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "t", "hits"), "documents-in-blocks")
    own = common.select(F.col("item").alias("_item")).distinct()
    asked = items.select("item", "words").dropDuplicates(["item"]).join(own, F.col("item") == F.col("_item")).select("item", "words")
    asked = stored(asked, "items-in-blocks")
    size = docs.agg(F.coalesce(F.sum(F.length("t") + 16 * F.size("hits")), F.lit(0)).alias("docs")).crossJoin(asked.agg(F.sum(F.size("words")).alias("words"))).first()
    blocks, parts = 1 + size["words"] // BLOCK_WORDS, 1 + size["docs"] // PART_BYTES
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("words", "array<bigint>"), ("gram", "bigint"), ("place", "int"))]
    right = asked.select(block, "item", "words", *none[1:]).unionByName(common.select(block, "item", none[0], "gram", "place"))
    right = right.select("*", every(parts).alias("part"))
    left = docs.select(every(blocks).alias("_block"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).alias("_part"), "doc_id", "key", "t", "hits")
    return left.groupBy("_block", "_part").cogroup(right.groupBy("block", "part")).applyInArrow(_in_blocks(least), "doc_id long, key long, item long, low long, high long")
