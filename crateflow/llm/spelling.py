"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by errata-trie merging.

The words form a trie, held as tables: an edge is a prefix with the character after it and the number of words below. A node's
heaviest edge is its heavy one. Two words one edit apart part at one node, and one of them at least leaves it by a light
edge. So only light subtrees are merged into what is below the node, small to large, with one character changed: a word that leaves a node by a
light edge goes in with its character replaced by the heavy one, with it skipped, and with the heavy one put before it.
Where it ends on a word's end, or on that of another light word replaced at the same node, the two are one edit apart.
A word leaves at most log2(words) nodes by light edges, so that many merged copies of it are made at most.

Every pair is found once: replaced at the node where the words part; skipped or put in there too, since a
character equal to the next one is not skipped.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import batches_of, col, stored

#: One byte for each code point of Latin-1: letters stay, A to Z in lower case, all else is a space.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Multiplier of prefix hashes. A collision only makes another edge heavy, which costs time, not pairs.
_ODD = 0x9E3779B97F4A7C15
#: Distinct words a task keeps before it gives their counts.
KEPT = 200_000


def _counts(misspell: int, least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def given() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in found]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        crc = zlib.crc32
        for b in batches_of(it, 1):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                start = crc(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for w, n in own.items():
                    if len(w) < least:
                        continue
                    h = crc(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % misspell == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    found[w] += n
            if len(found) > KEPT:
                yield given()
        if found:
            yield given()

    return run


def word_counts(docs: DataFrame, misspell: int = 97, least: int = 5, often: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the Latin-1 words with at least `least` code points and `often` occurrences.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. One in `misspell` of the distinct words of a document, by a
    checksum of its id and the word, loses a code point.
    """
    rows = docs.select(col(docs, id_col).cast("string").alias("doc_id"), F.coalesce(col(docs, text_col), F.lit("")).alias("t"))
    found = rows.mapInArrow(_counts(misspell, least), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, at, node, char) for each place of each word and its end, char empty there; node is the prefix's hash."""
    for b in batches_of(it, 1, 256 << 10):
        ids, at, node, chars = [], [], [], []
        for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h, n = len(w), len(w) + 1
            code = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.uint64)
            with np.errstate(over="ignore"):
                power = np.multiply.accumulate(np.full(h, _ODD, np.uint64)) if h else code
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * power, dtype=np.uint64)))
                sums = (sums + np.arange(n, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            node.append((sums ^ (sums >> np.uint64(32))).view(np.int64))
            ids.append(np.full(n, i))
            at.append(np.arange(n, dtype=np.int32))
            chars += [*w, ""]
        if ids:
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in (ids, at, node)), pa.array(chars)], ["id", "at", "node", "char"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n, n_near): for each of (word, n) with a word one edit away, how many there are, the one of largest n
    (the smallest of equals) and its n. Words are distinct and not null.
    """
    words = stored(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-numbered")
    edges = words.select("id", "word").mapInArrow(_edges, "id long, at int, node long, char string")
    below = edges.groupBy("node", "char").agg(F.count("*").alias("size"))
    # the end of a word is a light edge: only characters can be heavy. Nodes with one edge have no light one.
    heavy = below.groupBy(F.col("node").alias("_node")).agg(F.max(F.when(F.col("char") != "", F.struct("size", "char"))).alias("h"), F.count("*").alias("edges"))
    heavy = stored(heavy.where("edges > 1 and h is not null").select("_node", F.col("h.char").alias("heavy")), "spelling-heavy")
    light = edges.join(heavy, F.col("node") == F.col("_node")).where("char != heavy")
    light = light.join(words.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"))
    light = stored(light.select("word", "n", "at", "char", "heavy"), "spelling-light")
    head, rest, whole = F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"), F.expr("substring(word, at + 1)")
    # replaced: light words that meet, and the word below the heavy edge that they meet
    replaced = light.where("char != ''").select(F.concat(head, "heavy", rest).alias("met"), "at", "word", "n")
    asked = replaced.select(F.col("met").alias("_met"), "at").distinct()
    own = asked.join(words, F.col("_met") == F.col("word")).select(F.col("word").alias("met"), "at", "word", "n")
    best = F.struct((-F.col("n")).alias("m"), "word")
    group = F.collect_list(best)  # one for each character at most
    met = replaced.unionByName(own).groupBy("met", "at").agg(F.array_sort(group).alias("g")).where("size(g) > 1")
    pick = F.when(F.col("x.word") == F.col("g")[0]["word"], F.col("g")[1]).otherwise(F.col("g")[0])
    by_place = met.select("g", F.explode("g").alias("x")).select(F.col("x.word").alias("word"), pick.alias("best"), (F.size("g") - 1).cast("long").alias("k"))
    # skipped, or with the heavy character before it: the word met is one edit away, and neither is met elsewhere
    skipped = light.where("char != ''").where(~F.expr("substring(word, at + 2, 1) = char")).select(F.concat(head, rest).alias("met"), F.col("word").alias("from"), F.col("n").alias("from_n"))
    longer = light.select(F.concat(head, "heavy", whole).alias("met"), F.col("word").alias("from"), F.col("n").alias("from_n"))
    pairs = skipped.unionByName(longer).join(words, F.col("met") == F.col("word"))
    pairs = stored(pairs.select("word", "n", "from", "from_n"), "spelling-pairs")
    one = pairs.select("word", F.struct((-F.col("from_n")).alias("m"), F.col("from").alias("word")).alias("best"))
    other = pairs.select(F.col("from").alias("word"), best.alias("best"))
    by_edit = one.unionByName(other).withColumn("k", F.lit(1).cast("long"))
    found = by_place.unionByName(by_edit).groupBy("word").agg(F.min("best").alias("best"), F.sum("k").alias("n_near"))
    return found.select("word", F.col("best.word").alias("near"), (-F.col("best.m")).alias("near_n"), "n_near")


def _roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root) of (word, form): forms followed to their end, twice as far each round. A form occurs at least twice as
    often as its word, so that chains are short.
    """
    far = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(most_rounds):
        step = far.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = far.join(step, F.col("root") == F.col("_w"), "left")
        after = stored(after.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "spelling-roots")
        far = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return far
    raise RuntimeError(f"forms still lead on after {most_rounds} rounds")


def variants(docs: DataFrame, misspell: int = 97, least: int = 5, often: int = 3, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its form is the near word of largest n, if that is at least `times`
    its own; root follows forms to the last, and is the word itself without one.

    Null and empty texts have no words; a null id is written as nothing in the checksum. Repeated rows count as often. Ties go
    to the word smaller in code-point order. Other columns are not read. An empty table gives no row. Words are whole, however
    long: merged copies of a long word are as few as those of a short one.
    """
    words = stored(word_counts(docs, misspell, least, often, id_col, text_col), "spelling-words")
    near = stored(near_words(words), "spelling-near")
    known = words.join(near.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left").drop("_w")
    good = F.col("near_n") >= F.col("n") * times
    known = known.select("word", "n", F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
    known = stored(known, "spelling-forms")
    roots = _roots(known.where("form is not null")).withColumnRenamed("word", "_w")
    out = known.join(roots, F.col("word") == F.col("_w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
