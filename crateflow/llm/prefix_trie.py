"""Conversation prefix trie by Patricia construction.

Conversations are sorted by their sequences of turns. A scan of sorted sequences meets branch, end and leaf points only,
as common prefixes of neighbours grow and shrink; counts are summed up on these points, and the turns along a compressed edge
follow from its lower point by suffix sums of the edge.

The sort is a range partitioning: each part builds the trie of its own sequences. Parts share nodes only on the common
prefix of two neighbouring parts (their spine), whose nodes are given with a key and merged by it. All sums are of a
form that can be added over parts: a node that several parts share is counted as a node in the first of them alone.
Equal conversations are one sequence with a number of members, so a hot group of copies is one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.llm.common import col, stored

#: Turns, or ids, that are put in order together: longer conversations and groups are numbered block by block.
BLOCK = 1024
#: Characters of a turn's digest in a path.
DIGEST = 32
#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, digest, words): each conversation's turns numbered from 1, in the order of turn, nulls first.

    Turns of one place are put in the order of their digests. Null roles and texts are empty. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(col(table, c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = table.select(
        col(table, conv_col).cast("long").alias("conv_id"), col(table, turn_col).cast("long").alias("turn"),
        F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    ).where("conv_id is not null")
    # a conversation is numbered in blocks of turns, so that a very long one is not put in order in one task
    rows = stored(rows.withColumn("part", F.floor(F.col("turn") / BLOCK)), "trie-turns")
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    joined = rows.withColumn("own", own).join(sizes, (F.col("conv_id") == F.col("_c")) & F.col("part").eqNullSafe(F.col("_p")))
    return stored(joined.select("conv_id", (F.col("before") + F.col("own")).cast("long").alias("depth"), "digest", "words"), "trie-turns")


def rebuilt(turns: DataFrame, base: Column, keep: Column, most: int) -> DataFrame:
    """(conv_id, depth, digest, words), depth null for a conversation without a turn: the first `keep` turns of the
    conversation `base`, then a conversation's own after its first `keep`. base and keep are of conv_id; keep is at most `most`.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("depth").alias("size"))
    heads = sizes.select("conv_id", keep.alias("keep"), base.alias("base"), "size")
    known = sizes.select(F.col("conv_id").alias("_base"), F.col("size").alias("base_size"))
    plan = stored(heads.join(known, F.col("base") == F.col("_base"), "left").select("conv_id", "keep", "base", "size", F.least("keep", F.coalesce("base_size", F.lit(0))).alias("taken")), "trie-plan")
    first = turns.where(F.col("depth") <= most).select(F.col("conv_id").alias("_base"), "depth", "digest", "words")
    taken = plan.where("taken > 0").join(first, (F.col("base") == F.col("_base")) & (F.col("depth") <= F.col("taken"))).select("conv_id", "depth", "digest", "words")
    moved = plan.select(F.col("conv_id").alias("_c"), "keep", "taken")
    own = turns.join(moved, F.col("conv_id") == F.col("_c")).where("depth > keep").select("conv_id", (F.col("depth") - F.col("keep") + F.col("taken")).alias("depth"), "digest", "words")
    none = plan.where("taken = 0 and size <= keep").select("conv_id", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("words"))
    return taken.unionByName(own).unionByName(none)


def _ends(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's ids, from their text in blocks, in order; a stream, whatever a group's size."""
    key, digest = None, None
    for b in it:
        done: list[tuple[str, str]] = []
        for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield _pairs(done)
    if key is not None:
        yield _pairs([(key, digest.hexdigest())])


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["key", "ends"])


def sequences(turns: DataFrame) -> DataFrame:
    """(path, words, n, conv_id, ends) of each distinct sequence: its turns' digests joined, the words of each turn, its
    members, the smallest, and the SHA-256 of all their ids. A path takes 32 bytes a turn.
    """
    each = F.array_sort(F.collect_list(F.when(F.col("depth").isNotNull(), F.struct("depth", "digest", "words"))))
    whole = turns.groupBy("conv_id").agg(each.alias("_t")).select("conv_id", F.array_join("_t.digest", "").alias("path"), F.col("_t.words").alias("words"))
    whole = stored(whole.select("conv_id", F.md5("path").alias("key"), "path", "words"), "trie-sequences")
    classes = whole.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    shown = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = whole.groupBy("key", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(shown.alias("ids"))
    ends = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(_ends, "key string, ends string")
    first = whole.select(F.col("conv_id").alias("_c"), "path", "words")
    met = classes.join(first, F.col("conv_id") == F.col("_c")).join(ends.withColumnRenamed("key", "_k"), F.col("key") == F.col("_k"))
    return met.select("path", "words", "n", "conv_id", "ends")


_NODES = "key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, passed long, own long, ends string"
_NAMES = [c.split()[0] for c in _NODES.split(", ")]
_NO_IDS = hashlib.sha256(b"").hexdigest()


class _Point:
    """A branch, end or leaf point on the path to the sequence just read."""

    __slots__ = ("depth", "n", "least", "children", "leaves", "passed", "own", "ends", "waiting")

    def __init__(self, depth: int):
        self.depth = depth
        self.n = self.children = self.leaves = self.passed = self.own = 0
        self.least, self.ends, self.waiting = None, None, []


class _Part:
    """The Patricia trie of one part's sorted sequences, given node by node as they are complete.

    first: how many turns of the path just read also lie on the spine to the part before, whose nodes that part counts; -1
    without one. passed sums a node's words over its members, own over the node itself: their difference is what is saved.
    """

    def __init__(self, before: str | None):
        self.first = -1 if before is None else None
        self.path, self.words = before, np.zeros(1, np.int64)
        self.stack: list[_Point] = []
        self.out: list[list] = [[] for _ in _NAMES]

    def add(self, path: str, words: np.ndarray, n: int, least: int, ends: str) -> None:
        common = _common(self.path or "", path)
        if self.first is None:
            self.first = common
        elif self.stack:
            self.close(common)
        self.path, self.words = path, np.concatenate((np.zeros(1, np.int64), np.cumsum(words, dtype=np.int64)))
        if not self.stack:
            self.stack.append(_Point(0))
        depth = len(path) // DIGEST
        if self.stack[-1].depth < depth:
            self.stack.append(_Point(depth))
        top = self.stack[-1]
        top.n, top.least, top.ends = top.n + n, least if top.least is None else min(least, top.least), ends

    def close(self, to: int, spine: int = -1) -> None:
        """Complete the points deeper than `to`; nodes of depth up to `spine` are shared with the part after."""
        while self.stack and self.stack[-1].depth > to:
            low = self.stack.pop()
            above = self.stack[-1].depth if self.stack else -1
            if above < to:
                self.stack.append(_Point(to))
            self._edge(low, self.stack[-1] if self.stack else None, spine)
        self.first = min(self.first, to)

    def _edge(self, low: _Point, above: _Point | None, spine: int) -> None:
        """The nodes from a point up to the one above it, by sums of the words along the edge from below."""
        begin, end = (above.depth if above else -1) + 1, low.depth
        shared = max(self.first, spine)
        if low.ends and not low.children and end > spine:
            low.leaves += 1
        for r in low.waiting:  # nodes under this point wait for its least member, or find it by key where parts share it
            r[1 if end <= shared else 4] = _key(self.path, end) if end <= shared else low.least
            self._put(r)
        sums = self.words
        for depth in range(end, begin - 1, -1):
            top = max(depth - 1, 0)
            passed = low.passed + low.n * int(sums[end] - sums[top])
            own = low.own + int(sums[end] - sums[min(end, max(top, self.first))])
            children, ends = (low.children, low.ends or _NO_IDS) if depth == end else (int(depth + 1 > self.first), _NO_IDS)
            row = [_key(self.path, depth) if depth <= shared else None, None, low.least, depth, None, low.n, children, low.leaves, passed, own, ends]
            if depth and depth - 1 <= shared:
                row[1] = _key(self.path, depth - 1)
            elif depth > begin:
                row[4] = low.least
            if above is None or depth > begin or row[1]:
                self._put(row)
            else:
                above.waiting.append(row)
        if above:
            above.n, above.leaves = above.n + low.n, above.leaves + low.leaves
            above.least = low.least if above.least is None else min(above.least, low.least)
            above.passed, above.own = above.passed + passed, above.own + own
            above.children += begin > self.first

    def _put(self, row: list) -> None:
        for column, v in zip(self.out, row):
            column.append(v)

    def end(self, after: str | None) -> None:
        spine = -1 if after is None else _common(self.path, after)
        self.close(-1, spine)


def _common(a: str, b: str) -> int:
    """Turns that two paths have in common from the start."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    low, high = 0, n  # low turns are equal, high are not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST] else (low, mid)
    return low


def _key(path: str, depth: int) -> str:
    return hashlib.md5(path[: depth * DIGEST].encode()).hexdigest()


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the parts in the rows: of each part the last path before it, its own in order, the first path after it."""
    part, trie = None, None

    def given(t: _Part) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 8, pa.string()]
        if t.out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(t.out, kinds)], _NAMES)
        t.out = [[] for _ in _NAMES]

    for b in it:
        for p, place, path, words, n, least, ends in zip(*(c.to_pylist() for c in b.columns)):
            if p != part:
                if trie and trie.stack:
                    trie.end(None)
                    yield from given(trie)
                part, trie = p, _Part(path if place < 0 else None)
            if place > 0:
                trie.end(path)
                yield from given(trie)
            elif not place:
                trie.add(path, np.array(words, np.int64), n, least, ends)
        if trie and len(trie.out[0]) > 10_000:
            yield from given(trie)
    if trie and trie.stack:
        trie.end(None)
        yield from given(trie)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences of (conv_id, depth, digest, words): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    The root is the empty prefix, with all conversations, those without a turn too. Without conversations there is no row. A
    very long conversation is read whole by one task, at 32 bytes a turn; its texts are not. Turns that repeat count as often.
    """
    found = sequences(turns)
    dealt = stored(found.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "trie-parts")
    # what the parts' ends are: two paths a part, in the order of parts
    ends = dealt.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    ends = ends.select("part", F.lag("high").over(Window.orderBy("part")).alias("before"), F.lead("low").over(Window.orderBy("part")).alias("after"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("words", "array<bigint>"), ("n", "long"), ("conv_id", "long"), ("ends", "string"))]
    sides = ends.where("before is not null").select("part", F.lit(-1).alias("place"), F.col("before").alias("path"), *none)
    sides = sides.unionByName(ends.where("after is not null").select("part", F.lit(1).alias("place"), F.col("after").alias("path"), *none))
    rows = dealt.select("part", F.lit(0).alias("place"), "path", "words", "n", "conv_id", "ends").unionByName(sides)
    nodes = stored(rows.repartition("part").sortWithinPartitions("part", "place", "path").mapInArrow(_scan, _NODES), "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "passed", "own")]
    no_ids = F.lit(_NO_IDS)
    spine = nodes.where("key is not null").groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *sums, F.coalesce(F.max(F.when(F.col("ends") != no_ids, F.col("ends"))), no_ids).alias("ends"))
    spine = stored(spine, "trie-spine")
    known = spine.select(F.col("key").alias("_k"), F.col("conv_id").alias("_parent"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("passed") - F.col("own")).alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    inner = nodes.where("key is null and parent_key is null").select(*out)
    under = nodes.where("key is null and parent_key is not null").drop("parent_conv_id").unionByName(spine)
    under = under.join(known, F.col("parent_key") == F.col("_k"), "left").withColumn("parent_conv_id", F.col("_parent")).select(*out)
    return inner.unionByName(under)
