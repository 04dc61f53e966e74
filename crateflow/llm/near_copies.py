"""Near copies at a similarity of 0.8 over five-word shingles: SimHashes met at anchor points, compared exactly.

The SimHash of all of a text's shingles goes through the anchor-point covering of simhash.py. What links of two bits or
fewer lead to is one set, in which texts are compared exactly: equal ones by a digest, others shingle by shingle. That
gives the equal texts and the nearest copies; nothing that it has connected is asked for again.

Two bits do not reach 0.8: at that Jaccard similarity the 64-bit SimHashes differ in about nine bits (5 to 13 for nine
pairs in ten, measured), and a covering of such a radius takes more replicas than can be borne. So what the covering
leaves apart also meets by SimHashes of samples, as in MinHash banding: BANDS times, each time that of the two shingles
least in another order. Two documents that share both have the same fingerprint, with a probability of about 0.64 a time
at 0.8, so 0.9997 over BANDS times. They are compared in the same way: what is linked is at 0.8 or more exactly.

A group too large for one task is first dealt into parts with common pivots, which links the copies of one text.
Where a band's has several components after that, its members meet by their rarest shingles: two at 0.8 or more
share one of the rarest fifth of either's, in any common order of shingles. Those that share one are compared, part by
part with every other part if they are many still.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crateflow.llm.common import batches_of, col, stored, text_bytes
from crateflow.llm.components import components
from crateflow.llm.simhash import links, shingle_hashes, simhash

BANDS, SAMPLE, WORDS, LEAST = 8, 2, 5, 0.8
#: Documents that are compared in one group; a larger one is dealt into parts which all hold the same PIVOTS or so, and
#: then compared exactly where that leaves several components.
MOST, PIVOTS = 500, 100
#: Shingles of the documents of one group, counted likewise: very long texts make smaller groups.
SHINGLES = 2_000_000


def sampled(hashes: np.ndarray, bands: int = BANDS, sample: int = SAMPLE) -> np.ndarray:
    """The SimHash of the `sample` least distinct hashes in each of `bands` orders; none without hashes."""
    distinct = np.unique(hashes)
    if not len(distinct):
        return np.empty(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for b in range(bands):
            x = (distinct ^ np.uint64(0xD6E8FEB86659FD93 * (b + 1) & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            out.append(simhash(np.partition(x, min(sample, len(x)) - 1)[:sample].copy()))
    return np.array(out, np.uint64)


#: Columns of _fingerprints: band WHOLE has the SimHash of all shingles and the text's digest, the others those of samples.
MARKS, WHOLE = "id long, sha binary, band int, fp long, size long", -1


def _fingerprints(bands: int):
    def run(it):
        for b in batches_of(it, 1):
            ids, shas, fps, band, size = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = shingle_hashes(t, WORDS)
                f = sampled(h, bands)
                ids += [d] * (len(f) + 1)
                shas += [sha256(t).digest(), *[None] * len(f)]
                fps += [np.array([simhash(h)], np.uint64), f]
                band += range(WHOLE, len(f))
                size += [len(h)] * (len(f) + 1)
            f = np.concatenate(fps) if fps else np.empty(0, np.uint64)
            columns = [pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.array(band, pa.int32()), pa.array(f.view(np.int64)), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "sha", "band", "fp", "size"])

    return run


def _compare(least: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Edges that connect the group's documents as all pairs at `least` or more would."""
        pdf = pdf.drop_duplicates(["id", "t"]).sort_values(["id", "t"])
        sets = [np.unique(shingle_hashes(bytes(t), WORDS)) for t in pdf["t"]]
        ids = pdf["id"].to_numpy()[[len(s) > 0 for s in sets]]  # an id may name a text without words as well
        sets = [s for s in sets if len(s)]
        if len(sets) < 2:
            return pd.DataFrame([], columns=["a", "b"])
        size = np.array([len(s) for s in sets])
        # the owners of each shingle, one shingle after another
        _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)[np.argsort(token, kind="stable")]
        until, token = np.cumsum(held), np.split(token, np.cumsum(size)[:-1])
        label = np.arange(len(sets))
        out: list[tuple[int, int]] = []

        def link(i: int, among: np.ndarray) -> None:
            t = token[i]
            common = np.bincount(np.concatenate([owner[a:b] for a, b in zip((until[t] - held[t]).tolist(), until[t].tolist())]), minlength=len(sets))
            near = np.flatnonzero((common >= least * (size + size[i] - common)) & among)
            for c in np.unique(label[near]):
                if c != label[i]:
                    out.append((int(ids[i]), int(ids[near[label[near] == c][0]])))
                    label[label == c] = label[i]

        # first a leader after another, with all documents; when every document is in a leader's set, only those
        # outside the largest component can still miss a link to another component
        alone, done = np.ones(len(sets), bool), np.zeros(len(sets), bool)
        for i in range(len(sets)):
            if alone[i]:
                link(i, np.ones(len(sets), bool))
                done[i] = True
                alone &= label != label[i]
        while len(np.unique(label)) > 1:
            sizes = np.bincount(label, minlength=len(sets))
            todo = np.flatnonzero((label != sizes.argmax()) & ~done)
            if not len(todo):
                break
            link(todo[0], label != label[todo[0]])
            done[todo[0]] = True
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _tokens(it):
    for b in batches_of(it, 2):
        sets = [np.unique(shingle_hashes(t, WORDS)) for t in b.column(2).to_pylist()]
        ids, labels = (np.repeat(np.array(b.column(i)), [len(s) for s in sets]) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(np.concatenate(sets).view(np.int64))], ["id", "label", "token"])


def _apart(rows: DataFrame, shared: DataFrame, edges: DataFrame, least: float, most: int) -> DataFrame:
    """Sets of ids to compare, such that edges and all links within them connect the groups of shared as all pairs would.

    Two sets of shingles at least similar share one of the first |s| - ceil(least |s|) + 1 of either's, whatever the
    order; with the rarest first, few others share it. Sets of documents that edges connect are not asked for.
    """
    known = components(edges).select(F.col("node").alias("_node"), "label")
    hot = shared.where("parts > 1").select("band", "fp", "id")
    hot = stored(hot.join(known, F.col("id") == F.col("_node"), "left").select("band", "fp", "id", F.coalesce("label", "id").alias("label")), "large-groups")
    split = hot.groupBy(F.col("band").alias("_b"), F.col("fp").alias("_f")).agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
    asked = hot.join(split, (F.col("band") == F.col("_b")) & (F.col("fp") == F.col("_f")), "left_semi").select(F.col("id").alias("_id"), "label").distinct()
    texts = rows.join(asked, F.col("id") == F.col("_id")).select("id", "label", "t")
    tokens = stored(texts.mapInArrow(_tokens, "id long, label long, token long"), "large-groups-shingles")
    counts = tokens.groupBy(F.col("token").alias("_t")).agg(F.count("*").alias("df"))
    ordered = tokens.join(counts, F.col("token") == F.col("_t")).groupBy("id", "label").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("s"))
    first = F.slice("s", F.lit(1), (F.size("s") - F.ceil(F.size("s") * F.lit(least) - 1e-9) + 1).cast("int"))
    rare = ordered.select("id", "label", F.size("s").alias("size"), F.explode(first).alias("x")).where("x.df > 1")
    rare = stored(rare.select("id", "label", "size", F.col("x.token").alias("token")), "rarest-shingles")
    apart = rare.groupBy(F.col("token").alias("_t")).agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("_t")
    # parts in an order that keeps components together: those of one only need no comparison with each other. Rows are
    # numbered within slices of a token, and the slices by their counts, so that a very common token is no single task.
    met = rare.join(apart, F.col("token") == F.col("_t")).select("id", "label", "token", "size", F.pmod(F.xxhash64("label"), F.lit(64)).alias("near"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("slice"))
    met = stored(met, "met-at-tokens")
    slices = met.groupBy("token", "near", "slice").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    before = Window.partitionBy("token").orderBy("near", "slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("token")
    share = lambda n, size: F.floor(F.greatest(n / max(1, most // 2), size / (SHINGLES // 2))).cast("int")
    slices = slices.select(
        F.col("token").alias("_t"), F.col("near").alias("_n"), F.col("slice").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("size_before"),
        share(F.sum("n").over(whole) - 1, F.sum("s").over(whole)).alias("last"),
    )
    ahead = Window.partitionBy("token", "near", "slice").orderBy("label", "id").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_rows", F.count("*").over(ahead)).withColumn("_size", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    met = met.join(slices, (F.col("token") == F.col("_t")) & (F.col("near") == F.col("_n")) & (F.col("slice") == F.col("_s")))
    met = met.select("id", "label", "token", share(F.col("rows_before") + F.col("_rows"), F.col("size_before") + F.col("_size")).alias("own"), "last")
    few = met.where("last = 0").select("id", "label", "token", F.lit(0).alias("i"), F.lit(0).alias("j"))
    others = F.filter(F.sequence(F.lit(0), F.col("last")), lambda k: k != F.col("own"))
    many = met.where("last > 0").select("id", "label", "token", "own", F.explode(others).alias("other")).select("id", "label", "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = few.unionByName(many).groupBy("token", "i", "j").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.min("label").alias("low"), F.max("label").alias("high"))
    return met.where("low < high").select("ids").distinct()


def _dealt(fps: DataFrame, most: int, tag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the groups of fps (band, fp, id, size, label) that hold several labels: their sizes, their members and the sets
    of ids to compare, each with the least and largest label in it. Groups of up to `most` and SHINGLES are one set."""
    counts = fps.groupBy(F.col("band").alias("_b"), F.col("fp").alias("_f")).agg(F.count("*").alias("n"), F.sum("size").alias("_size"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
    parts = F.least(F.col("n"), F.ceil(F.greatest(F.col("n") / most, F.col("_size") / SHINGLES))).cast("int")
    counts = stored(counts.select("_b", "_f", "n", "_size", parts.alias("parts")), tag)
    shared = fps.join(counts, (F.col("band") == F.col("_b")) & (F.col("fp") == F.col("_f"))).select("band", "fp", "id", "label", "n", "_size", "parts")
    parts = F.col("parts")
    draw = F.pmod(F.xxhash64("id", "fp"), F.lit(1 << 30))
    pivot = draw < (F.least(F.lit(float(PIVOTS)) / F.col("n"), F.lit(SHINGLES / 4) / F.col("_size")) * (1 << 30))
    own = F.when(pivot & (parts > 1), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), parts).cast("int")))
    dealt = shared.select("band", "fp", "id", "label", F.explode(own).alias("part"))
    sets = dealt.groupBy("band", "fp", "part").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.min("label").alias("low"), F.max("label").alias("high"))
    # the same documents often meet in several bands: each set of them is compared once
    return counts, shared.drop("label"), sets.where("low < high").select("ids").distinct()


def groups(docs: DataFrame, least: float = LEAST, bands: int = BANDS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of the documents with an equal or near copy: the smallest id each is linked with.

    Texts whose SimHashes the anchor covering connects are one set. Equal ones in it are one class, named by their smallest
    id, and its classes are compared. Texts without a word are only equal to each other. Rows with a null id are not
    compared. Classes in different components then meet by the bands' fingerprints. Groups of up to `most` classes and
    SHINGLES shingles are compared whole. Larger ones are dealt into parts by a hash, each with the same PIVOTS or so of
    the group's own members: copies of one text meet through those. What of a band's group is in several components then
    is compared by its rarest shingles, exactly.
    """
    rows = docs.select(col(docs, id_col).cast("long").alias("id"), text_bytes(docs, text_col).alias("t")).where("id is not null")
    marks = stored(rows.mapInArrow(_fingerprints(bands), MARKS), "fingerprints")
    whole = marks.where(F.col("band") == WHOLE).drop("band")
    near = components(links(stored(whole.select("fp").distinct(), "fingerprint-kinds")))
    covered = whole.join(near, F.col("fp") == F.col("node"), "left").select("id", "sha", "size", F.coalesce("label", "fp").alias("fp"))
    covered = stored(covered, "covered")
    first = stored(covered.groupBy("fp", "sha").agg(F.min("id").alias("first")).withColumnsRenamed({"fp": "_fp", "sha": "_sha"}), "text-classes")
    member = stored(covered.join(first, (F.col("fp") == F.col("_fp")) & (F.col("sha") == F.col("_sha"))).select("id", "first", "fp", "size"), "text-members")

    def linked(sets: DataFrame) -> DataFrame:
        asked = sets.select(F.xxhash64("ids").alias("group"), F.explode("ids").alias("_id")).distinct()
        asked = stored(asked, "to-compare")
        pairs = rows.join(asked, F.col("id") == F.col("_id")).select("group", "id", "t")
        return pairs.groupBy("group").applyInPandas(_compare(least), "a long, b long")

    leaders = member.where("id = first")
    one = leaders.where("size > 0").select(F.lit(WHOLE).alias("band"), "fp", "id", "size", F.col("id").alias("label")).distinct()
    edges = stored(linked(_dealt(one, most, "covered-groups")[2]), "covered-links")
    known = components(edges)
    leaders = leaders.select("id").distinct().join(known, F.col("id") == F.col("node"), "left").select(F.col("id").alias("_id"), F.coalesce("label", "id").alias("label"))
    fps = marks.where(F.col("band") != WHOLE).join(leaders, F.col("id") == F.col("_id")).select("band", "fp", "id", "size", "label").distinct()
    counts, shared, sets = _dealt(fps, most, "band-groups")
    edges = stored(edges.unionByName(linked(sets)), "links")
    if not counts.where("parts > 1").isEmpty():
        edges = edges.unionByName(linked(_apart(rows, shared, edges, least, most)))
    found = components(edges)
    merged = member.join(found, F.col("first") == F.col("node"), "left").select(F.col("id").alias("doc_id"), F.coalesce("label", "first").alias("component_id"))
    return stored(merged.distinct(), "near-copies")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, without those that are an equal or near copy of a row that stays.

    Of each group the row with the smallest id stays, once, however often it is repeated; rows with a null id stay. An id
    that names several texts is judged text by text: each stays or goes for itself.
    """
    names = [f"__{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = docs.toDF(*names)
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("sum"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if named.groupBy("id").agg(F.min("sum").alias("low"), F.max("sum").alias("high")).where("low < high").isEmpty():
        found = groups(docs, least, id_col=id_col, text_col=text_col)
        stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("__stays")).distinct()
        known = rows.where(F.col(key).isNotNull()).join(stay, F.col(key).cast("long") == F.col("__stays"), "left_semi")
    else:
        # numbers in the order of ids, one for each text
        each = named.select("id", "sum").distinct().repartitionByRange("id", "sum").sortWithinPartitions("id", "sum")
        each = stored(each.withColumn("n", F.monotonically_increasing_id()), "texts-of-ids")
        numbers = each.select(F.col("id").alias("_id"), F.col("sum").alias("_sum"), "n")
        found = groups(named.join(numbers, (F.col("id") == F.col("_id")) & (F.col("sum") == F.col("_sum"))).select(F.col("n").alias("doc_id"), F.col("t").alias("text")), least)
        stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("__n")).distinct()
        stay = each.join(stay, F.col("n") == F.col("__n"), "left_semi").select(F.col("id").alias("__stays"), F.col("sum").alias("__sum"))
        own = F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary"))
        known = rows.where(F.col(key).isNotNull()).join(stay, (F.col(key).cast("long") == F.col("__stays")) & (own == F.col("__sum")), "left_semi")
    return known.dropDuplicates([key, text]).unionByName(rows.where(F.col(key).isNull())).toDF(*docs.columns)
