import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from crateflow.llm import prefix_trie, queries


def rebuild(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = children.get(p, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids)
    out = []
    for p, cs in nodes.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(seqs[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def of(spark, seqs):
    """The trie of sequences given directly."""
    rows = [(c, d + 1, role, text) for c, s in seqs.items() for d, (role, text) in enumerate(s)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.turns_of(df)
    none = spark.createDataFrame([(c, None, None, None) for c, s in seqs.items() if not s], "conv_id long, depth long, digest string, words long")
    return prefix_trie.prefix_trie(turns.unionByName(none))


def some(r, n, letters, longest):
    return {c: [("u", f"{r.choice(letters)} w" * r.randint(1, 2)) for _ in range(r.randint(0, longest))] for c in range(n)}


def test_against_all_prefixes(spark):
    for seed, (n, letters, longest) in enumerate([(300, "ab", 6), (200, "abcdefgh", 3), (60, "a", 30), (1, "a", 4), (40, "ab", 40)]):
        seqs = some(random.Random(seed), n, letters, longest)
        assert got(of(spark, seqs)) == brute(seqs), seed


def test_parts_share_spines_of_any_form(spark):
    """More parts than sequences, and chains whose ends are prefixes of the next part's first sequence."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts, seed in ((2, 1), (5, 2), (40, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seqs = some(random.Random(seed), 120, "ab", 9) | {1000 + i: [("u", "x")] * i for i in range(30)}
            seqs |= {2000 + i: [("u", "a w"), ("u", "same"), ("u", "same")] for i in range(50)}
            assert got(of(spark, seqs)) == brute(seqs)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def table(spark, tmp_path, rows):
    schema = "conv_id long, turn long, role string, text string, depth int, digest string, `a.b` int"
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_query_with_odd_rows(spark, tmp_path):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", None, ""]), r.choice(["hello there", "", None, " \t", "é ü"])) for c in [*range(0, 130), -7, -20, -33] for t in range(r.randint(1, 5))]
    rows += [(c, None, "system", "first") for c in range(0, 130, 7)] + [(None, 1, "user", "lost")] + [(41, 0, "user", "again")] * 3
    rows += [(500, t, "user", f"turn {t}") for t in range(5000)] + [(519, t, "user", f"turn {t}") for t in range(5000)]

    assert got(queries.op12_prefix_trie(spark, table(spark, tmp_path, _no_ties(rows)))) == brute(rebuild(_no_ties(rows)))


def _no_ties(rows):
    """One role and text for each conversation and turn; repeated rows stay."""
    first = {}
    return [(c, t, *first.setdefault((c, t), (role, text))) for c, t, role, text in rows]


def test_empty_table(spark, tmp_path):
    assert queries.op12_prefix_trie(spark, table(spark, tmp_path, [])).count() == 0


def test_ties_have_one_order(spark):
    rows = [(1, 5, "u", x) for x in "abc"] + [(2, 5, "u", x) for x in "cba"]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefix_trie.prefix_trie(prefix_trie.turns_of(df)).collect()
    assert len(found) == 4 and all(r.n_convs == 2 for r in found)


def test_ids_hash_in_blocks(spark):
    seqs = {c: [("u", "one")] for c in range(-1500, 4000)}
    assert got(of(spark, seqs)) == brute(seqs)


def test_words_are_counted_without_texts_in_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "u", "a b  c\td")], "conv_id long, turn long, role string, text string")
    turns = prefix_trie.turns_of(df)
    assert turns.columns == ["conv_id", "depth", "digest", "words"] and turns.agg(F.max("words")).first()[0] == 4
