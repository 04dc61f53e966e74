import random

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from crateflow.llm import simhash
from crateflow.llm.components import components


def _brute(fps):
    """Least fingerprint (as a signed long) of each component under links of two bits or fewer."""
    parent = {f: f for f in fps}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in fps:
        for b in fps:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {f: root(f) for f in fps}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("most", [2000, 0])
def test_links_connect_what_brute_force_connects(spark, most):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        center = rng.getrandbits(64)
        for _ in range(12):
            for _ in range(rng.choice((1, 1, 2, 3))):
                center ^= 1 << rng.randrange(64)
            fps.add(_signed(center))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {f: r for f, r in _brute(fps).items()}
    got = {r.node: r.label for r in components(simhash.links(frame, most)).collect()}
    assert {f: got.get(f, f) for f in fps} == want
    assert len(set(want.values())) < len(fps) - 100


def test_an_anchor_in_slices_gives_the_same_links():
    rng = random.Random(11)
    base = rng.getrandbits(64)
    fps = np.array(sorted({base} | {base ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}), np.uint64)
    at, anchor = simhash.replicas(fps)
    home = anchor.view(np.uint64) == simhash.homes(fps)[at]
    order = np.lexsort((~home, anchor))
    columns = [pa.array(anchor[order]), pa.array(fps[at][order].view(np.int64)), pa.array(home[order])]
    whole = pa.RecordBatch.from_arrays(columns, ["anchor", "fp", "home"])
    for rows in (3, 50, 1 << 17):
        edges = {e for b in simhash._links_at_anchors((whole.slice(k, 64) for k in range(0, whole.num_rows, 64)), rows) for e in zip(*(c.to_pylist() for c in b.columns))}
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in edges)
        label = {f: f for f in fps.view(np.int64).tolist()}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in edges:
            label[max(root(a), root(b))] = min(root(a), root(b))
        assert len({root(f) for f in label}) == 1


def _fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_odd_rows(spark):
    texts = [None, "", "One", "one TWO", "É é A B c", "a b c a b c a b c", " ".join(str(i % 977) for i in range(40_000)), "a b c a b c a b c", "A B c\ta\x0bb\nc a b c"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "one two", "y"), (3, "one TWO", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        assert int(by[i].fingerprint, 16) == _fingerprint(t) and len(by[i].fingerprint) == 16
    assert by[1].component_id == by[0].component_id == 0 and by[7].component_id == by[8].component_id == by[5].component_id == 5
    assert by[None].component_id == 3


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
