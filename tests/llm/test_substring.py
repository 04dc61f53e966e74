import hashlib
import random

import pytest

from crateflow.llm import substring


def _brute(rows, window):
    """By the definition, window by window."""
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = b" ".join(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[b" ".join(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [[f"p{j}_{i % rng.choice([7, 1000])}" for i in range(rng.choice([10, 12, 13, 30, 90]))] for j in range(8)]
    rows = []
    for i in rng.sample(range(1000), 60):
        words = []
        for _ in range(rng.randrange(0, 6)):
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            words += part[a:] if rng.random() < 0.5 else part
            words += [f"u{rng.randrange(4)}" for _ in range(rng.randrange(4))]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, window=12, k=4).collect()}
    want = _brute(rows, 12)
    assert got == want and sum(v[1] for v in want.values()) > 100


def test_odd_rows(spark, odd, none):
    got = substring.remove_repeats(odd).collect()
    assert len(got) == odd.count() and substring.remove_repeats(none).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert by[0] == [(75, 0)] and by[5] == [(74, 70)] * 2 and by[None] == [(74, 0)]
    assert by[1] == by[2] == by[3] == [(0, 0)] and by[4] == [(60_000, 0)] and by[9] == [(60_000, 60_000)]


def test_cut_keeps_columns_and_white_space(spark, odd):
    got = substring.cut_repeats(odd)
    assert got.columns == odd.columns and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id != 9)
    five = [r for r in rows if r.doc_id == 5]
    assert [(r.text, r.n_chars) for r in five] == [("start here end there", 20)] * 2
    assert {r.text for r in rows if r.doc_id == 3} == {" \t\n "} and {r.text for r in rows if r.doc_id == 1} == {None}
