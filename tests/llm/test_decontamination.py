import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crateflow.llm import decontamination as D
from crateflow.llm.common import stored


def _smith_waterman(a, b):
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = max(0, score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            score[i][j] = s
            best = max(best, s)
    return best


@settings(max_examples=150, deadline=None)
@given(pairs=st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(1, 4), min_size=1, max_size=14)), min_size=1, max_size=5))
def test_alignment_scores(pairs):
    a, b = [np.array(p, np.uint64) for p, _ in pairs], [np.array(q, np.uint64) for _, q in pairs]
    score, first, last = D.align(a, b)
    for i, (p, q) in enumerate(pairs):
        assert score[i] == _smith_waterman(p, q)
        if score[i]:
            assert 0 <= first[i] < last[i] <= len(q)
            assert _smith_waterman(p, q[first[i] : last[i]]) == score[i]


def _corpus(rng, n=150):
    vocabulary = [f"v{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15, 50)))) for i in range(12)]
    docs, leaked = [], {}
    for d in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        if d % 5 == 0:
            i, text = rng.choice(items)
            part = text.split()
            for _ in range(len(part) // 8 if d % 10 == 0 else 0):
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["edited"], [part[k], "more"]])
            at = rng.randrange(len(words))
            words[at:at] = part
            leaked[d] = i
        docs.append((d, " ".join(words).upper() if d % 3 == 0 else " ".join(words)))
    return docs, items, leaked


def test_finds_exact_and_edited_copies_and_nothing_else(spark):
    docs, items, leaked = _corpus(random.Random(2))
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least=0.5).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(leaked.items())
    for r in got:  # against alignment of the whole document
        words = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in docs[r.doc_id][1].lower().split()]
        item = items[r.item_id][1].split()
        assert abs(r.score - _smith_waterman(item, words) / (2 * len(item))) < 1e-9


def test_a_leak_in_a_third_of_all_documents_is_found(spark):
    rng = random.Random(4)
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(d, (item + " " if d % 3 == 0 else "") + " ".join(f"x{rng.randrange(500)}" for _ in range(60))) for d in range(300)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(0, 300, 3))


def test_an_edited_passage_is_found_however_often_it_stands(spark):
    rng = random.Random(6)
    words = [f"q{i}" for i in range(32)]
    edited = " ".join("other" if i % 4 == 1 else w for i, w in enumerate(words))
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for copies in (5, 50, 500):
        for whole in (0, 1):  # an unedited copy makes the other n-grams rarer than those that all copies keep
            docs = [(d, (" ".join(words) if d < whole else edited if d < copies + whole else "") + " " + " ".join(f"x{rng.randrange(500)}" for _ in range(40))) for d in range(copies + 50)]
            got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, least=0.5).collect()
            assert {r.doc_id for r in got} == set(range(copies + whole))


def test_a_stock_phrase_of_items_and_documents_makes_no_pairs(spark):
    rng = random.Random(9)
    stock = "choose the best answer to the question that follows and explain".split()
    items = [(i, " ".join(stock + [f"i{i}w{k}" for k in range(6)] + stock[:4] + [f"i{i}v{k}" for k in range(5)])) for i in range(300)]
    docs = [(d, " ".join([f"x{rng.randrange(400)}" for _ in range(30)] + (items[d // 3][1].split() if d % 3 == 0 else stock) + [f"y{rng.randrange(400)}" for _ in range(20)])) for d in range(240)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    seeds = stored(D.seeds_of(items, 3)[1], "test")
    assert seeds.where(f"shared > {D.MOST_ITEMS}").select("gram").distinct().count() == 9  # the phrase has eleven words
    rows = docs.selectExpr("doc_id", "0L AS key", "CAST(text AS BINARY) AS t")
    assert D.candidates(rows, D.seeds_of(items, 3)[0], seeds, 0.5)[1].select("doc_id", "item").distinct().count() <= 240
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, items, least=0.5).collect()} == {(d, d // 3) for d in range(0, 240, 3)}


def _all_pairs(docs, items, least):
    """(doc, item) of every pair that aligns, each with each other."""
    strip = lambda t: [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in t.lower().split()]
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number) + 1) for w in strip(t)], np.uint64)
    coded = [(i, code(t)) for i, t in items]
    out = set()
    for d, t in docs:
        h = code(t)
        score = D.align([x for _, x in coded], [h] * len(coded))[0]
        out |= {(d, i) for (i, x), s in zip(coded, score.tolist()) if s >= least * 2 * len(x)}
    return out


@settings(max_examples=100, deadline=None)
@given(items=st.lists(st.lists(st.booleans(), min_size=1, max_size=12), min_size=1, max_size=6))
def test_best_spans(items):
    size = np.array([len(x) for x in items])
    got = D._best_spans(np.concatenate([np.array(x) for x in items]), np.repeat(np.arange(len(items)), size), size)
    want = [max(sum(2 if v else -1 for v in x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)) for x in items]
    assert got.tolist() == want


@pytest.mark.parametrize("n", [10, 64, 65, 200, 2000])
def test_items_that_share_half_of_their_words(spark, n):
    """All items share a phrase of ten words of twenty: a document with that and ten other words aligns with each at 0.5."""
    rng = random.Random(n)
    phrase = [f"p{k}" for k in range(10)]
    items = [(i, " ".join(phrase + [f"i{i}w{k}" for k in range(10)])) for i in range(n)]
    docs = [(0, " ".join(phrase + [f"other{k}" for k in range(10)])), (1, "nothing of it"), (2, " ".join(phrase[:8] + ["x"] * 9)), (3, items[n // 2][1])]
    docs += [(4, " ".join([*phrase[:4], "new", *phrase[4:7], "i3w0", "i3w1", "i3w2", "i3w3", "i3w4"])), (5, " ".join(rng.sample(phrase, 10)))]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least=0.5).collect()
    want = _all_pairs(docs, items, 0.5)
    assert len([x for x in want if x[0] == 0]) == n and (4, 3) in want
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_common_seeds_in_many_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 500)
    monkeypatch.setattr(D, "PART_BYTES", 2000)
    monkeypatch.setattr(D, "MOST_ITEMS", 3)
    rng = random.Random(8)
    few = [f"c{k}" for k in range(7)]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.randrange(3, 14)))) for i in range(120)]
    docs = [(d, " ".join(rng.choice([*few, "x", "y"]) for _ in range(rng.randrange(1, 30)))) for d in range(60)]
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least=0.6).collect()}
    want = _all_pairs(docs, items, 0.6)
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    sharing = {(d, i) for d, i in want if grams(docs[d][1].split()) & grams(items[i][1].split())}
    assert got <= want and sharing <= got and len(sharing) > 50  # a copy keeps an n-gram


def test_very_long_items_and_items_of_equal_words(spark):
    rng = random.Random(12)
    long = " ".join(f"z{rng.randrange(3000)}" for _ in range(4000))
    docs = [(1, "before " + long + " after"), (2, long[: len(long) // 3]), (3, "nothing here")]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, long), (2, long.upper()), (3, "other words")], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.length) for r in got) == [(1, 1, 1, 4000), (1, 2, 1, 4000)]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "shared3 shared4 shared5 shared6 shared7 shared8 shared9"), (2, None), (3, ""), (None, "shared1 shared2 shared3"), (4, "one")], "item_id long, text string")
    got = D.leaks(odd, items).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("0", 1), ("5", 1), ("7", 4), ("8", 4), ("None", 1)]
    kept = D.without_leaks(odd, items)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "9"]
    assert D.leaks(none, items).count() == 0 and D.leaks(odd, items.limit(0)).count() == 0
    assert D.without_leaks(odd, items.limit(0)).count() == odd.count()
