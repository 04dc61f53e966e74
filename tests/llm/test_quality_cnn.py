import random

import numpy as np

from crateflow.llm import quality_cnn as Q


def _plain_score(m, text):
    """The network as described, place by place."""
    n = (len(text) + Q.WIDTH) // Q.BLOCK + 1
    x = text.ljust(n * Q.BLOCK, b"\0") + bytes(2 * Q.WIDTH)
    blocks = []
    for b in range(n):
        end = (b + 1) * Q.BLOCK - (Q.WIDTH - 2 if b == n - 1 else 0)
        places = [sum(m.tables[k, x[p + k]].astype(float) for k in range(Q.WIDTH)) + m.bias for p in range(b * Q.BLOCK, end, 2)]
        blocks.append(np.max(places, 0))
    chunks = np.maximum([np.maximum(blocks[i], blocks[i + 1]) for i in range(n - 1)] + [np.maximum(blocks[-2], blocks[-1])] if n > 1 else [blocks[0]], 0)
    doc = np.concatenate((chunks.mean(0), chunks.max(0), chunks.min(0)))
    z = np.maximum(doc @ m.w1 + m.b1, 0) @ m.w2 + m.b2
    return 1 / (1 + np.exp(-z))


def _rows(rng, n):
    out = []
    for i in range(n):
        words = [rng.choice(["meadow", "stone", "quiet", "river", "walks"]) for _ in range(rng.randrange(20, 200))]
        good = rng.random() < 0.7
        out.append((i, " ".join(words) if good else "!! ".join(words).upper(), int(good)))
    return out


def test_same_as_place_by_place():
    rng = random.Random(3)
    rows = _rows(rng, 60)
    m = Q.train([(t.encode(), y) for _, t, y in rows], 0.7, rounds=2)
    texts = [b"", b"x", "é😀".encode() * 300, rows[0][1].encode(), b"a" * 255, b"a" * 248, b"a" * 247]
    assert np.allclose(Q.score(m, m.paired(), texts, step=2), [_plain_score(m, t) for t in texts], atol=1e-4)


def test_held_out_ranking(spark):
    rows = _rows(random.Random(5), 400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    model = Q.learn(docs, labels, F.col("i") % 5 != 0)
    got = {r.doc_id: r.score for r in Q.predict(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 5 == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.99
    assert np.mean([(s >= Q.GOOD) == y for s, y in held]) > 0.95


def test_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(0, 1), (4, 0), (5, 1), (5, 1), (6, 0), (99, 1)], "doc_id long, quality int")
    model = Q.learn(odd, labels, F.lit(True))
    got = Q.predict(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id in (7, 8)}) == 1
    assert Q.predict(none, model).count() == 0
    constant = Q.learn(odd, labels.limit(0), F.lit(True))
    assert {round(r.score, 6) for r in Q.predict(odd, constant).collect()} == {0.5}
