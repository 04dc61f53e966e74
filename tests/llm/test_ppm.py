import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crateflow.llm import ppm, queries


def plain(learn, order):
    """log10 of the probability of a byte after a context, by counts in dictionaries."""
    counts = {}
    for t in learn:
        s = b"\n" * order + b" ".join(t.encode().lower().split()) + b"\n"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def p(context, byte):
        gone, out = set(), 1.0
        for k in range(order, -1, -1):
            seen = counts.get(context[len(context) - k :])
            if seen is None:
                continue
            left = {b: n for b, n in seen.items() if b not in gone}
            if not left:
                continue
            total = sum(left.values())
            if byte in left:
                return out * (left[byte] - 0.3) / total
            out *= 0.3 * len(left) / total
            gone |= set(seen)
        return out / (256 - len(gone))

    return p


def brute(rows, order=5, folds=10, smooth=0.1):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % folds == 0
    learn = [t or "" for d, t in rows if not held(d)]
    p = plain(learn, order)
    words = Counter(w for t in learn for w in [*t.encode().lower().split(), b"\n"])
    n, v = sum(words.values()), len(words)
    out = []
    for d, t in rows:
        ws = [*(t or "").encode().lower().split(), b"\n"]
        s = b"\n" * order + b" ".join(ws[:-1]) + b"\n"
        score = sum(math.log10(p(s[i - order : i], s[i])) for i in range(order, len(s)))
        base = sum(math.log10((words[w] + smooth) / (n + smooth * (v + 1))) for w in ws)
        out.append((d, held(d), len(ws), sum(words[w] > 0 for w in ws), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=repr)


def fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0


def some(n=60, seed=1):
    r = random.Random(seed)
    words = ["the", "then", "THERE", "été", "naïve", "日本", "x" * 30, "a", "\x00"]
    return [(i, " ".join(r.choice(words) + r.choice(["", "s", str(r.randint(0, 99))]) for _ in range(r.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 3, 5])
def test_against_plain_counts(spark, order):
    rows = some()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ppm.score(df, fold(), order)) == brute(rows, order)


def test_small_blocks_and_pieces_change_nothing(spark, monkeypatch):
    rows = some(80, 2) + [(500 + i, "word " * 3000 + "end") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ppm.score(df, fold(), block_bytes=700)) == brute(rows)


def test_probabilities_of_all_bytes_sum_to_one(spark):
    p = plain([t for _, t in some()], 3)
    for context in (b"the", b"\n\n\n", b"zzz", b"s x"):
        assert abs(sum(p(context, b) for b in range(256)) - 1) < 1e-9


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if not r.text or len(r.text) < 10_000]
    some_odd = odd.where("text is null or length(text) < 10000")
    assert got(ppm.score(some_odd, fold())) == brute(rows)
    assert ppm.score(odd, fold()).count() == odd.count()
    assert ppm.score(none, fold()).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in ppm.score(df, F.lit(True)).collect()}
    assert found[1].score == pytest.approx(-3 * math.log10(256)) and found[2].score == pytest.approx(-math.log10(256))
    assert found[1].n_known == 0 and found[1].train_tokens == 0


def test_held_out_texts_are_likelier_than_by_their_words(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op13_ppm(spark, sf).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).first()
    assert found.n > 50 and found.s > found.b
