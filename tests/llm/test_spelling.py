import re
import zlib

import pytest

from crateflow.llm import spelling
from tests.llm.conftest import LONG


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, misspell=97, least=5, often=3, times=2):
    count = {}
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % misspell == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                count[w] = count.get(w, 0) + 1
    count = {w: n for w, n in count.items() if n >= often}
    form, near = {}, {}
    for w, n in count.items():
        near[w] = [u for u in count if one_edit(u, w)]
        best = min(near[w], key=lambda u: (-count[u], u), default=None)
        form[w] = best if best and count[best] >= times * n else None
    out = set()
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), count.get(form[w])))
    return out


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_all_pairs(spark):
    import random

    r = random.Random(3)
    base = ["".join(r.choice("abé") for _ in range(r.randint(4, 8))) for _ in range(150)]
    rows = [(i, " ".join(r.choice(base) + r.choice(["", "", "-", "×", "1", " Z"]) for _ in range(60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for misspell, least, often in ((97, 5, 3), (3, 2, 1), (7, 1, 2)):
        want = brute(rows, misspell, least, often)
        assert len(want) > 50 and any(w[1] for w in want)
        assert got(spelling.variants(df, misspell, least, often)) == want


def test_runs_of_one_letter_and_ends(spark):
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "aaaaba", "baaaaa", "abaaaa", "aaaaaé", "éaaaaa", "aaaaÉ", "aaaaaÿ"]
    rows = [(i, " ".join([w] * (i + 3))) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.variants(df, misspell=10**9)) == brute(rows, misspell=10**9)


def test_chains_lead_to_their_root(spark):
    chain = ["abcdef" + "x" * i for i in range(7)]
    rows = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(chain)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), misspell=10**9).collect()}
    assert all(found[w].root == chain[-1] for w in chain) and found[chain[-1]].form is None and found[chain[0]].n_near == 1


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(spelling.variants(odd, least=1, often=1)) == brute(rows, least=1, often=1)
    assert spelling.variants(none).count() == 0


def test_very_long_words(spark):
    word = "ab" * 20_000
    rows = [(i, t) for i, t in enumerate([word] * 6 + [word[:-1]] * 3 + [word[:777] + "z" + word[778:]] * 3 + [LONG])]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), misspell=10**9).collect()}
    assert len(found) == 3 and found[word].n_near == 2 and found[word[:-1]].form == word


def test_few_copies_of_a_word_are_merged(spark):
    """A word leaves at most log2(words) nodes by a light edge."""
    import math
    import random

    r = random.Random(5)
    words = sorted({"".join(r.choice("abcd") for _ in range(9)) for _ in range(3000)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long").selectExpr("monotonically_increasing_id() id", "word", "n")
    edges = df.select("id", "word").mapInArrow(spelling._edges, "id long, at int, node long, char string").toPandas()
    size = edges.groupby(["node", "char"]).size().reset_index(name="n")
    heavy = size[size.char != ""].sort_values(["n", "char"]).groupby("node").last()["char"]
    light = edges[edges.char != edges.node.map(heavy)]
    assert light.groupby("id").size().max() <= math.log2(len(words)) + 1


@pytest.mark.parametrize("text", ["×÷", "123", "é", "a\x00b"])
def test_what_is_a_letter(spark, text):
    rows = [(1, text), (2, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.variants(df, least=1, often=1)) == brute(rows, least=1, often=1)
