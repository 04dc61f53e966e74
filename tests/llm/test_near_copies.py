import random
from itertools import combinations

from crateflow.llm import near_copies as N
from crateflow.llm import simhash


def _shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(rows, least=0.8):
    parent = {i: i for i, _ in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = {i: _shingles(t) for i, t in rows}
    text = dict(rows)
    for (i, a), (j, b) in combinations(sets.items(), 2):
        if (text[i] or "") == (text[j] or "") or (a and b and len(a & b) >= least * len(a | b)):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i, _ in rows}


def _corpus(rng):
    rows, n = [], 0
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 20])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows


def test_same_groups_as_brute_force(spark):
    rows = _corpus(random.Random(7)) + [(1000, None), (1001, ""), (1002, "short one"), (1003, "short one")]
    got = {r.doc_id: r.component_id for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _brute(rows)
    assert got == want and len(set(want.values())) < len(want) - 20


def test_a_large_group_is_dealt_out_and_still_found(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(400)] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = {r.component_id for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string"), most=60).collect()}
    assert got == {0}


def test_distinct_pairs_in_one_boilerplate_group(spark, monkeypatch):
    """Pairs at 0.82 whose shingles are mostly those that all texts share: many meet only in groups of all."""
    monkeypatch.setattr(N, "PIVOTS", 2)
    shared = [f"b{i}" for i in range(79)]
    rows = []
    for p in range(80):
        both = [f"p{p}.{i}" for i in range(15)]
        for k in range(2):
            rows.append((len(rows), " ".join([*shared, *both, *(f"o{p}.{k}.{i}" for i in range(10))])))
    for p in range(20):  # at 0.79 with each other, and the rarest fifth of their shingles reaches those of all
        own = [f"s{p}.{i}" for i in range(11)]
        rows += [(len(rows) + k, " ".join([*shared, *own[: 11 - k]])) for k in range(1 + p % 2)]
    want = _brute(rows)
    assert len(set(want.values())) == 100
    got = {r.doc_id: r.component_id for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string"), most=8).collect()}
    assert got == want


def test_chains_and_long_texts_in_a_large_group(spark, monkeypatch):
    """Near copies that form long chains, in groups too large by rows and too large by shingles, as brute force has them."""
    rng = random.Random(21)
    for most, shingles in ((40, 2_000_000), (500, 3_000)):
        monkeypatch.setattr(N, "SHINGLES", shingles)
        monkeypatch.setattr(N, "PIVOTS", 4)
        shared = [f"b{i}" for i in range(90)]
        rows = []
        for c in range(6):  # a chain: each text has one new word more than the one before
            own = [f"c{c}.{i}" for i in range(25)]
            for k in range(30):
                rows.append((len(rows), " ".join([*shared, *own[: 22 - k // 2], *(f"n{c}.{i}" for i in range(k))])))
        rng.shuffle(rows)
        got = {r.doc_id: r.component_id for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
        assert got == _brute(rows)


def test_planted_near_copies_are_found(spark):
    """Of pairs at 0.8 and more by exact comparison, all but a few in ten thousand: here every one."""
    rng, rows, pairs = random.Random(33), [], []
    for _ in range(250):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        v = list(w)
        for _ in range(rng.randrange(1, max(2, len(w) // 45))):
            v[rng.randrange(len(v))] = f"e{rng.randrange(9999)}"
        a, b = _shingles(" ".join(w)), _shingles(" ".join(v))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    got = {r.doc_id: r.component_id for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 150 and all(got[a] == got[b] for a, b in pairs)


def test_odd_rows(spark, odd, none):
    kept = N.keep_first(odd)
    assert kept.columns == odd.columns and kept.schema.simpleString() == odd.schema.simpleString()
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "3", "4", "6", "7", "None"]  # 5 shares 0.88 with 0
    assert N.keep_first(none).count() == 0


def test_an_id_of_several_texts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["more"])), (2, ""), (1, None), (2, "w1 w2")]
    got = {(r.doc_id, r.component_id) for r in N.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1)}


def test_texts_of_one_id_stay_or_go_for_themselves(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["more"])), (2, "another text of its own entirely here"), (2, None), (3, "another text of its own entirely here"), (1, " ".join(words)), (None, "x")]
    got = N.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)[:7]) for r in got) == [("1", "w0 w1 w"), ("2", "None"), ("2", "another"), ("None", "x")]


def _fingerprint(text):
    return simhash.simhash(simhash.shingle_hashes(text.encode(), N.WORDS))


def test_the_anchor_covering_alone_finds_copies_within_two_bits(spark):
    """Without a band, equal texts and those at two bits or fewer are still found; an equal fingerprint alone links nothing."""
    rng, rows, near, far = random.Random(17), [], [], []
    for _ in range(60):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(800, 3000))]
        v = list(w)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            v[rng.randrange(len(v))] = f"e{rng.randrange(9999)}"
        n = len(rows)
        rows += [(n, " ".join(w)), (n + 1, " ".join(v))]
        bits = (_fingerprint(rows[n][1]) ^ _fingerprint(rows[n + 1][1])).bit_count()
        (near if bits <= 2 else far).append((n, n + 1))
    alike = [(len(rows) + i, " ".join(["x"] * 400 + [f"a{i}.{k}" for k in range(20)])) for i in range(30)]
    assert len({_fingerprint(t) for _, t in alike}) == 1 and len(near) > 30 and far
    for most in (500, 8):
        frame = spark.createDataFrame(rows + alike, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in N.groups(frame, bands=0, most=most).collect()}
        assert all(got[a] == got[b] == a for a, b in near) and all(got[b] == b for _, b in far)
        assert all(got[i] == i for i, _ in alike)
        assert {r.doc_id: r.component_id for r in N.groups(frame, most=most).collect()} == _brute(rows + alike)


def test_what_the_covering_has_connected_is_not_compared_again(spark):
    rows = [(0, 5, 1, 9, 1), (0, 5, 2, 9, 1), (0, 6, 3, 9, 3), (0, 6, 4, 9, 4), (0, 6, 5, 9, 3), (1, 6, 1, 9, 1)]
    _, shared, sets = N._dealt(spark.createDataFrame(rows, "band int, fp long, id long, size long, label long"), 500, "test-groups")
    assert [r.ids for r in sets.collect()] == [[3, 4, 5]] and sorted(r.id for r in shared.collect()) == [3, 4, 5]
