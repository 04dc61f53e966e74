import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateflow.functions import music
from crateflow.operators import signals
from crateflow.operators import transitions as T
from crateflow.plans import signals as plans

ROWS = "transition int, step int, mix array<double>, a array<double>, b array<double>, alone_a boolean, alone_b boolean"


def test_band_gains_are_the_least_error(spark):
    rng = np.random.default_rng(8)
    n, band = 24, np.repeat([0, 1, 2], 8)
    a, b = rng.random((n, 24)) + 0.1, rng.random((n, 24)) + 0.1
    low_cut = np.where(band == 0, np.clip((12 - np.arange(n)) / 6, 0, 1)[:, None], np.clip((18 - np.arange(n)) / 12, 0, 1)[:, None])
    level = rng.random(24) + 0.5  # what a place's full level is in the mix
    mix = level * (low_cut * a + (1 - low_cut) * b)
    rows = [(1, i, mix[i].tolist(), a[i].tolist(), b[i].tolist(), i < 6, i >= 18) for i in range(n)]
    rows += [(2, i, [0.0] * 24, None, [1.0] * 24, False, False) for i in range(4)]
    got = T.band_gains(spark.createDataFrame(rows, ROWS), band.tolist(), smooth=0.1)
    got = got.withColumn("c", music.mixer_controls(F.col("gain_a"), F.col("gain_b"))).orderBy("transition", "step").collect()
    ga, gb = (np.array([r[c] for r in got[:n]]) for c in ("gain_a", "gain_b"))
    for k in range(3):
        want = low_cut[:, band == k][:, 0]
        assert np.abs(ga[:, k] ** 2 - want).max() < 0.1 and np.abs(gb[:, k] ** 2 - (1 - want)).max() < 0.1
    controls = np.array([r.c for r in got[:n]])
    assert controls[0, 0] < 0.55 and controls[-1, 0] > 0.45 and (np.diff(controls[:, 0]) > -0.06).all()
    assert controls[11, 1] == pytest.approx(10 * np.log10((1 / 6) / (7 / 12)) / 30, abs=0.02) and ((controls[:, 1:] <= 0) & (controls[:, 1:] >= -1)).all()
    assert len(got) == n + 4 and all(not any(r.gain_a) and not any(r.gain_b) for r in got[n:])


def test_gains_minimise_their_error(spark):
    """No small move of any gain gives less."""
    rng = np.random.default_rng(3)
    n, bands = 9, [0, 0, 1, 1, 2, 2]
    mix, a, b = (rng.random((n, 6)) + 0.05 for _ in range(3))
    rows = [(1, i, mix[i].tolist(), a[i].tolist(), b[i].tolist(), False, False) for i in range(n)]
    got = T.band_gains(spark.createDataFrame(rows, ROWS), bands, smooth=0.7).orderBy("step").collect()
    for k in range(3):
        x = np.array([[r.gain_a[k] ** 2 for r in got], [r.gain_b[k] ** 2 for r in got]])
        m, p, q = (v[:, 2 * k : 2 * k + 2] for v in (mix, a, b))
        w = 1 / (m + 1e-3 * (m.mean() + 1e-12))

        def cost(x, m=m, p=p, q=q, w=w):
            return (((x[0][:, None] * p + x[1][:, None] * q - m) * w) ** 2).sum() + 0.49 * (np.diff(x, axis=1) ** 2).sum()

        for i in range(2):
            for j in range(n):
                for d in (-1e-3, 1e-3):
                    y = x.copy()
                    y[i, j] = min(1.5, max(0, y[i, j] + d))
                    assert cost(y) >= cost(x) - 1e-9


def test_controls_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.random(3).tolist(), (rng.random(3) * 1.4).tolist()) for _ in range(40)] + [([0.0] * 3, [0.0] * 3), ([0.04, 0, 0], [1.0, 0.5, 1e-9])]
    df = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b]) for a, b in rows], "a array<double>, b array<double>")
    for r in df.select("a", "b", music.mixer_controls(F.col("a"), F.col("b")).alias("c")).collect():
        loud = [min(1, max(x)) for x in (r.a, r.b)]
        errors = [(min(1, math.sqrt(2) * math.cos(i / 400 * math.pi)) - loud[0]) ** 2 + (min(1, math.sqrt(2) * math.sin(i / 400 * math.pi)) - loud[1]) ** 2 for i in range(201)]
        want = [min(range(201), key=lambda i: (round(errors[i], 12), i)) / 200]
        for x, top in zip((r.a, r.b), loud):
            want += [max(-1, 20 * math.log10(min(1, max(1e-4, v / (top + 1e-6)))) / 30) if top > 0.05 else 0 for v in x]
        assert r.c == pytest.approx([*want, 0, 0], abs=1e-6)


def _tables(spark, spec):
    """Two tracks in a mix, powers of six places; spec: (transition, shift_b, beats of each)."""
    rng = np.random.default_rng(4)
    pairs, mixes, tracks, plain = [], [], [], {}
    for n, (shift, beats) in spec.items():
        power = rng.random((2, beats, 6)) + 0.1
        fade = np.clip((shift + 16 - np.arange(shift + beats)) / 8, 0, 1)
        mix = np.zeros((shift + beats, 6))
        mix[:beats] += fade[:beats, None] * power[0]
        mix[shift:] += (1 - fade[shift:, None]) * power[1]
        for k in range(2):
            for i in range(beats):
                tracks.append((10 * n + k, i, i * (0.5 + 0.1 * k) + 0.2, i // 4 - 1, i % 4, 100.0, [0.1 * k, 0.2, 0.3, i / 100], power[k, i].tolist()))
        mixes += [(n, j, mix[j].tolist()) for j in range(len(mix))]
        end_a, begin_b = shift + 14, shift + 9
        pairs.append((n, n, 10 * n, 10 * n + 1, 0, shift, 0, end_a, begin_b, shift + beats))
        plain[n] = (power, mix, shift, beats, end_a, begin_b)
    return (
        spark.createDataFrame(pairs, "transition int, mix_id int, track_a int, track_b int, shift_a int, shift_b int, begin_a int, end_a int, begin_b int, end_b int"),
        spark.createDataFrame(mixes, "mix_id int, beat int, power array<double>"),
        spark.createDataFrame(tracks, "track int, beat int, t double, bar int, place int, duration double, wave array<double>, power array<double>"), plain,
    )


def test_examples_against_a_plain_loop(spark):
    bands = [0, 0, 1, 1, 2, 2]
    *tables, plain = _tables(spark, {1: (40, 80), 2: (25, 70), 3: (60, 75)})
    rows = {r.transition: r for r in T.examples(*tables, bands, smooth=0.5, most=64).collect()}
    gains = {(r.transition, r.step): r for r in T.band_gains(T.steps(*tables), bands, 0.5).collect()}
    assert {1, 2} <= set(rows)
    for n, (power, mix, shift, beats, end_a, begin_b) in plain.items():
        low, high = max(0, begin_b - 48), min(shift + beats, end_a + 48)
        alone_a, alone_b = range(low, low + min(16, begin_b - low)), range(end_a, min(high, end_a + 16))
        heard_a, heard_b = [], []
        for j in range(low, high):
            g = gains[n, j - low]
            heard_a.append(max(g.gain_a) if j < beats else 0)
            heard_b.append(max(g.gain_b) if j >= shift else 0)
        first = next(i for i, v in enumerate(heard_b) if v > 0.1)
        begin = max(0, first - (low + first - shift) % 4)
        end = min(high - low, max(i for i, v in enumerate(heard_a) if v > 0.1) + 4)
        if end - begin < 16:
            assert n not in rows
            continue
        r = rows[n]
        assert (r.begin, r.whole, r.length) == (begin, end - begin, min(64, end - begin))
        assert r.mask == [i < r.length for i in range(64)] and len(r.x) == len(r.y) == len(r.power) == 64
        for i in range(64):
            if i >= r.length:
                assert not any(r.x[i]) and not any(r.y[i]) and not any(r.power[i])
                continue
            j = low + begin + i
            x, bands_of = [], []
            for k, beat in ((0, j), (1, j - shift)):
                if not 0 <= beat < beats:
                    x += [0.0] * 16
                    bands_of += [0.0] * 3
                    continue
                t, bar = beat * (0.5 + 0.1 * k) + 0.2, beat // 4 - 1
                x += [0.1 * k, 0.2, 0.3, beat / 100, *(float(beat % 4 == p) for p in range(4))]
                x += [f(2 * math.pi * (bar % m) / m) for m in (8, 16) for f in (math.sin, math.cos)]
                x += [t / 100, min(t / 60, 4), min((100 - t) / 60, 4), 1.0]
                alone = (alone_a, alone_b)[k]
                level = [np.median([mix[i][p] / (power[k][i - shift * k][p] + 1e-12 if 0 <= i - shift * k < beats else 1e-12) for i in alone]) for p in range(6)]
                bands_of += [sum(level[p] * power[k][beat][p] for p in (2 * b, 2 * b + 1)) for b in range(3)]
            x += [i / r.length, r.length / 128, math.log2(0.5 / 0.6)]
            assert r.x[i] == pytest.approx(x, abs=1e-9)
            assert r.power[i] == pytest.approx(bands_of + [mix[j][2 * b] + mix[j][2 * b + 1] for b in range(3)], rel=1e-9, abs=1e-9)
            assert len(r.y[i]) == 9 and 0 <= r.y[i][0] <= 1


def test_pairs_that_give_no_example(spark):
    pairs, mixes, tracks, _ = _tables(spark, {1: (40, 80)})
    far = pairs.withColumn("begin_b", F.lit(120)).withColumn("end_a", F.lit(50))
    assert T.examples(far, mixes, tracks, [0, 0, 1, 1, 2, 2]).count() == 0
    assert T.examples(pairs, mixes, tracks.where("beat < 5"), [0, 0, 1, 1, 2, 2]).count() == 0
    assert T.examples(pairs.limit(0), mixes, tracks, [0, 0, 1, 1, 2, 2]).count() == 0


def test_chains_solved_together_are_those_of_one_system_each():
    rng = np.random.default_rng(2)
    n, chains, smooth = 20, 30, 0.8
    a, b = rng.random((2, n, chains, 4))
    b[:, 3], a[:, 4], a[:9, 5], b[12:, 6] = 0, 0, 0, 0
    m = a * rng.random((n, chains, 1)) * 2.5 + b * rng.random((n, chains, 1)) * 2.5
    size = rng.integers(1, n + 1, chains)
    terms = [(x * y).sum(2) * (np.arange(n)[:, None] < size) for x, y in ((a, a), (b, b), (a, b), (a, m), (b, m))]
    got = signals.bounded_chains(tuple(terms), np.arange(1, n)[:, None] < size, smooth, 1.5)
    assert (got == 1.5).any() and (got == 0).any()
    for c, k in enumerate(size.tolist()):
        aa, bb, ab, am, bm = (t[:k, c] for t in terms)
        change = np.diff(np.eye(k), axis=0) * smooth
        h = np.block([[np.diag(aa), np.diag(ab)], [np.diag(ab), np.diag(bb)]]) + np.kron(np.eye(2), change.T @ change) + 1e-9 * np.eye(2 * k)
        assert got[:, :k, c].ravel() == pytest.approx(signals.bounded_least(h, np.concatenate((am, bm)), 1.5), abs=1e-9) and not got[:, k:, c].any()


def test_gains_of_transitions_that_batches_cut(spark):
    """Transitions of different lengths give what each gives alone, however few rows an Arrow batch holds."""
    rng = np.random.default_rng(6)
    rows = [(t, i, *(rng.random((3, 6)) + 0.05).tolist(), i < 3, i >= n - 3) for t, n in enumerate((9, 30, 1, 14, 2)) for i in range(n)]
    df, bands = spark.createDataFrame(rows, ROWS).repartition(1), [0, 0, 1, 1, 2, 2]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    try:
        spark.conf.set(key, 7)
        got = {(r.transition, r.step): r for r in T.band_gains(df, bands).collect()}
    finally:
        spark.conf.set(key, usual)
    assert len(got) == len(rows)
    for t in range(5):
        for r in T.band_gains(df.where(F.col("transition") == t), bands).collect():
            for name in ("gain_a", "gain_b", "power_a", "power_mix"):
                assert got[t, r.step][name] == pytest.approx(r[name], abs=1e-9)


def test_mixes_hold_their_tracks_as_they_fade(spark):
    sf = "/root/testdata/sf0.001"
    _, mixes, tracks = plans._mixed(spark, sf)
    want: dict = {}
    for r in tracks.collect():
        shift = r.track % 5 * 40
        fade = min(1, (r.beat + 1) / 16 if shift else 1, max(0, (60 - r.beat) / 16))
        at = r.track // 5, r.beat + shift
        want[at] = want.get(at, 0) + np.array(r.power) * fade
    got = {(r.mix_id, r.beat): r.power for r in mixes.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert plans.sig17(spark, sf).count() > 0
