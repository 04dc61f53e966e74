import random

import pytest

from crateflow.operators import calibration as C


def plain(frames, beats, reference, shifts):
    """Peaks picked anew at each shift."""
    out = {}
    for s in shifts:
        fs = []
        for k, refs in reference.items():
            x = [v + s for _, v in frames.get(k, [])]
            t = [a for a, _ in frames.get(k, [])]
            top = [i for i in range(len(x)) if x[i] > 0 and x[i] == max(x[max(0, i - 3) : i + 4])]
            groups = []
            for i in top:
                if groups and i - groups[-1][-1] == 1:
                    groups[-1].append(i)
                else:
                    groups.append([i])
            at = [sum(t[i] for i in g) / len(g) for g in groups]
            events = {min(beats[k], key=lambda b: (round(abs(b - a), 9), b)) for a in at} if beats.get(k) else set()
            events = sorted(b for b in events if b >= 5)
            refs = [r for r in refs if r >= 5]
            used, hit = set(), 0
            for r in refs:
                near = [b for b in events if abs(b - r) <= 0.07 and b not in used]
                if near:
                    used.add(near[0])
                    hit += 1
            fs.append(1.0 if not refs and not events else 2 * hit / (len(refs) + len(events)))
        out[s] = sum(fs) / len(fs)
    return out


def test_sweep_equals_picking_anew(spark):
    r = random.Random(4)
    shifts = [k / 4 - 2 for k in range(17)]
    frames, beats, refs = {}, {}, {}
    for k in range(7):
        frames[k] = [(i * 0.11, r.choice([r.uniform(-3, 3), r.uniform(-2, 2), 0.5])) for i in range(r.randint(0, 300))]
        beats[k] = [i * 0.37 + 0.01 for i in range(r.randint(0, 90))]
        refs[k] = [b + r.uniform(-0.1, 0.1) for b in beats[k][k % 4 :: 4]] or [1.0]
    refs[6] = [2.0]
    del beats[5]
    make = lambda d, f: [f(k, i, x) for k, xs in d.items() for i, x in enumerate(xs)]
    fr = spark.createDataFrame(make(frames, lambda k, i, x: (k, i, x[0], x[1])), "series int, idx int, t double, score double")
    be = spark.createDataFrame(make(beats, lambda k, i, x: (k, x)), "series int, t double")
    re = spark.createDataFrame(make(refs, lambda k, i, x: (k, x)), "series int, t double")
    got = {x["shift"]: x.score for x in C.agreement_by_shift(C.peaks(fr), be, re, shifts).collect()}
    want = plain(frames, beats, refs, shifts)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in shifts) and len(set(want.values())) > 3


@pytest.mark.parametrize("rows, want", [([(-1.0, 0.7), (0.0, 0.5), (0.5, 0.7)], (0.5, 0.7)), ([(-1.0, 0.505), (0.0, 0.5)], (0.0, 0.5)), ([(0.0, 0.5), (1.0, 0.51)], (1.0, 0.51))])
def test_what_is_chosen(spark, rows, want):
    assert tuple(C.chosen(spark.createDataFrame(rows, "shift double, score double")).first()) == want
