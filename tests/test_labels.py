import numpy as np
import pytest

from crateflow.operators import labels as L


def test_beat_labels(spark):
    t = 0.2 + np.arange(80) * 0.5
    off = t.copy()
    off[[20, 21, 40]] += 0.1  # two in a row are masked, one alone isn't
    mixed = np.concatenate((t[1:40:4], t[42::4] + 0.02))  # bars change in the middle: as detected, on the grid
    drift = 0.2 + np.arange(80) * 0.5 + 0.001 * np.arange(80) ** 2
    given = {"clean": (t, t[1::4]), "off": (np.delete(off, [60, 61, 62]), t[1::4]), "mixed": (t, mixed), "free": (drift, drift[::4]), "short": (t[:29], t[:1]), "none": (t, [])}
    rows = [(k, [float(x) for x in a], [float(x) for x in b]) for k, (a, b) in given.items()]
    labels = L.beat_labels(spark.createDataFrame(rows, "series string, beats array<double>, down array<double>"))
    got = {r.series: r for r in labels.collect()}
    assert got.keys() == {"clean", "off", "mixed", "free", "none"}
    clean = got["clean"]
    assert clean.kind == "grid" and clean.bpm == pytest.approx(120) and np.allclose(clean.beats, t) and np.allclose(clean.down, t[1::4])
    assert not clean.mask and not clean.gaps and clean.steady
    assert np.allclose(got["off"].mask, [[off[20] - 0.5, off[21] + 0.5]], atol=1e-3) and np.allclose(got["off"].gaps, [[t[59] + 0.25, t[63] - 0.25]], atol=1e-3)
    assert np.allclose(got["off"].beats, t, atol=1e-3)
    assert not got["mixed"].steady and np.allclose(got["mixed"].down, np.concatenate((t[1:40:4], t[42::4])), atol=1e-3)
    assert got["free"].kind == "free" and np.array_equal(got["free"].beats, drift) and got["none"].kind == "grid" and not got["none"].down

    def agree(series, *teachers):
        rows = [(series, i, [float(x) for x in d]) for i, d in enumerate(teachers)]
        found = L.teachers_agree(labels.where(f"series = '{series}'"), spark.createDataFrame(rows, "series string, teacher int, down array<double>"))
        return [r.agree for r in found.collect()] == [True]

    assert agree("clean", t[1::4], t[1:60:4]) and not agree("clean", t[1::4], t[2::4]) and not agree("clean", [])
    assert not agree("mixed", t[1::4]) and agree("mixed") and agree("free", drift[::4]) and not agree("free", drift[1::4]) and not agree("none", t[1::4])
