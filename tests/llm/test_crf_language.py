import random

import numpy as np
import pytest

from crateflow.llm import crf_language as C


def _plain_posteriors(e, a, first, begins):
    """Forward and backward word by word, text by text."""
    out = np.zeros_like(e)
    for lo, hi in zip(begins, [*begins[1:], len(e)]):
        alpha, beta = np.zeros((hi - lo, e.shape[1])), np.ones((hi - lo, e.shape[1]))
        for t in range(hi - lo):
            alpha[t] = (first if t == 0 else alpha[t - 1] @ a) * e[lo + t]
            alpha[t] /= alpha[t].sum()
        for t in range(hi - lo - 2, -1, -1):
            beta[t] = a @ (e[lo + t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
        p = alpha * beta
        out[lo:hi] = p / p.sum(1, keepdims=True)
    return out


@pytest.mark.parametrize("lane", [1, 3, 16, 500])
def test_lanes_give_exact_posteriors(lane):
    rng = np.random.default_rng(lane)
    e, a, first = rng.random((137, 3)) + 0.01, rng.random((3, 3)) + 0.05, rng.random(3) + 0.1
    begins = np.array([0, 1, 2, 30, 31, 90])
    assert np.allclose(C.forward_backward(e, a, first, begins, lane), _plain_posteriors(e / e.max(1, keepdims=True), a, first, begins.tolist()))


def _texts(rng, n):
    parts = {"en": ["ing", "tion", "the", "ough", "ly"], "de": ["ung", "sch", "keit", "der", "ü"], "fr": ["eaux", "que", "é", "oi", "le"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(parts))
        out.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    return out


def test_held_out_accuracy_and_code_switching(spark):
    rows = _texts(random.Random(1), 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = C.learn(docs, docs["doc_id"] % 4 != 2)
    got = {r.doc_id: r for r in C.predict(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = spark.createDataFrame([(1, "thetion lying oughing " * 4 + "eauxque oiqueé leeaux " * 4)], "doc_id long, text string")
    spans = C.predict(mixed, model, with_spans=True).first().spans
    assert [s.lang for s in spans] == ["en", "fr"] and abs(spans[0].end - 12) <= 1


def test_every_character_of_unspaced_and_long_words_is_read():
    han = "\u4e2d\u6587" * 2500
    assert "".join(C.words_of(han)) == han and max(map(len, C.words_of(han))) <= C.RUN
    long = "".join(random.Random(3).choice("abcdefgh") for _ in range(5000))
    assert "".join(C.words_of(f"x {long} y")) == f"x{long}y"
    model = C.train([("ungsch keitder " * 30, "de"), ("eauxque oileet " * 30, "fr")])
    labeller = C.Labeller(model)
    # the middle of one long run decides, not its two ends
    (post,), (counted,) = labeller.label(["keit" + "eauxque" * 700 + "keit"])
    assert post[counted].mean(0).argmax() == model.languages.index("fr") and len(post) > 200
    spaced, joined = (labeller.label([t])[0][0].mean(0) for t in ("keitder " * 50, "keitder" * 50))
    assert spaced.argmax() == joined.argmax() == model.languages.index("de")


def test_all_languages_are_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng, rows = random.Random(8), []
    for k in range(65):
        own = [letters[k % 26] + letters[(k * 7 + j) % 26] + letters[k // 26] for j in range(4)]
        rows += [(k * 4 + j, " ".join("".join(rng.choice(own) for _ in range(2)) for _ in range(30)), f"l{k:02}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = C.learn(docs, docs["doc_id"] >= 0)
    assert len(model.languages) == 65
    got = {r.doc_id: r.lang_pred for r in C.predict(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) / len(rows) > 0.95


def test_odd_rows(spark, odd, none):
    model = C.learn(odd, odd["doc_id"] >= 0)
    assert model.languages == ["de", "en"]
    got = C.predict(odd, model).collect()
    assert len(got) == odd.count()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert C.predict(none, model).count() == 0
    nothing = C.learn(none, none["doc_id"] >= 0)
    assert {r.lang_pred for r in C.predict(odd, nothing).collect()} == {"und"}
    kept = C.keep_known(odd, model, 0.0)
    assert kept.columns == odd.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
