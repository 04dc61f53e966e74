from crateflow.llm import licenses


def _brute(text):
    """Containment of each template in the best window of its class, by comparing all windows; the best of each family."""
    w = licenses.words_of(text or "")
    out, family = {}, {}
    for row in licenses.template_rows():
        want, k = set(row["shingles"]), row["width"]
        shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
        for s in range(0, len(shingles), row["step"]):
            c = len(want & set(shingles[s : s + row["window"]])) / len(want)
            if c >= 0.8 and c > out.get(row["license_id"], (0,))[0]:
                out[row["license_id"]] = (c, s)
                family[row["license_id"]] = row["family"]
    return {name: x for name, x in out.items() if x[0] == max(y[0] for n, y in out.items() if family[n] == family[name])}


def test_same_as_brute_force(spark, odd, none):
    filler = " ".join(f"word{i}" for i in range(300))
    t = licenses.TEMPLATES
    edited = t["MIT"].replace("free of charge", "at no cost").replace("merge, ", "")
    texts = [filler, filler + " " + t["MIT"], t["Apache-2.0"].upper() + filler, edited + filler, filler.replace("word150", t["GPL-3.0-or-later"]), "the license of software", t["MIT-line"], f"{t['MIT-line']} {filler} {t['CC-BY-NC-4.0-line']}", t["MIT"][:150] + filler, None, "", "all  RIGHTS reserved.", f"{filler} All rights reserved. {filler}", "all rights", t["GPL-2.0-or-later"] + filler, f"{t['AGPL-3.0-or-later']} {filler} {t['GPL-3.0-or-later']}", "// SPDX-License-Identifier: MIT", *t.values()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, {})[r.license_id] = (r.containment, r.first_word)
    want = {i: b for i, x in enumerate(texts) if (b := _brute(x))}
    assert got == want and len(want) >= 6
    assert set(got[texts.index(t["GPL-2.0-or-later"] + filler)]) == {"GPL-2.0-or-later"}
    for name, text in t.items():  # each notice is known by its own name
        assert name in got[len(texts) - len(t) + list(t).index(name)]
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_plan_has_no_python(spark, odd):
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
