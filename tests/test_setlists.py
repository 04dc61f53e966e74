from crateflow.operators import setlists as L

TEXTS = [
    '{"tracks": [{"artist": 3, "title": true, "at": 4.5}, 7, "x", null, [1], {"title": {"a": 1}}, {"titolo": null, "name": "n", "cue": "1:02:03"}, {"title": "", "brano": "b"}]}',
    '{"tracks": {"title": "x"}, "brani": [{"brano": "y", "inizio": "2:00"}]}', '[{"title": "top"}]', "nothing", None, '{"tracks": [], "songs": [{"title": "z"}]}',
]


def test_odd_entries_by_one_reading_of_each_list(spark):
    got = L.entries(spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string"), "t", ("k",))
    nothing = (None, None, None, "no title")
    want = [("3", "true", 4.5, ""), nothing, nothing, nothing, nothing, (None, '{"a":1}', None, ""), (None, "n", 3723.0, ""), (None, "b", None, "")]
    assert [tuple(r) for r in got.orderBy("k", "pos").collect()] == [(0, i, *w) for i, w in enumerate(want)] + [(1, 0, None, "y", 120.0, "")]
    # a reading of the variant for each name of a list, none for each field of each entry
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") + plan.count("variantget") <= 2 * len(L.ALIASES["entries"])
