import pytest

LONG = " ".join(f"w{i % 9973}" for i in range(60_000))


@pytest.fixture()
def odd(spark):
    """Null in every column, empty and blank texts, one very long, repeated rows and ids, and columns whose names clash."""
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [
        (0, "alpha beta gamma delta epsilon " + passage, "en", "s"), (1, None, "en", None), (2, "", None, "s"), (3, " \t\n ", "en", "s"), (4, LONG, None, "s"),
        (5, "start here " + passage + " end there", "en", "s"), (5, "start here " + passage + " end there", "en", "s"), (None, "no id at all " + passage, "fr", "s"),
        (6, "é ü ß 日本 😀 <|endoftext|> Ω", "de", "s"), (7, "one", "en", "s"), (8, "one", "en", "s"), (9, LONG, "en", "s"),
    ]
    clash = ["component_id", "sequence_id", "key", "t", "_doc", "score", "a.b", "fp"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in clash)
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *[i for i in range(len(clash))]) for r in rows], schema)


@pytest.fixture()
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
