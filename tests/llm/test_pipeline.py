import random
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from crateflow.llm import decontamination, oracles  # noqa: F401
from tests.llm.test_near_copies import _brute as near_groups
from tests.llm.test_substring import _brute as repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with everything in it that a stage acts on."""
    rng = random.Random(11)
    parts = {"en": ["ing", "tion", "the", "ough"], "fr": ["eaux", "que", "é", "oi"]}

    def prose(lang, n):
        return [("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(2, 6)))) for _ in range(n)]

    rows, passage, item = [], prose("en", 80), prose("en", 30)
    for i in range(80):
        lang = rng.choice(["en", "fr"])
        words = prose(lang, rng.randrange(40, 150))
        if i % 8 == 3:
            words[20:20] = passage
        if i % 10 == 5:
            words[5:5] = item
        rows.append((i, " ".join(words), lang, "s", 0))
        if i % 6 == 0:
            rows.append((500 + i, " ".join(words), lang, "s", 0))
        if i % 7 == 0:
            words[len(words) // 2] = "changed"
            rows.append((600 + i, " ".join(words), lang, "s", 0))
    rows += [(900, None, None, "s", None), (901, "", "en", None, 0), (902, "123 --- 456", "en", "s", 11)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), item


def test_every_stage_against_brute_force(spark, folder):
    path, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "substring", "decontamination", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, path)
        docs = docs.cache()
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = len(after)
        if name == "language":
            assert {i for i, _ in before} - set(after) == {900, 901, 902}
        elif name == "near_duplicates":
            groups = near_groups(before)
            assert set(after) == {i for i, g in groups.items() if i == g} and len(after) < len(before) - 15
        elif name == "substring":
            want = repeats(before, 50)
            assert {i: len(r.text.split()) for i, r in after.items()} == {i: v[0] - v[1] for i, v in want.items() if v[0] > v[1] or v[0] == 0}
            assert all(r.n_chars == len(r.text) for i, r in after.items() if want[i][1])
        elif name == "decontamination":
            held = " ".join(item)
            assert set(after) == {i for i, t in before if held not in t} and len(after) < len(before)
        if name != "packing":
            assert docs.columns == columns
    pieces = docs.collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = defaultdict(int)
    for p in pieces:
        total[p.doc_id] += p.length
    assert dict(total) == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in before}


def test_run_is_the_stages_in_order(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 10


def test_all_ten_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert "op7_substring" in __spark_entry__.oracle_sql() and "pipeline" not in __spark_entry__.oracle_sql()
