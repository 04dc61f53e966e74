import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crateflow.llm import token_files
from crateflow.llm.common import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(keys=st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_hash_is_minimal_and_perfect(keys):
    k = np.array(sorted(keys), np.uint64)
    slots = token_files.mph_slots(token_files.mph_build(k), k)
    assert sorted(slots.tolist()) == list(range(len(k)))


def test_round_trip_in_order_of_id(spark, odd, none):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    got = token_files.round_trip(odd, PATH, 2, shard_ids=1000).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in odd.collect()), key=lambda r: r[:3])
    want, at = [], 0
    for *_, text, doc in rows:
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert token_files.round_trip(none, PATH, 2).count() == 0


def test_keyed_access(spark, odd):
    path = fresh_path(spark, "test")
    token_files.write_shards(odd, PATH, 2, path, shard_ids=1000)
    shards = token_files.read_shards(spark, path)
    wanted = spark.createDataFrame([(7,), (0,), (12345,), (None,), (9,), (7,)], "doc_id long")
    plain = Tokenizer.from_file(PATH)
    text = {r.doc_id: r.text for r in odd.collect()}
    got = {r.doc_id: r.ids for r in token_files.find(shards, wanted).collect()}
    assert set(got) == {7, 0, 9}
    assert all(got[k] == plain.encode(text[k], add_special_tokens=False).ids + [2] for k in got)


def test_smallest_id_and_many_null_ids(spark):
    rows = [(-(1 << 63), "least")] + [(None, f"text {i}") for i in range(400)] + [(3, f"row {i}") for i in range(300)] + [(i, "x") for i in range(4, 90)]
    path = fresh_path(spark, "test")
    token_files.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2, path, shard_ids=200, partitions=8)
    shards = token_files.read_shards(spark, path)
    assert shards.groupBy("part").count().count() > 4  # null and repeated ids are dealt over several ranges
    got = token_files.documents_in(shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert {r.doc_id for r in token_files.find(shards, spark.createDataFrame([(-(1 << 63),), (3,), (2,)], "doc_id long")).collect()} == {-(1 << 63), 3}


def test_a_look_up_reads_one_block_a_level():
    rng = np.random.default_rng(1)
    for n in (1, 255, 256, 257, 100_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        mph = token_files.mph_build(keys)
        assert np.array_equal(np.sort(token_files.mph_slots(mph, keys)), np.arange(len(keys)))
        assert len(mph) * 8 < 6 * len(keys) + 4096
