import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crateflow.llm import media
from crateflow.llm.common import stored


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=500))
def test_payload_survives(data):
    p = media.padded(data)
    assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(data) and not p[len(data) :].strip(b"\0")
    assert media.decode(media.encode(p)) == p


def test_damage_is_noticed():
    m = bytearray(media.encode(media.padded(b"hello")))
    m[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode(bytes(m))


def test_documents(spark, odd, none):
    got = media.documents_as_media(odd).collect()
    rows = odd.collect()
    assert len(got) == len(rows)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), hashlib.sha256(media.padded((r.text or "").encode())).hexdigest()) for r in rows)
    assert sorted((str(g.doc_id), g.n_bytes, g.payload_sha256) for g in got) == want
    for g in got:
        assert g.payload_bytes % 64 == 0 and g.caption == f"Bytes of {g.doc_id if g.doc_id is not None else '?'}"
    one = {g.doc_id: g for g in got}
    assert len({(g.page_id, g.position) for g in got}) == len(got) > len({g.page_id for g in got})
    assert one[7].feature == one[8].feature and one[7].media_sha256 == one[8].media_sha256
    assert one[7].tail_crc32 == zlib.crc32(b"one".ljust(64, b"\0"))
    assert media.documents_as_media(none).count() == 0


def test_a_page_shows_several_media_in_order(spark):
    rows = [(i, f"text {i}") for i in range(20)]
    got = media.documents_as_media(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).orderBy("page_id", "position").collect()
    assert [g.doc_id for g in got] == list(range(20)) and [g.caption for g in got] == [f"Bytes of {i}" for i in range(20)]
    for g in got:
        assert g.payload_sha256 == hashlib.sha256(media.padded(f"text {g.doc_id}".encode())).hexdigest() and g.n_bytes == len(f"text {g.doc_id}")
    page = "".join(media.figure_html(i, str(i), "0" * 64, i) for i in range(8))
    items = media.sequence_of(page)
    assert [i["name"] for i in items if i["kind"] == "media"] == [str(i) for i in range(8)] and [i["position"] for i in items] == list(range(len(items)))
    at = {i["name"]: i["position"] for i in items if i["name"]}
    for i in range(8):  # each reference follows the text that names its document
        assert str(i) in items[at[str(i)] - 1]["text"] or str(i) in items[at[str(i)] - 2]["text"]
    assert [g.position for g in got[:8]] == [1 + at[str(i)] for i in range(8)]  # after the heading


def test_interleaving_keeps_order_and_captions(spark):
    page = '<h1>T</h1><p>a <img src="sha256:aa" data-bytes="3" alt="x">b</p><figure><img src="http://e"><figcaption>cap <i>two</i></figcaption></figure><p>c</p>'
    items = media.sequence_of(page)
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [
        (0, "text", "T", None, None), (1, "text", "a", None, None), (2, "media", None, "aa", "x"), (3, "text", "b", None, None), (4, "media", None, None, "cap two"), (5, "text", "c", None, None),
    ]
    pages = stored(media.sequences(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")), "test")
    described = spark.createDataFrame([("aa", 64)], "digest string, payload_bytes long")
    got = media.resolve(pages, described).orderBy("position").collect()
    assert [(r.page_id, r.position, r.payload_bytes) for r in got] == [(1, 2, 64), (1, 4, None)]


def test_foreign_attributes():
    got = media.sequence_of('<img src="a.png" data-bytes="99999999999999999999999"><img data-bytes="-1"><img data-bytes="12">')
    assert [x["n_bytes"] for x in got] == [None, None, 12]
