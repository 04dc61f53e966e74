import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crateflow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _check(docs, pieces, size):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(plain.encode(t or "", add_special_tokens=False).ids + [1])
    assert set(want) == set(by_doc)
    for d, copies in want.items():
        got = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[d])
        assert sum(g[1] for g in got) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for start, length, crc, total in got:
                assert start == at and total == len(copies[0])
                assert crc == zlib.crc32(np.array(copies[0][at : at + length], "<u4").tobytes())
                at += length
    return sum(p.length for p in pieces) / (size * len(by_sequence))


def test_odd_rows(spark, odd, none):
    pieces = packing.pack(odd, PATH, 1).collect()
    _check([(r.doc_id, r.text) for r in odd.collect()], pieces, 2048)
    assert packing.pack(none, PATH, 1).count() == 0


@pytest.mark.parametrize("split", [True, False])
def test_every_id_once_and_little_padding(spark, split):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["river", "Mountain", "sky,", "xyzzy"]) for _ in range(rng.choice([0, 3, 20, 60, 300])))) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    pieces = packing.pack(frame, PATH, 1, size=128, open_windows=8, split=split).collect()
    assert _check(docs, pieces, 128) > (0.985 if split else 0.9)


def test_bounded_windows_place_best_fit():
    seen = []
    w = packing.OpenWindows(10, 2, False, lambda window, offset, start, ids: seen.append((window, offset, len(ids))))
    for n in (6, 3, 4, 9, 1):
        w.place(np.zeros(n, int))
    # 6 opens 0, 3 fits it best, 4 opens 1; 9 fits nowhere: the fullest, 0, is emitted; 1 fits the new window best
    assert seen == [(0, 0, 6), (0, 6, 3), (1, 0, 4), (2, 0, 9), (2, 9, 1)]
