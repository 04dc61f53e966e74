import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crateflow.llm.tokens import Encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PLAIN = {}
OURS = {}
for name in NAMES:
    PLAIN[name] = Tokenizer.from_file(public_tokenizers.path(name))
    PLAIN[name].encode_special_tokens = True
    OURS[name] = Encoder(public_tokenizers.path(name), most_pieces=50)

PARTS = st.sampled_from(["don't", "we'll", " ", "  ", "\n", "\t", "\r\n", "a", "Zoë", "é", "0", "10", "x0y", ",", "...", "–,", "_", "<|endoftext|>", "\x85", "\x1c", "\xa0", "　", "ΣΑΣ", "İ", "日本", "é", "'", "'s", "😀", "0 0", "²"])


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(PARTS, max_size=30).map("".join), st.text(max_size=60)), max_size=6))
def test_same_ids_as_the_library(name, texts):
    want = [e.ids for e in PLAIN[name].encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in OURS[name].encode(texts)] == want
