"""Public tokenizers (files of the tokenizers library) over whole texts, with the same ids at a lower cost.

A byte-level vocabulary whose ids are its merge ranks is encoded by tiktoken, built from the same file. One that drops
white space and never merges across it is encoded word by word with the library's merges, and a word seen before is not
encoded again. Texts for which either is not certain to give the library's ids, and all other files, go to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import regex
import tiktoken
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

#: Characters that Python and the tokenizers' pattern engines may disagree on as white space.
_UNSURE = re.compile("[\x1c-\x1f\x85᠎​﻿]")
#: Characters whose class or lower case two Unicode versions may see differently; words of others are cut here.
_FOREIGN = re.compile("[^\0-\u024f\u0400-\u045f\u2010-\u2026]")
#: How byte-level files write bytes: these stand for themselves, the others follow 255 in order.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SELF)}
_ENCODERS: dict[tuple[str, int], "Encoder"] = {}


class _Memo(dict):
    """Stored ids of words, made where a word is first looked up; those of the generation before are taken over."""

    def __init__(self, make: Callable[[str], bytes], old: dict):
        self.make, self.old = make, old

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        self[word] = got
        return got


class Encoder:
    """ids of texts by a tokenizers JSON file; strings of special tokens in a text are ordinary text.

    most_pieces bounds the memory of words (about 170 bytes each, twice): when so many are new, those not met since the last
    time are forgotten.
    """

    def __init__(self, path: str, most_pieces: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.most_pieces, self.memo = most_pieces, _Memo(self._word, {})
        pre, normalizer = spec["pre_tokenizer"] or {}, spec["normalizer"]
        parts = [p["type"] for p in pre.get("pretokenizers", [])]
        norms = [n["type"] for n in (normalizer or {}).get("normalizers", [])]
        self.by_words = parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["invert"] and norms == ["NFC", "Replace", "Lowercase"]
        self.split = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"]).findall if self.by_words else None
        self.merge = self.tokenizer.model.tokenize
        self.stored = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.ranks = None
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not normalizer:
            self.ranks = _ranked(spec["model"])

    def _whole(self, text: str) -> bool:
        """Whether only the library itself is certain to give its ids."""
        if _UNSURE.search(text) or not (self.by_words or self.ranks):
            return True
        return self.by_words and (bool(_FOREIGN.search(text)) or not unicodedata.is_normalized("NFC", text))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """ids of one lower-case word: split and written as bytes' characters as the library does, merged by it.

        The pieces of a word, its letters and the marks around them, are remembered as words of their own.
        """
        pieces = [word] if word.isalpha() else self.split(word)
        if pieces != [word]:
            return b"".join(map(self.memo.__getitem__, pieces))
        return b"".join([self.stored[t.id] for t in self.merge(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_SHOWN))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text, without any end id."""
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        out: list = [None] * len(texts)
        for i, got in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = np.frombuffer(got, self.dtype)
        rest = [i for i, x in enumerate(out) if x is None]
        if self.ranks:
            for i in rest:
                out[i] = self.ranks.encode_to_numpy(texts[i], disallowed_special=()).astype(self.dtype)
            return out
        if len(self.memo) > self.most_pieces:
            self.memo = _Memo(self._word, dict(self.memo))
        get = self.memo.__getitem__
        for i in rest:
            out[i] = np.frombuffer(b"".join(map(get, texts[i].lower().split())), self.dtype)
        return out


def _ranked(model: dict) -> tiktoken.Encoding | None:
    """The vocabulary as tiktoken's ranks, if every merge's id follows from its place in the list of merges."""
    byte_of = {c: b for b, c in _SHOWN.items()}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or sorted(vocab[c] for c in byte_of) != list(range(256)):
        return None
    ranks = {bytes(byte_of[c] for c in a + b): 256 + i for i, (a, b) in enumerate(merges)} | {bytes([b]): vocab[c] for c, b in byte_of.items()}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str) -> Encoder:
    """The process's encoder for a file, made once for all tasks of a worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, os.getpid())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]
