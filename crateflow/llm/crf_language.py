"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and whether the training texts' lexicon of a language holds
it; their weights and the transitions between languages are learned by maximum likelihood with forward-backward. The
training sequences join stretches of different texts, so switches of language within a text are part of the model.
Every word of a text gets the posterior of each language; a text's language is the one with the largest mean. A chain's
words cover the whole text: scripts that set no spaces and very long words are cut into consecutive pieces, each a
place of the chain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import batches_of, col

UNDETERMINED = "und"
BUCKETS = 1 << 16
_WIDE = 24
#: Scripts that set no spaces between words (South-East Asian, kana, Han); their runs are cut into pieces of RUN.
_NO_SPACES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
RUN = 4
_UNSPACED = re.compile(f"[{_NO_SPACES}]")
_PIECES = re.compile(f"[{_NO_SPACES}]{{1,{RUN}}}|[^{_NO_SPACES}]{{1,{_WIDE}}}")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¡¿|0123456789"


def words_of(text: str) -> list[str]:
    """The places of a text's chain, lower-cased: its words, the longer ones and runs of scripts without spaces in pieces."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= _WIDE and not _UNSPACED.search(text):
        return words
    return [p for w in words for p in _PIECES.findall(w)]


def _cleaned(words: list[str]) -> list[str]:
    """Words without punctuation at their ends."""
    return [w.strip(_PUNCTUATION) for w in words]


def features(words: list[str]) -> np.ndarray:
    """Buckets of each word's affixes (2-4) and n-grams (1-3) within boundary marks; bucket 0 stands for none.

    words: of _WIDE characters at most, as words_of gives them."""
    n = len(words)
    chars = np.array(words, f"U{_WIDE}").reshape(n, 1).view(np.uint32).reshape(n, _WIDE).astype(np.uint64)
    size = np.array([min(len(w), _WIDE) for w in words])
    c = np.zeros((n, _WIDE + 2), np.uint64)
    c[:, 0] = 2
    c[:, 1:-1] = chars
    c[np.arange(n), size + 1] = 3
    out = []

    def put(h: np.ndarray, kind: int, ok: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(np.where(ok, 1 + (h >> np.uint64(40)) % np.uint64(BUCKETS - 1), 0).astype(np.int32))

    with np.errstate(over="ignore"):
        rolling = np.zeros_like(c)
        for k in range(1, 4):
            width = c.shape[1] - k + 1
            rolling = rolling[:, :width] * np.uint64(1_000_003) + c[:, k - 1 :]
            ok = (np.arange(width) + k <= size[:, None] + 2) & (size[:, None] > 0)
            put(rolling, k, ok)
        for k in range(2, 5):
            head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for i in range(k):
                head = head * np.uint64(1_000_003) + c[:, 1 + i]
                tail = tail * np.uint64(1_000_003) + c[np.arange(n), np.maximum(size - k + 1 + i, 0)]
            ok = size >= k
            put(head[:, None], 10 + k, ok[:, None])
            put(tail[:, None], 20 + k, ok[:, None])
    return np.concatenate(out, axis=1)


@dataclass
class Model:
    """languages in order; weights by bucket, by lexicon membership, of transitions (from, to) and of a first word."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, np.ndarray] = field(default_factory=dict)
    lexicon_weights: np.ndarray | None = None
    transitions: np.ndarray | None = None
    first: np.ndarray | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials of each word and language; none for a word without a letter."""
        cleaned = _cleaned(words)
        out = np.empty((len(words), len(self.languages)), np.float32)
        for k in range(0, len(words), 8192):
            out[k : k + 8192] = self.weights[features(cleaned[k : k + 8192])].sum(1)
        out += self._member(cleaned) * self.lexicon_weights
        out[[not any(map(str.isalpha, w)) for w in cleaned]] = 0
        return out

    def _member(self, cleaned: list[str]) -> np.ndarray:
        none = np.zeros(len(self.languages), np.float32)
        return np.array([self.lexicon.get(w, none) for w in cleaned], np.float32).reshape(len(cleaned), len(self.languages))


def forward_backward(e: np.ndarray, a: np.ndarray, first: np.ndarray, begins: np.ndarray, lane: int = 512) -> np.ndarray:
    """Posteriors of one chain of words in which a new text begins at each of `begins`, exactly.

    e: potentials (words, languages), a: transition potentials, first: those of a text's first word. The chain is cut
    into lanes that advance together: once for each lane's product of matrices, which gives the messages at its ends,
    and once in each direction with them. At a text's first word the past is forgotten: all rows of the matrix are equal.
    """
    m, n = e.shape
    lanes = -(-m // lane)
    pad = lanes * lane
    e = np.concatenate((e / e.max(1, keepdims=True), np.ones((pad - m, n), e.dtype))).reshape(lanes, lane, n)
    new = np.zeros(pad, bool)
    new[begins] = True
    new[m:] = True
    new = new.reshape(lanes, lane)
    starts = [np.flatnonzero(new[:, t]) for t in range(lane)]
    product = np.broadcast_to(np.eye(n), (lanes, n, n)).copy()
    for t in range(lane):
        step = (product.reshape(-1, n) @ a).reshape(lanes, n, n)
        if len(starts[t]):
            step[starts[t]] = product[starts[t]].sum(2, keepdims=True) * first
        product = step * e[:, t, None, :]
        product /= product.max((1, 2), keepdims=True)
    ahead, behind = np.full((lanes, n), 1 / n), np.full((lanes, n), 1 / n)
    for c in range(1, lanes):
        v = ahead[c - 1] @ product[c - 1]
        ahead[c] = v / v.sum()
    for c in range(lanes - 2, -1, -1):
        v = product[c + 1] @ behind[c + 1]
        behind[c] = v / v.sum()
    alpha, v = np.empty((lanes, lane, n)), ahead
    for t in range(lane):
        step = v @ a
        if len(starts[t]):
            step[starts[t]] = first
        v = step * e[:, t]
        v /= v.sum(1, keepdims=True)
        alpha[:, t] = v
    v = behind
    for t in range(lane - 1, -1, -1):
        alpha[:, t] *= v
        x = v * e[:, t]
        step = x @ a.T
        if len(starts[t]):
            step[starts[t]] = (x[starts[t]] @ first)[:, None]
        v = step / step.sum(1, keepdims=True)
    post = alpha.reshape(pad, n)[:m]
    return post / post.sum(1, keepdims=True)


def train(texts: list[tuple[str, str]], seed: int = 7, most_words: int = 300_000, rounds: int = 4, lexicon_words: int = 400, length: int = 64) -> Model:
    """Fit by stochastic gradient on sequences of `length` words, each of up to three stretches of different texts.

    most_words bounds the words of the sequences drawn; the texts themselves are a bounded sample of rows.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in texts})
    number = {lang: i for i, lang in enumerate(languages)}
    n = len(languages)
    split = [(words_of(t), number[lang]) for t, lang in texts]
    split = [(w, y) for w, y in split if w]
    counts = [Counter() for _ in languages]
    for words, y in split:
        counts[y].update(_cleaned(words))
    lexicon: dict[str, np.ndarray] = {}
    for y, c in enumerate(counts):
        for w, _ in c.most_common(lexicon_words):
            if w:
                lexicon.setdefault(w, np.zeros(n, np.float32))[y] = 1
    model = Model(languages, np.zeros((BUCKETS, n), np.float32), lexicon, np.zeros(n, np.float32), np.zeros((n, n)), np.zeros(n))
    if n < 2:
        return model
    by_language = [[i for i, (_, y) in enumerate(split) if y == k] for k in range(n)]
    order: dict[str, int] = {}
    draws = max(1, min(most_words, 4 * sum(len(w) for w, _ in split)) // length)
    xs, ys = np.zeros((draws, length), np.int64), np.zeros((draws, length), np.int64)
    for s in range(draws):
        cuts = np.sort(rng.integers(1, length, rng.integers(0, 3)))
        for lo, hi in zip([0, *cuts], [*cuts, length]):
            words, y = split[rng.choice(by_language[rng.integers(n)])]
            at = rng.integers(len(words))
            for k in range(lo, hi):
                xs[s, k] = order.setdefault(words[(at + k - lo) % len(words)], len(order))
                ys[s, k] = y
    cleaned = _cleaned(list(order))
    index = np.concatenate([features(cleaned[k : k + 8192]) for k in range(0, len(cleaned), 8192)])
    member = model._member(cleaned)
    letters = np.array([any(map(str.isalpha, w)) for w in cleaned])
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.lexicon_weights, model.transitions, model.first)]
    hot = np.eye(n)
    for _ in range(rounds):
        for some in np.array_split(rng.permutation(draws), max(1, draws // 256)):
            x, y = xs[some], ys[some]
            words, at = np.unique(x, return_inverse=True)
            at = at.reshape(x.shape)
            own = model.weights[index[words]].sum(1) + member[words] * model.lexicon_weights
            own[~letters[words]] = 0
            e = np.exp(own - own.max(1, keepdims=True))[at].reshape(-1, n)
            a, first = np.exp(model.transitions), np.exp(model.first)
            begins = np.arange(0, x.size, length)
            post = forward_backward(e, a, first, begins, length)
            pairs = _pairs(e.reshape(*x.shape, n), a, first)
            truth = hot[y.ravel()]
            error = np.zeros((len(words), n))
            for k in range(n):
                error[:, k] = np.bincount(at.ravel(), weights=(truth - post)[:, k], minlength=len(words))
            error[~letters[words]] = 0
            flat = index[words]
            gradient = np.stack([np.bincount(flat.ravel(), weights=np.repeat(error[:, k], flat.shape[1]), minlength=BUCKETS) for k in range(n)], 1)
            gradient[0] = 0
            seen = np.zeros((n, n))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            steps = (gradient, (error * member[words]).sum(0), seen - pairs, hot[y[:, 0]].sum(0) - post[begins].sum(0))
            for value, square, g in zip((model.weights, model.lexicon_weights, model.transitions, model.first), squares, steps):
                g = g / len(some)
                square += g * g
                value += (0.2 * g / np.sqrt(square) - 1e-5 * value).astype(value.dtype)
    return model


def _pairs(e: np.ndarray, a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected transitions over sequences of equal length (sequences, words, languages)."""
    s, length, n = e.shape
    alpha, v = np.empty_like(e), None
    for t in range(length):
        v = (first if v is None else v @ a) * e[:, t]
        v = v / v.sum(1, keepdims=True)
        alpha[:, t] = v
    out, b = np.zeros((n, n)), np.ones((s, n))
    for t in range(length - 1, 0, -1):
        x = b * e[:, t]
        p = alpha[:, t - 1, :, None] * a * x[:, None, :]
        out += (p / p.sum((1, 2), keepdims=True)).sum(0)
        b = x @ a.T
        b = b / b.sum(1, keepdims=True)
    return out


class Labeller:
    """Posteriors of the words of texts; a word met before is not featurized again."""

    def __init__(self, model: Model, most_words: int = 200_000):
        self.model, self.most = model, most_words
        self.a, self.first = np.exp(model.transitions), np.exp(model.first)
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def label(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text: the posteriors of its words, and whether each word has a letter the model reads."""
        words = [words_of(t) for t in texts]
        if len(self.place) > self.most:
            self.place.clear()
            self.table = self.table[:0]
        new = list(set().union(*words).difference(self.place)) if words else []
        if new:
            scores = self.model.emissions(new)
            self.table = np.concatenate((self.table, np.exp(scores - scores.max(1, keepdims=True))))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        get = self.place.__getitem__
        sizes = [len(w) for w in words]
        total = sum(sizes)
        if not total:
            return [np.zeros((0, len(self.model.languages)))] * len(texts), [np.zeros(0, bool)] * len(texts)
        at = np.fromiter((i for w in words for i in map(get, w)), np.int64, total)
        e = self.table[at]
        ends = np.cumsum(sizes)
        begins = (ends - sizes)[np.array(sizes) > 0]
        lane = int(min(512, max(16, total // 64)))
        post = forward_backward(e.astype(np.float64), self.a, self.first, begins, lane)
        counted = (e != 1).any(1)
        return np.split(post, ends[:-1]), np.split(counted, ends[:-1])


def _predict(model: Model, at: int, with_spans: bool):
    """Adds lang_pred and score (and spans) behind the columns of each batch; the text is column `at`."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        n = len(model.languages)
        for b in batches_of(it, at):
            texts = b.column(at).to_pylist()
            post, counted = labeller.label([t or "" for t in texts]) if n else ([None] * len(texts),) * 2
            best, score, spans = [], [], []
            for t, p, c in zip(texts, post, counted):
                if not t or n == 0 or not any(map(str.isalpha, t)):
                    best.append(UNDETERMINED)
                    score.append(0.0)
                    spans.append([])
                    continue
                share = (p[c] if c.any() else p).mean(0) if len(p) else np.full(n, 1 / n)
                k = int(share.argmax())
                best.append(model.languages[k])
                score.append(float(min(1.0, max(0.0, share[k]))))
                if with_spans:
                    y = p.argmax(1)
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(y)) + 1, [len(y)])) if len(y) else np.zeros(1, int)
                    spans.append([{"begin": int(i), "end": int(j), "lang": model.languages[int(y[i])]} for i, j in zip(cut[:-1], cut[1:])])
            more = [pa.array(best, pa.string()), pa.array(score, pa.float64())]
            if with_spans:
                more.append(pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            names = [f"c{i}" for i in range(b.num_columns)] + ["lang_pred", "score", "spans"][: len(more)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names)

    return run


def learn(docs: DataFrame, allowed: Column, most_per_language: int = 400, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fit on about most_per_language labelled rows of each language, drawn by a hash of id and text, and whole texts.

    allowed: which rows may be learned from. Rows with a null text or language are never used. Every language of the
    allowed rows is learned; the model holds a row of weights for each. With no rows the model knows no language. The
    draw takes equal rows together, so of a text repeated beyond most_per_language at most twice as many rows are used.
    """
    rows = docs.where(allowed).select(col(docs, id_col).alias("i"), col(docs, text_col).alias("t"), col(docs, lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    counts = sorted((r["l"], r["count"]) for r in rows.groupBy("l").count().collect())
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), {}, np.zeros(0, np.float32), np.zeros((0, 0)), np.zeros(0))
    draw = F.pmod(F.xxhash64("i", "t"), F.lit(1_000_003))
    # a row for each language, as the model itself has
    rates = docs.sparkSession.createDataFrame([(name, int(1_000_003 * min(1.0, most_per_language / n)) + 1) for name, n in counts], "_l string, _rate long")
    drawn = rows.join(F.broadcast(rates), F.col("l") == F.col("_l")).where(draw < F.col("_rate")).select("i", "t", "l").limit(2 * most_per_language * len(counts)).collect()
    return train([(r["t"], r["l"]) for r in sorted(drawn, key=lambda r: (str(r["i"]), r["t"]))])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row (with_spans: runs of one language as well, in places of words_of).

    Null texts and texts without a letter are `und` with score 0. Repeated rows give equal rows; ties go to the first
    language in order. Only the text is read; an empty table gives no rows.
    """
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("t"))
    more = ", spans array<struct<begin:int,end:int,lang:string>>" if with_spans else ""
    out = rows.mapInArrow(_predict(model, 1, with_spans), f"c0 long, c1 string, lang_pred string, score double{more}")
    return out.withColumnRenamed("c0", "doc_id").drop("c1")


def keep_known(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is in a known language with a score of least or more."""
    at = docs.columns.index(text_col)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = numbered.mapInArrow(_predict(model, at, False), f"{schema}, lang_pred string, score double")
    return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).drop("lang_pred", "score").toDF(*docs.columns)


