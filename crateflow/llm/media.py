"""Media columns: pages as ordered sequences of text and media references, resolved by digest.

Payloads are kept by content: a table of (digest, media), each media a lossless 8-bit grey image (PNG) of the payload.
A page's HTML is parsed to an ordered array of structs, text runs and media references with their captions, in which
positions never change: references are taken out, joined by digest with what is stored, and put back at their places.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm import html_text
from crateflow.llm.common import batches_of, col, stored, text_bytes

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "sha256:"
#: Media shown on one page.
PER_PAGE = 8
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,n_bytes:bigint,caption:string,name:string>>"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    """data and zeros up to a positive multiple of WIDTH."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """The payload as a PNG: 8-bit grey samples, WIDTH to a row, no row filter."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such a PNG; raises on damage or on any other kind."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, width, rows = 8, [], 0, 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, rows, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Statistics of the samples: mean, spread, entropy in bits, and difference of neighbours."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={max(0.0, float(-(p * np.log2(p)).sum())):.4f};step={step:.4f}"


def figure_html(number: int, name: str, digest: str, n_bytes: int) -> str:
    """A document's media as the number-th on a page: as a figure, in running text, in a list or in a table."""
    image = f'<img id="{name}" data-bytes="{n_bytes}" src="{SCHEME}{digest}"'
    caption = f"Bytes of {name}"
    return (
        f"<p>Document {name}</p><figure>{image}><figcaption>{caption}</figcaption></figure>",
        f'<p>Document {name} is {image} alt="{caption}"> here, in a line.',
        f'<ul><li>Document {name}<li>its bytes {image} alt="{caption}"></ul>',
        f'<table><tr><th>Document<th>Bytes<tr><td>{name}<td>{image} alt="{caption}"></table>',
    )[number % 4]


def keep_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text's payload as media in the shared folder: doc_id, n_bytes, digest, media, page_id, html, as read back.

    media is null where the same task has already stored the same payload. html is a page that shows this document's
    media and those of the PER_PAGE - 1 before it at most; it stands with the page's last document. Null texts are empty.
    """
    names = ["doc_id", "n_bytes", "digest", "media", "page_id", "html"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        page, shown = TaskContext.get().partitionId() << 40, []

        def html_of() -> str:
            parts = "".join(figure_html(i, *x) for i, x in enumerate(shown))
            shown.clear()
            return f"<article><h1>Page {page & (1 << 40) - 1}</h1>{parts}<p>End.</p></article>"

        for b in batches_of(it, 1):
            size, digest, media, pages, html = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                payload = padded(t)
                key = hashlib.sha256(payload).digest()
                size.append(len(t))
                digest.append(key.hex())
                media.append(None if key in seen else encode(payload))
                if len(seen) < 1 << 18:
                    seen.add(key)
                shown.append(("?" if d is None else str(d), key.hex(), len(t)))
                pages.append(page)
                html.append(html_of() if len(shown) == PER_PAGE else None)
                page += html[-1] is not None
            if shown:  # pages end with the slice, so a page is written with all its documents
                html[-1] = html_of()
                page += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(digest), pa.array(media, pa.binary()), pa.array(pages, pa.int64()), pa.array(html, pa.string())], names)

    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("t"))
    return stored(rows.mapInArrow(run, "doc_id long, n_bytes long, digest string, media binary, page_id long, html string"), "media")


def describe(media: DataFrame) -> DataFrame:
    """A row for each digest: what the stored bytes decode to. A digest that its bytes don't have is an error."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 1, 1 << 20):
            rows = []
            for digest, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                payload = decode(m)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest:
                    raise ValueError(f"media stored as {digest} is {sha}")
                rows.append((digest, len(payload), sha, zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(payload)))
            names = [x.split()[0] for x in FEATURES.split(", ")]
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    each = media.where("media is not null").select("digest", "media").mapInArrow(run, FEATURES)
    names = [x.split()[0] for x in FEATURES.split(", ")][1:]
    return each.groupBy("digest").agg(F.first(F.struct(*names)).alias("_f")).select("digest", "_f.*")


def sequence_of(source: str) -> list[dict]:
    """Text runs and media references of a page, in order."""
    out: list[dict] = []
    words: list[str] = []

    def flush() -> None:
        text = " ".join(" ".join(words).split())
        words.clear()
        if text:
            out.append({"position": len(out), "kind": "text", "text": text, "digest": None, "n_bytes": None, "caption": None, "name": None})

    def caption_in(figure: html_text.Node | None) -> str | None:
        for c in figure.children if figure else ():
            if isinstance(c, html_text.Node) and c.tag == "figcaption":
                return " ".join(html_text.text_of_node(c).split()) or None
        return None

    def walk(node: html_text.Node, figure: html_text.Node | None) -> None:
        for c in node.children:
            if isinstance(c, str):
                words.append(c)
            elif c.tag == "img":
                flush()
                a = c.attributes
                digest = a["src"][len(SCHEME) :] if a.get("src", "").startswith(SCHEME) else None
                size = a.get("data-bytes", "")
                out.append({"position": len(out), "kind": "media", "text": None, "digest": digest, "n_bytes": int(size) if size.isdecimal() and len(size) < 19 else None, "caption": caption_in(figure) or a.get("alt") or None, "name": a.get("id")})
            elif c.tag == "figcaption" and figure is not None or not html_text.visible(c):
                continue
            else:
                if c.tag in html_text.BLOCKS:
                    flush()
                walk(c, c if c.tag == "figure" else figure)
                if c.tag in html_text.BLOCKS:
                    flush()

    walk(html_text.parse(source), None)
    flush()
    return out


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and items of every page; a null page has no items."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("caption", pa.string()), ("name", pa.string())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence_of(x) for x in b.column(1).to_pylist()], kind)], ["page_id", "items"])

    rows = pages.select(col(pages, id_col).cast("long").alias("page_id"), F.coalesce(col(pages, html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id long, items {ITEMS}")


def resolve(items: DataFrame, described: DataFrame) -> DataFrame:
    """A row for each media reference: page_id, position, caption, name, n_bytes, digest and what is stored under it (nulls
    where nothing is). Both sides are joined as they lie, so a digest that many pages refer to is split when it is hot."""
    refs = items.select("page_id", F.explode("items").alias("i")).where("i.kind = 'media'")
    refs = refs.select("page_id", "i.position", "i.caption", "i.name", "i.n_bytes", "i.digest")
    return refs.join(described.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left").drop("_digest")


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, page_id, position and caption of each document's media in the page that shows it, n_bytes, and what its
    stored bytes hold.

    Pages show several documents' media among their texts, in figures, lines, lists and tables; they are parsed to
    sequences of texts and references, and these resolved by digest. Null texts are empty payloads of WIDTH zeros; null
    ids and repeated rows keep their rows; other columns are not read; an empty table gives no rows.
    """
    kept = keep_payloads(docs, id_col, text_col)
    pages = stored(sequences(kept.where("html is not null").select("page_id", "html")), "sequences")
    found = resolve(pages, stored(describe(kept), "media-features"))
    doc = F.when(F.col("name") != "?", F.col("name").cast("long")).alias("doc_id")
    return found.select(doc, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "page_id", "position", "caption")
