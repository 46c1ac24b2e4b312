"""Interleaved documents: ordered text and media references from HTML, payloads resolved by digest."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, written

WIDTH = 64
_MEDIA = {"img", "video", "audio", "source", "embed"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "table", "tr", "td", "nav", "header", "footer", "main", "blockquote", "pre", "title", "body", "head"}
_SILENT = {"script", "style", "template", "noscript"}


class _Interleaved(HTMLParser):
    """Collects [kind, text, reference, caption] in the order of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list[str | None]] = []
        self.buffer: list[str] = []
        self.silent = 0
        self.figure: list[list[str | None]] | None = None
        self.captioning = False

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if not text:
            return
        if self.captioning and self.figure is not None:
            for item in self.figure:
                item[3] = text
            if self.figure:
                return
        self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs) -> None:
        found = dict(attrs)
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAKS or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.captioning = True
        elif tag in _MEDIA and (ref := found.get("src")):
            self.items.append(["media", None, ref, found.get("alt") or None])
            if self.figure is not None:
                self.figure.append(self.items[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in _BREAKS:
            self.flush()
        if tag == "figcaption":
            self.captioning = False
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.buffer.append(data)


def items_of(html: str | None) -> list[dict]:
    """Ordered items of a page. A figure's caption goes to its media and not into the text; else ``alt`` is the caption."""
    p = _Interleaved()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": i, "kind": k, "text": t, "reference": r, "caption": c} for i, (k, t, r, c) in enumerate(p.items)]


ITEMS = "array<struct<position int, kind string, text string, reference string, caption string>>"


def interleaved(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, items) per row: text and media references in the order of the page. Null or empty pages have no items;
    broken markup gives what the parser can read; repeated rows give equal rows; other columns are ignored."""
    kind = pages.schema[key].dataType.simpleString()
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([items_of(x) for x in b.column(1).to_pylist()], item)], [key, "items"])

    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, f"`{key}` {kind}, items {ITEMS}")


def resolved(pages: DataFrame, key: str, payloads: DataFrame) -> DataFrame:
    """One row per media reference ``media:<digest>`` of (key, items): key, position, caption, digest and the columns of
    payloads, which has one row per digest. A reference without a payload has nulls there. A digest that many rows refer
    to is one row on its side, so the join splits the other side where it is skewed."""
    refs = pages.select(key, F.explode("items").alias("i")).where("i.kind = 'media' and startswith(i.reference, 'media:')")
    refs = refs.select(key, "i.position", "i.caption", F.expr("substring(i.reference, 7)").alias("digest"))
    return refs.join(payloads, "digest", "left")


def as_samples(data: bytes) -> tuple[bytes, bytes]:
    """The payload, zero-padded to a positive multiple of 64 bytes, and its grey image (binary PGM) of width 64."""
    payload = data + bytes(-len(data) % WIDTH if data else WIDTH)
    return payload, b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples_of(media: bytes) -> bytes:
    """The payload of a grey image that as_samples made."""
    kind, shape, depth, payload = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or depth != b"255" or width * height != len(payload):
        raise ValueError("not a whole 8-bit grey image")
    return payload


def feature_of(payload: bytes) -> str:
    """Mean, deviation and a histogram of 16 levels in thousandths of the samples, and bands of rows brighter than average."""
    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    bands = [b.mean() if len(b) else 0.0 for b in np.array_split(x.reshape(-1, WIDTH).mean(1), 16)]
    bright = sum(1 << i for i, b in enumerate(bands) if b > x.mean())
    return f"{x.mean():.3f}|{x.std():.3f}|{'.'.join(map(str, levels))}|{bright:04x}"


def store(docs: DataFrame) -> DataFrame:
    """Writes and reads back (doc_id, n_bytes, html, digest, media): each text as a grey image under its payload's
    digest, and a page whose figure refers to it. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 128):
            n, html, digest, media = [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                payload, image = as_samples(data)
                n.append(len(data))
                digest.append(hashlib.sha256(payload).hexdigest())
                html.append(f'<article><figure><img src="media:{digest[-1]}"><figcaption>document {doc_id}</figcaption></figure></article>')
                media.append(image)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(html), pa.array(digest), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "html", "digest", "media"])

    small_batches(docs.sparkSession)
    shape = "doc_id long, n_bytes long, html string, digest string, media binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)
    return written(rows, "media", **{"parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false"})


def features(media: DataFrame) -> DataFrame:
    """One row per digest: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, computed from
    the stored bytes where they are read. Only these small rows are shuffled; copies are merged before that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 128):
            out: list[list] = [[] for _ in range(6)]
            for x in b.column(1):
                image = x.as_py()
                payload = samples_of(image)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v) for v in out)], names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    shape = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("digest", "media").mapInArrow(run, shape).distinct()
