"""Operator 8: interleaved document sequences with media columns.

A page of HTML becomes an ordered sequence of text and media-reference structs. References name
their payload by digest; payloads are stored once a digest and resolved by a join on it.
Positions count over the sequence, and a caption stays with its reference.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import common as C
from sedge.shipping import ship

WIDTH = 64
#: Bytes of text and pages that are worked on together.
PART_BYTES, PAGES = 1 << 20, 64
#: Elements whose text is not shown.
HIDDEN = {"script", "style", "template", "noscript"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "section", "article", "figure", "blockquote", "pre"}
MEDIA = {"img", "video", "audio", "source"}
SCHEME = "digest:"
ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


class Sequence(HTMLParser):
    """Ordered items (kind, text, digest, caption) of a page.

    A figure's caption goes to all media of that figure, before or after it, and to no others;
    what lies in hidden elements is neither text nor media.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.hidden: list[str] = []
        self.caption: list[str] | None = None
        #: Of each open figure its media and its caption.
        self.figures: list[tuple[list[list], list[str]]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        if self.caption is not None:
            self.figures[-1][1].append(" ".join("".join(self.caption).split()))
            self.caption = None

    def end_figure(self) -> None:
        self.end_caption()
        media, captions = self.figures.pop()
        caption = " ".join(c for c in captions if c)
        for item in media:
            item[3] = caption or item[3]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag == "figcaption" and self.figures:
            self.flush()
            self.end_caption()
            self.caption = []
        elif tag in MEDIA:
            a = dict(attrs)
            if src := a.get("src"):
                self.flush()
                item = ["media", None, src.removeprefix(SCHEME), a.get("alt")]
                self.items.append(item)
                if self.figures:
                    self.figures[-1][0].append(item)
        elif tag in BREAKS:
            if self.caption is not None:
                self.caption.append(" ")
                if tag != "figure":
                    return
                self.end_caption()
            self.flush()
            if tag == "figure":
                self.figures.append(([], []))

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
        elif self.hidden:
            return
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.flush()
            self.end_figure()
        elif tag in BREAKS:
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)

    def done(self) -> list[tuple]:
        self.close()
        while self.figures:
            self.end_figure()
        self.flush()
        return [(k, *item) for k, item in enumerate(self.items)]


def sequence_of(html: str) -> list[tuple]:
    p = Sequence()
    p.feed(html)
    return p.done()


def interleave(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Row per page: key and items, an array of struct<position, kind, text, digest, caption>.

    kind is text or media; text runs end at block elements and at media. A reference without
    the digest scheme keeps its URL as digest. A figure's caption goes to its media, before or
    after it, else the alternative text does. Media and text of script, style, template and
    noscript elements are left out. Null or empty pages have no items; repeated rows each have
    theirs; unclosed elements end with the page.
    """
    ship(pages.sparkSession)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["position", "kind", "text", "digest", "caption"]
        kind = pa.list_(pa.struct([("position", pa.int32())] + [(n, pa.string()) for n in names[1:]]))
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                items = [[dict(zip(names, x, strict=True)) for x in sequence_of(h.as_py() or "")] for h in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, kind)], names=["key", "items"])

    pages = pages.select(F.col(key).cast("long").alias("key"), F.col(html).alias("html"))
    return pages.mapInArrow(C.lean(f), f"key long, items {ITEM}").withColumnRenamed("key", key)


def resolve(sequences: DataFrame, key: str, store: DataFrame, *beside: str) -> DataFrame:
    """Row per media item: key, columns beside it, position, digest, caption and the store's columns (null if it has none).

    store has one row a digest. Both sides are exchanges under the join, so that a digest which
    very many pages name is split by adaptive execution.
    """
    refs = sequences.select(key, *beside, F.inline("items")).filter(F.col("kind") == "media").drop("kind", "text")
    return refs.join(store, "digest", "left")


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH))


def to_media(payload: bytes) -> bytes:
    """A binary greymap (P5) of one byte a sample, WIDTH samples a row."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


HEADER = re.compile(rb"P5\n(\d+) (\d+)\n255\n")


def from_media(media: bytes) -> bytes:
    m = HEADER.match(media)
    if not m or len(media) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not a greymap as it was stored")
    return media[m.end() :]


def features(payload: bytes) -> str:
    """Rows, mean, deviation and mean step between rows of the samples, all exact to six digits."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    n, total, square = a.size, int(a.sum()), int((a * a).sum())
    step = int(np.abs(np.diff(a, axis=0)).sum())
    return f"rows={len(a)};mean={total / n:.6f};var={square / n - (total / n) ** 2:.6f};step={step / n:.6f}"


def digest_of(data: bytes) -> tuple[bytes, str]:
    payload = padded(data)
    return payload, hashlib.sha256(payload).hexdigest() + f"-{len(data)}"


def store_texts(docs: DataFrame) -> DataFrame:
    """The store of texts as media, in the checkpoint folder: digest, media. Rows of equal texts are equal there."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in C.parts(b, PART_BYTES):
                found = [digest_of(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([d for _, d in found]), pa.array([C.pack(to_media(p)) for p, _ in found], pa.binary())], names=["digest", "media"])

    return C.checkpointed(docs.select("text").mapInArrow(C.lean(f), "digest string, media binary"))


CAPTION = 80


def page_of(text: str) -> str:
    """A document's page: its lines as paragraphs, and after the first a figure that refers to its text's media.

    The figure's caption is the first CAPTION characters of the first line that has any.
    """
    lines = text.split("\n")
    title = next((s for x in lines if (s := " ".join(x.split()))), "")[:CAPTION]
    _, digest = digest_of(text.encode())
    figure = f"<figure><figcaption>{escape(title)}</figcaption><img src='{SCHEME}{digest}' alt='{len(text)} characters'></figure>"
    marked = [f"<p>{escape(x, False)}</p>" for x in lines]
    return "".join([marked[0], figure, *marked[1:]])


def pages_of(docs: DataFrame) -> DataFrame:
    """Row per document: doc_id, html. A null text is empty."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _ in C.parts(b, PART_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([page_of(t.as_py() or "") for t in part.column("text")], pa.string())], names=["doc_id", "html"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(C.lean(f), "doc_id long, html string")


READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(store: DataFrame) -> DataFrame:
    """One row a digest with what the stored bytes say; the payload itself stays in the store."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, x in zip(b.column("digest").to_pylist(), b.column("media"), strict=True):
                media = C.unpack(x.as_py())
                payload = from_media(media)
                rows.append((d, int(d.rpartition("-")[2]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest"] + [c.split()[0] for c in READ.split(", ")])

    return store.mapInArrow(C.lean(f), "digest string, " + READ).dropDuplicates(["digest"])


def media_columns(docs: DataFrame) -> DataFrame:
    """Row per document: doc_id, digest, position, caption, n_items and the columns of READ, by way of its page.

    The page is parsed whole: position is the reference's place among n_items of text and media.
    A null text is empty; an empty one is one row of zero bytes. Very long texts are one
    payload. Rows that repeat a doc_id each have a row. Other columns of docs are ignored.
    """
    ship(docs.sparkSession)
    sequences = interleave(pages_of(docs), "doc_id", "html").select("doc_id", "items", F.size("items").alias("n_items"))
    return resolve(sequences, "doc_id", C.checkpointed(read_back(store_texts(docs))), "n_items")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(C.documents(spark, sf_dir)).drop("digest")
