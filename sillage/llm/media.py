"""Media columns: HTML documents as ordered sequences of text and media references, resolved by digest.

A sequence's part is (position, kind, text, digest, caption). Stored forms are a table of their own; sequences refer
to them by digest, and a join by digest brings a payload's facts to every place it is used, so that positions and captions
stay with their part whatever the order of rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm.common import forget, read, slices, stored, whole

#: Samples in a row of the stored picture: payloads fill whole rows with FILL.
WIDTH, FILL = 576, b"\xff"
_PNG = b"\x89PNG\r\n\x1a\n"
_SCHEME = "sha256:"


def padded(text: str) -> bytes:
    """UTF-8, then bytes 255 up to a positive multiple of WIDTH."""
    data = text.encode("utf-8", "surrogatepass")
    return data + FILL * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey picture WIDTH wide, lossless; each row has filter type 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The payload of to_png(). Raises ValueError where the picture is not of that form or was damaged."""
    if not data.startswith(_PNG):
        raise ValueError("not a PNG")
    at, width, height, packed = len(_PNG), 0, 0, []
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("another form")
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean sample, and an average hash of 8 by 8 areas, as text."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = np.array_split(np.arange(len(rows)), 8) if len(rows) >= 8 else [[k * len(rows) // 8] for k in range(8)]
    areas = np.array([rows[p].reshape(-1, 8, WIDTH // 8).mean(axis=(0, 2)) for p in parts])
    bits = (areas > areas.mean()).ravel()
    return f"{len(rows)}:{rows.mean():.3f}:{np.packbits(bits).tobytes().hex()}"


_MEDIA = {"img", "audio", "video", "source"}
_BLOCK = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "figure", "table", "tr", "blockquote", "pre"}


class _Sequence(HTMLParser):
    """Collects text and figures in document order. A caption, before or after, belongs to all media of its figure."""

    def __init__(self, hidden: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.hides, self.hidden = hidden, 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None
        self.captions: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.add("text", text=text)

    def add(self, kind: str, text: str | None = None, digest: str | None = None, caption: str | None = None) -> None:
        self.parts.append({"position": len(self.parts), "kind": kind, "text": text, "digest": digest, "caption": caption})

    def end_caption(self) -> None:
        if self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if text:
                self.captions.append(text)

    def end_figure(self) -> None:
        """Captions go to the figure's media; without any they are text."""
        self.end_caption()
        self.flush()
        for media in self.figure or []:
            if self.captions:
                media["caption"] = " ".join(self.captions)
        if not self.figure:
            for text in self.captions:
                self.add("text", text=text)
        self.figure, self.captions = None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.hides:
            self.hidden += 1
        if tag == "figure":
            self.end_figure()
            self.figure = []
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in _BLOCK or tag in _MEDIA:
            # A caption may hold blocks of its own, but a picture after it shows that it had ended.
            if tag in _MEDIA:
                self.end_caption()
            elif self.caption is not None:
                self.caption.append(" ")
            self.flush()
        if tag in _MEDIA and not self.hidden:
            found = dict(attrs)
            src = found.get("src") or ""
            if src:
                known = src.startswith(_SCHEME)
                self.add("media", digest=src.removeprefix(_SCHEME) if known else None, text=None if known else src, caption=found.get("alt"))
                if self.figure is not None:
                    self.figure.append(self.parts[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hides:
            self.hidden = max(0, self.hidden - 1)
        if tag == "figure":
            self.end_figure()
        elif tag == "figcaption":
            if self.figure is None:
                # A caption of no figure is text.
                self.end_figure()
            else:
                self.end_caption()
        elif tag in _BLOCK:
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)

    def finish(self) -> None:
        self.close()
        # An unclosed figure whose media came first may have taken the rest of the page for its caption: that is text.
        if self.caption is not None:
            self.text, self.caption = [*self.text, *self.caption], None
        self.end_figure()


def parse(html: str) -> list[dict]:
    """The ordered parts of a page. A picture whose src is no digest keeps its src as text.

    Broken pages lose no text: what is left open at the end (a caption, a template) was no such thing, and declarations that
    the parser can't read are text. Scripts and styles end where a browser ends them.
    """
    hidden = {"script", "style", "template"}
    for _ in range(3):
        parser = _Sequence(hidden)
        try:
            parser.feed(html)
            parser.close()
        except AssertionError:
            html = html.replace("<![", "&lt;![")
            continue
        if not parser.hidden or hidden == {"script", "style"}:
            break
        hidden = {"script", "style"}
    parser.finish()
    return parser.parts


_PARTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_PART_TYPE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def sequences(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """doc_id, position, kind, text, digest, caption: one row for each part of each page, in order of position.

    Null and empty pages have no parts; broken HTML is read as far as it goes; repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, pages_ in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([parse(p) for p in pages_], _PART_TYPE)], names=["doc_id", "parts"])

    rows = pages.select(F.col(id_col).cast("long").alias("doc_id"), whole(html_col).alias("html")).mapInArrow(run, f"doc_id long, parts {_PARTS}")
    return rows.select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.*")


def resolve(parts: DataFrame, media: DataFrame) -> DataFrame:
    """parts with the facts of media (a row for each digest) at every place that refers to it; references that nothing resolves keep nulls."""
    return parts.join(media, "digest", "left")


def page_of(text: str, digest: str, size: int) -> str:
    """A text as a page: a paragraph for each line that has a word, and after the first a figure that refers to the digest, its caption the text's size."""
    lines = [f"<p>{escape(line, False)}</p>" for line in text.split("\n") if line.split()]
    lines.insert(1, f'<figure><figcaption>{size} bytes</figcaption><img src="{_SCHEME}{digest}"></figure>')
    return "<article>" + "\n".join(lines) + "</article>"


def _digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (texts,) in slices(batches, 64):
        payloads = [padded(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(p) for p in payloads], pa.string()), pa.array([to_png(p) for p in payloads], pa.binary())], names=["digest", "media"])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in slices(batches, 64):
        pages = [page_of(t, _digest(padded(t)), len(t.encode("utf-8", "surrogatepass"))) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pages, pa.string())], names=["doc_id", "html"])


_FACTS = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for digests, media in slices(batches, 64):
        payloads = [from_png(m) for m in media]
        sha = [hashlib.sha256(p).hexdigest() for p in payloads]
        columns = [pa.array(digests, pa.string()), pa.array([len(p) for p in payloads], pa.int64()), pa.array(sha, pa.string()), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array([feature(p) for p in payloads], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=_FACTS)


def interleave(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pages (doc_id, html) and media (digest, media): every text becomes a page of its paragraphs (see page_of) and a stored picture that the page refers to.

    Null texts are empty; an empty text is a row of FILL. Ids may be null or repeat. Other columns are ignored; empty tables give no rows.
    Media are in the shared folder; pages are made as they are read, since they hold no more than the texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(_pages, "doc_id long, html string"), stored(rows.select("text").mapInArrow(_store, "digest string, media binary"), "media")


def media_facts(kept: DataFrame) -> DataFrame:
    """A row for each digest of kept (digest, media) with what reading its stored form back gives; copies of a form are read where they lie and meet as facts only.

    Rows without a digest or a form are left out; an empty table gives no rows. A form that is damaged raises ValueError.
    """
    read_back = kept.select("digest", "media").where("digest is not null and media is not null").mapInArrow(_facts, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read_back.groupBy("digest").agg(*(F.max(c).alias(c) for c in _FACTS[1:]))


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "digest", "position", "caption", "n_parts", "text_sha256"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    for ids, pages in slices(batches, 64):
        rows = []
        for i, page in zip(ids, pages, strict=True):
            parts = parse(page)
            told = "\n".join(p["text"] for p in parts if p["kind"] == "text")
            sha = hashlib.sha256(told.encode("utf-8", "surrogatepass")).hexdigest()
            rows += [(i, p["digest"], p["position"], p["caption"], len(parts), sha) for p in parts if p["kind"] == "media"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)


def shown(pages: DataFrame) -> DataFrame:
    """doc_id, digest, position, caption, n_parts, text_sha256: a row for each medium of each page (doc_id, html), beside how many parts
    the page has and a digest of its text parts, a line each. Null and empty pages have none; repeated rows repeat."""
    return pages.select("doc_id", whole("html").alias("html")).mapInArrow(_shown, "doc_id long, digest string, position int, caption string, n_parts int, text_sha256 string")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, media = interleave(read(spark, sf_dir, "documents"))
    facts = stored(media_facts(media), "facts")
    forget(media)
    # The caption states the text's size, so it shows that captions stayed with their pictures.
    size = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return resolve(shown(pages), facts).select("doc_id", size.alias("n_bytes"), *_FACTS[1:], "position", "caption", "n_parts", "text_sha256")
