"""Pages to chunks, links and segments, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.functions import html as H
from sillage.functions import segments as S
from sillage.functions import text as T

_CHUNKS = "array<struct<id:string,chunk_index:int,text:string,length:int,hierarchy:array<string>,outgoing_links:array<struct<anchor_text:string,target:string>>>>"
_LINKS = "array<struct<target:string,anchor_text:string,source_chunk:string>>"


def _by_page(pages: DataFrame, name: str, kind: str, make: Callable[[str, str], list]) -> DataFrame:
    """pages (url, html, ...) with a column made of each page; one that cannot be read gives an empty list, or no text, and no other row fails for it (see unreadable)."""
    nothing: list | str = "" if kind == "string" else []
    at_url, at_html = pages.columns.index("url"), pages.columns.index("html")
    others = [k for k, c in enumerate(pages.columns) if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                made = []
                for url, page in zip(part.column(at_url).to_pylist(), part.column(at_html).to_pylist(), strict=True):
                    try:
                        made.append(make(url or "", page or ""))
                    except (ValueError, AssertionError):
                        made.append(nothing)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in others), pa.array(made, arrow)], names=[*(part.schema.names[k] for k in others), name])

    text, number = pa.string(), pa.int32()
    link = pa.struct([("anchor_text", text), ("target", text)])
    arrow = {
        _CHUNKS: pa.list_(pa.struct([("id", text), ("chunk_index", number), ("text", text), ("length", number), ("hierarchy", pa.list_(text)), ("outgoing_links", pa.list_(link))])),
        _LINKS: pa.list_(pa.struct([("target", text), ("anchor_text", text), ("source_chunk", text)])),
        "string": text,
    }[kind]
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    return pages.mapInArrow(run, f"{rest}, `{name}` {kind}")


def chunks(pages: DataFrame, most: int = H.MAX_WORDS, overlap: int = H.OVERLAP) -> DataFrame:
    """A row for each chunk of each page, with the page's other columns; of columns that both have the chunk's stays."""
    own = ("id", "chunk_index", "text", "length", "hierarchy", "outgoing_links")
    made = _by_page(pages.drop(*own), "chunk", _CHUNKS, lambda url, page: H.chunks(url, page, most, overlap))
    return made.withColumn("chunk", F.explode("chunk")).select(*(c for c in made.columns if c != "chunk"), "chunk.*")


def links(pages: DataFrame, *keys: str) -> DataFrame:
    """from_url, pos, target, anchor_text, source_chunk of every link of every page; before them the page's keys, which tell apart pages that share a URL."""
    made = _by_page(pages.select(*keys, "url", "html"), "links", _LINKS, lambda url, page: H.links(page, url))
    return made.select(*keys, F.col("url").alias("from_url"), F.posexplode("links").alias("pos", "l")).select(*keys, "from_url", "pos", "l.*")


def texts(pages: DataFrame) -> DataFrame:
    """pages with text, all that a reader sees, instead of html."""
    return _by_page(pages, "text", "string", lambda url, page: H.page_text(page))


def unreadable(pages: DataFrame) -> DataFrame:
    """The URLs of pages that cannot be read: chunks(), links() and texts() give nothing for them."""

    def tell(url: str, page: str) -> str:
        try:
            H.chunks(url, page)
            H.links(page, url)
        except (ValueError, AssertionError):
            return "y"
        return ""

    return _by_page(pages.select("url", "html"), "bad", "string", tell).where("bad <> ''").select("url")


def segments(chunked: DataFrame, most_tokens: int = S.limit(), text_col: str = "text") -> DataFrame:
    """A row for each segment of each chunk, with seg_index, seg_count and seg_whole: whether it is the chunk as it was. Texts that fit never reach Python.

    A text that is a little too long may make one segment, too, since what joins its pieces isn't counted: seg_count is 1 there, and seg_whole false.
    """
    fits = T.token_estimate(F.col(text_col)) <= most_tokens
    whole = chunked.where(fits & (F.trim(text_col) != "")).withColumns({"seg_index": F.lit(0), "seg_count": F.lit(1), "seg_whole": F.lit(True)})
    long = chunked.where(~fits & (F.trim(text_col) != ""))
    at, schema = long.columns.index(text_col), long.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                parts = S.segments(one.column(at)[0].as_py(), most_tokens)
                body = pa.Table.from_batches([one]).take([0] * len(parts)).combine_chunks().to_batches()[0] if parts else one.slice(0, 0)
                columns = [pa.array(parts, c.type) if k == at else c for k, c in enumerate(body.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(parts)), pa.int32()), pa.array([len(parts)] * len(parts), pa.int32())], names=[*body.schema.names, "seg_index", "seg_count"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return whole.unionByName(long.mapInArrow(run, f"{ddl}, seg_index int, seg_count int").withColumn("seg_whole", F.lit(False)))
