"""The main text of pages: their runs of text, less those that a site repeats, that are mostly links, or that stand alone and short."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillage.functions import html as H
from sillage.functions import urls as U
from sillage.sources.tables import remove_stored, stored

#: A run is a site's own, not a page's, where it is on so many of its pages, and on so large a share of them.
LEAST_PAGES, SHARE = 3, 0.1
#: Words from which a run stands for itself, and the greatest share of them in links.
LONG, LINKED = 10, 0.33

_RUN = "struct<text:string,words:int,linked:int,around:boolean,heading:boolean>"
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("around", pa.bool_()), ("heading", pa.bool_())]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            part = batch.slice(at, 32)
            made = []
            for page in part.column(1).to_pylist():
                try:
                    made.append(H.text_blocks(page or ""))
                except (ValueError, AssertionError):  # the parser gives up on it
                    made.append([])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, _ARROW)], names=["_row", "runs"])


def main_texts(pages: DataFrame) -> DataFrame:
    """pages (url, html, and any more but html, which goes) with text, and n_runs and n_kept, how many runs of text they have and how many of these text is.

    A run is left out where it stands around the text (navigation, header, footer, aside, form), where more than LINKED of its words are links, or where
    its site has it on LEAST_PAGES pages and on SHARE of them. Of the rest, runs of LONG words stay, and shorter ones next to one that stays: a short
    line within a text, and a heading over it. Lines of text are joined by a blank line.

    Sites are counted by digests, once for each page and summed where they lie; pages of one address are pages of their own. Null, empty and unreadable pages have an
    empty text. An extra column text, n_runs or n_kept gives way.
    """
    rest = [c for c in pages.columns if c not in ("html", "text", "n_runs", "n_kept")]
    given = stored(pages.withColumn("_row", F.monotonically_increasing_id()), "pages")
    site = F.lower(U.domain(F.coalesce("url", F.lit(""))))
    parsed = given.select("_row", "html").mapInArrow(_runs, f"_row long, runs array<{_RUN}>")
    runs = stored(parsed.select("_row", F.posexplode("runs").alias("pos", "r")).select("_row", "pos", "r.*", F.xxhash64(F.lower("r.text")).alias("digest")), "runs")
    sites = given.select("_row", F.coalesce(site, F.lit("")).alias("site"))
    total = sites.groupBy("site").agg(F.count("*").alias("pages"))
    often = runs.select("_row", "digest").distinct().join(sites, "_row").groupBy("site", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    own = stored(often.join(total, "site").where(F.col("n") >= SHARE * F.col("pages")).select("site", "digest", F.lit(True).alias("own")), "own")
    placed = runs.join(sites, "_row").join(own, ["site", "digest"], "left")
    fine = ~F.col("around") & (F.col("linked") <= LINKED * F.col("words")) & F.col("own").isNull()
    order = Window.partitionBy("_row").orderBy("pos")
    near = lambda f: F.coalesce(f("long").over(order), F.lit(False))
    judged = placed.withColumn("fine", fine).withColumn("long", F.col("fine") & (F.col("words") >= LONG)).withColumn("kept", F.col("long") | (F.col("fine") & (near(F.lag) | near(F.lead))))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("pos", "text")))), lambda x: x["text"])
    told = judged.groupBy("_row").agg(F.array_join(lines, "\n\n").alias("text"), F.count("*").cast("int").alias("n_runs"), F.sum(F.col("kept").cast("int")).cast("int").alias("n_kept"))
    made = stored(given.select("_row", *rest).join(told, "_row", "left").select(*rest, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("n_kept", F.lit(0)).alias("n_kept")), "main")
    remove_stored(given, runs, own)
    return made
