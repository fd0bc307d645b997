"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, split over shards to the word."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.llm.common import WORD, forget, read, stored, unused, whole

#: Weights of the sources in order of code point, null last, over and over.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input, and how often a source may be used at most.
SHARE, REPEATS = 1.5, 2
#: Most words in a block, least blocks in a source's target (blocks get smaller where it is small), and about how many words of input a shard has.
BLOCK, BLOCKS, SHARD = 64, 16, 1 << 16
SEED = 17
#: Shards whose words are summed up in one task; above them their sums are.
SPAN = 1024


def block_of(targets: list[float]) -> int:
    """Words in a block: as many as leave the smallest target, but for those of nothing, BLOCKS blocks, one at least and BLOCK at most. So no
    source is too small for a seat, and rounding to blocks moves none by more than a part of its target."""
    return max(1, min(BLOCK, int(min((t for t in targets if t > 0), default=0.0) / BLOCKS)))


def apportion(targets: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients target / (2 * seats so far + 1); ties go to the earlier; none goes beyond its cap."""
    got = [0] * len(targets)
    if seats > 1000 + len(targets):
        # Quotients above one that gives out no more than all seats are among the highest; one less each for rounding.
        least = sum(targets) / (2 * seats)
        while least > 0 and sum(counts := [min(int((t / least + 1) / 2), c) for t, c in zip(targets, caps, strict=True)]) > seats:
            least *= 1 + max(1e-12, len(targets) / seats)
        if least > 0:
            got = [max(0, n - 1) for n in counts]
            seats -= sum(got)
    queue = [(-t / (2 * got[i] + 1), i) for i, t in enumerate(targets) if t > 0 and got[i] < caps[i]]
    heapq.heapify(queue)
    while seats > 0 and queue:
        _, i = queue[0]
        got[i] += 1
        seats -= 1
        if got[i] < caps[i]:
            heapq.heapreplace(queue, (-targets[i] / (2 * got[i] + 1), i))
        else:
            heapq.heappop(queue)
    return got


def _quotas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for (sources,) in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sources = sorted(sources, key=lambda c: c["place"])
            targets = [c["target"] for c in sources]
            block = block_of(targets)
            got = apportion(targets, round(sum(targets) / block), [-(-REPEATS * c["words"] // block) for c in sources])
            out += [(c["place"], c["words"], min(n * block, REPEATS * c["words"])) for c, n in zip(sources, got, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 3, names=["place", "words", "quota"])


def source_targets(sized: DataFrame) -> DataFrame:
    """source, place, source_size, target: water filling. Every source gets its weight's share of the mix, but at most
    REPEATS times its size; what is above is shared again by weight among the others until none is above.

    The table has a row for each source, a few as weights are set for each of them.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    w = sources.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weights[F.col("place") % len(WEIGHTS)]).withColumn("cap", F.col("source_size") * REPEATS)
    # Sources reach their cap in this order as the level rises; those before a source are capped when it is looked at.
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(all_) * SHARE)
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    found = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(all_)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * found, F.col("cap").cast("double")))
    return w.select("source", F.col("place").cast("long").alias("place"), "source_size", target.alias("target"))


def _quota(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources, and by shard and place how many rounds a source's documents are taken whole, and the words due of the shard besides.

    sized has source, size and draw. Both tables are in the shared folder.
    """
    sources = stored(source_targets(sized), "sources")
    shards = F.greatest(F.lit(1), F.ceil(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).select(F.col("n") / SHARD).scalar()))
    met = sized.select("source", "size", F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("draw")), shards).cast("long").alias("shard")).join(sources.select(F.col("source").alias("s"), "place"), F.col("source").eqNullSafe(F.col("s")))
    cells = met.groupBy("shard", "place").agg(F.sum("size").alias("words")).where("words > 0")
    gathered = sources.groupBy().agg(F.collect_list(F.struct("place", F.col("source_size").alias("words"), "target")).alias("sources"))
    quotas = gathered.mapInArrow(_quotas, "place long, words long, quota long").where("words > 0")
    quotas = quotas.selectExpr("place", "words as whole", "div(quota, words) as rounds", "quota % words as rest")
    # Words of a source in the shards before: in spans of shards, and of the spans.
    cells = stored(cells.withColumn("span", F.expr("div(shard, %d)" % SPAN)), "cells")
    earlier = lambda *keys, by: F.coalesce(F.sum("words").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = cells.groupBy("place", "span").agg(F.sum("words").alias("words")).select("place", "span", earlier("place", by="span").alias("base"))
    before = cells.withColumn("before", earlier("place", "span", by="shard")).join(spans, ["place", "span"]).join(quotas, "place")
    # The products go beyond long in large tables.
    share = "div(cast({0} as decimal(18, 0)) * cast(rest as decimal(18, 0)), cast(whole as decimal(18, 0)))"
    due = stored(before.select("shard", "place", "rounds", F.expr(share.format("(base + before + words)") + " - " + share.format("(base + before)")).alias("due")), "due")
    forget(cells)
    return sources.withColumn("shards", shards), due


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What a row is mixed by: its size, and the seeded hash that places it. The text is part of the hash, so that rows that share an id, or have none, spread like any other."""
    return {"size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"), "draw": F.xxhash64(F.lit(SEED), F.col(id_col).cast("long"), F.xxhash64(whole(text_col)))}


def _taken(rows: DataFrame, sources: DataFrame, due: DataFrame, c: dict[str, str]) -> DataFrame:
    """rows (with size, draw and source by the names of c) and what is taken of each, a source's documents of a shard in seeded order."""
    named = sources.select(F.col("source").alias(c["s"]), F.col("place").alias(c["place"]), F.col("shards").alias(c["shards"]), F.col("source_size").alias(c["source_size"]), F.col("target").alias(c["target"]))
    met = rows.join(named, F.col(c["source"]).eqNullSafe(F.col(c["s"]))).withColumn(c["shard"], F.pmod(F.xxhash64(F.lit(SEED + 1), F.col(c["draw"])), F.col(c["shards"])).cast("long"))
    keys = [c["shard"], c["place"]]
    met = met.join(due.toDF(*keys, c["rounds"], c["due"]), keys, "left")
    stream = Window.partitionBy(*keys).orderBy(c["draw"], c["size"]).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(c["size"]).over(stream), F.lit(0))
    taken = F.col(c["size"]) * F.col(c["rounds"]) + F.greatest(F.lit(0), F.least(F.col(c["size"]), F.col(c["due"]) - start))
    return met.withColumn(c["taken"], F.coalesce(taken, F.lit(0)).cast("long"))


_COLUMNS = ("s", "place", "shards", "shard", "source_size", "target", "rounds", "due", "size", "draw", "source", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of docs.

    The sources compete for all blocks of the mix (see block_of) by highest quotients of their targets, which gives each its quota.
    Documents fall into shards of about SHARD words by a seeded hash. Every document is taken as often as its source's quota goes
    round all of the source; the rest of the quota is split over the source's shards by the words they have, its running
    total rounded down, so that fractions carry over from shard to shard and nothing of it is lost, however little of a source a
    shard has. A source's documents in a shard, in seeded order, form a stream, and the rest takes words from the start of it.
    So no document is used more than REPEATS times, and no source or shard is gathered in one task: a source of
    any size is spread over all shards.

    Nulls: a null text has no words, null sources are a source of their own, the last one; null ids are kept, and spread by their
    texts. Rows that repeat are documents of their own; those that repeat altogether share a shard. Sources without words have
    target 0. Empty tables give no rows. Reruns agree.
    """
    drawn = _drawn(docs, id_col, text_col, source_col)
    sized = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), *(v.alias(k) for k, v in drawn.items())), "sizes")
    sources, due = _quota(sized)
    names = {k: k for k in _COLUMNS}
    return _taken(sized, sources, due, names).select("doc_id", "size", "source", "source_size", "target", "taken")


_WORD = re.compile(WORD)


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    end = 0
    for k, m in enumerate(_WORD.finditer(text), 1):
        end = m.end()
        if k >= n:
            break
    return text[:end]


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix of docs itself, with all their columns: a row for each whole use of a document, and one of its first words for the rest
    of what is taken of it. Documents of which nothing is taken go. What is taken is by row, as mix() has it: rows may repeat an id.

    Whole rows go to their shards, which hold about SHARD words of all sources, so that texts are shuffled once.
    """
    drawn = _drawn(docs, id_col, text_col, source_col)
    sized = stored(docs.select(F.col(source_col).alias("source"), *(v.alias(k) for k, v in drawn.items())), "sizes")
    sources, due = _quota(sized)
    forget(sized)
    c = {k: unused(docs, k) for k in _COLUMNS}
    rows = docs.withColumns({c["source"]: F.col(source_col), **{c[k]: v for k, v in drawn.items()}})
    met = _taken(rows, sources, due, c).where(F.col(c["taken"]) > 0).select(*docs.columns, c["size"], c["taken"])
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts, sizes, uses = part.column(at).to_pylist(), part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                rows, out = [], []
                for row, (text, size, use) in enumerate(zip(texts, sizes, uses, strict=True)):
                    size = max(size, 1)
                    rows += [row] * -(-use // size)
                    out += [text] * (use // size) + ([first_words(text, use % size)] if use % size else [])
                body = pa.Table.from_batches([part]).take(rows).combine_chunks().to_batches()[0] if rows else part.slice(0, 0)
                columns = [pa.array(out, c.type) if k == at else c for k, c in enumerate(body.columns[:-2])]
                yield pa.RecordBatch.from_arrays(columns, names=body.schema.names[:-2])

    return met.mapInArrow(run, schema)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
