"""Hits from several searches: union in order of arrival, one per record, ranked, capped per page and per URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.functions import urls as U

ANCHOR_BOOST, SECTION_BOOST, PER_PARENT, PER_URL = 0.10, 0.05, 2, 1
#: Weight of where a hit came from, among equal scores (fixed values); any other origin is 0.
ORIGINS = {"initial": 3, "initial-after-recrawl": 3, "rewrite": 2, "graph-anchor": 1, "section": 1}
HIT_COLUMNS = ["id", "url", "chunk_index", "text", "score", "_score_vec", "_score_bm25", "_origin", "_boost_reason", "_meta_rank", "hierarchy", "parent"]


def _by(keys: list[str], *order: Column | str):  # noqa: ANN202
    return Window.partitionBy(*keys).orderBy(*order)


def arrived(*groups: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All hits of the groups with seq, their order of arrival: groups in turn, each by its own seq."""
    out = None
    for n, g in enumerate(groups):
        g = g.withColumn("_group", F.lit(n))
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    return out.withColumn("seq", F.row_number().over(_by(keys, "_group", "seq")) if keys else F.col("_group").cast("long") * (1 << 40) + F.col("seq")).drop("_group")


def record_id() -> Column:
    return F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.concat(F.coalesce("url", F.lit("")), F.lit("#chunk_"), F.coalesce(F.col("chunk_index").cast("string"), F.lit("-1"))))


def one_per_record(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The hit of the greatest score for each record, the earlier of equals; a score of 0 is as none.

    The winner keeps the place of the record's first hit. Where it has no boost reason, origin or rank, the first hit that came after
    it gives its own.
    """
    hits = hits.withColumn("_rid", record_id())
    best = F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.lit(float("-inf")))
    of = [*keys, "_rid"]
    ranked = hits.withColumn("_n", F.row_number().over(_by(of, best.desc(), "seq"))).withColumn("_first", F.min("seq").over(Window.partitionBy(*of)))
    win = F.max(F.when(F.col("_n") == 1, F.col("seq"))).over(Window.partitionBy(*of))
    later = ranked.withColumn("_win", win)
    for c in ("_boost_reason", "_origin", "_meta_rank"):
        given = F.min(F.when(F.col("seq") > F.col("_win"), F.struct("seq", F.col(c).alias("v")))).over(Window.partitionBy(*of))["v"]
        later = later.withColumn(f"_{c}", F.coalesce(F.col(c), given))
    kept = later.where("_n = 1").withColumn("seq", F.col("_first"))
    for c in ("_boost_reason", "_origin", "_meta_rank"):
        kept = kept.drop(c).withColumnRenamed(f"_{c}", c)
    return kept.drop("_n", "_first", "_win")


def rank_score() -> Column:
    vec = F.coalesce(F.nullif(F.col("_score_vec"), F.lit(0.0)), F.col("score"), F.lit(0.0))
    boost = F.when(F.col("_boost_reason") == "anchor", ANCHOR_BOOST).when(F.col("_boost_reason") == "section", SECTION_BOOST).otherwise(0.0)
    return 0.75 * vec + 0.25 * F.coalesce("_score_bm25", F.lit(0.0)) + boost


def origin_weight() -> Column:
    out = F.lit(0)
    for name, weight in ORIGINS.items():
        out = F.when(F.col("_origin") == name, weight).otherwise(out)
    return out


def ranked(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits with rank_score and place, from 1: by score, then origin, then rank within its search, then arrival.

    keys tell questions apart, and each question's hits are ranked in one task: there has to be such a key, since without it that would be all hits.
    """
    if not keys:
        raise ValueError("hits are ranked by question: name the columns that tell questions apart")
    order = _by(keys, F.desc("rank_score"), origin_weight().desc(), F.coalesce("_meta_rank", F.lit(9999)), "seq")
    return hits.withColumn("rank_score", rank_score()).withColumn("place", F.row_number().over(order))


def capped(placed: DataFrame, keys: list[str], per_parent: int = PER_PARENT, per_url: int = PER_URL) -> DataFrame:
    """At most per_parent hits of a parent, then of those at most per_url of a canonical URL, each by place."""
    parent = F.coalesce(F.nullif(F.col("parent"), F.lit("")), F.col("url"), F.lit(""))
    few = placed.withColumn("_p", parent).withColumn("_n", F.row_number().over(_by([*keys, "_p"], "place"))).where(F.col("_n") <= per_parent)
    few = few.withColumn("_u", U.page_key(F.coalesce("url", F.lit("")))).withColumn("_n", F.row_number().over(_by([*keys, "_u"], "place"))).where(F.col("_n") <= per_url)
    return few.drop("_p", "_u", "_n")


def rerank(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits, with keys telling questions apart, as one ranked list for each question."""
    return capped(ranked(one_per_record(hits, keys), keys), keys)


def hints(hits: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Headings and incoming anchors of each question's first hits, in order: what a rewrite may build on."""
    first = hits.withColumn("_n", F.row_number().over(_by(keys, "seq"))).where(F.col("_n") <= most)
    heading = F.array(F.array_join("hierarchy", " > "))
    anchors = F.transform(F.coalesce("incoming_links", F.array().cast("array<struct<from_page:string,anchor_text:string,source_chunk:string>>")), lambda x: x["anchor_text"])
    rows = first.select(*keys, "_n", F.posexplode(F.concat(heading, anchors)).alias("_i", "hint"))
    return rows.where("hint <> ''").withColumn("n", F.row_number().over(_by(keys, "_n", "_i"))).select(*keys, "n", "hint")


def anchor_queries(seeds: DataFrame, keys: list[str], seeds_most: int = 12, links_most: int = 5) -> DataFrame:
    """Distinct questions '{anchor} {question}' from the first incoming links of the first seeds; n is their order."""
    first = seeds.withColumn("_n", F.row_number().over(_by(keys, "seq"))).where(F.col("_n") <= seeds_most)
    links = first.select(*keys, "question", "_n", F.posexplode(F.slice("incoming_links", 1, links_most)).alias("_i", "link"))
    asked = links.withColumn("anchor", F.trim(F.coalesce("link.anchor_text", F.lit("")))).where("anchor <> ''").withColumn("query", F.trim(F.concat_ws(" ", "anchor", "question")))
    return asked.groupBy(*keys, "query").agg(F.min(F.struct("_n", "_i")).alias("at")).withColumn("n", F.row_number().over(_by(keys, "at"))).drop("at")


def section_queries(seeds: DataFrame, keys: list[str], seeds_most: int = 10) -> DataFrame:
    """Distinct questions '{question} {top heading}' from the first seeds; n is their order."""
    first = seeds.withColumn("_n", F.row_number().over(_by(keys, "seq"))).where(F.col("_n") <= seeds_most)
    asked = first.withColumn("top", F.get("hierarchy", 0)).where("top <> ''").withColumn("query", F.concat_ws(" ", "question", "top"))
    return asked.groupBy(*keys, "query").agg(F.min("_n").alias("at")).withColumn("n", F.row_number().over(_by(keys, "at"))).drop("at")
