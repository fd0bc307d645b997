"""Context for an answer: ranked hits cut to a budget, grouped by section, with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillage.operators.rerank import record_id


def pieces(ranked: DataFrame, max_chars: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The hits that fit the budget, by place, with piece, the text as it goes into the context: heading, text, source.

    Repeated records and blank texts don't count. A piece that doesn't fit is cut to what is left, and ends the list; what
    joins pieces isn't counted.
    """
    once = ranked.withColumn("_rid", record_id())
    once = once.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_rid").orderBy("place"))).where("_n = 1")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    heading = F.array_join(F.coalesce("hierarchy", F.array().cast("array<string>")), " > ")
    whole = F.concat(F.when(heading != "", F.concat(F.lit("["), heading, F.lit("]\n"))).otherwise(""), text, F.lit("\n\n(Source: "), F.coalesce("url", F.lit("N/A")), F.lit(")"))
    made = once.withColumn("_all", F.lit(0)).where(text != "").withColumn("_whole", whole)
    before = F.coalesce(F.sum(F.length("_whole")).over(Window.partitionBy(*keys, "_all").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = made.withColumn("_before", before).where(F.col("_before") < max_chars)
    section = F.coalesce(F.get("hierarchy", 0), F.lit("General"))
    return made.withColumn("piece", F.expr(f"left(_whole, {max_chars} - cast(_before as int))")).withColumn("section", section).select(*keys, "place", F.col("_rid").alias("chunk_id"), F.coalesce("url", F.lit("N/A")).alias("url"), "section", "piece")


def assembled(parts: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """context of each question: pieces of a section together, sections in order of their first piece. Bounded by the budget."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "\n\n")
    sections = parts.withColumn("_all", F.lit(0)).groupBy(*keys, "_all", "section").agg(F.min("place").alias("place"), joined.alias("block"))
    blocks = F.array_sort(F.collect_list(F.struct("place", "block")))
    return sections.where(F.trim("block") != "").groupBy(*keys, "_all").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n---\n\n").alias("context")).drop("_all")


def sources(parts: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Distinct (chunk_id, url) of pieces with their section, by first place; blanks drop out."""
    clean = parts.select(*keys, "place", F.trim("chunk_id").alias("chunk_id"), F.trim("url").alias("url"), "section").where("chunk_id <> '' and url <> ''")
    order = Window.partitionBy(*keys, "chunk_id", "url").orderBy("place")
    return clean.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def first_urls(rows: DataFrame, most: int = 3, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The first distinct URLs by place, numbered from 1."""
    found = rows.where("url <> ''").groupBy(*keys, "url").agg(F.min("place").alias("place"))
    return found.withColumn("n", F.row_number().over(Window.partitionBy(*keys, F.lit(0)).orderBy("place"))).where(F.col("n") <= most)


def links_by_concept(rows: DataFrame, concepts: DataFrame, most_concepts: int = 4, most_rows: int = 20, most_links: int = 2) -> DataFrame:
    """concept, n, url: of the first rows, by place, the distinct URLs whose text, headings or address hold the concept.

    concepts (n, concept) is a handful for a question, rows are its hits.
    """
    asked = concepts.where(F.col("n") <= most_concepts).select(F.col("n").alias("concept_n"), "concept", F.lower(F.trim("concept")).alias("needle")).where("needle <> ''")
    few = rows.where((F.col("place") <= most_rows) & (F.col("url") != ""))
    met = few.crossJoin(F.broadcast(asked)).where(F.lower("text").contains(F.col("needle")) | F.lower(F.array_join("hierarchy", " ")).contains(F.col("needle")) | F.lower("url").contains(F.col("needle")))
    found = met.groupBy("concept_n", "concept", "url").agg(F.min("place").alias("place"))
    return found.withColumn("n", F.row_number().over(Window.partitionBy("concept_n", "concept").orderBy("place"))).where(F.col("n") <= most_links).select("concept", "n", "url")


def coverage(rows: DataFrame, concepts: DataFrame, most_rows: int = 10) -> DataFrame:
    """concept, covered: whether the first rows' texts hold it, as it is written, in lower case."""
    text = rows.where(F.col("place") <= most_rows).agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")).alias("all_text"))
    return concepts.crossJoin(F.broadcast(text)).select("concept", F.coalesce(F.col("all_text").contains(F.col("concept")), F.lit(False)).alias("covered"))


def covered_by(rows: DataFrame, concepts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """concept, n_rows, first: how many rows hold each concept (concept), and the least id that does, for any number of concepts over any
    number of rows. Concepts are compared trimmed and in lower case; those nowhere held have 0 and null."""
    from sillage.functions.patterns import counted

    counts = counted(rows, concepts.select(F.col("concept").alias("phrase")), id_col, text_col)
    named = concepts.select("concept", F.lower(F.trim("concept")).alias("phrase")).distinct()
    return named.join(counts, "phrase", "left").select("concept", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first")


def memory(turns: DataFrame, max_chars: int = 2000, last_k: int = 0, reset_at: int = 0) -> DataFrame:
    """conv_id and memory: the newest turns before the current one, as many as fit, oldest first.

    turns (conv_id, turn, role, text): those before reset_at and the last one don't count, nor, with last_k, all but the last 2 * last_k
    before it; blank ones are passed over. The first that doesn't fit ends it.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("_at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).where(F.col("_at") >= reset_at)
    rows = rows.withColumn("_back", F.row_number().over(newest)).where("_back > 1")
    if last_k > 0:
        rows = rows.where(F.col("_back") <= 2 * last_k + 1)
    content = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = rows.where(content != "").withColumn("_line", F.concat(F.initcap(F.coalesce("role", F.lit("user"))), F.lit(": "), content))
    total = F.sum(F.length("_line") + 1).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_total", total).where(F.col("_total") <= max_chars)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "_line"))), lambda x: x["_line"])
    return rows.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("memory"))
