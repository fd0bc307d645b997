"""A corpus from raw documents: toxic ones out, one of each group of near duplicates, secrets out, sources mixed, texts encoded.

Every stage takes a table with the columns of documents, any of them null, and ignores columns besides, whatever their names; an
empty table gives an empty one. Rows that repeat are rows of their own, and texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm import bpe, mixing, near_dedup, secrets, toxicity
from sillage.llm.common import forget, read, stored
from sillage.session import ship


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now is."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labels of sf_dir; documents that score 0.5 or more go. Null texts are judged as empty ones; null ids are no label's."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return _documents(toxicity.without_toxic(docs, model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id. Documents without an id, or without words, stay; rows that repeat altogether stay or go together."""
    return _documents(near_dedup.without_near_duplicates(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark; no document goes, and null texts stay null."""
    return _documents(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them. Null sources are a source of their own, null texts have no words and go."""
    return _documents(mixing.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of every row, as a trainer reads them, and how many there are. Null and empty texts have none."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stored before the next."""
    docs = read(ship(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made = stored(made, f"stage-{name}")
        if k:
            forget(docs)
        docs = made
    return docs


#: SQL can't express a trained model or a tokenizer: tests/llm holds the rows of run() against plain versions of its stages.
ORACLE_SQL: str | None = None
