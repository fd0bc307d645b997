"""BM25 as tables: documents, statistics of terms, and a batch of questions against them."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillage.functions import text as T

K1, B = 1.5, 0.75
#: Pairs of a question and one of its terms that go to every task; larger batches are joined with postings instead.
MOST_ASKED = 1_000_000
#: Rows of a batch that are Python's own at a time.
TOGETHER = 64
_TOKEN = re.compile("[a-z0-9_]{2,}")


@dataclass
class Index:
    """occurrences (id, dl, term) of tokens, terms (term, df, idf), and totals (n_docs, avgdl), a table of one row.

    Occurrences are counted once it is known which terms are asked for, so that only those are shuffled.
    """

    occurrences: DataFrame
    terms: DataFrame
    totals: DataFrame

    def postings(self, asked: DataFrame | None = None) -> DataFrame:
        """id, dl, term, tf of all terms, or of those asked for (term)."""
        rows = self.occurrences if asked is None else self.occurrences.join(asked.select("term").distinct(), "term", "left_semi")
        return rows.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def documents(records: DataFrame, id_col: str, text_col: str, summary_col: str | None = None) -> DataFrame:
    """id, tokens and dl of records; an empty text gives way to the summary. Those without a token are in no posting and no total;
    they are not filtered here, since a filter on tokens would have them made twice."""
    text = F.coalesce(F.nullif(F.col(text_col), F.lit("")), F.col(summary_col)) if summary_col else F.col(text_col)
    return records.select(F.col(id_col).alias("id"), T.tokens(text).alias("tokens")).withColumn("dl", F.size("tokens"))


def index(docs: DataFrame) -> Index:
    """From documents()."""
    some = F.when(F.col("dl") > 0, F.col("dl"))
    totals = docs.agg(F.count(some).alias("n_docs"), F.avg(some).alias("avgdl"))
    occurrences = docs.select("id", "dl", F.explode("tokens").alias("term"))
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = df.crossJoin(F.broadcast(totals)).select("term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return Index(occurrences, terms, totals)


def scores(ix: Index, questions: DataFrame) -> DataFrame:
    """qid, id, score of every document that shares a term with a question; a term asked twice counts twice.

    questions (qid, query) is a batch of a session's size; its terms go to the postings, which stay where they are.
    """
    asked = questions.select("qid", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    weighted = asked.join(ix.terms, "term")
    met = ix.postings(asked).join(weighted, "term").crossJoin(F.broadcast(ix.totals))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) * F.col("qtf")
    return met.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best documents of each question, ties by id, with their rank from 0."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows, TOGETHER at a time as Python's, so that its texts are never held twice."""
    for at in range(0, batch.num_rows, TOGETHER):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, TOGETHER).columns), strict=True)


def _count(asked: dict[str, int]):  # noqa: ANN202
    """In how many texts each asked term is, for each task; under -1 texts with a token, and their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[int] = Counter()
        texts = tokens = 0
        for batch in batches:
            for (text,) in _rows(batch):
                found = _TOKEN.findall((text or "").lower())
                texts, tokens = texts + bool(found), tokens + len(found)
                df.update([asked[t] for t in set(found) if t in asked])
        rows = [(-1, texts, tokens), *((t, n, 0) for t, n in df.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["term", "n", "tokens"])

    return run


def best(records: DataFrame, questions: DataFrame, k: int, id_col: str = "id", text_col: str = "text", summary_col: str | None = None, digits: int | None = None) -> DataFrame:
    """qid, id, score, rank from 0: the k best records of each question (qid, query), ties by id; scores rounded to digits before they are compared.

    Every text is scored where it lies: one pass counts in how many texts the asked terms are, another scores and keeps each task's own k best
    of each question, so that what is shuffled grows with questions and tasks, not with texts or postings. What goes to the tasks is
    the questions' terms, MOST_ASKED at most; a larger batch is joined with postings instead. Null and empty texts are
    in no result; records that repeat an id are records of their own.
    """
    text = F.coalesce(F.nullif(F.col(text_col), F.lit("")), F.col(summary_col)) if summary_col else F.col(text_col)
    texts = records.select(F.col(id_col).alias("id"), text.alias("text"))
    asked = questions.select("qid", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    rows = asked.limit(MOST_ASKED + 1).collect()
    if len(rows) > MOST_ASKED:
        scored = scores(index(documents(records, id_col, text_col, summary_col)), questions)
        return top(scored if digits is None else scored.withColumn("score", F.round("score", digits)), k)
    qids = list(dict.fromkeys(r["qid"] for r in rows))
    place = {q: n for n, q in enumerate(qids)}
    terms = {t: n for n, t in enumerate(dict.fromkeys(r["term"] for r in rows))}
    counted = texts.select("text").mapInArrow(_count(terms), "term int, n long, tokens long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()
    df = {r["term"]: r["n"] for r in counted}
    n_docs = df.pop(-1, 0)
    avgdl = sum(r["tokens"] for r in counted) / n_docs if n_docs else 1.0
    by_term: dict[int, list[tuple[int, float]]] = {}
    for r in rows:
        t = terms[r["term"]]
        if t in df:
            by_term.setdefault(t, []).append((place[r["qid"]], r["qtf"] * float(np.log(1 + (n_docs - df[t] + 0.5) / (df[t] + 0.5)))))
    weights = {name: (np.array([q for q, _ in by_term[t]]), np.array([w for _, w in by_term[t]])) for name, t in terms.items() if t in by_term}
    sent = records.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, kept, kind = sent.value, [[] for _ in qids], None
        order = lambda hit: (-hit[0], hit[1] is not None, hit[1])
        least = np.zeros(len(qids))
        for batch in batches:
            kind = batch.column(0).type
            for key, text in _rows(batch):
                found = Counter(_TOKEN.findall((text or "").lower()))
                of = [(weights[t], n) for t, n in found.items() if t in weights]
                if not of:
                    continue
                norm = K1 * (1 - B + B * found.total() / avgdl)
                got = np.bincount(np.concatenate([w[0] for w, _ in of]), np.concatenate([w[1] * (n * (K1 + 1) / (n + norm)) for w, n in of]), len(qids))
                if digits is not None:
                    got = np.round(got, digits)
                for q in np.flatnonzero((got > 0) & (got >= least)).tolist():
                    kept[q].append((float(got[q]), key))
                    if len(kept[q]) >= 4 * k + 64:
                        kept[q] = heapq.nsmallest(k, kept[q], key=order)
                        least[q] = kept[q][-1][0]
        out = [(qids[q], key, score) for q, hits in enumerate(kept) for score, key in heapq.nsmallest(k, hits, key=order)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], qid_type), pa.array([r[1] for r in out], kind), pa.array([r[2] for r in out], pa.float64())], names=["qid", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    qid_type = to_arrow_type(questions.schema["qid"].dataType)
    ddl = f"qid {questions.schema['qid'].dataType.simpleString()}, id {texts.schema['id'].dataType.simpleString()}, score double"
    return top(texts.mapInArrow(run, ddl), k) if k > 0 and rows else texts.limit(0).select(F.lit(None).cast(questions.schema["qid"].dataType).alias("qid"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
