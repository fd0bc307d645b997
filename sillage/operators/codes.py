"""Product codes: a byte for each part of a vector instead of its numbers, searched by distance tables, the best compared exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from sillage.functions import vectors as V
from sillage.operators import index
from sillage.sources.tables import stored

#: Parts of a vector, codes of each, vectors that the codes are learned from at most, and rounds of learning.
PARTS, CODES, SAMPLE, ROUNDS = 8, 256, 20_000, 12
#: Numbers of the distance tables that go to every task at a time (16 MB); more questions take more passes over the codes.
MOST_TABLES = 2_000_000


def _learn(codes: int, rounds: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """Centres of one part's vectors, by k-means: rows part, v; ordered by v first, so that the order of rows doesn't matter."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.array(table.column("v").to_pylist(), np.float64)
        rows = rows[np.lexsort(rows.T[::-1])]
        rng = np.random.default_rng(seed)
        centres = rows[np.sort(rng.choice(len(rows), min(codes, len(rows)), replace=False))]
        for _ in range(rounds):
            near = nearest(rows, centres)
            n = np.bincount(near, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rows)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        part = table.column("part")[0].as_py()
        return pa.table({"part": pa.array([part] * len(centres), pa.int32()), "code": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    return run


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, ties to the first."""
    lengths = (centres**2).sum(axis=1)
    return np.concatenate([np.argmin(lengths - 2 * rows[at : at + 4096] @ centres.T, axis=1) for at in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, np.int64)


def books(records: DataFrame, dim: int, parts: int = PARTS, codes: int = CODES, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> list[np.ndarray]:
    """The centres of each part, learned part by part in tasks from sample vectors at most, the first by hash of their key.

    What a task holds is one part of the sample; what reaches the driver is parts * codes centres.
    """
    if dim % parts:
        raise ValueError(f"{parts} parts don't divide {dim} numbers")
    width = dim // parts
    some = records.where(F.size("unit") == dim).orderBy(F.xxhash64(F.lit(seed), "_key"), "_key").limit(sample)
    pieces = some.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("unit", p * width + 1, width))).alias("part", "v"))
    got = pieces.groupBy("part").applyInArrow(_learn(codes, rounds, seed), "part int, code int, centre array<double>").collect()
    return [np.array([r["centre"] for r in sorted((r for r in got if r["part"] == p), key=lambda r: r["code"])]).reshape(-1, width) for p in range(parts)]


def coded(records: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """_key, code: a byte for each part of every record with a vector of the right length."""
    dim = sum(c.shape[1] for c in centres)
    kind = to_arrow_type(records.schema["_key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                columns = [nearest(rows[:, sum(x.shape[1] for x in centres[:p]) :][:, : c.shape[1]], c) for p, c in enumerate(centres)]
                made = np.stack(columns, axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array([row.tobytes() for row in made], pa.binary())], names=["_key", "code"])

    return records.where(F.size("unit") == dim).select("_key", "unit").mapInArrow(run, S.StructType([records.schema["_key"], S.StructField("code", S.BinaryType())]))


def _scores(codes: pa.Array, tables: np.ndarray) -> np.ndarray:
    """Rows by questions: the sum over parts of what a question's table (parts, codes, questions) has for the row's code."""
    made = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    out = np.zeros((len(codes), tables.shape[2]), np.float32)
    for p in range(tables.shape[0]):
        out += tables[p][made[:, p]]
    return out


@dataclass
class Codes:
    """An index with product codes, in the shared folder: records, their codes as a table of their own, the centres, and how many
    of a question's best by code are compared exactly for k hits."""

    records: DataFrame
    codes: DataFrame
    centres: list[np.ndarray]
    keep: int = 0

    def _tables(self, vectors: list[list[float]]) -> np.ndarray:
        q = np.array(vectors, np.float64)
        at, tables = 0, np.zeros((len(self.centres), max(len(c) for c in self.centres), len(q)), np.float32)
        for p, c in enumerate(self.centres):
            tables[p, : len(c)] = c @ q[:, at : at + c.shape[1]].T
            at += c.shape[1]
        return tables

    def _asked(self, queries: DataFrame) -> list[tuple]:
        dim = sum(c.shape[1] for c in self.centres)
        rows = queries.select("qid", V.normalised(F.col("vector")).alias("asked")).where(F.size("asked") == dim).collect()
        return [(r["qid"], r["asked"]) for r in rows]

    def candidates(self, queries: DataFrame, keep: int) -> DataFrame:
        """qid, _key: the keep best of each question by code, ties by key. Codes alone are read; each task hands on its own best.

        queries are a stated set; their tables go to the tasks MOST_TABLES numbers at a time, a pass over the codes for each.
        """
        asked, each = self._asked(queries), max(1, MOST_TABLES // (len(self.centres) * CODES))
        form = S.StructType([queries.schema["qid"], self.codes.schema["_key"], S.StructField("near", S.DoubleType())])
        passes = [self._pass(asked[at : at + each], keep, form) for at in range(0, max(1, len(asked)), each)]
        found = passes[0]
        for more in passes[1:]:
            found = found.union(more)
        order = Window.partitionBy("qid").orderBy(F.desc("near"), "_key")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select("qid", "_key")

    def _pass(self, asked: list[tuple], keep: int, form: S.StructType) -> DataFrame:
        if not asked:
            return self.codes.sparkSession.createDataFrame([], form)
        sent = self.codes.sparkSession.sparkContext.broadcast(self._tables([v for _, v in asked]))
        qids, kinds = [q for q, _ in asked], [to_arrow_type(f.dataType) for f in form]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = sent.value
            best = np.full((keep, len(qids)), -np.inf, np.float32)
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    scores = _scores(batch.column(1), tables)
                    # Rows at a question's keep-th best so far stay, since ties go by key.
                    best = np.partition(np.concatenate([best, scores]), len(scores), axis=0)[len(scores) :]
                    row, question = np.nonzero(scores >= best.min(axis=0))
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array([qids[n] for n in question.tolist()], kinds[0]), batch.column(0).take(pa.array(row)), pa.array(scores[row, question].astype(np.float64), kinds[2])], names=form.names)

        return self.codes.mapInArrow(run, form)

    def search(self, queries: DataFrame, k: int, keep: int | None = None) -> DataFrame:
        """qid, the record, score and rank from 0, as index.search() has them, among the keep best by code."""
        near = self.candidates(queries, keep or self.keep or 20 * k)
        asked = queries.select("qid", V.normalised(F.col("vector")).alias("asked"))
        # Questions times keep rows meet the records, by key.
        met = self.records.join(near.join(asked, "qid"), "_key").withColumn("score", F.round(V.dot(F.col("unit"), F.col("asked")), index.DIGITS))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "_key")
        return met.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("qid", *self.records.columns, "score", "rank")

    def behind(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        """qid, _key, place: where hits (qid, _key) lie in the order by code, counted from 1. One pass over the codes."""
        asked = self._asked(queries)
        place = {q: n for n, (q, _) in enumerate(asked)}
        rows = [(r["qid"], r["_key"], r["code"]) for r in hits.join(self.codes, "_key").collect()]
        if not rows:
            return hits.limit(0).withColumn("place", F.lit(0).cast("long"))
        tables = self._tables([v for _, v in asked])
        own = np.array([_scores(pa.array([code], pa.binary()), tables)[0, place[q]] for q, _, code in rows])
        of = np.array([place[q] for q, _, _ in rows])
        sent = self.codes.sparkSession.sparkContext.broadcast((tables, own, of))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, own, of = sent.value
            above = np.zeros(len(own), np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    above += (_scores(whole.column(1).slice(at, 1024), tables)[:, of] >= own).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int32()), pa.array(above)], names=["n", "place"])

        counted = {r["n"]: r["place"] for r in self.codes.mapInArrow(run, "n int, place long").groupBy("n").agg(F.sum("place").alias("place")).collect()}
        return self.codes.sparkSession.createDataFrame([(q, key, counted[n]) for n, (q, key, _) in enumerate(rows)], S.StructType([queries.schema["qid"], self.codes.schema["_key"], S.StructField("place", S.LongType())]))


def build(records: DataFrame, dim: int, parts: int = PARTS, codes: int = CODES, k: int = 10, recall: float = 0.97, asked: int = 64, seed: int = 7) -> Codes:
    """records (see index.added) with product codes for every one of them. How many of the best by code are compared exactly is measured: for some records
    as questions the k nearest are found exactly, and so many of the order by code are kept as hold the stated share of them."""
    records = stored(records, "records")
    centres = books(records, dim, parts, codes, seed=seed)
    made = Codes(records, stored(coded(records, centres), "codes"), centres)
    queries = records.where(F.size("unit") == dim).orderBy(F.xxhash64(F.lit(seed + 1), "_key"), "_key").limit(asked).select(F.col("_key").alias("qid"), F.col("unit").alias("vector"))
    queries = stored(queries, "asked")
    got = made.behind(queries, index.search(records, queries, k).select("qid", "_key")).agg(F.expr(f"percentile_disc({recall}) within group (order by place)").alias("n")).first()
    made.keep = max(k, int(got["n"] or k))
    return made
