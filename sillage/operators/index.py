"""The vector index: a table of records with normalised vectors, its changes, exact and approximate search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from sillage.functions import text as T
from sillage.functions import vectors as V
from sillage.sources.tables import stored

VERSION = 1
#: Numbers of a set of queries that go to every task (32 MB), and digits to which scores are compared unless told otherwise.
MOST_ASKED, DIGITS = 4_000_000, 12
#: Numbers of a block of records and of a block of questions that meet in one task.
ROWS_CELL, ASKED_CELL = 4_000_000, 1_000_000
#: Kinds of index; flat searches exactly, the others look into the nearest cells only.
KINDS = ("flat", "hnsw", "ivf_flat", "ivf_pq")


def create(kind: str = "flat") -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown index type {kind!r}; known: {', '.join(KINDS)}")
    return kind


def added(records: DataFrame, id_col: str = "id", vector_col: str = "embedding", url_keys: bool = False) -> DataFrame:
    """Records with _key and unit. Keys are the records' own ids; url_keys takes the URL first, and then the last record of a URL stands for all."""
    given = [c for c in (["_key", "url", id_col] if url_keys else ["_key", id_col, "url"]) if c in records.columns]
    keyed = records.withColumn("_key", F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in given)))
    made = keyed.withColumn("unit", V.normalised(F.col(vector_col)))
    if not url_keys:
        return made
    last = Window.partitionBy("_key").orderBy(F.desc(id_col))
    return made.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def search(index: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0, sent: int | None = None, digits: int = DIGITS) -> DataFrame:
    """qid, the record, score (cosine) and rank from 0: the k nearest records of each query, ties by key, those below the threshold cut after.
    Scores are rounded to digits before they are compared, with each other and with the threshold.

    queries (qid, vector) is a stated set against all rows. Up to sent (MOST_ASKED) numbers of it go to every task, which multiplies its records
    with them a batch at a time and keeps rows that are among its own k best of a query so far, so that what is shuffled grows with
    queries and tasks, not with records. A larger set meets the records block by block (see _gridded). Records without a
    vector, or with one of another length, are near nothing; so is a query without one.
    """
    if k <= 0:
        return index.limit(0).select(F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), *index.columns, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    asked = queries.select("qid", V.normalised(F.col("vector")).alias("asked"))
    numbers = asked.agg(F.coalesce(F.sum(F.greatest(F.size("asked"), F.lit(1))), F.lit(0)).alias("n")).first()["n"]
    near = (_multiplied if numbers <= (MOST_ASKED if sent is None else sent) else _gridded)(index, asked, k, digits)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "_key")
    hits = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
    return hits.where(F.col("score") >= threshold) if threshold > 0 else hits


def _gridded(index: DataFrame, asked: DataFrame, k: int, digits: int) -> DataFrame:
    """qid, the record and score of all pairs that may be among the k best, for sets of questions too large for every task.

    Records and questions are dealt into blocks by hash, ROWS_CELL and ASKED_CELL numbers large, and every block of records meets every
    block of questions in a cell of its own, which multiplies them as matrices and hands on its own k best of each question. So a
    task holds two blocks, however many questions there are, and a record is shuffled once for each block of questions.
    """
    sizes = lambda df, c: df.agg(F.coalesce(F.sum(F.greatest(F.size(c), F.lit(1)).cast("long")), F.lit(1)).alias("n")).first()["n"]
    across, down = (max(1, -(-sizes(df, c) // most)) for df, c, most in ((asked, "asked", ASKED_CELL), (index, "unit", ROWS_CELL)))
    names = [f"c{n}" for n in range(len(index.columns))]
    dealt = lambda df, of, other, own, n, m: df.withColumn(own, F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    rows = dealt(index.toDF(*names), [names[index.columns.index("_key")]], "_across", "_down", down, across)
    questions = dealt(asked, ["qid"], "_down", "_across", across, down)
    return _blocks_met(index, rows, questions, ("_down", "_across"), k, digits)


def _blocks_met(index: DataFrame, rows: DataFrame, questions: DataFrame, by: tuple[str, ...], k: int, digits: int) -> DataFrame:
    """qid, the record and score of the k best of each question in each block: rows (index, its columns named c0 on) and questions (qid, asked), dealt by the columns by, each block a matrix product."""
    names, unit = [f"c{n}" for n in range(len(index.columns))], index.columns.index("unit")
    schema = S.StructType([questions.schema["qid"], *(S.StructField(n, f.dataType) for n, f in zip(names, index.schema, strict=True)), S.StructField("score", S.DoubleType())])
    kind = to_arrow_type(questions.schema["qid"].dataType)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        body = left.select(names).combine_chunks()
        vectors, wanted = (t.column(c).combine_chunks() for t, c in ((left, f"c{unit}"), (right, "asked")))
        long, long_asked = (pc.list_value_length(v).fill_null(-1).to_numpy(zero_copy_only=False) for v in (vectors, wanted))
        picked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(long_asked[long_asked > 0]).tolist():
            usable, of = np.flatnonzero(long == size), np.flatnonzero(long_asked == size)
            matrix = wanted.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).T
            best = np.full((k, len(of)), -np.inf)
            for at in range(0, len(usable), 512):
                some = usable[at : at + 512]
                scores = np.round(vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) @ matrix, digits)
                best = np.partition(np.concatenate([best, scores]), len(scores), axis=0)[len(scores) :]
                row, question = np.nonzero(scores >= best.min(axis=0))
                picked.append((some[row], of[question], scores[row, question]))
            least = np.full(len(long_asked), -np.inf)
            least[of] = best.min(axis=0)
            picked = [(r[keep], q[keep], s[keep]) for r, q, s in picked for keep in [(long_asked[q] != size) | (s >= least[q])]]
        row, question, score = (np.concatenate([p[n] for p in picked]) if picked else np.zeros(0, t) for n, t in enumerate((np.int64, np.int64, np.float64)))
        kept = body.take(pa.array(row))
        return pa.table([right.column("qid").take(pa.array(question)).cast(kind), *kept.columns, pa.array(score)], names=["qid", *names, "score"])

    return rows.groupBy(*by).cogroup(questions.groupBy(*by)).applyInArrow(cell, schema).toDF("qid", *index.columns, "score")


def _multiplied(index: DataFrame, asked: DataFrame, k: int, digits: int) -> DataFrame:
    """qid, the record and score of all pairs that may be among the k best."""
    rows = [r for r in asked.collect() if r["asked"]]
    names, unit = [f"c{n}" for n in range(len(index.columns))], index.columns.index("unit")
    kind = to_arrow_type(asked.schema["qid"].dataType)
    by_size: dict[int, list[int]] = {}
    for n, r in enumerate(rows):
        by_size.setdefault(len(r["asked"]), []).append(n)
    sent = index.sparkSession.sparkContext.broadcast([(size, np.array(of), np.array([rows[n]["asked"] for n in of], float).T) for size, of in by_size.items()])
    qids = [r["qid"] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(qids), k), -np.inf)
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                vectors = batch.column(unit)
                sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
                for size, of, matrix in sent.value:
                    usable = np.flatnonzero(sizes == size)
                    if not len(usable):
                        continue
                    scores = np.round(vectors.take(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) @ matrix, digits)
                    # Rows at a query's k-th best so far stay, since ties go by key.
                    top = np.sort(np.concatenate([best[of].T, scores]), axis=0)[-k:]
                    best[of] = top.T
                    row, query = np.nonzero(scores >= top[0])
                    if len(row):
                        kept = batch.take(pa.array(usable[row]))
                        yield pa.RecordBatch.from_arrays([pa.array([qids[n] for n in of[query].tolist()], kind), *kept.columns, pa.array(scores[row, query], pa.float64())], names=["qid", *names, "score"])

    schema = S.StructType([asked.schema["qid"], *(S.StructField(n, f.dataType) for n, f in zip(names, index.schema, strict=True)), S.StructField("score", S.DoubleType())])
    return index.toDF(*names).mapInArrow(run, schema).toDF("qid", *index.columns, "score")


def cells(index: DataFrame, n_cells: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """index with its cell, and the cells' centres (cell, centre), by k-means over at most 100,000 sampled vectors. Records without a vector, or
    with one of another length than most, are in no cell."""
    spark = index.sparkSession
    dim = index.agg(F.mode(F.when(F.size("unit") > 0, F.size("unit")), True).alias("n")).first()["n"]
    if not dim:
        return index.limit(0).withColumn("cell", F.lit(0)), spark.createDataFrame([], "cell int, centre array<double>")
    index = index.where(F.size("unit") == dim)
    total = index.count()
    sample = index.sample(False, min(1.0, 100_000 / max(total, 1)), seed).select(array_to_vector("unit").alias("features"))
    model = KMeans(k=max(1, min(n_cells, total)), seed=seed, maxIter=10).fit(sample)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    placed = model.transform(index.withColumn("features", array_to_vector("unit"))).withColumnRenamed("prediction", "cell").drop("features")
    return placed, centres


def search_cells(placed: DataFrame, centres: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """search() within the probes nearest cells of each query, instead of all rows.

    The records of a cell meet the queries that look into it as matrices, each cell in tasks of its own: large ones are dealt into blocks of ROWS_CELL
    numbers by hash, very many queries into blocks of ASKED_CELL.
    """
    asked = queries.select("qid", V.normalised(F.col("vector")).alias("asked"))
    closest = Window.partitionBy("qid").orderBy(F.desc(V.dot(F.col("centre"), F.col("asked"))), "cell")
    probed = asked.crossJoin(F.broadcast(centres)).withColumn("n", F.row_number().over(closest)).where(F.col("n") <= probes).select("qid", "asked", "cell")
    down, across = (
        max(1, -(-int(df.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]) // most))
        for df, most in ((placed.groupBy("cell").agg(F.sum(F.size("unit").cast("long")).alias("n")), ROWS_CELL), (asked.agg(F.sum(F.size("asked").cast("long")).alias("n")), ASKED_CELL))
    )
    index = placed.drop("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = placed.select(*(F.col(c).alias(f"c{n}") for n, c in enumerate(index.columns)), "cell", F.pmod(F.xxhash64("_key"), F.lit(down)).cast("int").alias("_down"), every(across).alias("_across"))
    dealt = probed.withColumn("_across", F.pmod(F.xxhash64("qid"), F.lit(across)).cast("int")).withColumn("_down", every(down))
    near = _blocks_met(index, rows, dealt, ("cell", "_down", "_across"), k, DIGITS)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "_key")
    return near.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def deleted(index: DataFrame, keys: DataFrame) -> DataFrame:
    """index without the keys of a table (_key); unknown keys change nothing."""
    return index.join(keys.select("_key").distinct(), "_key", "left_anti")


def updated(index: DataFrame, changes: DataFrame) -> DataFrame:
    """index with the records of changes in place of those of the same key; keys it does not have are not added."""
    known = changes.join(index.select("_key"), "_key", "left_semi").select(*index.columns)
    return deleted(index, known).unionByName(known)


def require(index: DataFrame, key: str) -> None:
    """KeyError unless the index has the key."""
    if index.where(F.col("_key") == key).isEmpty():
        raise KeyError(key)


def id_of(index: DataFrame, key: str) -> int:
    """The number of a key (blake2b of eight bytes), -1 where the index lacks it."""
    got = index.where(F.col("_key") == key).select(T.key_hash("_key").alias("n")).first()
    return -1 if got is None else got["n"]


@dataclass
class Cells:
    """An index cut into cells, in the shared folder: records with their cell, the cells' centres, and how many cells a query looks into."""

    placed: DataFrame
    centres: DataFrame
    probes: int

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search_cells(self.placed, self.centres, queries, k, self.probes)


def build(index: DataFrame, n_cells: int | None = None, k: int = 10, recall: float = 0.95, asked: int = 64, seed: int = 7) -> Cells:
    """index as Cells: every record is placed; the square root of their number makes the cells, 1024 at most, unless given.

    Probes are measured, not guessed: for some records as queries (asked of them, by hash) the k nearest are found exactly, and the
    cells that hold them are ranked by how near their centres are to the query; probes reach as many of them as recall says. So
    recall follows the data: vectors without clusters need most cells, and clustered ones a few.
    """
    total = index.count()
    n_cells = n_cells or max(1, min(1024, round(total**0.5)))
    placed, centres = cells(index, n_cells, seed)
    placed = stored(placed, "cells")
    queries = placed.orderBy(F.xxhash64(F.lit(seed), "_key"), "_key").limit(asked).select(F.col("_key").alias("qid"), F.col("unit").alias("vector"))
    queries = stored(queries, "asked")
    near = search(placed, queries, k).select("qid", "cell")
    # asked * n_cells rows.
    order = Window.partitionBy("qid").orderBy(F.desc(V.dot(F.col("centre"), V.normalised(F.col("vector")))), "cell")
    ranks = queries.crossJoin(F.broadcast(centres)).withColumn("n", F.row_number().over(order)).select("qid", "cell", "n")
    got = near.join(F.broadcast(ranks), ["qid", "cell"]).agg(F.expr(f"percentile_disc({recall}) within group (order by n)").alias("n")).first()
    return Cells(placed, centres, int(got["n"] or 1))


def find(index: DataFrame | Cells, queries: DataFrame, k: int, kind: str = "flat", n_cells: int | None = None, probes: int | None = None) -> DataFrame:
    """search() by kind: exact for flat, within the nearest cells for ivf_flat, by product codes for ivf_pq (see codes.Codes), along a graph
    of neighbours for hnsw (see graph.Graph). What a kind needs is made anew; build it once, and search it, for more than one set of queries.
    """
    if create(kind) == "flat":
        return search(index.placed if isinstance(index, Cells) else index, queries, k)
    if kind == "ivf_flat":
        made = index if isinstance(index, Cells) else build(index, n_cells, k)
        return search_cells(made.placed, made.centres, queries, k, probes or made.probes)
    from sillage.operators import codes, graph

    records = index.placed.drop("cell") if isinstance(index, Cells) else index
    if kind == "hnsw":
        return graph.build(records).search(queries, k)
    dim = records.agg(F.coalesce(F.mode(F.when(F.size("unit") > 0, F.size("unit")), True), F.lit(0)).alias("n")).first()["n"]
    if not dim:
        return search(records, queries, k)
    return codes.build(records, dim, next(p for p in (codes.PARTS, 4, 2, 1) if dim % p == 0), k=k).search(queries, k)
