"""Centroid clustering by annulus search: exact k-means of whole-number vectors, comparing only centroids of fitting length."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm.common import forget, read, stored

#: Steps to which components are floored, centroids, rounds, and what is put before an id where the first centroids are drawn.
STEPS, CENTROIDS, ROUNDS, SEED = 64, 16, 3, "1:"
#: Greatest absolute component after scaling: squared distances of 64 of these still fit a long.
LARGEST = 1 << 27
#: Pairs of a vector and a centroid that are compared at a time.
PAIRS = 1 << 14

_PLACED = "vec_id long, v array<int>, cluster int, distance long, compared int"


def whole_vectors(vectors: DataFrame, dim: int, steps: int = STEPS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(steps * x) of every component, of vectors with dim components, none null, infinite or no number. Others drop out.

    A component beyond LARGEST is an error, since its squared distances fit no long.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fit = (F.size(x) == dim) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    scaled = F.transform(x, lambda c: F.when(F.abs(c * steps) <= LARGEST, F.floor(c * steps).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {steps}")).cast("int")))
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def annulus(x: np.ndarray, last: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of x its nearest centroid (ties: the smaller number), the squared distance, and how many centroids it was compared with.

    A centroid nearer to a vector than the bound u differs from it in length by u at most. The bound is the distance to the
    centroid that was nearest last (below 0: that of the nearest length); centroids lie sorted by length, so those within
    the annulus are found by two binary searches. Lengths are rounded, so its edges are widened by more than rounding can
    move them: what lies on an edge is compared. Comparisons are in whole numbers.
    """
    lengths = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(lengths, kind="stable")
    lengths = lengths[order]
    own = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    first = order[np.minimum(np.searchsorted(lengths, own), len(order) - 1)]
    known = np.where(last >= 0, last, first)
    bound = np.sqrt(((x - centroids[known]) ** 2).sum(axis=1).astype(np.float64))
    slack = 1e-9 * (own + bound) + 1e-6
    lo, hi = np.searchsorted(lengths, own - bound - slack, "left"), np.searchsorted(lengths, own + bound + slack, "right")
    compared = hi - lo
    nearest, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    ends = np.cumsum(compared)
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = compared[at:to]
        starts = np.cumsum(n) - n
        row = np.repeat(np.arange(at, to), n)
        place = np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(lo[at:to], n)
        number = order[place]
        d = ((x[row] - centroids[number]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(d, starts)
        distance[at:to] = least
        nearest[at:to] = np.minimum.reduceat(np.where(d == np.repeat(least, n), number, len(order)), starts)
        at = to
    return nearest, distance, compared


def _assign(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                last = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                nearest, distance, compared = annulus(_rows(batch.column(1), centroids.shape[1]), last, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest, pa.int32()), pa.array(distance, pa.int64()), pa.array(compared, pa.int32())], names=["vec_id", "v", "cluster", "distance", "compared"])

    return run


def _sums(dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """cluster, n, sums of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False)
            n += np.bincount(at, minlength=k)
            np.add.at(sums, at, _rows(batch.column(0), dim))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


@dataclass
class Clusters:
    """placed (vec_id, v, cluster, distance, compared) in the shared folder, and the centroids by number."""

    placed: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, dim: int, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> Clusters:
    """Exact k-means of vectors (vec_id, v): rounds of assigning and of moving centroids to floor(sum / count), then once more assigned.

    First centroids are the k vectors of least sha256(seed and id), in that order; equal hashes go by components, null ids come last. Fewer
    vectors than k make fewer centroids; empty clusters stay where they are. Rows that repeat count each; no vectors give no rows.

    Vectors are assigned where they lie, so no cluster's rows ever meet in a task. A round shuffles each task's sums alone, and
    what reaches the driver is k times dim sums. Each round is stored, so a lost executor costs a round's tasks.
    """
    drawn = vectors.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in drawn], np.int64).reshape(len(drawn), dim)
    start = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("compared"))
    if not drawn:
        return Clusters(start, centroids)
    placed = stored(start, "vectors")
    for n in range(rounds + 1):
        last, placed = placed, stored(placed.mapInArrow(_assign(centroids), _PLACED), "placed")
        forget(last)
        if n == rounds:
            break
        sums = placed.select("v", "cluster").mapInArrow(_sums(dim, len(centroids)), "cluster int, n long, sums array<long>")
        added = sums.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))
        for r in added.collect():
            centroids[r["cluster"], r["place"]] = r["part"] // r["n"]
    return Clusters(placed, centroids)


def summed(made: Clusters) -> DataFrame:
    """vec_id, cluster, distance, compared, and each cluster's inertia, that of all, and a digest of its centroid. k rows are broadcast."""
    by = {r["cluster"]: r["n"] for r in made.placed.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made.centroids.tolist()]
    rows = [(c, n, sum(by.values()), digest[c]) for c, n in by.items()]
    of = made.placed.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.placed.drop("v").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(cluster(whole_vectors(read(spark, sf_dir, "embeddings"), 64), 64)).drop("compared")


def _sql() -> str:
    steps = [
        f"kept as materialized (select vec_id, list_transform(embedding, lambda x: floor({STEPS} * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select row_number() over (order by h) - 1 as cluster, v as c from (select v, sha256('{SEED}' || vec_id) as h from kept order by h limit {CENTROIDS}))",
    ]
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint"
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} as materialized (select vec_id, any_value(v) as v, min((d, cluster)) as best from (select vec_id, v, cluster, {distance} as d from kept, c{n}) group by vec_id)")
        if n < ROUNDS:
            steps.append(f"""c{n + 1} as materialized (select cluster, coalesce(m.c, c{n}.c) as c from c{n} left join (select cluster, list(f order by i) as c from
  (select best[2] as cluster, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*))::bigint // count(*) as f from a{n}, range(1, 65) t(i) group by all) group by cluster) m using (cluster))""")
    return f"""with {", ".join(steps)}
select vec_id, best[2]::int as cluster, best[1] as distance, sum(best[1]) over (partition by best[2])::bigint as cluster_inertia, sum(best[1]) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} on cluster = best[2]"""


OP13_SQL = _sql()
