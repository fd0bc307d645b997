"""A graph of nearest neighbours, made by comparing the records of overlapping cells as matrices, and searched by walking it a frontier at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillage.functions import vectors as V
from sillage.operators import index
from sillage.sources.tables import remove_stored, stored

#: Neighbours of a record, and far ones that keep the graph in one piece; rounds at most, and the share of changed links that ends them.
DEGREE, FAR, ROUNDS, SETTLED = 16, 4, 12, 0.01
#: Best records that a question's walk keeps in view where build() finds no need for more, those whose links it follows in a step (a quarter of them, unless told), where it starts, and steps at most.
BEAM, STARTS, STEPS = 32, 16, 60
#: Beams that build() tries, the recall it asks of them, of how many nearest, for how many records.
BEAMS, RECALL, NEAREST, TRIED = (32, 64, 128, 256, 512, 1024), 0.95, 10, 64
#: Records that are put in a random order together.
DRAWN = 10_000
#: What single precision may be off by in a score.
OFF = 1e-5


def _drawn(nodes: DataFrame, n: int, total: int, seed: int) -> DataFrame:
    """src, dst: n others for each node, each the next in a random order of its own."""
    each = nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("turn")).withColumn("of", F.pmod(F.xxhash64(F.lit(seed), "turn", "id"), F.lit(max(1, total // DRAWN))))
    ring = Window.partitionBy("turn", "of").orderBy(F.xxhash64(F.lit(seed + 1), "turn", "id"), "id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return each.select(F.col("id").alias("src"), F.coalesce(F.lead("id").over(ring), F.first("id").over(whole)).alias("dst")).where("src <> dst").distinct()


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _placed(nodes: DataFrame, centres: np.ndarray) -> DataFrame:
    """nodes (id, unit) with the cell whose centre is nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = np.argmax(_matrix(b.column(1), b.num_rows) @ centres.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["id", "unit", "cell"])

    return nodes.mapInArrow(run, "id long, unit array<float>, cell int") if len(centres) > 1 else nodes.withColumn("cell", F.lit(0))


def _nearest(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the n best of each row, and of few more."""
    # The n-th best of the best of n groups or more is a bound that no n-th best falls below: only groups that reach it are looked into.
    wide = max(1, scores.shape[1] // (32 * n))
    main = scores.shape[1] // wide * wide
    groups = scores[:, :main].reshape(len(scores), -1, wide)
    tops = groups.max(axis=2)
    if tops.shape[1] <= n:
        return np.nonzero(np.ones(scores.shape, bool))
    bound = np.partition(tops, -n, axis=1)[:, -n]
    row, group = np.nonzero(tops >= bound[:, None])
    at, within = np.nonzero(groups[row, group] >= bound[row, None])
    last, rest = np.nonzero(scores[:, main:] >= bound[:, None])
    i, j = np.concatenate([row[at], last]), np.concatenate([group[at] * wide + within, rest + main])
    # Rows with very many equals, as copies have them, are cut to n.
    many = np.bincount(i, minlength=len(scores)) > 64 * n
    if not many.any():
        return i, j
    cut = np.argpartition(scores[many], -n, axis=1)[:, -n:]
    few = ~many[i]
    return np.concatenate([i[few], np.repeat(np.flatnonzero(many), n)]), np.concatenate([j[few], cut.ravel()])


def _met(degree: int) -> Callable[[pa.Table], pa.Table]:
    """src, dst, score: the degree nearest others in a block of records (id, unit, mine) of those that are mine."""

    def run(block: pa.Table) -> pa.Table:
        ids, units = block.column("id").to_numpy(), _matrix(block.column("unit"), block.num_rows)
        mine, out = np.flatnonzero(block.column("mine").to_numpy()), []
        for at in range(0, len(mine), 256):
            some = mine[at : at + 256]
            scores = units[some] @ units.T
            scores[np.arange(len(some)), some] = -9
            i, j = _nearest(scores, degree)
            s = scores[i, j]
            order = np.lexsort((ids[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            keep = (np.arange(len(i)) - np.searchsorted(i, i) < degree) & (s > -9)
            out.append((ids[some[i[keep]]], ids[j[keep]], s[keep]))
        kinds = {"src": (pa.int64(), np.int64), "dst": (pa.int64(), np.int64), "score": (pa.float32(), np.float32)}
        return pa.table({c: pa.array(np.concatenate([o[n] for o in out]) if out else np.zeros(0, kind), t) for n, (c, (t, kind)) in enumerate(kinds.items())})

    return run


def _best(edges: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def neighbours(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, settled: float = SETTLED, seed: int = 7) -> DataFrame:
    """src, dst, score (in single precision): about the degree nearest others of each node (id, unit).

    In a round the nodes are cut into cells around records at random, a cell for each index.ROWS_CELL numbers, and all of a cell are compared with each other
    as matrices; each node keeps its best of all rounds, whose cells differ. It ends when few links change, and a single cell is exact at
    once. Cells that hold more numbers, as around copies, are dealt into blocks by hash. So a round shuffles a node's vector, once or as
    often as spreads few cells over all cores, and its links; a task holds one block. Rounds are stored.
    """
    nodes = nodes.select("id", F.col("unit").cast("array<float>").alias("unit"))
    sizes = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("unit")), F.lit(1)).alias("dim")).first()
    most = max(2, index.ROWS_CELL // max(1, sizes["dim"]))
    n_cells = max(1, -(-sizes["n"] // most))
    across = max(1, nodes.sparkSession.sparkContext.defaultParallelism // n_cells)
    edges = None
    for turn in range(rounds):
        # As many rows as there are cells: a record of each most ones.
        centres = nodes.orderBy(F.xxhash64(F.lit(seed + turn), "id"), "id").limit(n_cells).collect() if n_cells > 1 else []
        placed = _placed(nodes, np.array([r["unit"] for r in centres], np.float32))
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(seed + turn), "id"), F.col("parts")))
        spread = dealt.withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("mine", F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(across)) == F.col("across"))
        found = spread.select("cell", "part", "across", "id", "unit", "mine").groupBy("cell", "part", "across").applyInArrow(_met(degree), "src long, dst long, score float").withColumn("fresh", F.lit(True))
        both = found if edges is None else edges.withColumn("fresh", F.lit(False)).union(found)
        last, edges = edges, stored(_best(both.repartition("src").groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh")), degree), "edges")
        if last is not None:
            remove_stored(last)
        if n_cells == 1 or edges.where("fresh").count() <= settled * sizes["n"] * degree:
            break
    return edges


def _compared(block: pa.Table, reached: pa.Table) -> pa.Table:
    """qid, id, score of pairs reached (qid, id), each once, that are no worse than a question's worst; block has the nodes and questions they are of (id, qid, unit, worst)."""
    kinds = {"qid": reached.column("qid").type, "id": pa.int64(), "score": pa.float32()}
    if not reached.num_rows:
        return pa.table({c: pa.array([], t) for c, t in kinds.items()})
    asks = block.column("id").is_null().to_numpy()
    units = _matrix(block.column("unit"), block.num_rows)
    number, worst = block.column("id").fill_null(-1).to_numpy(), block.column("worst").to_numpy()
    nodes = np.flatnonzero(~asks)
    nodes = nodes[np.argsort(number[nodes])]
    questions = np.flatnonzero(asks)
    qids = block.column("qid").take(pa.array(questions)).combine_chunks()
    pair_q = pc.index_in(reached.column("qid"), value_set=qids).to_numpy()
    pair_n = np.searchsorted(number[nodes], reached.column("id").to_numpy())
    pairs = np.unique(pair_q.astype(np.int64) * len(nodes) + pair_n)
    q, n = pairs // len(nodes), pairs % len(nodes)
    scores = np.concatenate([np.einsum("ij,ij->i", units[nodes[n[s : s + 16384]]], units[questions[q[s : s + 16384]]]) for s in range(0, len(pairs), 16384)])
    keep = scores >= worst[questions[q]]
    return pa.table({"qid": qids.take(pa.array(q[keep])), "id": number[nodes[n[keep]]], "score": scores[keep]})


@dataclass
class Graph:
    """An index as a graph in the shared folder: records with their node, each node's links, and the records that a walk keeps in view."""

    records: DataFrame
    links: DataFrame
    dim: int
    total: int
    beam: int = BEAM

    def walk(self, queries: DataFrame, beam: int | None = None, step: int | None = None, starts: int = STARTS, steps: int = STEPS) -> DataFrame:
        """qid, id, score (in single precision): all that is compared for each question until none of its beam best has links to follow."""
        compared = []
        self._walked(queries, beam, step, starts, steps, compared)
        out = compared[0]
        for more in compared[1:]:
            out = out.union(more)
        return out.distinct()

    def _walked(self, queries: DataFrame, beam: int | None = None, step: int | None = None, starts: int = STARTS, steps: int = STEPS, compared: list[DataFrame] | None = None) -> DataFrame:
        """qid, id, score: the beam best that a walk meets for each question (qid, vector, and beam where each has its own).

        A step is for all questions at once. The links of the best records not followed yet go to the blocks that have the nodes they lead to, and
        meet them and the questions there; what is no worse than a question's worst in view goes on. So no vector travels with a pair, and what is
        held and stored is what is in view: a record that fell out of it can't come back, and one in it is followed once.
        """
        own = F.col("beam") if "beam" in queries.columns else F.lit(beam or self.beam)
        nodes = self.records.select(F.col("_node").alias("id"), F.col("unit").cast("array<float>").alias("unit"))
        asked = queries.select("qid", V.normalised(F.col("vector")).cast("array<float>").alias("asked"), own.alias("beam")).where(F.size("asked") == self.dim)
        asked = stored(asked.withColumn("step", F.lit(step) if step else F.ceil(F.col("beam") / 4)), "asked")
        blocks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-self.total * self.dim // index.ROWS_CELL))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("block")
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        no_qid = F.lit(None).cast(asked.schema["qid"].dataType).alias("qid")
        sides = nodes.select(block("id"), "id", no_qid, "unit", F.lit(None).cast("float").alias("worst"))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        kept = f"qid {asked.schema['qid'].dataType.simpleString()}, id long, score float"

        def view(met: DataFrame) -> DataFrame:
            """The best of rows (qid, id, score, open), go on those to follow next."""
            once = met.repartition("qid").groupBy("qid", "id").agg(F.max("score").alias("score"), F.min("open").alias("open"))
            best = once.join(asked.select("qid", "beam", "step"), "qid").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("beam"))
            go = F.col("open") & (F.sum(F.col("open").cast("int")).over(until) <= F.col("step"))
            return stored(best.withColumn("go", go).select("qid", "id", "score", "open", "go", (F.col("_n") == F.col("beam")).alias("full")), "view")

        # starts rows for each question.
        first = nodes.orderBy(F.xxhash64(F.lit(11), "id")).limit(starts)
        begun = stored(asked.crossJoin(F.broadcast(first)).select("qid", "id", V.dot(F.col("unit"), F.col("asked")).cast("float").alias("score")), "compared")
        seen = view(begun.withColumn("open", F.lit(True)))
        if compared is not None:
            compared.append(begun)
        for _ in range(steps):
            front = seen.where("go")
            if front.isEmpty():
                break
            reached = front.join(self.links, "id").select("qid", F.explode("others").alias("id")).select(block("id"), "qid", "id")
            worst = F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst") if compared is None else F.lit(-2.0).cast("float").alias("worst")
            alive = asked.join(front.select("qid").distinct(), "qid", "left_semi").join(seen.where("full").select("qid", F.col("score").alias("worst")), "qid", "left")
            wanted = alive.select(everywhere, F.lit(None).cast("long").alias("id"), "qid", F.col("asked").alias("unit"), worst)
            fresh = sides.union(wanted).groupBy("block").cogroup(reached.groupBy("block")).applyInArrow(_compared, kept)
            if compared is not None:
                fresh = stored(fresh, "compared")
                compared.append(fresh)
            followed = seen.select("qid", "id", "score", (F.col("open") & ~F.col("go")).alias("open"))
            last, seen = seen, view(followed.union(fresh.withColumn("open", F.lit(True))))
            remove_stored(last)
        return seen.select("qid", "id", "score")

    def search(self, queries: DataFrame, k: int, beam: int | None = None) -> DataFrame:
        """qid, the record, score and rank from 0, as index.search() has them, among what a walk has in view at its end.

        Those that single precision leaves among the k best are scored anew in double.
        """
        least = Window.partitionBy("qid").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = self._walked(queries, max(beam or self.beam, k)).withColumn("k", F.element_at(F.collect_list("score").over(least), F.least(F.lit(k), F.count("*").over(least)).cast("int")))
        near = met.where(F.col("score") >= F.col("k") - OFF).select("qid", F.col("id").alias("_node"))
        asked = queries.select("qid", V.normalised(F.col("vector")).alias("_asked"))
        hits = self.records.join(near, "_node").join(asked, "qid").withColumn("score", F.round(V.dot(F.col("unit"), F.col("_asked")), index.DIGITS))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "_key")
        return hits.select("qid", *self.records.drop("_node").columns, "score").withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)

    def measured(self, seed: int = 7) -> dict[int, float]:
        """The recall of each of BEAMS for TRIED records as questions, by hash: of their NEAREST nearest, found exactly."""
        tried = self.records.orderBy(F.xxhash64(F.lit(seed), "_key"), "_key").limit(TRIED).select(F.col("_node").alias("of"), F.col("unit").alias("vector"))
        tried = stored(tried, "tried")
        exact = stored(index.search(self.records, tried.withColumnRenamed("of", "qid"), NEAREST).select(F.col("qid").alias("of"), F.col("_node").alias("id")), "exact")
        # TRIED * len(BEAMS) questions walk at once, told apart by number.
        each = stored(tried.select("of", "vector", F.posexplode(F.array(*map(F.lit, BEAMS))).alias("n", "beam")).withColumn("qid", F.col("of") * len(BEAMS) + F.col("n")), "each")
        met = self._walked(each)
        best = met.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= NEAREST)
        hit = best.join(F.broadcast(each.select("qid", "of", "beam")), "qid").join(F.broadcast(exact), ["of", "id"]).groupBy("beam").count().collect()
        want = exact.count()
        remove_stored(tried, exact, each)
        return {r["beam"]: r["count"] / want for r in hit}


def build(records: DataFrame, degree: int = DEGREE, far: int = FAR, seed: int = 7) -> Graph:
    """records (see index.added) as a Graph. Links are a node's neighbours, degree of those it is a neighbour of, and far ones at random.
    The beam is measured, not guessed: the smallest of BEAMS that finds RECALL of the nearest of some records, else the largest.
    Records whose vector is missing, or of another length than most, are near nothing and not in it."""
    dim = records.agg(F.coalesce(F.mode(F.when(F.size("unit") > 0, F.size("unit")), True), F.lit(0)).alias("n")).first()["n"]
    placed = stored(records.where(F.size("unit") == dim).withColumn("_node", F.monotonically_increasing_id()), "records")
    nodes, total = placed.select(F.col("_node").alias("id"), "unit"), placed.count()
    near = neighbours(nodes, degree, seed=seed)
    back = Window.partitionBy("dst").orderBy(F.desc("score"), "src")
    reverse = near.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= degree).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = near.select("src", "dst").union(reverse).union(_drawn(nodes, far, total, seed + 100))
    made = Graph(placed, stored(pairs.repartition("src").groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("others")), "links"), dim, total)
    if total:
        recall = made.measured(seed)
        made.beam = next((b for b in BEAMS if recall.get(b, 0) >= RECALL), BEAMS[-1])
    return made
