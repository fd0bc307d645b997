"""An inverted index in storage: postings by blocks of documents, each with the most that it can add to a score, so that blocks that can't matter are skipped."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from sillage.functions import text as T
from sillage.operators.bm25 import K1, B
from sillage.sources.tables import put_json, remove, remove_stored, stored, unique

#: Documents of a block, blocks that are scored together, folders that terms are dealt to, and questions that are scored at a time.
BLOCK, RANGE, FOLDERS, TOGETHER = 256, 64, 32, 512
#: Pairs of a question and one of its terms that go to every task.
MOST_ASKED = 1_000_000
#: Terms of a search up to which folders and terms are named to the scan.
NAMED = 200
_TABLES = {"postings": "term string, block long, places array<int>, parts array<double>, most double, folder int", "terms": "term string, df long, idf double, folder int"}
_TOKEN = re.compile("[a-z0-9_]{2,}")


def _blocks(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts (id, text) as blocks of BLOCK documents: a row for each term of a block, with the places, counts and lengths of the documents that
    have it, and one without a term for the block's ids and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held = [], []

        def whole() -> pa.RecordBatch:
            nonlocal number
            codes: dict[str, int] = {}
            code, place, count = ([] for _ in range(3))
            for n, found in enumerate(held):
                code += [codes.setdefault(t, len(codes)) for t in found]
                place += [n] * len(found)
                count += found.values()
            length = np.array([sum(found.values()) for found in held], np.int32)
            order = np.argsort(np.array(code, np.int64), kind="stable")
            place = np.array(place, np.int32)[order]
            ends = np.cumsum(np.bincount(np.array(code, np.int64), minlength=len(codes)))
            # The last row is the block's own.
            lists = lambda inner, own: pa.ListArray.from_arrays(pa.array([0, *ends.tolist(), len(inner) + own], pa.int32()), pa.array(np.concatenate([inner, length]) if own else inner, pa.int32()))
            columns = [pa.array([*codes, None], pa.string()), pa.array([number] * (len(codes) + 1), pa.int64()), lists(place, 0), lists(np.array(count, np.int32)[order], 0), lists(length[place], len(length)), pa.array([None] * len(codes) + [ids], pa.list_(kind))]
            number += 1
            return pa.RecordBatch.from_arrays(columns, names=["term", "block", "places", "counts", "lengths", "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = Counter(_TOKEN.findall((text or "").lower()))
                    if found:
                        ids.append(key)
                        held.append(found)
                    if len(ids) == BLOCK:
                        yield whole()
                        ids, held = [], []
        if ids:
            yield whole()

    return run


def _folder(term: str = "term"):  # noqa: ANN202
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


@dataclass
class Index:
    """postings (term, block, most, places, parts), terms (term, idf) and blocks (block, ids) under a folder, each written once."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        # Tables in folders of an empty index have no file that tells their columns.
        read = self.spark.read.schema(_TABLES[name]) if name in _TABLES else self.spark.read
        return read.parquet(f"{self.path}/{name}")

    def _named(self, name: str, terms: list[str]) -> DataFrame:
        """A table of terms; for few terms their folders alone are listed, and their rows read."""
        table = self.table(name)
        if len(terms) > NAMED:
            return table
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        folders = [r["f"] for r in asked.select(_folder().alias("f")).distinct().collect()]
        return table.where(F.col("folder").isin(folders)).where(F.col("term").isin(terms))

    def search(self, questions: DataFrame, k: int, digits: int = 9) -> DataFrame:
        """qid, id, score, rank from 0: the k best records of each question (qid, query), ties by id; scores rounded to digits before they are compared.

        No text is read: the postings of the asked terms are, by term. Those of RANGE blocks meet in a task, which takes blocks in order of the
        most that they can give, and leaves out, question by question, those that can't reach its k-th best any more. Exact, since a
        block's most is never less than what one of its documents gets.
        """
        kind = questions.schema["qid"]
        asked = questions.select("qid", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf")).limit(MOST_ASKED + 1).collect()
        if len(asked) > MOST_ASKED:
            raise ValueError(f"more than {MOST_ASKED} terms asked at once: search by fewer questions")
        qids = list(dict.fromkeys(r["qid"] for r in asked))
        place = {q: n for n, q in enumerate(qids)}
        terms = list(dict.fromkeys(r["term"] for r in asked))
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string")
        idf = {r["term"]: r["idf"] for r in self._named("terms", terms).join(wanted, "term", "left_semi").select("term", "idf").collect()}
        by_term: dict[str, list[tuple[int, float]]] = {}
        for r in asked:
            if r["term"] in idf:
                by_term.setdefault(r["term"], []).append((place[r["qid"]], r["qtf"] * idf[r["term"]]))
        sent = self.spark.sparkContext.broadcast({t: (np.array([q for q, _ in of]), np.array([w for _, w in of])) for t, of in by_term.items()})
        rows = self._named("postings", list(by_term)).join(wanted, "term", "left_semi").select(F.floor(F.col("block") / RANGE).alias("range"), "term", "block", "most", "places", "parts")

        def run(table: pa.Table) -> pa.Table:
            q, block, at, score, _ = scored(table, sent.value, len(qids), k, digits)
            return pa.table({"qid": pa.array([qids[n] for n in q.tolist()], to_arrow_type(kind.dataType)), "block": pa.array(block, pa.int64()), "at": pa.array(at, pa.int32()), "score": pa.array(score, pa.float64())})

        form = S.StructType([kind, S.StructField("block", S.LongType()), S.StructField("at", S.IntegerType()), S.StructField("score", S.DoubleType())])
        hits = rows.groupBy("range").applyInArrow(run, form)
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        named = hits.join(self.table("blocks"), "block").select("qid", F.get("ids", "at").alias("id"), "score")
        return named.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def scored(table: pa.Table, weights: dict[str, tuple[np.ndarray, np.ndarray]], n_asked: int, k: int, digits: int) -> tuple[np.ndarray, ...]:
    """question, block, place and score of all that may be among the k best, and how many pairs of a question and a block were scored."""
    table = table.combine_chunks().sort_by("block")
    term, block, most = table.column("term").to_pylist(), table.column("block").to_numpy(), table.column("most").to_numpy()
    places, parts = (table.column(c).combine_chunks() for c in ("places", "parts"))
    sizes = places.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    places, parts = places.flatten().to_numpy(zero_copy_only=False), parts.flatten().to_numpy(zero_copy_only=False)
    blocks, first = np.unique(block, return_index=True)
    last = np.append(first[1:], len(block))
    # Of each block the pairs of a question and one of its rows, and what the question can get there at most.
    met, bounds = [], np.zeros((len(blocks), n_asked))
    for n, (lo, hi) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        of = [weights[t] for t in term[lo:hi]]
        q, w = (np.concatenate([x[c] for x in of]) for c in range(2))
        row = np.repeat(np.arange(hi - lo), [len(x[0]) for x in of])
        met.append((q, w, row))
        bounds[n] = np.bincount(q, w * most[lo:hi][row], n_asked)
    best = np.full((n_asked, k), -np.inf) if k > 0 else np.zeros((n_asked, 0))
    least, out, pairs = np.zeros(n_asked), [], 0
    for n in np.argsort(-bounds.max(axis=1), kind="stable").tolist() if k > 0 else []:
        lo, hi, (q, w, row) = first[n], last[n], met[n]
        # What is rounded may rise by half a unit.
        asked = np.flatnonzero((bounds[n] > 0) & (bounds[n] * (1 + 1e-12) + 10.0**-digits >= least))
        pairs += len(asked)
        if not len(asked):
            continue
        matrix = np.zeros((hi - lo, BLOCK))
        start = ends[lo] - sizes[lo]
        matrix[np.repeat(np.arange(hi - lo), sizes[lo:hi]), places[start : ends[hi - 1]]] = parts[start : ends[hi - 1]]
        where = np.full(n_asked, -1)
        for at in range(0, len(asked), TOGETHER):
            some = asked[at : at + TOGETHER]
            where[some] = np.arange(len(some))
            mine = where[q] >= 0
            of = np.zeros((len(some), hi - lo))
            np.add.at(of, (where[q[mine]], row[mine]), w[mine])
            where[some] = -1
            scores = np.round(of @ matrix, digits)
            best[some] = np.sort(np.concatenate([best[some], scores], axis=1), axis=1)[:, -k:]
            least[some] = np.maximum(best[some, 0], 0)
            x, y = np.nonzero((scores > 0) & (scores >= least[some][:, None]))
            out.append((some[x], np.full(len(x), blocks[n]), y, scores[x, y]))
    if not out:
        return (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64)), pairs)
    q, b, p, s = (np.concatenate([o[c] for o in out]) for c in range(4))
    keep = s >= least[q]
    return q[keep], b[keep], p[keep], s[keep], pairs


def build(records: DataFrame, id_col: str = "id", text_col: str = "text", summary_col: str | None = None, path: str | None = None) -> Index:
    """An index of records under path (a folder of its own in the shared one, unless given). Every text is read once; an empty one gives way to the
    summary, and one without a token is in no posting and no total. Records that repeat an id are records of their own.

    Documents are numbered where they lie and make blocks there, so that what is shuffled is blocks' rows of terms. The settings file is written last:
    a folder without it is no index.
    """
    spark = records.sparkSession
    path = path or unique(spark, "postings")
    remove(spark, f"{path}/settings.json")
    text = F.coalesce(F.nullif(F.col(text_col), F.lit("")), F.col(summary_col)) if summary_col else F.col(text_col)
    texts = records.select(F.col(id_col).alias("id"), text.alias("text"))
    of_id = texts.schema["id"].dataType
    made = stored(texts.mapInArrow(_blocks(to_arrow_type(of_id)), f"term string, block long, places array<int>, counts array<int>, lengths array<int>, ids array<{of_id.simpleString()}>"), "blocks")
    own = made.where("term is null")
    sums = own.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)).alias("tokens")).first()
    n_docs, avgdl = sums["n"], (sums["tokens"] / sums["n"] if sums["n"] else 1.0)
    own.select("block", "ids").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    part = F.zip_with("counts", "lengths", lambda n, length: n * (K1 + 1) / (n + K1 * (1 - B + B * length / F.lit(avgdl))))
    rows = made.where("term is not null").select(_folder().alias("folder"), "term", "block", "places", part.alias("parts")).withColumn("most", F.array_max("parts"))
    # A folder of very frequent terms is dealt by blocks too.
    dealt = rows.repartition("folder", F.floor(F.col("block") / (RANGE * RANGE))).sortWithinPartitions("folder", "term", "block")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(f"{path}/postings")
    df = made.where("term is not null").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df.select(_folder().alias("folder"), "term", "df", idf.alias("idf")).repartition("folder").sortWithinPartitions("folder", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(f"{path}/terms")
    remove_stored(made)
    put_json(spark, f"{path}/settings.json", {"n_docs": n_docs, "avgdl": avgdl, "block": BLOCK})
    return Index(spark, path)
