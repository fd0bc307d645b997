"""Many phrases in many texts at once: an automaton of all phrases, sent to the tasks, that reads each text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of all phrases that go to every task at a time (an automaton of about 1 GB at most); more are taken in passes over the texts.
MOST_SENT = 4_000_000
#: Characters of a text that are searched at a time; the next piece starts before its end, by the longest phrase.
PIECE = 1 << 20


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Of distinct phrases that aren't empty; what it finds is a phrase's place in the list."""
    made = ahocorasick.Automaton()
    for n, phrase in enumerate(phrases):
        made.add_word(phrase, n)
    made.make_automaton()
    return made


def found(made: ahocorasick.Automaton, text: str, longest: int) -> set[int]:
    """Places of the phrases that the text holds, piece by piece, so that a long text's hits are never held all at once."""
    got: set[int] = set()
    for at in range(0, max(1, len(text)), PIECE):
        got.update(n for _, n in made.iter(text[at : at + PIECE + longest - 1]))
    return got


def counted(rows: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """phrase, n_rows, first: how many rows' texts hold each phrase that any holds, and the least id of these, read as holding() reads them.

    A task counts as it reads, and hands on a row for each phrase that it met, so that what is shuffled grows with phrases and tasks, not with
    the pairs of a text and a phrase.
    """
    form = S.StructType([S.StructField("phrase", S.StringType()), S.StructField("n_rows", S.LongType()), S.StructField("first", rows.schema[id_col].dataType)])
    kind = to_arrow_type(form[2].dataType)

    def tell(chosen: list[str], hits: Iterator[tuple[object, set[int]]]) -> Iterator[pa.RecordBatch]:
        n, first = [0] * len(chosen), [None] * len(chosen)
        for key, got in hits:
            for at in got:
                n[at] += 1
                if key is not None and (first[at] is None or key < first[at]):
                    first[at] = key
        met = [at for at in range(len(chosen)) if n[at]]
        for k in range(0, len(met), 10_000):
            some = met[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([chosen[at] for at in some], pa.string()), pa.array([n[at] for at in some], pa.int64()), pa.array([first[at] for at in some], kind)], names=form.names)

    return _read(rows, phrases, id_col, text_col, form, tell).groupBy("phrase").agg(F.sum("n_rows").alias("n_rows"), F.min("first").alias("first"))


def holding(rows: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, phrase: which texts (lower-cased) hold which phrases (phrase; trimmed and lower-cased), once each however often.

    A text is read once, for all phrases together, where it lies: no row meets a row. Phrases reach the driver, and are a stated set, of any
    number: MOST_SENT characters of them go to the tasks at a time. Null and blank phrases are in nothing, null texts hold nothing; an id that repeats has
    the phrases of each of its rows.
    """
    form = S.StructType([S.StructField("id", rows.schema[id_col].dataType), S.StructField("phrase", S.StringType())])
    kind = to_arrow_type(form[0].dataType)

    def tell(chosen: list[str], hits: Iterator[tuple[object, set[int]]]) -> Iterator[pa.RecordBatch]:
        for key, got in hits:
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), kind), pa.array([chosen[n] for n in sorted(got)], pa.string())], names=form.names)

    return _read(rows, phrases, id_col, text_col, form, tell).distinct()


def _read(rows: DataFrame, phrases: DataFrame, id_col: str, text_col: str, form: S.StructType, tell: Callable[[list[str], Iterator[tuple[object, set[int]]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What tell makes, in each task, of the ids of its texts and the places of the phrases that each holds."""
    cleaned = phrases.select(F.lower(F.trim("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    texts = rows.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    passes: list[list[str]] = [[]]
    size = 0
    for r in cleaned.orderBy("phrase").toLocalIterator():
        if size + len(r["phrase"]) > MOST_SENT and passes[-1]:
            passes.append([])
            size = 0
        passes[-1].append(r["phrase"])
        size += len(r["phrase"])

    def one(chosen: list[str]) -> DataFrame:
        sent, longest = rows.sparkSession.sparkContext.broadcast(chosen), max(map(len, chosen))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen = sent.value
            made = automaton(chosen)

            def hits() -> Iterator[tuple[object, set[int]]]:
                for batch in batches:
                    for at in range(0, batch.num_rows, 64):
                        for key, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                            yield key, found(made, text, longest)

            yield from tell(chosen, hits())

        return texts.mapInArrow(run, form)

    if not passes[0]:
        return rows.sparkSession.createDataFrame([], form)
    out = one(passes[0])
    for chosen in passes[1:]:
        out = out.union(one(chosen))
    return out
