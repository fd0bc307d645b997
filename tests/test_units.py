"""Flows whose records have their vectors in a table of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage.plans.answers import Retriever
from sillage.queries import QUESTION, flow_records, table, vector_index
from sillage.sources.tables import stored


def test_texts_are_not_joined_with_all_vectors(spark, sf):
    """each search joined all texts with all vectors, and so shuffled every text."""
    records = flow_records(spark, sf)
    units = stored(vector_index(spark, sf).join(records.select("id"), "id", "left_semi"), "units")
    assert "embedding" not in records.columns
    vector = table(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"]
    apart = Retriever(spark, records, lambda q: list(vector), units=units)
    joined = Retriever(spark, records.join(units.select("id", "_key", "unit"), "id", "left"), lambda q: list(vector))
    asked = spark.createDataFrame([(0, vector)], "qid int, vector array<double>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plans = [r.near(asked, 8)._jdf.queryExecution().executedPlan().toString() for r in (apart, joined)]
        assert ["SortMergeJoin" in p for p in plans] == [False, True]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    shown = lambda r: [tuple(x) for x in r.search([QUESTION], 8, "initial").orderBy("seq").select("seq", "id", F.round("score", 9), F.round("_score_bm25", 9), "_origin").collect()]
    assert shown(apart) == shown(joined) != []


def test_texts_are_read_a_few_at_a_time():
    """all texts of a batch, ten thousand of any length, were Python's strings at once."""
    import tracemalloc

    import pyarrow as pa

    from sillage.operators import bm25

    batch = pa.RecordBatch.from_pydict({"id": list(range(2000)), "text": ["ab " * 3000] * 2000})
    tracemalloc.start()
    assert sum(len(text) for _, text in bm25._rows(batch)) == 2000 * 9000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000
