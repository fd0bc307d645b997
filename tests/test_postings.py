"""The stored inverted index against scores by definition: ties, repeats, nulls, blocks that are skipped, and what a search reads."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sillage.operators import bm25, postings
from sillage.sources import tables


def by_definition(records, questions, k, digits=9):
    docs = [(i, Counter(re.findall("[a-z0-9_]{2,}", (t or "").lower()))) for i, t in records]
    docs = [(i, c) for i, c in docs if c]
    n, avgdl = len(docs), sum(c.total() for _, c in docs) / max(1, len(docs))
    df = Counter(t for _, c in docs for t in c)
    out = []
    for q, text in questions:
        asked = Counter(re.findall("[a-z0-9_]{2,}", (text or "").lower()))
        scored = []
        for i, c in docs:
            s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / avgdl)) for t, m in asked.items() if t in c)
            if round(s, digits) > 0:
                scored.append((-round(s, digits), i))
        out += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def given(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(80)] + ["The", "THE", "x", "a_b", "é"]
    return [(k, " ".join(rng.choices(words, weights=[1 / (r + 1) for r in range(len(words))], k=rng.choice([1, 3, 10, 60])))) for k in range(n)]


@pytest.mark.parametrize(("block", "together", "named"), [(256, 512, 200), (4, 2, 0)])
def test_hits_are_those_by_definition(spark, monkeypatch, block, together, named):
    for name, value in (("BLOCK", block), ("TOGETHER", together), ("NAMED", named), ("RANGE", 3)):
        monkeypatch.setattr(postings, name, value)
    rows = given(1, 150) + [(200, None), (201, ""), (202, "!"), (5, "w1 w2 again"), (203, "w7 " * 500)]
    rows += [(300 + k, "same words here") for k in range(20)]
    questions = [(1, "w1 w2"), (2, "w3 W3 w70"), (3, None), (4, "nowhere"), (5, "same words"), (6, "the w0 w9 w44"), (7, "")]
    ix = postings.build(spark.createDataFrame(rows, "id long, text string"))
    asked = spark.createDataFrame(questions, "qid int, query string")
    for k in (1, 7, 500):
        got = sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in ix.search(asked, k).collect())
        want = by_definition(rows, questions, k)
        assert [(q, i, n) for q, i, _, n in got] == [(q, i, n) for q, i, _, n in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-9)
    assert ix.search(asked.limit(0), 5).count() == 0 and ix.search(asked, 0).count() == 0


def test_a_search_reads_postings_alone(spark, tmp_path):
    rows = spark.createDataFrame(given(2, 300), "id long, text string")
    path = f"file://{tmp_path}/words"
    postings.build(rows, path=path)
    again = postings.Index(spark, path)
    found = again.search(spark.createDataFrame([(0, "w1 w30")], "qid int, query string"), 5)
    assert tables.exists(spark, f"{path}/settings.json")
    assert all("/words/" in f for f in found.inputFiles())
    assert [r["id"] for r in found.orderBy("rank").collect()] == [r["id"] for r in bm25.best(rows, spark.createDataFrame([(0, "w1 w30")], "qid int, query string"), 5, digits=9).orderBy("rank").collect()]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    empty = postings.build(rows.limit(0))
    assert empty.search(spark.createDataFrame([(0, "w1")], "qid int, query string"), 5).count() == 0
    summed = postings.build(spark.createDataFrame([(1, "", "short words"), (2, "long text", None)], "id long, text string, summary string"), summary_col="summary")
    assert [r["id"] for r in summed.search(spark.createDataFrame([(0, "words")], "qid int, query string"), 5).collect()] == [1]


def test_blocks_that_cannot_matter_are_skipped():
    """A rare term's blocks hold the best; blocks of the frequent term alone can't reach them."""
    n = 64
    rows = [("often", b, 0.4, [0, 1, 2], [0.4, 0.3, 0.2]) for b in range(n)] + [("rare", b, 2.0, [5, 9], [2.0, 1.5]) for b in (3, 17)]
    table = pa.table({"term": [r[0] for r in rows], "block": pa.array([r[1] for r in rows], pa.int64()), "most": [r[2] for r in rows], "places": pa.array([r[3] for r in rows], pa.list_(pa.int32())), "parts": pa.array([r[4] for r in rows], pa.list_(pa.float64()))})
    weights = {"often": (np.array([0, 1]), np.array([0.1, 1.0])), "rare": (np.array([0]), np.array([5.0]))}
    q, block, place, score, pairs = postings.scored(table, weights, 2, 3, 9)
    mine = sorted(zip(score[q == 0].tolist(), block[q == 0].tolist(), place[q == 0].tolist(), strict=True), reverse=True)
    assert mine == [(10.0, 17, 5), (10.0, 3, 5), (7.5, 17, 9), (7.5, 3, 9)]
    # Question 0 needs two blocks of 64; all of question 1's first places tie.
    assert pairs == n + 2 and (q == 1).sum() == n
