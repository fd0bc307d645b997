"""Vector indexes of every kind against the exact search: recall, what is read, and records and questions at odds with the rest."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sillage import queries as Q
from sillage.operators import codes, graph, index


def plain(records, questions, k):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1.0)
    out = set()
    for q, v in questions:
        if v:
            scored = sorted((-round(float(unit(v) @ unit(w)), 12), key) for key, w in records if w and len(w) == len(v))
            out |= {(q, key, n) for n, (_, key) in enumerate(scored[:k])}
    return out


def hits(df):
    return {(r["qid"], r["_key"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    records = [(f"k{n:03d}", [float(x) for x in rng.integers(-2, 3, 6)]) for n in range(120)] + [("short", [1.0, 2.0]), ("none", None), ("empty", []), ("zero", [0.0] * 6)]
    questions = [(n, records[n * 7][1]) for n in range(12)] + [(50, None), (51, [1.0, 1.0]), (52, [1.0] * 9), (53, [])]
    made = index.added(spark.createDataFrame(records, "id string, embedding array<double>"))
    return made, spark.createDataFrame(questions, "qid long, vector array<double>"), records, questions


@pytest.mark.parametrize(("rows", "asked"), [(4_000_000, 1_000_000), (60, 20), (7, 1_000_000)])
def test_grid_is_exact(mixed, monkeypatch, rows, asked):
    made, questions, records, given = mixed
    monkeypatch.setattr(index, "ROWS_CELL", rows)
    monkeypatch.setattr(index, "ASKED_CELL", asked)
    found = index.search(made, questions, 5, sent=0)
    assert hits(found) == hits(index.search(made, questions, 5)) == plain(records, given, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_grid_of_nothing(mixed):
    made, questions, *_ = mixed
    assert index.search(made.limit(0), questions, 5, sent=0).count() == 0 and index.search(made, questions.limit(0), 5, sent=0).count() == 0


def test_codes_of_every_record_and_an_exact_end(spark, sf):
    ix = Q.vector_index(spark, sf)
    asked = Q.vector_queries(ix)
    made = codes.build(ix, 64)
    assert made.codes.columns == ["_key", "code"] and made.codes.count() == ix.count()
    assert {r["n"] for r in made.codes.select(F.length("code").alias("n")).collect()} == {codes.PARTS}
    exact = hits(index.search(ix, asked, 10))
    got = made.search(asked, 10)
    assert len({h[:2] for h in hits(got)} & {h[:2] for h in exact}) >= 0.9 * len(exact)
    total = ix.count()
    assert 10 <= made.keep < total / 2 and made.candidates(asked, 30).groupBy("qid").count().where("count <> 30").isEmpty()
    # With every record kept the end is the exact search.
    assert hits(made.search(asked, 10, total)) == exact
    print(f"codes: {made.keep} of {total} records compared exactly for a question")


def test_codes_take_passes_and_odd_rows(mixed, monkeypatch):
    made, questions, records, given = mixed
    monkeypatch.setattr(codes, "MOST_TABLES", 3 * codes.CODES * 5)
    coded = codes.build(made, 6, parts=3, codes=8)
    assert coded.codes.count() == 121
    right = [(k, v) for k, v in records if v and len(v) == 6], [(q, v) for q, v in given if v and len(v) == 6]
    assert hits(coded.search(questions, 4, 200)) == plain(*right, 4)
    with pytest.raises(ValueError, match="parts"):
        codes.books(made, 6, parts=4)


def test_codes_are_those_of_the_nearest_centres():
    rng = np.random.default_rng(1)
    rows, centres = rng.normal(size=(500, 4)), rng.normal(size=(9, 4))
    assert (codes.nearest(rows, centres) == ((rows[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_graph_has_the_nearest_and_walks_to_them(spark, sf):
    ix = Q.vector_index(spark, sf)
    asked = Q.vector_queries(ix)
    made = graph.build(ix)
    total, questions = ix.count(), asked.count()
    exact = {h[:2] for h in hits(index.search(ix, asked, 10))}
    got = {h[:2] for h in hits(made.search(asked, 10, beam=16))}
    compared = made.walk(asked, beam=16).count() / questions
    print(f"graph: recall {len(got & exact) / len(exact):.3f}, {compared:.0f} of {total} records compared for a question")
    assert len(got & exact) >= 0.9 * len(exact) and compared < 0.7 * total
    assert made.links.count() == total


def test_neighbours_are_found_by_introduction(spark):
    """Clusters that random links hardly touch: nearly all true neighbours are found, in few comparisons' worth of rounds."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    near = [centres[n % 12] + 0.3 * rng.normal(size=8) for n in range(600)]
    rows = [(n, (v / np.linalg.norm(v)).tolist()) for n, v in enumerate(near)]
    nodes = spark.createDataFrame(rows, "id long, unit array<double>")
    got = {}
    for r in graph.neighbours(nodes, 10).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    m = np.array([v for _, v in rows])
    scores = m @ m.T - 9 * np.eye(len(m))
    want = {n: set(np.argsort(-scores[n])[:10].tolist()) for n in range(len(m))}
    assert sum(len(got[n] & want[n]) for n in want) >= 0.95 * 10 * len(want)


def test_graph_of_odd_rows(mixed):
    made, questions, records, given = mixed
    built = graph.build(made)
    right = [(k, v) for k, v in records if v and len(v) == 6], [(q, v) for q, v in given if v and len(v) == 6]
    assert len(hits(built.search(questions, 4, beam=200)) & plain(*right, 4)) >= 0.9 * len(plain(*right, 4))
    assert graph.build(made.limit(0)).search(questions, 4).count() == 0 and built.search(questions.limit(0), 4).count() == 0


def test_every_kind_finds(mixed):
    made, questions, records, given = mixed
    for kind in index.KINDS:
        found = index.find(made, questions.where("qid < 12"), 1, kind)
        assert {r["qid"] for r in found.collect()} == set(range(12))
        assert index.find(made.limit(0), questions, 1, kind).count() == 0
