"""Many phrases at once against plain search: overlaps, pieces, passes, and rows that are null, blank or repeated."""

from __future__ import annotations

import random

import pytest

from sillage.functions import patterns
from sillage.operators import context


def given(seed):
    rng = random.Random(seed)
    texts = [(k, "".join(rng.choices("abAé ", k=rng.choice([0, 3, 40, 400])))) for k in range(60)] + [(61, None), (5, "ab ab ab"), (62, "z" * 5000)]
    phrases = sorted({"".join(rng.choices("abé ", k=rng.randint(1, 5))) for _ in range(200)}) + ["", "  ", None, "AB", " ab ", "nowhere", "z" * 4999]
    return texts, phrases


@pytest.mark.parametrize(("sent", "piece"), [(4_000_000, 1 << 20), (60, 7)])
def test_holding_is_plain_search(spark, monkeypatch, sent, piece):
    monkeypatch.setattr(patterns, "MOST_SENT", sent)
    monkeypatch.setattr(patterns, "PIECE", piece)
    texts, phrases = given(4)
    if sent == 60:
        phrases = phrases[::12] + phrases[-7:]
    cleaned = {p.strip(" ").lower() for p in phrases if p} - {""}
    want = {(i, p) for i, t in texts for p in cleaned if p in (t or "").lower()}
    rows, asked = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = [tuple(r) for r in patterns.holding(rows, asked, "id", "text").collect()]
    assert set(got) == want and len(got) == len(want)
    assert patterns.holding(rows, asked.limit(0), "id", "text").count() == 0 and patterns.holding(rows.limit(0), asked, "id", "text").count() == 0


def test_covered_by(spark):
    rows = spark.createDataFrame([(1, "Alpha beta"), (2, "alphabet"), (3, None)], "id long, text string")
    concepts = spark.createDataFrame([("alpha",), (" Beta ",), ("gamma",), (None,)], "concept string")
    assert {r["concept"]: (r["n_rows"], r["first"]) for r in context.covered_by(rows, concepts).collect()} == {"alpha": (2, 1), " Beta ": (1, 1), "gamma": (0, None), None: (0, None)}


def test_counted_without_pairs(spark):
    """every pair of a text and a phrase was shuffled; rows that repeat an id were one."""
    rows = spark.createDataFrame([(2, "ab ab"), (2, "xab"), (1, "b"), (None, "ab")], "id long, text string")
    asked = spark.createDataFrame([("ab",), ("B",), ("c",)], "phrase string")
    made = patterns.counted(rows, asked, "id", "text")
    assert sorted(tuple(r) for r in made.collect()) == [("ab", 3, 2), ("b", 4, 1)]
