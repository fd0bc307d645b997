"""Search within cells by blocks, against exact search."""

from __future__ import annotations

import numpy as np
import pytest

from sillage.operators import index


@pytest.mark.parametrize(("rows_cell", "asked_cell"), [(4_000_000, 1_000_000), (200, 40)])
def test_all_cells_are_exact_search(spark, monkeypatch, rows_cell, asked_cell):
    """F8, F12: each record met each query of its cell as a joined row."""
    monkeypatch.setattr(index, "ROWS_CELL", rows_cell)
    monkeypatch.setattr(index, "ASKED_CELL", asked_cell)
    rng = np.random.default_rng(3)
    rows = [(f"{n:04d}", rng.normal(size=8).tolist()) for n in range(300)] + [("0300", [0.0] * 8), ("0301", None)]
    ix = index.added(spark.createDataFrame(rows, "id string, embedding array<double>"))
    asked = spark.createDataFrame([(n, rows[n][1]) for n in range(20)] + [(20, None)], "qid int, vector array<double>")
    placed, centres = index.cells(ix, 5)
    near = index.search_cells(placed, centres, asked, 4, 5)
    assert "FlatMapCoGroupsInArrow" in near._jdf.queryExecution().executedPlan().toString()
    shown = lambda hits: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in hits.collect())
    assert shown(near) == shown(index.search(ix, asked, 4)) and len(shown(near)) == 80
