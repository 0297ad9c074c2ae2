"""Nearest neighbours hold few pairs at a time."""

from __future__ import annotations

import random

from quarryline.operators import vectors as V


def hits(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


def test_neighbours_in_small_steps(spark, monkeypatch):
    """Vectors are compared with the queries in steps; ties between steps go to the smaller id."""
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in rng.sample(range(5000), 400)] + [(9000, None), (9001, [0.0, 0.0, 0.0])]
    docs = spark.createDataFrame(rows, "doc_id long, v array<double>").coalesce(2)
    asked = spark.createDataFrame([(q, [float(rng.randint(-2, 2)) + 0.5 for _ in range(3)]) for q in range(9)], "query_id long, v array<double>")
    for more in ({}, {"positive_only": False}, {"positive_only": False, "floor": 0.0}):
        want = hits(V.nearest(docs, asked, 6, **more))
        monkeypatch.setattr(V, "PAIRS", 30)
        assert hits(V.nearest(docs, asked, 6, **more)) == want and len(want) == 54
        monkeypatch.setattr(V, "PAIRS", 1 << 20)
    assert V.nearest(docs, asked, 0).count() == 0
