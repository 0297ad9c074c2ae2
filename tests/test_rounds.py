"""Rounds of alias chains follow the chains, not the table."""

from __future__ import annotations

from quarryline.operators import graph as G


def test_cycles_do_not_prolong_short_chains(spark, monkeypatch):
    rounds, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: rounds.append(1) or cut(df))
    rows = [(i, i - 1) for i in range(3000) if i % 3] + [(-1, -2), (-2, -1), (-3, -1), (-4, -3), (7000, 7000)]
    got = {r.key: r.canonical for r in G.resolve_aliases(spark.createDataFrame(rows, "alias long, canonical long")).collect()}
    assert got == {i: i // 3 * 3 for i in range(3000) if i % 3} | {i: i for i in (-1, -2, -3, -4)}
    assert len(rounds) <= 4
    for rows in ([], [(1, 2), (2, 1)], [(i, i + 1) for i in range(37)]):
        got = {r.key: r.canonical for r in G.resolve_aliases(spark.createDataFrame(rows, "alias long, canonical long")).collect()}
        assert got == {a: a if len(rows) == 2 else 37 for a, _ in rows}
