"""Functions of pages hold few results at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import html as H


def test_pages_are_handed_on_by_few(spark, monkeypatch):
    """Results of pages leave a task before its batch is through, and are those of each page."""
    pages = [(i, None if i == 3 else f"<html lang='e{i}'><title>T{i}</title><p>Text of {i}</p><a href='/x{i}'>to {i}</a></html>", f"http://h{i}/") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, html string, url string").coalesce(1)
    want = [(i, *H.clean_page(h or "", u).values(), *H.to_markdown(h or "", u), H.anchors(H.tree(h or ""), u)) for i, h, u in pages]
    for few in (H.PAGES, 7):
        monkeypatch.setattr(H, "PAGES", few)
        own = df.select("page_id", H.cleaned(F.col("html"), F.col("url")).alias("c"), H.markdown(F.col("html"), F.col("url")).alias("m"), H.anchor_links(F.col("html"), F.col("url")).alias("l"))
        got = [(r.page_id, *r.c, *r.m, [tuple(x) for x in r.l]) for r in own.orderBy("page_id").collect()]
        assert got == want
