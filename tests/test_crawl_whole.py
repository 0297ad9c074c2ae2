"""The registered crawl reaches all that its links reach."""

from __future__ import annotations

from quarryline.plans import web

TESTDATA = "/root/testdata/sf0.01"


def test_crawl_reaches_every_linked_host(spark):
    links = [(r.src, r.dst) for r in web.edges(spark, TESTDATA).collect()]
    (seed,) = {r.url.split("/")[2] for r in web.pages(spark, TESTDATA).where("page_id = 1").collect()}
    depth, front = {seed: 0}, {seed}
    while front:
        front = {b for a, b in links if a in front} - set(depth)
        depth |= dict.fromkeys(front, 1 + max(depth.values()))
    assert {r.url: r.depth for r in web.crawl_bfs(spark, TESTDATA).collect()} == depth
