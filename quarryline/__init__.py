"""quarryline: retrieval and crawl analytics as Spark plans.

operators/  corpus, index, ranking, vectors, fusion, graph, crawl, lifecycle
functions/  column expressions, and Arrow functions where columns don't reach
sources/    robots, sitemaps, result pages, document stores, index snapshots
streaming/  index upserts, limits and offsets on streams
plans/      the registered queries with their SQL twins
"""
