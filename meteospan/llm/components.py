"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meteospan.llm.store import written


def _nearest(edges: DataFrame) -> DataFrame:
    """Edges seen from both ends, with the smallest neighbour of the near end (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node reachable.

    Large-star and small-star steps in turn: a node's neighbours are hung on the smallest of them,
    until every component is a star. Only minima are gathered per node, with partial aggregation,
    and each round has as many rows as edges at most; a table without edges gives no rows.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        large = _nearest(edges).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b")))
        after = written(small.filter("a <> b").distinct(), "edges")
        # a star forest is a fixed point: no node is both a root and hung elsewhere, and none hangs twice
        roots = after.select(F.col("b").alias("a")).distinct()
        twice = after.groupBy("a").count().filter("count > 1")
        if roots.join(after, "a", "left_semi").isEmpty() and twice.isEmpty():
            break
        edges = after
    roots = after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
