"""Connected components by alternating large and small stars, in DataFrame operations throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import discard, materialize, salted, with_salt


def _hang(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Rows (u, v) with u's least neighbour m; hubs are spread by salt and adaptive skew splitting."""
    return with_salt(pairs, F.col("v")).join(salted(least), ["u", "__salt"]).drop("__salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _hang(both.filter("v > u"), least).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _hang(down, least).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs -> (node, component), the component being its smallest node.

    Self loops and repeated edges are harmless, null ends are dropped, no edges give no rows.
    Each star is written to the shared folder and deleted once the next one is; the loop ends when a whole round changes nothing.
    Raises RuntimeError if ``max_rounds`` don't suffice (the number grows with the log of the size).
    """
    canon = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(canon, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        large = materialize(_large_star(now), "stars")
        small = materialize(_small_star(large), "stars")
        discard(now, large)
        now = small
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
