"""Connected components of a table of links, by alternating stars.

Each round is a few keyed aggregations and joins; its edges are written to the
shared folder, so neither lineage nor the driver grows with the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")  # a row for each edge: the small star makes them distinct


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    across = down.join(least, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return across.union(least.select("w", "m")).distinct()


def components(links: DataFrame, space: Workspace, name: str = "") -> DataFrame:
    """node, root: the least node reachable from each node of ``links`` (a, b), for all but the roots themselves."""
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    edges = space.save(links.select("a", "b").filter("a <> b").distinct(), f"edges{name}0", mark=mark)
    before, turn = None, 0
    while space.told[f"edges{name}{turn}"] != before and space.told[f"edges{name}{turn}"]["rows"]:
        before, turn = space.told[f"edges{name}{turn}"], turn + 1
        edges = space.save(_small_star(_large_star(edges)), f"edges{name}{turn}", mark=mark)
        space.drop(f"edges{name}{turn - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
