"""Connected components of an edge table, without the driver or any task holding a whole component."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, merged, written


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of one partition, replaced by stars around the smallest node of each of their components."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = [x for x in up if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pd.DataFrame({"a": part, "b": [root(x) for x in part]}, dtype="int64")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return merged(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = merged(edges, least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that isn't the smallest of its component.

    Edges are first contracted within partitions; large-star and small-star steps then alternate until nothing moves.
    Each step is written to the shared folder. Null nodes and loops are dropped; equal edges count once.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(edges.mapInPandas(_forest, "a long, b long").distinct(), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = now.agg(mark.alias("m")).first()["m"]
    for _ in range(rounds):
        after = written(_small_star(_large_star(now)), "stars")
        drop_written(now)
        now, found = after, after.agg(mark.alias("m")).first()["m"]
        if found == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = found
    raise RuntimeError(f"components did not settle in {rounds} rounds")
