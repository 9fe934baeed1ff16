"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semtab.runtime import split_join, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("_v", "_u")).distinct()
    least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
    onward = split_join(both.where(F.col("_v") > F.col("_u")), least, "_u")
    return onward.select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).where("_u != _v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).distinct()
    least = down.groupBy("_u").agg(F.min("_v").alias("_m"))
    moved = split_join(down, least, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
    return moved.where("_u != _v").union(least.select("_u", F.col("_m").alias("_v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(20,0)"))).first()
    return tuple(row)


def _union_in_task(pdf: pd.DataFrame) -> pd.DataFrame:
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in zip(pdf["_u"], pdf["_v"]):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in list(parent)]
    return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["_u", "_v"])


def components(edges: DataFrame, max_rounds: int = 60, task_edges: int = 100_000) -> DataFrame:
    """``_u`` and the least member ``_v`` of its component, for every node but that least one.

    ``edges`` holds ``_u _v``. Each round is written out, so lineage stays short; the
    number of rounds grows with the logarithm of the longest chain. A hub node is
    handled by :func:`split_join`. At most ``task_edges`` edges are settled by one task.
    """
    edges = stage(edges.select("_u", "_v").distinct(), "edges")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if mark[0] <= task_edges:
            return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_union_in_task, edges.schema)
        edges = stage(_small_star(_large_star(_small_star(edges))), "edges")
        now = _mark(edges)
        if now == mark:
            return edges
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
