"""Clusters of an embedded column, and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.models.base import AnswerModel
from semtab.operators.folding import sem_agg
from semtab.operators.values import groupby
from semtab.operators.vectors import arrow_matrix, matrix
from semtab.runtime import col, missing, require_columns, stage

#: Rows that starting centres are chosen from: all of a smaller table, a hash sample of a larger one.
SEED_ROWS = 10_000
#: Distances and centres are rounded to so many places, so that the order of a sum decides nothing.
PLACES = 9


def _distances(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty((len(m), len(centres)))
    for c, centre in enumerate(centres):
        out[:, c] = np.sqrt(((m - centre) ** 2).sum(axis=1))
    return np.round(out, PLACES)


def farthest_first(vectors: np.ndarray, k: int) -> np.ndarray:
    """``k`` starting centres: the first vector, then always the one farthest from those chosen, the earlier of equal ones."""
    chosen, nearest = [0], np.full(len(vectors), np.inf)
    while len(chosen) < k:
        nearest = np.minimum(nearest, _distances(vectors, vectors[chosen[-1:]])[:, 0])
        chosen.append(int(nearest.argmax()))
    return vectors[chosen]


def _moved(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """One round: rows go to their nearest centre, centres to the mean of their rows. A centre without rows stays."""
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1))
        for batch in batches:
            if batch.num_rows:
                m = arrow_matrix(batch.column(0))
                np.add.at(sums, _distances(m, centres).argmin(axis=1), np.column_stack([m, np.ones(len(m))]))
        cluster, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int64()), pa.array(place, pa.int64()), pa.array(sums[cluster, place])], names=["c", "p", "s"])

    total = np.zeros((k, dim + 1))
    # each task hands on k sums whatever the size of its clusters, so a cluster of most rows is no heavier than others
    for r in vectors.mapInArrow(run, "c long, p long, s double").groupBy("c", "p").agg(F.sum("s").alias("s")).collect():
        total[r["c"], r["p"]] = r["s"]
    full = total[:, dim] > 0
    out = centres.copy()
    out[full] = np.round(total[full, :dim] / total[full, dim:], PLACES)
    return out


def sem_cluster_by(
    df: DataFrame, vec_col: str, k: int, *, max_iter: int = 20, seed: int = 42, out: str = "cluster_id", key: str | None = None
) -> DataFrame:
    """Add the k-means cluster of a vector column, 0 to ``k - 1``; rows without a vector are left out.

    Starting centres are chosen farthest-first, from the row with the smallest ``key`` (the smallest hash of the
    vector if no key is given), so a table has the same clusters in every run and partitioning. Tables of more than
    ``SEED_ROWS`` rows choose them from that many rows by a hash with ``seed``. Rounds of assignment and sums follow until no
    centre moves, ``max_iter`` at most. A cluster that loses all rows keeps its centre. Equally near centres: the lower number.
    """
    require_columns(df, [vec_col, *([key] if key else [])])
    kept = df.where(col(vec_col).isNotNull())
    order = col(key) if key else F.xxhash64(vec_col)
    by_hash = F.xxhash64(F.lit(seed), order)
    vectors = stage(kept.select(col(vec_col).alias("_v"), order.alias("_key"), by_hash.alias("_hash")), "vectors")
    if len(vectors.limit(k).select(F.lit(1)).collect()) < k:
        raise ValueError(f"{k} clusters need at least {k} rows")
    # without a key rows are known by their vector, and copies of one vector must not fill the sample
    apart = vectors if key else vectors.groupBy("_hash", "_key").agg(F.any_value("_v").alias("_v"))
    sample = apart.orderBy("_hash", "_key").limit(SEED_ROWS).orderBy("_key").select("_v").collect()
    centres = farthest_first(matrix([r[0] for r in sample]), k)
    vectors = vectors.select("_v")
    for _ in range(max_iter):
        before, centres = centres, _moved(vectors, centres)
        if np.array_equal(before, centres):
            break

    def nearest(v: pa.Array) -> pa.Array:
        return pa.array(_distances(arrow_matrix(v), centres).argmin(axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32))

    nearest.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return kept.withColumn(out, F.arrow_udf(nearest, T.IntegerType())(col(vec_col)))


def cluster_summary(
    df: DataFrame,
    column: str,
    vec_col: str,
    k: int,
    agg_col: str,
    func: str,
    model: AnswerModel,
    *,
    max_iter: int = 20,
    seed: int = 42,
    key: str | None = None,
    budget: int | None = None,
) -> DataFrame:
    """Per cluster a summary of the distinct values of ``column`` and ``{agg_col}_{func}``."""
    clustered = sem_cluster_by(df, vec_col, k, max_iter=max_iter, seed=seed, key=key)
    numbers = groupby(clustered, "cluster_id", agg_col, func)
    texts = clustered.where(~missing(clustered, column)).select("cluster_id", col(column)).distinct()
    told = sem_agg(
        texts, f"Summarize {{{column}}} in a short sentence.", model, group_by="cluster_id", out="_told", budget=budget
    )
    summary = F.substring_index("_told", "Answer: ", -1).alias("summary")
    return numbers.join(told, "cluster_id", "left").select(summary, col(f"{agg_col}_{func}"))
