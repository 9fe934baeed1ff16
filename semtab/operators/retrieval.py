"""Embedding columns: index, search, similarity join, semantic de-duplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.models.answering import pair_score_column, slots, spread, vector_column
from semtab.models.base import Embedder, PairScorer
from semtab.operators import metric as M
from semtab.operators import vectors as V
from semtab.operators.components import components
from semtab.runtime import col, dtype_of, key_hash, missing, pick, require_columns, same_key, split_join, stage


#: Texts that a task remembers, by their hashes, so as to send a copy no further.
SEEN = 200_000


def _first_seen(h1: Column, h2: Column) -> Column:
    """False where an earlier row of the task had the same hashes, as far as these are remembered."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        seen: set = set()
        for a, b in batches:
            fresh = []
            for pair in zip(a.to_pylist(), b.to_pylist()):
                fresh.append(pair not in seen)
                seen.add(pair)
            if len(seen) > SEEN:
                seen = set()
            yield pa.array(fresh, pa.bool_())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.BooleanType()).asNondeterministic()(h1, h2)


def embed(df: DataFrame, column: str, embedder: Embedder, out: str = "vec") -> DataFrame:
    """Add a vector for a text column; each distinct text is encoded once and its vector written out."""
    require_columns(df, [column])
    texts = df.where(~missing(df, column))
    if dtype_of(df, column) == T.StringType():
        # long texts move once: dealt out by their hashes, one of each kept where they arrive
        texts = texts.select(*key_hash(df, [column]), col(column).alias("_text"))
        tasks = max(slots(df.sparkSession), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        coded = texts.where(_first_seen(F.col("_h1"), F.col("_h2"))).repartition(tasks, "_h1", "_h2").distinct()
    else:
        texts = texts.select(col(column)).distinct()
        coded = spread(texts.select(*key_hash(texts, [column]), col(column).cast("string").alias("_text")))
    coded = stage(coded.select("_h1", "_h2", vector_column(F.col("_text"), embedder).alias("_vec")), "vectors")
    joined = df.join(coded, same_key(df, [column]), "left")
    return joined.select(*[pick(df, c) for c in df.columns if c != out], F.col("_vec").alias(out))


def sem_index(df: DataFrame, key: str, column: str, embedder: Embedder, path: str) -> DataFrame:
    """Encode a column and store ``(key, vec)`` as Parquet at ``path``; returns the stored index."""
    coded = embed(df.select(col(key), col(column)), column, embedder, "vec")
    coded.select(col(key).alias("key"), "vec").write.mode("overwrite").parquet(path)
    return load_index(df.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index as a table ``(key, vec)``."""
    return spark.read.parquet(path)


def attach_index(df: DataFrame, key: str, index: DataFrame, out: str = "vec") -> DataFrame:
    """Join a stored index to the table it was made from."""
    side = index.select(F.col("key").alias("_ik"), F.col("vec").alias(out))
    return df.join(side, pick(df, key) == F.col("_ik"), "left").drop("_ik")


def sem_search(
    df: DataFrame,
    vec_col: str | None,
    query,
    k: int | None = None,
    *,
    key: str,
    embedder: Embedder | None = None,
    text_col: str | None = None,
    rerank: PairScorer | None = None,
    n_rerank: int | None = None,
    scores: bool = False,
    suffix: str = "_sim_score",
) -> DataFrame:
    """The ``k`` rows most similar to a query, best first; ties by ``key``.

    ``query`` is a vector, or a text when ``embedder`` is given. ``n_rerank`` keeps
    the best of them by a pair scorer; without ``k`` it scores all rows. A filter
    on ``df`` acts before the search.
    """
    if k is None and n_rerank is None:
        raise ValueError("give k or n_rerank")
    out = df
    score = f"vec_scores{suffix}"
    if k is not None:
        q = embedder.embed([query])[0] if isinstance(query, str) else np.asarray(query)
        out = (
            df.where(pick(df, vec_col).isNotNull())
            .withColumn(score, V.dot_column(col(vec_col), q))
            .orderBy(F.desc(score), col(key).asc())
            .limit(k)
        )
    if n_rerank is not None:
        if rerank is None or text_col is None or not isinstance(query, str):
            raise ValueError("reranking needs rerank=, text_col= and a text query")
        scored = out.withColumn("_pair", pair_score_column(col(text_col).cast("string"), query, rerank))
        out = scored.orderBy(F.desc("_pair"), col(key).asc()).limit(n_rerank).drop("_pair")
    return out if scores or k is None else out.drop(score)


def sim_join(
    left: DataFrame,
    right: DataFrame,
    left_vec: str,
    right_vec: str,
    k: int,
    *,
    left_key: str,
    right_key: str,
    lsuffix: str = "",
    rsuffix: str = "",
    score_suffix: str = "",
    keep_index: bool = False,
    approx: bool = False,
    recall: float = 0.95,
    stats: bool = False,
    broadcast_bytes: int = V.BROADCAST_BYTES,
    block_rows: int = M.BLOCK_ROWS,
):
    """For each left row the ``k`` most similar right rows, with column ``_scores``.

    Exact at any size: a right side of checked size is broadcast, a larger one matched along a tree of pivots.
    ``approx=True`` looks only into those sign buckets that together hold a neighbour as near as the worst hit
    with a chance of ``recall``; scores are exact all the same. ``stats`` returns ``(rows, {"pairs_scored", "pairs"})``.
    """
    require_columns(left, [left_key, left_vec])
    require_columns(right, [right_key, right_vec])
    clash = set(left.columns) & set(right.columns)
    if clash and lsuffix == rsuffix:
        raise ValueError(f"columns {sorted(clash)} are on both sides; give lsuffix= or rsuffix=")
    schema = V.hits_schema(dtype_of(left, left_key), dtype_of(right, right_key))
    lv = left.where(pick(left, left_vec).isNotNull()).select(
        pick(left, left_key).alias("_lk"), pick(left, left_vec).alias("_lv"))
    rv = right.where(pick(right, right_vec).isNotNull()).select(
        pick(right, right_key).alias("_rk"), pick(right, right_vec).alias("_rv"))
    n, dim, longest = V.measure(rv, "_rv")
    report: dict | None = {} if stats else None
    if not approx and not stats and V.fits_broadcast(n, dim, broadcast_bytes):
        # the hits come as one more column: left rows stay where they are
        hit = V.hits_column(pick(left, left_vec), rv, k, schema["_rk"].dataType)
        kept = left.where(pick(left, left_vec).isNotNull()).withColumn("_hit", F.explode(hit))
        found = kept.withColumns({"_lk": pick(left, left_key), "_rk": F.col("_hit._rk"), "_score": F.col("_hit._score")})
    else:
        hits = M.nearest(lv, rv, k, schema, broadcast_bytes, block_rows, (n, dim, longest), recall if approx else None, report)
        found = left.join(hits, pick(left, left_key) == F.col("_lk"))
    r = right.select(*[pick(right, c).alias(f"_r{i}") for i, c in enumerate(right.columns)])
    joined = found.join(r, F.col("_rk") == F.col(f"_r{right.columns.index(right_key)}"))
    out = [pick(left, c).alias(f"{c}{lsuffix}" if c in clash else c) for c in left.columns]
    out.append(F.col("_score").alias(f"_scores{score_suffix}"))
    out += [F.col(f"_r{i}").alias(f"{c}{rsuffix}" if c in clash else c) for i, c in enumerate(right.columns)]
    if keep_index:
        out += [F.col("_lk").alias("_left_id"), F.col("_rk").alias("_right_id")]
    return (joined.select(*out), report) if stats else joined.select(*out)


def sem_dedup(
    df: DataFrame,
    value_col: str,
    vec_col: str,
    threshold: float,
    *,
    broadcast_bytes: int = V.BROADCAST_BYTES,
    block_rows: int = M.BLOCK_ROWS,
) -> DataFrame:
    """Drop rows whose value is linked, by products above ``threshold``, to a smaller value.

    Links chain: each connected component keeps its smallest value. Rows with
    that very value are all kept. Only distinct values are compared, so copies
    of one value cost nothing.
    """
    require_columns(df, [value_col, vec_col])
    held = df.where(~missing(df, value_col) & pick(df, vec_col).isNotNull())
    held = held.select(F.md5(col(value_col).cast("string")).alias("_id"), col(value_col).alias("_value"), col(vec_col).alias("_vec"))
    # values may be whole texts: their hashes are compared, and only members of larger components are read again
    nodes = stage(held.select("_id", "_vec").distinct().withColumn("_n", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select(F.col("_n").alias("_lk"), F.col("_vec").alias("_lv"))
    n, dim, longest = V.measure(rows, "_lv")
    if not n:
        return df
    # a block of rows at least, even where less than that would be broadcast
    labels, edges = M.linked(rows, threshold, max(block_rows, min(n, broadcast_bytes // (16 * (8 * dim + 64)))), (n, dim, longest))
    # a value with several vectors is one value
    several = nodes.groupBy("_id").agg(F.min("_n").alias("_v"), F.count("*").alias("_c")).where("_c > 1")
    same = nodes.select("_id", F.col("_n").alias("_lk")).join(several, "_id").join(labels, "_lk").select(F.col("_label").alias("_u"), F.col("_v").alias("_lk"))
    same = same.join(labels, "_lk").select("_u", F.col("_label").alias("_v")).where("_u != _v")
    joined = components(edges.union(same))
    labels = stage(split_join(labels.withColumnRenamed("_label", "_u"), joined, "_u", "left").select(F.col("_lk").alias("_n"), F.coalesce("_v", "_u").alias("_v")), "labels")
    open_ = labels.groupBy("_v").count().where("count > 1").select("_v")
    members = stage(nodes.select("_n", "_id").join(split_join(labels, open_, "_v"), "_n").select(F.col("_id"), "_v").distinct(), "members")
    named = split_join(held.select("_id", "_value"), members, "_id")
    texts = dtype_of(df, value_col) == T.StringType()
    if not texts:
        named = stage(named.distinct(), "named")
    # of texts, only the least one's hash is handed on
    told = "_id" if texts else "_value"
    keep = named.groupBy("_v").agg(F.min_by(told, "_value").alias("_keep"))
    # one component may hold a third of all values
    dropped = split_join(members if texts else named, keep, "_v").where(F.col(told) != F.col("_keep")).select(F.col("_id").alias("_u"))
    # hashed beside the values, so that a caller who doesn't select these need not move them
    return df.withColumn("_id", F.md5(col(value_col).cast("string"))).join(dropped, F.col("_id") == F.col("_u"), "left_anti").drop("_id")

