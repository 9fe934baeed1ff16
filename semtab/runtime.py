"""Session helpers: column naming, staged tables, bounded look-ups.

Nothing here keeps state between calls; every helper takes the session or a
DataFrame and returns a DataFrame or a small Python value.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "semtab") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by path on one machine, as an archive on a cluster.

    Not needed where the package is installed on the executors or given to
    ``spark-submit --py-files``.
    """
    sc = spark.sparkContext
    home = Path(__file__).resolve().parent
    if sc.master.startswith("local"):
        paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(home.parent) not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([str(home.parent), *paths])
    elif not getattr(sc, "_semtab_shipped", False):
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{home.name}", "zip", home.parent, home.name)
        sc.addPyFile(archive)
        sc._semtab_shipped = True


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds (dots, colons, spaces)."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, name: str) -> Column:
    """Like :func:`col`, bound to one side of a join."""
    return df["`" + name.replace("`", "``") + "`"]


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) {missing} not found; the table has {df.columns}")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def missing(df: DataFrame, name: str) -> Column:
    """True where a value is missing: NULL, or NaN in a floating column."""
    c = col(name)
    if isinstance(dtype_of(df, name), (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Give a table read from elsewhere one missing value: NaN becomes NULL."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
            if isinstance(f.dataType, floating)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="semtab-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    Used where rows are costly (model replies) or where an iterative job must cut
    its lineage. The table survives lost executors, and its file statistics let
    the optimizer size later joins.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/semtab-staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_hash(df: DataFrame, names: list[str]) -> list[Column]:
    """Two 64-bit hashes that stand for the values of some columns, missing ones included.

    Joining on them moves 16 bytes per row instead of whole texts, for any number and
    type of key columns; 128 bits keep chance matches out of reach.
    """
    parts: list[Column] = []
    for n in names:
        c = col(n)
        if isinstance(dtype_of(df, n), (T.DoubleType, T.FloatType)):
            c = c + F.lit(0.0)  # one zero, not two
        parts += [c.isNull(), c]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"_h{seed}") for seed in (1, 2)]


def same_key(df: DataFrame, names: list[str]) -> Column:
    """Join condition between rows of ``df`` and a table that holds ``_h1 _h2`` of the same columns."""
    a, b = key_hash(df, names)
    return (a == F.col("_h1")) & (b == F.col("_h2"))


def tasks_for(rows: int, rows_per_task: int) -> int:
    return max(1, -(-rows // rows_per_task))


def split_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    how: str = "inner",
    hot_share: float = 0.001,
) -> DataFrame:
    """Equi-join on ``key`` where one key of ``big`` may hold a third of its rows.

    ``small`` must hold one row per key. Keys above ``hot_share`` of all rows
    number at most ``1 / hot_share`` by counting, so their part of ``small`` is
    broadcast and their rows never move; all other keys, and rows without one, are joined by shuffle.
    """
    counts = big.groupBy(col(key).alias("_hk")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("_hk").isNotNull() & (F.col("_n") > max(hot_share * total, 10_000))).select("_hk").collect()]
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(col(key).isin(hot), F.lit(False))
    part_hot = big.where(is_hot).join(F.broadcast(small.where(is_hot)), key, how)
    part_rest = big.where(~is_hot).join(small.where(~is_hot), key, how)
    return part_hot.unionByName(part_rest)
