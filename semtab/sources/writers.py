"""Writing tables, result documents and vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from semtab.runtime import col


def sink_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write every table of a catalog below ``folder``, as Parquet or as CSV with a header."""
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt is 'parquet' or 'csv'")
    for name, df in tables.items():
        target = f"{folder.rstrip('/')}/{name}.{fmt}"
        writer = df.write.mode(mode)
        if fmt == "csv":
            writer.option("header", True).option("quote", '"').option("escape", '"').csv(target)
        else:
            writer.parquet(target)


def sink_tables_csv(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    sink_tables(tables, folder, "csv", mode)


def sink_results_json(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write process or result documents as JSON lines."""
    df.write.mode(mode).json(path)


def sink_vectors(df: DataFrame, key: str, vec: str, path: str, mode: str = "overwrite") -> None:
    """Write an embedding table ``(key, vec)``."""
    df.select(col(key).alias("key"), col(vec).alias("vec")).write.mode(mode).parquet(path)
