"""Positions and running totals over a whole sorted table, without one big window.

A window without partitions, or with one hot partition, is a single task. Here the
table is range-partitioned by its sort columns instead; each partition counts for
itself, and what lies before a partition is known from one total per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.runtime import col, stage


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, out: str = "_upto"
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` from the start of the row's group up to the row.

    Rows of a group may lie in several partitions; only the first group of a
    partition can have begun earlier, so the carried totals are one row per
    partition.
    """
    keys, order = [col(g) for g in group], [col(o) for o in order]
    local, part = "_local", "_part"
    schema = T.StructType(
        [*df.schema.fields, T.StructField(local, T.LongType()), T.StructField(part, T.IntegerType())]
    )
    group = list(group)

    def count_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, carried = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            starts = np.zeros(len(pdf), dtype=bool)
            if group:
                for g in group:
                    starts |= (pdf[g] != pdf[g].shift()).to_numpy()
                starts[0] = tuple(pdf[group].iloc[0]) != last
                last = tuple(pdf[group].iloc[-1])
            run = pdf[weight].to_numpy().cumsum()
            before = np.where(starts, run - pdf[weight].to_numpy(), 0)
            base = np.maximum.accumulate(np.where(starts, before, -1))
            total = np.where(base >= 0, run - np.maximum(base, 0), run + carried)
            carried = int(total[-1])
            yield pdf.assign(**{local: total, part: pid})

    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    counted = stage(ranged.mapInPandas(count_up, schema), "running")
    # one row per (partition, group at its edge)
    ends = counted.groupBy(part, *keys).agg(F.max(local).alias("_sum"), F.min(local).alias("_low"))
    first = counted.groupBy(part).agg(F.min(F.struct(*keys) if keys else F.lit(0)).alias("_first"))
    total = ends.select(part, F.struct(*keys).alias("_g") if keys else F.lit(0).alias("_g"), "_sum")
    last = counted.groupBy(part).agg(F.max(F.struct(*keys) if keys else F.lit(0)).alias("_last"))
    edge = (
        first.join(last, part)
        .join(total.withColumnRenamed("_g", "_last"), [part, "_last"])
        .select(part, "_first", "_last", "_sum")
        .orderBy(part)
        .collect()
    )
    offsets, open_group, before = [], object(), 0
    for row in edge:
        carry = before if row["_first"] == open_group else 0
        offsets.append((row[part], carry))
        before = row["_sum"] + (carry if row["_first"] == row["_last"] else 0)
        open_group = row["_last"]
    spark = df.sparkSession
    table = spark.createDataFrame(offsets, f"{part} int, _carry long") if offsets else spark.createDataFrame(
        [], f"{part} int, _carry long"
    )
    with_first = F.broadcast(table.join(first, part))
    same = (F.struct(*keys) if keys else F.lit(0)) == F.col("_first")
    joined = counted.join(with_first, part)
    return joined.withColumn(out, F.col(local) + F.when(same, F.col("_carry")).otherwise(F.lit(0))).drop(
        local, part, "_carry", "_first"
    )


def exact_median(
    df: DataFrame, group: Sequence[str], column: str, out: str, in_memory: int = 50_000, bins: int = 4096
) -> DataFrame:
    """Exact median per group; a group without values has a missing one.

    One small aggregate tells the size of the largest group. Groups of up to ``in_memory`` values are settled by one
    further aggregate that holds their distinct values. Beyond that nothing is sorted and no value is shuffled: each round counts the values
    of every group's open range in ``bins`` intervals, which combine before the shuffle, and keeps the interval that holds
    the middle, until an interval is one value or has ``in_memory`` values at most. A hot group is no heavier than others.
    """
    names = [f"_k{i}" for i in range(len(group))]
    rows = df.select(*[col(g).alias(k) for g, k in zip(group, names)], col(column).cast("double").alias("_v"))
    sizes = stage(rows.groupBy(*names).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= in_memory:
        return df.groupBy(*[col(g) for g in group]).agg(F.percentile(col(column).cast("double"), F.lit(0.5)).alias(out))
    low, up = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    left = sizes.where(F.col("_n") > 0).select(*names, "_lo", "_hi", "_n", low.alias("_low"), up.alias("_up"))
    done: list[DataFrame] = []
    while True:
        settled = F.col("_lo") == F.col("_hi")
        done.append(left.where(settled).select(*names, F.col("_lo").alias("_a"), F.col("_lo").alias("_b")))
        left = left.where(~settled)
        most = left.agg(F.max("_n")).first()[0] or 0
        if most == 0:
            break
        within = (rows.join(left, names) if names else rows.crossJoin(F.broadcast(left))).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        if most <= in_memory:
            values = within.groupBy(*names, "_low", "_up").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
            done.append(values.select(*names, F.element_at("_s", F.col("_low").cast("int")).alias("_a"), F.element_at("_s", F.col("_up").cast("int")).alias("_b")))
            break
        # halves keep the width finite; an endless range parts into its ends and what lies between
        width = F.col("_hi") / 2 - F.col("_lo") / 2
        share = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * bins), F.lit(bins - 1))
        ends = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), bins - 1).otherwise(bins // 2)
        bin_of = F.when(width == float("inf"), ends).otherwise(share).cast("int").alias("_bin")
        counted = within.groupBy(*names, "_low", "_up", bin_of).agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        upto = F.sum("_c").over(Window.partitionBy(*names).orderBy("_bin"))  # at most `bins` rows per group
        placed = counted.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))
        holds = lambda rank: (F.col("_before") < F.col(rank)) & (F.col("_upto") >= F.col(rank))
        shape = F.struct("_from", "_to", "_before", "_c", "_bin")
        picked = placed.groupBy(*names, "_low", "_up").agg(F.max(F.when(holds("_low"), shape)).alias("_l"), F.max(F.when(holds("_up"), shape)).alias("_u"))
        picked = stage(picked, "median")
        same = F.col("_l._bin") == F.col("_u._bin")
        # the middle pair falls apart: the last value of one interval and the first of the next
        done.append(picked.where(~same).select(*names, F.col("_l._to").alias("_a"), F.col("_u._from").alias("_b")))
        rank = lambda name: (F.col(name) - F.col("_l._before")).alias(name)
        left = picked.where(same).select(*names, F.col("_l._from").alias("_lo"), F.col("_l._to").alias("_hi"), F.col("_l._c").alias("_n"), rank("_low"), rank("_up"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    middle = (F.col("_a") + F.col("_b")) / 2
    every = sizes.select(*names).join(found, names, "left") if names else found
    return every.select(*[col(k).alias(g) for k, g in zip(names, group)], middle.alias(out))
