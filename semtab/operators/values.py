"""Relational steps: filter, project, sort, head, join, aggregate, group, calculate.

Plain DataFrame expressions throughout, so filters and column choices reach the
scan and Catalyst plans the rest.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.operators.running import exact_median
from semtab.runtime import col, dtype_of, is_numeric, missing, pick, require_columns

COMPARISONS = ("eq", "ne", "gt", "lt", "ge", "le", "like")


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


# --- filter, project -------------------------------------------------------


def like_pattern(text: str) -> str:
    """``%`` matches anything; all other characters stand for themselves."""
    return r"(?i)\A(?:" + ".*".join(re.escape(part) for part in text.split("%")) + ")"


def condition(df: DataFrame, column: str, op: str, value) -> Column:
    """One comparison of a column with a literal, or with the one-row table of an aggregate."""
    if op not in COMPARISONS:
        raise ValueError(f"operator {op!r} is not one of {COMPARISONS}")
    c, dtype = col(column), dtype_of(df, column)
    if isinstance(value, DataFrame):
        if op == "like":
            raise ValueError("like takes a text, not a scalar table")
        literal = value.scalar()
        compare = {"eq": c == literal, "ne": ~c.eqNullSafe(literal), "gt": c > literal,
                   "lt": c < literal, "ge": c >= literal, "le": c <= literal}
        return compare[op]
    if value is None or (isinstance(value, str) and value == "nan") or value != value:
        if op not in ("eq", "ne"):
            raise ValueError(f"operator {op!r} does not apply to a missing value")
        return missing(df, column) if op == "eq" else ~missing(df, column)
    if op == "like":
        if not isinstance(dtype, T.StringType):
            raise ValueError(f"like needs a text column; {column!r} is {dtype.simpleString()}")
        return F.coalesce(c.rlike(like_pattern(str(value))), F.lit(False))
    if is_numeric(dtype):
        try:
            number = float(value)
        except (TypeError, ValueError):
            raise ValueError(f"column {column!r} is numeric and cannot be compared with {value!r}") from None
        whole = isinstance(dtype, T.IntegralType) and number.is_integer() and abs(number) < 2**53
        literal = F.lit(int(number)) if whole else F.lit(number)
        if whole and isinstance(value, int):
            literal = F.lit(value)
    else:
        dated = isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
        if op in ("gt", "lt", "ge", "le") and not dated:
            raise ValueError(f"operator {op!r} does not apply to the text column {column!r}")
        literal = F.lit(value).cast(dtype)
    if op == "eq":
        return c == literal
    if op == "ne":
        return ~c.eqNullSafe(literal)
    return {"gt": c > literal, "lt": c < literal, "ge": c >= literal, "le": c <= literal}[op]


def filter_rows(df: DataFrame, column: str, conditions: Sequence[tuple[str, object]]) -> DataFrame:
    """Rows that meet all conditions on one column. ``ne`` keeps rows with a missing value."""
    require_columns(df, [column])
    for op, value in conditions:
        df = df.where(condition(df, column, op, value))
    return df


def project(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """The named columns, in the given order, repeats kept."""
    names = _names(columns)
    require_columns(df, names)
    return df.select(*[col(n) for n in names])


# --- order -----------------------------------------------------------------


def sort_keys(df: DataFrame, columns: Sequence[str], ascending: bool) -> list[Column]:
    """Sort columns with missing values last in both directions."""
    keys: list[Column] = []
    for name in columns:
        c = col(name)
        if isinstance(dtype_of(df, name), (T.DoubleType, T.FloatType)):
            c = F.when(~missing(df, name), c)
        keys.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    return keys


def orderby(
    df: DataFrame, columns: str | Sequence[str], ascending: bool | str = True, tie_break: str | Sequence[str] = ()
) -> DataFrame:
    """Sort by one or more columns in one direction; ``tie_break`` columns ascend."""
    names, ties = _names(columns), _names(tie_break)
    require_columns(df, names + ties)
    if isinstance(ascending, str):
        ascending = ascending == "asc"
    return df.orderBy(*sort_keys(df, names, ascending), *sort_keys(df, ties, True))


def head(df: DataFrame, n: int, order_by: str | Sequence[str] | None = None, ascending: bool | str = True) -> DataFrame:
    """The first ``n`` rows of a sorted table, or of ``df`` sorted by ``order_by``."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError("n is a whole number of rows, 0 or more")
    if order_by is not None:
        df = orderby(df, order_by, ascending)
    return df.limit(n)


# --- join ------------------------------------------------------------------


def join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, null_safe: bool = True, spread: int = 1) -> DataFrame:
    """Inner equi-join on one column pair.

    One key column remains when both have the same name. Other names found on
    both sides get ``_x`` and ``_y``. Missing keys match each other unless
    ``null_safe`` is off.

    Where few keys have many rows on both sides the result is far larger than the tables, and each key is the
    work of one task. With ``spread`` a key's left rows are dealt over that many parts and its right rows sent to each;
    equal left rows share a part. Rows then come in short runs: a left row with some right rows, the next left
    row with the same ones, which columnar files hold in a fraction of the room.
    """
    require_columns(left, [left_on])
    require_columns(right, [right_on])
    lt, rt = dtype_of(left, left_on), dtype_of(right, right_on)
    if is_numeric(lt) != is_numeric(rt):
        raise ValueError(f"cannot join {left_on!r} ({lt.simpleString()}) with {right_on!r} ({rt.simpleString()})")
    same = left_on == right_on
    clash = (set(left.columns) & set(right.columns)) - ({left_on} if same else set())
    r = right.select(*[pick(right, c).alias(f"_r{i}") for i, c in enumerate(right.columns)])
    right_key = f"_r{right.columns.index(right_on)}"
    if spread > 1:
        l = left.select(*[pick(left, c).alias(f"_l{i}") for i, c in enumerate(left.columns)])
        joined = _spread(l, r, f"_l{left.columns.index(left_on)}", right_key, null_safe, spread)
        kept = [F.col(c) for c in l.columns]
    else:
        left_key = pick(left, left_on)
        joined = left.join(r, left_key.eqNullSafe(F.col(right_key)) if null_safe else left_key == F.col(right_key), "inner")
        kept = [pick(left, c) for c in left.columns]
    out = [x.alias(f"{c}_x" if c in clash else c) for x, c in zip(kept, left.columns)]
    for i, c in enumerate(right.columns):
        if not (same and c == right_on):
            out.append(F.col(f"_r{i}").alias(f"{c}_y" if c in clash else c))
    return joined.select(*out)


#: Right rows of a run, and hash buckets in which a key's right rows are counted off into runs.
RUN_ROWS, RUN_BUCKETS = 256, 8


def _spread(left: DataFrame, right: DataFrame, left_on: str, right_on: str, null_safe: bool, parts: int) -> DataFrame:
    """Both sides joined in parts of their keys: the columns of ``left`` and those of ``right``.

    The numbers of tasks are given, as adaptive execution would merge these small inputs of a large result into few tasks;
    there are enough for a task to hold the rows of few keys, so that its files can name their values by dictionaries.
    Keys are dealt by a hash and compared beside it, so that the join needs no further shuffle. Right rows are joined by
    runs of :data:`RUN_ROWS`, a run of them with each left row before the next run, and unpacked in the task that writes them.
    """
    alike = dtype_of(left, left_on) == dtype_of(right, right_on)

    def hashed(df: DataFrame, on: str) -> Column:
        c, dtype = col(on), dtype_of(df, on)
        if not alike:
            # equal numbers are equal as floats, whatever type they are compared in; other types are only dealt
            c = c.cast("float") if is_numeric(dtype) else F.lit(0)
        return F.xxhash64(c)  # of both zeros alike

    def dealt(df: DataFrame, count: int) -> Column:
        plain = [col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
        return F.pmod(F.xxhash64(F.lit(1), *plain), F.lit(count)).cast("int")

    session = left.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism, 16 * parts)
    l = left.withColumns({"_lkey": hashed(left, left_on), "_lpart": dealt(left, parts)})
    r = right.select(hashed(right, right_on).alias("_rkey"), col(right_on).alias("_rvalue"), dealt(right, RUN_BUCKETS).alias("_rbucket"), F.struct("*").alias("_row"))
    place = F.row_number().over(Window.partitionBy("_rkey", "_rvalue", "_rbucket").orderBy(F.lit(0)))
    r = r.withColumn("_rrun", F.floor((place - 1) / RUN_ROWS))
    r = r.groupBy("_rkey", "_rvalue", "_rbucket", "_rrun").agg(F.collect_list("_row").alias("_rows"))
    r = r.select("_rkey", "_rvalue", "_rows", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_rpart"))
    l, r = l.repartition(tasks, "_lkey", "_lpart"), r.repartition(tasks, "_rkey", "_rpart")
    a, b = F.col(left_on), F.col("_rvalue")
    met = F.coalesce(a == b, a.isNull() & b.isNull() if null_safe else F.lit(False))
    # the order within a task is that of a merge join, whose left side, the runs, is the outer loop
    joined = r.hint("merge").join(l, (F.col("_rkey") == F.col("_lkey")) & (F.col("_rpart") == F.col("_lpart")) & met, "inner")
    return joined.select(*left.columns, F.inline("_rows"))


# --- aggregate -------------------------------------------------------------

BASIC = ("sum", "mean", "count", "min", "max")
SPREAD = ("std", "var", "nunique", "prod")
ORDERED = ("first", "last")


def _aggregate(df: DataFrame, column: str, func: str, order_by: str | None = None) -> Column:
    present = F.when(~missing(df, column), col(column))
    if func in ("sum", "mean", "std", "var", "prod", "median") and not is_numeric(dtype_of(df, column)):
        raise ValueError(f"{func} needs a numeric column; {column!r} is {dtype_of(df, column).simpleString()}")
    if func == "sum":
        zero = F.lit(0).cast(dtype_of(df, column))
        return F.coalesce(F.sum(present), zero)
    if func == "mean":
        return F.avg(present)
    if func in ORDERED:
        if order_by is None:
            raise ValueError(f"{func} needs order_by=, a table has no order of its own")
        pickers = {"first": F.min_by, "last": F.max_by}
        return pickers[func](present, F.when(~missing(df, column), col(order_by)))
    simple = {
        "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp,
        "var": F.var_samp, "nunique": F.count_distinct, "prod": F.product,
    }
    if func not in simple:
        raise ValueError(f"function {func!r} is not one of {BASIC + SPREAD + ORDERED + ('median',)}")
    return simple[func](present)


def agg(df: DataFrame, column: str, func: str, out: str | None = None) -> DataFrame:
    """One function over one column, as a table of one row and one column.

    ``agg(df, "*", "count")`` counts the present values of every column.
    """
    if column == "*":
        if func != "count":
            raise ValueError("'*' goes with count only")
        return df.agg(*[F.count(F.when(~missing(df, c), col(c))).alias(c) for c in df.columns])
    require_columns(df, [column])
    if func not in BASIC:
        raise ValueError(f"function {func!r} is not one of {BASIC}")
    return df.agg(_aggregate(df, column, func).alias(out or f"{column}_{func}"))


def groupby(
    df: DataFrame,
    keys: str | Sequence[str],
    column: str,
    func: str,
    *,
    order_by: str | None = None,
    sort: bool = False,
    in_memory: int = 50_000,
) -> DataFrame:
    """Group by ``keys`` and aggregate one column into ``{column}_{func}``.

    Rows with a missing key are left out. ``count`` may target a key column,
    other functions may not. ``sort=True`` returns the groups in key order. Medians are exact; groups of more
    than ``in_memory`` values are settled by rounds of counting instead of one aggregate.
    """
    names = _names(keys)
    require_columns(df, [*names, column])
    if column in names and func != "count":
        raise ValueError(f"column {column!r} is a group key; only count applies to it")
    out = f"{column}_{func}"
    kept = df
    for name in names:
        kept = kept.where(~missing(df, name))
    if func == "median":
        if not is_numeric(dtype_of(df, column)):
            raise ValueError(f"median needs a numeric column; {column!r} is not")
        present = kept.withColumn(column, F.when(~missing(kept, column), col(column)))
        grouped = exact_median(present, names, column, out, in_memory)
    else:
        grouped = kept.groupBy(*[col(n) for n in names]).agg(_aggregate(df, column, func, order_by).alias(out))
    return grouped.orderBy(*[col(n) for n in names]) if sort else grouped


# --- calculate -------------------------------------------------------------

ARITHMETIC = ("add", "sub", "mul", "div")


def _divide(a: Column, b: Column, zero: str) -> Column:
    a, b = a.cast("double"), b.cast("double")
    quotient = F.try_divide(a, b)
    if zero == "null":
        return quotient
    infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, infinite).otherwise(quotient)


def column_calculate(
    df: DataFrame, column1: str, column2: str, operation: str, out: str = "result", zero: str = "float"
) -> DataFrame:
    """``add sub mul div`` of two columns into ``out``; ``add`` of two text columns joins them.

    Division by zero gives infinity or NaN as floating arithmetic does, or NULL
    with ``zero="null"``.
    """
    require_columns(df, [column1, column2])
    if operation not in ARITHMETIC:
        raise ValueError(f"operation {operation!r} is not one of {ARITHMETIC}")
    a, b = col(column1), col(column2)
    numeric = [is_numeric(dtype_of(df, c)) for c in (column1, column2)]
    if not all(numeric):
        if operation != "add" or any(numeric):
            raise ValueError(f"{operation} does not apply to {column1!r} and {column2!r}")
        value = F.concat(a, b)
    elif operation == "div":
        value = _divide(a, b, zero)
    else:
        value = {"add": a + b, "sub": a - b, "mul": a * b}[operation]
    return df.withColumn(out, value)


def _scalar(value) -> tuple[DataFrame | None, Column | None]:
    if isinstance(value, DataFrame):
        if len(value.columns) != 1:
            raise ValueError("a scalar table has one column")
        return value, None
    return None, F.lit(float(value))


def value_calculate(operation: str, a, b=None, out: str = "result", spark=None) -> DataFrame:
    """``add sub mul div`` of two scalars, or ``round`` of one, half to even.

    Each operand is a number or the one-row table an aggregate returns; tables
    enter as scalar subqueries, so nothing is computed before the final action.
    """
    if operation == "round":
        if b is not None:
            raise ValueError("round takes one value")
    elif operation in ARITHMETIC:
        if b is None:
            raise ValueError(f"{operation} takes two values")
    else:
        raise ValueError(f"operation {operation!r} is not one of {ARITHMETIC + ('round',)}")
    if operation == "div" and isinstance(b, (int, float)) and b == 0:
        raise ZeroDivisionError("division by zero")
    operands = []
    for value in (a,) if b is None else (a, b):
        table, literal = _scalar(value)
        operands.append(table.scalar().cast("double") if table is not None else literal)
        spark = spark or (table.sparkSession if table is not None else None)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
    if operation == "round":
        value = F.bround(operands[0], 0)
    else:
        x, y = operands
        value = {"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: x / y}[operation]()
    return spark.range(1).select(value.alias(out))
