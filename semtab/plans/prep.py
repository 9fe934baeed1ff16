"""Jobs on tables before they are queried: profiles, key paths, related samples, call estimates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtab.functions.claims import HOLE, distinct_holes
from semtab.models.base import count_tokens
from semtab.models.prompts import PromptSpec
from semtab.operators.matching import sides
from semtab.runtime import col, dtype_of, missing, pick, require_columns

EXAMPLES = 6  # example values per column
LONG_TEXT = 50  # characters above which a text column shows one value only

_DTYPES = {"bigint": "int64", "int": "int64", "smallint": "int64", "tinyint": "int64", "double": "float64",
           "float": "float64", "boolean": "bool"}


def _dtype_name(dtype: T.DataType) -> str:
    return _DTYPES.get(dtype.simpleString(), "object")


def profile_table(df: DataFrame, descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """One row per column: ``column``, ``dtype``, ``n_distinct`` shown, ``examples`` and ``profile`` text.

    Up to six distinct values are shown, chosen by least md5 where there are more. A
    text column whose first shown value is long shows that one only. Two aggregates
    without a shuffle of data: the first sizes the columns, the second keeps only
    values whose hash is small enough to be among the least.
    """
    names = df.columns
    texts = [F.when(~missing(df, c), col(c).cast("string")) for c in names]
    sizes = df.agg(*[F.approx_count_distinct(t).alias(f"c{i}") for i, t in enumerate(texts)]).first()
    shares = [1.0 if sizes[i] <= 256 else 128 / sizes[i] for i in range(len(names))]
    rows: dict[int, list] = {}
    open_columns = list(range(len(names)))
    while open_columns:
        kept = []
        for i in open_columns:
            limit = "g" if shares[i] >= 1 else format(int(shares[i] * (1 << 64)), "016x")
            h = F.md5(texts[i])
            kept.append(F.collect_set(F.when(h < F.lit(limit), F.struct(h.alias("h"), texts[i].alias("v")))).alias(f"s{i}"))
        found = df.agg(*kept).select(
            *[F.slice(F.array_sort(f"s{i}"), 1, EXAMPLES).alias(f"s{i}") for i in open_columns]).first()
        again = []
        for i in open_columns:
            got = [e["v"] for e in found[f"s{i}"]]
            if len(got) < EXAMPLES and shares[i] < 1:  # the size was overestimated: widen and look again
                shares[i] = min(1.0, shares[i] * 64)
                again.append(i)
            else:
                rows[i] = got
        open_columns = again
    out = []
    for i, c in enumerate(names):
        values = rows[i]
        is_text = isinstance(dtype_of(df, c), T.StringType)
        if is_text and values and len(values[0]) > LONG_TEXT:
            values = values[:1]
        dtype = _dtype_name(dtype_of(df, c))
        examples = "; ".join(values)
        lead = f"description: {descriptions[c]} " if descriptions else ""
        out.append((i, c, dtype, len(values), examples, f"{lead}dtype={dtype} e.g. {examples}"))
    schema = "position int, column string, dtype string, n_examples int, examples string, profile string"
    return df.sparkSession.createDataFrame(out, schema)


def step_profile(name: str, df: DataFrame, descriptions: Mapping[str, str] | None = None) -> str:
    """The result line of a step: table name, profile and number of rows."""
    rows = profile_table(df, descriptions).orderBy("position").collect()
    shown = {"*": "all columns", **{r["column"]: r["profile"] for r in rows}}
    return f"{name}: {shown} table_length: {df.count()}"


def fk_paths(edges: DataFrame, size: int) -> DataFrame:
    """All simple paths over ``size`` tables that follow foreign keys.

    ``edges`` holds ``child parent``; the result has one column ``path``. Every
    further table is one join on the last table of the paths so far.
    """
    nodes = edges.select(F.col("child").alias("n")).union(edges.select("parent")).distinct()
    paths = nodes.select(F.array("n").alias("path"))
    links = edges.select(F.col("child").alias("_from"), F.col("parent").alias("_to")).distinct()
    for _ in range(size - 1):
        paths = (
            paths.join(links, F.element_at("path", -1) == F.col("_from"))
            .where(~F.array_contains("path", F.col("_to")))
            .select(F.array_append("path", F.col("_to")).alias("path"))
        )
    return paths


def fk_edges(tables: Sequence[str], columns: Sequence[tuple[int, str]], foreign_keys: Sequence[tuple[int, int]], spark) -> DataFrame:
    """Schema metadata as an edge table ``child parent child_column parent_column``."""
    rows = []
    for a, b in foreign_keys:
        (ct, cc), (pt, pc) = columns[a], columns[b]
        rows.append((tables[ct], tables[pt], cc, pc))
    return spark.createDataFrame(rows, "child string, parent string, child_column string, parent_column string")


def _pseudo_random(df: DataFrame, seed: int) -> Column:
    """A fixed random-looking order of rows, with the row itself as last resort."""
    return F.md5(F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(col(c).cast("string"), F.lit("\x00")) for c in df.columns]))


def sample_related(df: DataFrame, n: int, related: Mapping[str, DataFrame], seed: int = 42) -> DataFrame:
    """At most ``n`` rows of ``df``, those related to earlier samples first.

    ``related`` maps a column of ``df`` to one-column tables of wanted values. Too few
    related rows are topped up with others; of too many, one per wanted key
    combination comes first. Only aggregates and top-n, so a key with very many rows
    is no burden.
    """
    require_columns(df, list(related))
    marked = df.withColumn("_order", _pseudo_random(df, seed))
    hit = F.lit(False)
    for i, (c, values) in enumerate(related.items()):
        wanted = values.select(pick(values, values.columns[0]).alias(f"_w{i}")).where(
            F.col(f"_w{i}").isNotNull()).distinct()
        marked = marked.join(wanted, col(c) == F.col(f"_w{i}"), "left")
        hit = hit | F.col(f"_w{i}").isNotNull()
    marked = marked.withColumn("_hit", hit).drop(*[f"_w{i}" for i in range(len(related))])
    keys = [col(c) for c in related]
    if keys:
        firsts = (
            marked.where("_hit").groupBy(*[k.alias(f"_f{i}") for i, k in enumerate(keys)])
            .agg(F.min("_order").alias("_order")).orderBy("_order").limit(n).select("_order", F.lit(True).alias("_first"))
        )
        # at most n rows, which the caller may have set high
        marked = marked.join(F.broadcast(firsts) if n <= 100_000 else firsts, "_order", "left")
    else:
        marked = marked.withColumn("_first", F.lit(None).cast("boolean"))
    place = F.when(F.col("_first"), 0).when(F.col("_hit"), 1).otherwise(2)
    return marked.orderBy(place, "_order").limit(n).select(*[col(c) for c in df.columns])


def sample_path(
    path: Sequence[str], tables: Mapping[str, DataFrame], edges: Sequence[tuple[str, str, str, str]], n: int = 1000,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Samples of the tables on a key path, each related to the samples before it.

    ``edges`` are ``(child, parent, child_column, parent_column)``.
    """
    done: dict[str, DataFrame] = {}
    for name in path:
        related = {
            pc: done[child].select(col(cc)) for child, parent, cc, pc in edges if parent == name and child in done
        }
        done[name] = sample_related(tables[name], n, related, seed)
    return done


def sample_added(
    name: str, tables: Mapping[str, DataFrame], done: Mapping[str, DataFrame],
    edges: Sequence[tuple[str, str, str, str]], n: int = 1000, seed: int = 42,
) -> DataFrame:
    """A sample of one more table, related in either key direction to samples that exist."""
    related: dict[str, DataFrame] = {}
    for child, parent, cc, pc in edges:
        column, values = None, None
        if parent == name and child in done:
            column, values = pc, done[child].select(col(cc).alias("_v"))
        elif child == name and parent in done:
            column, values = cc, done[parent].select(col(pc).alias("_v"))
        if column is not None:
            related[column] = related[column].union(values) if column in related else values
    return sample_related(tables[name], n, related, seed)


# --- what a step would cost ------------------------------------------------


def filter_calls(df: DataFrame, claim: str) -> DataFrame:
    """Upper bound of calls for a per-row step: the product of distinct counts of its columns."""
    names = distinct_holes(claim)
    require_columns(df, names)
    product = F.lit(1).cast("long")
    for n in names:
        product = product * F.count_distinct(col(n))
    return df.agg(product.alias("calls"))


def input_calls(df: DataFrame, claim: str) -> DataFrame:
    """Calls a per-row step will make: its distinct inputs without missing values."""
    names = distinct_holes(claim)
    present = df
    for n in names:
        present = present.where(~missing(df, n))
    return present.agg(F.count_distinct(*[col(n) for n in names]).alias("calls"))


def join_calls(left: DataFrame, right: DataFrame, claim: str) -> DataFrame:
    """Calls a semantic join will make: distinct left values times distinct right values."""
    _, lc, _, rc = sides(claim, left, right)
    a = left.agg(F.count_distinct(col(lc)).alias("n"))
    b = right.agg(F.count_distinct(col(rc)).alias("n"))
    return a.select((F.col("n") * b.scalar()).alias("calls"))


def topk_calls(df: DataFrame, question: str, k: int, method: str = "quick") -> DataFrame:
    """Expected calls of a semantic top-k over the rows of ``df``."""
    n = F.count("*").cast("double")
    log = F.log(F.greatest(n, F.lit(1.0)))
    formula = {
        "quick": 2 * F.lit(k) + 2 * n * log,
        "heap": n * log + F.lit(k) * log,
        "naive": n * (n - 1) / 2,
    }
    if method not in formula:
        raise ValueError(f"method is one of {tuple(formula)}")
    require_columns(df, distinct_holes(question))
    return df.agg(formula[method].alias("calls"))


def prompt_tokens(df: DataFrame, context: Column, spec: PromptSpec) -> DataFrame:
    """Tokens that all prompts of a step hold together, a quarter of their characters."""
    fixed = sum(count_tokens(m["content"]) for m in spec.messages(""))
    return df.agg(F.coalesce(F.sum(F.ceil(F.length(context) / 4) + F.lit(fixed)), F.lit(0)).alias("tokens"))


def referenced_columns(steps: DataFrame, params: str = "params") -> DataFrame:
    """Distinct column names that steps refer to.

    ``params`` is a column of text arrays: bare names, ``[a, b]`` lists and claims with
    holes. Side marks ``:left :right`` and suffixes ``_x _y`` are removed.
    """
    item = steps.select(F.explode(col(params)).alias("item"))
    inner = F.split(F.regexp_extract("item", r"\A\[(.*)\]\z", 1), r"\s*,\s*")
    names = (
        F.when(F.col("item").startswith("["), inner)
        .when(F.col("item").contains("{"), F.regexp_extract_all("item", F.lit(HOLE), F.lit(1)))
        .otherwise(F.array("item"))
    )
    name = F.regexp_replace(F.trim(F.col("name")), r"(:left|:right|_x|_y)\z", "")
    return item.select(F.explode(names).alias("name")).select(name.alias("column")).where("column != ''").distinct()
