"""Suite queries for relational steps, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from semtab.operators import values as V
from semtab.plans.steps import Ref, Step, run_steps
from semtab.runtime import staging_root
from semtab.sources import readers, writers
from semtab.suite.registry import Tables, query


def _folder(t: Tables) -> str:
    return f"{staging_root(t.spark).rstrip('/')}/semtab-suite/{uuid.uuid4().hex}"


# --- sources and sinks -----------------------------------------------------


@query("""SELECT o_orderstatus, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total
          FROM orders GROUP BY o_orderstatus""")
def scan_csv(t):
    folder = _folder(t)
    writers.sink_tables_csv({"orders": t.orders}, folder)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    back = readers.scan_csv(t.spark, f"{folder}/orders.csv", schema, multiline=False)
    return back.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
          CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || chr(10) || 'second, "line"' END AS note FROM orders""")
def scan_csv_missing(t):
    """Words for missing values, dates as text, and quoted fields with line breaks, with types read off the cells."""
    folder = _folder(t)
    day = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("null")
    price = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice").cast("string")).otherwise("NA")
    note = F.when(F.col("o_orderkey") % 5 != 0, F.concat("o_orderpriority", F.lit('\nsecond, "line"'))).otherwise("N/A")
    writers.sink_tables_csv({"orders": t.orders.select("o_orderkey", price.alias("price"), day.alias("day"), note.alias("note"))}, folder)
    return readers.scan_csv(t.spark, f"{folder}/orders.csv")


@query("SELECT doc_id, md5(nullif(trim(text), '')) AS text_md5, n_chars FROM documents")
def scan_csv_documents(t):
    """Whole texts with their line breaks and quotes, written and read back."""
    folder = _folder(t)
    writers.sink_tables_csv({"documents": t.documents.select("doc_id", F.trim("text").alias("text"), "n_chars")}, folder)
    back = readers.scan_csv(t.spark, f"{folder}/documents.csv", "doc_id long, text string, n_chars long")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "n_chars")


@query("""SELECT DISTINCT p_name AS name,
                 'column_description=' || p_brand || '; value_description=' ||
                 CASE WHEN p_partkey % 3 = 0 THEN 'NULL' ELSE 'one two, ' || p_type END AS description FROM part""")
def scan_description_csv(t):
    folder = _folder(t)
    value = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("one\ntwo, "), "p_type"))
    described = t.part.select(
        F.concat(F.lit(" "), "p_name").alias("original_column_name"), F.col("p_brand").alias("column_description"), value.alias("value_description"))
    writers.sink_tables_csv({"part": described}, folder)
    return readers.scan_description_csv(t.spark, f"{folder}/part.csv").distinct()


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def sink_tables(t):
    folder = _folder(t)
    writers.sink_tables({"supplier": t.supplier}, folder)
    return t.spark.read.parquet(f"{folder}/supplier.parquet")


@query("SELECT conv_id, CAST(turn AS BIGINT) AS pos, role AS operator, text AS params FROM conversations")
def scan_process_json(t):
    folder = _folder(t)
    steps = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("operator"), F.col("text").alias("params"))))
    docs = t.conversations.groupBy(F.col("conv_id").cast("string").alias("database")).agg(steps.alias("process"))
    writers.sink_results_json(docs, folder)
    read = readers.scan_process_json(t.spark, folder, multiline=False)
    out = readers.steps_of(read)
    return out.select(F.col("database").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("pos"),
                      "operator", "params")


@query("SELECT vec_id AS key, len(embedding) AS dim FROM embeddings")
def scan_vectors(t):
    folder = _folder(t)
    writers.sink_vectors(t.embeddings, "vec_id", "embedding", folder)
    return readers.scan_vectors(t.spark, folder).select("key", F.size("vec").cast("long").alias("dim"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume(t):
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.pending(t.orders.select("o_orderkey", "o_totalprice"), done, "o_orderkey")


# --- filter, project, calculate --------------------------------------------

_LINE = "l_orderkey, l_linenumber, l_partkey, l_quantity"


@query(f"SELECT {_LINE} FROM lineitem WHERE l_quantity >= 24 AND l_quantity <= 36")
def filter_range(t):
    df = V.filter_rows(t.lineitem, "l_quantity", [("ge", "24"), ("le", 36)])
    return V.project(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


@query(f"SELECT {_LINE} FROM lineitem WHERE l_quantity > 10 AND l_quantity < 12.5 AND l_quantity <> 11")
def filter_gt_lt_ne(t):
    df = V.filter_rows(t.lineitem, "l_quantity", [("gt", 10), ("lt", 12.5), ("ne", 11)])
    return V.project(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


@query("SELECT * FROM part WHERE p_type = 'ECONOMY'")
def filter_eq_text(t):
    return V.filter_rows(t.part, "p_type", [("eq", "ECONOMY")])


@query("SELECT * FROM part WHERE p_name <> 'red widget' AND p_name <> 'Red widget'")
def filter_ne_text(t):
    return V.filter_rows(t.part, "p_name", [("ne", "red widget"), ("ne", "Red widget")])


@query("SELECT * FROM part WHERE regexp_matches(p_name, '^re.*w', 'i')")
def filter_like(t):
    return V.filter_rows(t.part, "p_name", [("like", "RE%W")])


@query("""SELECT CAST(count(*) FILTER (l_quantity IS NULL) AS BIGINT) AS without,
                 CAST(count(*) FILTER (l_quantity IS NOT NULL) AS BIGINT) AS present
          FROM (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity FROM lineitem)""")
def filter_nan(t):
    df = t.lineitem.select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"))
    out = [V.filter_rows(df, "l_quantity", [(op, "nan")]).select(F.lit(op).alias("op")) for op in ("eq", "ne")]
    return out[0].union(out[1]).agg(
        F.count_if(F.col("op") == "eq").alias("without"), F.count_if(F.col("op") == "ne").alias("present"))


@query("SELECT c_name, c_acctbal, c_mktsegment FROM customer", name="map")
def map_(t):
    return V.project(t.customer, ["c_name", "c_acctbal", "c_mktsegment"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey,
                 round(l_extendedprice * l_discount, 6) AS result FROM lineitem""")
def column_calculate_mul(t):
    df = V.column_calculate(t.lineitem, "l_extendedprice", "l_discount", "mul")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.round("result", 6).alias("result"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN NULL
                 ELSE round(l_tax / l_discount, 6) END AS result FROM lineitem""")
def column_calculate_div(t):
    df = V.column_calculate(t.lineitem, "l_tax", "l_discount", "div", zero="null")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.round("result", 6).alias("result"))


@query("SELECT p_partkey, p_brand || p_type AS result FROM part")
def column_calculate_text(t):
    return V.column_calculate(t.part, "p_brand", "p_type", "add").select("p_partkey", "result")


# --- order -----------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def orderby_head(t):
    df = V.orderby(t.orders, "o_totalprice", "desc", tie_break="o_orderkey")
    return V.project(V.head(df, 20), ["o_orderkey", "o_totalprice"])


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal, c_custkey")
def orderby_two(t):
    df = V.orderby(t.customer, ["c_mktsegment", "c_acctbal"], "asc", tie_break="c_custkey")
    return V.project(df, ["c_custkey", "c_mktsegment", "c_acctbal"])


# --- aggregate -------------------------------------------------------------

_SQL_FUNC = {"sum": "sum", "mean": "avg", "min": "min", "max": "max"}


def _add_group(func: str, sql: str) -> None:
    out = f"l_extendedprice_{func}"

    def run(t):
        df = V.groupby(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", func)
        return df.withColumn(out, F.round(F.col(out).cast("double"), 3))

    query(f"""SELECT l_returnflag, l_linestatus, round(CAST({sql} AS DOUBLE), 3) AS {out}
              FROM lineitem GROUP BY l_returnflag, l_linestatus""", name=f"groupby_{func}")(run)


for _f, _s in [
    ("sum", "sum(l_extendedprice)"), ("mean", "avg(l_extendedprice)"), ("count", "count(l_extendedprice)"),
    ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("median", "median(l_extendedprice)"),
    ("std", "stddev_samp(l_extendedprice)"), ("nunique", "count(DISTINCT l_extendedprice)"),
]:
    _add_group(_f, _s)


@query("""SELECT l_returnflag, median(l_extendedprice) AS l_extendedprice_median FROM lineitem GROUP BY l_returnflag""")
def groupby_median_large(t):
    """As for groups of more values than one task may hold: rounds of counting, nothing sorted."""
    return V.groupby(t.lineitem, "l_returnflag", "l_extendedprice", "median", in_memory=100)


@query("""SELECT p_brand, product(CAST(p_size % 3 + 1 AS DOUBLE)) AS size_prod FROM part GROUP BY p_brand""")
def groupby_prod(t):
    return V.groupby(t.part.withColumn("size", (F.col("p_size") % 3 + 1).cast("double")), "p_brand", "size", "prod")


@query("""SELECT o_orderpriority, arg_min(o_totalprice, o_orderkey) AS o_totalprice_first
          FROM orders GROUP BY o_orderpriority""")
def groupby_first(t):
    return V.groupby(t.orders, "o_orderpriority", "o_totalprice", "first", order_by="o_orderkey")


@query("""SELECT o_orderpriority, arg_max(o_totalprice, o_orderkey) AS o_totalprice_last
          FROM orders GROUP BY o_orderpriority""")
def groupby_last(t):
    return V.groupby(t.orders, "o_orderpriority", "o_totalprice", "last", order_by="o_orderkey")


@query("""SELECT l_returnflag, round(var_samp(l_quantity), 6) AS l_quantity_var FROM lineitem GROUP BY l_returnflag""")
def groupby_var(t):
    df = V.groupby(t.lineitem, "l_returnflag", "l_quantity", "var")
    return df.withColumn("l_quantity_var", F.round("l_quantity_var", 6))


def _add_agg(func: str, sql: str) -> None:
    def run(t):
        df = V.agg(t.orders, "o_totalprice", func)
        return df.select(F.round(F.col(df.columns[0]).cast("double"), 2).alias(df.columns[0]))

    query(f"SELECT round(CAST({sql} AS DOUBLE), 2) AS o_totalprice_{func} FROM orders", name=f"agg_{func}")(run)


for _f, _s in [("sum", "sum(o_totalprice)"), ("mean", "avg(o_totalprice)"), ("count", "count(o_totalprice)"),
               ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)")]:
    _add_agg(_f, _s)


@query("""SELECT count(c_custkey) AS c_custkey, count(c_name) AS c_name, count(c_nationkey) AS c_nationkey,
                 count(c_acctbal) AS c_acctbal, count(c_mktsegment) AS c_mktsegment FROM customer""")
def agg_count_star(t):
    return V.agg(t.customer, "*", "count")


@query("""SELECT round((SELECT avg(l_extendedprice) FROM lineitem) -
                       (SELECT avg(o_totalprice) FROM orders), 4) AS result""")
def value_calculate_sub(t):
    out = V.value_calculate("sub", V.agg(t.lineitem, "l_extendedprice", "mean"), V.agg(t.orders, "o_totalprice", "mean"))
    return out.select(F.round("result", 4).alias("result"))


@query("SELECT round((SELECT avg(o_totalprice) FROM orders), 0) AS result")
def value_calculate_round(t):
    return V.value_calculate("round", V.agg(t.orders, "o_totalprice", "mean"))


# --- join ------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, c_mktsegment
          FROM orders JOIN customer ON o_custkey = c_custkey""")
def join(t):
    right = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return V.join(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), right, "o_custkey", "c_custkey")


@query("""SELECT c.c_nationkey AS nationkey, c.c_name AS name_x, c.c_acctbal AS acctbal_x,
                 s.s_name AS name_y, s.s_acctbal AS acctbal_y
          FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey""")
def join_same_names(t):
    left = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"),
                             F.col("c_acctbal").alias("acctbal"))
    right = t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"),
                              F.col("s_acctbal").alias("acctbal"))
    # a few nations for all rows of both tables
    return V.join(left, right, "nationkey", "nationkey", spread=32)


@query("""WITH l AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_partkey AS DOUBLE) END AS k
                     FROM lineitem),
               p AS (SELECT CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey END AS pk, p_brand FROM part)
          SELECT p_brand, count(*) AS n FROM l JOIN p ON k IS NOT DISTINCT FROM pk GROUP BY p_brand""")
def join_null_keys(t):
    left = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") != 7, F.col("l_partkey").cast("double")).alias("k"))
    right = t.part.select(F.when(F.col("p_partkey") != 0, F.col("p_partkey")).alias("pk"), "p_brand")
    return V.join(left, right, "k", "pk").groupBy("p_brand").agg(F.count("*").alias("n"))


# --- steps -----------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def placeholder(t):
    steps = [
        Step("agg", "orders", ("o_totalprice", "mean")),
        Step("filter", "orders", ("o_totalprice", (("gt", Ref(0)),))),
        Step("map", "orders_filter", (["o_orderkey", "o_totalprice"],)),
    ]
    return run_steps({"orders": t.orders}, steps).answer


@query("""SELECT c_mktsegment, max(o_totalprice) AS o_totalprice_max FROM orders JOIN customer ON o_custkey = c_custkey
          WHERE o_totalprice > 100000 GROUP BY c_mktsegment HAVING max(o_totalprice) > 1000
          ORDER BY o_totalprice_max DESC LIMIT 3""")
def run_steps_values(t):
    steps = [
        Step("join", "orders", ("customer", "o_custkey", "c_custkey")),
        Step("filter", "orders_join", ("o_totalprice", (("gt", 100000),))),
        Step("groupby", "orders_join_filter", (["c_mktsegment"], "o_totalprice", "max")),
        Step("filter", "orders_join_filter_groupby", ("o_totalprice_max", (("gt", 1000),))),
        Step("orderby", "orders_join_filter_groupby_filter", (["o_totalprice_max"], "desc")),
        Step("head", "orders_join_filter_groupby_filter_orderby", (3,)),
    ]
    return run_steps({"orders": t.orders, "customer": t.customer}, steps).answer


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_tax, 6) AS sum, round(l_extendedprice - l_tax, 6) AS difference,
          CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) WHEN l_tax > 0 THEN 'infinity'::DOUBLE END AS quotient FROM lineitem""")
def column_calculate_numbers(t):
    """Sums, differences and quotients of two columns; a number by zero is infinite, and zero by zero no number."""
    df = V.column_calculate(t.lineitem, "l_extendedprice", "l_tax", "add", out="sum")
    df = V.column_calculate(df, "l_extendedprice", "l_tax", "sub", out="difference")
    df = V.column_calculate(df, "l_tax", "l_discount", "div", out="quotient")
    return df.select("l_orderkey", "l_linenumber", F.round("sum", 6).alias("sum"), F.round("difference", 6).alias("difference"),
                     F.when(~F.isnan("quotient"), F.when(F.col("quotient") == float("inf"), F.col("quotient")).otherwise(F.round("quotient", 6))).alias("quotient"))


def _scalar(op: str, sign: str):
    @query(f"""SELECT round((SELECT avg(o_totalprice) FROM orders) {sign} (SELECT max(l_quantity) FROM lineitem), 4) AS result""", name=f"value_calculate_{op}")
    def run(t):
        out = V.value_calculate(op, V.agg(t.orders, "o_totalprice", "mean"), V.agg(t.lineitem, "l_quantity", "max"))
        return out.select(F.round(F.col(out.columns[0]), 4).alias("result"))


for _op, _sign in (("add", "+"), ("mul", "*"), ("div", "/")):
    _scalar(_op, _sign)
