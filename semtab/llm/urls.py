"""URL rules by a sort-merge range join over reversed hosts."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semtab.runtime import col, require_columns, stage


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty if it is missing or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the right, each with a dot behind it: a host's subdomains are exactly the keys that start with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``host path verdict`` from pairs such as ``("block", "example.com/en/")``."""
    rows = [F.struct(F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path"), F.lit(v).alias("verdict")) for v, r in rules]
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    return spark.range(1).select(F.inline(F.array(*rows)))


def _chains(rules: DataFrame) -> DataFrame:
    """``_node _path _chain`` for every rule: its host's key, its path, and all rules of the host whose paths its own begins with.

    A rule is nested in those whose paths are prefixes of its own. They are found by joining its prefixes to the rules
    themselves; only lengths that the host's rules have are tried, so no list of a host's rules is made.
    """
    clean = rules.where("host IS NOT NULL AND host != ''").select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    # of equal rules that disagree the one that blocks holds
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = clean.groupBy("host").agg(F.collect_set(F.length("path")).alias("_lengths"))
    shorter = F.filter("_lengths", lambda n: n <= F.length("path"))
    prefixes = clean.join(lengths, "host").select("host", "path", F.explode(shorter).alias("_n")).select("host", "path", F.expr("substr(path, 1, _n)").alias("_prefix"))
    outer = clean.select(col("host").alias("_h"), col("path").alias("_p"), "verdict")
    nested = prefixes.join(outer, (F.col("host") == F.col("_h")) & (F.col("_prefix") == F.col("_p")))
    size = F.length("_h") + F.length("_p")
    entry = F.struct(size.alias("size"), F.length("_h").alias("host_size"), F.concat("_h", "_p").alias("rule"), F.col("_p").alias("path"), F.col("verdict").alias("verdict"))
    chains = nested.groupBy("host", "path").agg(F.sort_array(F.collect_list(entry), asc=False).alias("_chain"))
    return chains.select(host_key(F.col("host")).alias("_node"), F.col("path").alias("_path"), "_chain")


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``id host path rule verdict`` for every row of ``pages``: the longest fitting rule decides, else ``default``.

    ``rules`` holds ``host path verdict``. A rule fits its host and all subdomains where the
    url's path starts with the rule's path. The longest of host and path together wins, of
    equally long ones the longer host. Equal rules count once, ``block`` before ``allow``.

    Reversed hosts with the path behind make the urls of a rule an interval of keys. A url has one key for its host and
    for each host above it that has rules, at most as many as labels. Keys of urls and rules are range-partitioned together, with a
    hash of the row behind, so one host or even one url with a third of all rows spreads over many shards. Inside a shard
    one sorted sweep holds the last rule and the stack of rules around it: every rule whose interval is still open is on that
    stack, as the keys between a prefix and a key that begins with it begin with it too. What is open when a shard begins is
    the stack of the last rule of the shards before. Of a url's keys the longest rule wins. Work grows with the number of
    urls and rules times its logarithm; a stack is as long as rules are nested in each other.

    A missing url, or one without ``://``, has an empty host and path and fits no rule. Repeated
    rows each give a row, as do rows without an id. Other columns are left out, whatever their names. Very long urls are keys like others.
    """
    require_columns(pages, [id_col, url_col])
    url = col(url_col).cast("string")
    host, path = host_and_path(F.coalesce(url, F.lit("")))
    keyed = pages.select(col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    # staged, so that a row keeps its number in both uses
    rows = stage(keyed.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    chains = stage(_chains(rules), "url-rules")
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.reverse(F.slice(labels, F.size(labels) - n + 1, n)), "."), F.lit(".")))
    keys = rows.select("_row", F.explode(above).alias("_node"), F.col("path").alias("_path")).join(chains.select("_node").distinct(), "_node", "left_semi")
    shape = chains.schema["_chain"].dataType
    # a rule stands before the urls of the same key
    events = keys.select("_node", "_path", F.lit(1).alias("_url"), F.xxhash64("_row").alias("_salt"), "_row", F.lit(None).cast(shape).alias("_chain")).unionByName(
        chains.select("_node", "_path", F.lit(0).alias("_url"), F.lit(0).cast("long").alias("_salt"), F.lit(None).cast("long").alias("_row"), "_chain")
    )
    events = stage(events.repartitionByRange("_node", "_path", "_url", "_salt").withColumn("_shard", F.spark_partition_id()), "url-shards")
    # one row per shard, at most as many as there are shuffle partitions: its last rule is what the next shards begin with
    place = F.struct("_node", "_path")
    lasts = events.groupBy("_shard").agg(F.max_by(F.struct("_node", "_chain"), F.when(F.col("_url") == 0, place)).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    carried = lasts.withColumn("_last", before).where("_last IS NOT NULL").select(F.lit("").alias("_node"), F.lit("").alias("_path"), F.lit(-1).alias("_url"), F.lit(None).cast("long").alias("_row"), "_shard", "_last")
    swept = events.select("_node", "_path", "_url", "_row", "_shard", F.when(F.col("_url") == 0, F.struct("_node", "_chain")).alias("_last")).unionByName(carried)
    sweep = Window.partitionBy("_shard").orderBy(F.col("_url") >= 0, "_node", "_path", "_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("_open", F.last("_last", ignorenulls=True).over(sweep)).where("_url = 1")
    fitting = F.filter("_open._chain", lambda r: (F.col("_open._node") == F.col("_node")) & F.col("_path").startswith(r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"], r["host_size"], r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    found = swept.select("_row", best.alias("_best")).where("_best IS NOT NULL").groupBy("_row").agg(F.max("_best").alias("_best"))
    return rows.join(found, "_row", "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )
