"""Jobs that score answers, operator choice, plan shape and cost over many cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtab.functions.claims import bool_of
from semtab.models.answering import with_replies
from semtab.models.base import AnswerModel
from semtab.models.prompts import PromptSpec
from semtab.runtime import col, pick, split_join, stage

# Fixed values of the published scoring.
CASES_PER_BUCKET = 143
BUCKET_SIZES = (143, 143, 143, 143, 143, 143, 142)
AGREEMENT = 0.9
FILTERS = ("filter", "sem_filter")
SORTS = ("orderby", "sem_topk")


# --- answers ---------------------------------------------------------------


def _unmark(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(":left", "").replace(":right", "_1") for c in df.columns])


def table_agreement(prediction: DataFrame, truth: DataFrame, share: float = AGREEMENT) -> DataFrame:
    """Whether two tables agree on their common columns, as one row.

    Distinct rows found in both must make up ``share`` of either table. Both are
    counted by one aggregate over their union. An empty side does not agree.
    """
    prediction, truth = _unmark(prediction), _unmark(truth)
    common = [c for c in prediction.columns if c in truth.columns]
    if not common:
        return prediction.sparkSession.range(1).select(
            *[F.lit(0).cast("long").alias(c) for c in ("n_prediction", "n_truth", "n_matched")],
            F.lit(False).alias("agree"),
        )
    p = prediction.select(*[col(c) for c in common], F.lit(1).alias("_p"), F.lit(0).alias("_t"))
    t = truth.select(*[col(c) for c in common], F.lit(0).alias("_p"), F.lit(1).alias("_t"))
    both = p.union(t).groupBy(*[col(c) for c in common]).agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    counted = both.agg(
        F.coalesce(F.sum("_p"), F.lit(0)).alias("n_prediction"),
        F.coalesce(F.sum("_t"), F.lit(0)).alias("n_truth"),
        F.coalesce(F.sum(F.col("_p") * F.col("_t")), F.lit(0)).alias("n_matched"),
    )
    enough = (F.col("n_matched") >= share * F.col("n_prediction")) & (F.col("n_matched") >= share * F.col("n_truth"))
    return counted.withColumn("agree", enough & (F.col("n_prediction") > 0) & (F.col("n_truth") > 0))


def scalar_agreement(prediction: Column, truth: Column) -> Column:
    """Whether two answers are the same text."""
    return F.coalesce(prediction.cast("string") == truth.cast("string"), F.lit(False))


def judged_agreement(
    answers: DataFrame, prediction: str, truth: str, model: AnswerModel, out: str = "agree"
) -> DataFrame:
    """Add whether a model finds no factual error in ``prediction`` against ``truth``."""
    text = F.concat(
        F.lit("[Prediction]: «"), F.coalesce(col(prediction), F.lit("nan")), F.lit("»\n[Reference]: «"),
        F.coalesce(col(truth), F.lit("nan")), F.lit("»\n"),
    )
    pairs = answers.select(col(prediction).alias("_p"), col(truth).alias("_t"), text.alias("_context")).distinct()
    spec = PromptSpec("agree", "The prediction has no factual error against the reference.")
    judged = with_replies(pairs, F.col("_context"), model, spec)
    judged = stage(judged.select("_p", "_t", bool_of(F.col("_reply.text")).alias("_agree")), "judged")
    on = pick(answers, prediction).eqNullSafe(F.col("_p")) & pick(answers, truth).eqNullSafe(F.col("_t"))
    return answers.join(judged, on).select(*[pick(answers, c) for c in answers.columns], F.col("_agree").alias(out))


def _cells(row: Column) -> Column:
    """A stored row as an array of ``(name, missing, value)`` under the names it is compared by."""
    name = lambda k: F.replace(F.replace(k, F.lit(":left"), F.lit("")), F.lit(":right"), F.lit("_1"))
    return F.transform(F.map_entries(row), lambda e: F.struct(name(e["key"]).alias("k"), e["value"].isNull().alias("m"), F.coalesce(e["value"], F.lit("")).alias("v")))


def tables_agree(predicted: DataFrame, true: DataFrame, case: str = "case_id", row: str = "row", share: float = AGREEMENT) -> DataFrame:
    """``case agree`` for the tables of many cases at once: :func:`table_agreement` of each, in one job.

    Both sides hold one stored row per row, a map from column name to value as text (missing values are NULL); cases may have
    any columns. Rows are known by two hashes of their common cells, which spread the rows of a case over all tasks;
    the list of a case's common columns is brought to its rows by a join that splits large cases. Cases
    with rows on one side only, or without a common column, do not agree.
    """
    p, t = (df.select(col(case).alias("_case"), _cells(col(row)).alias("_cells")).where(F.col("_cells").isNotNull()) for df in (predicted, true))

    def names(df: DataFrame, out: str) -> DataFrame:
        each = df.select("_case", F.explode(F.array_distinct(F.transform("_cells", lambda c: c["k"]))).alias("_k")).distinct()
        return each.groupBy("_case").agg(F.collect_set("_k").alias(out))

    common = names(p, "_a").join(names(t, "_b"), "_case").select("_case", F.array_intersect("_a", "_b").alias("_common")).where(F.size("_common") > 0)
    common = stage(common, "common")

    def prints(df: DataFrame, tag: int) -> DataFrame:
        # a cell that a row leaves out is a missing one
        value = lambda c, k: F.coalesce(F.element_at(F.filter(c, lambda x: x["k"] == k), 1), F.struct(k.alias("k"), F.lit(True).alias("m"), F.lit("").alias("v")))
        rows = split_join(df, common, "_case")
        own = F.transform(F.array_sort("_common"), lambda k: value(F.col("_cells"), k))
        return rows.select("_case", *[F.xxhash64(F.lit(seed), own).alias(f"_h{seed}") for seed in (1, 2)], F.lit(tag).alias("_p"), F.lit(1 - tag).alias("_t"))

    both = prints(p, 1).union(prints(t, 0)).groupBy("_case", "_h1", "_h2").agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    counted = both.groupBy("_case").agg(F.sum("_p").alias("_np"), F.sum("_t").alias("_nt"), F.sum(F.col("_p") * F.col("_t")).alias("_n"))
    enough = (F.col("_n") >= share * F.col("_np")) & (F.col("_n") >= share * F.col("_nt")) & (F.col("_np") > 0) & (F.col("_nt") > 0)
    return counted.select(F.col("_case").alias(case), enough.alias("agree"))


# Fixed values of the published scoring: the last operator of the true plan says how an answer is scored.
TOLD = ("sem_agg",)
COUNTED = ("agg", "value_calculate")


def answer_accuracy(
    cases: DataFrame, predicted: DataFrame, true: DataFrame, model: AnswerModel, *, case: str = "case_id", operator: str = "operator",
    prediction: str = "prediction", truth: str = "truth", row: str = "row",
) -> DataFrame:
    """``case answer_accuracy`` for a whole test set in one job.

    ``cases`` holds per case the last operator of the true plan and both final answers as text, ``predicted`` and
    ``true`` the stored rows of the final tables (see :func:`tables_agree`). A told answer (``sem_agg``) is right if the model
    finds it so; a number (``agg``, ``value_calculate``) if its table agrees or else the model finds its text right; any other
    answer if its table agrees. The model is asked once per distinct pair of texts that a table does not settle.
    """
    agree = tables_agree(predicted, true, case, row).withColumnsRenamed({case: "_case", "agree": "_agree"})
    kept = cases.select(col(case).alias("_id"), col(operator).alias("_op"), col(prediction).cast("string").alias("_said"), col(truth).cast("string").alias("_meant"))
    scored = stage(kept.join(agree, F.col("_id") == F.col("_case"), "left").drop("_case").withColumn("_agree", F.coalesce("_agree", F.lit(False))), "agreement")
    to_judge = F.coalesce(F.col("_op").isin(*TOLD) | (F.col("_op").isin(*COUNTED) & ~F.col("_agree")), F.lit(False))
    judged = judged_agreement(scored.where(to_judge).select("_id", "_said", "_meant"), "_said", "_meant", model, "_right")
    settled = scored.where(~to_judge).select("_id", F.col("_agree").alias("_right"))
    return judged.select("_id", "_right").unionByName(settled).select(F.col("_id").alias(case), F.col("_right").alias("answer_accuracy"))


# --- operators -------------------------------------------------------------


def op_precision_recall(prediction: DataFrame, truth: DataFrame, case: str = "case", op: str = "op") -> DataFrame:
    """Precision and recall of operator names per case, as multisets; one row per step on input."""
    p = prediction.select(col(case).alias("case"), col(op).alias("op"), F.lit(1).alias("p"), F.lit(0).alias("t"))
    t = truth.select(col(case).alias("case"), col(op).alias("op"), F.lit(0).alias("p"), F.lit(1).alias("t"))
    per_op = p.union(t).groupBy("case", "op").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    per_case = per_op.groupBy("case").agg(
        F.sum(F.least("p", "t")).alias("hit"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    share = lambda n: F.coalesce(F.try_divide(F.col("hit"), F.col(n)), F.lit(0.0))
    return per_case.select("case", share("p").alias("precision"), share("t").alias("recall"))


def format_success(steps: DataFrame, case: str = "case", failed: str = "has_failed") -> DataFrame:
    """Steps and steps that did not fail, per case."""
    ok = F.coalesce(~col(failed), F.lit(False))
    return steps.groupBy(col(case).alias("case")).agg(
        F.count("*").alias("operator_count"), F.count_if(ok).alias("success_count"))


def bucket_of(case_id: Column) -> Column:
    return (F.floor((case_id - 1) / CASES_PER_BUCKET) + 1).cast("int")


def bucket_averages(detail: DataFrame, case_id: str = "case_id") -> DataFrame:
    """Means per complexity bucket, rounded to four places.

    ``detail`` holds ``answer_accuracy precision recall operator_count success_count``.
    """
    four = lambda c: F.round(c, 4)
    right = F.avg(F.when(col("answer_accuracy"), 1.0).otherwise(0.0))
    return detail.groupBy(bucket_of(col(case_id)).alias("bucket")).agg(
        four(right).alias("accuracy"),
        four(F.avg("precision")).alias("precision"),
        four(F.avg("recall")).alias("recall"),
        four(F.avg("operator_count")).alias("op_count"),
        four(F.coalesce(F.try_divide(F.sum("success_count"), F.sum("operator_count")), F.lit(0.0))).alias("success"),
    )


def _known_bucket(bucket: Column) -> Column:
    """The bucket, or an error for cases that belong to none, which would be missing from every mean."""
    told = F.concat(F.lit("a case belongs to no bucket: "), F.coalesce(bucket.cast("string"), F.lit("no id")))
    return F.when(bucket.between(1, len(BUCKET_SIZES)), bucket).otherwise(F.raise_error(told).cast("int"))


def bucket_macro_avg(detail: DataFrame, case_id: str = "case_id") -> DataFrame:
    """The mean of the seven bucket means; a bucket without cases counts as zero."""
    per_bucket = bucket_averages(detail, case_id).withColumn("bucket", _known_bucket(F.col("bucket"))).where("bucket IS NOT NULL")
    mean = lambda c, d=4: F.round(F.coalesce(F.sum(c), F.lit(0.0)) / len(BUCKET_SIZES), d).alias(c)
    return per_bucket.agg(mean("accuracy"), mean("precision"), mean("recall"), mean("op_count", 2), mean("success"))


def bucket_macro_avg_fixed(detail: DataFrame, case_id: str = "case_id") -> DataFrame:
    """As :func:`bucket_macro_avg` where failed cases leave no row: bucket sizes are fixed, with a success rate."""
    size = F.element_at(F.array(*[F.lit(float(n)) for n in BUCKET_SIZES]), F.col("bucket"))
    per_bucket = (
        detail.select(_known_bucket(bucket_of(col(case_id))).alias("bucket"), col("answer_accuracy").alias("ok"))
        .groupBy("bucket").agg(F.count_if("ok").alias("right"), F.count("*").alias("n"))
    )
    mean = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)) / len(BUCKET_SIZES), 4)
    return per_bucket.agg(
        mean(F.col("n") / size).alias("success_rate"), mean(F.round(F.col("right") / size, 4)).alias("accuracy"))


# --- plans -----------------------------------------------------------------


def key_params(operator: Column, params: Column) -> Column:
    """The arguments of a stored step without the tables it works on, cleaned; a value join's pair is sorted."""
    quotes = "[\"']"

    def behind(parts: Column, n: int) -> Column:
        return F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0)))

    # cleaning the whole text at once spares a pass over every argument
    clean = F.split(F.trim(F.regexp_replace(params, quotes, "")), r"\s*;;\s*")
    pair = F.array_sort(behind(F.split(params, ";;"), 2))
    return (
        F.when(operator == "join", F.transform(pair, lambda p: F.trim(F.regexp_replace(p, quotes, ""))))
        .when(operator == "sem_join", behind(clean, 2))
        .when(operator == "value_calculate", clean)
        .otherwise(behind(clean, 1))
    )


def plan_set_equal(prediction: DataFrame, truth: DataFrame, case: str = "case") -> DataFrame:
    """Per case, whether both plans have the same length and the same set of steps.

    Both sides hold ``case operator params``, one row per step.
    """
    def marked(df: DataFrame, p: int) -> DataFrame:
        return df.select(
            col(case).alias("case"), col("operator").alias("o"), key_params(col("operator"), col("params")).alias("a"),
            F.lit(p).alias("p"), F.lit(1 - p).alias("t"))

    each = marked(prediction, 1).union(marked(truth, 0)).groupBy("case", "o", "a").agg(
        F.sum("p").alias("p"), F.sum("t").alias("t"))
    per_case = each.groupBy("case").agg(
        F.sum("p").alias("np"), F.sum("t").alias("nt"), F.every((F.col("p") > 0) & (F.col("t") > 0)).alias("all"))
    return per_case.where("nt > 0").select("case", ((F.col("np") == F.col("nt")) & F.col("all")).alias("same"))


def filters_before_sort(steps: DataFrame, case: str = "case", op: str = "operator", pos: str = "pos") -> DataFrame:
    """Per case, the number of filters before the first sort and whether there is one."""
    mine = steps.select(col(case).alias("case"), col(op).alias("op"), col(pos).alias("pos"))
    cases = mine.groupBy("case").agg(F.min(F.when(F.col("op").isin(*SORTS), F.col("pos"))).alias("_s"))
    filters = split_join(mine.where(F.col("op").isin(*FILTERS)), cases, "case")
    early = filters.where("_s IS NULL OR pos < _s").groupBy("case").agg(F.count("*").alias("n"))
    counted = cases.join(early, "case", "left")
    return counted.select(
        "case", F.coalesce("n", F.lit(0)).cast("int").alias("filters"), F.col("_s").isNotNull().alias("sorts"))


def order_valid(prediction: DataFrame, truth: DataFrame, case: str = "case", op: str = "operator", pos: str = "pos") -> DataFrame:
    """Per case, whether the plan filters as often before its first sort as the true plan does."""
    p = filters_before_sort(prediction, case, op, pos)
    t = filters_before_sort(truth, case, op, pos).select("case", F.col("filters").alias("_t"))
    return p.join(t, "case").select("case", (~F.col("sorts") | (F.col("filters") == F.col("_t"))).alias("valid"))


# --- cost ------------------------------------------------------------------

COSTS = ("total_cost", "prompt_tokens", "completion_tokens", "total_tokens", "cache_hits")


def cost_ratio(model: DataFrame, base: DataFrame, case: str = "case", fields: Sequence[str] = COSTS) -> DataFrame:
    """Mean over cases of model cost to base cost, per cost field; 0 where the base is 0.

    Both sides hold one row per step. Cases without a base are left out.
    """
    def sums(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(col(case).alias("case")).agg(*[F.sum(col(f)).alias(f"{tag}{f}") for f in fields])

    both = sums(model, "m_").join(sums(base, "b_"), "case")
    ratio = lambda f: F.when(
        F.col(f"b_{f}") > 0, F.try_divide(F.col(f"m_{f}"), F.col(f"b_{f}"))).otherwise(F.lit(0.0))
    return both.agg(*[F.avg(ratio(f)).alias(f) for f in fields])


def valid_rate(cases: DataFrame, valid: str = "valid") -> DataFrame:
    """Share of valid cases."""
    return cases.agg(F.avg(F.when(col(valid), 1.0).otherwise(0.0)).alias("valid_rate"))
