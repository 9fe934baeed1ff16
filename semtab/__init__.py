"""semtab: tables queried by value and by meaning, on Spark.

Every operator takes DataFrames and returns DataFrames. Operators whose condition,
mapping, ranking, grouping or summary is stated in words ask a pluggable model.
"""

from semtab.functions.sql import qa_over, register_sql_functions
from semtab.functions.tables import blocking_index, register_table_functions
from semtab.models.base import ConfidenceCascade, HashEmbedder, OverlapScorer, Reply, RuleModel, TokenChance
from semtab.models.memo import recorded, usage_of
from semtab.operators.cascade import calibrate, learn_thresholds, sample_weights, sem_filter_cascade, true_prob
from semtab.operators.clustering import cluster_summary, sem_cluster_by
from semtab.operators.folding import sem_agg, sem_partition_by
from semtab.operators.matching import JoinCascade, sem_join
from semtab.operators.ranking import sem_topk
from semtab.operators.retrieval import attach_index, embed, load_index, sem_dedup, sem_index, sem_search, sim_join
from semtab.operators.semantic import sem_extract, sem_filter, sem_filter_batch, sem_map
from semtab.operators.values import (
    agg, column_calculate, filter_rows, groupby, head, join, orderby, project, value_calculate,
)
from semtab.plans.steps import Ref, Step, run_steps, typed_step
from semtab.runtime import local_session, ship, stage

__all__ = [
    "ConfidenceCascade", "HashEmbedder", "JoinCascade", "OverlapScorer", "Ref", "Reply", "RuleModel", "Step",
    "TokenChance", "agg", "attach_index", "blocking_index", "calibrate", "cluster_summary", "column_calculate",
    "embed", "filter_rows", "groupby", "head", "join", "learn_thresholds", "load_index", "local_session",
    "orderby", "project", "qa_over", "recorded", "register_sql_functions", "register_table_functions",
    "run_steps", "sample_weights", "sem_agg", "sem_cluster_by", "sem_dedup", "sem_extract", "sem_filter",
    "sem_filter_batch", "sem_filter_cascade", "sem_index", "sem_join", "sem_map", "sem_partition_by",
    "sem_search", "sem_topk", "ship", "sim_join", "stage", "true_prob", "typed_step", "usage_of",
    "value_calculate",
]
