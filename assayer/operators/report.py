"""Tables of a report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The order in which conditions are shown.
CONDITION_ORDER = {
    "baseline_zero_shot": 0,
    "zero_shot": 0,
    "baseline_few_shot": 1,
    "few_shot": 1,
    "finetuned": 2,
    "finetuned_zero_shot": 2,
    "finetuned_few_shot": 3,
}


def condition_rank(condition, order: Mapping[str, int] = CONDITION_ORDER):
    return F.coalesce(F.create_map(*(F.lit(x) for p in order.items() for x in p))[condition], F.lit(50))


def headline(stats: DataFrame, conditions: list[str] | None = None) -> DataFrame:
    """Mean accuracy over judges, models by conditions."""
    means = stats.groupBy("model_short", "condition").agg(F.avg("accuracy").alias("accuracy"))
    return means.groupBy("model_short").pivot("condition", conditions).agg(F.first("accuracy"))


def decomposition(stats: DataFrame) -> DataFrame:
    """Accuracy as exact match plus what judges add, and the share of that."""
    rows = stats.groupBy("model_short", "condition").agg(F.avg("accuracy").alias("accuracy"), F.avg("accuracy_from_exact_match").alias("from_exact_match"), F.avg("accuracy_boost_from_llm").alias("from_judge"))
    return rows.withColumn("judge_share", F.try_divide("from_judge", "accuracy"))


def setup_facts(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_distinct("model_short").alias("n_models"), F.count_distinct("condition").alias("n_conditions"), F.max("n_examples").alias("max_examples"), F.count_distinct("seed").alias("n_seeds"), F.count_distinct("cv_fold").alias("n_folds"), F.array_join(F.array_sort(F.collect_set("judge_model")), ",").alias("judges"))


def reliability(pairs: DataFrame, fleiss: DataFrame, alpha: DataFrame, human: DataFrame) -> DataFrame:
    """(measure, n, value) of all coefficients."""
    parts = [
        pairs.select(F.concat(F.lit("cohen_"), "judge_1", F.lit("_"), "judge_2").alias("measure"), F.col("n_items").cast("long").alias("n"), F.col("kappa").alias("value")),
        fleiss.select(F.lit("fleiss").alias("measure"), F.col("n_items").cast("long").alias("n"), F.col("kappa").alias("value")),
        alpha.select(F.lit("krippendorff").alias("measure"), F.col("n_items").cast("long").alias("n"), F.col("alpha").alias("value")),
        human.select(F.concat(F.lit("human_"), "who").alias("measure"), F.col("n_items").cast("long").alias("n"), F.col("accuracy").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
