"""Runs: statistics of a run's rows, and of metrics over seeds and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators.rank import quantiles

# The numeric fields of a run that are aggregated over seeds.
NUMERIC_FIELDS = (
    "accuracy",
    "exact_match",
    "exact_match_rate",
    "llm_approval_rate",
    "total_evaluated",
    "evaluated",
    "correct",
    "incorrect",
    "accuracy_from_exact_match",
    "accuracy_boost_from_llm",
    "no_llm_fallback_count",
    "n_examples",
    "latency_mean_ms",
    "latency_p50_ms",
    "latency_p95_ms",
    "latency_p99_ms",
    "latency_total_ms",
)
GROUP = ("model_short", "condition", "finetuned", "few_shot", "judge_model", "split_type")


def run_stats(rows: DataFrame, by: list[str], generated: str = "generated", error: str = "generation_error", latency: str = "latency_ms") -> DataFrame:
    """Counts of successful, failed and refused rows, and latencies. A row with an output is successful, whatever else it says; one with an error text is refused."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    counts = rows.groupBy(*by).agg(F.count("*").alias("total_samples"), F.count_if(filled(generated)).alias("successful"), F.count_if(~filled(generated)).alias("failed"), F.count_if(filled(error)).alias("content_filtered"), F.avg(latency).alias("latency_mean_ms"), F.min(latency).alias("latency_min_ms"), F.max(latency).alias("latency_max_ms"), F.sum(latency).alias("latency_total_ms"))
    marks = quantiles(rows, by, latency, {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99})
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] or F.lit(True)
    return counts.alias("a").join(marks.alias("b"), same, "left").select("a.*", *(f"b.{c}" for c in marks.columns if c not in by))


def refused_ids(rows: DataFrame, by: list[str], error: str = "generation_error", row_id: str = "id") -> DataFrame:
    """(by, id): the rows with an error text, one row for each, uncut."""
    return rows.where(F.coalesce(F.col(error), F.lit("")) != "").select(*by, F.col(row_id).alias("id"))


def with_split_type(runs: DataFrame, combine_judges: bool = False) -> DataFrame:
    """split_type: cv where there is a fold, else canonical; judge_model null where judges are combined."""
    out = runs.withColumn("split_type", F.when(F.col("cv_fold").isNotNull(), "cv").otherwise("canonical"))
    return out.withColumn("_judge", F.col("judge_model")).withColumn("judge_model", F.lit(None).cast("string") if combine_judges else F.col("judge_model"))


def seed_stats(runs: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """(group, metric, mean, std, n, sem, ci95): population deviation; spread is 0 for one value; nulls are skipped."""
    long = runs.select(*by, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(by, list(fields), "metric", "value").where("value is not null")
    stats = long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("_std"), F.count("*").alias("n"))
    std = F.when(F.col("n") > 1, F.col("_std")).otherwise(0.0)
    sem = std / F.sqrt("n")
    return stats.select(*by, "metric", "mean", std.alias("std"), "n", sem.alias("sem"), (1.96 * sem).alias("ci95"))


def group_sizes(runs: DataFrame, by: list[str]) -> DataFrame:
    """num_seeds (the number of runs where none has a seed), num_folds, num_runs and the judges of each group."""
    seeds = F.count_distinct("seed")
    return runs.groupBy(*by).agg(F.coalesce(F.nullif(seeds, F.lit(0)), F.count("*")).alias("num_seeds"), F.count_distinct("cv_fold").alias("num_folds"), F.count("*").alias("num_runs"), F.array_join(F.array_sort(F.collect_set("_judge")), ",").alias("judge_models"))


def with_agreement(runs: DataFrame, per_source: DataFrame, source: str = "source_file") -> DataFrame:
    """Runs with the agreement scores of their source; names are compared without judge and suffix."""
    right = per_source.withColumn("_stem", text.source_stem(F.col("source_file"))).drop("source_file")
    return runs.withColumn("_stem", text.source_stem(F.col(source))).join(right, "_stem", "left").drop("_stem")


def agreement_stats(runs: DataFrame, per_source: DataFrame, by: list[str], fields: list[str], source: str = "source_file") -> DataFrame:
    """Statistics over each group's runs of the agreement scores of their sources."""
    return seed_stats(with_agreement(runs, per_source, source), by, fields)


def seed_pairs(runs: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Pairs of models compared on the seeds both have: mean difference, wins and ties, for each condition and judge."""
    by = ["condition", "judge_model"]
    means = runs.groupBy(*by, "seed", "model_short").agg(F.avg(metric).alias("x"))
    # a group has one entry a model
    entries = means.groupBy(*by, "seed").agg(F.array_sort(F.collect_list(F.struct("model_short", "x"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice(F.col("m"), i + 2, F.size("m")), lambda b: F.struct(a["model_short"].alias("model_1"), b["model_short"].alias("model_2"), (a["x"] - b["x"]).alias("delta")))))
    return entries.select(*by, "seed", F.inline(pairs)).groupBy(*by, "model_1", "model_2").agg(F.count("*").alias("n_seeds"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"), F.count_if(F.col("delta") == 0).alias("ties"))


def numeric_metric(struct: Column) -> Column:
    """The number in (value) or {mean, std}: value first."""
    return F.coalesce(struct["value"], struct["mean"])


def first_of_group(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
