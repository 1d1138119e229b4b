"""Efficiency: derived measures, scores, frontiers and rankings of models and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def derived(rows: DataFrame) -> DataFrame:
    """duration_seconds, throughput_samples_per_sec, accuracy_per_second; null where a part is missing or zero."""
    seconds = F.col("latency_total_ms") / 1000
    positive = lambda c: F.when(c > 0, c)
    return rows.withColumns({"duration_seconds": seconds, "throughput_samples_per_sec": F.nullif(F.col("n_examples"), F.lit(0)) / positive(seconds), "accuracy_per_second": F.col("accuracy") / positive(F.col("latency_mean_ms") / 1000)})


def _normalized(value: Column, low: Column, high: Column, higher_is_better: bool) -> Column:
    scaled = (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(value.isNull(), F.lit(None).cast("double")).when(low == high, 1.0).otherwise(scaled if higher_is_better else 1 - scaled)


def scored(rows: DataFrame, accuracy_weight: float = 0.5, latency_weight: float = 0.5) -> DataFrame:
    """Accuracy and latency from 0 to 1 over all rows, and their weighted mean over those that are there."""
    span = rows.agg(*(f(c).cast("double").alias(f"_{n}_{c}") for c in ("accuracy", "latency_mean_ms") for n, f in (("low", F.min), ("high", F.max))))
    out = rows.join(F.broadcast(span))  # one row
    a = _normalized(F.col("accuracy"), F.col("_low_accuracy"), F.col("_high_accuracy"), True)
    b = _normalized(F.col("latency_mean_ms"), F.col("_low_latency_mean_ms"), F.col("_high_latency_mean_ms"), False)
    weight = F.when(a.isNotNull(), accuracy_weight).otherwise(0.0) + F.when(b.isNotNull(), latency_weight).otherwise(0.0)
    total = F.coalesce(a * accuracy_weight, F.lit(0.0)) + F.coalesce(b * latency_weight, F.lit(0.0))
    return out.withColumns({"accuracy_normalized": a, "latency_normalized": b, "efficiency_score": F.try_divide(total, F.nullif(weight, F.lit(0.0)))}).drop(*span.columns)


def top(rows: DataFrame, value: str, k: int = 5, higher: bool = True, ties: tuple[str, ...] = ("model_short", "condition", "judge_model")) -> DataFrame:
    """The k best with their rank; rows without the value are left out."""
    order = [F.desc(value) if higher else F.asc(value), *ties]
    best = rows.where(F.col(value).isNotNull()).orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # k rows


def pareto(rows: DataFrame, accuracy: str = "accuracy", latency: str = "latency_mean_ms", digits: int = 2) -> DataFrame:
    """The rows that no other one beats in accuracy or latency without losing in the other; equal ones stay together.

    Each latency keeps its best accuracy. A row stays if it has that and it is
    above all of smaller latencies. Those are found in two steps, over ranges
    of latency and within them, so no window holds all rows.
    """
    known = rows.where(F.col(accuracy).isNotNull() & F.col(latency).isNotNull())
    best = known.groupBy(F.col(latency).alias("_l")).agg(F.max(accuracy).alias("_a"))
    # ranges by the number's magnitude and leading digits: they ascend with latency
    span = F.when(F.col("_l") <= 0, F.lit(-(10**9)).cast("long")).otherwise(F.floor(F.log2(F.col("_l").cast("double")) * 10**digits).cast("long"))
    best = best.withColumn("_r", span)
    ranges = best.groupBy("_r").agg(F.max("_a").alias("_top"))  # a few thousand at most
    ahead = Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.max("_top").over(ahead)).drop("_top")
    within = Window.partitionBy("_r").orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("_own", F.max("_a").over(within)).join(ranges, "_r")
    kept = kept.where("_a > coalesce(greatest(_own, _before), double('-Infinity'))").select("_l", "_a")
    return known.join(kept, (F.col(latency) == F.col("_l")) & (F.col(accuracy) == F.col("_a")), "left_semi")


def frontier_flags(rows: DataFrame, frontier: DataFrame) -> DataFrame:
    """rows with on_frontier; a frontier row without judge stands for all judges."""
    f = frontier.select(F.col("model_short").alias("_m"), F.col("condition").alias("_c"), F.col("judge_model").alias("_j"))
    any_judge = f.where("_j is null").select("_m", "_c").distinct().withColumn("_any", F.lit(True))
    exact = f.where("_j is not null").distinct().withColumn("_one", F.lit(True))
    out = rows.join(any_judge, (F.col("model_short") == F.col("_m")) & (F.col("condition") == F.col("_c")), "left").drop("_m", "_c")
    out = out.join(exact, (F.col("model_short") == F.col("_m")) & (F.col("condition") == F.col("_c")) & (F.col("judge_model") == F.col("_j")), "left").drop("_m", "_c", "_j")
    return out.withColumn("on_frontier", F.coalesce("_any", "_one", F.lit(False))).drop("_any", "_one")


def with_judge_accuracy(runs: DataFrame, summary: DataFrame, on: str = "source_file") -> DataFrame:
    """The judges' accuracy instead of exact match where a summary has it, and where it came from."""
    s = summary.select(F.col(on).alias("_on"), F.col("accuracy").alias("_judged"))
    out = runs.join(s, F.col(on) == F.col("_on"), "left")
    return out.withColumns({"accuracy": F.coalesce("_judged", "exact_match"), "accuracy_source": F.when(F.col("_judged").isNotNull(), "judge_summary").when(F.col("exact_match").isNotNull(), "exact_match")}).drop("_on", "_judged")


def run_entry(runs: DataFrame, rows: DataFrame, key: str = "run_id") -> DataFrame:
    """Accuracy and latency of a run: from its metadata, else its duration, else the sum over its rows."""
    sums = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.avg(F.col("exact_match").cast("double")).alias("_acc"), F.sum("latency_ms").alias("_total"))
    out = runs.join(sums, F.col(key) == F.col("_k"), "left")
    n = F.coalesce(F.nullif(F.col("n_examples"), F.lit(0)), F.nullif(F.col("total_samples"), F.lit(0)), F.col("_n"))
    total = F.coalesce(F.col("latency_total_ms"), F.col("duration_seconds") * 1000, F.col("_total"))
    return out.withColumns({"n_examples": n, "accuracy": F.coalesce("exact_match", "_acc"), "latency_total_ms": total, "latency_mean_ms": F.coalesce(F.col("latency_mean_ms"), F.try_divide(total, n))}).drop("_k", "_n", "_acc", "_total")


def grouped(rows: DataFrame) -> DataFrame:
    """By condition and by model in one pass: rows, members, mean and best accuracy, mean latency, mean score."""
    model, condition = F.col("model_short"), F.col("condition")
    out = rows.groupingSets([[condition], [model]], condition, model).agg(
        F.when(F.grouping("condition") == 0, "condition").otherwise("model").alias("grouped_by"),
        F.count("*").alias("n_entries"),
        F.count_distinct(F.col("model_short")).alias("n_models"),
        F.count_distinct(F.col("condition")).alias("n_conditions"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.max("accuracy").alias("best_accuracy"),
        F.avg("latency_mean_ms").alias("mean_latency_ms"),
        F.avg("efficiency_score").alias("mean_score"),
    )
    return out.select("grouped_by", F.coalesce("condition", "model_short").alias("name"), "n_entries", "mean_accuracy", "best_accuracy", "mean_latency_ms", "mean_score")


def totals(rows: DataFrame) -> DataFrame:
    """Numbers of entries, models and conditions, and of entries that lack accuracy or latency, with all of their names (model/condition/judge, in order, '' where there are none)."""
    name = F.concat_ws("/", "model_short", "condition", "judge_model")
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c).isNull(), name))), ",")
    return rows.agg(F.count("*").alias("n_entries"), F.count_distinct("model_short").alias("n_models"), F.count_distinct("condition").alias("n_conditions"), F.count_if(F.col("accuracy").isNull()).alias("n_missing_accuracy"), F.count_if(F.col("latency_mean_ms").isNull()).alias("n_missing_latency"), listed("accuracy").alias("missing_accuracy"), listed("latency_mean_ms").alias("missing_latency"))


def missing(rows: DataFrame) -> DataFrame:
    """(model_short, condition, judge_model, missing): every entry that lacks accuracy or latency, a row for each lack."""
    lacks = F.array_compact(F.array(F.when(F.col("accuracy").isNull(), "accuracy"), F.when(F.col("latency_mean_ms").isNull(), "latency")))
    return rows.select("model_short", "condition", "judge_model", F.explode(lacks).alias("missing"))
