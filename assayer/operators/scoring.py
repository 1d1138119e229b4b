"""Scoring: predictions against gold readings, and the route of each to a decision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.sources.shared import staged


def exact_match(prediction: Column, golds: Column) -> Column:
    """Whether the lines of a prediction are the readings: order doesn't count, multiplicity does; nothing on either side is no match."""
    mine = F.array_sort(F.transform(text.formula_lines(prediction), text.normalized_formula))
    gold = F.array_sort(F.transform(golds, text.normalized_formula))
    return F.coalesce((F.size(mine) > 0) & (F.size(gold) > 0) & (mine == gold), F.lit(False))


def scored(rows: DataFrame, prediction_sources: list[str], golds: str) -> DataFrame:
    """rows with `prediction` (the first source that isn't empty), `gold` (readings one a line) and `exact_match` 0 or 1."""
    out = rows.withColumn("prediction", F.coalesce(text.first_filled(*prediction_sources), F.lit("")))
    return out.withColumns({"gold": F.array_join(golds, "\n"), "exact_match": exact_match(F.col("prediction"), F.col(golds)).cast("int")})


def exact_evaluator(golds: str = "golds", sources: Sequence[str] = ("prediction",)) -> Callable[[DataFrame], DataFrame]:
    """An evaluator for DataFrame.transform: pairs in, scored rows out. Any function of this form is one."""
    return lambda pairs: scored(pairs, list(sources), golds)


def aligned_pairs(predictions: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions and references joined by position or id; an error where either has rows without partner."""
    marked = staged(predictions.withColumn("_p", F.lit(1)).join(references.withColumn("_r", F.lit(1)), keys, "full_outer"), "aligned")  # the join is made once
    if not marked.where("_p is null or _r is null").isEmpty():
        raise ValueError("predictions and references differ in number")
    return marked.drop("_p", "_r")


def exact_flag(stored: Column, computed: Column) -> Column:
    """A stored flag where there is one, whatever the texts say; else the computed one."""
    return F.when(stored.isNotNull(), F.lower(F.trim(stored.cast("string"))).isin("1", "true", "yes")).otherwise(computed)


def route(prediction: Column, matched: Column, judging: bool = True) -> Column:
    """(decision_method, correct, judge_parse_status): missing, exact, not judged, or for the judge (correct is null)."""
    made = lambda method, correct, status: F.struct(F.lit(method).alias("decision_method"), F.lit(correct).cast("string").alias("correct"), F.lit(status).alias("judge_parse_status"))
    rest = made("llm", None, "pending") if judging else made("no_llm", "no", "not_applicable")
    return F.when(F.coalesce(text.strip(prediction), F.lit("")) == "", made("unmatched", "no", "not_applicable")).when(matched, made("exact", "yes", "not_applicable")).otherwise(rest)


def match_rate(rows: DataFrame, by: list[str] | None = None, flag: str = "exact_match") -> DataFrame:
    """n_examples and the share of exact matches, 0 where there are none."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n_examples"), F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0)).alias("exact_match"))
