"""Judged rows: metrics, rankings, reuse of finished work, and the judge itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators import scoring
from assayer.sources.shared import staged
from assayer.sources.sinks import REQUEST

METHODS = ("exact", "llm", "no_llm", "unmatched", "content_filtered")


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metric_columns() -> list[Column]:
    """Aggregates over (decision_method, correct); rows without a prediction don't count."""
    method, yes = F.coalesce(F.col("decision_method"), F.lit("")), F.col("correct") == "yes"
    seen = method != "unmatched"
    n = F.count_if(seen)
    right, exact, judged, approved = F.count_if(seen & yes), F.count_if(method == "exact"), F.count_if(method == "llm"), F.count_if((method == "llm") & yes)
    return [
        n.alias("evaluated"),
        right.alias("correct_count"),
        (n - right).alias("incorrect_count"),
        _rate(right, n).alias("accuracy"),
        exact.alias("exact_count"),
        _rate(exact, n).alias("exact_match_rate"),
        judged.alias("llm_count"),
        _rate(judged, n).alias("llm_rate"),
        approved.alias("llm_approved"),
        (judged - approved).alias("llm_rejected"),
        _rate(approved, judged).alias("llm_approval_rate"),
        _rate(exact, n).alias("accuracy_from_exact_match"),
        _rate(approved, n).alias("accuracy_boost_from_llm"),
        F.count_if(method == "no_llm").alias("no_llm_count"),
        F.count_if(method == "content_filtered").alias("content_filtered_count"),
    ]


def metrics(judged: DataFrame, by: list[str]) -> DataFrame:
    return judged.groupBy(*by).agg(*metric_columns())


def method_stats(judged: DataFrame, by: list[str], cached: Column | None = None) -> DataFrame:
    """Rows of each decision method, and how many came from the cache."""
    extra = [] if cached is None else [F.count_if(cached).alias("cached")]
    return judged.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col("decision_method") == m).alias(m) for m in METHODS), *extra)


def summary(judged: DataFrame, judge: str, source: str) -> DataFrame:
    """Metrics of each file and of each judge (source null) in one pass, and each file's place by accuracy, ties by name."""
    rows = judged.groupingSets([[F.col(judge), F.col(source)], [F.col(judge)]], F.col(judge), F.col(source)).agg(F.grouping(source).alias("overall"), *metric_columns())
    order = Window.partitionBy(judge, "overall").orderBy(F.desc("accuracy"), source)
    return rows.withColumn("place", F.when(F.col("overall") == 0, F.row_number().over(order)))


def best_rows(rows: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The row of the highest value in each group, the first by tie among equals."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def not_yet_judged(rows: DataFrame, done: DataFrame, on: tuple[str, ...] = ("judge_model", "source_file", "prompt_version")) -> DataFrame:
    """Rows whose judge, source and prompt version have no result yet."""
    return rows.join(done.select(*on).distinct(), list(on), "left_anti")


def split_by_store(rows: DataFrame, store: DataFrame, on: Sequence[str] = REQUEST) -> tuple[DataFrame, DataFrame]:
    """(stored, open): what is stored of the requests of rows, and the rows whose request isn't. Only rows are shuffled where the store is in buckets by request."""
    asked = rows.select(*on).distinct()
    known = store.select(*on).distinct()
    return store.join(asked.hint("merge"), list(on), "left_semi"), rows.join(known.hint("merge"), list(on), "left_anti")


Scorer = Callable[[pd.Series], pd.DataFrame]


def judge(rows: DataFrame, scorer: Scorer, prompt: str = "judge_prompt", request: tuple[str, ...] = ("judge_model", "prompt_version"), order: str = "ord") -> DataFrame:
    """rows with decision_method, correct, reasoning, raw_judge_response and from_cache.

    scorer maps prompts to a frame of (response, refused). It sees each different
    request once: requests are made distinct, scored in Arrow batches, and joined
    back. All but the first row of a request count as from the cache.
    """
    key = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in request), F.sha2(F.col(prompt), 256)), 256)
    keyed = rows.withColumn("cache_key", key)
    first = keyed.groupBy("cache_key").agg(F.min(order).alias("_first"), F.first(prompt).alias("_prompt"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = scorer(frame["_prompt"])
            yield pd.DataFrame({"cache_key": frame["cache_key"], "_first": frame["_first"], "raw_judge_response": out["response"].to_numpy(), "_refused": out["refused"].to_numpy()})

    kind = rows.schema[order].dataType.simpleString()
    replies = first.mapInPandas(run, f"cache_key string, _first {kind}, raw_judge_response string, _refused boolean")
    out = keyed.join(replies.withColumn("_v", text.verdict(F.col("raw_judge_response"))), "cache_key")  # a reply is parsed once, however many rows it is for
    return out.withColumns(
        {
            "decision_method": F.when(F.col("_refused"), "content_filtered").otherwise("llm"),
            "correct": F.when(F.col("_refused"), "no").otherwise(F.col("_v.decision")),
            "reasoning": F.when(F.col("_refused"), "").otherwise(F.col("_v.reasoning")),
            "from_cache": F.col(order) > F.col("_first"),
        }
    ).drop("_v", "_first", "_refused")


def evaluate(pairs: DataFrame, scorer: Scorer, template: str, golds: str = "golds", order: str = "ord", judge_model: str = "judge", prompt_version: str = "v1") -> DataFrame:
    """Exact matches first, the judge for the rest: rows with decision_method, correct, reasoning, from_cache. The judge only gets the rows that need it.

    Pairs are few bytes and much work: they are dealt to as many tasks as a
    shuffle has, however few files they come from, compared once, and stored.
    """
    prompt = text.filled_template(template, {"input": F.col("input"), "gold": text.numbered(F.col(golds)), "prediction": F.col("prediction")})
    dealt = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    matched = dealt.withColumn("_r", scoring.route(F.col("prediction"), scoring.exact_match(F.col("prediction"), F.col(golds))))
    routed = staged(matched.withColumn("judge_prompt", F.when(F.col("_r.decision_method") == "llm", prompt)), "routed")
    settled = routed.where("_r.decision_method <> 'llm'").withColumns({"decision_method": F.col("_r.decision_method"), "correct": F.col("_r.correct"), "reasoning": F.lit(""), "from_cache": F.lit(False)}).drop("_r", "judge_prompt")
    asked = routed.where("_r.decision_method = 'llm'").drop("_r").withColumns({"judge_model": F.lit(judge_model), "prompt_version": F.lit(prompt_version)})
    return settled.unionByName(judge(asked, scorer, order=order).select(*settled.columns))
