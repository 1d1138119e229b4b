"""Agreement between judges over aligned ratings.

Ratings are rows (source_file, item_key, judge, verdict). Items have at most as
many raters as there are judges, so what is gathered for an item is small.
Coefficients come from sums of counts, in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text

# Decisions made without a judge.
NOT_JUDGED = ("exact", "no_llm", "unmatched")
ITEM = ("source_file", "item_key")


def judge_called(rows: DataFrame, method: str = "decision_method") -> DataFrame:
    """Rows decided by a judge or a human; those without a method stay."""
    return rows.where(~F.lower(F.coalesce(F.col(method), F.lit(""))).isin(*NOT_JUDGED))


def aligned(rows: DataFrame, judged_only: bool = True, order: str = "ord") -> DataFrame:
    """(source_file, item_key, judge, verdict): of several verdicts of a judge the last; anything but yes is no."""
    rows = judge_called(rows) if judged_only else rows
    return rows.groupBy(*ITEM, "judge").agg(text.yes_no(F.max_by("verdict", order)).alias("verdict"))


def details(rows: DataFrame, columns: list[str], judged_only: bool = True, order: str = "ord") -> DataFrame:
    """For each item, the columns of its first row."""
    rows = judge_called(rows) if judged_only else rows
    return rows.groupBy(*ITEM).agg(F.min_by(F.struct(*columns), order).alias("d")).select(*ITEM, "d.*")


def human_rows(items: DataFrame, source: Column, input_names: list[str], gold_names: list[str], prediction_names: list[str]) -> DataFrame:
    """Human labels in the shape of judged rows."""
    pick = lambda names: F.coalesce(text.first_filled(*(n for n in names if n in items.columns)), F.lit(""))
    return items.select(source.alias("source_file"), pick(input_names).alias("input"), pick(gold_names).alias("gold"), pick(prediction_names).alias("prediction"), F.lit("human").alias("judge"), text.yes_no(F.col("correct"), ("yes", "y", "true", "1")).alias("verdict"), F.lit("human").alias("decision_method"))


def merged(base: DataFrame, extra: DataFrame) -> DataFrame:
    return base.unionByName(extra, allowMissingColumns=True)


def require_judges(ratings: DataFrame, wanted: list[str]) -> DataFrame:
    """The ratings of the judges asked for; an error if one is missing or fewer than two are left."""
    spark = ratings.sparkSession
    missing = spark.createDataFrame([(j,) for j in wanted], "judge string").exceptAll(ratings.select("judge").distinct()).collect()
    if missing:
        raise ValueError(f"no ratings by {sorted(r.judge for r in missing)}")
    if len(set(wanted)) < 2:
        raise ValueError("at least two judges")
    return ratings.where(F.col("judge").isin(*wanted))


def judge_coverage(ratings: DataFrame, wanted: list[str]) -> DataFrame:
    """(judge, n_ratings, missing): a row for each judge asked for, whether it has rated or not."""
    asked = ratings.sparkSession.createDataFrame([(j,) for j in dict.fromkeys(wanted)], "judge string")
    counts = ratings.groupBy("judge").agg(F.count("*").alias("n"))
    return asked.join(counts, "judge", "left").select("judge", F.coalesce("n", F.lit(0)).alias("n_ratings"), F.col("n").isNull().alias("missing"))


def items(ratings: DataFrame, by: tuple[str, ...] = ITEM) -> DataFrame:
    """One row for each item: n raters, yes and no counts, votes (judge, verdict) in the judges' order."""
    return ratings.groupBy(*by).agg(
        F.count("*").alias("n_raters"),
        F.count_if(F.col("verdict") == "yes").alias("n_yes"),
        F.count_if(F.col("verdict") == "no").alias("n_no"),
        F.array_sort(F.collect_list(F.struct("judge", "verdict"))).alias("votes"),
    )


def common(rated: DataFrame, least: int) -> DataFrame:
    return rated.where(F.col("n_raters") >= least)


def _pairs(rated: DataFrame, extra: list[str]) -> DataFrame:
    """Every pair of votes of an item, first judge before second: bounded by the number of judges."""
    later = lambda i: F.transform(F.slice(F.col("votes"), i + 2, F.size("votes")), lambda y: y)
    pairs = F.flatten(F.transform(F.col("votes"), lambda x, i: F.transform(later(i), lambda y: F.struct(x["judge"].alias("judge_1"), y["judge"].alias("judge_2"), x["verdict"].alias("v1"), y["verdict"].alias("v2")))))
    return rated.select(*extra, F.inline(pairs))


def cohen(both_yes: Column, yes_no: Column, no_yes: Column, both_no: Column) -> Column:
    """Kappa of a two by two table; null without items, 1 or 0 where chance agreement is certain."""
    a, b, c, d = (x.cast("double") for x in (both_yes, yes_no, no_yes, both_no))
    n = a + b + c + d
    po, pe = (a + d) / n, ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)
    return F.when(n == 0, F.lit(None).cast("double")).when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))


def pairwise(ratings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Kappa, agreement and the table of counts of each pair of judges, over what both rated. Pairs without such items have n_items 0."""
    by = by or []
    pairs = _pairs(items(ratings), [c for c in by if c in ITEM])
    is_ = lambda x, y: (F.col("v1") == x) & (F.col("v2") == y)
    counts = pairs.groupBy(*by, "judge_1", "judge_2").agg(F.count_if(is_("yes", "yes")).alias("both_yes"), F.count_if(is_("yes", "no")).alias("yes_no"), F.count_if(is_("no", "yes")).alias("no_yes"), F.count_if(is_("no", "no")).alias("both_no"))
    if not by:
        judges = ratings.select("judge").distinct()
        grid = judges.select(F.col("judge").alias("judge_1")).join(judges.select(F.col("judge").alias("judge_2")), F.col("judge_1") < F.col("judge_2"))
        counts = grid.join(counts, ["judge_1", "judge_2"], "left").fillna(0, ["both_yes", "yes_no", "no_yes", "both_no"])
    a, b, c, d = (F.col(x) for x in ("both_yes", "yes_no", "no_yes", "both_no"))
    n = a + b + c + d
    return counts.withColumns({"n_items": n, "agreement": F.try_divide(a + d, n), "kappa": cohen(a, b, c, d), "yes_rate_1": F.try_divide(a + b, n), "yes_rate_2": F.try_divide(a + c, n)})


def kappa_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("kappa").alias("mean_kappa"), F.min("kappa").alias("min_kappa"), F.max("kappa").alias("max_kappa"), F.stddev_pop("kappa").alias("std_kappa"), F.count("kappa").alias("n_pairs"))


def per_source(ratings: DataFrame) -> DataFrame:
    """For each source: items with two raters or more, and mean, least and greatest kappa over the pairs."""
    counts = items(ratings).where("n_raters >= 2").groupBy("source_file").agg(F.count("*").alias("n_items"))
    kappas = pairwise(ratings, ["source_file"]).groupBy("source_file").agg(F.avg("kappa").alias("mean_kappa"), F.min("kappa").alias("min_kappa"), F.max("kappa").alias("max_kappa"), F.count("kappa").alias("n_pairs"))
    return counts.join(kappas, "source_file")


def fleiss(rated: DataFrame, n_judges: int) -> DataFrame:
    """Kappa over the items that all judges rated."""
    y, k, m = F.col("n_yes").cast("double"), F.col("n_no").cast("double"), F.col("n_raters").cast("double")
    rows = rated.where(F.col("n_raters") == n_judges)
    sums = rows.agg(F.count("*").alias("n_items"), F.avg((y * y + k * k - m) / F.nullif(m * (m - 1), F.lit(0.0))).alias("po"), F.sum(y).alias("yes"), F.sum(m).alias("all"))
    share = F.col("yes") / F.nullif(F.col("all"), F.lit(0.0))
    pe = share * share + (1 - share) * (1 - share)
    kappa = F.when(F.col("n_items") == 0, F.lit(None).cast("double")).when(F.lit(n_judges <= 1), 1.0).when(pe == 1, F.when(F.col("po") == 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return sums.select("n_items", F.lit(n_judges).alias("n_judges"), "po", pe.alias("pe"), kappa.alias("kappa"))


def krippendorff(rated: DataFrame, n_judges: int) -> DataFrame:
    """Alpha for two categories with missing ratings. All pairs of ratings weigh alike, however many an item has."""
    y, k, m = F.col("n_yes").cast("double"), F.col("n_no").cast("double"), F.col("n_raters").cast("double")
    sums = rated.where("n_raters >= 2").agg(F.count("*").alias("n_items"), F.sum(m).alias("n_ratings"), F.sum(y).alias("yes"), F.sum(k).alias("no"), F.sum(y * k).alias("split"), F.sum(m * (m - 1) / 2).alias("pairs"), F.count_if(F.col("n_raters") < n_judges).alias("items_with_missing"))
    n, yes, no = F.col("n_ratings"), F.col("yes"), F.col("no")
    observed = F.try_divide(F.col("split"), F.col("pairs"))
    expected = 1 - (yes * (yes - 1) + no * (no - 1)) / F.nullif(n * (n - 1), F.lit(0.0))
    alpha = F.when(F.col("n_items") == 0, F.lit(None).cast("double")).when(expected == 0, 1.0).otherwise(1 - observed / F.nullif(expected, F.lit(0.0)))
    return sums.select("n_items", n.cast("long").alias("n_ratings"), "items_with_missing", observed.alias("observed"), expected.alias("expected"), alpha.alias("alpha"))


def coverage(rated: DataFrame, n_judges: int) -> DataFrame:
    """By number of raters: items, full agreement, disagreement, unanimous by all judges, judges present."""
    same = (F.col("n_yes") == 0) | (F.col("n_no") == 0)
    counts = rated.groupBy("n_raters").agg(F.count("*").alias("n_items"), F.count_if(same).alias("full_agreement"), F.count_if(~same).alias("any_disagreement"), F.count_if(same & (F.col("n_raters") == n_judges)).alias("unanimous_all_judges"))
    present = rated.select("n_raters", F.explode("votes.judge").alias("judge")).distinct().groupBy("n_raters").agg(F.array_join(F.array_sort(F.collect_list("judge")), ",").alias("judges_present"))
    return counts.join(present, "n_raters")


def patterns(rated: DataFrame) -> DataFrame:
    y, k, m = (F.col(c).cast("string") for c in ("n_yes", "n_no", "n_raters"))
    name = (
        F.when((F.col("n_yes") == 0) | (F.col("n_no") == 0), "unanimous")
        .when(F.col("n_yes") > F.col("n_no"), F.concat(F.lit("majority_yes_"), y, F.lit("_of_"), m))
        .when(F.col("n_no") > F.col("n_yes"), F.concat(F.lit("majority_no_"), k, F.lit("_of_"), m))
        .otherwise(F.concat(F.lit("split_"), y, F.lit("_vs_"), k))
    )
    return rated.where("n_raters >= 2").groupBy(name.alias("pattern")).agg(F.count("*").alias("n_items"))


def disagreements(rated: DataFrame, most: int | None = 50) -> DataFrame:
    """Items whose raters differ, in the order of their keys; the report shows the first of them."""
    rows = rated.where("n_yes > 0 and n_no > 0").select(*ITEM, "n_raters", "n_yes", "n_no", F.array_join(F.transform("votes", lambda v: F.concat(v["judge"], F.lit("="), v["verdict"])), ",").alias("votes"))
    return rows if most is None else rows.orderBy(*ITEM).limit(most)


def human_comparison(ratings: DataFrame, human: str = "human") -> DataFrame:
    """Accuracy against the human's label: of each judge, of the majority of two votes or more, of all judges where unanimous. Ties are counted apart."""
    n_judges = ratings.where(F.col("judge") != human).agg(F.count_distinct("judge").alias("n"))
    rated = items(ratings).withColumn("label", F.element_at(F.map_from_entries("votes"), human)).where("label is not null")
    votes = rated.select("label", F.inline(F.filter("votes", lambda v: v["judge"] != human)))
    each = votes.groupBy(F.col("judge").alias("who")).agg(F.count("*").alias("n_items"), F.count_if(F.col("verdict") == F.col("label")).alias("n_correct")).withColumn("ties", F.lit(0).cast("long"))
    y = F.col("n_yes") - F.when(F.col("label") == "yes", 1).otherwise(0)
    k = F.col("n_no") - F.when(F.col("label") == "no", 1).otherwise(0)
    counted = rated.select("label", y.alias("y"), k.alias("k")).join(F.broadcast(n_judges))  # one row
    enough = F.col("y") + F.col("k") >= 2
    side = F.when(F.col("y") > F.col("k"), "yes").when(F.col("k") > F.col("y"), "no")
    whole = (F.col("y") + F.col("k") == F.col("n")) & (F.least("y", "k") == 0) & (F.col("n") > 0)
    sums = counted.agg(
        F.count_if(enough & side.isNotNull()).alias("mn"), F.count_if(enough & (side == F.col("label"))).alias("mc"), F.count_if(enough & side.isNull()).alias("mt"), F.count_if(whole).alias("un"), F.count_if(whole & (side == F.col("label"))).alias("uc")
    )
    votes_of = sums.select(F.inline(F.array(F.struct(F.lit("majority_vote").alias("who"), F.col("mn").alias("n_items"), F.col("mc").alias("n_correct"), F.col("mt").alias("ties")), F.struct(F.lit("unanimous_vote").alias("who"), F.col("un").alias("n_items"), F.col("uc").alias("n_correct"), F.lit(0).cast("long").alias("ties")))))
    return each.unionByName(votes_of).withColumn("accuracy", F.try_divide("n_correct", "n_items"))
