"""Paired significance of the best group against others on shared items.

Differences between paired scores take few values, so their counts are all that
resampling needs. `paired_tests` draws nothing: scores are shares of few votes,
differences are multiples of a step, and the sums that resampling looks at are
whole numbers of steps, whose distributions follow from their characteristic
functions. A bootstrap sum of n items has that of one draw to the power of n, a
random sign flip is a product of cosines; the inverse transform over a period
gives probabilities without a replicate, so an interval and a p-value are what
drawing tends to as replicates grow. The period is 20 or more deviations wide:
what lies outside is under 1e-20. Terms of a group number as many as its period,
some 20 deviations of the sum in steps, whatever the number of items.

`drawn_tests` draws replicates: a bootstrap sample is a multinomial draw over the
values, a random sign flip a binomial one for each value, and a task draws CHUNK
replicates at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.sources.shared import staged

GROUP = ("model_short", "condition")
CHUNK = 100
STEP = 1 / 12  # of scores from 1, 2, 3, 4 or 6 votes
SPAN = 20  # deviations in a period
TINY = 1e-18
OUT = "model_short string, condition string, boot double, flip double"


def item_scores(judged: DataFrame, unit: str = "unit_key") -> DataFrame:
    """Mean vote over the judges of each item in each group."""
    return judged.groupBy(*GROUP, unit).agg(F.avg(F.when(F.col("correct") == "yes", 1.0).otherwise(0.0)).alias("combined_score"), F.count("*").alias("n_votes"))


def paired_differences(scores: DataFrame, best: tuple[str, str], challengers: DataFrame, unit: str = "unit_key") -> DataFrame:
    """(challenger, diff, n): how often each difference, best minus challenger, occurs on the units that both have."""
    top = scores.where((F.col("model_short") == best[0]) & (F.col("condition") == best[1])).select(F.col(unit).alias("_u"), F.col("combined_score").alias("_best"))
    rest = scores.join(F.broadcast(challengers.select(*GROUP)), list(GROUP))  # a few groups
    return rest.join(top, F.col(unit) == F.col("_u")).groupBy(*GROUP, (F.col("_best") - F.col("combined_score")).alias("diff")).agg(F.count("*").alias("n"))


def paired_moments(differences: DataFrame) -> DataFrame:
    """For each challenger: n, mean difference, and the exact deviation of that mean under random sign flips, with what it makes of the mean (z)."""
    n, mean = F.sum("n"), F.sum(F.col("diff") * F.col("n")) / F.sum("n")
    out = differences.groupBy(*GROUP).agg(n.alias("n_paired_items"), mean.alias("accuracy_difference"), (F.sqrt(F.sum(F.col("diff") * F.col("diff") * F.col("n"))) / n).alias("flip_std"))
    return out.withColumn("flip_z", F.try_divide("accuracy_difference", "flip_std"))


def drawn_tests(differences: DataFrame, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """For each challenger: n, mean difference, bootstrap 95 % interval, and the p-value of random sign flips."""
    values = F.array_sort(F.collect_list(F.struct("diff", "n")))
    table = differences.groupBy(*GROUP).agg(values.alias("d"), F.sum("n").alias("n_paired_items"), (F.sum(F.col("diff") * F.col("n")) / F.sum("n")).alias("accuracy_difference"))
    spark = differences.sparkSession
    chunks = spark.range(-(-replicates // CHUNK)).withColumnRenamed("id", "chunk")
    tasks = table.join(F.broadcast(chunks))  # groups are few, replicates a parameter
    tasks = tasks.select(*GROUP, "chunk", F.col("d.diff").alias("diffs"), F.col("d.n").alias("counts")).repartition(*GROUP, "chunk")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, other, chunk, diffs, counts in zip(*(frame[c] for c in (*GROUP, "chunk", "diffs", "counts")), strict=True):
                own = np.random.default_rng([seed, int(chunk), *f"{name}|{other}".encode()])
                diffs, counts = np.asarray(diffs), np.asarray(counts)
                size, n = min(CHUNK, replicates - CHUNK * int(chunk)), counts.sum()
                boot = own.multinomial(n, counts / n, size=size) @ diffs / n
                flip = (2 * own.binomial(counts, 0.5, size=(size, len(counts))) - counts) @ diffs / n
                yield pd.DataFrame({"model_short": name, "condition": other, "boot": boot, "flip": flip})

    drawn = tasks.mapInPandas(draw, OUT)
    facts = table.select(*GROUP, "n_paired_items", "accuracy_difference")
    joined = drawn.join(F.broadcast(facts), list(GROUP))  # a row for each group
    extreme = F.count_if(F.abs("flip") >= F.abs("accuracy_difference") - 1e-12)
    return joined.groupBy(*GROUP, "n_paired_items", "accuracy_difference").agg(F.percentile("boot", F.lit(0.025)).alias("ci95_low"), F.percentile("boot", F.lit(0.975)).alias("ci95_high"), ((extreme + 1) / (F.count("*") + 1)).alias("randomization_p_value"))


def _steps(differences: DataFrame, step: float) -> DataFrame:
    """A row for each challenger: d, its differences in steps with their shares; sums and deviations in steps."""
    each = differences.withColumn("_a", F.round(F.col("diff") / step).cast("long"))
    counted = each.groupBy(*GROUP, "_a").agg(F.sum("n").alias("_n"), F.max(F.abs(F.col("diff") - F.col("_a") * step)).alias("_off"))
    n, a = F.col("_n"), F.col("_a")
    out = counted.groupBy(*GROUP).agg(F.collect_list(F.struct(a.alias("a"), n.alias("n"))).alias("d"), F.sum("_n").alias("n"), F.sum(a * n).alias("s"), F.sum(a * a * n).alias("q"), F.max("_off").alias("off_grid"))  # a score has few values
    var = F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    boot = F.ceil(SPAN * F.sqrt(var)) + 2 * F.array_max(F.transform("d", lambda x: F.abs(x["a"]))) + 3
    flip = F.ceil(SPAN * F.sqrt("q")) + 2 * F.abs("s") + 3
    return out.withColumns({"boot_period": boot.cast("long"), "flip_period": flip.cast("long"), "far": F.abs("s") > SPAN / 2 * F.sqrt("q") + 1})


def _angles(rows: DataFrame, period: str) -> DataFrame:
    """A row for each angle 2 pi m / period, m from 1 to period - 1: a thousand for each row of a first explosion."""
    coarse = rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col(period) - 1) / 1000).cast("int"))))
    m = F.explode(F.sequence(F.greatest(F.lit(1), F.col("_c").cast("long") * 1000), F.least(F.col(period) - 1, F.col("_c").cast("long") * 1000 + 999)))
    return coarse.repartition(*GROUP, "_c").where(F.col(period) > 1).where(F.greatest(F.lit(1), F.col("_c").cast("long") * 1000) < F.col(period)).withColumn("m", m).withColumn("t", 2 * F.pi() * F.col("m") / F.col(period))


def flip_p_values(steps: DataFrame) -> DataFrame:
    """(challenger, p): the probability that a random sign flip's sum is as far from 0 as the sum observed."""
    phi = F.aggregate("d", F.lit(1.0), lambda acc, x: acc * F.when(x["a"] == 0, 1.0).otherwise(F.pow(F.cos(x["a"] * F.col("t")), x["n"].cast("double"))))
    inside = F.abs("s") - 1  # sums that are less extreme: from -inside to inside
    kernel = F.sin((inside + 0.5) * F.col("t")) / F.sin(F.col("t") / 2)
    near = steps.where(~F.col("far") & (F.col("s") != 0))
    terms = _angles(near, "flip_period").withColumn("x", phi * kernel).groupBy(*GROUP).agg(F.sum("x").alias("x"))
    whole = near.join(terms, list(GROUP)).select(*GROUP, F.greatest(F.lit(0.0), 1 - (2 * inside + 1 + F.col("x")) / F.col("flip_period")).alias("p"))
    rest = steps.where(F.col("far") | (F.col("s") == 0)).select(*GROUP, F.when(F.col("s") == 0, 1.0).otherwise(0.0).alias("p"))
    return whole.unionByName(rest)


def bootstrap_bounds(steps: DataFrame, shares: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """(challenger, bounds): the least sums, in steps, that a bootstrap sum is at or under with these probabilities."""
    part = lambda f: F.aggregate("d", F.lit(0.0), lambda acc, x: acc + x["n"] / F.col("n") * f(x["a"] * F.col("t")))
    # angles that carry nothing are dropped: of a smooth distribution some dozens are left
    terms = _angles(steps, "boot_period").withColumns({"re": part(F.cos), "im": part(F.sin)})
    size = F.pow(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.col("n") / 2.0)
    terms = terms.withColumn("size", size).where(F.col("size") > TINY)
    terms = terms.groupBy(*GROUP).agg(F.collect_list(F.struct("t", "size", (F.atan2("im", "re") * F.col("n")).alias("turn"))).alias("terms"))
    low = F.col("s") - F.floor(F.col("boot_period") / 2)  # the period's first sum
    none = F.array().cast(terms.schema["terms"].dataType)
    rows = steps.join(terms, list(GROUP), "left").withColumns({"terms": F.coalesce("terms", none), "low": low})

    def below(k):
        """Probability of a sum from low to k."""
        one = lambda x: x["size"] * F.cos(x["turn"] - x["t"] * (F.col("low") + k) / 2) * F.sin((k - F.col("low") + 1) * x["t"] / 2) / F.sin(x["t"] / 2)
        return (k - F.col("low") + 1 + F.aggregate("terms", F.lit(0.0), lambda acc, x: acc + one(x))) / F.col("boot_period")

    def bound(share: float):
        start = F.struct(F.col("low").cast("long").alias("a"), (F.col("low") + F.col("boot_period") - 1).cast("long").alias("b"))

        def halved(acc, _):
            middle = F.floor((acc["a"] + acc["b"]) / 2)
            enough = below(middle) >= share
            return F.struct(F.when(enough, acc["a"]).otherwise(F.least(middle + 1, acc["b"])).cast("long").alias("a"), F.when(enough, middle).otherwise(acc["b"]).cast("long").alias("b"))

        return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2("boot_period")).cast("int") + 1), start, halved)["b"]

    return rows.select(*GROUP, F.array(*(bound(p) for p in shares)).alias("bounds"))


def paired_tests(differences: DataFrame, step: float = STEP) -> DataFrame:
    """For each challenger: n, mean difference, bootstrap 95 % interval and the p-value of random sign flips, all exact.

    Differences count as multiples of step; off_grid is the furthest one from it.
    A p-value under about 1e-13 is 0.
    """
    steps = staged(_steps(differences, step), "steps")  # a row for each challenger
    out = steps.join(bootstrap_bounds(steps), list(GROUP)).join(flip_p_values(steps), list(GROUP))
    return out.select(*GROUP, F.col("n").alias("n_paired_items"), (F.col("s") * step / F.col("n")).alias("accuracy_difference"), *((F.col("bounds")[i] * step / F.col("n")).alias(f"ci95_{name}") for i, name in enumerate(("low", "high"))), F.col("p").alias("randomization_p_value"), "off_grid")
