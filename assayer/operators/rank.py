"""Exact ranks within strata of any size.

A window over a stratum is one task. Here the order is that of a hash, whose
first digits deal each stratum into 4096 buckets: counts of these give each
bucket's first rank, and ranks within buckets, which are small, the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.keys import ordering_hash
from assayer.sources.shared import staged

DIGITS = 3


def ranked(df: DataFrame, key: str, seed: int, namespace: str | Column, strata: list[str] | None = None, into: str = "rank", size: str | None = None) -> DataFrame:
    """df with the rank, from 1, of each row in its stratum by (hash, key); size adds the stratum's number of rows."""
    strata = strata or []
    keyed = df.withColumns({"_hash": ordering_hash(seed, namespace, F.col(key)), "_all": F.lit(0)}).withColumn("_bucket", F.substring("_hash", 1, DIGITS))
    by = ["_all", *strata]
    # 4096 rows a stratum at most: a window over them is small
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    extra = []
    if size:
        firsts = firsts.withColumn(size, F.sum("_n").over(Window.partitionBy(*by)))
        extra = [F.col(f"f.{size}")]
    on = F.lit(True)
    for c in [*by, "_bucket"]:
        on = on & F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}"))
    joined = keyed.alias("k").join(firsts.alias("f"), on).select("k.*", "f._before", *extra)
    within = Window.partitionBy(*by, "_bucket").orderBy("_hash", key)
    return joined.withColumn(into, (F.row_number().over(within) + F.col("_before")).cast("long")).drop("_hash", "_all", "_bucket", "_before")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], parts: int = 64, salts: int = 16) -> DataFrame:
    """Exact, interpolated quantiles of each group, by name.

    Different values are counted first. A sketch of these brackets the ranks: its
    cuts deal a group's values to `parts` (a power of 2) ranges of about as many
    each, whatever the values are. Ranges are counted exactly, and only those that hold a wanted
    rank are ordered. Nulls are skipped; a group without values has no row.
    """
    keyed = rows.where(F.col(value).isNotNull()).withColumn("_group", F.struct(F.lit(0).alias("_"), *by))
    own = staged(keyed.groupBy("_group", F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), "counted-values")
    cuts = own.groupBy("_group").agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], 20 * parts).alias("_cuts"), F.sum("_n").alias("_all"))
    # a group's values may be a third of all: its row is copied for each salt
    cuts = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = own.withColumn("_salt", F.pmod(F.hash("_v"), F.lit(salts))).join(cuts, ["_group", "_salt"])
    # how many cuts aren't above the value, by halves
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(parts.bit_length() - 1))))
    below = F.aggregate(halves, F.lit(0), lambda p, s: F.when(F.get("_cuts", p + s - 1) <= F.col("_v"), p + s).otherwise(p))
    placed = placed.withColumn("_part", below).select("_group", "_v", "_n", "_all", "_part")
    sizes = placed.groupBy("_group", "_part").agg(F.sum("_n").alias("_size"), F.first("_all").alias("_all"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as parts
    ranks = F.array(*(F.struct(F.lit(n).alias("name"), ((F.col("_all") - 1) * p).alias("at")) for n, p in shares.items()))
    wanted = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("_w", F.explode(ranks))
    wanted = wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_w.at"), F.ceil("_w.at"))))).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size")))
    wanted = wanted.groupBy("_group", "_part", "_before").agg(F.collect_list(F.struct(F.col("_w.name").alias("name"), F.col("_w.at").alias("at"), F.col("_rank").alias("rank"))).alias("_wanted"))  # two for each share at most
    upto = Window.partitionBy("_group", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.drop("_all").join(wanted, ["_group", "_part"]).withColumn("_end", F.col("_before") + F.sum("_n").over(upto))
    here = F.filter("_wanted", lambda w: (w["rank"] < F.col("_end")) & (w["rank"] >= F.col("_end") - F.col("_n")))
    hit = inside.select("_group", "_v", F.explode(here).alias("w"))
    weight = F.when(F.floor("w.at") == F.ceil("w.at"), F.lit(1.0)).otherwise(1 - F.abs(F.col("w.at") - F.col("w.rank")))
    out = hit.groupBy("_group").agg(*(F.sum(F.when(F.col("w.name") == n, F.col("_v") * weight)).alias(n) for n in shares))
    return out.select(*(F.col("_group")[c].alias(c) for c in by), *shares)
