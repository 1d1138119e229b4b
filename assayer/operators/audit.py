"""Audit samples: strata, quotas, apportionment, a seeded sample without repeated units, ids, blind and key forms."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.keys import ordering_hash
from assayer.operators.rank import ranked
from assayer.sources.shared import staged


def judge_label(name: str) -> str:
    """Short name of a judge in stratum names."""
    for prefix in ("ds", "gpt"):
        if name.startswith(f"{prefix}-"):
            return prefix
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()


def population(judged: DataFrame, judges: Sequence[str], key: str = "population_key") -> DataFrame:
    """Items that every judge has decided: verdict and method of each judge as columns v_<i>, m_<i>."""
    rows = judged.where(F.col("judge").isin(*judges))
    aggregates = []
    for i, j in enumerate(judges):
        own = F.col("judge") == j
        aggregates += [F.max_by(F.when(own, F.col("verdict")), F.when(own, F.col("ord"))).alias(f"v_{i}"), F.max_by(F.when(own, F.col("decision_method")), F.when(own, F.col("ord"))).alias(f"m_{i}")]
    counted = rows.groupBy(key).agg(F.count_distinct("judge").alias("_n"), F.min_by("source_file", "ord").alias("source_file"), *aggregates)
    return counted.where(F.col("_n") == len(judges)).drop("_n")


def decision_stratum(v0: Column, v1: Column, methods: Sequence[Column], judges: Sequence[str]) -> Column:
    a, b = judge_label(judges[0]), judge_label(judges[1])
    exact = F.lit(False)
    for m in methods:
        exact = exact | F.coalesce(m == "exact", F.lit(False))
    return (
        F.when(exact, "exact_match")
        .when((v0 == "yes") & (v1 == "yes"), "llm_agree_yes")
        .when((v0 == "no") & (v1 == "no"), "llm_agree_no")
        .when((v0 == "yes") & (v1 == "no"), f"disagree_{a}_yes_{b}_no")
        .when((v0 == "no") & (v1 == "yes"), f"disagree_{a}_no_{b}_yes")
        .otherwise("other")
    )


def source_stratum(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def resolved_quotas(available: DataFrame, requested: Mapping[str, int], priority: Sequence[str]) -> DataFrame:
    """(stratum, quota): requests cut to what is there; what is short is made up along the priorities. available: (stratum, n)."""
    spark = available.sparkSession
    names = list(dict.fromkeys([*requested, *priority]))
    rank = {s: i for i, s in enumerate(priority)}
    asked = spark.createDataFrame([(s, max(0, int(requested.get(s, 0))), rank.get(s, -1)) for s in names], "stratum string, asked long, priority int")
    # one row a stratum, and strata are few
    rows = F.broadcast(asked).join(available, "stratum", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("cut", F.least("asked", "n"))
    everything = Window.partitionBy(F.lit(0))
    short = F.sum("asked").over(everything) - F.sum("cut").over(everything)
    spare = F.when(F.col("priority") >= 0, F.col("n") - F.col("cut")).otherwise(0)
    before = F.coalesce(F.sum(spare).over(everything.orderBy(F.when(F.col("priority") >= 0, F.col("priority")).otherwise(10**6), "stratum").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"_short": short, "_spare": spare, "_before": before}).select("stratum", (F.col("cut") + F.least("_spare", F.greatest(F.col("_short") - F.col("_before"), F.lit(0)))).alias("quota"))


def apportioned(groups: DataFrame, by: list[str], group: str, quota: str = "quota", size: str = "n") -> DataFrame:
    """(by, group, allocation): each group's floor share of the quota; what is left goes, all it can take, to the largest fraction first.

    Of groups with one fraction, units go to where most room is left, then to the
    last group by name: the room that is left ends at one level for all that had
    more, which follows from sums over the groups in order of room.
    """
    whole = Window.partitionBy(*by)
    raw = F.col(quota) * F.col(size) / F.sum(size).over(whole)
    rows = groups.withColumn("_raw", raw).withColumn("_base", F.least(F.col(size), F.floor("_raw")))
    rows = rows.withColumns({"_rem": F.least(F.col(quota), F.sum(size).over(whole)) - F.sum("_base").over(whole), "_room": F.col(size) - F.col("_base"), "_part": F.col("_raw") - F.floor("_raw")})
    alike = Window.partitionBy(*by, "_part")
    all_room = F.sum("_room").over(alike)
    before = F.sum("_room").over(whole.orderBy(F.desc("_part")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - all_room
    rows = rows.withColumn("_award", F.least(all_room, F.greatest(F.lit(0), F.col("_rem") - before)))
    largest = alike.orderBy(F.desc("_room"), F.desc(group)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_upto": F.sum("_room").over(largest), "_k": F.row_number().over(alike.orderBy(F.desc("_room"), F.desc(group)))})
    rows = rows.withColumn("_level", F.max(F.floor((F.col("_upto") - F.col("_award")) / F.col("_k")) + 1).over(alike))
    rows = rows.withColumn("_more", F.greatest(F.lit(0), F.col("_room") - F.col("_level")))
    last = F.row_number().over(alike.orderBy(F.desc(F.col("_room") >= F.col("_level")), F.desc(group)))
    rows = rows.withColumns({"_one": F.col("_award") - F.sum("_more").over(alike), "_last": last})
    one = F.when((F.col("_last") <= F.col("_one")) & (F.col("_room") >= F.col("_level")), 1).otherwise(0)
    return rows.select(*by, group, (F.col("_base") + F.when(F.col("_award") > 0, F.col("_more") + one).otherwise(0)).cast("long").alias("allocation"))


def _prefix(order: Column) -> Column:
    """The first 32 bits of an ordering hash: rows up to a limit of it come first in the order."""
    return F.conv(F.substring(order, 1, 8), 16, 10).cast("long")


def _limit(wanted: Column, rows: Column, widen: float = 1.0) -> Column:
    """A limit of the prefix under which `wanted` rows lie, but for a chance of some 1e-9; 2**32 where that is all of them."""
    return F.least(F.lit(float(1 << 32)), (wanted + 6 * F.sqrt(wanted) + 20) * widen / rows * float(1 << 32)).cast("long")


def bucket_sample(candidates: DataFrame, quotas: DataFrame, key: str, seed: int, stratum: str = "primary_stratum", source: str = "source_stratum") -> DataFrame:
    """Of each stratum its quota, apportioned over sources; in each source the first by a seeded hash. Every stratum in one pass.

    Only rows under a limit of the hash are ranked: all of these come before all
    others, so where they are enough, the first of them are the first of all. The
    limit is widened until they are.
    """
    sizes = candidates.groupBy(stratum, source).agg(F.count("*").alias("n")).join(quotas.select(F.col("stratum").alias(stratum), "quota"), stratum)
    shares = staged(sizes.select(stratum, source, "n").join(apportioned(sizes, [stratum], source), [stratum, source]).where("allocation > 0"), "allocations")
    order = ordering_hash(seed, F.concat(F.lit("primary:"), F.col(stratum)), F.col(key))
    names = candidates.columns
    widen = 1.0
    while True:
        limits = shares.select(stratum, source, "allocation", _limit(F.col("allocation"), F.col("n"), widen).alias("_limit"))
        few = staged(candidates.join(limits, [stratum, source]).withColumn("_h", order).where(_prefix(F.col("_h")) <= F.col("_limit")), "candidates")
        found = few.groupBy(stratum, source).agg(F.count("*").alias("_found"))
        if shares.join(found, [stratum, source], "left").where("coalesce(_found, 0) < allocation").isEmpty():
            first = Window.partitionBy(stratum, source).orderBy("_h", key)
            return few.withColumn("_rank", F.row_number().over(first)).where("_rank <= allocation").select(*names)
        widen *= 8


def _fill(rows: DataFrame, taken: DataFrame, gaps: DataFrame, order: Column, rank: Column, key: str, unit: str) -> DataFrame:
    """The first rows of units that aren't taken, as many as gaps has for each group. gaps: (primary_stratum, _group, _gap).

    A unit stands for its first row by (rank, order, key). Only units with a row
    under a limit of the order, in a group with a gap, are looked at, with all
    their rows; widened until each group has enough or all of it is looked at.
    """
    names = rows.columns
    taken_units = taken.select(unit).distinct()
    free = rows.join(F.broadcast(taken_units), unit, "left_anti").withColumns({"_h": order, "_place": rank})  # as many as the quotas at most
    free = free.join(F.broadcast(gaps), "primary_stratum", "left")  # a row for each stratum
    sizes = free.where("_gap > 0").groupBy("_group", "_gap").agg(F.count("*").alias("n")).collect()  # a row for each group
    widen = 4.0
    while True:
        upto = {s["_group"]: min(1 << 32, int((s["_gap"] + 6 * s["_gap"] ** 0.5 + 20) * widen / s["n"] * (1 << 32))) for s in sizes}
        limits = rows.sparkSession.createDataFrame(list(upto.items()), "_group string, _limit long")
        candidates = free.where("_gap > 0").join(F.broadcast(limits), "_group").where(_prefix(F.col("_h")) <= F.col("_limit")).select(unit).distinct()
        first = Window.partitionBy(unit).orderBy("_place", "_h", key)
        own = free.join(candidates, unit, "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1 and _gap > 0")
        own = staged(own.join(F.broadcast(limits), "_group").where(_prefix(F.col("_h")) <= F.col("_limit")), "fill")
        found = {r["_group"]: r["n"] for r in own.groupBy("_group").agg(F.count("*").alias("n")).collect()}
        if all(upto[s["_group"]] >= 1 << 32 or found.get(s["_group"], 0) >= s["_gap"] for s in sizes):
            best = Window.partitionBy("_group").orderBy("_h", key)
            return own.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.col("_gap")).select(*names)
        widen *= 8


def audit_sample(rows: DataFrame, requested: Mapping[str, int], priority: Sequence[str], seed: int, key: str = "population_key", unit: str = "annotation_unit_key") -> DataFrame:
    """Rows with their stratum's quota filled, no annotation unit twice, and the total made up along the priorities.

    Of a unit chosen in several strata, the first requested keeps it. Rows that
    fill a gap are chosen by a seeded hash among units not taken yet, and are no
    units twice among themselves. The sample's size is bounded by the quotas. rows
    is read several times: pass a stored table.
    """
    available = rows.groupBy(F.col("primary_stratum").alias("stratum")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    settled = resolved_quotas(available, requested, priority).collect()  # a row for each stratum
    quotas = spark.createDataFrame([tuple(q) for q in settled], "stratum string, quota long")
    place = {s: i for i, s in enumerate(dict.fromkeys([*requested, *priority]))}
    numbered = lambda names, other: F.coalesce(F.create_map(*(F.lit(x) for p in names.items() for x in p))[F.col("primary_stratum")], F.lit(other)) if names else F.lit(other)
    rank = numbered(place, len(place))
    picked = bucket_sample(rows, quotas, key, seed).withColumns({"_place": rank, "_h": ordering_hash(seed, F.concat(F.lit("primary:"), F.col("primary_stratum")), F.col(key))})
    first = Window.partitionBy(unit).orderBy("_place", "_h", key)
    taken = staged(picked.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*rows.columns), "taken")
    have = {r["primary_stratum"]: r["n"] for r in taken.groupBy("primary_stratum").agg(F.count("*").alias("n")).collect()}
    gaps = [(q["stratum"], q["stratum"], int(q["quota"] - have.get(q["stratum"], 0))) for q in settled if q["quota"] > have.get(q["stratum"], 0)]
    if gaps:
        table = spark.createDataFrame(gaps, "primary_stratum string, _group string, _gap long")
        taken = taken.unionByName(_fill(rows, taken, table, ordering_hash(seed, "unique-fill", F.col(key)), rank, key, unit))  # of staged rows, as many as the quotas
    missing = sum(int(q["quota"]) for q in settled) - (taken.count() if gaps else sum(have.values()))
    strata = [r["stratum"] for r in available.select("stratum").collect()] if missing > 0 else []  # a row for each stratum
    level = {s: i for i, s in enumerate(priority)}
    for own in sorted({level.get(s, 99) for s in strata}):  # along the priorities, as long as something is missing
        if missing <= 0:
            break
        table = spark.createDataFrame([(s, "all", missing) for s in strata if level.get(s, 99) == own], "primary_stratum string, _group string, _gap long")
        more = _fill(rows, taken, table, ordering_hash(seed, "global-unique-fill", F.col(key)), rank, key, unit)
        missing -= more.count()
        taken = taken.unionByName(more)
    return taken


def with_audit_ids(rows: DataFrame, seed: int, prefix: str = "AUDIT", key: str = "population_key") -> DataFrame:
    """audit_id PREFIX-0001 ... in a seeded order."""
    out = ranked(rows, key, seed, "presentation", [], "presentation_order")
    return out.withColumn("audit_id", F.format_string("%s-%04d", F.lit(prefix), F.col("presentation_order")))


def disagreement_pool(rows: DataFrame, seed: int, prefix: str = "DIS", key: str = "population_key") -> DataFrame:
    """Every item on which the judges differ, with ids."""
    return with_audit_ids(rows.where(F.col("primary_stratum").startswith("disagree_")), seed, prefix, key)


def blind(rows: DataFrame, golds: Column, extra: Sequence[str] = ("input", "prediction")) -> DataFrame:
    """What annotators see: no model, judge or stratum."""
    pick = lambda i: F.coalesce(F.try_element_at(golds, F.lit(i)), F.lit(""))
    return rows.select("audit_id", extra[0], pick(1).alias("gold_1"), pick(2).alias("gold_2"), *extra[1:], F.lit("").alias("correct"), F.lit("").alias("annotator_id"))


def stratum_weights(rows: DataFrame, sample: DataFrame, by: str = "primary_stratum") -> DataFrame:
    """Population and sample sizes of each stratum and the weight of a sampled row."""
    a = rows.groupBy(by).agg(F.count("*").alias("population"))
    b = sample.groupBy(by).agg(F.count("*").alias("sampled"), F.count_distinct("annotation_unit_key").alias("units"))
    return a.join(b, by, "left").select(by, "population", F.coalesce("sampled", F.lit(0)).alias("sampled"), F.coalesce("units", F.lit(0)).alias("units"), F.try_divide(F.col("population"), F.col("sampled")).alias("sampling_weight"))


def complexity_counts(rows: DataFrame, sample: DataFrame, by: str = "complexity_bin") -> DataFrame:
    """How many rows and how many sampled ones each bin of complexity has."""
    both = rows.select(by, F.lit(1).alias("_r"), F.lit(0).alias("_s")).unionByName(sample.select(by, F.lit(0).alias("_r"), F.lit(1).alias("_s")))
    return both.groupBy(by).agg(F.sum("_r").alias("population"), F.sum("_s").alias("sampled"))


# The columns of the key that belongs to a blind sample, in order.
KEY_FIELDS = (
    "audit_id",
    "presentation_order",
    "population_key",
    "annotation_unit_key",
    "primary_stratum",
    "source_stratum",
    "sampling_weight_primary",
    "source_stem",
    "source_file",
    "run_id",
    "item_id",
    "model",
    "model_short",
    "condition",
    "seed",
    "finetuned",
    "few_shot",
    "num_few_shot",
    "git_commit",
    "dataset_path",
    "source_sha256",
    "formula_profile",
    "input",
    "gold",
    "gold_options",
    "prediction",
    "judge_decisions",
)


def decisions(judges: Sequence[str], fields: Mapping[str, Sequence[str]]) -> Column:
    """{judge: {field: value}} from a column for each judge and field."""
    return F.create_map(*(x for i, j in enumerate(judges) for x in (F.lit(j), F.struct(*(F.col(columns[i]).alias(name) for name, columns in fields.items())))))


def key_items(sample: DataFrame, weights: DataFrame, by: str = "primary_stratum") -> DataFrame:
    """What a reviewer joins annotations with: every field of KEY_FIELDS by name, null where the sample has no such column."""
    weighed = sample.join(F.broadcast(weights.select(by, F.round("sampling_weight", 6).alias("sampling_weight_primary"))), by, "left")  # a row for each stratum
    return weighed.select(*(F.col(c) if c in weighed.columns else F.lit(None).cast("string").alias(c) for c in KEY_FIELDS))
