"""Gold datasets: readings, validation, hold-outs, splits, folds, samples, augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import keys, text
from assayer.operators.rank import ranked

# Phrases and the forms that may stand for them, in the order they are looked for.
PARAPHRASES = (
    ("can guarantee that", ("can ensure that", "guarantees that", "is able to guarantee that")),
    ("sooner or later", ("eventually", "at some point in the future", "finally")),
    ("at the next step", ("in the next moment", "immediately after")),
    ("will always", ("will forever", "will continuously", "will perpetually")),
    ("will keep", ("will continue to", "will maintain")),
)


def gold_options(*sources: Column) -> Column:
    """All readings given by columns of strings or arrays of them, in order: trimmed, none blank, each once."""
    arrays = [F.coalesce(s, F.array().cast("array<string>")) for s in sources]
    return F.array_distinct(F.filter(F.transform(F.concat(*arrays), text.strip), lambda x: x.isNotNull() & (x != "")))


def normalized_items(df: DataFrame, input_col: str = "input", outputs_col: str = "outputs") -> DataFrame:
    """df with its readings cleaned and `problem`: null, or what is wrong with the item."""
    out = df.withColumn(outputs_col, gold_options(F.col(outputs_col)))
    blank = text.strip(F.coalesce(F.col(input_col), F.lit(""))) == ""
    return out.withColumn("problem", F.when(blank, "input is blank").when(F.size(outputs_col) == 0, "no outputs"))


def require_valid(items: DataFrame, name: str = "id") -> DataFrame:
    """The items, or an error that names a bad one."""
    bad = items.where("problem is not null").select(name, "problem").limit(1).collect()
    if bad:
        raise ValueError(f"item {bad[0][0]}: {bad[0][1]}")
    return items.drop("problem")


def without_exemplars(items: DataFrame, exemplars: DataFrame, input_col: str = "input", exemplar_col: str = "input") -> DataFrame:
    """Items whose input, in lower case and trimmed, is no exemplar's. The other way round with the arguments swapped."""
    held = exemplars.select(F.lower(F.trim(exemplar_col)).alias("_held")).where("_held is not null").distinct()
    return items.join(held, F.lower(F.trim(F.col(input_col))) == F.col("_held"), "left_anti")


def default_stratum(outputs: Column) -> Column:
    return F.when(F.size(outputs) > 1, "multi").otherwise("single")


def split(items: DataFrame, key: str, stratum: str | None, train: float, validation: float, test: float, seed: int) -> DataFrame:
    """items with `split` and `ordinal`: in each stratum the first round(n * train) of a seeded order, then the validation share, then the rest."""
    if abs(train + validation + test - 1) > 1e-6:
        raise ValueError("fractions must add up to 1")
    rows = ranked(items, key, seed, "split", [stratum] if stratum else [], "ordinal", "_n")
    a, b = F.bround(F.col("_n") * train), F.bround(F.col("_n") * validation)
    return rows.withColumn("split", F.when(F.col("ordinal") <= a, "train").when(F.col("ordinal") <= a + b, "validation").otherwise("test")).drop("_n")


def folds(items: DataFrame, key: str, stratum: str | None, k: int, seed: int) -> DataFrame:
    """items with `fold`, dealt in turn within each stratum."""
    if k < 2:
        raise ValueError("at least two folds")
    rows = ranked(items, key, seed, "fold", [stratum] if stratum else [], "_rank")
    return rows.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def fold_split(items: DataFrame, key: str, stratum: str | None, k: int, fold: int, validation: float, seed: int) -> DataFrame:
    """items with `split`: one fold is the test, round(N * validation) of the others the validation set, the rest trains."""
    dealt = folds(items, key, stratum, k, seed).withColumn("_test", F.col("fold") == fold)
    rows = ranked(dealt, key, seed, f"fold-{fold}-validation", ["_test"], "_rank", "_n")
    return rows.withColumn("split", F.when(F.col("_test"), "test").when(F.col("_rank") <= F.bround(F.col("_n") * validation), "validation").otherwise("train")).drop("_test", "_rank", "_n", "fold")


def covering_sample(items: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """n items, taken from the strata in turn."""
    return ranked(items, key, seed, "sample", [stratum], "_rank").orderBy("_rank", stratum).limit(n).drop("_rank")


def exemplar_choice(exemplars: DataFrame, order: str, n: int | None, seed: int) -> DataFrame:
    """All exemplars in their order, or n of them by a seeded one."""
    if n is None:
        return exemplars.orderBy(order)
    return exemplars.orderBy(keys.ordering_hash(seed, "exemplars", F.col(order)), order).limit(n)


def augmented(items: DataFrame, key: str, factor: int, seed: int, table: Sequence[tuple[str, Sequence[str]]] = PARAPHRASES, input_col: str = "input") -> DataFrame:
    """Each item as it is (copy 0) and factor - 1 times with a phrase replaced."""
    rows = items.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    choice = keys.choice_number(seed, F.col(key), F.col("copy"))
    return rows.withColumn(input_col, F.when(F.col("copy") == 0, F.col(input_col)).otherwise(text.paraphrased(F.col(input_col), choice, table)))


def split_manifest(rows: DataFrame, id_col: str, input_col: str, outputs: Column) -> DataFrame:
    """(split, ordinal, id, input_sha256, outputs_sha256)."""
    return rows.select("split", "ordinal", keys.item_id(F.col(id_col), F.col(input_col)).alias("id"), F.sha2(F.coalesce(F.col(input_col), F.lit("")), 256).alias("input_sha256"), F.sha2(F.to_json(outputs), 256).alias("outputs_sha256"))


def supervised_pairs(items: DataFrame, family: Column, system: Column, user: Column, outputs: Column) -> DataFrame:
    """items with `prompt`, `completion` and `tokens`: the completion is what the full text adds to the prompt; starts_with_prompt says that it does."""
    target = F.array_join(outputs, "\n")
    prompt, full = text.chat_prompt(family, system, user), text.chat_prompt(family, system, user, target)
    rows = items.withColumns({"prompt": prompt, "_full": full})
    return rows.withColumns({"starts_with_prompt": F.col("_full").startswith(F.col("prompt")), "completion": F.substring(F.col("_full"), F.length("prompt") + 1, F.length("_full")), "tokens": text.token_estimate(F.col("_full"))}).drop("_full")


def over_length(pairs: DataFrame, kind: Column, key: str, limit: int, shown: int = 20) -> DataFrame:
    """For each kind: how many are over the limit, the longest, and the first keys of them."""
    bad = pairs.where(F.col("tokens") > limit).select(kind.alias("kind"), F.col(key).alias("_key"), "tokens")
    own = bad.groupBy("kind", "_key").agg(F.count("*").alias("_n"), F.max("tokens").alias("_longest")).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(256)))
    # the first keys of a kind are among the first of its buckets: no group gathers more than these
    within = Window.partitionBy("kind", "_bucket").orderBy(F.col("_key").asc_nulls_last())
    firsts = F.collect_list(F.when(F.col("_rank") <= shown, F.col("_key")))
    return own.withColumn("_rank", F.row_number().over(within)).groupBy("kind").agg(F.sum("_n").alias("n_over"), F.max("_longest").alias("longest"), F.slice(F.sort_array(firsts), 1, shown).alias("examples"))
