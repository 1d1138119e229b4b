"""Readers of record files: gold datasets, predictions, judged files, annotations.

Files are JSON arrays or objects, read whole by Spark (`multiLine`), one row a
file or record; names and positions come along, since order is meaningful.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators import dataset
from assayer.sources import arrays

DATASET = "id string, input string, outputs array<struct<formula:string>>, _bad string"
ITEM = "struct<id:string,input:string,gold:string,expected:string,reference:string,gold_options:array<string>,expected_options:array<string>,prediction:string,generated:string,model_output:string,correct:string,reasoning:string,decision_method:string,exact_match:string,latency_ms:double,generation_error:string>"
HEADER = ("run_id", "judge_model", "prompt_version", "model", "model_short", "condition", "finetuned", "few_shot", "seed", "cv_fold", "total_samples", "duration_seconds", "latency_mean_ms", "latency_total_ms")
_HEADER = "run_id string, judge_model string, prompt_version string, model string, model_short string, condition string, finetuned boolean, few_shot boolean, seed long, cv_fold long, total_samples long, duration_seconds double, latency_mean_ms double, latency_total_ms double"
FILE = f"{_HEADER}, metadata struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in _HEADER.split(', ')))}>, detailed_results array<{ITEM}>, predictions array<{ITEM}>, _bad string"


def _json(spark: SparkSession, path: str | list[str], schema: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path)


def gold_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Items with their place, readings cleaned, and `problem` where one is not valid."""
    rows = _json(spark, path, DATASET).withColumns({"_file": F.col("_metadata.file_path"), "ordinal": F.monotonically_increasing_id()})
    items = rows.withColumn("outputs", F.transform("outputs", lambda x: x["formula"]))
    out = dataset.normalized_items(items)
    return out.withColumn("problem", F.when(F.col("_bad").isNotNull(), "not an object").otherwise(F.col("problem"))).drop("_bad", "_file")


def large_gold_dataset(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = arrays.RANGE_BYTES) -> DataFrame:
    """gold_dataset for files of any size: each is read by many tasks. ordinal grows along a file, with gaps."""
    read = F.from_json("value", DATASET, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = arrays.array_elements(spark, path, pattern, range_bytes).select("ordinal", read.alias("x")).select("ordinal", "x.*")
    out = dataset.normalized_items(rows.withColumn("outputs", F.transform("outputs", lambda x: x["formula"])))
    return out.withColumn("problem", F.when(F.col("_bad").isNotNull(), "not an object").otherwise(F.col("problem"))).drop("_bad")


def matching_files(spark: SparkSession, folder: str, wanted: str = "all") -> DataFrame:
    """Paths of record files under a folder: all, by path, by name with or without .json, or by pattern."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path", F.substring_index("path", "/", -1).alias("name"))
    if wanted == "all":
        return listed
    if any(c in wanted for c in "*?["):
        like = F.lit("^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in ".+(){}|^$" else c) for c in wanted) + "$")
        return listed.where(F.regexp(F.col("name"), like))
    return listed.where((F.col("path").endswith(wanted) & F.lit("/" in wanted)) | F.col("name").isin(wanted, f"{wanted}.json"))


def header(rows: DataFrame) -> DataFrame:
    """The fields of a run: from `metadata`, or from the top level."""
    return rows.withColumns({c: F.coalesce(F.col(f"metadata.{c}"), F.col(c)) for c in HEADER}).drop("metadata")


def item_columns() -> dict[str, Column]:
    """An item's fields whatever names they go by."""
    pick = lambda *names: text.first_filled(*(f"item.{n}" for n in names))
    golds = dataset.gold_options(F.col("item.expected_options"), F.col("item.gold_options"), F.array(F.col("item.expected")), F.array(F.col("item.gold")), F.array(F.col("item.reference")))
    return {
        "id": F.col("item.id"),
        "input": F.coalesce(F.col("item.input"), F.lit("")),
        "gold": F.coalesce(pick("gold", "reference", "expected"), F.array_join(golds, "\n")),
        "golds": golds,
        "prediction": F.coalesce(pick("prediction", "generated", "model_output"), F.lit("")),
        **{c: F.col(f"item.{c}") for c in ("correct", "reasoning", "decision_method", "exact_match", "latency_ms", "generation_error")},
    }


def record_files(spark: SparkSession, path: str | list[str], pattern: str = "*.json") -> DataFrame:
    """Items of prediction or judged files, in either form (an object with rows, or a bare list), with header, file and ordinal.

    Files that can't be read (see unreadable_files) and summaries are left out; a bare list's rows are
    objects of its own, so it is read as items.
    """
    rows = _json(spark, path, FILE, pattern).select("*", F.col("_metadata.file_path").alias("file"))
    rows = rows.where("_bad is null").where(~F.substring_index("file", "/", -1).startswith("summary"))
    head = header(rows).withColumn("_items", F.coalesce("detailed_results", "predictions"))
    whole = head.where("_items is not null").select(*HEADER, "file", F.posexplode("_items").alias("ordinal", "item"))
    out = whole.select(*HEADER, "file", F.col("ordinal").cast("long").alias("ordinal"), *(c.alias(n) for n, c in item_columns().items()))
    bare = _json(spark, path, _bare_schema(), pattern).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"))
    bare = bare.where("_bad is null and detailed_results is null and predictions is null").where(~F.substring_index("file", "/", -1).startswith("summary"))
    bare = bare.select("file", "ordinal", F.struct(*_item_fields()).alias("item"))
    listed = bare.select(*(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in _HEADER.split(", "))), "file", "ordinal", *(c.alias(n) for n, c in item_columns().items()))
    return out.unionByName(listed)


def _item_fields() -> list[str]:
    return [x.split(":", 1)[0] for x in ITEM.removeprefix("struct<").removesuffix(">").split(",")]


def _bare_schema() -> str:
    own = ", ".join(f"{n} {t}" for n, t in (x.split(":", 1) for x in ITEM.removeprefix("struct<").removesuffix(">").split(",")))
    return f"{own}, detailed_results array<string>, predictions array<string>, _bad string"


def unreadable_files(spark: SparkSession, path: str | list[str], pattern: str = "*.json") -> DataFrame:
    """(file): those that record_files leaves out since they are no JSON. Say how many there are before going on without them."""
    rows = _json(spark, path, FILE, pattern).select("_bad", "metadata", F.col("_metadata.file_path").alias("file"))
    return rows.where("_bad is not null and metadata is null").select("file").distinct()


def judged_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Judged items of folder/<judge>/<file>: with judge (the file's own, else its folder), and the source's stem."""
    rows = record_files(spark, folder, pattern)
    directory = F.element_at(F.split("file", "/"), -2)
    return rows.withColumns({"judge": F.coalesce(F.col("judge_model"), directory), "source_file": text.source_stem(F.col("file"))})


ANNOTATION = "struct<audit_id:string,annotator_id:string,correct:string>"


def annotations_json(spark: SparkSession, path: str) -> DataFrame:
    """(audit_id, annotator_id, correct, ord): ord is the place by row and within it. A list, or an object with the rows under one of four names. The annotator defaults to the file's stem."""
    schema = f"audit_id string, annotator_id string, correct string, annotations array<{ANNOTATION}>, items array<{ANNOTATION}>, data array<{ANNOTATION}>, predictions array<{ANNOTATION}>, _bad string"
    rows = _json(spark, path, schema).where("_bad is null").select("*", F.col("_metadata.file_name").alias("_file"))
    own = F.array(F.struct("audit_id", "annotator_id", "correct"))
    rows = rows.select("_file", F.monotonically_increasing_id().alias("_row"), F.posexplode(F.coalesce("annotations", "items", "data", "predictions", own)).alias("_at", "a"))
    return _annotation_rows(rows.select("_file", "a.*", F.struct("_row", "_at").alias("ord")))


def annotations_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    for c in ("annotator_id", "correct"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return _annotation_rows(rows.select(F.col("_metadata.file_name").alias("_file"), "audit_id", "annotator_id", "correct", F.struct(F.monotonically_increasing_id().alias("_row"), F.lit(0).alias("_at")).alias("ord")))


def _annotation_rows(rows: DataFrame) -> DataFrame:
    stem = F.regexp_replace("_file", r"\.[^.]*$", "")
    return rows.select(F.trim("audit_id").alias("audit_id"), F.coalesce(text.first_filled(F.trim("annotator_id")), stem).alias("annotator_id"), F.coalesce("correct", F.lit("")).alias("correct"), "ord").where("coalesce(audit_id, '') <> ''")


def file_digests(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, sha256, bytes) of each file, of whatever size."""
    return arrays.digests(arrays.listed(spark, path, pattern)).select(F.col("file").alias("path"), "sha256", "bytes")


_ROWS = ("predictions", "detailed_results")
_OPEN = "metadata variant, detailed_results array<variant>, predictions array<variant>, _bad string"


def run_envelopes(spark: SparkSession, path: str | list[str], pattern: str = "*.json") -> DataFrame:
    """(file, metadata): every key of each run file's `metadata` object or, where it has none, of its top level but for the rows, as MAP<STRING, VARIANT>.

    Bare lists have no metadata (an empty map); summaries and unreadable files are left out.
    A file is one VARIANT here, of the size that Spark allows for it.
    """
    reader = spark.read.option("singleVariantColumn", "whole").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    rows = reader.json(path).select("whole", F.col("_metadata.file_path").alias("file")).where(~F.substring_index("file", "/", -1).startswith("summary"))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    keys = lambda v: F.when(is_object(v), v.cast("map<string,variant>"))
    own = F.try_variant_get("whole", "$.metadata", "variant")
    top = F.map_filter(keys(F.col("whole")), lambda k, v: ~k.isin(*_ROWS))
    readable = is_object(F.col("whole")) | F.schema_of_variant("whole").startswith("ARRAY")
    return rows.where(readable).select("file", F.coalesce(keys(own), top, F.create_map().cast("map<string,variant>")).alias("metadata"))


def run_items(spark: SparkSession, path: str | list[str], pattern: str = "*.json") -> DataFrame:
    """(file, ordinal, item): each row of prediction or judged files, with all its keys, as VARIANT. What is no object is left out; ordinal is its place in the file.

    Every item of an object's rows is a VARIANT of its own; a bare list is one, of the size that Spark allows for it.
    """
    outside = lambda df: df.where("_bad is null").where(~F.substring_index("file", "/", -1).startswith("summary"))
    rows = outside(_json(spark, path, _OPEN, pattern).select("*", F.col("_metadata.file_path").alias("file")))
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    listed = rows.select("file", F.posexplode(F.coalesce(filled("detailed_results"), filled("predictions"))).alias("ordinal", "item"))
    whole = spark.read.option("singleVariantColumn", "whole").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    bare = whole.select("whole", F.col("_metadata.file_path").alias("file")).where(~F.substring_index("file", "/", -1).startswith("summary"))
    bare = bare.where(F.schema_of_variant("whole").startswith("ARRAY")).select("file", F.posexplode(F.col("whole").cast("array<variant>")).alias("ordinal", "item"))
    return listed.unionByName(bare).where(F.schema_of_variant("item").startswith("OBJECT")).select("file", F.col("ordinal").cast("long").alias("ordinal"), "item")
