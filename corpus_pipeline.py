"""The corpus pipeline: from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of documents.

Defined results, for every stage: a null text is the empty text; a null doc_id
is an id of its own, after all others, and so are rows of other columns' nulls
kept as they are. Repeated rows are documents each, but where near duplicates
are dropped: rows alike in doc_id and text are one there. Columns besides
doc_id and text, whatever their names, come out as they went in (n_chars, where
there is one, follows the text). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import decontamination, jaccard, packing, quality, suffixes
from assayer.llm.common import released, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled rows of docs, does not reject.

    Empty texts score what the intercept says. Without labels nothing is rejected.
    """
    return quality.accepted(docs, quality.train(spark, sf_dir, docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles: that of the smallest doc_id.

    Documents without words are in no group and all stay.
    """
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document with a smaller id has.

    What is left of a cut character goes too; a text may come out empty, a null text stays null.
    """
    return suffixes.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item: under 80 % of the five-word shingles of each. Blank texts contain none."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; an empty text is one token."""
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: A trained classifier, minimum hashes and a tokenizer: not for SQL. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        released(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
