import numpy as np
import pandas as pd

import corpus_pipeline
from assayer.llm import decontamination, quality
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_suffixes import brute as cuts

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def step(name, docs):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = step("quality classifier", docs)
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(spark, SF, docs), ["doc_id"]).collect()}
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(d for d, s in scores.items() if s >= 0.5)

    two = step("n-gram Jaccard join", one)
    found = groups([(r.doc_id, r.text) for r in one.collect()], 5, 80)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted({c for _, n, c in found})

    three = step("suffix-array dedup", two)
    want = cuts([(r.doc_id, r.text) for r in two.collect()], 50)
    assert three.columns == columns and sorted((str(r.doc_id), r.text, r.n_chars) for r in three.collect()) == sorted((w[0], w[5], len(w[5])) for w in want)

    four = step("benchmark decontamination", three)
    items = [decontamination.shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [r.doc_id for r in three.collect() if not any(100 * len(s & decontamination.shingles(r.text)) >= 80 * len(s) for s in items)]
    assert four.columns == columns and sorted(r.doc_id for r in four.collect()) == sorted(kept)

    five = step("best-fit packing", four).toPandas()
    assert sorted(five["doc_id"].unique()) == sorted(kept)
    whole = corpus_pipeline.run(spark, SF).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pd.testing.assert_frame_equal(five[cols].sort_values(cols, ignore_index=True), whole[cols].sort_values(cols, ignore_index=True))
    ends = five.groupby("sequence_id")["length"].sum()
    assert ends.max() <= 2048 and np.ceil(five["length"].sum() / 2048) <= len(ends)


def tables(spark, folder, docs, labels=((0, 1, 0), (1, 1, 0), (5, 1, 0), (6, 1, 0), (7, 1, 0), (99, 0, 0), (98, 0, 0))):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(400_000))  # 3 MB: more than one chunk
    rows = [(0, "good words stand here in a row of their own", "en", "s", 9, "k0"), (0, "good words stand here in a row of their own", "en", "s", 9, "k0"), (1, None, None, None, None, "k1"), (None, None, "en", "s", 0, "k2")]
    rows += [(None, "a text without an id but with words in it", "de", None, 3, None), (5, "", "en", "s", 0, "k5"), (6, long, "en", "s", len(long), "k6"), (7, "one two three four five six", "en", "s", 7, "k7")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, {} string"
    rows += [(i, "### $$$ 00 11 22 ###" * (i - 90), "en", "s", 9, f"k{i}") for i in (98, 99)]
    folder = tables(spark, str(tmp_path / "mark"), spark.createDataFrame(rows, schema.format("mark")))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "best-fit packing":
            assert out.columns == docs.columns, name
            docs = corpus_pipeline.staged(out, "kept")
    texts = {(r.doc_id, r.mark): r.text for r in docs.collect()}
    assert (7, "k7") not in texts and (99, "k99") not in texts and (98, "k98") not in texts and texts[(6, "k6")] == long and texts[(1, "k1")] is None and texts[(5, "k5")] == ""
    assert sorted(k for _, k in texts if k) == ["k0", "k1", "k2", "k5", "k6"] and texts[(None, None)] == rows[4][1]
    assert sum(r.length for r in out.collect() if r.doc_id == 6) > 400_000
    few = [r for r in rows if r[0] != 6]
    for extra in ("places", "node", "_keep_id", "score", "_text", "copy", "rest"):
        docs = spark.createDataFrame(few, schema.format(extra))
        folder = tables(spark, str(tmp_path / extra), docs)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns, name


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, tables(spark, str(tmp_path), docs)).count() == 0
