"""Human annotations: consolidation for each item, matches with the judges, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text

# Annotators whose label is final.
FINAL_ANNOTATORS = ("adjudicated", "adjudicator", "consensus", "final")
# What stands for a label that isn't there yet.
PENDING = ("unannotated", "single_annotation", "pending_second_annotation", "no_consensus", "pending_adjudication")


def consolidated(annotations: DataFrame) -> DataFrame:
    """One row for each audit_id of (audit_id, annotator_id, correct, ord): status, consensus, final label, labels and their counts. Last labels win."""
    rows = annotations.where(F.coalesce(F.trim("audit_id"), F.lit("")) != "").withColumn("label", text.annotated(F.col("correct")))
    final = F.lower(F.trim(F.coalesce("annotator_id", F.lit("")))).isin(*FINAL_ANNOTATORS)
    labelled = F.col("label").isin("yes", "no")
    own = labelled & ~final
    entry = F.struct("ord", F.coalesce("annotator_id", F.lit("")).alias("annotator_id"), "label")
    grouped = rows.groupBy("audit_id").agg(
        F.count_if(own).alias("n_human_labels"),
        F.count_if(own & (F.col("label") == "yes")).alias("n_human_yes"),
        F.count_if(own & (F.col("label") == "no")).alias("n_human_no"),
        F.max_by(F.when(final & labelled, F.col("label")), F.when(final & labelled, F.col("ord"))).alias("_final"),
        F.array_sort(F.collect_list(F.when(own, entry))).alias("_own"),
    )
    n, y, k = F.col("n_human_labels"), F.col("n_human_yes"), F.col("n_human_no")
    status = F.when(n == 0, "unannotated").when(n == 1, "single_annotation").when((y == 0) | (k == 0), "agreement").otherwise("disagreement")
    consensus = F.when(status == "agreement", F.when(y > 0, "yes").otherwise("no")).when(status == "disagreement", "no_consensus").otherwise(status)
    waiting = F.when(status == "agreement", consensus).when(status == "disagreement", "pending_adjudication").when(status == "single_annotation", "pending_second_annotation").otherwise("unannotated")
    return grouped.select(
        "audit_id",
        status.alias("human_status"),
        F.when((status == "disagreement") & F.col("_final").isNull(), "yes").otherwise("no").alias("needs_adjudication"),
        consensus.alias("human_consensus_correct"),
        F.coalesce("_final", waiting).alias("human_final_correct"),
        "n_human_labels",
        "n_human_yes",
        "n_human_no",
        F.col("_own.label").alias("human_labels"),
        F.col("_own.annotator_id").alias("annotator_ids"),
        F.aggregate("_own", F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k2, v: k2 != x["annotator_id"]), F.create_map(x["annotator_id"], x["label"]))).alias("labels_by_annotator"),
    )


def label_match(human: Column, judge: Column) -> Column:
    """yes or no where both have a label; the human's state where it isn't one; else ''."""
    both = human.isin("yes", "no") & judge.isin("yes", "no")
    return F.when(human.isin(*PENDING), human).when(F.coalesce(both, F.lit(False)), F.when(human == judge, "yes").otherwise("no")).otherwise("")


def merged(key: DataFrame, human: DataFrame, judges: Sequence[str], annotators: Sequence[str] = ("annotator_1", "annotator_2")) -> DataFrame:
    """The audit key with its human labels and their matches with each judge. key has a column of verdicts for each judge."""
    out = key.join(human, "audit_id", "left")
    out = out.withColumns(
        {
            "human_status": F.coalesce("human_status", F.lit("unannotated")),
            "needs_adjudication": F.coalesce("needs_adjudication", F.lit("no")),
            "human_consensus_correct": F.coalesce("human_consensus_correct", F.lit("unannotated")),
            "human_final_correct": F.coalesce("human_final_correct", F.lit("unannotated")),
            **{c: F.coalesce(c, F.lit(0)) for c in ("n_human_labels", "n_human_yes", "n_human_no")},
            **{f"{a}_correct": F.coalesce(F.col("labels_by_annotator")[a], F.lit("")) for a in annotators},
        }
    )
    clean = {j: text.annotated(F.col(j)) for j in judges}
    new = {}
    for j, own in clean.items():
        matches = F.when(own == "yes", F.col("n_human_yes")).when(own == "no", F.col("n_human_no")).otherwise(0)
        new |= {f"human_matches_{j}": label_match(F.col("human_final_correct"), own), f"n_human_matches_{j}": matches, f"human_match_rate_{j}": F.try_divide(matches, F.col("n_human_labels"))}
        new |= {f"{a}_matches_{j}": label_match(F.col(f"{a}_correct"), own) for a in annotators}
    if len(judges) > 1:
        new["llm_judges_agree"] = label_match(clean[judges[0]], clean[judges[1]])
    return out.withColumns(new)


def merge_summary(rows: DataFrame, judges: Sequence[str], annotators: Sequence[str] = ("annotator_1", "annotator_2")) -> DataFrame:
    """(measure, n, matches, agreement_rate): agreement of judges with final labels and with single labels, of the judges, and of the two annotators."""
    structs = []

    def add(name: str, n: Column, matches: Column) -> None:
        structs.append(F.struct(F.lit(name).alias("measure"), n.cast("long").alias("n"), matches.cast("long").alias("matches")))

    for j in judges:
        add(f"final_vs_{j}", F.count_if(F.col(f"human_matches_{j}").isin("yes", "no")), F.count_if(F.col(f"human_matches_{j}") == "yes"))
        add(f"labels_vs_{j}", F.sum("n_human_labels"), F.sum(f"n_human_matches_{j}"))
    if len(judges) > 1:
        add("judges", F.count_if(F.col("llm_judges_agree").isin("yes", "no")), F.count_if(F.col("llm_judges_agree") == "yes"))
    a, b = (F.col(f"{x}_correct") for x in annotators[:2])
    add("annotators", F.count_if(a.isin("yes", "no") & b.isin("yes", "no")), F.count_if(a.isin("yes", "no") & (a == b)))
    return rows.agg(F.array(*structs).alias("s")).select(F.inline("s")).withColumn("agreement_rate", F.try_divide("matches", "n"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("human_status").agg(F.count("*").alias("n_items"), F.count_if(F.col("needs_adjudication") == "yes").alias("n_needs_adjudication"))
