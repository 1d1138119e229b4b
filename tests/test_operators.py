import hashlib
import itertools
import random
import re
import statistics
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.operators import agreement, annotations, audit, dataset, efficiency, judging, runs, scoring, significance
from assayer.operators.rank import quantiles, ranked
from assayer.sources import sinks


def test_rank_is_a_window(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("s"))
    out = ranked(df, "id", 7, "x", ["s"], "r", "n").toPandas()
    import hashlib

    for s, own in out.groupby("s"):
        order = sorted(own["id"], key=lambda i: (hashlib.sha256(f"7|x|{i}".encode()).hexdigest(), i))
        assert own.sort_values("r")["id"].tolist() == order and set(own["n"]) == {1500}


def test_split_counts_and_folds(spark):
    df = spark.createDataFrame([(i, "multi" if i < 10 else "single") for i in range(20)], "id long, stratum string")
    out = dataset.split(df, "id", "stratum", 0.7, 0.1, 0.2, 1)
    assert {(r.stratum, r.split): r["count"] for r in out.groupBy("stratum", "split").count().collect()} == {(s, p): n for s in ("multi", "single") for p, n in (("train", 7), ("validation", 1), ("test", 2))}
    with pytest.raises(ValueError):
        dataset.split(df, "id", None, 0.7, 0.1, 0.1, 1)
    tests = [{r.id for r in dataset.fold_split(df, "id", "stratum", 5, f, 0.1, 1).where("split = 'test'").collect()} for f in range(5)]
    assert set().union(*tests) == set(range(20)) and sum(map(len, tests)) == 20
    assert dataset.covering_sample(df, "id", "stratum", 2, 1).select("stratum").distinct().count() == 2


def test_invalid_items(spark):
    df = spark.createDataFrame([("a", "x", ["y"]), ("b", " ", ["y"]), ("c", "x", [" "])], "id string, input string, outputs array<string>")
    out = dataset.normalized_items(df)
    assert {r.id: r.problem for r in out.collect()} == {"a": None, "b": "input is blank", "c": "no outputs"}
    with pytest.raises(ValueError):
        dataset.require_valid(out)
    assert dataset.require_valid(out.where("id = 'a'")).count() == 1


def test_alignment_needs_partners(spark):
    a, b = spark.createDataFrame([(1, "p"), (2, "q")], "i int, p string"), spark.createDataFrame([(1, "r")], "i int, r string")
    with pytest.raises(ValueError):
        scoring.aligned_pairs(a, b, ["i"])
    assert scoring.aligned_pairs(a.where("i = 1"), b, ["i"]).count() == 1


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([("m", "unmatched", "no")], "m string, decision_method string, correct string")
    r = judging.metrics(df, ["m"]).first()
    assert (r.evaluated, r.accuracy, r.llm_approval_rate) == (0, 0.0, 0.0)


@pytest.mark.parametrize("seed", range(3))
def test_kappas_against_counting(spark, seed):
    r = random.Random(seed)
    rows = [("s", str(i), j, r.choice(["yes", "no", "no"]), "llm", i * 5 + k) for i in range(60) for k, j in enumerate("abcd") if r.random() < 0.8]
    ratings = agreement.aligned(spark.createDataFrame(rows, "source_file string, item_key string, judge string, verdict string, decision_method string, ord long"))
    by = {}
    for _, i, j, v, _, _ in rows:
        by.setdefault(i, {})[j] = v
    for p in agreement.pairwise(ratings).collect():
        both = [(x[p.judge_1], x[p.judge_2]) for x in by.values() if p.judge_1 in x and p.judge_2 in x]
        po = sum(a == b for a, b in both) / len(both)
        ya, yb = (sum(x[k] == "yes" for x in both) / len(both) for k in (0, 1))
        pe = ya * yb + (1 - ya) * (1 - yb)
        assert p.n_items == len(both) and abs(p.kappa - (po - pe) / (1 - pe)) < 1e-9
    rated = agreement.items(ratings)
    several = [list(x.values()) for x in by.values() if len(x) >= 2]
    pairs = [(a, b) for x in several for n, a in enumerate(x) for b in x[n + 1 :]]
    labels = [v for x in several for v in x]
    y = labels.count("yes")
    n = len(labels)
    expected = 1 - (y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1))
    assert abs(agreement.krippendorff(rated, 4).first().alpha - (1 - sum(a != b for a, b in pairs) / len(pairs) / expected)) < 1e-9
    f = agreement.fleiss(rated, 4).first()
    assert f.n_items == sum(len(x) == 4 for x in by.values())


def test_fleiss_of_opposite_unanimities(spark):
    rows = [("s", i, j, v) for i, v in (("1", "yes"), ("2", "no")) for j in "ab"]
    rated = agreement.items(spark.createDataFrame(rows, "source_file string, item_key string, judge string, verdict string"))
    assert agreement.fleiss(rated, 2).first().kappa == 1.0


def test_required_judges(spark):
    ratings = spark.createDataFrame([("s", "1", "a", "yes"), ("s", "1", "b", "no")], "source_file string, item_key string, judge string, verdict string")
    assert agreement.require_judges(ratings, ["a", "b"]).count() == 2
    for wanted in (["a", "z"], ["a"]):
        with pytest.raises(ValueError):
            agreement.require_judges(ratings, wanted)


def test_human_rows_are_appended(spark):
    items = spark.createDataFrame([("q", "g", "p", "TRUE"), ("q2", "g", None, "0")], "nl string, expected string, generated string, correct string")
    human = agreement.human_rows(items, F.lit("src"), ["input", "nl"], ["gold", "expected"], ["prediction", "generated"])
    assert [(r.input, r.prediction, r.verdict, r.judge) for r in human.orderBy("input").collect()] == [("q", "p", "yes", "human"), ("q2", "", "no", "human")]
    assert agreement.merged(human, human.drop("gold")).count() == 4


def test_seed_stats(spark):
    df = spark.createDataFrame([("m", 0.5), ("m", 0.7), ("m", 0.9), ("k", 0.4), ("k", None)], "g string, accuracy double")
    out = {r.g: r for r in runs.seed_stats(df, ["g"], ["accuracy"]).collect()}
    std = statistics.pstdev([0.5, 0.7, 0.9])
    assert abs(out["m"].std - std) < 1e-12 and abs(out["m"].ci95 - 1.96 * std / 3**0.5) < 1e-12 and out["m"].n == 3
    assert (out["k"].mean, out["k"].std, out["k"].ci95, out["k"].n) == (0.4, 0.0, 0.0, 1)


def test_agreement_joins_by_stem(spark):
    a = spark.createDataFrame([("d/run__judge-x.json", 1)], "source_file string, n int")
    b = spark.createDataFrame([("run", 0.5)], "source_file string, mean_kappa double")
    assert runs.with_agreement(a, b).first().mean_kappa == 0.5


def test_efficiency_examples(spark):
    df = spark.createDataFrame([("a", 0.8, 1000.0, 3600000.0, 2), ("b", 0.6, 500.0, 0.0, 2), ("c", None, None, None, 0)], "model_short string, accuracy double, latency_mean_ms double, latency_total_ms double, n_examples long")
    out = {r.model_short: r for r in efficiency.scored(efficiency.derived(df), 0.5, 0.5).collect()}
    assert out["a"].duration_seconds == 3600 and abs(out["a"].throughput_samples_per_sec - 0.000556) < 1e-6 and out["b"].throughput_samples_per_sec is None
    assert out["a"].efficiency_score == 0.5 and out["c"].efficiency_score is None
    run = spark.createDataFrame([("r", None, None, 3600.0, 0, 2, None)], "run_id string, exact_match double, latency_mean_ms double, duration_seconds double, n_examples long, total_samples long, latency_total_ms double")
    rows = spark.createDataFrame([("r", 1, 5.0), ("r", 0, 7.0)], "run_id string, exact_match int, latency_ms double")
    e = efficiency.run_entry(run, rows).first()
    assert (e.latency_mean_ms, e.accuracy) == (1800000.0, 0.5)
    s = spark.createDataFrame([("r", 0.9)], "run_id string, accuracy double")
    j = efficiency.with_judge_accuracy(run, s, "run_id").first()
    assert (j.accuracy, j.accuracy_source) == (0.9, "judge_summary")


@pytest.mark.parametrize("seed", range(4))
def test_pareto_against_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *range(8)]), r.choice([None, -1.0, 0.0, *[x / 4 for x in range(12)]])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a int, l double")
    known = [x for x in rows if x[1] is not None and x[2] is not None]
    want = {x[0] for x in known if not any(y[1] >= x[1] and y[2] <= x[2] and (y[1] > x[1] or y[2] < x[2]) for y in known)}
    assert {x.i for x in efficiency.pareto(df, "a", "l").collect()} == want


def apportion(sizes, quota):
    total = sum(sizes.values())
    quota = min(quota, total)
    raw = {g: quota * n / total for g, n in sizes.items()}
    out = {g: min(sizes[g], int(raw[g])) for g in sizes}
    left = quota - sum(out.values())
    while left:
        best = max((g for g in sizes if out[g] < sizes[g]), key=lambda g: (raw[g] - int(raw[g]), sizes[g] - out[g], g))
        out[best] += 1
        left -= 1
    return out


def test_apportionment_against_python(spark):
    r = random.Random(6)
    cases, rows = {}, []
    for c in range(150):
        sizes = {f"g{i}": r.randrange(1, 30) for i in range(r.randrange(1, 7))}
        quota = r.randrange(0, sum(sizes.values()) + 1)
        cases[c] = apportion(sizes, quota)
        rows += [(c, g, n, quota) for g, n in sizes.items()]
    out = audit.apportioned(spark.createDataFrame(rows, "c int, g string, n long, quota long"), ["c"], "g").collect()
    got = {}
    for x in out:
        got.setdefault(x.c, {})[x.g] = x.allocation
    assert got == cases


def test_quotas_refill(spark):
    have = spark.createDataFrame([("a", 10), ("b", 100), ("c", 5)], "stratum string, n long")
    got = {r.stratum: r.quota for r in audit.resolved_quotas(have, {"a": 33, "b": 20}, ["c", "b"]).collect()}
    assert got == {"a": 10, "b": 38, "c": 5}


def test_audit_sample(spark):
    r = random.Random(9)
    rows = [(f"k{i}", f"u{i // 2 if i % 5 == 0 else i}", r.choice(["x", "y", "z"]), r.choice(["s", "t"])) for i in range(300)]
    df = spark.createDataFrame(rows, "population_key string, annotation_unit_key string, primary_stratum string, source_stratum string")
    sample = audit.audit_sample(df, {"x": 40, "y": 500}, ["z", "x"], 3)
    out = sample.collect()
    assert len({x.annotation_unit_key for x in out}) == len(out)
    n = df.groupBy("primary_stratum").count().rdd.collectAsMap() if False else {x.primary_stratum: x["count"] for x in df.groupBy("primary_stratum").count().collect()}
    units = len({u for _, u, _, _ in rows})
    assert len(out) == min(540, units) and n["y"] > 0
    ids = audit.with_audit_ids(sample, 3, "H").orderBy("presentation_order").collect()
    assert [x.audit_id for x in ids[:2]] == ["H-0001", "H-0002"] and len(ids) == len(out)
    w = {x.primary_stratum: x for x in audit.stratum_weights(df, sample).collect()}
    assert all(abs(x.sampling_weight - x.population / x.sampled) < 1e-9 for x in w.values() if x.sampled)


def test_annotation_states(spark):
    rows = [("1", "annotator_1", "yes", 1), ("1", "annotator_2", "NO", 2), ("2", "annotator_1", "y", 1), ("2", "annotator_2", "true", 2), ("3", "annotator_1", "no", 1), ("4", "annotator_1", "", 1), ("5", "annotator_1", "yes", 1), ("5", "annotator_2", "no", 2), ("5", "Final", "no", 3), ("5", "final", "yes", 4), ("6", "annotator_1", "no", 1), ("6", "annotator_1", "yes", 2), (" ", "x", "yes", 1)]
    h = annotations.consolidated(spark.createDataFrame(rows, "audit_id string, annotator_id string, correct string, ord long"))
    out = {r.audit_id: (r.human_status, r.needs_adjudication, r.human_consensus_correct, r.human_final_correct, r.n_human_labels) for r in h.collect()}
    assert out == {
        "1": ("disagreement", "yes", "no_consensus", "pending_adjudication", 2),
        "2": ("agreement", "no", "yes", "yes", 2),
        "3": ("single_annotation", "no", "single_annotation", "pending_second_annotation", 1),
        "4": ("unannotated", "no", "unannotated", "unannotated", 0),
        "5": ("disagreement", "no", "no_consensus", "yes", 2),
        "6": ("disagreement", "yes", "no_consensus", "pending_adjudication", 2),
    }
    key = spark.createDataFrame([("1", "yes"), ("7", "no")], "audit_id string, j string")
    m = {r.audit_id: r for r in annotations.merged(key, h, ["j"]).collect()}
    assert m["1"].human_match_rate_j == 0.5 and m["1"].annotator_2_matches_j == "no" and m["7"].human_final_correct == "unannotated"
    assert {r.audit_id: dict(r.labels_by_annotator) for r in h.where("audit_id = '6'").collect()} == {"6": {"annotator_1": "yes"}}


def test_judge_sees_each_request_once(spark):
    rows = [(i, "same" if i % 2 else f"p{i}", "m" if i < 6 else "n", "v") for i in range(10)]
    df = spark.createDataFrame(rows, "ord long, judge_prompt string, judge_model string, prompt_version string")
    out = judging.judge(df, lambda p: pd.DataFrame({"response": ["Correct: yes"] * len(p), "refused": p == "p0"})).collect()
    assert {r.ord for r in out if r.from_cache} == {3, 5, 9}
    assert {(r.ord, r.correct, r.decision_method) for r in out if r.ord < 2} == {(0, "no", "content_filtered"), (1, "yes", "llm")}


def test_reuse_skips_finished_work(spark):
    rows = spark.createDataFrame([("j", "a", "1"), ("j", "b", "1"), ("j", "a", "2")], "judge_model string, source_file string, prompt_version string")
    done = rows.where("source_file = 'a' and prompt_version = '1'")
    assert judging.not_yet_judged(rows, done).count() == 2


def test_the_store_is_not_shuffled(spark, tmp_path):
    rows = spark.createDataFrame([("j", "1", f"s{i % 9}", f"d{i % 9}", i) for i in range(90)], "judge_model string, prompt_version string, source_file string, source_sha256 string, x int")
    sinks.store_judged(rows.where("x % 9 < 5"), "judged_store_test", str(tmp_path / "store"), 8)
    sinks.store_judged(rows.where("x % 9 = 5"), "judged_store_test", str(tmp_path / "store"), 8)
    again = rows.withColumn("source_sha256", F.when(F.col("source_file") == "s0", "new").otherwise(F.col("source_sha256")))
    stored, open_ = judging.split_by_store(again, spark.table("judged_store_test"))
    assert sorted(r.x % 9 for r in stored.collect()) == sorted([1, 2, 3, 4, 5] * 10)
    assert {r.source_file for r in open_.collect()} == {"s0", "s6", "s7", "s8"} and open_.count() == 40
    for out in (stored, open_):
        lines = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
        at = next(i for i, line in enumerate(lines) if "FileScan" in line)
        depth, above = len(lines[at]), []
        for line in reversed(lines[: at + 1]):  # the scan and what it goes through, up to the join
            own = re.search(r"[A-Za-z(*]", line).start()
            if own < depth:
                depth = own
                above.append(line)
            if "SortMergeJoin" in line:
                break
        assert "Bucketed: true" in above[0] and "SortMergeJoin" in above[-1] and not any("Exchange" in x for x in above)


def test_resampling(spark):
    r = random.Random(5)
    rows = [("a", "x", str(i), "yes" if r.random() < 0.7 else "no") for i in range(400)] + [("b", "x", str(i), "yes" if r.random() < 0.6 else "no") for i in range(400)] + [("c", "x", str(i), "yes") for i in range(0)]
    scores = significance.item_scores(spark.createDataFrame(rows, "model_short string, condition string, unit_key string, correct string"))
    others = spark.createDataFrame([("b", "x")], "model_short string, condition string")
    diffs = significance.paired_differences(scores, ("a", "x"), others)
    out = significance.drawn_tests(diffs, 1500, 1).first()
    mine = {u: c for m, _, u, c in rows if m == "a"}
    d = [(mine[u] == "yes") - (c == "yes") for m, _, u, c in rows if m == "b"]
    mean, sem = statistics.mean(d), statistics.pstdev(d) / 20
    assert out.n_paired_items == 400 and abs(out.accuracy_difference - mean) < 1e-9
    assert abs(out.ci95_low - (mean - 1.96 * sem)) < 0.02 and abs(out.ci95_high - (mean + 1.96 * sem)) < 0.02
    z = abs(mean) / (sum(x * x for x in d) ** 0.5 / 400)
    p = 2 * (1 - statistics.NormalDist().cdf(z))
    assert abs(out.randomization_p_value - p) < 0.05
    assert significance.drawn_tests(diffs, 1500, 1).first() == out
    exact = significance.paired_tests(diffs).first()
    assert abs(exact.randomization_p_value - out.randomization_p_value) < 4 * (exact.randomization_p_value / 1500) ** 0.5 + 1 / 1500
    assert abs(exact.ci95_low - out.ci95_low) < 0.01 and abs(exact.ci95_high - out.ci95_high) < 0.01


def test_exact_resampling_against_every_outcome(spark):
    """Small sets: all bootstrap samples and all sign flips, one after another."""
    r = random.Random(6)
    cases = [[r.choice([-1, -0.5, -1 / 3, 0, 0.25, 0.5, 1]) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6) for _ in range(4)] + [[0.0, 0.0], [0.5] * 5, [0.5, -0.5]]
    rows = [(str(i), "x", float(d), 1) for i, own in enumerate(cases) for d in own]
    diffs = spark.createDataFrame(rows, "model_short string, condition string, diff double, n long").groupBy("model_short", "condition", "diff").agg(F.sum("n").alias("n"))
    got = {int(x.model_short): x for x in significance.paired_tests(diffs).collect()}
    for i, own in enumerate(cases):
        steps, n = [round(12 * d) for d in own], len(own)
        sums = Counter(sum(c) for c in itertools.product(steps, repeat=n))
        upto = list(itertools.accumulate(sums[k] for k in sorted(sums)))
        low, high = (next(k for k, c in zip(sorted(sums), upto) if c >= q * n**n - 1e-6) for q in (0.025, 0.975))
        flips = [abs(sum(s * a for s, a in zip(signs, steps))) for signs in itertools.product((1, -1), repeat=n)]
        p = sum(f >= abs(sum(steps)) for f in flips) / len(flips)
        x = got[i]
        assert (x.n_paired_items, round(x.ci95_low * n * 12), round(x.ci95_high * n * 12)) == (n, low, high), own
        assert abs(x.randomization_p_value - p) < 1e-9 and abs(x.accuracy_difference - sum(own) / n) < 1e-9 and x.off_grid < 1e-12


def test_exact_resampling_of_very_many_items(spark):
    """A hundred million items take as long as a thousand deviations; a difference far from 0 has p-value 0."""
    n = 10**8
    rows = [("near", "x", 1.0, n // 2 + 9_000), ("near", "x", -1.0, n // 2 - 9_000), ("far", "x", 0.5, n), ("far", "x", -0.5, n // 2)]
    diffs = spark.createDataFrame(rows, "model_short string, condition string, diff double, n long")
    out = {x.model_short: x for x in significance.paired_tests(diffs, 0.5).collect()}
    z = 18_000 / n**0.5
    assert abs(out["near"].randomization_p_value - 2 * (1 - statistics.NormalDist().cdf(z))) < 1e-4
    assert abs(out["near"].ci95_low - (18_000 / n - 1.96 / n**0.5)) < 1e-6 and out["far"].randomization_p_value == 0


def test_quantiles_with_outliers(spark):
    r = random.Random(8)
    groups = {"a": [r.gauss(0, 1) for _ in range(3_000)] + [1e12, -1e300, 1e300], "b": [5.0] * 400 + [7.0], "c": [2.0], None: [r.choice([1.0, 2.0, 3.5]) for _ in range(50)], "none": [None, None]}
    rows = [(g, v) for g, own in groups.items() for v in own]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = {"low": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "high": 1.0}
    got = {x.g: x for x in quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, x in got.items():
        own = sorted(groups[g])
        for name, p in shares.items():
            at = (len(own) - 1) * p
            a, b = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
            want = a if at == int(at) else a * (1 - (at - int(at))) + b * (at - int(at))
            assert x[name] == pytest.approx(want, rel=1e-12), (g, name)
    everything = quantiles(df.where("g = 'b'"), [], "v", {"p": 0.5}).collect()
    assert [x.p for x in everything] == [5.0] and quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_no_part_of_the_quantiles_is_large(spark, monkeypatch):
    """One outlier doesn't bring all other values into one range."""
    from assayer.operators import rank

    df = spark.range(200_000).select((F.col("id") * 0.001).alias("v")).unionByName(spark.createDataFrame([(1e12,)], "v double"))
    kept = []
    monkeypatch.setattr(rank, "staged", lambda d, name: kept.append(d) or d)
    out = quantiles(df, [], "v", {"p": 0.5})
    assert out.first().p == pytest.approx(100.0)
    (cuts,) = kept[0].agg(F.percentile_approx("_v", [i / 64 for i in range(1, 64)], 1280)).first()
    sizes = kept[0].groupBy(F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("_v")))).count().agg(F.max("count")).first()[0]
    assert sizes < 4 * 200_001 / 64


def test_success_is_an_output(spark):
    rows = [("m", "text", None, 5.0, 1), ("m", "text", "late error", 7.0, 2), ("m", "", "content_filter", None, 3), ("m", None, "", 1.0, 4)]
    df = spark.createDataFrame(rows, "m string, generated string, generation_error string, latency_ms double, id long")
    out = runs.run_stats(df, ["m"]).first()
    assert (out.total_samples, out.successful, out.failed, out.content_filtered, out.latency_p50_ms) == (4, 2, 2, 2, 5.0)
    assert sorted(x.id for x in runs.refused_ids(df, ["m"]).collect()) == [2, 3]


def test_pairs_from_one_file_are_compared_by_many_tasks_once(spark, monkeypatch):
    n, kept = 400, []
    monkeypatch.setattr(judging, "staged", lambda d, name: kept.append(d) or d.localCheckpoint())
    pairs = spark.range(n).coalesce(1).select(F.col("id").alias("ord"), F.lit("q").alias("input"), F.array(F.lit("p and q")).alias("golds"), F.when(F.col("id") % 2 == 0, "p && q").otherwise(F.concat(F.lit("r"), (F.col("id") % 7).cast("string"))).alias("prediction"))
    out = judging.evaluate(pairs, lambda p: pd.DataFrame({"response": ["Correct: yes"] * len(p), "refused": [False] * len(p)}), "{gold} {prediction}")
    assert Counter((x.decision_method, x.correct, x.from_cache) for x in out.collect()) == {("exact", "yes", False): 200, ("llm", "yes", False): 7, ("llm", "yes", True): 193}
    (stored,) = kept
    held = stored.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 4 and max(x["count"] for x in held) < 0.4 * n


def test_totals_name_every_entry_that_lacks_something(spark):
    rows = [(f"m{i:03}", "c", "j", None if i % 2 else 1.0, None) for i in range(250)] + [("a", "c", None, 0.5, 2.0)]
    out = efficiency.totals(spark.createDataFrame(rows, "model_short string, condition string, judge_model string, accuracy double, latency_mean_ms double")).first()
    assert (out.n_entries, out.n_models, out.n_missing_accuracy, out.n_missing_latency) == (251, 251, 125, 250)
    assert out.missing_accuracy.split(",") == [f"m{i:03}/c/j" for i in range(1, 250, 2)] and out.missing_latency.split(",") == [f"m{i:03}/c/j" for i in range(250)]


@pytest.mark.parametrize("seed", range(3))
def test_apportionment_by_levels(spark, seed):
    """Against units handed out one by one: largest fraction first, then most room left, then the last name."""
    r = random.Random(seed)
    rows, want = [], {}
    for s in range(60):
        sizes = [r.choice([1, 2, 3, 5, 10, 10, 40]) for _ in range(r.randrange(1, 8))]
        quota = r.randrange(0, sum(sizes) + 6)
        raw = [quota * n / sum(sizes) for n in sizes]
        base = [min(n, int(x)) for n, x in zip(sizes, raw)]
        left = min(quota, sum(sizes)) - sum(base)
        while left > 0:
            i = max((i for i in range(len(sizes)) if base[i] < sizes[i]), key=lambda i: (raw[i] - int(raw[i]), sizes[i] - base[i], f"g{i}"))
            base[i] += 1
            left -= 1
        rows += [(s, f"g{i}", n, quota) for i, n in enumerate(sizes)]
        want |= {(s, f"g{i}"): x for i, x in enumerate(base)}
    out = audit.apportioned(spark.createDataFrame(rows, "s long, g string, n long, quota long"), ["s"], "g")
    assert {(x.s, x.g): x.allocation for x in out.collect()} == want
    assert "Generate" not in out._jdf.queryExecution().toString()


def plain_audit(rows, requested, priority, seed):
    """The audit sample by sorting everything."""
    h = lambda space, k: hashlib.sha256(f"{seed}|{space}|{k}".encode()).hexdigest()
    place = {s: i for i, s in enumerate(dict.fromkeys([*requested, *priority]))}
    have = Counter(s for *_, s, _ in rows)
    names = list(place)
    cut = {s: min(requested.get(s, 0), have[s]) for s in names}
    short = sum(requested.values()) - sum(cut.values())
    for s in priority:
        more = min(short, have[s] - cut[s])
        cut[s] += more
        short -= more
    picked = []
    for s, quota in cut.items():
        sizes = Counter(x[3] for x in rows if x[2] == s)
        raw = {g: quota * n / have[s] for g, n in sizes.items()}
        got = {g: min(n, int(raw[g])) for g, n in sizes.items()}
        for _ in range(min(quota, have[s]) - sum(got.values())):
            g = max((g for g in sizes if got[g] < sizes[g]), key=lambda g: (raw[g] - int(raw[g]), sizes[g] - got[g], g))
            got[g] += 1
        for g, n in got.items():
            picked += sorted((x for x in rows if x[2] == s and x[3] == g), key=lambda x: (h(f"primary:{s}", x[0]), x[0]))[:n]
    taken = {}
    for x in sorted(picked, key=lambda x: (place.get(x[2], len(place)), h(f"primary:{x[2]}", x[0]), x[0])):
        taken.setdefault(x[1], x)

    def free(space):
        out = {}
        for x in sorted((x for x in rows if x[1] not in taken), key=lambda x: (place.get(x[2], len(place)), h(space, x[0]), x[0])):
            out.setdefault(x[1], x)
        return sorted(out.values(), key=lambda x: (h(space, x[0]), x[0]))

    gaps = {s: q - sum(x[2] == s for x in taken.values()) for s, q in cut.items()}
    for x in free("unique-fill"):
        if gaps.get(x[2], 0) > 0:
            gaps[x[2]] -= 1
            taken[x[1]] = x
    level = {s: i for i, s in enumerate(priority)}
    for x in sorted(free("global-unique-fill"), key=lambda x: level.get(x[2], 99))[: max(0, sum(cut.values()) - len(taken))]:
        taken[x[1]] = x
    return sorted(x[0] for x in taken.values())


@pytest.mark.parametrize("seed", range(3))
def test_audit_sample_is_what_sorting_everything_gives(spark, seed):
    r = random.Random(seed)
    rows = [(f"k{i}", f"u{r.randrange(500)}", r.choice(["x", "y", "z", "w"]), r.choice(["s", "t", "v"])) for i in range(1_500)]
    requested = {"x": r.randrange(90), "y": r.randrange(200), "q": 25}
    df = spark.createDataFrame(rows, "population_key string, annotation_unit_key string, primary_stratum string, source_stratum string")
    got = sorted(x.population_key for x in audit.audit_sample(df, requested, ["z", "x"], seed).collect())
    assert got == plain_audit(rows, requested, ["z", "x"], seed)


def test_over_length_gathers_first_keys_only(spark):
    rows = [("a", f"k{i * 7919 % 3000:04}", 61 + i % 5) for i in range(6000)] + [("a", None, 90), ("b", None, 70), (None, "x", 61), ("a", "k", 60)]
    out = dataset.over_length(spark.createDataFrame(rows, "model string, key string, tokens int"), F.col("model"), "key", 60)
    assert {r.kind: (r.n_over, r.longest, r.examples) for r in out.collect()} == {"a": (6001, 90, [f"k{i:04}" for i in range(20)]), "b": (1, 70, []), None: (1, 61, ["x"])}
    assert "collect_set" not in out._jdf.queryExecution().toString()
