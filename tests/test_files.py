import hashlib
import json
import random

from pyspark.sql import functions as F

from assayer.operators import annotations
from assayer.sources import arrays, readers, sinks


def save(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value) if not isinstance(value, str) else value)


def test_gold_dataset(spark, tmp_path):
    save(tmp_path / "d.json", [{"id": "1", "input": "x", "outputs": [{"formula": " a "}, {"formula": "a"}]}, {"input": " ", "outputs": [{"formula": "b"}]}, {"input": "y", "outputs": []}])
    out = readers.gold_dataset(spark, str(tmp_path / "d.json")).orderBy("ordinal").collect()
    assert [(r.id, r.outputs, r.problem) for r in out] == [("1", ["a"], None), (None, ["b"], "input is blank"), (None, [], "no outputs")]


def test_judged_files(spark, tmp_path):
    item = {"input": "i", "gold": "g", "prediction": "p", "correct": "yes", "decision_method": "llm"}
    save(tmp_path / "j1" / "run1__judge-j1.json", {"metadata": {"run_id": "r1", "seed": 42}, "model_short": "m", "detailed_results": [item, item | {"correct": "no"}]})
    save(tmp_path / "j2" / "run1.json", [item, item | {"generated": "z", "prediction": ""}])
    save(tmp_path / "j2" / "summary.json", {"detailed_results": [item]})
    save(tmp_path / "j2" / "broken.json", "{oops")
    out = readers.judged_files(spark, str(tmp_path)).collect()
    got = sorted((r.judge, r.source_file, r.ordinal if r.judge == "j1" else -1, r.run_id, r.seed, r.model_short, r.prediction, r.correct) for r in out)
    assert got == [("j1", "run1", 0, "r1", 42, "m", "p", "yes"), ("j1", "run1", 1, "r1", 42, "m", "p", "no"), ("j2", "run1", -1, None, None, None, "p", "yes"), ("j2", "run1", -1, None, None, None, "z", "yes")]


def test_unreadable_files_are_told(spark, tmp_path):
    save(tmp_path / "a" / "good.json", [{"input": "i"}])
    save(tmp_path / "a" / "broken.json", "{oops")
    assert [r.file.rsplit("/", 1)[-1] for r in readers.unreadable_files(spark, str(tmp_path)).collect()] == ["broken.json"]


def test_finding_files(spark, tmp_path):
    for name in ("a/x1.json", "b/x2.json", "b/y.json", "b/z.txt"):
        save(tmp_path / name, "[]")
    names = lambda w: sorted(r.name for r in readers.matching_files(spark, str(tmp_path), w).collect())
    assert names("all") == ["x1.json", "x2.json", "y.json"] and names("x*.json") == ["x1.json", "x2.json"] and names("y") == names("y.json") == ["y.json"] and names("b/x2.json") == ["x2.json"]


def test_annotations(spark, tmp_path):
    save(tmp_path / "ann_a.json", {"items": [{"audit_id": "1", "correct": "yes"}, {"audit_id": " ", "correct": "no"}]})
    save(tmp_path / "ann_b.json", [{"audit_id": "1", "annotator_id": "me", "correct": "no"}])
    save(tmp_path / "c.csv", "audit_id,correct,annotator_id\n2,true,\n,no,x\n")
    both = readers.annotations_json(spark, str(tmp_path / "ann_*.json")).unionByName(readers.annotations_csv(spark, str(tmp_path / "c.csv")))
    assert sorted((r.audit_id, r.annotator_id, r.correct) for r in both.collect()) == [("1", "ann_a", "yes"), ("1", "me", "no"), ("2", "c", "true")]
    assert {r.audit_id: r.human_status for r in annotations.consolidated(both).collect()} == {"1": "disagreement", "2": "single_annotation"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", 'q"']), ("b", None)], "k string, v array<string>")
    sinks.write(df, str(tmp_path / "csv"), "csv", ["v", "k"])
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == ["v", "k"] and json.loads(back.where("k = 'a'").first().v) == ["x", 'q"']
    sinks.write(df, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    rows = spark.createDataFrame([("j", "1", 5), ("k", "1", 6)], "judge_model string, prompt_version string, x int")
    sinks.write_judged(rows, str(tmp_path / "judged"))
    sinks.write_judged(rows.where("judge_model = 'j'").selectExpr("judge_model", "prompt_version", "7 AS x"), str(tmp_path / "judged"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "judged")).collect()) == [6, 7]


def test_digests(spark, tmp_path):
    save(tmp_path / "f.json", "hello")
    r = readers.file_digests(spark, str(tmp_path), "*.json").first()
    assert (r.sha256, r.bytes) == (hashlib.sha256(b"hello").hexdigest(), 5)


def test_envelopes_keep_every_key(spark, tmp_path):
    save(tmp_path / "a" / "nested.json", {"metadata": {"run_id": "r", "odd": {"x": [1, None]}}, "other": 1, "detailed_results": [{"id": 1, "odd": {"y": 2}}, 5, {"id": 2}]})
    save(tmp_path / "a" / "flat.json", {"run_id": "q", "k": 3, "detailed_results": [], "predictions": [{"id": 3, "z": "é"}]})
    save(tmp_path / "b" / "bare.json", [{"id": 4, "own": True}, [1], {"id": 5}])
    save(tmp_path / "b" / "summary_x.json", {"predictions": [{"id": 9}]})
    save(tmp_path / "b" / "broken.json", "{oops")
    save(tmp_path / "b" / "number.json", "7")
    name = F.substring_index("file", "/", -1)
    heads = {r.n: r.m for r in readers.run_envelopes(spark, str(tmp_path)).select(name.alias("n"), F.to_json("metadata").alias("m")).collect()}
    assert {k: json.loads(v) for k, v in heads.items()} == {"nested.json": {"run_id": "r", "odd": {"x": [1, None]}}, "flat.json": {"run_id": "q", "k": 3}, "bare.json": {}}
    items = readers.run_items(spark, str(tmp_path)).select(name.alias("n"), "ordinal", F.to_json("item").alias("i")).collect()
    assert sorted((r.n, r.ordinal, r.i) for r in items) == [("bare.json", 0, '{"id":4,"own":true}'), ("bare.json", 2, '{"id":5}'), ("flat.json", 0, '{"id":3,"z":"é"}'), ("nested.json", 0, '{"id":1,"odd":{"y":2}}'), ("nested.json", 2, '{"id":2}')]


def test_array_files(spark, tmp_path):
    rows = [(i, f'q"{i}\n', None if i % 3 else [i]) for i in range(50)]
    sinks.write(spark.createDataFrame(rows, "id long, input string, v array<long>").repartition(3), str(tmp_path / "out"), "json_array")
    files = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sorted((x["id"], x["input"], x["v"]) for own in files for x in own) == rows and len(files) == 3
    sinks.write(spark.createDataFrame([], "id long"), str(tmp_path / "none"), "json_array")
    assert not "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")).strip()


def test_a_file_in_ranges_is_the_file(spark, tmp_path):
    """Wherever ranges are cut: in strings, escapes, characters, nested brackets."""
    r = random.Random(7)
    words = ["a", '"', "\\\\", "{", "}", "[", "]", ",", "é", "😀", "\n", " ", ":"]
    text = lambda: "".join(r.choice(words) for _ in range(r.randrange(12)))
    value = lambda d: r.choice([text(), r.randrange(99), None, True, 1.5, {text(): value(d - 1) for _ in range(r.randrange(3))} if d else [], [value(d - 1) for _ in range(r.randrange(3))] if d else {}])
    for n, indent in ((0, None), (1, None), (7, 1), (120, None), (120, 2)):
        items = [value(3) for _ in range(n)]
        path = tmp_path / f"{n}-{indent}.json"
        path.write_text(json.dumps(items, indent=indent, ensure_ascii=r.random() < 0.5))
        size = path.stat().st_size
        for cut in {1, 2, 3, 7, max(1, size // 16), size + 5} if n < 20 else {max(1, size // 16), 61, 997}:
            states, found = [(arrays.OUTSIDE, 0)], []
            for a in range(0, size, cut):
                b = min(size, a + cut)
                state, depth = states[-1]
                found += [json.loads(x) for x in arrays.elements(str(path), a, b, size, state, depth)]
                after, change = arrays.effect(str(path), a, b)[state]
                states.append((after, depth + change))
            assert found == items and states[-1] == (arrays.OUTSIDE, 0), (n, cut)


def test_large_gold_dataset(spark, tmp_path):
    rows = [{"id": str(i), "input": f'q "{i}" {{[,\\' if i % 5 else " ", "outputs": [{"formula": f" <<a>>F p{i} "}] * (i % 3)} for i in range(400)] + [{"input": "no outputs", "odd": {"a": []}}]
    (tmp_path / "gold").mkdir()
    save(tmp_path / "gold" / "d.json", rows)
    size = (tmp_path / "gold" / "d.json").stat().st_size
    want = readers.gold_dataset(spark, str(tmp_path / "gold")).orderBy("ordinal").drop("ordinal").collect()
    out = readers.large_gold_dataset(spark, str(tmp_path / "gold"), range_bytes=size // 16 + 1)
    assert out.orderBy("ordinal").drop("ordinal").select(*want[0].asDict()).collect() == want
    assert len({x.ordinal >> 32 for x in out.select("ordinal").collect()}) == 16
    save(tmp_path / "odd.json", [5, rows[1], "x", [rows[2]]])
    assert [x.problem for x in readers.large_gold_dataset(spark, str(tmp_path / "odd.json")).orderBy("ordinal").collect()] == ["not an object", None, "not an object", "not an object"]


def test_digest_of_a_file_that_no_row_holds(spark, tmp_path):
    (tmp_path / "large").mkdir()
    path = tmp_path / "large" / "sparse.bin"
    with open(path, "wb") as f:
        f.truncate((2 << 30) + 10)
    want = hashlib.sha256()
    zeros = bytes(1 << 20)
    for _ in range(2 << 10):
        want.update(zeros)
    want.update(bytes(10))
    r = readers.file_digests(spark, str(tmp_path / "large")).first()
    assert (r.sha256, r.bytes) == (want.hexdigest(), (2 << 30) + 10)


def test_ranges_are_dealt_to_tasks_and_read_no_further_than_needed(spark, tmp_path, monkeypatch):
    items = [{"id": str(i), "text": "x" * 60} for i in range(4_000)]
    save(tmp_path / "a.json", items)
    size = (tmp_path / "a.json").stat().st_size
    out = arrays.array_elements(spark, str(tmp_path), "a.json", 1 << 12)
    held = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(held) == len(items) and len(held) > 1 and max(held) < 0.7 * len(items)
    seen, whole = [], arrays.marks
    monkeypatch.setattr(arrays, "marks", lambda data, state: seen.append(len(data)) or whole(data, state))
    assert len(list(arrays.elements(str(tmp_path / "a.json"), 0, 1 << 12, size, arrays.OUTSIDE, 0))) > 40
    assert sum(seen) <= 2 << 12
    digests = arrays.digests(arrays.listed(spark, str(tmp_path)))
    assert digests.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
