import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.functions import keys, text
from assayer.operators import dataset, scoring


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def normal(x):
    for a, b in text.SYMBOLS:
        x = x.replace(a, b)
    x = re.sub(r"\bor\b", "||", re.sub(r"\band\b", "&&", x, flags=re.I), flags=re.I)
    x = re.sub(r"&&+", "&&", re.sub(r"\|\|+", "||", x))
    x = re.sub(r"<<[^>]*>>", lambda m: m[0].replace("_", ""), x)
    return re.sub(r"\s+", "", x.lower())


def test_formulas_against_python(spark):
    r = random.Random(1)
    parts = ["<<", ">>", "a_b", "_", " and ", " OR ", "∧", "∨", "¬", "→", "⇔", "&&&", "|||", "X y", " ", "\t", "G", ">", "é_É", "sand", "or"]
    values = ["".join(r.choice(parts) for _ in range(r.randrange(0, 12))) for _ in range(800)]
    assert column(spark, values, text.normalized_formula) == [normal(v) for v in values]


def test_exact_match_examples(spark):
    rows = [("<<A>>F p\n<<B>>G q", ["<<b>>G q", "<<a>> F p"], True), ("<<A>>F p", ["<<a>>F p", "<<b>>G q"], False), ("<<A>>F p\n<<A>>F p", ["<<A>>F p"], False), ("<<a_b>>F x_y", ["<<AB>>F x_y"], True), ("<<a_b>>F xy", ["<<AB>>F x_y"], False), ("", ["p"], False), ("p", [], False), (None, ["p"], False), ("p ∧ q", ["p and q"], True)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, p string, g array<string>, want boolean")
    assert [r.got for r in df.select("i", scoring.exact_match(F.col("p"), F.col("g")).alias("got")).orderBy("i").collect()] == [x[2] for x in rows]


#: By hand: raw outputs of each family and the answers in them.
ANSWERS = {
    "qwen": [
        ('<|im_start|>user\nask<|im_end|>\n<|im_start|>assistant\n"F p"<|im_end|>tail', "F p"),
        ("<|im_start|>assistant\none\n \n\ntwo<|im_end|><|im_end|>", "one\ntwo"),
        ("  just this\t", "just this"),
        ("<|im_start|>assistant\n<|im_end|>gone", ""),
    ],
    "mistral": [("<s>[INST] ask [/INST] 'G q'</s>tail", "G q"), ("[INST] a [/INST] b [INST] c [/INST] d", "d"), ("\"it's\"", "it's"), ("", "")],
    "phi3": [("<|user|>ask<|end|>\n<|assistant|>\nF p<|end|>tail", "F p"), ("<|assistant|>first<|assistant|>second", "second")],
    "generic": [("User: ask\nAssistant: F p", "F p"), ("Assistant: a\n\n\nb", "a\nb")],
}


@pytest.mark.parametrize("family", sorted(ANSWERS))
def test_clean_output(spark, family):
    raw, want = zip(*ANSWERS[family])
    assert column(spark, list(raw), lambda c: text.clean_output(c, F.lit(family))) == list(want)


def test_verdicts(spark):
    cases = {
        '{"correct": "yes", "reasoning": "fine"}': ("yes", "fine"),
        "{'correct': 'yes', 'reasoning': 'ok',}": ("yes", "ok"),
        '```json\n{"a": {"b": 1}, "correct": " YES "}\n```': ("yes", "No reasoning provided."),
        "Correct: yes\nbecause": ("yes", "No reasoning provided."),
        'Correct = "no", Reasoning: "two words.\nand more" ': ("no", "two words.\nand more"),
        "{}": ("no", "No reasoning provided."),
        "{'correct': True, 'reasoning': None}": ("no", "None"),
        '{"correct": "yes", "reasoning": "a {b} \\\\" c}"}'.replace('\\\\"', '\\"'): ("yes", 'a {b} " c}'),
        '{"correct": "yes", "reasoning": false}': ("yes", "False"),
        "{" * 9 + '"correct": "yes"' + "}" * 9: ("no", "Judge response was not valid JSON."),
        '{"a": ' * 8 + "1" + "}" * 8 + ' {"x": {"y": {"z": {"w": [{"v": 1}]}}}, "correct": "yes", "reasoning": "deep"} {bad}': ("yes", "deep"),
        'output: {"correct": "no"} output: {"correct": "yes"}': ("yes", "No reasoning provided."),
        '{"correct": "yes"} then {"correct": "no"}': ("no", "No reasoning provided."),
        "don't know {“correct”: “yes”}": ("yes", "No reasoning provided."),
        '{"correct": "maybe"}': ("no", "No reasoning provided."),
        "cannot say": ("no", "Judge response was not valid JSON."),
        "": ("no", "Judge response was not valid JSON."),
    }
    assert [tuple(x) for x in column(spark, list(cases), text.verdict)] == list(cases.values())


def test_small_functions(spark):
    assert column(spark, ["", "abc", "a" * 9, None], text.token_estimate) == [0, 1, 2, 0]
    assert column(spark, ["Azure-x", "gpt-4", "Qwen2", "Phi-3", "Mistral", "other"], text.chat_family) == ["generic", "generic", "qwen", "phi3", "mistral", "generic"]
    assert column(spark, ["x/a__judge-b.json", "c.json", "d"], text.source_stem) == ["a", "c", "d"]
    assert column(spark, [-0.1, 0.0, 0.21, 0.61, 0.9, None], text.kappa_band, "double") == ["Poor", "Slight", "Fair", "Substantial", "Almost Perfect", "n/a"]
    assert column(spark, [" Yes", "n", "", None, "1", "maybe"], text.annotated) == ["yes", "no", "", "", "yes", ""]
    assert column(spark, ["<< A , B >> F p"], text.single_brackets) == ["<A , B> F p"]
    assert column(spark, ["mistral", "x"], lambda c: text.displayed(c, {"mistral": "mistral-7b"})) == ["mistral-7b", "x"]
    assert column(spark, [["a"], ["a", "b"], []], text.numbered, "array<string>") == ["a", "1. a\n2. b", ""]
    assert column(spark, ["x content_filter y", "ok", None], text.refused) == [True, False, False]
    assert column(spark, ["It WILL KEEP on", "no"], lambda c: text.paraphrased(c, F.lit(1), dataset.PARAPHRASES)) == ["It will maintain on", "no"]
    assert text.few_shot_block([("a", "b")]) == "Examples:\nInput: a\nOutput: b" and text.few_shot_block([]) == ""


def test_item_key_is_that_of_json(spark):
    import hashlib

    values = ['a "quoted" ü', "line\nbreak\t\\", "plain"]
    want = [hashlib.sha256(json.dumps({"input": v, "gold": "g", "prediction": "p"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16] for v in values]
    assert column(spark, values, lambda c: keys.item_key(c, F.lit("g"), F.lit("p"))) == want


def test_gold_options(spark):
    df = spark.createDataFrame([([" a ", "b", ""], "b", None), (None, " ", "c")], "x array<string>, y string, z string")
    out = df.select(dataset.gold_options(F.col("x"), F.array("y"), F.array("z")).alias("g")).collect()
    assert [r.g for r in out] == [["a", "b"], ["c"]]


def test_profile(spark):
    df = spark.createDataFrame([(["<<A>>G (p -> F q)", "!<<B>>X p"], "pr")], "g array<string>, p string")
    p = df.select(text.formula_profile(F.col("g"), F.col("p")).alias("p")).first().p
    assert (p.n_G, p.n_F, p.n_X, p.n_U, p.n_and, p.n_or, p.n_implies, p.n_not, p.coalition_count) == (1, 1, 1, 0, 0, 1, 1, 1, 2)
    assert p.has_negated_ability and p.complexity_score == 9 and p.complexity_bin == "complex" and p.gold_option_count == 2


def test_counts_matter(spark):
    assert Counter(["a"]) != Counter(["a", "a"])


def plain_objects(text):
    """The scan in plain Python: quotes count within braces only."""
    found, start, depth, quote, escaped = [], 0, 0, "", False
    for i, c in enumerate(text):
        if quote:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == quote:
                quote = ""
        elif depth and c in "\"'":
            quote = c
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                found.append(text[start : i + 1])
    return found


def test_objects_of_any_depth(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["{", "{", "}", "}", '"', "'", "\\", "ab", "\n", "é😀", ":", " "]) for _ in range(r.randrange(40))) for _ in range(3_000)]

    def nest(depth):
        return json.dumps({"k": "v}\"'{"}) if depth == 0 else '{"a' + r.choice(["", "'", "}"]) + '": ' + nest(depth - 1) + "}"

    texts += [f"say {nest(d)} and {nest(8)} end" for d in range(30)]
    assert column(spark, texts, text.objects) == [plain_objects(t) for t in texts]
    assert max(len(x) for x in map(plain_objects, texts)) > 3


def test_verdicts_of_random_objects(spark):
    r = random.Random(4)

    def value(depth):
        kind = r.randrange(6 if depth else 4)
        return [r.choice(["yes", "no", "it's", 'a "b"', "x}{y", "é"]), r.randrange(9), None, True, {f"k{i}": value(depth - 1) for i in range(r.randrange(3))} if depth else 0, [value(depth - 1) for _ in range(2)] if depth else 0][kind]

    replies, want = [], []
    for i in range(600):
        data = {f"n{j}": value(8) for j in range(r.randrange(4))} | {"correct": r.choice(["yes", "no", " YES ", "maybe", 3]), "reasoning": r.choice(["", " why ", "it's {so}"])}
        keys = list(data)
        r.shuffle(keys)
        own = {k: data[k] for k in keys}
        replies.append(f"prose isn't an object {json.dumps(own) if i % 2 else repr(own)} done")
        decision = str(data["correct"]).strip().lower()
        want.append((decision if decision in ("yes", "no") else "no", data["reasoning"].strip() or "No reasoning provided."))
    assert [tuple(x) for x in column(spark, replies, text.verdict)] == want
