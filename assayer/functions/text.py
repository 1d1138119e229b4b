"""Column functions over texts: formulas, chat output, prompts, verdicts. All built from SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Logic symbols and their ASCII forms.
SYMBOLS = (
    ("∧", "&&"),
    ("∨", "||"),
    ("¬", "!"),
    ("→", "->"),
    ("⇒", "->"),
    ("↔", "<->"),
    ("⇔", "<->"),
)

# Where an answer begins and ends in the output of each chat family.
ANSWER_MARKERS = {
    "qwen": (("<|im_start|>assistant",), ("<|im_end|>", "<|endoftext|>")),
    "mistral": (("[/INST]",), ("</s>",)),
    "phi3": (("<|assistant|>",), ("<|end|>", "<|endoftext|>")),
    "generic": (("Assistant:", "assistant:"), ("<|im_end|>", "<|end|>", "<|endoftext|>", "</s>")),
}

# What a provider's refusal says.
REFUSAL_MARKERS = ("content_filter", "ResponsibleAIPolicyViolation", "content management policy")

# Upper bounds of kappa's bands; the first set includes none of them, the second includes them.
KAPPA_BANDS = (("Poor", 0.0), ("Slight", 0.21), ("Fair", 0.41), ("Moderate", 0.61), ("Substantial", 0.81), ("Almost Perfect", None))
KAPPA_BANDS_CLOSED = (("slight", 0.20), ("fair", 0.40), ("moderate", 0.60), ("substantial", 0.80), ("almost perfect", None))

_LINE_BREAKS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_BLANK = r"[\s\x{1c}-\x{1f}]"


def first_filled(*columns: Column | str) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*(F.nullif(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in columns))


def strip(text: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def collapse_blanks(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U){_BLANK}+", " "))


def normalized_formula(formula: Column) -> Column:
    """Symbols in ASCII, `and` and `or` as operators, doubled operators once, no `_` within << >>, lower case, no white space."""
    out = F.coalesce(formula, F.lit(""))
    for symbol, ascii_form in SYMBOLS:
        out = F.replace(out, F.lit(symbol), F.lit(ascii_form))
    out = F.regexp_replace(out, r"(?iU)\band\b", "&&")
    out = F.regexp_replace(out, r"(?iU)\bor\b", "||")
    out = F.regexp_replace(out, r"\|\|+", "||")
    out = F.regexp_replace(out, r"&&+", "&&")
    out = F.regexp_replace(out, r"(<<|\G(?!^))([^>_]*)_(?=[^>]*>>)", "$1$2")
    return F.regexp_replace(F.lower(out), rf"(?U){_BLANK}+", "")


def clean_output(raw: Column, family: Column) -> Column:
    """The answer in a chat model's raw output: after the last start marker, up to the first stop token."""

    def answer(markers: Sequence[str], stops: Sequence[str]) -> Column:
        out = raw
        for m in markers:
            out = F.substring_index(out, m, -1)
        for s in stops:
            out = F.substring_index(out, s, 1)
        return out

    text = F.when(F.lit(False), raw)
    for name, (markers, stops) in ANSWER_MARKERS.items():
        if name != "generic":
            text = text.when(family == name, answer(markers, stops))
    text = text.otherwise(answer(*ANSWER_MARKERS["generic"]))
    text = strip(F.regexp_replace(text, r"(?U)\n\s*\n+", "\n"))
    return F.btrim(F.btrim(text, F.lit('"')), F.lit("'"))


def formula_lines(text: Column) -> Column:
    """Lines that aren't blank, stripped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _LINE_BREAKS), strip), lambda x: x != "")


def yes_no(value: Column, accept: Sequence[str] = ("yes",), reject: Sequence[str] | None = None, default: str = "no") -> Column:
    """'yes' for the accepted words, 'no' for the rejected ones (all others where reject is None), else default; case and blanks don't count."""
    word = F.lower(F.trim(value.cast("string")))
    out = F.when(word.isin(*accept), "yes")
    if reject is not None:
        out = out.when(word.isin(*reject), "no")
    return out.otherwise(default)


def annotated(value: Column) -> Column:
    """A human label: yes, no, or '' where there is none."""
    return yes_no(value, ("yes", "y", "true", "1"), ("no", "n", "false", "0"), "")


def formula_profile(golds: Column, prediction: Column) -> Column:
    """Counts of operators over the readings joined by ' || ', a score, and its bin."""
    text = F.array_join(F.coalesce(golds, F.array().cast("array<string>")), " || ")
    token = lambda t: F.regexp_count(text, F.lit(rf"(?<![A-Za-z0-9_]){t}(?![A-Za-z0-9_])"))
    times = lambda s: ((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s)).cast("int")
    temporal = {t: token(t) for t in ("G", "F", "X", "U")}
    connectives = {"and": times("&&"), "or": times("||"), "implies": times("->"), "not": times("!")}
    coalitions = times("<<")
    n = F.size(golds)
    score = sum([*temporal.values(), *connectives.values(), coalitions, F.greatest(F.lit(0), n - 1)])
    size = F.length(text)
    return F.struct(
        F.greatest(n, F.lit(0)).alias("gold_option_count"),
        size.alias("gold_length_chars"),
        F.length(F.coalesce(prediction, F.lit(""))).alias("prediction_length_chars"),
        coalitions.alias("coalition_count"),
        F.replace(text, F.lit(" "), F.lit("")).contains("!<<").alias("has_negated_ability"),
        *(c.alias(f"n_{k}") for k, c in temporal.items()),
        *(c.alias(f"n_{k}") for k, c in connectives.items()),
        score.alias("complexity_score"),
        F.when((score <= 3) & (size <= 100), "simple").when((score <= 8) & (size <= 240), "medium").otherwise("complex").alias("complexity_bin"),
    )


def objects(text: Column) -> Column:
    """The outermost {...} of a text, in order, nested to any depth; braces in strings within them don't count."""
    tokens = F.regexp_extract_all(text, F.lit(r"""(?s)\\.?|[{}"']|[^\\{}"']+"""), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(0).alias("begin"), F.array().cast("array<struct<a:int,n:int>>").alias("found"))

    def step(s, t):
        inside = s["quote"] != ""
        size = F.length(t)
        # a backslash goes with the character after it; out of strings that one counts as itself
        mark = F.when(t.startswith("\\"), F.when(inside, F.lit("")).otherwise(F.substring(t, 2, 1))).otherwise(t)
        last = s["at"] + size  # the place after the token
        opens = ~inside & (mark == "{")
        closes = ~inside & (mark == "}") & (s["depth"] > 0)
        quote = F.when(inside, F.when(mark == s["quote"], F.lit("")).otherwise(s["quote"])).when((s["depth"] > 0) & mark.isin('"', "'"), mark).otherwise(F.lit(""))
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        begin = F.when(opens & (s["depth"] == 0), last - 1).otherwise(s["begin"])
        found = F.when(closes & (s["depth"] == 1), F.concat(s["found"], F.array(F.struct(s["begin"].alias("a"), (last - s["begin"]).alias("n"))))).otherwise(s["found"])
        return F.struct(last.alias("at"), depth.alias("depth"), quote.alias("quote"), begin.alias("begin"), found.alias("found"))

    spans = F.aggregate(tokens, start, step, lambda s: s["found"])
    return F.transform(spans, lambda x: F.substring(text, x["a"], x["n"]))


_LENIENT = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}
_PYTHON_WORDS = (("True", "true"), ("False", "false"), ("None", "null"))


def parsed_object(text: Column) -> Column:
    """A {...} as VARIANT, with typographic quotes, commas before closing brackets and Python's words for values mended; null where it can't be read."""
    mended = F.regexp_replace(F.regexp_replace(F.translate(text, "“”‘’", "\"\"''"), r",\s*\}", "}"), r",\s*\]", "]")
    words = mended
    for own, other in _PYTHON_WORDS:
        words = F.regexp_replace(words, rf"([:\[,]\s*){own}(?=\s*[,}}\]])", f"$1{other}")
    read = lambda x: F.from_json(x, "variant", _LENIENT)
    return F.coalesce(read(mended), read(words))


def _said(data: Column, path: str) -> Column:
    """A value as text: null is None, true is True; null where there is none."""
    value = F.try_variant_get(data, path, "variant")
    own = F.try_variant_get(data, path, "string")
    return F.when(F.is_variant_null(value), "None").when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(own)).otherwise(own)


def verdict(reply: Column) -> Column:
    """(decision, reasoning) of a judge's reply: its last JSON object, at any depth of nesting and mended where quotes or commas are off; else `correct: yes` with what follows `reasoning:`; else no.

    Nested values in reasoning are written as JSON. A quote in the prose around an object opens no string.
    """
    raw = strip(F.coalesce(reply, F.lit("")))
    raw = strip(F.element_at(F.split(raw, r"(?iU)\boutput\s*:"), -1))
    return let(raw, lambda raw: let(_last_object(raw), lambda data: _decision(raw, data)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _last_object(raw: Column) -> Column:
    """The last object that can be read. What comes before it isn't parsed."""
    return F.aggregate(F.reverse(objects(raw)), F.lit(None).cast("variant"), lambda seen, x: F.when(seen.isNotNull(), seen).otherwise(parsed_object(x)))


def _decision(raw: Column, data: Column) -> Column:
    pair = F.lower(F.regexp_extract(raw, r"""(?iU)\bcorrect\s*[:=]\s*['"]?(yes|no)['"]?""", 1))
    after = F.regexp_replace(strip(F.regexp_extract(raw, r"(?isU)\breasoning\s*[:=]\s*(.+)", 1)), r"""^["']+|["']+\z""", "")
    why = lambda x: first_filled(strip(x), F.lit("No reasoning provided."))
    return (
        F.when(data.isNotNull(), F.struct(yes_no(strip(_said(data, "$.correct")), ("yes",)).alias("decision"), why(_said(data, "$.reasoning")).alias("reasoning")))
        .when(pair != "", F.struct(pair.alias("decision"), why(after).alias("reasoning")))
        .otherwise(F.struct(F.lit("no").alias("decision"), F.lit("Judge response was not valid JSON.").alias("reasoning")))
    )


def numbered(options: Column) -> Column:
    """One option as it is, several as a numbered list."""
    listed = F.array_join(F.transform(options, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.when(F.size(options) > 1, listed).otherwise(F.coalesce(F.try_element_at(options, F.lit(1)), F.lit("")))


def filled_template(template: str, values: Mapping[str, Column]) -> Column:
    """The template with each {name} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def few_shot_block(examples: Sequence[tuple[str, str]], heading: str = "Examples:") -> str:
    """The examples as text, for a system prompt."""
    return heading + "\n" + "\n".join(f"Input: {a}\nOutput: {b}" for a, b in examples) if examples else ""


def chat_prompt(family: Column, system: Column, user: Column, completion: Column | None = None) -> Column:
    """A prompt in the chat form of each family, with the completion where one is given."""
    end = lambda stop, lead="": F.lit("") if completion is None else F.coalesce(F.concat(F.lit(lead), completion, F.lit(stop)), F.lit(""))
    qwen = F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"), end("<|im_end|>"))
    phi3 = F.concat(F.lit("<|system|>\n"), system, F.lit("<|end|>\n<|user|>\n"), user, F.lit("<|end|>\n<|assistant|>\n"), end("<|end|>"))
    mistral = F.concat(F.lit("<s>[INST] "), system, F.lit("\n\n"), user, F.lit(" [/INST]"), end("</s>", " "))
    generic = F.concat(F.lit("System:\n"), system, F.lit("\n\nUser:\n"), user, F.lit("\n\nAssistant:\n"), end(""))
    return F.when(family == "qwen", qwen).when(family == "phi3", phi3).when(family == "mistral", mistral).otherwise(generic)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one; none for an empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def refused(message: Column) -> Column:
    out = F.lit(False)
    for marker in REFUSAL_MARKERS:
        out = out | F.coalesce(message, F.lit("")).contains(marker)
    return out


def chat_family(model: Column) -> Column:
    name = F.lower(model)
    return F.when(name.contains("azure") | name.startswith("gpt-"), "generic").when(name.contains("qwen"), "qwen").when(name.contains("phi"), "phi3").when(name.contains("mistral"), "mistral").otherwise("generic")


def source_stem(file_name: Column) -> Column:
    """A judged file's name without its judge and suffix."""
    return F.substring_index(F.regexp_replace(F.substring_index(file_name, "/", -1), r"\.json$", ""), "__judge-", 1)


def kappa_band(kappa: Column, bands: Sequence[tuple[str, float | None]] = KAPPA_BANDS, closed: bool = False) -> Column:
    out = F.when(kappa.isNull(), "n/a")
    if closed:
        out = out.when(kappa < 0, "poor")
    for label, bound in bands:
        if bound is not None:
            out = out.when(kappa <= bound if closed else kappa < bound, label)
    return out.otherwise(bands[-1][0])


def displayed(value: Column, names: Mapping[str, str]) -> Column:
    """The name to show, where there is one."""
    if not names:
        return value
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[value], value)


def single_brackets(formula: Column) -> Column:
    """<<A>> as <A>."""
    return F.regexp_replace(F.trim(formula), r"<<\s*([^>]+?)\s*>>", "<$1>")


def paraphrased(text: Column, choice: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first phrase of the table that occurs, in any case, replaced once by one of its forms; choice is a number that picks it."""
    out = F.when(F.lit(False), text)
    for phrase, forms in table:
        form = F.element_at(F.array(*(F.lit(x) for x in forms)), (F.pmod(choice, F.lit(len(forms))) + 1).cast("int"))
        at = F.locate(phrase, F.lower(text))
        out = out.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), form, F.substring(text, at + len(phrase), F.length(text))))
    return out.otherwise(text)
