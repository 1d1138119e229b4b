"""Every query over the driver's tables, and the same in SQL for DuckDB. Doubles are rounded where they are shown."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import keys, text
from assayer.operators import agreement, annotations, audit, dataset, efficiency, judging, report, runs, scoring, significance
from assayer.operators.rank import ranked
from assayer.plans.views import load, with_views
from assayer.sources import readers, sinks
from assayer.sources.shared import fresh_path, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 42


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append(F.round(c, digits).alias(f.name) if kind in ("double", "float") else c.cast("long").alias(f.name) if kind in ("int", "smallint", "tinyint") else c)
    return df.select(*out)


# --- judged rows ---

_N = "count(*) FILTER (WHERE decision_method <> 'unmatched')"
_METRICS = f"""
  {_N} AS evaluated,
  count(*) FILTER (WHERE decision_method <> 'unmatched' AND correct = 'yes') AS correct_count,
  count(*) FILTER (WHERE decision_method <> 'unmatched' AND correct = 'no') AS incorrect_count,
  round(coalesce(count(*) FILTER (WHERE decision_method <> 'unmatched' AND correct = 'yes') / nullif({_N}, 0)::DOUBLE, 0), 6) AS accuracy,
  count(*) FILTER (WHERE decision_method = 'exact') AS exact_count,
  round(coalesce(count(*) FILTER (WHERE decision_method = 'exact') / nullif({_N}, 0)::DOUBLE, 0), 6) AS exact_match_rate,
  count(*) FILTER (WHERE decision_method = 'llm') AS llm_count,
  round(coalesce(count(*) FILTER (WHERE decision_method = 'llm') / nullif({_N}, 0)::DOUBLE, 0), 6) AS llm_rate,
  count(*) FILTER (WHERE decision_method = 'llm' AND correct = 'yes') AS llm_approved,
  count(*) FILTER (WHERE decision_method = 'llm' AND correct <> 'yes') AS llm_rejected,
  round(coalesce(count(*) FILTER (WHERE decision_method = 'llm' AND correct = 'yes') / nullif(count(*) FILTER (WHERE decision_method = 'llm'), 0)::DOUBLE, 0), 6) AS llm_approval_rate,
  round(coalesce(count(*) FILTER (WHERE decision_method = 'exact') / nullif({_N}, 0)::DOUBLE, 0), 6) AS accuracy_from_exact_match,
  round(coalesce(count(*) FILTER (WHERE decision_method = 'llm' AND correct = 'yes') / nullif({_N}, 0)::DOUBLE, 0), 6) AS accuracy_boost_from_llm,
  count(*) FILTER (WHERE decision_method = 'no_llm') AS no_llm_count,
  count(*) FILTER (WHERE decision_method = 'content_filtered') AS content_filtered_count"""


@query(f"SELECT model_short, condition, judge_model, {_METRICS} FROM v_judged GROUP BY ALL")
def judge_metrics(spark, sf_dir):
    return shown(judging.metrics(load(spark, sf_dir, "v_judged"), ["model_short", "condition", "judge_model"]))


@query(f"""
SELECT *, CASE WHEN overall = 0 THEN row_number() OVER (PARTITION BY judge_model, overall ORDER BY accuracy DESC, source_file) END AS place
FROM (SELECT judge_model, source_file, grouping(source_file)::BIGINT AS overall, {_METRICS}
      FROM (SELECT *, concat(model_short, '/', condition) AS source_file FROM v_judged) t GROUP BY GROUPING SETS ((judge_model, source_file), (judge_model))) s""")
def judge_summary(spark, sf_dir):
    rows = load(spark, sf_dir, "v_judged").withColumn("source_file", F.concat("model_short", F.lit("/"), "condition"))
    return shown(judging.summary(rows, "judge_model", "source_file"))


@query("""
SELECT judge_model, condition, count(*) AS total, count(*) FILTER (WHERE decision_method = 'exact') AS exact, count(*) FILTER (WHERE decision_method = 'llm') AS llm,
       count(*) FILTER (WHERE decision_method = 'no_llm') AS no_llm, count(*) FILTER (WHERE decision_method = 'unmatched') AS unmatched, count(*) FILTER (WHERE decision_method = 'content_filtered') AS content_filtered
FROM v_judged GROUP BY ALL""")
def method_stats(spark, sf_dir):
    return judging.method_stats(load(spark, sf_dir, "v_judged"), ["judge_model", "condition"])


_ACC = "count(*) FILTER (WHERE decision_method <> 'unmatched' AND correct = 'yes') / nullif(count(*) FILTER (WHERE decision_method <> 'unmatched'), 0)::DOUBLE"


@query(f"""
SELECT condition, judge_model, model_short, round(accuracy, 6) AS accuracy FROM (
  SELECT condition, judge_model, model_short, coalesce({_ACC}, 0) AS accuracy FROM v_judged GROUP BY ALL) t
QUALIFY row_number() OVER (PARTITION BY condition, judge_model ORDER BY accuracy DESC, model_short) = 1""")
def best_models(spark, sf_dir):
    stats = judging.metrics(load(spark, sf_dir, "v_judged"), ["condition", "judge_model", "model_short"])
    return shown(judging.best_rows(stats, ["condition", "judge_model"], "accuracy", "model_short").select("condition", "judge_model", "model_short", "accuracy"))


@query("""
SELECT count(*) AS n FROM v_judged v WHERE NOT EXISTS (
  SELECT 1 FROM v_judged d WHERE d.decision_method = 'exact' AND d.condition = 'F' AND d.judge_model = v.judge_model AND d.model_short = v.model_short AND d.condition = v.condition)""")
def rows_not_yet_judged(spark, sf_dir):
    rows = load(spark, sf_dir, "v_judged")
    done = rows.where("decision_method = 'exact' and condition = 'F'")
    return judging.not_yet_judged(rows, done, ("judge_model", "model_short", "condition")).agg(F.count("*").alias("n"))


@query("""SELECT concat(model_short, '/', condition) AS source_file, judge_model, CASE WHEN condition <> 'P' THEN count(*) ELSE 0 END AS n_stored, CASE WHEN condition = 'P' THEN count(*) ELSE 0 END AS n_open FROM v_judged GROUP BY model_short, condition, judge_model""")
def stored_judgements(spark, sf_dir):
    """A second run over stored results, after the content of some sources has changed."""
    source = F.concat_ws("/", "model_short", "condition")
    rows = load(spark, sf_dir, "v_judged").select("judge_model", F.lit("1").alias("prompt_version"), source.alias("source_file"), F.sha2("model_short", 256).alias("source_sha256"), "model_short", "condition", "o_orderkey", "correct")
    path = fresh_path(spark, "judged_store")
    table = f"judged_{path.rsplit('/', 2)[-2].rsplit('-', 1)[-1]}"
    sinks.store_judged(rows, table, path, 8)
    again = rows.withColumn("source_sha256", F.when(F.col("condition") == "P", F.sha2(F.concat("model_short", F.lit(" changed")), 256)).otherwise(F.col("source_sha256")))
    stored, open_ = judging.split_by_store(again, spark.table(table))
    both = stored.select("source_file", "judge_model", F.lit(1).alias("s"), F.lit(0).alias("o")).unionByName(open_.select("source_file", "judge_model", F.lit(0).alias("s"), F.lit(1).alias("o")))
    return both.groupBy("source_file", "judge_model").agg(F.sum("s").alias("n_stored"), F.sum("o").alias("n_open"))


# --- formulas, texts, prompts ---


def _norm_sql(x: str) -> str:
    for a, b in text.SYMBOLS:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\band\\b', '&&', 'gi'), '\\bor\\b', '||', 'gi'), '\\|\\|+', '||', 'g'), '&&+', '&&', 'g')"
    for _ in range(6):
        x = f"regexp_replace({x}, '(<<[^>_]*)_([^>]*>>)', '\\1\\2', 'g')"
    return f"regexp_replace(lower({x}), '\\s+', '', 'g')"


_LINES = "list_filter(list_transform(string_split(prediction, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_GOLDS = "CASE WHEN gold_2 IS NULL THEN [gold_1] ELSE [gold_1, gold_2] END"


def _golds():
    return F.array_compact(F.array("gold_1", "gold_2"))


@query(f"SELECT id, {_norm_sql('gold_1')} AS gold, {_norm_sql('prediction')} AS prediction FROM v_formula")
def normalized_formulas(spark, sf_dir):
    return load(spark, sf_dir, "v_formula").select("id", text.normalized_formula(F.col("gold_1")).alias("gold"), text.normalized_formula(F.col("prediction")).alias("prediction"))


_MATCH = f"(len({_LINES}) > 0 AND list_sort(list_transform({_LINES}, lambda x: {_norm_sql('x')})) = list_sort(list_transform({_GOLDS}, lambda x: {_norm_sql('x')})))"


@query(f"SELECT id, array_to_string({_GOLDS}, chr(10)) AS gold, prediction, {_MATCH}::BIGINT AS exact_match FROM v_formula")
def exact_matches(spark, sf_dir):
    rows = load(spark, sf_dir, "v_formula").withColumn("golds", _golds()).withColumnRenamed("prediction", "generated")
    return shown(scoring.scored(rows, ["generated"], "golds").select("id", "gold", "prediction", "exact_match"))


@query(f"SELECT p_size::BIGINT AS p_size, count(*) AS n_examples, round(avg({_MATCH}::INT), 6) AS exact_match FROM v_formula GROUP BY 1")
def exact_match_rate(spark, sf_dir):
    rows = load(spark, sf_dir, "v_formula").withColumn("exact_match", scoring.exact_match(F.col("prediction"), _golds()).cast("int"))
    return shown(scoring.match_rate(rows, ["p_size"]))


@query(f"""
SELECT id, CASE WHEN trim(prediction) = '' THEN 'unmatched' WHEN {_MATCH} THEN 'exact' ELSE 'llm' END AS decision_method,
       CASE WHEN trim(prediction) = '' THEN 'no' WHEN {_MATCH} THEN 'yes' END AS correct, CASE WHEN trim(prediction) = '' OR {_MATCH} THEN 'not_applicable' ELSE 'pending' END AS judge_parse_status
FROM v_formula""")
def decision_routes(spark, sf_dir):
    rows = load(spark, sf_dir, "v_formula")
    return rows.select("id", scoring.route(F.col("prediction"), scoring.exact_match(F.col("prediction"), _golds())).alias("r")).select("id", "r.*")


@query(f"SELECT id, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE {_MATCH} END AS flag FROM v_formula")
def exact_flags(spark, sf_dir):
    stored = F.when(F.col("p_size") % 4 == 0, " True").when(F.col("p_size") % 4 == 1, "0")
    return load(spark, sf_dir, "v_formula").select("id", scoring.exact_flag(stored, scoring.exact_match(F.col("prediction"), _golds())).alias("flag"))


def _count_sql(s: str) -> str:
    return f"((length(g) - length(replace(g, '{s}', ''))) / {len(s)})::BIGINT"


_SCORE = "(nf + ng + nand + nor + nimp + nnot + co + gold_option_count - 1)"


_PROFILED = f"""FROM (SELECT *, length(g) AS gold_length_chars, {_count_sql('&&')} AS nand, {_count_sql('||')} AS nor, {_count_sql('->')} AS nimp, {_count_sql('!')} AS nnot, {_count_sql('<<')} AS co,
             len(regexp_extract_all(g, '(^|[^A-Za-z0-9_])G($|[^A-Za-z0-9_])'))::BIGINT AS ng, len(regexp_extract_all(g, '(^|[^A-Za-z0-9_])F($|[^A-Za-z0-9_])'))::BIGINT AS nf
      FROM (SELECT id, len({_GOLDS})::BIGINT AS gold_option_count, array_to_string({_GOLDS}, ' || ') AS g, length(prediction) AS prediction_length_chars FROM v_formula) a) b"""
_BIN = f"CASE WHEN {_SCORE} <= 3 AND gold_length_chars <= 100 THEN 'simple' WHEN {_SCORE} <= 8 AND gold_length_chars <= 240 THEN 'medium' ELSE 'complex' END"


@query(f"""
SELECT id, gold_option_count, gold_length_chars, prediction_length_chars, co AS coalition_count, instr(replace(g, ' ', ''), '!<<') > 0 AS has_negated_ability, ng AS n_G, nf AS n_F, nand AS n_and, nor AS n_or, nimp AS n_implies, nnot AS n_not,
       {_SCORE} AS complexity_score, CASE WHEN {_SCORE} <= 3 AND gold_length_chars <= 100 THEN 'simple' WHEN {_SCORE} <= 8 AND gold_length_chars <= 240 THEN 'medium' ELSE 'complex' END AS complexity_bin
{_PROFILED}""")
def formula_profiles(spark, sf_dir):
    rows = load(spark, sf_dir, "v_formula").select("id", text.formula_profile(_golds(), F.col("prediction")).alias("p")).select("id", "p.*")
    return shown(rows.drop("n_X", "n_U"))


@query("""
SELECT conv_id, turn, CASE WHEN model_type = 'qwen' THEN trim(trim(c, '"'), '''') ELSE trim(trim(c, '"'), '''') END AS answer FROM (
  SELECT conv_id, turn, model_type, trim(regexp_replace(text, '\\n\\s*\\n+', chr(10), 'g'), chr(32) || chr(10) || chr(9) || chr(13)) AS c FROM v_chat) t""")
def clean_outputs(spark, sf_dir):
    return load(spark, sf_dir, "v_chat").select("conv_id", "turn", text.clean_output(F.col("raw"), F.col("model_type")).alias("answer"))


@query("""
SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN concat('<|im_start|>system', chr(10), 'Be brief.<|im_end|>', chr(10), '<|im_start|>user', chr(10), text, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10))
  WHEN 1 THEN concat('<s>[INST] Be brief.', chr(10), chr(10), text, ' [/INST]')
  WHEN 2 THEN concat('<|system|>', chr(10), 'Be brief.<|end|>', chr(10), '<|user|>', chr(10), text, '<|end|>', chr(10), '<|assistant|>', chr(10))
  ELSE concat('System:', chr(10), 'Be brief.', chr(10), chr(10), 'User:', chr(10), text, chr(10), chr(10), 'Assistant:', chr(10)) END AS prompt,
  CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens
FROM v_chat""")
def generation_prompts(spark, sf_dir):
    family = text.chat_family(F.concat(F.col("model_type"), F.lit("-3-small")))
    return shown(load(spark, sf_dir, "v_chat").select("conv_id", "turn", text.chat_prompt(family, F.lit("Be brief."), F.col("text")).alias("prompt"), text.token_estimate(F.col("text")).alias("tokens")))


_TEMPLATE = "Gold: {gold}\nAnswer: {prediction}"


@query("""
SELECT id, concat('Gold: ', CASE WHEN gold_2 IS NULL THEN gold_1 ELSE concat('1. ', gold_1, chr(10), '2. ', gold_2) END, chr(10), 'Answer: ', prediction) AS prompt,
       regexp_replace(trim(gold_1), '<<\\s*([^>]+?)\\s*>>', '<\\1>', 'g') AS single_brackets
FROM v_formula""")
def judge_prompts(spark, sf_dir):
    return load(spark, sf_dir, "v_formula").select("id", text.filled_template(_TEMPLATE, {"gold": text.numbered(_golds()), "prediction": F.col("prediction")}).alias("prompt"), text.single_brackets(F.col("gold_1")).alias("single_brackets"))


@query("""
SELECT id, CASE id % 8 WHEN 0 THEN 'yes' WHEN 2 THEN 'yes' WHEN 3 THEN 'yes' ELSE 'no' END AS decision,
       CASE id % 8 WHEN 2 THEN 'brief' WHEN 4 THEN '{"a":[1,{"b":"c"}]}' WHEN 5 THEN 'Judge response was not valid JSON.' WHEN 7 THEN 'Judge response was not valid JSON.'
       WHEN 3 THEN coalesce(nullif(trim(trim(regexp_replace(translate(said, '{}', '()'), '^\\s+|\\s+$', '', 'g'), concat('"', chr(39)))), ''), 'No reasoning provided.')
       ELSE coalesce(nullif(regexp_replace(said, '^\\s+|\\s+$', '', 'g'), ''), 'No reasoning provided.') END AS reasoning
FROM v_reply""")
def verdicts(spark, sf_dir):
    return load(spark, sf_dir, "v_reply").select("id", text.verdict(F.col("reply")).alias("v")).select("id", "v.*")


@query("""
SELECT id, substr(sha256(concat('{"gold": ', to_json(gold_1), ', "input": ', to_json(p_size::VARCHAR), ', "prediction": ', to_json(prediction), '}')), 1, 16) AS item_key FROM v_formula""")
def item_keys(spark, sf_dir):
    return load(spark, sf_dir, "v_formula").select("id", keys.item_key(F.col("p_size").cast("string"), F.col("gold_1"), F.col("prediction")).alias("item_key"))


@query("""
SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed, contains(text, 'content_filter') OR contains(text, 'content management policy') OR contains(text, 'ResponsibleAIPolicyViolation') AS refused, regexp_extract(source, '^(src)', 1) AS stem
FROM documents""")
def text_checks(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.collapse_blanks(F.col("text")).alias("collapsed"), text.refused(F.col("text")).alias("refused"), text.source_stem(F.regexp_replace("source", r"\d+$", "__judge-x.json")).alias("stem"))


# --- agreement ---

_ALIGNED = """aligned AS (SELECT source_file, item_key, judge, arg_max(verdict, ord) AS verdict FROM v_ratings WHERE decision_method NOT IN ('exact', 'no_llm', 'unmatched') GROUP BY ALL),
rated AS (SELECT source_file, item_key, count(*) AS n_raters, count(*) FILTER (WHERE verdict = 'yes') AS n_yes, count(*) FILTER (WHERE verdict = 'no') AS n_no FROM aligned GROUP BY ALL)"""
_PAIRS = """pairs AS (SELECT a.source_file, a.judge AS judge_1, b.judge AS judge_2, count(*) FILTER (WHERE a.verdict = 'yes' AND b.verdict = 'yes')::DOUBLE AS a, count(*) FILTER (WHERE a.verdict = 'yes' AND b.verdict = 'no')::DOUBLE AS b,
  count(*) FILTER (WHERE a.verdict = 'no' AND b.verdict = 'yes')::DOUBLE AS c, count(*) FILTER (WHERE a.verdict = 'no' AND b.verdict = 'no')::DOUBLE AS d
  FROM aligned a JOIN aligned b ON a.source_file = b.source_file AND a.item_key = b.item_key AND a.judge < b.judge GROUP BY ALL)"""
_ALL_PAIRS = f"{_PAIRS}, whole AS (SELECT judge_1, judge_2, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM pairs GROUP BY ALL)"
_KAPPA = """CASE WHEN ((a+b)*(a+c)+(c+d)*(b+d)) / ((a+b+c+d)*(a+b+c+d)) = 1 THEN CASE WHEN (a+d) = (a+b+c+d) THEN 1.0 ELSE 0.0 END
  ELSE ((a+d)/(a+b+c+d) - ((a+b)*(a+c)+(c+d)*(b+d)) / ((a+b+c+d)*(a+b+c+d))) / (1 - ((a+b)*(a+c)+(c+d)*(b+d)) / ((a+b+c+d)*(a+b+c+d))) END"""


def _ratings(spark, sf_dir):
    return agreement.aligned(load(spark, sf_dir, "v_ratings"))


@query(f"""WITH {_ALIGNED}, {_ALL_PAIRS}
SELECT judge_1, judge_2, a::BIGINT AS both_yes, b::BIGINT AS yes_no, c::BIGINT AS no_yes, d::BIGINT AS both_no, (a+b+c+d)::BIGINT AS n_items, round((a+d)/(a+b+c+d), 6) AS agreement, round({_KAPPA}, 6) AS kappa,
       round((a+b)/(a+b+c+d), 6) AS yes_rate_1, round((a+c)/(a+b+c+d), 6) AS yes_rate_2 FROM whole""")
def pairwise_kappa(spark, sf_dir):
    return shown(agreement.pairwise(_ratings(spark, sf_dir)))


@query(f"""WITH {_ALIGNED}, {_ALL_PAIRS}
SELECT round(avg(k), 6) AS mean_kappa, round(min(k), 6) AS min_kappa, round(max(k), 6) AS max_kappa, round(stddev_pop(k), 6) AS std_kappa, count(k) AS n_pairs FROM (SELECT {_KAPPA} AS k FROM whole) t""")
def kappa_summary(spark, sf_dir):
    return shown(agreement.kappa_summary(agreement.pairwise(_ratings(spark, sf_dir))))


@query(f"""WITH {_ALIGNED}, {_ALL_PAIRS}
SELECT judge_1, judge_2, CASE WHEN k < 0 THEN 'Poor' WHEN k < 0.21 THEN 'Slight' WHEN k < 0.41 THEN 'Fair' WHEN k < 0.61 THEN 'Moderate' WHEN k < 0.81 THEN 'Substantial' ELSE 'Almost Perfect' END AS band,
       CASE WHEN k < 0 THEN 'poor' WHEN k <= 0.2 THEN 'slight' WHEN k <= 0.4 THEN 'fair' WHEN k <= 0.6 THEN 'moderate' WHEN k <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS closed_band
FROM (SELECT *, {_KAPPA} AS k FROM whole) t""")
def kappa_bands(spark, sf_dir):
    pairs = agreement.pairwise(_ratings(spark, sf_dir))
    return pairs.select("judge_1", "judge_2", text.kappa_band(F.col("kappa")).alias("band"), text.kappa_band(F.col("kappa"), text.KAPPA_BANDS_CLOSED, True).alias("closed_band"))


@query(f"""WITH {_ALIGNED}, {_PAIRS}, k AS (SELECT source_file, {_KAPPA} AS k FROM pairs)
SELECT r.source_file, r.n_items, round(avg(k), 6) AS mean_kappa, round(min(k), 6) AS min_kappa, round(max(k), 6) AS max_kappa, count(k) AS n_pairs
FROM (SELECT source_file, count(*) AS n_items FROM rated WHERE n_raters >= 2 GROUP BY 1) r JOIN k ON k.source_file = r.source_file GROUP BY ALL""")
def per_source_kappa(spark, sf_dir):
    return shown(agreement.per_source(_ratings(spark, sf_dir)))


@query(f"""WITH {_ALIGNED}, s AS (SELECT count(*) AS n_items, avg((n_yes*n_yes + n_no*n_no - 5) / 20.0) AS po, sum(n_yes) / (5.0 * count(*)) AS y FROM rated WHERE n_raters = 5)
SELECT n_items, 5::BIGINT AS n_judges, round(po, 6) AS po, round(y*y + (1-y)*(1-y), 6) AS pe, round((po - (y*y + (1-y)*(1-y))) / (1 - (y*y + (1-y)*(1-y))), 6) AS kappa FROM s""")
def fleiss_kappa(spark, sf_dir):
    return shown(agreement.fleiss(agreement.items(_ratings(spark, sf_dir)), 5))


@query(f"""WITH {_ALIGNED}, s AS (SELECT count(*) AS n_items, sum(n_raters)::DOUBLE AS n, sum(n_yes)::DOUBLE AS y, sum(n_no)::DOUBLE AS k, sum(n_yes*n_no) / sum(n_raters*(n_raters-1)/2.0) AS o, count(*) FILTER (WHERE n_raters < 5) AS m FROM rated WHERE n_raters >= 2)
SELECT n_items, n::BIGINT AS n_ratings, m AS items_with_missing, round(o, 6) AS observed, round(1 - (y*(y-1) + k*(k-1)) / (n*(n-1)), 6) AS expected, round(1 - o / (1 - (y*(y-1) + k*(k-1)) / (n*(n-1))), 6) AS alpha FROM s""")
def krippendorff_alpha(spark, sf_dir):
    return shown(agreement.krippendorff(agreement.items(_ratings(spark, sf_dir)), 5))


@query(f"""WITH {_ALIGNED}, p AS (SELECT n_raters, string_agg(DISTINCT judge, ',' ORDER BY judge) AS judges_present FROM rated JOIN aligned USING (source_file, item_key) GROUP BY 1)
SELECT n_raters, count(*) AS n_items, count(*) FILTER (WHERE n_yes = 0 OR n_no = 0) AS full_agreement, count(*) FILTER (WHERE n_yes > 0 AND n_no > 0) AS any_disagreement, count(*) FILTER (WHERE n_raters = 5 AND (n_yes = 0 OR n_no = 0)) AS unanimous_all_judges, any_value(judges_present) AS judges_present
FROM rated JOIN p USING (n_raters) GROUP BY 1""")
def rater_coverage(spark, sf_dir):
    return agreement.coverage(agreement.items(_ratings(spark, sf_dir)), 5)


@query(f"""WITH {_ALIGNED}
SELECT CASE WHEN n_yes = 0 OR n_no = 0 THEN 'unanimous' WHEN n_yes > n_no THEN concat('majority_yes_', n_yes, '_of_', n_raters) WHEN n_no > n_yes THEN concat('majority_no_', n_no, '_of_', n_raters) ELSE concat('split_', n_yes, '_vs_', n_no) END AS pattern, count(*) AS n_items
FROM rated WHERE n_raters >= 2 GROUP BY 1""")
def disagreement_patterns(spark, sf_dir):
    return agreement.patterns(agreement.items(_ratings(spark, sf_dir)))


@query(f"""WITH {_ALIGNED}
SELECT source_file, item_key, n_raters, n_yes, n_no, string_agg(concat(judge, '=', verdict), ',' ORDER BY judge) AS votes FROM rated JOIN aligned USING (source_file, item_key) WHERE n_yes > 0 AND n_no > 0 GROUP BY ALL""")
def disagreement_list(spark, sf_dir):
    return agreement.disagreements(agreement.items(_ratings(spark, sf_dir)), None)


@query(f"""WITH {_ALIGNED}, h AS (SELECT source_file, item_key, verdict AS label FROM aligned WHERE judge = 'signup'), v AS (SELECT a.*, label FROM aligned a JOIN h USING (source_file, item_key) WHERE judge <> 'signup'),
i AS (SELECT source_file, item_key, any_value(label) AS label, count(*) FILTER (WHERE verdict = 'yes') AS y, count(*) FILTER (WHERE verdict = 'no') AS k FROM v GROUP BY ALL),
r AS (SELECT judge AS who, count(*) AS n_items, count(*) FILTER (WHERE verdict = label) AS n_correct, 0::BIGINT AS ties FROM v GROUP BY 1
  UNION ALL SELECT 'majority_vote', count(*) FILTER (WHERE y + k >= 2 AND y <> k), count(*) FILTER (WHERE y + k >= 2 AND y <> k AND label = CASE WHEN y > k THEN 'yes' ELSE 'no' END), count(*) FILTER (WHERE y + k >= 2 AND y = k) FROM i
  UNION ALL SELECT 'unanimous_vote', count(*) FILTER (WHERE y + k = 4 AND (y = 0 OR k = 0)), count(*) FILTER (WHERE y + k = 4 AND (y = 0 OR k = 0) AND label = CASE WHEN y > k THEN 'yes' ELSE 'no' END), 0 FROM i)
SELECT *, round(n_correct / nullif(n_items, 0)::DOUBLE, 6) AS accuracy FROM r""")
def human_comparison(spark, sf_dir):
    return shown(agreement.human_comparison(_ratings(spark, sf_dir), "signup"))


# --- runs and efficiency ---

_RUNS = f"""runs AS (SELECT model_short, condition, judge_model, seed, cv_fold, coalesce({_ACC}, 0) AS accuracy, count(*) AS n_examples, avg(latency_ms) AS latency_mean_ms, sum(latency_ms) AS latency_total_ms FROM v_judged GROUP BY ALL)"""
_ENTRIES = f"""entries AS (SELECT model_short, condition, judge_model, coalesce({_ACC}, 0) AS accuracy, count(*) AS n_examples, avg(latency_ms) AS latency_mean_ms, sum(latency_ms) AS latency_total_ms FROM v_judged GROUP BY ALL)"""
_SCORED = f"""{_ENTRIES}, lim AS (SELECT min(accuracy) AS la, max(accuracy) AS ha, min(latency_mean_ms) AS ll, max(latency_mean_ms) AS hl FROM entries),
scored AS (SELECT *, (accuracy - la) / (ha - la) AS an, 1 - (latency_mean_ms - ll) / (hl - ll) AS ln FROM entries, lim)"""


def _stats(spark, sf_dir, by):
    rows = load(spark, sf_dir, "v_judged")
    return rows.groupBy(*by).agg(*judging.metric_columns()[3:4], *judging.metric_columns()[11:13], F.count("*").alias("n_examples"), F.avg("latency_ms").alias("latency_mean_ms"), F.sum("latency_ms").alias("latency_total_ms"))


_GROUP = ["model_short", "condition", "judge_model"]


@query("""
SELECT model_short, condition, count(*) AS total_samples, count(*) FILTER (WHERE decision_method NOT IN ('unmatched', 'content_filtered')) AS successful, count(*) FILTER (WHERE decision_method IN ('unmatched', 'content_filtered')) AS failed,
       count(*) FILTER (WHERE decision_method = 'content_filtered') AS content_filtered, round(avg(latency_ms), 6) AS latency_mean_ms, round(min(latency_ms), 6) AS latency_min_ms, round(max(latency_ms), 6) AS latency_max_ms, round(sum(latency_ms), 6) AS latency_total_ms,
       round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS latency_p99_ms
FROM v_judged GROUP BY ALL""")
def run_stats(spark, sf_dir):
    return shown(runs.run_stats(_generated(spark, sf_dir), ["model_short", "condition"]))


def _generated(spark, sf_dir):
    """Judged rows as a run writes them: a refused one has an error and no output."""
    return load(spark, sf_dir, "v_judged").withColumns({"generated": F.when(F.col("decision_method").isin("unmatched", "content_filtered"), "").otherwise("x"), "generation_error": F.when(F.col("decision_method") == "content_filtered", "content_filter: no")})


@query("""SELECT model_short, condition, o_orderkey AS id FROM v_judged WHERE decision_method = 'content_filtered'""")
def refused_ids(spark, sf_dir):
    return runs.refused_ids(_generated(spark, sf_dir), ["model_short", "condition"], row_id="o_orderkey")


@query(f"""WITH {_RUNS}, long AS (SELECT model_short, condition, judge_model, CASE WHEN cv_fold IS NULL THEN 'canonical' ELSE 'cv' END AS split_type, unnest(['accuracy', 'latency_mean_ms', 'n_examples']) AS metric, unnest([accuracy, latency_mean_ms, n_examples::DOUBLE]) AS value FROM runs),
s AS (SELECT model_short, condition, judge_model, split_type, metric, avg(value) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(value) ELSE 0 END AS std, count(*) AS n FROM long GROUP BY ALL)
SELECT model_short, condition, judge_model, split_type, metric, round(mean, 5) AS mean, round(std, 5) AS std, n, round(std / sqrt(n), 5) AS sem, round(1.96 * std / sqrt(n), 5) AS ci95 FROM s""")
def seed_stats(spark, sf_dir):
    rows = runs.with_split_type(_stats(spark, sf_dir, [*_GROUP, "seed", "cv_fold"]))
    return shown(runs.seed_stats(rows, [*_GROUP, "split_type"], ["accuracy", "latency_mean_ms", "n_examples"]), 5)


@query(f"""WITH {_RUNS}
SELECT model_short, condition, CASE WHEN cv_fold IS NULL THEN 'canonical' ELSE 'cv' END AS split_type, count(DISTINCT seed) AS num_seeds, count(DISTINCT cv_fold) AS num_folds, count(*) AS num_runs, string_agg(DISTINCT judge_model, ',' ORDER BY judge_model) AS judge_models FROM runs GROUP BY ALL""")
def group_sizes(spark, sf_dir):
    rows = runs.with_split_type(_stats(spark, sf_dir, [*_GROUP, "seed", "cv_fold"]), combine_judges=True)
    return runs.group_sizes(rows, ["model_short", "condition", "split_type"])


@query(f"""WITH {_RUNS}, m AS (SELECT condition, judge_model, seed, model_short, avg(accuracy) AS x FROM runs GROUP BY ALL)
SELECT a.condition, a.judge_model, a.model_short AS model_1, b.model_short AS model_2, count(*) AS n_seeds, round(avg(a.x - b.x), 6) AS mean_delta, count(*) FILTER (WHERE a.x > b.x) AS wins, count(*) FILTER (WHERE a.x < b.x) AS losses, count(*) FILTER (WHERE a.x = b.x) AS ties
FROM m a JOIN m b ON a.condition = b.condition AND a.judge_model = b.judge_model AND a.seed = b.seed AND a.model_short < b.model_short GROUP BY ALL""")
def seed_pairs(spark, sf_dir):
    return shown(runs.seed_pairs(_stats(spark, sf_dir, [*_GROUP, "seed", "cv_fold"])))


@query(f"""WITH {_SCORED}
SELECT model_short, condition, judge_model, round(accuracy, 6) AS accuracy, round(latency_mean_ms, 4) AS latency_mean_ms, round(latency_total_ms / 1000, 4) AS duration_seconds, round(n_examples / (latency_total_ms / 1000), 4) AS throughput_samples_per_sec,
       round(accuracy / (latency_mean_ms / 1000), 4) AS accuracy_per_second, round(an, 5) AS accuracy_normalized, round(ln, 5) AS latency_normalized, round(0.6 * an + 0.4 * ln, 5) AS efficiency_score FROM scored""")
def efficiency_entries(spark, sf_dir):
    rows = efficiency.scored(efficiency.derived(_stats(spark, sf_dir, _GROUP)), 0.6, 0.4)
    r = lambda c, d: F.round(c, d).alias(c)
    return rows.select(*_GROUP, r("accuracy", 6), r("latency_mean_ms", 4), r("duration_seconds", 4), r("throughput_samples_per_sec", 4), r("accuracy_per_second", 4), r("accuracy_normalized", 5), r("latency_normalized", 5), r("efficiency_score", 5))


@query(f"""WITH {_ENTRIES}
SELECT model_short, condition, judge_model, round(accuracy, 6) AS accuracy, round(latency_mean_ms, 4) AS latency_mean_ms FROM entries e
WHERE NOT EXISTS (SELECT 1 FROM entries o WHERE o.accuracy >= e.accuracy AND o.latency_mean_ms <= e.latency_mean_ms AND (o.accuracy > e.accuracy OR o.latency_mean_ms < e.latency_mean_ms))""")
def pareto_frontier(spark, sf_dir):
    rows = efficiency.pareto(_stats(spark, sf_dir, _GROUP))
    return rows.select(*_GROUP, F.round("accuracy", 6).alias("accuracy"), F.round("latency_mean_ms", 4).alias("latency_mean_ms"))


@query("""
SELECT p_partkey, p_retailprice, p_size::BIGINT AS p_size FROM part e WHERE NOT EXISTS (
  SELECT 1 FROM part o WHERE o.p_size >= e.p_size AND o.p_retailprice <= e.p_retailprice AND (o.p_size > e.p_size OR o.p_retailprice < e.p_retailprice))""")
def pareto_parts(spark, sf_dir):
    return shown(efficiency.pareto(load(spark, sf_dir, "part"), "p_size", "p_retailprice").select("p_partkey", "p_retailprice", "p_size"), 10)


@query(f"""WITH {_ENTRIES}, f AS (SELECT DISTINCT model_short, condition FROM entries e WHERE NOT EXISTS (SELECT 1 FROM entries o WHERE o.accuracy >= e.accuracy AND o.latency_mean_ms <= e.latency_mean_ms AND (o.accuracy > e.accuracy OR o.latency_mean_ms < e.latency_mean_ms)))
SELECT model_short, condition, judge_model, EXISTS (SELECT 1 FROM f WHERE f.model_short = e.model_short AND f.condition = e.condition) AS on_frontier FROM entries e""")
def frontier_flags(spark, sf_dir):
    rows = _stats(spark, sf_dir, _GROUP)
    return efficiency.frontier_flags(rows, efficiency.pareto(rows).withColumn("judge_model", F.lit(None).cast("string"))).select(*_GROUP, "on_frontier")


@query(f"""WITH {_ENTRIES} SELECT row_number() OVER (ORDER BY accuracy DESC, model_short, condition, judge_model) AS rank, model_short, condition, judge_model, round(accuracy, 6) AS accuracy FROM entries ORDER BY rank LIMIT 5""")
def top_accuracy(spark, sf_dir):
    return shown(efficiency.top(_stats(spark, sf_dir, _GROUP), "accuracy").select("rank", *_GROUP, "accuracy"))


@query(f"""WITH {_SCORED}
SELECT CASE WHEN grouping(condition) = 0 THEN 'condition' ELSE 'model' END AS grouped_by, coalesce(condition, model_short) AS name, count(*) AS n_entries, round(avg(accuracy), 6) AS mean_accuracy, round(max(accuracy), 6) AS best_accuracy, round(avg(latency_mean_ms), 4) AS mean_latency_ms, round(avg((an + ln) / 2), 5) AS mean_score
FROM scored GROUP BY GROUPING SETS ((condition), (model_short))""")
def efficiency_groups(spark, sf_dir):
    rows = efficiency.grouped(efficiency.scored(_stats(spark, sf_dir, _GROUP)))
    return rows.select("grouped_by", "name", "n_entries", F.round("mean_accuracy", 6).alias("mean_accuracy"), F.round("best_accuracy", 6).alias("best_accuracy"), F.round("mean_latency_ms", 4).alias("mean_latency_ms"), F.round("mean_score", 5).alias("mean_score"))


@query("""WITH e AS (SELECT model_short, condition, judge_model, max(CASE WHEN judge_model <> 'A' THEN latency_ms END) AS l FROM v_judged GROUP BY ALL)
SELECT count(*) AS n_entries, count(DISTINCT model_short) AS n_models, count(DISTINCT condition) AS n_conditions, 0::BIGINT AS n_missing_accuracy, count(*) FILTER (WHERE l IS NULL) AS n_missing_latency, '' AS missing_accuracy,
       string_agg(CASE WHEN l IS NULL THEN concat(model_short, '/', condition, '/', judge_model) END, ',' ORDER BY concat(model_short, '/', condition, '/', judge_model)) AS missing_latency FROM e""")
def efficiency_totals(spark, sf_dir):
    return efficiency.totals(_without_latency(spark, sf_dir))


@query("""SELECT model_short, condition, judge_model, 'latency' AS missing FROM v_judged WHERE judge_model = 'A' GROUP BY ALL""")
def efficiency_missing(spark, sf_dir):
    return efficiency.missing(_without_latency(spark, sf_dir))


def _without_latency(spark, sf_dir):
    return _stats(spark, sf_dir, _GROUP).withColumn("latency_mean_ms", F.when(F.col("judge_model") != "A", F.col("latency_mean_ms")))


@query(f"""WITH {_ENTRIES}, m AS (SELECT model_short, condition, avg(accuracy) AS a FROM entries GROUP BY ALL)
SELECT model_short, round(max(a) FILTER (WHERE condition = 'F'), 6) AS F, round(max(a) FILTER (WHERE condition = 'O'), 6) AS O, round(max(a) FILTER (WHERE condition = 'P'), 6) AS P FROM m GROUP BY 1""")
def headline_accuracy(spark, sf_dir):
    return shown(report.headline(_stats(spark, sf_dir, _GROUP), ["F", "O", "P"]))


@query("""WITH e AS (SELECT model_short, condition, judge_model, count(*) FILTER (WHERE decision_method <> 'unmatched')::DOUBLE AS n, count(*) FILTER (WHERE decision_method <> 'unmatched' AND correct = 'yes') AS y, count(*) FILTER (WHERE decision_method = 'exact') AS x, count(*) FILTER (WHERE decision_method = 'llm' AND correct = 'yes') AS l FROM v_judged GROUP BY ALL)
SELECT model_short, condition, round(avg(y / n), 6) AS accuracy, round(avg(x / n), 6) AS from_exact_match, round(avg(l / n), 6) AS from_judge, round(avg(l / n) / avg(y / n), 6) AS judge_share FROM e GROUP BY ALL""")
def accuracy_decomposition(spark, sf_dir):
    return shown(report.decomposition(_stats(spark, sf_dir, _GROUP)))


@query(f"""WITH {_RUNS} SELECT count(DISTINCT model_short) AS n_models, count(DISTINCT condition) AS n_conditions, max(n_examples) AS max_examples, count(DISTINCT seed) AS n_seeds, count(DISTINCT cv_fold) AS n_folds, string_agg(DISTINCT judge_model, ',' ORDER BY judge_model) AS judges FROM runs""")
def setup_facts(spark, sf_dir):
    return report.setup_facts(_stats(spark, sf_dir, [*_GROUP, "seed", "cv_fold"]))


@query("""SELECT model_short, condition, concat(seed, '|', o_orderkey) AS unit_key, round(avg(CASE WHEN correct = 'yes' THEN 1.0 ELSE 0.0 END), 6) AS combined_score, count(*) AS n_votes FROM v_judged GROUP BY ALL""")
def item_scores(spark, sf_dir):
    return shown(significance.item_scores(_units(spark, sf_dir)))


def _units(spark, sf_dir):
    return load(spark, sf_dir, "v_judged").withColumn("unit_key", F.concat_ws("|", "seed", "o_orderkey"))


def _supplier_scores(spark, sf_dir):
    """Groups that share units: suppliers' return flags and line status by part."""
    rows = load(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'N', 'R')")
    rows = rows.select(F.col("l_returnflag").alias("model_short"), F.col("l_linestatus").alias("condition"), F.col("l_partkey").cast("string").alias("unit_key"), F.when(F.col("l_quantity") >= 25, "yes").otherwise("no").alias("correct"))
    return significance.item_scores(rows)


def _differences(spark, sf_dir):
    scores = _supplier_scores(spark, sf_dir)
    return significance.paired_differences(scores, ("A", "F"), _others(spark))


def _others(spark):
    return spark.createDataFrame([("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O")], "model_short string, condition string")


@query("""WITH s AS (SELECT l_returnflag AS model_short, l_linestatus AS condition, l_partkey, avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END) AS x FROM lineitem GROUP BY ALL)
SELECT b.model_short, b.condition, round(a.x - b.x, 6) AS diff, count(*) AS n FROM s a JOIN s b USING (l_partkey) WHERE a.model_short = 'A' AND a.condition = 'F' AND NOT (b.model_short = 'A' AND b.condition = 'F') GROUP BY ALL""")
def paired_differences(spark, sf_dir):
    rows = _differences(spark, sf_dir)
    return rows.groupBy("model_short", "condition", (F.round("diff", 6) + F.lit(0.0)).alias("diff")).agg(F.sum("n").alias("n"))


@query("""WITH s AS (SELECT l_returnflag AS model_short, l_linestatus AS condition, l_partkey, avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END) AS x FROM lineitem GROUP BY ALL),
d AS (SELECT b.model_short, b.condition, a.x - b.x AS diff FROM s a JOIN s b USING (l_partkey) WHERE a.model_short = 'A' AND a.condition = 'F' AND NOT (b.model_short = 'A' AND b.condition = 'F'))
SELECT model_short, condition, count(*) AS n_paired_items, round(avg(diff), 6) AS accuracy_difference, round(sqrt(sum(diff * diff)) / count(*), 6) AS flip_std FROM d GROUP BY ALL""")
def paired_moments(spark, sf_dir):
    return shown(significance.paired_moments(_differences(spark, sf_dir)).drop("flip_z"))


#: In twelfths; every sum's probability by a transform over a period that no sum can leave, added up in order.
@query("""WITH s AS (SELECT l_returnflag AS model_short, l_linestatus AS condition, l_partkey, round(12 * avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0.0 END))::BIGINT AS x FROM lineitem GROUP BY ALL),
d AS MATERIALIZED (SELECT b.model_short, b.condition, a.x - b.x AS a, count(*) AS k FROM s a JOIN s b USING (l_partkey) WHERE a.model_short = 'A' AND a.condition = 'F' AND NOT (b.model_short = 'A' AND b.condition = 'F') GROUP BY ALL),
g AS MATERIALIZED (SELECT model_short, condition, sum(k)::BIGINT AS n, sum(a * k)::BIGINT AS s, sum(a * a * k)::BIGINT AS q FROM d GROUP BY ALL),
per AS MATERIALIZED (SELECT *, (30 * ceil(sqrt(q)) + 2 * abs(s) + 30)::BIGINT AS p FROM g),
phi AS MATERIALIZED (SELECT model_short, condition, m, p, n, s, 2 * pi() * m / p AS t,
    exp(n * (ln(sum(k * cos(a * 2 * pi() * m / p)) ** 2 + sum(k * sin(a * 2 * pi() * m / p)) ** 2) / 2 - ln(n))) AS size, n * atan2(sum(k * sin(a * 2 * pi() * m / p)), sum(k * cos(a * 2 * pi() * m / p))) AS turn, product(power(cos(a * 2 * pi() * m / p), k)) AS flip
    FROM d JOIN (SELECT *, unnest(range(1, p)) AS m FROM per) USING (model_short, condition) GROUP BY model_short, condition, m, p, n, s),
pr AS (SELECT model_short, condition, j, (1 + sum(size * cos(turn - t * j))) / any_value(p) AS pr FROM (SELECT *, unnest(range(s - p // 2, s - p // 2 + p)) AS j FROM (SELECT * FROM phi WHERE size > 1e-18)) GROUP BY ALL),
c AS (SELECT *, sum(pr) OVER (PARTITION BY model_short, condition ORDER BY j) AS c FROM pr),
b AS (SELECT model_short, condition, min(j) FILTER (WHERE c >= 0.025) AS lo, min(j) FILTER (WHERE c >= 0.975) AS hi FROM c GROUP BY ALL),
f AS (SELECT model_short, condition, greatest(0, 1 - (2 * abs(any_value(s)) - 1 + sum(flip * sin((abs(s) - 0.5) * t) / sin(t / 2))) / any_value(p)) AS pv FROM phi WHERE s <> 0 GROUP BY model_short, condition)
SELECT model_short, condition, n AS n_paired_items, round(s / 12.0 / n, 6) AS accuracy_difference, round(lo / 12.0 / n, 6) AS ci95_low, round(hi / 12.0 / n, 6) AS ci95_high, round(coalesce(pv, 1.0), 6) AS randomization_p_value, 0::DOUBLE AS off_grid
FROM g JOIN b USING (model_short, condition) LEFT JOIN f USING (model_short, condition)""")
def paired_tests(spark, sf_dir):
    scores = _supplier_scores(spark, sf_dir).withColumn("combined_score", F.round(F.col("combined_score") * 12) / 12)
    return shown(significance.paired_tests(significance.paired_differences(scores, ("A", "F"), _others(spark))))


# --- datasets ---


def _hash_sql(space: str, key: str = "id") -> str:
    return f"sha256(concat_ws('|', '{SEED}', {space}, {key}::VARCHAR))"


_SPLIT = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_hash_sql("'split'")}, id) AS ordinal, count(*) OVER (PARTITION BY stratum) AS n FROM v_dataset),
parts AS (SELECT id, input, stratum, ordinal, CASE WHEN ordinal <= round_even(n * 0.7, 0) THEN 'train' WHEN ordinal <= round_even(n * 0.7, 0) + round_even(n * 0.1, 0) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


def _split(spark, sf_dir):
    return dataset.split(load(spark, sf_dir, "v_dataset"), "id", "stratum", 0.7, 0.1, 0.2, SEED)


@query(f"WITH {_SPLIT} SELECT id, stratum, split, ordinal FROM parts")
def split_membership(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "stratum", "split", "ordinal")


@query(f"WITH {_SPLIT} SELECT stratum, split, count(*) AS n FROM parts GROUP BY ALL")
def split_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("stratum", "split").agg(F.count("*").alias("n"))


@query(f"WITH {_SPLIT} SELECT split, ordinal, id::VARCHAR AS id, sha256(input) AS input_sha256, sha256(concat('[\"', stratum, '\"]')) AS outputs_sha256 FROM parts")
def split_manifest(spark, sf_dir):
    return dataset.split_manifest(_split(spark, sf_dir), "id", "input", F.array("stratum"))


_FOLDS = f"""f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY {_hash_sql("'fold'")}, id) - 1) % 5 AS fold FROM v_dataset)"""


@query(f"WITH {_FOLDS} SELECT id, stratum, fold FROM f")
def folds(spark, sf_dir):
    return shown(dataset.folds(load(spark, sf_dir, "v_dataset"), "id", "stratum", 5, SEED).select("id", "stratum", "fold"))


@query(f"""WITH {_FOLDS}, r AS (SELECT *, row_number() OVER (PARTITION BY fold = 2 ORDER BY {_hash_sql("'fold-2-validation'")}, id) AS k, count(*) OVER (PARTITION BY fold = 2) AS n FROM f)
SELECT id, CASE WHEN fold = 2 THEN 'test' WHEN k <= round_even(n * 0.1, 0) THEN 'validation' ELSE 'train' END AS split FROM r""")
def fold_split(spark, sf_dir):
    return dataset.fold_split(load(spark, sf_dir, "v_dataset"), "id", "stratum", 5, 2, 0.1, SEED).select("id", "split")


@query(f"""SELECT id, stratum FROM (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_hash_sql("'sample'")}, id) AS k FROM v_dataset) t ORDER BY k, stratum LIMIT 40""")
def covering_sample(spark, sf_dir):
    return dataset.covering_sample(load(spark, sf_dir, "v_dataset"), "id", "stratum", 40, SEED).select("id", "stratum")


@query("SELECT id, stratum FROM v_dataset WHERE lower(trim(input)) NOT IN (SELECT lower(trim(text)) FROM documents WHERE doc_id % 7 = 0)")
def without_exemplars(spark, sf_dir):
    held = load(spark, sf_dir, "documents").where("doc_id % 7 = 0")
    return dataset.without_exemplars(load(spark, sf_dir, "v_dataset"), held, "input", "text").select("id", "stratum")


@query(f"SELECT item_id FROM benchmark ORDER BY {_hash_sql(chr(39) + 'exemplars' + chr(39), 'item_id')}, item_id LIMIT 8")
def exemplar_choice(spark, sf_dir):
    return dataset.exemplar_choice(load(spark, sf_dir, "benchmark"), "item_id", 8, SEED).select("item_id")


_AUGMENT = (("the ", ("this ", "that ")), ("de ", ("du ", "des ", "d' ")))
_PICK = "('0x' || substr(md5(concat_ws('|', '42', id::VARCHAR, copy::VARCHAR)), 1, 8))::BIGINT"


@query(f"""SELECT id, copy, CASE WHEN copy = 0 THEN input
  WHEN instr(lower(input), 'the ') > 0 THEN concat(substr(input, 1, instr(lower(input), 'the ') - 1), CASE {_PICK} % 2 WHEN 0 THEN 'this ' ELSE 'that ' END, substr(input, instr(lower(input), 'the ') + 4))
  WHEN instr(lower(input), 'de ') > 0 THEN concat(substr(input, 1, instr(lower(input), 'de ') - 1), CASE {_PICK} % 3 WHEN 0 THEN 'du ' WHEN 1 THEN 'des ' ELSE 'd'' ' END, substr(input, instr(lower(input), 'de ') + 3)) ELSE input END AS input
FROM v_dataset, (SELECT unnest([0, 1, 2])::BIGINT AS copy) c""")
def augmented(spark, sf_dir):
    return shown(dataset.augmented(load(spark, sf_dir, "v_dataset"), "id", 3, SEED, _AUGMENT).select("id", "copy", "input"))


_FULL = """CASE model_type WHEN 'qwen' THEN concat('<|im_start|>system', chr(10), 'Be brief.<|im_end|>', chr(10), '<|im_start|>user', chr(10), 'Say it.<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), text, '<|im_end|>')
  WHEN 'mistral' THEN concat('<s>[INST] Be brief.', chr(10), chr(10), 'Say it. [/INST] ', text, '</s>')
  WHEN 'phi3' THEN concat('<|system|>', chr(10), 'Be brief.<|end|>', chr(10), '<|user|>', chr(10), 'Say it.<|end|>', chr(10), '<|assistant|>', chr(10), text, '<|end|>')
  ELSE concat('System:', chr(10), 'Be brief.', chr(10), chr(10), 'User:', chr(10), 'Say it.', chr(10), chr(10), 'Assistant:', chr(10), text) END"""


@query(f"""SELECT model_type AS kind, count(*) AS n_over, max(t) AS longest, list_slice(list_sort(list(DISTINCT conv_id)), 1, 20) AS examples FROM (SELECT *, greatest(1, length({_FULL}) // 4) AS t FROM v_chat) x WHERE t > 60 GROUP BY 1""")
def over_length_prompts(spark, sf_dir):
    pairs = dataset.supervised_pairs(load(spark, sf_dir, "v_chat"), F.col("model_type"), F.lit("Be brief."), F.lit("Say it."), F.array("text"))
    return shown(dataset.over_length(pairs, F.col("model_type"), "conv_id", 60))


@query("""SELECT conv_id, turn, concat(CASE WHEN model_type = 'mistral' THEN ' ' ELSE '' END, text, CASE model_type WHEN 'qwen' THEN '<|im_end|>' WHEN 'mistral' THEN '</s>' WHEN 'phi3' THEN '<|end|>' ELSE '' END) AS completion, true AS starts_with_prompt FROM v_chat""")
def supervised_pairs(spark, sf_dir):
    rows = load(spark, sf_dir, "v_chat")
    return dataset.supervised_pairs(rows, F.col("model_type"), F.lit("Be brief."), F.lit("Say it."), F.array("text")).select("conv_id", "turn", "completion", "starts_with_prompt")


# --- audits and annotations ---

QUOTAS = {"disagree_click_no_purchase_yes": 33, "disagree_click_yes_purchase_no": 400, "llm_agree_yes": 120, "llm_agree_no": 120}
PRIORITY = ("disagree_click_yes_purchase_no", "llm_agree_yes", "llm_agree_no", "exact_match", "disagree_click_no_purchase_yes")
JUDGES = ("click", "purchase")

_POP = """pop AS (SELECT concat(source_file, '/', item_key) AS population_key, arg_min(source_file, ord) AS source_file, arg_max(verdict, ord) FILTER (WHERE judge = 'click') AS v0, arg_max(verdict, ord) FILTER (WHERE judge = 'purchase') AS v1,
  arg_max(decision_method, ord) FILTER (WHERE judge = 'click') AS m0, arg_max(decision_method, ord) FILTER (WHERE judge = 'purchase') AS m1 FROM v_ratings WHERE judge IN ('click', 'purchase') GROUP BY 1 HAVING count(DISTINCT judge) = 2),
strata AS (SELECT *, CASE WHEN m0 = 'exact' OR m1 = 'exact' THEN 'exact_match' WHEN v0 = 'yes' AND v1 = 'yes' THEN 'llm_agree_yes' WHEN v0 = 'no' AND v1 = 'no' THEN 'llm_agree_no' WHEN v0 = 'yes' THEN 'disagree_click_yes_purchase_no' ELSE 'disagree_click_no_purchase_yes' END AS primary_stratum FROM pop)"""


def _population(spark, sf_dir):
    rows = load(spark, sf_dir, "v_ratings").withColumn("population_key", F.concat("source_file", F.lit("/"), "item_key"))
    pop = audit.population(rows, JUDGES)
    stratum = audit.decision_stratum(F.col("v_0"), F.col("v_1"), [F.col("m_0"), F.col("m_1")], JUDGES)
    unit = F.substring_index(F.substring_index("population_key", "/", -1), "|", 1)
    return pop.withColumns({"primary_stratum": stratum, "source_stratum": audit.source_stratum(F.col("source_file")), "annotation_unit_key": unit})


@query(f"WITH {_POP} SELECT population_key, primary_stratum, source_file AS source_stratum FROM strata")
def audit_strata(spark, sf_dir):
    return _population(spark, sf_dir).select("population_key", "primary_stratum", "source_stratum")


_QUOTA_SQL = f"""{_POP}, want(stratum, asked, pr) AS (VALUES {', '.join(f"('{s}', {QUOTAS.get(s, 0)}, {i})" for i, s in enumerate(PRIORITY))}),
have AS (SELECT stratum, asked, pr, coalesce(n, 0) AS n, least(asked, coalesce(n, 0)) AS cut FROM want LEFT JOIN (SELECT primary_stratum AS stratum, count(*) AS n FROM strata GROUP BY 1) c USING (stratum)),
quotas AS (SELECT stratum, (cut + least(n - cut, greatest(0, (sum(asked) OVER () - sum(cut) OVER ()) - coalesce(sum(n - cut) OVER (ORDER BY pr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS quota FROM have)"""


def _quotas(spark, sf_dir):
    return audit.resolved_quotas(_population(spark, sf_dir).groupBy(F.col("primary_stratum").alias("stratum")).agg(F.count("*").alias("n")), QUOTAS, PRIORITY)


@query(f"WITH {_QUOTA_SQL} SELECT stratum, quota FROM quotas")
def audit_quotas(spark, sf_dir):
    return shown(_quotas(spark, sf_dir))


_SHARES = f"""{_QUOTA_SQL}, g AS (SELECT primary_stratum, source_file AS source_stratum, count(*) AS n, any_value(quota) AS quota FROM strata JOIN quotas ON primary_stratum = stratum GROUP BY 1, 2),
b AS (SELECT *, quota * n / (sum(n) OVER w)::DOUBLE AS raw, least(n, floor(quota * n / (sum(n) OVER w)::DOUBLE))::BIGINT AS base, (least(quota, sum(n) OVER w))::BIGINT AS total FROM g WINDOW w AS (PARTITION BY primary_stratum)),
c AS (SELECT *, (total - sum(base) OVER (PARTITION BY primary_stratum))::BIGINT AS rem FROM b),
u AS (SELECT *, unnest(range(greatest(0, least(n - base, rem)))) AS i FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY primary_stratum ORDER BY raw - floor(raw) DESC, n - base - i DESC, source_stratum DESC) AS k FROM u),
shares AS (SELECT c.primary_stratum, c.source_stratum, c.base + (SELECT count(*) FROM k WHERE k.primary_stratum = c.primary_stratum AND k.source_stratum = c.source_stratum AND k.k <= k.rem) AS allocation FROM c)"""


@query(f"WITH {_SHARES} SELECT primary_stratum, source_stratum, allocation FROM shares")
def audit_shares(spark, sf_dir):
    sizes = _population(spark, sf_dir).groupBy("primary_stratum", "source_stratum").agg(F.count("*").alias("n"))
    return audit.apportioned(sizes.join(_quotas(spark, sf_dir).withColumnRenamed("stratum", "primary_stratum"), "primary_stratum"), ["primary_stratum"], "source_stratum")


@query(f"""WITH {_SHARES}, r AS (SELECT *, row_number() OVER (PARTITION BY primary_stratum, source_file ORDER BY {_hash_sql("concat('primary:', primary_stratum)", "population_key")}, population_key) AS k FROM strata)
SELECT population_key, r.primary_stratum FROM r JOIN shares s ON r.primary_stratum = s.primary_stratum AND r.source_file = s.source_stratum WHERE k <= allocation""")
def audit_bucket_sample(spark, sf_dir):
    return audit.bucket_sample(_population(spark, sf_dir), _quotas(spark, sf_dir), "population_key", SEED).select("population_key", "primary_stratum")


def _case(column: str, names, other: int) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names))} ELSE {other} END"


_PLACE = _case("primary_stratum", list(dict.fromkeys([*QUOTAS, *PRIORITY])), 99)
_KEYED = """SELECT population_key, primary_stratum, source_file AS source_stratum, split_part(split_part(population_key, '/', 2), '|', 1) AS unit"""


def _free_sql(space: str, taken: str) -> str:
    """One row of each unit that isn't taken: the first by place and hash."""
    h = _hash_sql(f"'{space}'", "population_key")
    return f"""SELECT *, {h} AS h FROM ({_KEYED} FROM strata) x WHERE unit NOT IN (SELECT unit FROM {taken}) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY {_PLACE}, {h}, population_key) = 1"""


@query(f"""WITH {_SHARES}, r AS (SELECT *, {_hash_sql("concat('primary:', primary_stratum)", "population_key")} AS h FROM strata),
r2 AS (SELECT *, row_number() OVER (PARTITION BY primary_stratum, source_file ORDER BY h, population_key) AS k FROM r),
picked AS (SELECT r2.* FROM r2 JOIN shares s ON r2.primary_stratum = s.primary_stratum AND r2.source_file = s.source_stratum WHERE k <= allocation),
t1 AS ({_KEYED} FROM picked QUALIFY row_number() OVER (PARTITION BY split_part(split_part(population_key, '/', 2), '|', 1) ORDER BY {_PLACE}, h, population_key) = 1),
f1 AS ({_free_sql('unique-fill', 't1')}),
m1 AS (SELECT f1.population_key, f1.primary_stratum, f1.source_stratum, f1.unit FROM (SELECT *, row_number() OVER (PARTITION BY primary_stratum ORDER BY h, population_key) AS k FROM f1) f1
       JOIN (SELECT stratum, quota - (SELECT count(*) FROM t1 WHERE t1.primary_stratum = stratum) AS gap FROM quotas) g ON g.stratum = f1.primary_stratum WHERE k <= gap),
t2 AS (SELECT * FROM t1 UNION ALL SELECT * FROM m1),
f2 AS ({_free_sql('global-unique-fill', 't2')}),
m2 AS (SELECT population_key, primary_stratum, source_stratum, unit FROM (SELECT *, row_number() OVER (ORDER BY {_case('primary_stratum', PRIORITY, 99)}, h, population_key) AS k FROM f2) f2 WHERE k <= (SELECT sum(quota) FROM quotas) - (SELECT count(*) FROM t2)),
t3 AS (SELECT * FROM t2 UNION ALL SELECT * FROM m2),
o AS (SELECT *, row_number() OVER (ORDER BY {_hash_sql("'presentation'", "population_key")}, population_key) AS presentation_order FROM t3)
SELECT concat('AUDIT-', lpad(presentation_order::VARCHAR, 4, '0')) AS audit_id, presentation_order, population_key, unit AS annotation_unit_key, primary_stratum, source_stratum,
       round((SELECT count(*) FROM strata s WHERE s.primary_stratum = o.primary_stratum) / (SELECT count(*) FROM t3 WHERE t3.primary_stratum = o.primary_stratum)::DOUBLE, 6) AS sampling_weight FROM o""")
def audit_sample(spark, sf_dir):
    rows = staged(_population(spark, sf_dir), "population")
    sample = audit.audit_sample(rows, QUOTAS, PRIORITY, SEED)
    items = audit.key_items(audit.with_audit_ids(sample, SEED), audit.stratum_weights(rows, sample))
    return shown(items.select("audit_id", "presentation_order", "population_key", "annotation_unit_key", "primary_stratum", "source_stratum", F.col("sampling_weight_primary").alias("sampling_weight")))


@query(f"""WITH p AS (SELECT id, {_BIN} AS complexity_bin {_PROFILED}) SELECT complexity_bin, count(*) AS population, count(*) FILTER (WHERE p_size > 40) AS sampled FROM p JOIN (SELECT id, p_size FROM v_formula) f USING (id) GROUP BY 1""")
def complexity_counts(spark, sf_dir):
    rows = load(spark, sf_dir, "v_formula").withColumn("profile", text.formula_profile(_golds(), F.col("prediction"))).withColumn("complexity_bin", F.col("profile.complexity_bin"))
    return audit.complexity_counts(rows, rows.where("p_size > 40"))


@query(f"""WITH p AS (SELECT id, {_BIN} AS complexity_bin {_PROFILED}), r AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'llm_agree_yes' WHEN p_size % 3 = 1 THEN 'llm_agree_no' ELSE 'exact_match' END AS st, concat('run_', p_size) AS f FROM v_formula JOIN p USING (id) WHERE p_size <= 20)
SELECT row_number() OVER (ORDER BY {_hash_sql("'presentation'", "id")}, id) AS presentation_order, id AS population_key, st AS primary_stratum, f AS source_stratum, round((SELECT count(*) FROM v_formula v WHERE v.p_size % 3 = r.p_size % 3) / (SELECT count(*) FROM r x WHERE x.st = r.st)::DOUBLE, 6) AS sampling_weight_primary, f AS run_id, id AS item_id, sha256(f) AS source_sha256, complexity_bin, input, gold, len(gold_options) AS n_golds, prediction,
       CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS first_decision, CASE WHEN p_size % 5 = 0 THEN 'exact' ELSE 'llm' END AS second_method, git_commit IS NULL AS no_commit
FROM (SELECT *, concat('Q', id) AS input, array_to_string(CASE WHEN gold_2 IS NULL THEN [trim(gold_1)] ELSE [trim(gold_1), trim(gold_2)] END, chr(10)) AS gold, CASE WHEN gold_2 IS NULL THEN [gold_1] ELSE [gold_1, gold_2] END AS gold_options, NULL AS git_commit FROM r) r""")
def audit_key(spark, sf_dir):
    """Every field a reviewer joins on, from a sample that has most of them."""
    name = F.concat(F.lit("run_"), F.col("p_size").cast("string"))
    rows = load(spark, sf_dir, "v_formula").withColumns({"population_key": F.col("id"), "annotation_unit_key": F.col("id"), "item_id": F.col("id"), "primary_stratum": F.when(F.col("p_size") % 3 == 0, "llm_agree_yes").when(F.col("p_size") % 3 == 1, "llm_agree_no").otherwise("exact_match"), "source_stratum": name, "source_file": name, "run_id": name, "source_sha256": F.sha2(name, 256), "gold_options": _golds(), "gold": F.array_join(_golds(), "\n"), "input": F.concat(F.lit("Q"), "id"), "formula_profile": text.formula_profile(_golds(), F.col("prediction"))})
    rows = rows.withColumns({"v_0": F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no"), "v_1": F.lit("no"), "m_0": F.lit("llm"), "m_1": F.when(F.col("p_size") % 5 == 0, "exact").otherwise("llm")})
    rows = rows.withColumn("judge_decisions", audit.decisions(["a", "b"], {"decision": ["v_0", "v_1"], "method": ["m_0", "m_1"]}))
    sample = audit.with_audit_ids(rows.where("p_size <= 20"), SEED)
    out = audit.key_items(sample, audit.stratum_weights(rows, sample))
    kept = ["presentation_order", "population_key", "primary_stratum", "source_stratum", "sampling_weight_primary", "run_id", "item_id", "source_sha256"]
    return out.select(*kept, F.col("formula_profile.complexity_bin").alias("complexity_bin"), "input", "gold", F.size("gold_options").cast("long").alias("n_golds"), "prediction", F.col("judge_decisions")["a"]["decision"].alias("first_decision"), F.col("judge_decisions")["b"]["method"].alias("second_method"), F.col("git_commit").isNull().alias("no_commit"))


@query(f"""WITH {_POP} SELECT concat('DIS-', lpad(row_number() OVER (ORDER BY {_hash_sql("'presentation'", "population_key")}, population_key)::VARCHAR, 4, '0')) AS audit_id, population_key FROM strata WHERE primary_stratum LIKE 'disagree_%'""")
def disagreement_pool(spark, sf_dir):
    return audit.disagreement_pool(_population(spark, sf_dir), SEED).select("audit_id", "population_key")


@query("SELECT id AS audit_id, concat('Q', id) AS input, gold_1, coalesce(gold_2, '') AS gold_2, prediction, '' AS correct, '' AS annotator_id FROM v_formula")
def blind_items(spark, sf_dir):
    rows = load(spark, sf_dir, "v_formula").withColumns({"audit_id": F.col("id"), "input": F.concat(F.lit("Q"), "id")})
    return audit.blind(rows, _golds())


_HUMAN = """lab AS (SELECT audit_id, annotator_id, ord, CASE WHEN lower(trim(correct)) IN ('yes', 'y', 'true', '1') THEN 'yes' WHEN lower(trim(correct)) IN ('no', 'n', 'false', '0') THEN 'no' ELSE '' END AS label FROM v_annotation),
h AS (SELECT audit_id, count(*) FILTER (WHERE own) AS n_human_labels, count(*) FILTER (WHERE own AND label = 'yes') AS n_human_yes, count(*) FILTER (WHERE own AND label = 'no') AS n_human_no, arg_max(label, ord) FILTER (WHERE fin AND label <> '') AS f,
      coalesce(arg_max(label, ord) FILTER (WHERE own AND annotator_id = 'annotator_1'), '') AS annotator_1_correct, coalesce(arg_max(label, ord) FILTER (WHERE own AND annotator_id = 'annotator_2'), '') AS annotator_2_correct
      FROM (SELECT *, annotator_id = 'adjudicator' AS fin, annotator_id <> 'adjudicator' AND label <> '' AS own FROM lab) l GROUP BY 1),
s AS (SELECT *, CASE WHEN n_human_labels = 0 THEN 'unannotated' WHEN n_human_labels = 1 THEN 'single_annotation' WHEN n_human_yes = 0 OR n_human_no = 0 THEN 'agreement' ELSE 'disagreement' END AS human_status FROM h),
human AS (SELECT *, CASE WHEN human_status = 'disagreement' AND f IS NULL THEN 'yes' ELSE 'no' END AS needs_adjudication,
  CASE human_status WHEN 'agreement' THEN CASE WHEN n_human_yes > 0 THEN 'yes' ELSE 'no' END WHEN 'disagreement' THEN 'no_consensus' ELSE human_status END AS human_consensus_correct,
  coalesce(f, CASE human_status WHEN 'agreement' THEN CASE WHEN n_human_yes > 0 THEN 'yes' ELSE 'no' END WHEN 'disagreement' THEN 'pending_adjudication' WHEN 'single_annotation' THEN 'pending_second_annotation' ELSE 'unannotated' END) AS human_final_correct FROM s)"""
_MERGED = f"""{_HUMAN}, m AS (SELECT k.*, coalesce(human_status, 'unannotated') AS human_status, coalesce(needs_adjudication, 'no') AS needs_adjudication, coalesce(human_consensus_correct, 'unannotated') AS human_consensus_correct, coalesce(human_final_correct, 'unannotated') AS human_final_correct,
  coalesce(n_human_labels, 0) AS n_human_labels, coalesce(n_human_yes, 0) AS n_human_yes, coalesce(n_human_no, 0) AS n_human_no, coalesce(annotator_1_correct, '') AS annotator_1_correct, coalesce(annotator_2_correct, '') AS annotator_2_correct FROM v_key k LEFT JOIN human USING (audit_id))"""


def _match_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} IN ('yes', 'no') THEN CASE WHEN {a} = {b} THEN 'yes' ELSE 'no' END ELSE {a} END"


def _merged(spark, sf_dir):
    return annotations.merged(load(spark, sf_dir, "v_key"), annotations.consolidated(load(spark, sf_dir, "v_annotation")), ["judge_a", "judge_b"])


@query(f"WITH {_HUMAN} SELECT audit_id, human_status, needs_adjudication, human_consensus_correct, human_final_correct, n_human_labels, n_human_yes, n_human_no FROM human")
def human_labels(spark, sf_dir):
    return annotations.consolidated(load(spark, sf_dir, "v_annotation")).drop("human_labels", "annotator_ids", "labels_by_annotator")


@query(f"""WITH {_MERGED}
SELECT audit_id, model_short, condition, human_status, human_final_correct, annotator_1_correct, annotator_2_correct, {_match_sql('human_final_correct', 'judge_a')} AS human_matches_judge_a, {_match_sql('human_final_correct', 'judge_b')} AS human_matches_judge_b,
       CASE WHEN judge_a = 'yes' THEN n_human_yes ELSE n_human_no END AS n_human_matches_judge_a, round(CASE WHEN judge_b = 'yes' THEN n_human_yes ELSE n_human_no END / nullif(n_human_labels, 0)::DOUBLE, 6) AS human_match_rate_judge_b,
       CASE WHEN annotator_1_correct = '' THEN '' ELSE {_match_sql('annotator_1_correct', 'judge_a')} END AS annotator_1_matches_judge_a, CASE WHEN judge_a = judge_b THEN 'yes' ELSE 'no' END AS llm_judges_agree FROM m""")
def human_matches(spark, sf_dir):
    cols = ["audit_id", "model_short", "condition", "human_status", "human_final_correct", "annotator_1_correct", "annotator_2_correct", "human_matches_judge_a", "human_matches_judge_b", "n_human_matches_judge_a", "human_match_rate_judge_b", "annotator_1_matches_judge_a", "llm_judges_agree"]
    return shown(_merged(spark, sf_dir).select(*cols))


def _measure(name: str, n: str, k: str) -> str:
    return f"SELECT '{name}' AS measure, ({n})::BIGINT AS n, ({k})::BIGINT AS matches FROM m"


_FINAL = "human_final_correct IN ('yes', 'no')"
_MEASURES = " UNION ALL ".join(
    [
        *(_measure(f"final_vs_{j}", f"count(*) FILTER (WHERE {_FINAL})", f"count(*) FILTER (WHERE {_FINAL} AND human_final_correct = {j})") for j in ("judge_a", "judge_b")),
        *(_measure(f"labels_vs_{j}", "sum(n_human_labels)", f"sum(CASE WHEN {j} = 'yes' THEN n_human_yes ELSE n_human_no END)") for j in ("judge_a", "judge_b")),
        _measure("judges", "count(*)", "count(*) FILTER (WHERE judge_a = judge_b)"),
        _measure("annotators", "count(*) FILTER (WHERE annotator_1_correct <> '' AND annotator_2_correct <> '')", "count(*) FILTER (WHERE annotator_1_correct <> '' AND annotator_1_correct = annotator_2_correct)"),
    ]
)


@query(f"WITH {_MERGED} SELECT *, round(matches / nullif(n, 0)::DOUBLE, 6) AS agreement_rate FROM ({_MEASURES}) x")
def human_summary(spark, sf_dir):
    return shown(annotations.merge_summary(_merged(spark, sf_dir), ["judge_a", "judge_b"]))


@query(f"WITH {_MERGED} SELECT human_status, count(*) AS n_items, count(*) FILTER (WHERE needs_adjudication = 'yes') AS n_needs_adjudication FROM m GROUP BY 1")
def human_status_counts(spark, sf_dir):
    return annotations.status_counts(_merged(spark, sf_dir))


# --- the judge ---


def stub_scorer(prompts: pd.Series) -> pd.DataFrame:
    """Stands for a model: yes where the prompt has an even number of characters, refuses long ones."""
    size = prompts.str.len()
    return pd.DataFrame({"response": ['{"correct": "yes"}' if n % 2 == 0 else "Correct: no" for n in size], "refused": size > 160})


@query(f"""WITH r AS (SELECT id, {_MATCH} AS matched, concat('Gold: ', CASE WHEN gold_2 IS NULL THEN gold_1 ELSE concat('1. ', gold_1, chr(10), '2. ', gold_2) END, chr(10), 'Answer: ', prediction) AS prompt, trim(prediction) = '' AS none FROM v_formula),
q AS (SELECT *, length(prompt) AS l, min(id) FILTER (WHERE NOT none AND NOT matched) OVER (PARTITION BY prompt) AS first FROM r)
SELECT id, CASE WHEN none THEN 'unmatched' WHEN matched THEN 'exact' WHEN l > 160 THEN 'content_filtered' ELSE 'llm' END AS decision_method,
       CASE WHEN none THEN 'no' WHEN matched THEN 'yes' WHEN l > 160 THEN 'no' WHEN l % 2 = 0 THEN 'yes' ELSE 'no' END AS correct, NOT none AND NOT matched AND id > first AS from_cache FROM q""")
def judged_predictions(spark, sf_dir):
    rows = load(spark, sf_dir, "v_formula").withColumns({"golds": _golds(), "input": F.lit("")})
    return judging.evaluate(rows, stub_scorer, _TEMPLATE, order="id").select("id", "decision_method", "correct", "from_cache")


@query("""SELECT judge, verdict, count(*) AS n FROM (SELECT judge, verdict FROM v_ratings UNION ALL SELECT 'human', CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END FROM labels) t GROUP BY ALL""")
def ratings_with_humans(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("input"), F.lit("").alias("gold"), F.lit("p").alias("prediction"), F.col("quality").alias("correct"))
    human = agreement.human_rows(labels, F.lit("labels"), ["input"], ["gold"], ["prediction"])
    return agreement.merged(load(spark, sf_dir, "v_ratings"), human).groupBy("judge", "verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {_ALIGNED}, {_ALL_PAIRS},
f AS (SELECT count(*) AS n, avg((n_yes*n_yes + n_no*n_no - 5) / 20.0) AS po, sum(n_yes) / (5.0 * count(*)) AS y FROM rated WHERE n_raters = 5),
s AS (SELECT count(*) AS c, sum(n_raters)::DOUBLE AS n, sum(n_yes)::DOUBLE AS y, sum(n_no)::DOUBLE AS k, sum(n_yes*n_no) / sum(n_raters*(n_raters-1)/2.0) AS o FROM rated WHERE n_raters >= 2)
SELECT concat('cohen_', judge_1, '_', judge_2) AS measure, (a+b+c+d)::BIGINT AS n, round({_KAPPA}, 6) AS value FROM whole
UNION ALL SELECT 'fleiss', n, round((po - (y*y + (1-y)*(1-y))) / (1 - (y*y + (1-y)*(1-y))), 6) FROM f
UNION ALL SELECT 'krippendorff', c, round(1 - o / (1 - (y*(y-1) + k*(k-1)) / (n*(n-1))), 6) FROM s
UNION ALL SELECT concat('human_', a.judge), count(*), round(avg((a.verdict = h.verdict)::INT), 6) FROM aligned a JOIN aligned h USING (source_file, item_key) WHERE h.judge = 'signup' AND a.judge <> 'signup' GROUP BY a.judge""")
def reliability(spark, sf_dir):
    ratings = _ratings(spark, sf_dir)
    rated = agreement.items(ratings)
    human = agreement.human_comparison(ratings, "signup").where("who not like '%_vote'")
    return shown(report.reliability(agreement.pairwise(ratings), agreement.fleiss(rated, 5), agreement.krippendorff(rated, 5), human))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice / 1000 END AS d, CASE WHEN o_custkey % 3 = 1 THEN 0.25 END AS e FROM orders),
s AS (SELECT l_orderkey, count(*) AS n, avg(CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0.0 END) AS a, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1)
SELECT o_orderkey AS run_id, n AS n_examples, round(coalesce(e, a), 6) AS accuracy, round(coalesce(d * 1000, t), 6) AS latency_total_ms, round(coalesce(d * 1000, t) / n, 6) AS latency_mean_ms FROM r LEFT JOIN s ON l_orderkey = o_orderkey""")
def run_entries(spark, sf_dir):
    third = F.col("o_custkey") % 3
    none = F.lit(None).cast("double")
    head = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(third == 0, F.col("o_totalprice") / 1000).alias("duration_seconds"), F.when(third == 1, 0.25).alias("exact_match"), none.alias("latency_total_ms"), none.alias("latency_mean_ms"), F.lit(0).cast("long").alias("n_examples"), F.lit(None).cast("long").alias("total_samples"))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") == 1).cast("int").alias("exact_match"), F.col("l_extendedprice").alias("latency_ms"))
    out = efficiency.run_entry(head, rows)
    return out.select("run_id", "n_examples", F.round("accuracy", 6).alias("accuracy"), F.round("latency_total_ms", 6).alias("latency_total_ms"), F.round("latency_mean_ms", 6).alias("latency_mean_ms"))


@query("""SELECT c_custkey, round(coalesce(j, e), 4) AS accuracy, CASE WHEN j IS NOT NULL THEN 'judge_summary' WHEN e IS NOT NULL THEN 'exact_match' END AS accuracy_source
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS e FROM customer) c LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS j FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey""")
def accuracy_sources(spark, sf_dir):
    head = load(spark, sf_dir, "customer").select(F.col("c_custkey"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("exact_match"))
    summary = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("accuracy"))
    return shown(efficiency.with_judge_accuracy(head, summary, "c_custkey").select("c_custkey", "accuracy", "accuracy_source"), 4)


@query("""SELECT source_file, k.mean_kappa, count(*) AS n_rows FROM (SELECT source_file FROM v_ratings) r LEFT JOIN (SELECT DISTINCT concat('run_', user_id % 12) AS source_file, (user_id % 12) / 10.0::DOUBLE AS mean_kappa FROM events WHERE user_id % 12 < 9) k USING (source_file) GROUP BY ALL""")
def runs_with_agreement(spark, sf_dir):
    rows = load(spark, sf_dir, "v_ratings").select(F.concat("source_file", F.lit("__judge-a.json")).alias("file"))
    scores = load(spark, sf_dir, "events").where("user_id % 12 < 9").select(F.concat(F.lit("run_"), (F.col("user_id") % 12).cast("string"), F.lit(".json")).alias("source_file"), ((F.col("user_id") % 12) / 10).alias("mean_kappa")).distinct()
    out = runs.with_agreement(rows, scores, "file")
    return out.groupBy(text.source_stem(F.col("file")).alias("source_file"), "mean_kappa").agg(F.count("*").alias("n_rows"))


@query("""SELECT id, CASE WHEN gold_2 IS NULL OR gold_2 = gold_1 THEN [trim(gold_1)] ELSE [trim(gold_1), trim(gold_2)] END AS golds, CASE WHEN gold_2 IS NULL THEN 'single' ELSE 'multi' END AS stratum FROM v_formula""")
def gold_readings(spark, sf_dir):
    golds = dataset.gold_options(F.array(F.concat(F.lit(" "), F.col("gold_1"))), F.array(F.col("gold_2"), F.col("gold_1"), F.lit(" ")))
    return load(spark, sf_dir, "v_formula").select("id", golds.alias("golds")).withColumn("stratum", dataset.default_stratum(F.col("golds")))


@query(f"""SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_hash_sql("'rank'")}, id) AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM v_dataset""")
def seeded_ranks(spark, sf_dir):
    return ranked(load(spark, sf_dir, "v_dataset"), "id", SEED, "rank", ["stratum"], "rank", "n").select("id", "stratum", "rank", "n")


# --- files: tables written to the shared folder in the readers' forms, and read back ---


PER_FILE = 1000  # ids in a file, however many files that takes


def _as_files(rows: DataFrame, name: str, columns: dict[str, str]) -> str:
    """A folder with one text file for each row of `rows`, whose column `content` it holds, under directories by the other columns."""
    path = fresh_path(rows.sparkSession, name)
    rows.select("content", *(F.col(c).alias(n) for n, c in columns.items())).write.partitionBy(*columns).text(path)
    return path


@query("""SELECT id::VARCHAR AS id, CASE WHEN p_size % 7 = 0 THEN '' ELSE concat('Q', id) END AS input, CASE WHEN gold_2 IS NULL THEN [trim(gold_1)] ELSE [trim(gold_1), trim(gold_2)] END AS outputs, CASE WHEN p_size % 7 = 0 THEN 'input is blank' END AS problem FROM v_formula""")
def gold_files(spark, sf_dir):
    rows = load(spark, sf_dir, "v_formula").withColumn("bucket", F.floor(F.col("id") / PER_FILE))
    item = F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("Q"), "id")).alias("input"), F.transform(_golds(), lambda g: F.struct(F.concat(F.lit(" "), g).alias("formula"))).alias("outputs"))
    folder = _as_files(rows.groupBy("bucket").agg(F.to_json(F.collect_list(item)).alias("content")), "gold", {"bucket": "bucket"})
    return readers.gold_dataset(spark, folder).select("id", "input", "outputs", "problem")


@query("""SELECT id::VARCHAR AS id, concat('Q "', id, '" {[,') AS input, CASE WHEN gold_2 IS NULL THEN [trim(gold_1)] ELSE [trim(gold_1), trim(gold_2)] END AS outputs FROM v_formula""")
def large_gold_files(spark, sf_dir):
    """Arrays read by ranges of 8 kB: elements lie across them."""
    item = F.struct(F.col("id").cast("string").alias("id"), F.concat(F.lit('Q "'), "id", F.lit('" {[,')).alias("input"), F.transform(_golds(), lambda g: F.struct(g.alias("formula"))).alias("outputs"))
    rows = load(spark, sf_dir, "v_formula").select(F.floor(F.col("id") / PER_FILE).alias("bucket"), item.alias("item"))
    folder = _as_files(rows.groupBy("bucket").agg(F.to_json(F.collect_list("item")).alias("content")), "large-gold", {"bucket": "bucket"})
    return readers.large_gold_dataset(spark, folder, "*.txt", 1 << 13).select("id", "input", "outputs")


def _judged_folder(spark, sf_dir) -> str:
    rows = load(spark, sf_dir, "v_formula").withColumns({"run": F.concat(F.lit("run"), F.floor(F.col("id") / PER_FILE)), "bucket": F.when(F.col("id") % 2 == 0, "judge_a").otherwise("judge_b")})
    item = F.struct(F.col("id").cast("string").alias("id"), F.concat(F.lit("Q"), "id").alias("input"), F.col("gold_1").alias("expected"), F.col("prediction").alias("generated"), F.when(F.col("p_size") > 25, "yes").otherwise("no").alias("correct"))
    whole = rows.groupBy("bucket", "run").agg(F.to_json(F.struct(F.struct(F.col("run").alias("run_id"), F.lit(42).alias("seed")).alias("metadata"), F.array_sort(F.collect_list(item)).alias("detailed_results"))).alias("content"))
    broken = whole.where("run = 'run0'").select("bucket", F.lit("broken").alias("run"), F.lit("{oops").alias("content"))
    return _as_files(whole.unionByName(broken), "judged", {"run": "run", "judge": "bucket"})


@query("""SELECT id::VARCHAR AS id, concat('run', id // 1000) AS run_id, 42::BIGINT AS seed, concat('judge=judge_', CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END) AS judge, concat('Q', id) AS input, gold_1 AS gold, prediction, CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS correct FROM v_formula""")
def judged_records(spark, sf_dir):
    return readers.judged_files(spark, _judged_folder(spark, sf_dir), "*.txt").select("id", "run_id", "seed", "judge", "input", "gold", "prediction", "correct")


@query("SELECT count(DISTINCT id % 2) AS n_unreadable FROM v_formula WHERE id // 1000 = 0")
def unreadable_files(spark, sf_dir):
    return readers.unreadable_files(spark, _judged_folder(spark, sf_dir), "*.txt").agg(F.count("*").alias("n_unreadable"))


@query("SELECT concat('file=', id // 100) AS folder, sha256(concat(string_agg(concat(id, ' ', gold_1), ' | ' ORDER BY id), chr(10))) AS sha256, strlen(string_agg(concat(id, ' ', gold_1), ' | ' ORDER BY id)) + 1 AS bytes FROM v_formula GROUP BY id // 100")
def file_digests(spark, sf_dir):
    rows = load(spark, sf_dir, "v_formula").withColumn("file", F.floor(F.col("id") / 100))
    line = F.transform(F.array_sort(F.collect_list(F.struct("id", "gold_1"))), lambda x: F.concat(x["id"].cast("string"), F.lit(" "), x["gold_1"]))
    folder = _as_files(rows.groupBy("file").agg(F.array_join(line, " | ").alias("content")), "digests", {"file": "file"})
    return readers.file_digests(spark, folder, "*.txt").select(F.element_at(F.split("path", "/"), -2).alias("folder"), "sha256", "bytes")


@query("""SELECT id::VARCHAR AS id, concat('run', id // 1000) AS run_id, concat('{"of":', id // 1000, ',"tags":["a",null]}') AS note, concat('{"size":', p_size, '}') AS extra, prediction FROM v_formula""")
def open_records(spark, sf_dir):
    """Keys that no schema names, of runs and of items, after a round through files in both forms of envelope."""
    rows = load(spark, sf_dir, "v_formula").withColumns({"run": F.floor(F.col("id") / PER_FILE), "half": F.col("id") % 2})
    item = F.struct(F.col("id").cast("string").alias("id"), F.col("prediction").alias("generated"), F.struct(F.col("p_size").alias("size")).alias("extra"))
    note = F.struct(F.col("run").alias("of"), F.array(F.lit("a"), F.lit(None)).alias("tags"))
    name = F.concat(F.lit("run"), F.col("run").cast("string"))
    items = F.array_sort(F.collect_list(item))
    keep = {"ignoreNullFields": "false"}
    nested = F.to_json(F.struct(F.struct(name.alias("run_id"), note.alias("note")).alias("metadata"), items.alias("detailed_results")), keep)
    flat = F.to_json(F.struct(name.alias("run_id"), note.alias("note"), items.alias("predictions")), keep)
    folder = _as_files(rows.groupBy("half", "run").agg(F.when(F.col("half") == 0, nested).otherwise(flat).alias("content")), "open", {"run": "run", "half": "half"})
    head = readers.run_envelopes(spark, folder, "*.txt").select("file", F.col("metadata")["run_id"].cast("string").alias("run_id"), F.to_json(F.col("metadata")["note"]).alias("note"))
    own = lambda key: F.try_variant_get("item", f"$.{key}", "string")
    return readers.run_items(spark, folder, "*.txt").join(head, "file").select(own("id").alias("id"), "run_id", "note", own("extra").alias("extra"), own("generated").alias("prediction"))


@query("""SELECT audit_id, annotator_id, correct FROM v_annotation WHERE trim(audit_id) <> ''""")
def annotation_files(spark, sf_dir):
    rows = load(spark, sf_dir, "v_annotation").withColumn("bucket", F.floor(F.regexp_extract("audit_id", r"(\d+)$", 1).cast("long") / PER_FILE))
    folder = _as_files(rows.where("ord <= 2").groupBy("bucket").agg(F.to_json(F.struct(F.collect_list(F.struct("audit_id", "annotator_id", "correct")).alias("items"))).alias("content")), "annotations", {"bucket": "bucket"})
    path = fresh_path(spark, "annotations-csv")
    sinks.write(rows.where("ord > 2"), path, "csv", ["audit_id", "annotator_id", "correct"])
    return readers.annotations_json(spark, folder).unionByName(readers.annotations_csv(spark, path)).select("audit_id", "annotator_id", "correct")


@query("""SELECT judge_model, prompt_version, CASE WHEN judge_model = 'R' AND prompt_version = 'v1' THEN -1 ELSE total END AS total
FROM (SELECT judge_model, CASE WHEN condition = 'F' THEN 'v1' ELSE 'v2' END AS prompt_version, sum(o_orderkey)::BIGINT AS total FROM v_judged GROUP BY ALL) t""")
def judged_partitions(spark, sf_dir):
    rows = load(spark, sf_dir, "v_judged").select("judge_model", F.when(F.col("condition") == "F", "v1").otherwise("v2").alias("prompt_version"), "o_orderkey")
    path = fresh_path(spark, "judged")
    sinks.write_judged(rows, path)
    again = rows.where("judge_model = 'R' and prompt_version = 'v1'").groupBy("judge_model", "prompt_version").agg(F.lit(-1).cast("long").alias("o_orderkey"))
    sinks.write_judged(again, path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("judge_model", "prompt_version").agg(F.sum("o_orderkey").alias("total"))


@query(f"""WITH {_ALIGNED}, {_PAIRS}, k AS (SELECT source_file, avg({_KAPPA}) AS mean_kappa FROM pairs GROUP BY 1), g AS (SELECT source_file, CASE WHEN source_file < 'run_5' THEN 'first' ELSE 'second' END AS half, mean_kappa FROM k)
SELECT half, 'mean_kappa' AS metric, round(avg(mean_kappa), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(mean_kappa) ELSE 0 END, 6) AS std, count(*) AS n FROM g GROUP BY 1""")
def agreement_stats(spark, sf_dir):
    ratings = _ratings(spark, sf_dir)
    files = ratings.select("source_file").distinct().withColumn("half", F.when(F.col("source_file") < "run_5", "first").otherwise("second"))
    return shown(runs.agreement_stats(files, agreement.per_source(ratings), ["half"], ["mean_kappa"]).select("half", "metric", "mean", "std", "n"))


@query("SELECT o_orderstatus AS condition, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 50 END::BIGINT AS place, count(*) AS n, round(sum(CASE WHEN o_custkey % 3 = 0 THEN o_totalprice ELSE o_totalprice / 2 END), 2) AS total FROM orders GROUP BY ALL")
def ranked_conditions(spark, sf_dir):
    pair = F.struct(F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice")).alias("value"), (F.col("o_totalprice") / 2).alias("mean"))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("condition"), report.condition_rank(F.col("o_orderstatus"), {"F": 0, "O": 1}).alias("place"), runs.numeric_metric(pair).alias("x"))
    return shown(rows.groupBy("condition", "place").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total")))


@query("SELECT p_partkey AS id, p_name, p_type, prediction FROM part JOIN v_formula ON id = p_partkey")
def aligned_pairs(spark, sf_dir):
    references = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type")
    return scoring.aligned_pairs(load(spark, sf_dir, "v_formula").select("id", "prediction"), references, ["id"])


@query(f"SELECT p_size, count(*) AS n_examples, round(avg(CASE WHEN {_MATCH} THEN 1.0 ELSE 0.0 END), 6) AS exact_match FROM v_formula GROUP BY 1")
def evaluated_pairs(spark, sf_dir):
    """An evaluator over pairs, through transform, and its metrics."""
    pairs = load(spark, sf_dir, "v_formula").withColumn("golds", _golds())
    return shown(scoring.match_rate(pairs.transform(scoring.exact_evaluator()), ["p_size"]))


@query("""SELECT w.judge, count(r.judge) AS n_ratings, count(r.judge) = 0 AS missing FROM (VALUES ('click'), ('purchase'), ('nobody')) w(judge) LEFT JOIN v_ratings r ON r.judge = w.judge GROUP BY w.judge""")
def requested_judges(spark, sf_dir):
    return agreement.judge_coverage(load(spark, sf_dir, "v_ratings"), ["click", "purchase", "nobody", "click"])


@query("""WITH f AS (SELECT DISTINCT id // 100 AS k FROM v_formula), n AS (SELECT k, concat('set', k % 3, '/run', k, '.json') AS path FROM f)
SELECT 'all' AS wanted, path FROM n UNION ALL SELECT 'run1', path FROM n WHERE k = 1 UNION ALL SELECT 'run1*.json', path FROM n WHERE k::VARCHAR LIKE '1%' UNION ALL SELECT 'set2/run2.json', path FROM n WHERE k = 2""")
def found_files(spark, sf_dir):
    """Files by all, name, pattern and path."""
    k = F.floor(F.col("id") / 100)
    rows = load(spark, sf_dir, "v_formula").groupBy(F.concat(F.lit("set"), (k % 3).cast("string"), F.lit("/run"), k.cast("string"), F.lit(".json")).alias("name")).agg(F.to_json(F.collect_list("id")).alias("content"))
    folder = fresh_path(spark, "found")
    sinks.write_named(rows, folder)
    tail = F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1))
    asked = ("all", "run1", "run1*.json", "set2/run2.json")
    out = [readers.matching_files(spark, folder, w).select(F.lit(w).alias("wanted"), tail.alias("path")) for w in asked]
    return reduce(DataFrame.unionByName, out)
