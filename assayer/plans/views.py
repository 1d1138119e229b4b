"""The driver's tables in the shapes of the operators' inputs: SELECT texts that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_ratings": """
SELECT concat('run_', CAST(user_id % 12 AS STRING)) AS source_file,
       concat(CAST(user_id AS STRING), '|', CAST(CAST(ts AS DATE) AS STRING)) AS item_key,
       event_type AS judge,
       CASE WHEN value >= 35 THEN 'yes' ELSE 'no' END AS verdict,
       CASE event_id % 10 WHEN 0 THEN 'exact' WHEN 1 THEN 'no_llm' WHEN 2 THEN 'unmatched'
                          WHEN 3 THEN 'content_filtered' ELSE 'llm' END AS decision_method,
       event_id AS ord
FROM {events}""",
    "v_judged": """
SELECT o_orderkey, o_orderpriority AS model_short, o_orderstatus AS condition,
       42 + o_custkey % 3 AS seed,
       CASE WHEN o_custkey % 5 = 0 THEN o_custkey % 4 END AS cv_fold,
       l_returnflag AS judge_model,
       CASE l_linenumber WHEN 1 THEN 'exact' WHEN 2 THEN 'unmatched' WHEN 3 THEN 'no_llm'
                         WHEN 4 THEN 'content_filtered' ELSE 'llm' END AS decision_method,
       CASE WHEN l_linenumber = 1 THEN 'yes' WHEN l_linenumber <= 4 THEN 'no'
            WHEN l_quantity >= 25 THEN 'yes' ELSE 'no' END AS correct,
       l_extendedprice / 100 AS latency_ms
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "v_formula": """
SELECT p_partkey AS id, p_size,
       concat('<<', replace(agent, '_', ''), '>>F (', prop, ' && ready)') AS gold_1,
       CASE WHEN p_size % 5 = 0 THEN concat('<<Backup>>G !', prop) END AS gold_2,
       CASE p_partkey % 6
         WHEN 0 THEN concat('<<', replace(agent, '_', ''), '>>F (', prop, ' && ready)')
         WHEN 1 THEN concat('<<', agent, '>>F (', prop, ' ∧ ready)', chr(10), '<<backup>> G ¬', prop)
         WHEN 2 THEN concat('<<', agent, '>> F (', prop, ' AND ready)')
         WHEN 3 THEN concat('<<', agent, '>>F (', prop, ' && ready)', chr(10), '<<', agent, '>>F (', prop, ' && ready)')
         WHEN 4 THEN ''
         ELSE concat('<<', agent, '>>F (', replace(prop, '_', ''), ' && ready)') END AS prediction
FROM (SELECT *, concat(p_type, '_', replace(p_brand, '#', '_')) AS agent, replace(p_name, ' ', '_') AS prop FROM {part}) t""",
    "v_chat": """
SELECT conv_id, turn, role, text,
       CASE conv_id % 4 WHEN 0 THEN concat('<|im_start|>assistant', chr(10), '"', text, '"<|im_end|>tail')
                        WHEN 1 THEN concat('[INST] ask [/INST] ', text, '</s>tail')
                        WHEN 2 THEN concat('<|assistant|>', text, '<|end|>tail')
                        ELSE concat('Assistant: ', text) END AS raw,
       CASE conv_id % 4 WHEN 0 THEN 'qwen' WHEN 1 THEN 'mistral' WHEN 2 THEN 'phi3' ELSE 'generic' END AS model_type
FROM {conversations}""",
    "v_dataset": """
SELECT doc_id AS id, text AS input,
       CASE WHEN instr(text, chr(10)) > 0 THEN 'multi' ELSE 'single' END AS stratum
FROM {documents}""",
    "v_reply": """
SELECT id, said, CASE id % 8
         WHEN 0 THEN concat('{{"correct": "yes", "reasoning": "', quoted, '"}}')
         WHEN 1 THEN concat('output: ', repeat('{{"n": ', 9), '{{"text": "', quoted, '"}}', repeat('}}', 9), ' then {{"n": {{"n": {{"n": {{"n": {{"n": {{"n": {{"n": "', quoted, '"}}}}}}}}}}}}, "correct": "no", "reasoning": "', quoted, '"}}')
         WHEN 2 THEN concat(plain, replace(' {{`correct`: "YES", `meta`: {{`c`: 0.9}}, `reasoning`: `brief`,}}', '`', chr(39)))
         WHEN 3 THEN concat('Correct: yes. Reasoning: ', plain)
         WHEN 4 THEN '{{"correct": "maybe", "reasoning": {{"a": [1, {{"b": "c"}}]}}}}'
         WHEN 5 THEN concat('cannot decide: ', plain)
         WHEN 6 THEN concat('{{"correct": "yes", "reasoning": "first"}} ', plain, ' {{"correct": "no", "reasoning": "', quoted, '"}}')
         ELSE concat('{{"correct": "yes", "reasoning": "', quoted) END AS reply
FROM (SELECT *, translate(said, '{{}}', '()') AS plain, replace(replace(replace(said, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')), chr(10), concat(chr(92), 'n')) AS quoted
      FROM (SELECT doc_id AS id, replace(replace(coalesce(text, ''), chr(9), ' '), chr(13), ' ') AS said FROM {documents}) s) t""",
    "v_annotation": """
SELECT concat('HEVAL-', lpad(CAST(doc_id AS STRING), 6, '0')) AS audit_id, annotator_id, label AS correct, ord FROM (
  SELECT doc_id, 'annotator_1' AS annotator_id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN quality = 1 THEN 'Yes' ELSE 'n' END AS label, 1 AS ord FROM {labels}
  UNION ALL
  SELECT doc_id, 'annotator_2', CASE WHEN doc_id % 7 = 0 THEN '' WHEN toxic = 1 THEN 'false' ELSE 'true' END, 2 FROM {labels}
  UNION ALL
  SELECT doc_id, 'adjudicator', CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END, 3 FROM {labels} WHERE doc_id % 2 = 0) t""",
    "v_key": """
SELECT concat('HEVAL-', lpad(CAST(doc_id AS STRING), 6, '0')) AS audit_id, source AS model_short, lang AS condition,
       CASE WHEN doc_id % 3 <> 0 THEN 'yes' ELSE 'no' END AS judge_a,
       CASE WHEN doc_id % 4 <> 0 THEN 'yes' ELSE 'no' END AS judge_b
FROM {documents}""",
}


def tables(name: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", VIEWS[name])))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view of tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{t: load(spark, sf_dir, t) for t in tables(name)})


def with_views(sql: str) -> str:
    """SQL for DuckDB with the views it names as common table expressions. A WITH of its own is continued."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in tables(v)})})" for v in used)
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
