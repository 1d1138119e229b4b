"""The queries of this package and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from assayer.llm.byte_bpe import op11_byte_bpe
from assayer.llm.conversations import op13_conversation_repair
from assayer.llm.decontamination import op4_decontamination
from assayer.llm.fingerprints import op7_fingerprints
from assayer.llm.jaccard import op6_jaccard_join
from assayer.llm.lexical import op12_lexical_search
from assayer.llm.packing import op1_best_fit_packing
from assayer.llm.quality import op9_quality_classifier
from assayer.llm.sharding import op2_sharding
from assayer.llm.spans import op3_substring_dedup
from assayer.llm.suffixes import op5_suffix_dedup
from assayer.llm.token_output import op10_token_output
from assayer.llm.warc import op8_warc

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_sharding, op3_substring_dedup, op4_decontamination, op5_suffix_dedup, op6_jaccard_join, op7_fingerprints, op8_warc, op9_quality_classifier, op10_token_output, op11_byte_bpe, op12_lexical_search, op13_conversation_repair)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _shingles(table: str, key: str, k: int) -> str:
    """(key, s): the distinct runs of k words of each row; fewer words are one run."""
    runs = f"CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    words = f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^ \\t-\\r]+') AS w FROM {table}"
    return f"SELECT DISTINCT {key}, unnest({runs}) AS s FROM ({words})"


ORACLE_SQL = {
    "op4_decontamination": f"""
WITH i AS MATERIALIZED ({_shingles('benchmark', 'item_id', 5)}), d AS MATERIALIZED ({_shingles('documents', 'doc_id', 5)}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1), p AS (SELECT doc_id, item_id, count(*) AS c FROM i JOIN d USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared, c / n::DOUBLE AS containment FROM p JOIN n USING (item_id) WHERE 100 * c >= 80 * n
""",
    "op5_suffix_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM t)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY 1),
c AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS fresh FROM w JOIN f USING (s) WHERE least < doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c) GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
m AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE concat(kept, substr(h, 2 * last + 1)) END)) AS kept_sha256
FROM t LEFT JOIN m USING (doc_id)
""",
    "op6_jaccard_join": f"""
WITH RECURSIVE d AS MATERIALIZED ({_shingles('documents', 'doc_id', 3)}), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x
""",
    "op8_warc": """
SELECT p.page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN p.page_id = w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = w THEN NULL ELSE w END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS w FROM pages) p
JOIN (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> CAST(35 - 5 * j AS INT)) % 32 AS INT), 1), '' ORDER BY g, j) AS payload_digest
      FROM (SELECT page_id, g, j, ('0x' || substr(sha1(coalesce(html, '')), 1 + 10 * g, 10))::BIGINT AS v
            FROM pages, range(4) t(g), range(8) u(j)) GROUP BY page_id) d ON d.page_id = p.page_id
""",
    "op12_lexical_search": f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS MATERIALIZED (SELECT count(*) FILTER (len(w) > 0) AS big_n, sum(len(w))::BIGINT AS big_l FROM d),
t AS MATERIALIZED (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, term),
v AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS often FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
p AS (SELECT item_id, doc_id, sum(often * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN t USING (term) JOIN v USING (term), s GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM p WHERE score > 0) WHERE rank <= 10
""",
}
