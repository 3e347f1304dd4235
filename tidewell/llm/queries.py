"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.chat import op1_chat_format
from tidewell.llm.common import with_code
from tidewell.llm.decontaminate import op5_decontaminate
from tidewell.llm.neardup import op7_near_dedup
from tidewell.llm.pieces import op10_sentencepiece
from tidewell.llm.quality import op3_quality
from tidewell.llm import linededup, pii, substrings, urls
from tidewell.llm.vectordedup import op9_embedding_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    native = {
        "op1_chat_format": op1_chat_format,
        "op2_pii": pii.op2_pii,
    }
    free = {
        "op3_quality": op3_quality,
        "op4_line_dedup": linededup.op4_line_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_substring_dedup": substrings.op6_substring_dedup,
        "op7_near_dedup": op7_near_dedup,
        "op8_url_filter": urls.op8_url_filter,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_sentencepiece": op10_sentencepiece,
    }
    return native | {k: with_code(f) for k, f in free.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": CHAT_SQL, "op2_pii": pii.ORACLE_SQL, "op4_line_dedup": linededup.ORACLE_SQL, "op6_substring_dedup": substrings.ORACLE_SQL,
        "op7_near_dedup": NEAR_SQL, "op8_url_filter": urls.ORACLE_SQL, "op9_embedding_dedup": VECTOR_SQL,
    }


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM (SELECT doc_id, min(c) AS m FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, m AS component_id, vec_id = m AS kept
FROM (SELECT vec_id, min(c) AS m FROM r GROUP BY vec_id)
"""


#: The marks are those of the default template; a text's marks get one character each when escaped.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), m AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/INST\]|/ROLE\]|/SYS\]|INST\]|ROLE\]|TEXT\]|SYS\]|/s>|s>)'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS f,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k
  FROM c
), s AS (
  SELECT *, CASE WHEN role = 'system' THEN k = 1 WHEN role = 'user' THEN k = 1 OR prev IN ('system', 'assistant')
    WHEN role = 'assistant' THEN prev = 'user' ELSE false END AS ok FROM m
), t AS (
  SELECT *, min(CASE WHEN coalesce(ok, false) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS fine FROM s
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS trained, CAST(sum(f) AS BIGINT) AS formatted_chars,
    arg_max(role, k) AS last_role, CAST(sum(fine) AS BIGINT) AS n_accepted, min(fine) AS fine
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(trained) AS BIGINT) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars,
  fine = 1 AND last_role = 'assistant' AS valid,
  CASE WHEN fine = 0 THEN 'invalid' WHEN last_role = 'assistant' THEN 'answered' WHEN last_role = 'user' THEN 'asked' ELSE 'told' END AS state, n_accepted
FROM g
"""
