"""The ``opN_*`` queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import queries as q
from graphloom.llm import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": q.op1_sentencepiece,
    "op2_warc": q.op2_warc,
    "op3_licences": q.op3_licences,
    "op4_nn_descent": q.op4_nn_descent,
    "op5_rendezvous": q.op5_rendezvous,
    "op6_toxicity": q.op6_toxicity,
    "op7_minmax": q.op7_minmax,
    "op8_packing": q.op8_packing,
    "op9_binary_fuse": q.op9_binary_fuse,
    "op10_pii": q.op10_pii,
    "op11_suffix_runs": q.op11_suffix_runs,
    "op12_whitening": q.op12_whitening,
    "op13_spelling": q.op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op9_binary_fuse": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op11_suffix_runs": sql.OP11,
    "op13_spelling": sql.OP13,
}
