"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard_join, packing, pii, secrets, token_counts, tool_calls, toxicity, vptree
from .shared import fold, table


#: The tools whose calls op5 validates: (tool, argument, type, required).
TOOLS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("fetch", "url", "string", True),
    ("run", "code", "string", True),
    ("run", "arguments", "array", False),
]


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op2_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_vptree(spark, sf_dir):
    return vptree.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def with_calls(turns):
    """The conversations as a log with calls, as those of the tables hold none.

    In two of three conversations every assistant turn makes one call, whose result is the user's next turn, and the
    turns' own texts are the contents.  Calls depend on the one before, or, in a log that runs newest first, on the one
    after.  A third of the calls have arguments that their tool does not take.
    """
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x")), {"ignoreNullFields": "false"}), r"(?s)^\{\"x\":(.*)\}$", 1)
    number = lambda n: (F.col("turn") + n).cast("string")
    name = F.element_at(F.array(*(F.lit(n) for n in ("search", "fetch", "run"))), (F.col("turn") % 3 + 1).cast("int"))
    arguments = F.element_at(F.array(F.concat(F.lit('{"query":"q","limit":'), number(0), F.lit("}")), F.lit('{"uri":"u"}'), F.lit('{"code":"x","arguments":[1]}')), (F.col("turn") % 3 + 1).cast("int"))
    needed = F.concat(F.lit("c"), F.when(F.col("conv_id") % 3 == 1, number(2)).otherwise(number(-2)))
    call = F.concat(F.lit('{"content":'), quoted, F.lit(',"tool_calls":[{"id":"c'), number(0), F.lit('","name":"'), name, F.lit('","arguments":'), arguments, F.lit(',"depends_on":["'), needed, F.lit('"]}]}'))
    result = F.concat(F.lit('{"content":'), quoted, F.lit(',"tool_call_id":"c'), number(-1), F.lit('"}'))
    calling = F.col("conv_id") % 3 > 0
    is_result = calling & (F.col("role") == "user") & (F.col("turn") >= 2)
    return turns.select("conv_id", "turn", F.when(is_result, "tool").otherwise(F.col("role")).alias("role"), F.when(calling & (F.col("role") == "assistant"), call).when(is_result, result).otherwise(F.col("text")).alias("text"))


def op5_tool_calls(spark, sf_dir):
    tools = spark.createDataFrame(TOOLS, tool_calls.TOOLS)
    return tool_calls.format_chats(with_calls(table(spark, sf_dir, "conversations")), tools)


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.scan_personal_data(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_vptree, op4_packing, op5_tool_calls, op6_exact_dedup, op7_bpe, op8_pii, op9_jaccard_join, op10_token_counts)}


_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


# Calls and results as `with_calls` derives them; a chain that runs against the turns puts the last call first.
_OP5 = """
WITH c AS (SELECT *, conv_id % 3 AS kind, conv_id % 3 > 0 AND role = 'assistant' AS calls, conv_id % 3 > 0 AND role = 'user' AND turn >= 2 AS result FROM conversations),
a AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM c WHERE calls),
j AS (SELECT c.*, a.last, m.turn AS made, m.last AS made_last, r.turn AS answer FROM c LEFT JOIN a ON c.calls AND a.conv_id = c.conv_id AND a.turn = c.turn
      LEFT JOIN a m ON c.result AND m.conv_id = c.conv_id AND m.turn = c.turn - 1 LEFT JOIN c r ON c.calls AND r.result AND r.conv_id = c.conv_id AND r.turn = c.turn + 1)
SELECT conv_id, turn, CASE WHEN result THEN 'tool' ELSE role END AS role,
       CASE WHEN kind = 1 AND calls THEN last WHEN kind = 1 AND made IS NOT NULL THEN greatest(made_last, turn) ELSE turn END::BIGINT AS order_turn,
       CASE WHEN kind = 1 AND calls THEN last - turn WHEN kind = 1 AND made IS NOT NULL AND made_last > turn THEN made_last - made + 1 ELSE 0 END::INTEGER AS order_step,
       calls::BIGINT AS n_calls, (answer IS NOT NULL OR made IS NOT NULL)::BIGINT AS n_linked, (calls AND turn % 3 <> 1)::BIGINT AS n_valid, coalesce(answer, made)::BIGINT AS link_turn,
       CASE WHEN calls THEN '{"content":' || to_json(text) || ',"role":"assistant","tool_calls":[{"arguments":' ||
                CASE turn % 3 WHEN 0 THEN '{"limit":' || turn || ',"query":"q"}' WHEN 1 THEN '{"uri":"u"}' ELSE '{"arguments":[1],"code":"x"}' END || ',"id":"c' || turn || '","name":"' || CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'fetch' ELSE 'run' END || '"}]}'
            WHEN result THEN '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"c' || (turn - 1) || '"}' ELSE to_json({'content': text, 'role': role})::VARCHAR END AS message
FROM j
"""


def oracle_sql():
    return {"op5_tool_calls": _OP5, "op6_exact_dedup": _OP6}
