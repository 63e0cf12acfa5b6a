"""Redaction and payload scrubbing over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators import history
from corpuslens.plans.registry import query
from corpuslens.session import table

# A secret of every family, made from the row id, in front of the row's own text.
PLANTED = """CASE {id} % 6
  WHEN 0 THEN 'fatal https://x-access-token:ghp_' || lpad({id}, 24, 'a') || '@host.example/o/r.git '
  WHEN 1 THEN 'token ghp_' || lpad({id}, 24, 'b') || ' and github_pat_' || lpad({id}, 22, 'c') || ' '
  WHEN 2 THEN 'Authorization: Bearer ' || lpad({id}, 12, 'd') || ' then basic ' || lpad({id}, 9, 'e') || ' '
  WHEN 3 THEN 'key sk-proj-' || lpad({id}, 18, 'f') || ' glpat-' || lpad({id}, 20, 'g') || ' gloas-' || lpad({id}, 15, 'h') || ' '
  WHEN 4 THEN 'short ghp_abc sk-1 Bearer x '
  ELSE '' END || text"""

_TOKENS_RE2 = fixed.KNOWN_TOKENS.replace("(?U)", "")

def planted(id_column: str, cast: str) -> str:
    return PLANTED.format(id=f"CAST({id_column} AS {cast})").replace(f"CASE CAST({id_column} AS {cast}) %", f"CASE {id_column} %")


def redacted_sql(text: str) -> str:
    return (
        "regexp_replace(regexp_replace(regexp_replace(" + text + ", '://[^\\s/@]+:[^\\s/@]+@', '://***:***@', 'g'), "
        "'" + _TOKENS_RE2 + "', '" + fixed.TOKEN_PLACEHOLDER + "', 'g'), "
        "'\\b(Bearer|Basic)\\s+[A-Za-z0-9._~+/=-]{8,}', '\\1 " + fixed.TOKEN_PLACEHOLDER + "', 'gi')"
    )


@query(
    "s1_redact_documents",
    f"""
WITH t AS (SELECT doc_id, {planted('doc_id', 'VARCHAR')} AS message FROM documents)
SELECT doc_id, md5({redacted_sql('message')}) AS digest, CAST(length({redacted_sql('message')}) AS INT) AS n_chars FROM t""",
)
def redact_documents(spark, sf_dir):
    """S1 over whole documents with planted secrets."""
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{planted('doc_id', 'STRING')} AS message")
    out = df.withColumn("message", fn.redact_secrets(F.col("message")))
    return out.select("doc_id", F.md5("message").alias("digest"), F.length("message").alias("n_chars"))


@query(
    "s1_extra_rule",
    """
SELECT conv_id, turn, regexp_replace(text, 'token = "[0-9a-f]{16,}"', 'token = "***"', 'g') AS message
FROM conversations""",
)
def extra_rule(spark, sf_dir):
    """S1 with a caller's rule on top: hexadecimal tokens in assignments."""
    rules = [(r'token = "[0-9a-f]{16,}"', 'token = "***"')]
    df = table(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", fn.redact_with(fn.redact_secrets(F.col("text")), rules).alias("message"))


@query(
    "r4_redacted_errors",
    f"""
WITH t AS (SELECT role, {planted('conv_id', 'VARCHAR')} AS message FROM conversations)
SELECT count(*) FILTER (WHERE {redacted_sql('message')} <> message) AS rewritten, count(*) AS total FROM t""",
)
def redacted_errors(spark, sf_dir):
    """How many stored messages a redaction run rewrites."""
    df = table(spark, sf_dir, "conversations").selectExpr(f"{planted('conv_id', 'STRING')} AS error_message")
    return history.rewrite_count(history.redacted_history(df))


# Digits beyond any number type, a trailing zero, key order and white space: all must stay as they are.
_BEFORE = '{"z": 1.10,"n":{"token":1,"a":[1, 2]}'
_AFTER = '"big":12345678901234567890123456789012345678901234 , "p":'
PAYLOAD = f"""CASE event_id % 4
  WHEN 0 THEN '{_BEFORE} , "token" : "t' || event_id || '", {_AFTER}' || props || ' }}'
  WHEN 1 THEN props WHEN 2 THEN 'not json ' || event_id || props ELSE '["token",' || props || ']' END"""


@query(
    "s2_scrub_payload",
    f"""
WITH t AS (SELECT event_id, props, {PAYLOAD} AS payload FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{_BEFORE} , {_AFTER}' || props || ' }}' ELSE payload END AS request_payload,
  event_id % 4 = 0 AS rewritten FROM t""",
)
def scrub_payload(spark, sf_dir):
    """The top-level token of JSON objects goes, nested values and other text stay."""
    df = table(spark, sf_dir, "events").selectExpr("event_id", f"{PAYLOAD} AS request_payload")
    return history.scrubbed_history(df)


@query(
    "r3_scrub_history",
    """
SELECT event_type, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS INT) IS NOT NULL) AS rewritten,
  count(*) FILTER (WHERE json_merge_patch(props, '{"k":null}') = '{}') AS emptied
FROM events GROUP BY event_type""",
)
def scrub_history(spark, sf_dir):
    """R3/A16 on the event properties, with 'k' as the secret key."""
    df = table(spark, sf_dir, "events").select("event_type", "props")
    out = history.scrubbed_history(df, "props", "k")
    return out.groupBy("event_type").agg(
        F.count_if("rewritten").alias("rewritten"), F.count_if(F.col("props") == "{}").alias("emptied")
    )


@query(
    "r3_lossless_history",
    """
SELECT event_id, '{ "v": 1' || event_id || repeat('7', 40) || '.10, "p": ' || props || ' }' AS request_payload, true AS rewritten FROM events""",
)
def lossless_history(spark, sf_dir):
    """Numbers longer than any type and the white space of rewritten payloads stay as they are."""
    df = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """'{ "v": 1' || event_id || repeat('7', 40) || '.10, "token":"' || event_type || '", "p": ' || props || ' }' AS request_payload""",
    )
    return history.scrubbed_history(df)


@query(
    "s12_safe_arrays",
    """
SELECT event_id, array_to_string(CASE WHEN event_id % 3 = 0 THEN [event_type, 'x'] ELSE [] END, ',') AS languages
FROM events""",
)
def safe_arrays(spark, sf_dir):
    """An array in a payload field; invalid payloads give an empty array."""
    payload = F.expr(
        """CASE event_id % 3 WHEN 0 THEN '{"languages_detected":["' || event_type || '","x"],"p":' || props || '}'
           WHEN 1 THEN '{"languages_detected":' || props ELSE props END"""
    )
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "props").withColumn("payload", payload)
    languages = fn.safe_array(F.col("payload"), "string", "languages_detected")
    return df.select("event_id", F.array_join(languages, ",").alias("languages"))


@query(
    "s13_numeric_cleanup",
    """
SELECT event_id, greatest(0, least(100, value * 4 - 50)) AS progress,
  coalesce(TRY_CAST(CASE event_id % 3 WHEN 0 THEN ' ' || event_id WHEN 1 THEN 'x' || event_id END AS INT), 0) AS line_number
FROM events""",
)
def numeric_cleanup(spark, sf_dir):
    """Clamped progress and lenient integers."""
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN ' ' || event_id WHEN 1 THEN 'x' || event_id END")
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return df.select(
        "event_id", fn.clamp(F.col("value") * 4 - 50).alias("progress"), fn.lenient_int(raw).alias("line_number")
    )
