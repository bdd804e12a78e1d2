"""Views that dress the generic tables as document and registry records.

Each is one SELECT in the SQL that Spark and DuckDB share, so a query and its oracle start from
the same rows. A table's name in braces is replaced by the DataFrame or by the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def pick(expression: str, values: list[str | None]) -> str:
    """CASE that gives the value at ``expression``; beyond the list it is null."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {expression} {cases} END"


TYPES = ["teudat_zehut", "teudat_zehut_back", "teudat_zehut_sefach", "israeli_passport", "foreign_passport", "israeli_drivers_license", "disability_card", "senior_citizen_card", "weapon_license", "cheque", "cheque_back", "other", "unreadable"]
BANKS = ["4", "9", "10", "11", "12", "13", "14", "17", "18", "20", "22", "23", "26", "31", "34", "46", "52", "54"]
MODELS = [f"model-{i}" for i in range(11)]

def check_digit(text: str, length: int) -> str:
    """SQL of the weighted 7-3-1 digit of a text of digits and fillers."""
    terms = [f"{(7, 3, 1)[i % 3]} * CASE WHEN substr({text}, {i + 1}, 1) = '<' THEN 0 ELSE CAST(substr({text}, {i + 1}, 1) AS INT) END" for i in range(length)]
    return f"CAST(({' + '.join(terms)}) % 10 AS STRING)"


_NUMBER, _BIRTH, _EXPIRY, _OPTIONAL = "lpad(CAST(c_custkey AS STRING), 9, '0')", "lpad(CAST(500101 + c_custkey % 27 AS STRING), 6, '0')", "lpad(CAST(300101 + c_custkey % 25 AS STRING), 6, '0')", "lpad(CAST(100000000 + c_custkey AS STRING), 9, '0') || '<<<<<'"
_DATA = f"({_NUMBER} || {check_digit(f'({_NUMBER})', 9)} || 'UTO' || {_BIRTH} || {check_digit(f'({_BIRTH})', 6)} || 'F' || {_EXPIRY} || {check_digit(f'({_EXPIRY})', 6)} || {_OPTIONAL} || {check_digit(f'({_OPTIONAL})', 14)})"

VIEWS = {
    "request_log": f"""
SELECT event_id AS id, user_id, ts AS created_at,
  CASE event_type WHEN 'error' THEN 502 WHEN 'signup' THEN 102 ELSE 200 END AS status,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN {pick('event_id % 14', TYPES)} END AS doc_type,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN {pick('event_id % 4', ['verified', 'mismatch', 'unverified', None])} END AS verdict,
  {pick('event_id % 3', ['web', 'api', 'mobile'])} AS source, {pick('event_id % 2', ['local', 'cloud'])} AS backend,
  {pick('event_id % 5', ['trial', 'byok', 'trial', 'local', 'byok'])} AS mode,
  CAST(floor(value * 100) AS INT) AS latency_ms, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS tokens_in,
  CASE WHEN event_id % 6 > 0 THEN CAST(event_id % 97 AS DOUBLE) / 64 END AS cost_usd,
  CASE WHEN event_type = 'error' THEN 'UPSTREAM' END AS error_code,
  CASE WHEN event_id % 7 = 0 THEN 'v1:' || CAST(event_id AS STRING) END AS result_enc
FROM {{events}}""",
    "usage_calls": f"""
SELECT l_orderkey AS document_id, 'cloud' AS backend, {pick('(l_partkey + l_linenumber) % 11', MODELS)} AS model,
  CAST(l_quantity AS BIGINT) * 64 AS input_tokens, CAST(l_quantity AS BIGINT) * 8 AS output_tokens,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) * 16 END AS cache_read_tokens,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity AS BIGINT) * 4 END AS cache_write_tokens
FROM {{lineitem}}""",
    "companies": """
SELECT 510000000 + c_custkey AS number, 'ACME ' || c_name || ' ' || n_name AS name_en,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'פעילה' ELSE 'מחוקה' END AS status, n_name AS city
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "boi_accounts": f"""
SELECT CAST({pick('o_custkey % 18', BANKS)} AS INT) AS bank, CAST(o_custkey % 1000 AS INT) AS branch, o_orderkey AS account,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS start_date,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(CAST(o_orderdate + INTERVAL '2' YEAR AS DATE) AS STRING) END AS end_date
FROM {{orders}}""",
    "boi_severe": """
SELECT 510000000 + s_suppkey AS id_number, s_name AS name,
  CASE WHEN s_suppkey % 3 > 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN '1999-01-01' ELSE '2030-01-01' END END AS end_date
FROM {supplier}""",
    "nbctf_individuals": """
SELECT c_custkey AS seq, 'Person ' || c_mktsegment || ' ' || c_name AS name_en,
  'ID ' || CAST(510000000 + c_custkey AS STRING) || ', PASSPORT ' || CAST(20000 + c_custkey AS STRING) || '; no. 12' AS id_text,
  c_custkey % 4 = 0 AS cancelled
FROM {customer} WHERE c_acctbal < 1500""",
    "payloads": """
SELECT o_orderkey AS document_id, CAST(510000000 + o_custkey AS STRING) AS id_number,
  CASE WHEN o_orderkey % 2 = 0 THEN '0' || CAST(510000000 + o_custkey AS STRING) ELSE CAST(510000000 + o_orderkey % 300 AS STRING) END AS spouse_id_number,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(510000000 + o_orderkey % 40 AS STRING) END AS drawer_id_number,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(510000000 + o_orderkey % 40 AS STRING) END AS guarantor_id_number,
  CASE o_custkey % 18 WHEN 3 THEN '11' WHEN 2 THEN '10' ELSE '12' END AS bank_code, CAST(o_custkey % 1000 AS STRING) AS branch_number,
  CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey AS STRING) END AS account_number,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Person' END AS first_name_en, c_name AS last_name_en
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "ids": """
SELECT o_orderkey AS k, CASE o_orderkey % 5
  WHEN 0 THEN lpad(CAST(o_orderkey * 7919 % 1000000000 AS STRING), 9, '0') WHEN 1 THEN CAST(o_orderkey AS STRING)
  WHEN 2 THEN '0' || CAST(o_orderkey AS STRING) || '-' || CAST(o_custkey % 10 AS STRING) WHEN 3 THEN CAST(o_orderkey + 12345678901 AS STRING) ELSE 'none' END AS raw
FROM {orders}""",
    "micr": """
SELECT o_orderkey AS k, CASE o_orderkey % 4
  WHEN 0 THEN CAST(80000000 + o_orderkey AS STRING) || ' 11 ' || lpad(CAST(o_custkey % 100000 AS STRING), 5, '0') || ' ' || lpad(CAST(o_orderkey AS STRING), 10, '0')
  WHEN 1 THEN ':' || CAST(80000000 + o_orderkey AS STRING) || ': 11' || lpad(CAST(o_custkey % 100000 AS STRING), 5, '0') || ' ' || lpad(CAST(o_orderkey AS STRING), 10, '0')
  WHEN 2 THEN CAST(o_orderkey AS STRING) || ' ' || CAST(o_custkey % 1000 AS STRING) || ' 7' ELSE CAST(80000000 + o_orderkey AS STRING) || ' 12' END AS line
FROM {orders}""",
    "amounts": """
SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber
  WHEN 1 THEN CAST(l_partkey AS STRING) || '.—' WHEN 2 THEN 'X ' || CAST(l_partkey AS STRING) || ' X' WHEN 3 THEN CAST(l_partkey AS STRING) || ' xx/xx'
  WHEN 4 THEN CAST(1 + l_partkey % 999 AS STRING) || ',' || lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0') || '.50'
  WHEN 5 THEN CAST(l_partkey AS STRING) || '.5' WHEN 6 THEN '₪ ' || CAST(l_partkey AS STRING) ELSE ' about ' || CAST(l_partkey AS STRING) END AS raw
FROM {lineitem}""",
    "dates": """
SELECT o_orderkey AS k, CAST(extract(DAY FROM o_orderdate) AS STRING) AS d, CAST(extract(MONTH FROM o_orderdate) AS STRING) AS m,
  CAST(extract(YEAR FROM o_orderdate) AS STRING) AS y FROM {orders}""",
    "zones": f"""
SELECT k, upper_line, data || CASE WHEN k % 7 = 0 THEN CASE composite WHEN '0' THEN '1' ELSE '0' END ELSE composite END AS data_line FROM (
  SELECT k, upper_line, data, {check_digit('(substr(data, 1, 10) || substr(data, 14, 7) || substr(data, 22, 22))', 39)} AS composite
  FROM (SELECT c_custkey AS k, 'P<UTOERIKSSON<<ANNA<MARIA<<<<' AS upper_line, {_DATA} AS data FROM {{customer}}))""",
    "key_events": """
SELECT key % 23 AS user_id, seq, CASE WHEN odd AND key % 5 < 2 THEN 'revoke' ELSE 'create' END AS kind,
  CASE WHEN odd AND key % 5 >= 2 THEN -seq WHEN odd AND key % 3 = 0 THEN key - 23 ELSE key END AS key_id
FROM (SELECT o_orderkey AS seq, CAST(floor(o_orderkey / 2) AS BIGINT) AS key, o_orderkey % 2 = 1 AS odd FROM {orders})""",
    "invitation_events": """
SELECT o_orderkey AS id, ' U' || CAST(o_custkey % 97 AS STRING) || '@x.test' AS email, 'sent' AS kind, CAST(o_orderdate AS TIMESTAMP) AS moment FROM {orders}
UNION ALL
SELECT o_orderkey AS id, NULL AS email, CASE l_linenumber WHEN 3 THEN 'accepted' WHEN 4 THEN 'revoked' ELSE 'resent' END AS kind,
  CASE l_linenumber WHEN 2 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '5' DAY WHEN 3 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '9' DAY
    WHEN 4 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '7' DAY ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL '8' DAY END AS moment
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
WHERE l_linenumber IN (2, 5) OR l_linenumber = 3 AND o_orderkey % 3 = 0 OR l_linenumber = 4 AND o_orderkey % 4 = 0""",
    "invites": """
SELECT o_orderkey AS id, 'u' || CAST(o_custkey % 97 AS STRING) || '@x.test' AS email, CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'revoked' END AS status,
  CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '30' DAY AS expires_at FROM {orders}""",
    "sign_ups": """
SELECT o_orderkey AS user_id, 'U' || CAST(o_custkey % 120 AS STRING) || '@x.test' AS email, o_orderkey % 4 > 0 AS verified,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL '3' DAY AS moment FROM {orders}""",
    "boxes": """
SELECT l_orderkey AS page_id, l_linenumber AS idx, CAST(l_partkey * 7 % 600 AS INT) AS x1, CAST(l_suppkey * 13 % 600 AS INT) AS y1,
  CAST(l_partkey * 7 % 600 + 20 + l_partkey * 31 % 380 AS INT) AS x2, CAST(l_suppkey * 13 % 600 + 20 + l_partkey * 17 % 380 AS INT) AS y2,
  CAST(1000 + l_orderkey % 5 * 400 AS INT) AS width, CAST(1000 + l_orderkey % 7 * 300 AS INT) AS height
FROM {lineitem}""",
}


def tables_of(view: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[view])))


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """``spread`` deals the tables' rows out over all cores first: for small rows with much work,
    which a file of few row groups would leave to few tasks."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(name)}
    if spread:
        tables = {t: df.repartition(spark.sparkContext.defaultParallelism) for t, df in tables.items()}
    return spark.sql(VIEWS[name], **tables)


def oracle(sql: str, *views: str) -> str:
    """DuckDB SQL over the named views."""
    parts = [f"{v} AS ({re.sub(r'[{](' + r'[a-z]+' + r')[}]', lambda m: m[1], VIEWS[v])})" for v in views]
    head = "WITH " + ", ".join(parts) if parts else ""
    body, recursive = sql.strip(), ""
    if head and (start := re.match("WITH (RECURSIVE )?", body, re.IGNORECASE)):
        body, recursive, head = body[start.end() :], start[1] or "", head + ","
    return f"{head.replace('WITH ', f'WITH {recursive}', 1)} {body}"
