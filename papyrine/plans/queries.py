"""Queries over the operators, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import amounts, calendar, geometry, identifiers, names
from papyrine.operators import merge, registries, request_log, triage, validation
from papyrine.operators.postings import NameIndex
from papyrine.plans.adapters import MODELS, oracle, view
from papyrine.streaming import limits, stages
from papyrine.workspace import written

NOW = "2024-01-31 00:00:00"
WINDOW = "10 MINUTES"
TODAY = "2000-06-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def now():
    return F.lit(NOW).cast("timestamp")


def query(sql: str | None = None, *views: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return register


FAMILY_SQL = "CASE " + " ".join(f"WHEN doc_type IN ({', '.join(repr(t) for t in types)}) THEN '{f}'" for f, types in request_log.FAMILIES.items()) + " WHEN doc_type IS NOT NULL THEN 'not_a_document' END"


# --- request log -------------------------------------------------------------------------------


@query(f"SELECT {FAMILY_SQL} AS family, count(*) AS n FROM request_log WHERE status = 200 AND doc_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, family", "request_log")
def log_families(spark, sf_dir):
    return request_log.by_family(view(spark, sf_dir, "request_log")).orderBy(F.desc("n"), "family")


@query("SELECT user_id, verdict, count(*) AS n FROM request_log WHERE status = 200 AND verdict IS NOT NULL GROUP BY ALL", "request_log")
def log_verdicts(spark, sf_dir):
    return request_log.by_verdict(view(spark, sf_dir, "request_log"), "user_id")


@query(
    f"""SELECT user_id, count(*) AS total, count(*) FILTER (created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS last_30_days,
  CAST(quantile_disc(latency_ms, 0.5) FILTER (status = 200) AS BIGINT) AS median_latency_ms,
  sum(cost_usd) FILTER (status = 200 AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS cost_30_days, sum(cost_usd) FILTER (status = 200) AS cost_total
FROM request_log GROUP BY user_id""",
    "request_log",
)
def log_dashboard(spark, sf_dir):
    return request_log.dashboard(view(spark, sf_dir, "request_log"), now())


@query(
    f"""SELECT user_id, '2024-01' AS month, count(*) FILTER (created_at >= TIMESTAMP '2024-01-01') AS docs_this_month,
  count(*) FILTER (created_at >= TIMESTAMP '2024-01-01' AND status = 200) AS ok_this_month,
  count(*) FILTER (created_at >= TIMESTAMP '2024-01-01' AND status <> 200) AS failed_this_month, count(*) AS total,
  count(*) FILTER (mode = 'trial' AND (status = 200 OR status = 102 AND created_at > TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE)) AS trial_used
FROM request_log GROUP BY user_id""",
    "request_log",
)
def log_usage(spark, sf_dir):
    return request_log.usage(view(spark, sf_dir, "request_log"), now(), WINDOW)


@query(
    """SELECT id, user_id, position, total, has_result FROM (SELECT *, result_enc IS NOT NULL AS has_result, count(*) OVER (PARTITION BY user_id) AS total,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INT) AS position FROM request_log
  WHERE doc_type IN ('teudat_zehut', 'teudat_zehut_back', 'teudat_zehut_sefach') AND status = 200 AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-26')
WHERE position > 5 AND position <= 15""",
    "request_log",
)
def log_listing(spark, sf_dir):
    filters = request_log.parse_filters({"family": ["teudat_zehut", "x"], "status": "ok", "from": "2024-01-05", "to": "2024-01-25", "verdict": ""})
    page = request_log.listing(view(spark, sf_dir, "request_log"), filters, limit=10, offset=5)
    return page.select("id", "user_id", "position", "total", "has_result")


@query(
    f"""SELECT user_id, array_to_string(list_sort(list(DISTINCT verdict) FILTER (verdict IS NOT NULL)), ',') AS verdicts,
  array_to_string(list_sort(list(DISTINCT backend)), ',') AS backends, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
  array_to_string(list_sort(list(DISTINCT {FAMILY_SQL}) FILTER (doc_type IS NOT NULL)), ',') AS families FROM request_log GROUP BY user_id""",
    "request_log",
)
def log_facets(spark, sf_dir):
    found = request_log.facets(view(spark, sf_dir, "request_log"))
    return found.select("user_id", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("verdicts", "backends", "sources", "families")])


@query(
    """SELECT user_id, count(*) AS docs, count(*) FILTER (status = 200) AS ok, count(*) FILTER (created_at >= TIMESTAMP '2024-01-01') AS this_month,
  CAST(max(epoch_us(created_at)) AS BIGINT) AS last_us FROM request_log GROUP BY user_id""",
    "request_log",
)
def log_per_user(spark, sf_dir):
    found = request_log.per_user(view(spark, sf_dir, "request_log"), now())
    return found.select("user_id", "docs", "ok", "this_month", F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"))


@query(
    """SELECT id, CASE WHEN status = 102 AND created_at < TIMESTAMP '2024-01-20' - INTERVAL 10 MINUTE THEN 500 ELSE status END AS status,
  CASE WHEN status = 102 AND created_at < TIMESTAMP '2024-01-20' - INTERVAL 10 MINUTE THEN 'INTERRUPTED' ELSE error_code END AS error_code FROM request_log""",
    "request_log",
)
def log_sweep(spark, sf_dir):
    swept = request_log.sweep_pending(view(spark, sf_dir, "request_log"), F.lit("2024-01-20").cast("timestamp"), WINDOW)
    return swept.select("id", "status", "error_code")


@query(
    """SELECT id, CASE status WHEN 200 THEN 'ok' WHEN 102 THEN 'pending' ELSE 'failed' END AS label,
  CASE CASE status WHEN 200 THEN 'ok' WHEN 102 THEN 'pending' ELSE 'failed' END WHEN 'ok' THEN 'success' WHEN 'pending' THEN 'warning' ELSE 'destructive' END AS tone,
  result_enc IS NOT NULL AND id % 2 = 0 AS changed, result_enc IS NOT NULL AND id % 2 = 1 AS kept FROM request_log""",
    "request_log",
)
def log_labels_and_deletes(spark, sf_dir):
    label = request_log.status_label(F.col("status"))
    rows = request_log.delete_results(view(spark, sf_dir, "request_log"), F.col("id") % 2 == 0)
    return rows.select("id", label.alias("label"), request_log.tone(label).alias("tone"), "changed", F.col("result_enc").isNotNull().alias("kept"))


@query(
    f"""SELECT *, CAST(floor(100.0 * n / max(n) OVER () + 0.5) AS INT) AS width FROM (
  SELECT {FAMILY_SQL} AS family, count(*) AS n FROM request_log WHERE status = 200 AND doc_type IS NOT NULL GROUP BY 1)""",
    "request_log",
)
def log_bars(spark, sf_dir):
    return request_log.bar_widths(request_log.by_family(view(spark, sf_dir, "request_log")))


RATES = {m: (2.0 * (1 + i % 3), 10.0 * (1 + i % 3), 0.25 * (1 + i % 3), 2.5 * (1 + i % 3)) for i, m in enumerate(MODELS[:10])}


@query(
    "SELECT document_id, CASE WHEN count(*) = count(p.input) THEN sum(input_tokens * p.input + output_tokens * p.output + coalesce(cache_read_tokens, 0) * p.cache_read + coalesce(cache_write_tokens, 0) * p.cache_write) / 1000000 END AS cost_usd "
    f"FROM usage_calls c LEFT JOIN (VALUES {', '.join(f'({m!r}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)' for m, (a, b, c, d) in RATES.items())}) p(model, input, output, cache_read, cache_write) ON c.model = p.model GROUP BY document_id",
    "usage_calls",
)
def log_costs(spark, sf_dir):
    prices = spark.createDataFrame([("cloud", m, *r) for m, r in RATES.items()], "backend string, model string, input double, output double, cache_read double, cache_write double")
    calls = view(spark, sf_dir, "usage_calls")
    return request_log.costs(calls.select("document_id"), calls, prices)


@query("SELECT document_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens FROM usage_calls GROUP BY document_id", "usage_calls")
def log_tokens(spark, sf_dir):
    return request_log.tokens(view(spark, sf_dir, "usage_calls"))


# --- identifiers, amounts, dates ---------------------------------------------------------------

_LUHN = "(SELECT sum(CASE WHEN i % 2 = 1 THEN d ELSE CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END END) FROM (SELECT i, CAST(substr(lpad(g, 9, '0'), CAST(i AS INT), 1) AS INT) AS d FROM range(1, 10) t(i))) % 10 = 0"


@query(
    f"""SELECT k, CASE WHEN length(g) BETWEEN 1 AND 9 THEN {_LUHN} END AS valid, CASE WHEN g <> '' AND CAST(g AS HUGEINT) <= 9007199254740991 THEN CAST(g AS BIGINT) END AS number,
  CASE WHEN length(raw) > 4 THEN substr(raw, 1, 2) || '…' || right(raw, 2) WHEN length(raw) >= 3 THEN substr(raw, 1, 1) || '…' || right(raw, 1) ELSE '…' END AS masked, sha256(raw) AS hash
FROM (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM ids)""",
    "ids",
)
def identifiers_checked(spark, sf_dir):
    raw = F.col("raw")
    return view(spark, sf_dir, "ids").select("k", identifiers.id_check(raw).alias("valid"), identifiers.number_of_digits(raw).alias("number"), identifiers.masked(raw).alias("masked"), identifiers.key_hash(raw).alias("hash"))


@query(
    """SELECT k, CASE WHEN good THEN g[1] END AS cheque_number, CASE WHEN good THEN substr(mid, 1, 2) END AS bank_code,
  CASE WHEN good THEN substr(mid, 3, 3) END AS branch_number, CASE WHEN good THEN g[len(g)] END AS account_number
FROM (SELECT *, len(g) >= 3 AND length(mid) >= 5 AS good FROM (SELECT k, g, array_to_string(g[2:len(g) - 1], '') AS mid FROM (SELECT k, regexp_extract_all(line, '[0-9]+') AS g FROM micr)))""",
    "micr",
)
def micr_lines(spark, sf_dir):
    return view(spark, sf_dir, "micr").withColumn("p", identifiers.micr_parts(F.col("line"))).select("k", *[F.col("p")[c].alias(c) for c in ("cheque_number", "bank_code", "branch_number", "account_number")])


@query(
    """SELECT k, n, CASE n WHEN 5 THEN raw WHEN 7 THEN trim(raw) WHEN 4 THEN CAST(CAST(replace(substr(raw, 1, length(raw) - 3), ',', '') AS BIGINT) AS STRING) || '.50'
  ELSE regexp_extract(raw, '[0-9]+', 0) || '.00' END AS value, n NOT IN (5, 7) AS parsed FROM amounts""",
    "amounts",
)
def amounts_in_figures(spark, sf_dir):
    return view(spark, sf_dir, "amounts").withColumn("a", amounts.figure_amount(F.col("raw"))).select("k", "n", "a.value", "a.parsed")


@query(
    """SELECT k, y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS printed, y || '-' || lpad(m, 2, '0') AS month,
  CASE WHEN k % 3 = 0 THEN '31.2.' || y ELSE '20' || substr(y, 3, 2) || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') END AS cheque,
  CASE WHEN k % 3 > 0 THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') END AS compact,
  CAST(CAST(DATE '1899-12-30' + CAST(40000 + k % 5000 AS INT) AS DATE) AS STRING) AS serial FROM dates""",
    "dates",
)
def dates_normalized(spark, sf_dir):
    d, m, y = F.col("d"), F.col("m"), F.col("y")
    impossible = F.col("k") % 3 == 0
    cheque = F.when(impossible, F.concat(F.lit(" 31.2."), y)).otherwise(F.concat_ws("/", d, m, F.substring(y, 3, 2)))
    compact = F.when(impossible, F.concat(y, F.lit("0230"))).otherwise(F.concat(y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    return view(spark, sf_dir, "dates").select(
        "k",
        calendar.printed_date(F.concat_ws(".", d, m, y)).alias("printed"),
        calendar.printed_date(F.concat_ws("-", m, y)).alias("month"),
        calendar.cheque_date(cheque).alias("cheque"),
        calendar.iso_from_yyyymmdd(compact).alias("compact"),
        calendar.iso_from_cell((F.lit(40000) + F.col("k") % 5000).cast("string")).alias("serial"),
    )


@query(
    """WITH r AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS value FROM documents), d AS (
  SELECT doc_id, value, i, CAST(substr(value, CAST(i AS INT), 1) AS INT) AS d FROM r, range(1, 10) t(i) WHERE length(value) = 9),
s AS (SELECT doc_id, value, sum(CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END) % 10 = 0 AS good FROM d GROUP BY ALL)
SELECT doc_id, CASE WHEN good THEN 'id' ELSE 'candidate' END AS kind, value FROM r LEFT JOIN s USING (doc_id, value) WHERE length(value) BETWEEN 8 AND 10"""
)
def sensitive_numbers(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(identifiers.sensitive_runs(F.col("text"), [])).alias("r"))
    return found.select("doc_id", "r.kind", "r.value")


@query("SELECT doc_id, len(l) AS n, len(list_distinct(l)) AS n_distinct, len(l) >= 20 AND len(list_distinct(l)) < 0.25 * len(l) AS degenerate FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def transcripts_degenerate(spark, sf_dir):
    lines = F.split("text", "\n")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(lines).cast("long").alias("n"), F.size(F.array_distinct(lines)).cast("long").alias("n_distinct"), geometry.is_degenerate(lines).alias("degenerate"))


# --- registries --------------------------------------------------------------------------------


def registry_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The registries with tokens and numbers, written as a loader writes them."""
    people = view(spark, sf_dir, "nbctf_individuals")
    tables = {
        "boi_accounts": view(spark, sf_dir, "boi_accounts"),
        "boi_severe": view(spark, sf_dir, "boi_severe").withColumn("tokens", names.name_tokens(F.col("name"))),
        "nbctf_individuals": people.withColumns({"tokens": names.name_tokens(F.col("name_en")), "ids": identifiers.long_numbers(F.col("id_text"))}),
        "companies": view(spark, sf_dir, "companies").withColumn("tokens", names.name_tokens(F.col("name_en"))),
    }
    return {source: table if source == "boi_accounts" else written(table, source) for source, table in tables.items()}


def name_indexes(tables: dict[str, DataFrame], *sources: str) -> dict[str, NameIndex]:
    return {s: NameIndex.build(tables[s], [F.col("tokens")], registries.ORDER[s]) for s in sources}


@query(
    """SELECT source, position, total, key FROM (
  SELECT 'boi_severe' AS source, id_number AS key, CAST(row_number() OVER (ORDER BY id_number) AS INT) AS position, count(*) OVER () AS total FROM boi_severe WHERE starts_with(lower(name), 'supplier#00000000')
  UNION ALL SELECT 'companies', number, CAST(row_number() OVER (ORDER BY number) AS INT), count(*) OVER () FROM companies WHERE false) WHERE position <= 50""",
    "boi_severe",
    "companies",
)
def registry_search_names(spark, sf_dir):
    return searched_names(spark, sf_dir, ("boi_severe", "companies"), "supplier 00000000")


def searched_names(spark, sf_dir, sources, name, whole=False):
    """(source, position, total, key) of a name search over posting indexes."""
    tables = {s: view(spark, sf_dir, s) for s in sources}
    indexes = {s: NameIndex.build(t, [names.name_tokens(F.col("name" if s == "boi_severe" else "name_en"))], registries.ORDER[s]) for s, t in tables.items()}
    found = registries.search(tables, registries.Query.parsed({"name": name}), whole=whole, indexes=indexes)
    key = F.coalesce(*[F.get_json_object("record", f"$.{c}") for c in ("id_number", "number", "seq")]).cast("bigint")
    return found.select("source", "position", "total", key.alias("key"))


@query(
    """SELECT * FROM (
  SELECT 'nbctf_individuals' AS source, seq AS key, CAST(row_number() OVER (ORDER BY seq) AS INT) AS position, count(*) OVER () AS total FROM nbctf_individuals WHERE regexp_matches(name_en, '^Person MACHINERY ') AND contains(name_en, '#00000')
  UNION ALL SELECT 'companies', number, CAST(row_number() OVER (ORDER BY number) AS INT), count(*) OVER () FROM companies WHERE false) WHERE position <= 50""",
    "nbctf_individuals",
    "companies",
)
def registry_search_phrases(spark, sf_dir):
    """A phrase whose last token is the beginning of one, and a word with a token after it in the name."""
    return searched_names(spark, sf_dir, ("nbctf_individuals", "companies"), "machinery/customer/00000 person")


@query(
    """SELECT * FROM (
  SELECT 'companies' AS source, number AS key, CAST(row_number() OVER (ORDER BY number) AS INT) AS position, count(*) OVER () AS total FROM companies WHERE regexp_matches(name_en, '^ACME .* NATION_1$')
  UNION ALL SELECT 'boi_severe', id_number, CAST(row_number() OVER (ORDER BY id_number) AS INT), count(*) OVER () FROM boi_severe WHERE false) WHERE position <= 50""",
    "boi_severe",
    "companies",
)
def registry_search_whole(spark, sf_dir):
    """Whole words only: a token that goes on is no hit."""
    return searched_names(spark, sf_dir, ("boi_severe", "companies"), "nation_1 acme", whole=True)


@query(
    """SELECT source, position, total FROM (SELECT 'boi_accounts' AS source, CAST(row_number() OVER (ORDER BY bank, branch, account) AS INT) AS position, count(*) OVER () AS total FROM boi_accounts WHERE account = 40 AND bank IS NOT NULL)""",
    "boi_accounts",
)
def registry_search_account(spark, sf_dir):
    return registries.search(registry_tables(spark, sf_dir), registries.Query.parsed({"account": "0-0040"})).select("source", "position", "total")


_LOOKUPS = """l AS (SELECT document_id, 0 AS pos, 'id_number' AS field, CAST(id_number AS BIGINT) AS id FROM payloads UNION ALL SELECT document_id, 1, 'spouse_id_number', CAST(spouse_id_number AS BIGINT) FROM payloads
  UNION ALL SELECT document_id, 2, 'drawer_id_number', CAST(drawer_id_number AS BIGINT) FROM payloads UNION ALL SELECT document_id, 3, 'guarantor_id_number', CAST(guarantor_id_number AS BIGINT) FROM payloads),
k AS (SELECT * FROM l WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, id ORDER BY pos) = 1)"""
_MATCHES = f"""{_LOOKUPS}, m AS (
  SELECT document_id, field, 'id' AS "by", 'boi_severe' AS source, CASE WHEN coalesce(end_date >= '{TODAY}', true) THEN 'alert' ELSE 'info' END AS level, CAST(id_number AS STRING) AS record_key FROM k JOIN boi_severe ON id = id_number
  UNION ALL SELECT document_id, field, 'id', 'nbctf_individuals', CASE WHEN cancelled THEN 'info' ELSE 'alert' END, CAST(seq AS STRING) FROM k JOIN nbctf_individuals ON id = 510000000 + seq OR id = 20000 + seq
  UNION ALL SELECT document_id, field, 'id', 'companies', CASE WHEN status = 'פעילה' THEN 'info' ELSE 'alert' END, CAST(number AS STRING) FROM k JOIN companies ON id = number
  UNION ALL SELECT document_id, 'account', 'account', 'boi_accounts', CASE WHEN end_date >= '{TODAY}' THEN 'alert' ELSE 'info' END, concat_ws('/', bank, branch, account)
    FROM payloads p JOIN boi_accounts a ON CAST(p.bank_code AS INT) = a.bank AND CAST(p.branch_number AS INT) = a.branch AND CAST(p.account_number AS BIGINT) = a.account
  UNION ALL SELECT document_id, 'name_en', 'name', 'nbctf_individuals', CASE WHEN cancelled THEN 'info' ELSE 'alert' END, CAST(seq AS STRING)
    FROM payloads p JOIN nbctf_individuals n ON p.first_name_en = 'Person' AND split_part(n.name_en, ' ', 3) = p.last_name_en)"""
_REGISTRIES = ("payloads", "boi_severe", "nbctf_individuals", "companies", "boi_accounts")


def screening_payloads(spark, sf_dir):
    blank = F.lit(None).cast("string")
    return view(spark, sf_dir, "payloads").withColumns({"child_id_numbers": F.lit(None).cast("array<string>"), "first_name_he": blank, "last_name_he": blank})


@query(f"WITH {_MATCHES} SELECT * FROM m", *_REGISTRIES)
def registry_screening(spark, sf_dir):
    tables = registry_tables(spark, sf_dir)
    found = registries.screen(screening_payloads(spark, sf_dir), tables, F.lit(TODAY), name_indexes(tables, "nbctf_individuals"))
    return found.select("document_id", "field", "by", "source", "level", "record_key")


_KEY_ORDER = "[" + ", ".join(repr(k) for k in registries.LOOKUP_KEYS) + "]"
_SOURCE_ORDER = "[" + ", ".join(repr(s) for s in registries.CARRIED) + "]"


@query(
    f"""WITH {_MATCHES} SELECT document_id, field, source, level, record_key, CAST(row_number() OVER (PARTITION BY document_id
  ORDER BY level <> 'alert', list_position({_KEY_ORDER}, field), list_position({_SOURCE_ORDER}, source), TRY_CAST(record_key AS BIGINT)) AS INT) AS place FROM m""",
    *_REGISTRIES,
)
def registry_match_order(spark, sf_dir):
    """Each document's matches, alerts first."""
    tables = registry_tables(spark, sf_dir)
    found = registries.screen(screening_payloads(spark, sf_dir), tables, F.lit(TODAY), name_indexes(tables, "nbctf_individuals"))
    return registries.in_order(found).select("document_id", "field", "source", "level", "record_key", "place")


@query(f'WITH {_MATCHES} SELECT document_id, level, source, "by", count(*) AS n FROM m GROUP BY ALL', *_REGISTRIES)
def registry_summary(spark, sf_dir):
    found = registries.screen(screening_payloads(spark, sf_dir), registry_tables(spark, sf_dir), F.lit(TODAY))
    return registries.summary(found).drop("first")


@query(
    """SELECT document_id, concat_ws(',', 'id_number', CASE WHEN CAST(spouse_id_number AS BIGINT) <> CAST(id_number AS BIGINT) THEN 'spouse_id_number' END,
  CASE WHEN CAST(drawer_id_number AS BIGINT) NOT IN (CAST(id_number AS BIGINT), CAST(spouse_id_number AS BIGINT)) THEN 'drawer_id_number' END,
  CASE WHEN CAST(guarantor_id_number AS BIGINT) NOT IN (CAST(id_number AS BIGINT), CAST(spouse_id_number AS BIGINT), coalesce(CAST(drawer_id_number AS BIGINT), 0)) THEN 'guarantor_id_number' END,
  CASE WHEN account_number IS NOT NULL THEN 'account' END, CASE WHEN first_name_en IS NOT NULL THEN 'name_en' END) AS checked FROM payloads""",
    "payloads",
)
def registry_checked_keys(spark, sf_dir):
    found = registries.checked_keys(screening_payloads(spark, sf_dir), registry_tables(spark, sf_dir))
    return found.select("document_id", F.array_join("checked", ",").alias("checked"))


@query("SELECT seq, array_to_string([510000000 + seq, 20000 + seq], ',') AS ids, 'person,' || lower(split_part(name_en, ' ', 2)) || ',customer,' || right(name_en, 9) AS tokens FROM nbctf_individuals", "nbctf_individuals")
def registry_index(spark, sf_dir):
    rows = registry_tables(spark, sf_dir)["nbctf_individuals"]
    return rows.select("seq", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("tokens", ",").alias("tokens"))


# --- geometry and triage -----------------------------------------------------------------------

_PX = "(x2 - x1) * width / 1000.0 AS w, (y2 - y1) * height / 1000.0 AS h"
_KINDS = f"""k AS (SELECT b.*, CASE WHEN least(w, h) <= 0 OR greatest(w, h) < 250 OR greatest(w, h) > 3.5 * least(w, h) OR EXISTS (SELECT 1 FROM boxes o WHERE o.page_id = b.page_id
  AND (o.x2 - o.x1) * (o.y2 - o.y1) > (b.x2 - b.x1) * (b.y2 - b.y1)
  AND greatest(least(b.x2, o.x2) - greatest(b.x1, o.x1), 0) * greatest(least(b.y2, o.y2) - greatest(b.y1, o.y1), 0) > 0.5 * (b.x2 - b.x1) * (b.y2 - b.y1)) THEN 'none' END AS kind
  FROM (SELECT *, {_PX} FROM boxes) b)"""


def paged_boxes(spark, sf_dir):
    item = F.struct("idx", F.array("x1", "y1", "x2", "y2").alias("b"))
    pages = view(spark, sf_dir, "boxes").groupBy("page_id", "width", "height").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return pages.select("page_id", "width", "height", F.col("items.idx").alias("idx"), F.col("items.b").alias("boxes"))


@query(f"WITH {_KINDS} SELECT page_id, count(*) AS n, count(kind) AS n_none, count(kind) > 1 OR count(kind) = 1 AND count(*) = 1 AS junk FROM k GROUP BY page_id", "boxes")
def pages_gated(spark, sf_dir):
    kinds = geometry.box_kinds(F.col("boxes"), F.col("width"), F.col("height"))
    return paged_boxes(spark, sf_dir).withColumn("k", kinds).select(
        "page_id", F.size("k").cast("long").alias("n"), F.size(F.filter("k", lambda x: x == "none")).cast("long").alias("n_none"), geometry.page_is_junk(F.col("k")).alias("junk")
    )


_TRIAGE_KINDS = "CASE (page_id + idx) % 5 WHEN 0 THEN 'cheque_front' WHEN 1 THEN 'cheque_back' WHEN 2 THEN CASE WHEN page_id % 3 = 0 THEN 'teudat_zehut' ELSE 'none' END ELSE 'none' END"


@query(
    f"""SELECT page_id, idx, CASE WHEN bool_or(identity) OVER (PARTITION BY page_id) THEN identity ELSE kind IN ('cheque_front', 'cheque_back') AND place = 1 END AS read
FROM (SELECT *, kind = 'teudat_zehut' AS identity, row_number() OVER (PARTITION BY page_id, kind ORDER BY y1, idx, x1, x2, y2) AS place FROM (SELECT DISTINCT ON (page_id, idx) *, {_TRIAGE_KINDS} AS kind FROM boxes ORDER BY page_id, idx, x1, y1, x2, y2))""",
    "boxes",
)
def frames_selected(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("page_id", "idx").orderBy("x1", "y1", "x2", "y2"))
    frames = view(spark, sf_dir, "boxes").withColumn("_n", first).filter("_n = 1").select("page_id", "idx", F.expr(_TRIAGE_KINDS).alias("kind"), F.col("y1").alias("top"))
    return triage.selected(frames).select("page_id", "idx", "read")


@query(
    """SELECT page_id, idx, x1, y1, x2, y2, greatest(CAST(trunc(x1 / 1000.0 * width - (x2 - x1) / 1000.0 * width * 0.03) AS INT), 0) AS left_px,
  least(CAST(trunc(y2 / 1000.0 * height + (y2 - y1) / 1000.0 * height * 0.03) AS INT), height) AS bottom_px,
  CAST(round_even(greatest(width, height) / 297.0 * 25.4, 0) AS INT) AS page_dpi FROM boxes WHERE greatest(width, height) / least(width, height) BETWEEN 1.29 AND 1.45""",
    "boxes",
)
def crops_and_dpi(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    boxes = view(spark, sf_dir, "boxes").withColumn("c", geometry.crop_pixels(F.array("x1", "y1", "x2", "y2"), w, h))
    dpi = geometry.estimated_dpi(F.lit("sefach"), F.lit(False), F.lit(1.0), F.lit(1.0), w, h, F.lit(False), F.lit(True))
    return boxes.select("page_id", "idx", "x1", "y1", "x2", "y2", F.col("c")[0].alias("left_px"), F.col("c")[3].alias("bottom_px"), dpi.alias("page_dpi")).filter("page_dpi is not null")


# --- cheques -----------------------------------------------------------------------------------


@query(
    """SELECT k, CASE WHEN bad THEN 'mismatch' WHEN NOT parsed THEN 'unverified' WHEN k % 5 = 0 THEN 'partial' ELSE 'verified' END AS verdict FROM (
  SELECT k, k % 4 < 2 AS parsed, k % 4 < 2 AND k % 5 > 0 AND k % 7 = 0 AS bad FROM micr)""",
    "micr",
)
def cheque_verdicts(spark, sf_dir):
    """Cheques whose account is wrong at every 7th key and unread at every 5th."""
    line = view(spark, sf_dir, "micr").withColumn("p", identifiers.micr_parts(F.col("line")))
    none, number = F.lit(None).cast("string"), F.col("p.account_number")
    account = F.when(F.col("k") % 5 == 0, none).when(F.col("k") % 7 == 0, F.concat(number, F.lit("9"))).otherwise(number)
    records = line.select(
        "k", F.col("line").alias("micr_line"), *[F.col(f"p.{c}").alias(c) for c in ("cheque_number", "bank_code", "branch_number")], account.alias("account_number"),
        *[none.alias(c) for c in ("drawer_id_number", "guarantor_id_number", "guarantor_name", "amount", "amount_in_words")], F.lit(None).cast("boolean").alias("guarantor_signed"),
    )
    return validation.validate_cheque(records).select("k", "verdict")


# --- zones, merging, folds ---------------------------------------------------------------------


@query(
    """SELECT k, k % 7 > 0 AS mrz_valid, CASE WHEN k % 5 = 0 THEN 'mismatch' WHEN k % 7 = 0 THEN 'partial' ELSE 'verified' END AS verdict,
  CAST(1950 AS STRING) || '-01-' || lpad(CAST(1 + k % 27 AS STRING), 2, '0') AS birth, '2030-01-' || lpad(CAST(1 + k % 25 AS STRING), 2, '0') AS expiry FROM zones""",
    "zones",
)
def identity_verdicts(spark, sf_dir):
    """Zones with a wrong last digit at every 7th key, and a wrong birth date read at every 5th."""
    k = F.col("k")
    birth = F.concat(F.lit("1950-01-"), F.lpad((1 + k % 27).cast("string"), 2, "0"))
    records = view(spark, sf_dir, "zones", spread=True).select(
        "k", F.lit("israeli_passport").alias("document_type"), (100000000 + k).cast("string").alias("id_number"), F.when(k % 5 == 0, "1999-09-09").otherwise(birth).alias("date_of_birth"),
        F.lit(None).cast("string").alias("date_of_expiry"), F.lit("f").alias("sex"), F.array("upper_line", "data_line").alias("mrz_lines"),
    )
    told = lambda name: F.filter("cross_checks", lambda c: c["field"] == name)[0]["reference"]
    return validation.validate_identity(records).select("k", "mrz_valid", "verdict", told("date_of_birth").alias("birth"), told("date_of_expiry").alias("expiry"))


_TURN_TYPES = ["teudat_zehut_back", "israeli_passport", "other", "teudat_zehut", "unreadable", "foreign_passport", "teudat_zehut_sefach"]


@query(
    f"""SELECT conv_id AS page_id, arg_min(t, list_position([{", ".join(repr(t) for t in merge.PRIORITY)}], t) * 1000 + turn) AS document_type, count(*) AS n
FROM (SELECT *, CASE (turn + conv_id) % 7 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TURN_TYPES))} END AS t FROM conversations) GROUP BY conv_id"""
)
def pages_merged(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TURN_TYPES]), ((F.col("turn") + F.col("conv_id")) % 7 + 1).cast("int"))
    field = F.struct(F.substring("text", 1, 12).alias("value"), F.lit("high").alias("confidence"))
    records = turns.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"), kind.alias("document_type"), F.create_map(F.lit("last_name_en"), field).alias("fields"), F.lit(None).cast("array<string>").alias("mrz_lines"), F.lit(None).cast("string").alias("notes"))
    counts = records.groupBy("page_id").agg(F.count("*").alias("n"))
    return merge.merged(records).select("page_id", "document_type").join(counts, "page_id")


@query(
    """SELECT CAST(user_id AS STRING) AS request_id, CAST(count(*) FILTER (event_type = 'view') AS INT) AS classified, CAST(count(*) FILTER (event_type = 'click') AS INT) AS read_count,
  CAST(count(*) FILTER (event_type = 'purchase') AS INT) AS n_notes FROM events GROUP BY user_id"""
)
def stage_progress(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.create_map(*[F.lit(x) for x in ("view", "classified", "click", "read", "purchase", "note")])
    none = F.lit(None).cast("string")
    staged = events.select(
        F.col("user_id").cast("string").alias("request_id"), F.col("event_id").alias("seq"), F.coalesce(F.try_element_at(kind, "event_type"), F.lit("later")).alias("type"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.lit(None).cast("int").alias("i"), *[none.alias(c) for c in ("kind", "text", "document_type", "items", "error")],
    )
    return stages.progress(staged).select("request_id", "classified", "read_count", "n_notes")


@query(
    """WITH RECURSIVE r AS (SELECT CAST(user_id AS STRING) AS key, epoch_ms(ts) AS ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
s AS (SELECT key, event_id AS request, n, ms, 1.0::DOUBLE AS tokens, true AS allowed, NULL::INT AS wait FROM r WHERE n = 1
  UNION ALL SELECT key, event_id, n, ms, t - CASE WHEN t >= 1 THEN 1 ELSE 0 END, t >= 1, CASE WHEN t < 1 THEN CAST(greatest(1, ceil((1 - t) / (2::DOUBLE / 60000) / 1000)) AS INT) END
  FROM (SELECT r.*, least(2::DOUBLE, s.tokens + (r.ms - s.ms) * (2::DOUBLE / 60000)) AS t FROM s JOIN r ON r.key = s.key AND r.n = s.n + 1))
SELECT key, request, allowed, wait AS retry_after_s FROM s"""
)
def request_budget(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    requests = events.select(F.col("user_id").cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("request"))
    return limits.token_bucket(requests, 2)


@query(
    """SELECT k, CASE k % 4 WHEN 0 THEN 'verified' WHEN 1 THEN NULL WHEN 2 THEN 'x' ELSE 'z' END AS left, CASE k % 4 WHEN 1 THEN 'y' WHEN 3 THEN 'w' WHEN 0 THEN 'other' END AS right FROM ids WHERE k % 4 <> 2
UNION ALL SELECT k, 'x', NULL FROM ids WHERE k % 4 = 2""",
    "ids",
)
def runs_compared(spark, sf_dir):
    """Two runs that differ in value, or hold a field on one side only."""
    k = F.col("k")
    ids = view(spark, sf_dir, "ids").select(k.alias("file"), F.lit("f").alias("name"))
    left = ids.withColumn("value", F.when(F.col("file") % 4 == 0, "verified").when(F.col("file") % 4 == 2, "x").when(F.col("file") % 4 == 3, "z")).dropna()
    right = ids.withColumn("value", F.when(F.col("file") % 4 == 1, "y").when(F.col("file") % 4 == 3, "w").when(F.col("file") % 4 == 0, "other")).dropna()
    return merge.run_diff(left, right).select(F.col("file").alias("k"), "left", "right")


@query(
    f"""SELECT user_id, count(*) AS docs, count(*) FILTER (status = 200) AS ok, count(*) FILTER (created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS last_30_days,
  count(*) FILTER (status <> 200) AS failed_this_month FROM request_log GROUP BY user_id""",
    "request_log",
)
def log_user_detail(spark, sf_dir):
    return request_log.user_detail(view(spark, sf_dir, "request_log"), now(), WINDOW).select("user_id", "docs", "ok", "last_30_days", "failed_this_month")
