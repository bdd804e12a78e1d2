"""Queries over keys, invitations, admissions, settings, pages of the log and answers, each with the
DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import accounts, request_log, responses
from papyrine.plans.adapters import pick, view
from papyrine.plans.queries import WINDOW, now, query

ADMIN = "u7@x.test"
IDENTITY_TYPES = ["teudat_zehut", "teudat_zehut_back", "teudat_zehut_sefach", "israeli_passport", "foreign_passport", "israeli_drivers_license", "disability_card"]


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM key_events),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS live, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS key_id, CAST(NULL AS VARCHAR) AS outcome FROM e
  UNION ALL SELECT e.user_id, e.n,
    CASE WHEN e.kind = 'revoke' THEN list_filter(live, lambda x: x <> e.key_id) WHEN len(live) < {accounts.MAX_ACTIVE_KEYS} THEN list_append(live, e.key_id) ELSE live END, e.seq, e.key_id,
    CASE WHEN e.kind = 'revoke' THEN CASE WHEN list_contains(live, e.key_id) THEN 'revoked' ELSE 'not_found' END WHEN len(live) < {accounts.MAX_ACTIVE_KEYS} THEN 'created' ELSE 'refused' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, seq, key_id, outcome, CAST(len(live) AS INT) AS active FROM s WHERE n > 0""",
    "key_events",
)
def account_key_outcomes(spark, sf_dir):
    return accounts.key_outcomes(view(spark, sf_dir, "key_events"))


@query(
    """SELECT o_orderkey AS id, o_custkey AS user_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS position,
  count(*) FILTER (o_orderkey % 3 > 0) OVER (PARTITION BY o_custkey) AS active FROM orders"""
)
def account_key_listing(spark, sf_dir):
    keys = _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.lit("h").alias("hash"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).alias("revoked_at")
    )
    return accounts.key_listing(keys).select("id", "user_id", "position", "active")


@query("SELECT count(*) AS users, count(*) FILTER (c_custkey % 50 = 0) AS admins FROM customer")
def account_admins(spark, sf_dir):
    return accounts.admin_count(_customers(spark, sf_dir).select(F.when(F.col("c_custkey") % 50 == 0, "admin").otherwise("user").alias("role")))


@query(
    """SELECT c_custkey AS user_id, c_custkey % 2 = 0 AS store_results, c_custkey % 3 = 0 AS check_registries, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS model,
  CASE WHEN c_nationkey < 12 THEN 'small' END AS local_model, CASE WHEN c_nationkey < 12 AND c_custkey % 2 = 0 THEN 'local' END AS backend, 'base' AS default_model,
  CASE WHEN c_custkey % 7 = 0 THEN right(c_name, 4) END AS key_last4, c_custkey % 7 = 0 AS has_key FROM customer"""
)
def account_settings(spark, sf_dir):
    k, stored = F.col("c_custkey"), F.col("c_custkey") % 7 == 0
    settings = _customers(spark, sf_dir).select(
        k.alias("user_id"), (k % 2 == 0).alias("store_results"), (k % 3 == 0).alias("check_registries"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("model"), F.lit("small").alias("local_model"),
        F.when(k % 2 == 0, "local").alias("backend"), F.when(stored, F.concat(F.lit("v1:"), F.col("c_name"))).alias("key_enc"), F.when(stored, F.right("c_name", F.lit(4))).alias("key_last4"), "c_nationkey",
    )
    return accounts.public_settings(settings, F.col("c_nationkey") < 12, "base")


@query("SELECT c_custkey AS user_id, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_nationkey DESC, c_custkey DESC LIMIT 30 OFFSET 15")
def account_listing(spark, sf_dir):
    users = _customers(spark, sf_dir).select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("created_at"))
    return accounts.user_listing(users, 30, 15).select("user_id", "total")


@query(
    """WITH s AS (SELECT id, lower(trim(max(email))) AS email, min(moment) FILTER (kind = 'sent') AS sent, max(moment) FILTER (kind IN ('sent', 'resent')) AS created,
    min(moment) FILTER (kind = 'accepted') AS accepted, min(moment) FILTER (kind = 'revoked') AS revoked FROM invitation_events GROUP BY id),
n AS (SELECT *, least(revoked, lead(sent) OVER (PARTITION BY email ORDER BY sent, id)) AS closed FROM s)
SELECT id, email, CAST(epoch_us(created) AS BIGINT) AS created_us, CAST(epoch_us(created + INTERVAL 30 DAY) AS BIGINT) AS expires_us,
  CASE WHEN accepted <= coalesce(closed, accepted) THEN 'accepted' WHEN closed IS NOT NULL THEN 'revoked' ELSE 'pending' END AS status FROM n""",
    "invitation_events",
)
def account_invitation_states(spark, sf_dir):
    states = accounts.invitation_states(view(spark, sf_dir, "invitation_events").withColumnRenamed("moment", "at"))
    return states.select("id", "email", F.unix_micros("created_at").alias("created_us"), F.unix_micros("expires_at").alias("expires_us"), "status")


@query(
    f"""WITH f AS (SELECT user_id, lower(email) AS email, moment FROM sign_ups WHERE verified AND user_id % 5 > 0),
m AS (SELECT f.*, i.id, row_number() OVER (PARTITION BY f.user_id ORDER BY i.created_at DESC, i.id DESC) AS r
  FROM f JOIN invites i ON i.email = f.email AND i.status = 'pending' AND i.expires_at > f.moment AND i.created_at <= f.moment),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY moment, user_id) AS q FROM m WHERE r = 1),
a AS (SELECT user_id, moment FROM f WHERE email = '{ADMIN}' ORDER BY moment, user_id LIMIT 1),
b AS (SELECT a.user_id, max_by(i.id, (i.created_at, i.id)) AS id FROM a LEFT JOIN invites i ON i.email = '{ADMIN}' AND i.status = 'pending' AND i.created_at <= a.moment GROUP BY a.user_id)
SELECT user_id, 'admin' AS role, '{ADMIN}' AS email, id AS invitation_id FROM b
UNION ALL SELECT user_id, 'user', email, id FROM g WHERE q = 1 AND user_id NOT IN (SELECT user_id FROM b) AND id NOT IN (SELECT id FROM b WHERE id IS NOT NULL)""",
    "sign_ups",
    "invites",
)
def account_admissions(spark, sf_dir):
    """Sign-ups against invitations, where every fifth is a user already and none is an admin."""
    sign_ups = view(spark, sf_dir, "sign_ups").withColumnRenamed("moment", "at")
    users = sign_ups.filter("user_id % 5 = 0").select("user_id", F.lit("user").alias("role"))
    return accounts.admitted_accounts(sign_ups, view(spark, sf_dir, "invites"), users, ADMIN).select("user_id", "role", "email", "invitation_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 AND NOT (o_custkey % 4 = 0 AND c_custkey IS NOT NULL) THEN o_custkey END AS accepted_user_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def account_invitations_unlinked(spark, sf_dir):
    sent = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("accepted_user_id"))
    return accounts.unlinked_invitations(sent, _customers(spark, sf_dir).filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id")))


_ASKED = ["CASE WHEN event_id % 11 = 0 THEN -event_id ELSE event_id END AS id", "CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE user_id END AS user_id"]


@query(f"SELECT a.id, a.user_id, l.id IS NOT NULL AS found, l.result_enc FROM (SELECT {', '.join(_ASKED)} FROM events) a LEFT JOIN request_log l ON l.id = a.id AND l.user_id = a.user_id", "request_log")
def log_stored_results(spark, sf_dir):
    """Results asked for by their owners, by others, and under numbers that do not exist."""
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_ASKED)
    return request_log.stored_results(view(spark, sf_dir, "request_log"), asked)


_PAGE = pick("user_id % 4", ["1", "2", "99", "x"])


@query(
    f"""SELECT user_id, id, CAST(position AS INT) AS position, CAST(page AS INT) AS page, total FROM (
  SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position, total,
    least(coalesce(TRY_CAST({_PAGE} AS INT), 1), ceil(total / {request_log.DETAIL_PAGE}.0)) AS page
  FROM request_log JOIN (SELECT user_id, count(*) AS total FROM request_log GROUP BY user_id) USING (user_id))
WHERE position > (page - 1) * {request_log.DETAIL_PAGE} AND position <= page * {request_log.DETAIL_PAGE}""",
    "request_log",
)
def log_recent_pages(spark, sf_dir):
    log = view(spark, sf_dir, "request_log")
    asked = log.select("user_id").distinct().withColumn("page", F.expr(_PAGE))
    return request_log.recent_page(log, asked).select("user_id", "id", "position", "page", "total")


@query(
    """SELECT user_id, count(*) AS docs, user_id % 3 = 0 AND user_id % 2 = 0 AS store_results, CASE WHEN user_id % 3 = 0 THEN 'm' || CAST(user_id AS STRING) END AS model FROM request_log GROUP BY user_id""",
    "request_log",
)
def log_user_settings(spark, sf_dir):
    log, user = view(spark, sf_dir, "request_log"), F.col("user_id")
    settings = log.filter("user_id % 3 = 0").select("user_id").distinct().withColumns({"store_results": user % 2 == 0, "model": F.concat(F.lit("m"), user.cast("string"))})
    return request_log.user_detail(log, now(), WINDOW, settings).select("user_id", "docs", "store_results", "model")


_KINDS = ["teudat_zehut", "other", "unreadable", "israeli_passport", "other", "foreign_passport", "disability_card"]
_IDENTITY = f"kind IN ({', '.join(repr(t) for t in IDENTITY_TYPES)})"


@query(
    f"""SELECT k, branch, CASE branch WHEN 'cheque' THEN CASE WHEN k % 8 = 0 THEN 'unreadable' ELSE 'cheque' END WHEN 'identity' THEN coalesce(classified, kind) ELSE branch END AS document_type,
  CASE branch WHEN 'not_a_document' THEN concat_ws(' | ', '{responses.NOTHING}', run)
  WHEN 'identity' THEN concat_ws(' | ', run, CASE WHEN kind = 'unreadable' THEN '{responses.UNREADABLE}' END, CASE WHEN k % 2 = 0 AND k % 9 > 4 THEN '{responses.BAD_ZONE}' END,
    CASE WHEN k % 11 < 3 THEN '{responses.BAD_ID}' END, CASE WHEN k % 13 = 0 THEN '{responses.ZONE_DIFFERS}' END, CASE WHEN k % 17 = 0 THEN 'note ' || CAST(k AS STRING) END,
    '{responses.UNTUNED[0]}' || classified || '{responses.UNTUNED[1]}')
  ELSE concat_ws(' | ', run, CASE WHEN k % 8 = 0 THEN '{responses.UNREADABLE}' END, CASE WHEN k % 9 > 4 THEN '{responses.UNPARSED_LINE}' END,
    CASE WHEN k % 10 IN (2, 4) THEN '{responses.LINE_DIFFERS}' END, CASE WHEN k % 6 = 2 THEN '{responses.WORDS_DIFFER}' WHEN k % 6 = 4 THEN '{responses.UNPARSED_WORDS}' END,
    CASE WHEN k % 11 < 3 THEN '{responses.BAD_ID}' END, CASE WHEN k % 13 < 3 THEN '{responses.BAD_GUARANTOR}' END, CASE WHEN k % 17 = 0 THEN 'note ' || CAST(k AS STRING) END) END AS warnings
FROM (SELECT *, CASE WHEN k % 4 = 0 AND NOT coalesce({_IDENTITY}, FALSE) THEN 'cheque' WHEN kind IS NULL OR kind = 'other' AND classified IS NULL THEN 'not_a_document' ELSE 'identity' END AS branch
  FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN {pick("o_orderkey % 7", _KINDS)} END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'weapon_license' END AS classified,
    CASE WHEN o_orderkey % 19 > 9 THEN 'run warning' END AS run FROM orders))"""
)
def responses_shaped(spark, sf_dir):
    """Answers whose records, marks and warnings follow the order's number."""
    k = F.col("k")
    text = lambda *values: F.when(k < 0, "").otherwise(F.try_element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int")))
    note = F.when(k % 17 == 0, F.concat(F.lit("note "), k.cast("string"))).otherwise("")
    identity = F.struct(
        text(*_KINDS).alias("document_type"), note.alias("notes"), (k % 2 == 0).alias("mrz_present"), (k % 9 <= 4).alias("mrz_valid"), (k % 11 >= 3).alias("id_valid"),
        F.when(k % 13 == 0, "mismatch").otherwise("partial").alias("verdict"),
    )
    check = lambda field, seen, known: F.struct(F.lit(field).alias("field"), seen.alias("visual"), known.alias("reference"), F.coalesce(seen == known, F.lit(False)).alias("match"))
    checks = F.array(check("account_number", text("1", "1", "1", "1", "7", None, "3", "3", "3", None), text("1", None, "2", "1", "8", "5", "3", "3", "3", None)), check("amount", text(*["5.00"] * 6), text("5.00", None, "6.00", "5.00", None, "5.00")))
    cheque = F.struct(
        F.when(k % 8 == 0, "unreadable").otherwise("cheque").alias("document_type"), note.alias("notes"), F.lit(True).alias("micr_present"), (k % 9 <= 4).alias("micr_parsed"), checks.alias("cross_checks"),
        F.lit("five").alias("amount_in_words"), (k % 11 >= 3).alias("id_valid"), (k % 13 >= 3).alias("guarantor_id_valid"),
    )
    results = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k")).select(
        "k", F.when(k % 5 > 0, identity).alias("identity"), F.when(k % 4 == 0, cheque).alias("cheque"), F.when(k % 3 == 0, "weapon_license").alias("classified_type"),
        F.when(k % 19 > 9, F.array(F.lit("run warning"))).alias("run_warnings"),
    )
    return responses.shaped(results, IDENTITY_TYPES).select("k", "branch", "document_type", F.array_join("warnings", " | ").alias("warnings"))
