"""Queries over accounts, names, frames and figures, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.functions import display, geometry, names
from papyrine.operators import accounts, clean, merge, request_log, validation
from papyrine.plans.adapters import pick, view
from papyrine.plans.queries import query


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


@query(
    """SELECT c_custkey AS user_id,
  CASE WHEN c_custkey % 5 = 0 THEN 'local' WHEN c_custkey % 3 = 0 THEN 'byok' WHEN c_custkey % 7 = 0 OR c_custkey % 4 = 0 OR c_nationkey < 10 THEN 'trial' ELSE 'exhausted' END AS mode,
  CAST(greatest(10 - c_nationkey, 0) AS INT) AS trial_left, c_custkey % 7 = 0 OR c_custkey % 4 = 0 AS unlimited,
  'cloud' || CAST(c_nationkey AS STRING) AS backend, 'm/' || c_mktsegment || '/1' AS model,
  CASE WHEN c_custkey % 2 = 0 THEN 'read:key:' || CAST(c_custkey AS STRING) ELSE 'read:user:' || CAST(c_nationkey AS STRING) END AS budget FROM customer"""
)
def account_modes(spark, sf_dir):
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    unlimited = accounts.is_unlimited(F.when(k % 7 == 0, "admin").otherwise("user"), F.when(k % 4 == 0, True))
    model = accounts.model_parts(F.concat(F.lit("cloud"), nation.cast("string"), F.lit("/m/"), F.col("c_mktsegment"), F.lit("/1")))
    return _customers(spark, sf_dir).select(
        k.alias("user_id"),
        accounts.request_mode(F.when(k % 5 == 0, "none").otherwise("key"), k % 3 == 0, unlimited, nation, F.lit(10)).alias("mode"),
        accounts.trial_left(F.lit(10), nation).cast("int").alias("trial_left"), unlimited.alias("unlimited"), model["backend"].alias("backend"), model["model"].alias("model"),
        accounts.budget_key(F.lit("read"), F.when(k % 2 == 0, k.cast("string")), nation.cast("string")).alias("budget"),
    )


@query(
    """SELECT o_orderkey AS key_id, o_custkey AS user_id, lower(trim(c_name)) || '@x.test' AS email FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 > 0 AND c_custkey % 10 > 0"""
)
def account_keys_resolved(spark, sf_dir):
    address = names.email(F.concat(F.lit(" "), F.col("c_name"), F.lit("@X.test ")))
    users = _customers(spark, sf_dir).filter("c_custkey % 10 > 0").select(F.col("c_custkey").alias("user_id"), address.alias("email"))
    keys = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("key_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("revoked_at"))
    return accounts.resolve_keys(keys, users).select("key_id", "user_id", "email")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'accepted' WHEN o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1997-01-01' THEN 'expired' ELSE 'pending' END AS status, c_name AS inviter_email
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 > 0) ON o_custkey = c_custkey"""
)
def account_invitations(spark, sf_dir):
    users = _customers(spark, sf_dir).filter("c_custkey % 10 > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    sent = _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("invited_by"), F.when(F.col("o_orderkey") % 4 == 0, "accepted").otherwise("pending").alias("status"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
    )
    return accounts.with_inviter(sent, users, F.lit("1997-01-01").cast("timestamp")).select("id", "status", "inviter_email")


@query(
    """SELECT id, CASE WHEN status = 'pending' AND row_number() OVER (PARTITION BY address ORDER BY o_orderdate DESC, id DESC) > 1 THEN 'revoked' ELSE status END AS status FROM (
  SELECT o_orderkey AS id, 'u' || CAST(o_custkey % 97 AS STRING) || '@x.test' AS address, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status FROM orders)"""
)
def account_invitations_current(spark, sf_dir):
    address = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("u")).otherwise(F.lit(" U")), (F.col("o_custkey") % 97).cast("string"), F.lit("@x.test"))
    sent = _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), address.alias("email"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 == 0, "accepted").otherwise("pending").alias("status")
    )
    return accounts.current_invitations(sent).select("id", "status")


@query(
    """SELECT u.user_id, coalesce(a.docs, 0) AS docs, coalesce(a.ok, 0) AS ok, u.user_id % 3 = 0 AS has_key FROM (SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 8 > 0) u
LEFT JOIN (SELECT user_id, count(*) AS docs, count(*) FILTER (status = 200) AS ok FROM request_log GROUP BY user_id) a USING (user_id)""",
    "request_log",
)
def account_page(spark, sf_dir):
    everyone = _customers(spark, sf_dir).select(F.col("c_custkey").alias("user_id"))
    keys = everyone.select("user_id", F.when(F.col("user_id") % 3 == 0, "v1:x").alias("key_enc"))
    left = accounts.without_user({"users": everyone}, everyone.filter("user_id % 8 = 0"))["users"]
    totals = request_log.per_user(view(spark, sf_dir, "request_log"), F.lit("2024-01-31").cast("timestamp"))
    return accounts.user_page(left, totals, keys).select("user_id", "docs", "ok", "has_key")


@query(
    """SELECT user_id, arg_min(lower(email), seen) AS email, CAST(epoch_us(min(seen)) AS BIGINT) AS first_us, CAST(epoch_us(max(seen)) AS BIGINT) AS last_us,
  CASE WHEN user_id = (SELECT user_id FROM events ORDER BY ts, user_id LIMIT 1) THEN 'admin' ELSE 'user' END AS role
FROM (SELECT user_id, ts AS seen, 'U' || CAST(user_id AS STRING) || '-' || CAST(event_id AS STRING) || '@x.test' AS email FROM events) GROUP BY user_id"""
)
def account_sign_ins(spark, sf_dir):
    address = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_id").cast("string"), F.lit("@x.test"))
    sign_ins = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", address.alias("email"), F.col("ts").cast("timestamp").alias("at"))
    return accounts.registered(sign_ins).select("user_id", "email", F.unix_micros("created_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), "role")


@query(
    """WITH RECURSIVE v AS (SELECT user_id, epoch_us(ts) AS us FROM events), k AS (
  SELECT user_id, min(us) AS us FROM v GROUP BY user_id
  UNION ALL SELECT user_id, us FROM (SELECT k.user_id, (SELECT min(v.us) FROM v WHERE v.user_id = k.user_id AND v.us >= k.us + 86400000000) AS us FROM k) WHERE us IS NOT NULL)
SELECT user_id, CAST(us AS BIGINT) AS us FROM k"""
)
def account_last_seen(spark, sf_dir):
    """Visits that rewrite ``last_seen``, here once a day at most."""
    visits = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return accounts.throttled_last_seen(visits, 86_400).select("user_id", F.unix_micros("written_at").alias("us"))


@query(
    """SELECT k, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'cell ' || CAST(k AS STRING) WHEN 2 THEN NULL ELSE 'x' END AS cell, CASE WHEN k % 3 = 0 THEN NULL ELSE 'Co "' || CAST(k AS STRING) || '"' END AS company,
  CASE k % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'F' ELSE NULL END AS sex, 'B, C1' AS categories, 'Main St' AS street, 'ab' || CAST(k AS STRING) AS plain,
  k % 2 = 0 AS good_email, CASE WHEN k % 5 = 0 THEN NULL ELSE 'a · ' || CAST(k AS STRING) END AS aliases, CASE WHEN k % 2 = 0 THEN 'children' END AS parent, CASE WHEN k % 2 = 0 THEN 2 END AS ordinal,
  CASE WHEN k % 2 = 0 THEN 'id_number' ELSE 'sex' END AS leaf, CASE WHEN k % 2 = 0 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN k % 3 = 0 THEN 'short' ELSE 'word word…' END AS note FROM (SELECT o_orderkey AS k FROM orders)"""
)
def cells_cleaned(spark, sf_dir):
    k = F.col("o_orderkey")
    number = k.cast("string")
    path = names.field_path(F.when(k % 2 == 0, "children[2].id_number").otherwise("sex"))
    return _orders(spark, sf_dir).select(
        k.alias("k"),
        names.cell_or_null(F.when(k % 4 == 0, " --- ").when(k % 4 == 1, F.concat(F.lit(" cell "), number, F.lit(" "))).when(k % 4 == 2, "").otherwise("x")).alias("cell"),
        names.company_text(F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" Co ~"), number, F.lit("~ ")))).alias("company"),
        names.sex_code(F.when(k % 4 == 0, " m").when(k % 4 == 1, "f").when(k % 4 == 2, "נקבה ").otherwise("?")).alias("sex"),
        names.licence_categories(F.when(k % 2 == 0, " b ;c1").otherwise("B,, C1,")).alias("categories"),
        names.street_without_number(F.concat(F.lit("Main St "), number), number).alias("street"),
        names.alphanumeric(F.concat(F.lit("A-b "), number, F.lit("."))).alias("plain"),
        names.email_valid(F.when(k % 2 == 0, F.concat(number, F.lit("@x.test"))).otherwise(F.concat(number, F.lit("@x")))).alias("good_email"),
        names.joined_aliases(F.when(k % 5 == 0, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.lit("a"), F.lit(""), number))).alias("aliases"),
        path["parent"].alias("parent"), path["ordinal"].alias("ordinal"), path["leaf"].alias("leaf"),
        names.capped_confidence(F.when(k % 2 == 0, "high").otherwise("low")).alias("confidence"),
        names.capped_note(F.when(k % 3 == 0, "short").otherwise("word word, cut"), 12).alias("note"),
    )


@query(
    """SELECT k, CASE WHEN ms >= 1000 THEN printf('%.1f', ms / 1000.0) || 's' ELSE CAST(ms AS STRING) || 'ms' END AS duration,
  CASE WHEN k % 3 = 0 THEN '—' WHEN k % 3 = 1 THEN '<$0.001' ELSE '$' || printf('%.3f', CAST(k AS DOUBLE) / 1000) END AS cost,
  CAST(n AS STRING) || ' KB' AS size, lpad(CAST(1 + k % 28 AS STRING), 2, '0') || '.02.2011' AS day, '11 · Bank B' AS bank
FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey * 37 % 5000 / 50) AS BIGINT) * 100 AS ms, CAST(1 + o_orderkey % 900 AS BIGINT) AS n FROM orders)"""
)
def figures_shown(spark, sf_dir):
    k = F.col("o_orderkey")
    ms = F.floor(k * 37 % 5000 / 50) * 100
    usd = F.when(k % 3 == 0, F.lit(None).cast("double")).when(k % 3 == 1, F.lit(0.0002)).otherwise(k.cast("double") / 1000)
    return _orders(spark, sf_dir).select(
        k.alias("k"), display.duration(ms).alias("duration"), display.cost(usd).alias("cost"), display.file_size((1 + k % 900) * 1024).alias("size"),
        display.field_date(F.concat(F.lit("2011-02-"), F.lpad((1 + k % 28).cast("string"), 2, "0"))).alias("day"), display.bank_label(F.lit(11), {"11": "Bank B"}).alias("bank"),
    )


@query(
    """SELECT page_id, idx, x1, y1, x2, y2, CASE WHEN dpi > 0 AND abs(300.0 / dpi - 1) > 0.15 THEN 300.0 / dpi ELSE 1.0 END AS factor, dpi
FROM (SELECT *, CAST(round_even(width / 85.6 * 25.4, 0) AS INT) AS dpi FROM boxes)""".replace("300.0", f"{float(geometry.TARGET_DPI)}::DOUBLE").replace("0.15", str(geometry.RESAMPLE_TOLERANCE)).replace("85.6", str(geometry.CARD_MM)),
    "boxes",
)
def frames_measured(spark, sf_dir):
    """Frames of cards on pages without the shape of paper: their resolution and its change."""
    boxes = view(spark, sf_dir, "boxes").withColumns({"kind": F.when(F.col("idx") > 0, geometry.CARD_KINDS[0]), "page_width": F.col("height") * 10})
    no = F.col("idx") < 0
    dpi = geometry.estimated_dpi(F.col("kind"), ~no, F.col("width").cast("double"), F.col("height").cast("double"), F.col("page_width"), F.col("height"), no, no)
    boxes = boxes.withColumn("dpi", dpi)
    return boxes.select("page_id", "idx", "x1", "y1", "x2", "y2", geometry.resample_factor(F.col("dpi")).alias("factor"), "dpi")


_VOTES = "sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS up, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS down, count(*) AS n, count(*) FILTER (l_tax > 0.02) AS tall"


@query(
    f"""SELECT part, CASE WHEN n >= {geometry.MIN_VOTES} AND up + down > 0 AND abs(up - down) >= {geometry.MIN_MARGIN} * (up + down) THEN CASE WHEN down > up THEN 180 ELSE 0 END END AS turn,
  n >= {geometry.MIN_VOTES} AND tall >= {geometry.TALL_SHARE} * n AS sideways FROM (SELECT l_partkey AS part, {_VOTES} FROM lineitem GROUP BY l_partkey)"""
)
def rotations_decided(spark, sf_dir):
    vote = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "0").otherwise("180").alias("label"), F.col("l_quantity").cast("double").alias("score"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pages = lines.groupBy(F.col("l_partkey").alias("part")).agg(F.collect_list(vote).alias("votes"), F.collect_list(F.col("l_tax") > 0.02).alias("tall"))
    return pages.select("part", geometry.decided_rotation(F.col("votes")).alias("turn"), geometry.lies_sideways(F.col("tall")).alias("sideways"))


@query("SELECT page_id, count(*) = 1 AND max((x2 - x1) * (y2 - y1)) > 800000 AS whole FROM boxes GROUP BY page_id", "boxes")
def pages_whole(spark, sf_dir):
    box = F.array("x1", "y1", "x2", "y2")
    pages = view(spark, sf_dir, "boxes").groupBy("page_id").agg(F.collect_list(box).alias("boxes"))
    return pages.select("page_id", geometry.whole_page(F.col("boxes")).alias("whole"))


# --- records: cheques with amounts, merged pages, cleaned fields ---------------------------------

_WORDS = ['ארבעת אלפים וחמש מאות ש"ח', "מאתיים ארבעים אלף ומאה", "אלף ומאה שח בלבד", "בלה בלה", None, None]
_FIGURES = ["4500.00", "240100.00", "700.00", "11.00", "4500", None]
_DRAWERS = ["123456782", "123456782", "123456782", "123456783", None]
_GUARANTORS = ["300000007", None, "123456783", None, None, None, None]


@query(
    f"""SELECT k, CASE WHEN k % 6 = 2 OR k % 5 = 3 OR k % 7 = 2 THEN 'mismatch' WHEN k % 11 = 0 THEN 'unverified' WHEN k % 7 IN (1, 3) OR k % 6 IN (3, 4) THEN 'partial' ELSE 'verified' END AS verdict,
  {pick("k % 6", ["4500.00", "240100.00", "1100.00", None, None, None])} AS words, CASE WHEN k % 5 < 4 THEN k % 5 < 3 END AS id_valid,
  CASE WHEN k % 7 = 0 AND k % 5 < 4 THEN FALSE WHEN k % 7 = 2 AND k % 5 < 4 THEN k % 5 = 3 END AS guarantor_is_drawer FROM (SELECT o_orderkey AS k FROM orders)"""
)
def cheque_amounts(spark, sf_dir):
    """Cheques with figures, Hebrew words, drawers and guarantors, whose line is absent at every 11th key."""
    k = F.col("o_orderkey")
    records = _orders(spark, sf_dir).select(
        k.alias("k"), F.when(k % 11 > 0, "80001234 11 14841 0000123456").alias("micr_line"), F.lit("80001234").alias("cheque_number"), F.lit("11").alias("bank_code"), F.lit("148").alias("branch_number"),
        F.lit("123456").alias("account_number"), F.expr(pick("o_orderkey % 6", _FIGURES)).alias("amount"), F.expr(pick("o_orderkey % 6", _WORDS)).alias("amount_in_words"),
        F.expr(pick("o_orderkey % 5", _DRAWERS)).alias("drawer_id_number"), F.expr(pick("o_orderkey % 7", _GUARANTORS)).alias("guarantor_id_number"), F.when(k % 7 == 1, "x").alias("guarantor_name"),
        (k % 7 == 3).alias("guarantor_signed"),
    )
    words = F.filter("cross_checks", lambda c: c["field"] == "amount")
    return validation.validate_cheque(records).select("k", "verdict", F.try_element_at(words, F.lit(1))["reference"].alias("words"), "id_valid", "guarantor_is_drawer")


def _fields(**values):
    """Map of fields from (value, confidence) columns."""
    pairs = [x for name, (value, sure) in values.items() for x in (F.lit(name), F.struct(value.alias("value"), sure.alias("confidence")))]
    return F.create_map(*pairs)


_OTHERS = ["israeli_drivers_license", "teudat_zehut_back", "israeli_passport"]


@query(
    f"""SELECT k, name, sure, address, lines, notes, CASE WHEN stranger THEN 'Ignored a ' || other || ' block belonging to a different person (ID number differs)'
  WHEN NOT fills AND k % 4 > 0 THEN 'last_name_en differs between teudat_zehut and ' || other ELSE '' END AS warnings FROM (
  SELECT k, other, stranger, fills, CASE WHEN taken THEN 'COHEN' WHEN k % 4 > 0 THEN 'LEVI' END AS name,
    CASE WHEN taken THEN CASE WHEN k % 2 = 0 THEN 'high' ELSE 'medium' END WHEN k % 5 = 0 THEN 'medium' ELSE 'high' END AS sure,
    CASE WHEN NOT stranger AND k % 3 < 2 THEN 'Main 1' END AS address, CASE WHEN NOT stranger THEN 'L' ELSE '' END AS lines,
    CASE WHEN stranger OR fills THEN CASE WHEN k % 2 = 0 THEN 'a' END ELSE concat_ws('; ', CASE WHEN k % 2 = 0 THEN 'a' END, 'b') END AS notes
  FROM (SELECT *, NOT stranger AND (k % 4 = 0 OR NOT fills AND k % 5 = 0 AND k % 2 = 0) AS taken
    FROM (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS stranger, o_orderkey % 3 = 1 AS fills, {pick("o_orderkey % 3", _OTHERS)} AS other FROM orders)))"""
)
def pages_merged_fields(spark, sf_dir):
    """Two documents a page: the second fills gaps, corrects unsure names, or is of another person."""
    k, high, medium = F.col("o_orderkey"), F.lit("high"), F.lit("medium")
    number = k.cast("string")
    keys = _orders(spark, sf_dir)
    first = keys.select(
        k.alias("page_id"), F.lit(0).alias("pos"), F.lit("teudat_zehut").alias("document_type"),
        _fields(id_number=(F.concat(F.lit("A"), number), high), last_name_en=(F.when(k % 4 > 0, "LEVI"), F.when(k % 5 == 0, medium).otherwise(high))).alias("fields"),
        F.lit(None).cast("array<string>").alias("mrz_lines"), F.when(k % 2 == 0, "a").alias("notes"),
    )
    second = keys.select(
        k.alias("page_id"), F.lit(1).alias("pos"), F.expr(pick("o_orderkey % 3", _OTHERS)).alias("document_type"),
        _fields(
            id_number=(F.when(k % 7 == 0, F.concat(F.lit("B"), number)).when(k % 7 > 1, F.concat(F.lit("A-"), number)), high),
            last_name_en=(F.lit("COHEN"), F.when(k % 2 == 0, high).otherwise(medium)), address=(F.when(k % 3 < 2, "Main 1"), high),
        ).alias("fields"),
        F.array(F.lit("L")).alias("mrz_lines"), F.lit("b").alias("notes"),
    )
    name, address = (F.try_element_at("fields", F.lit(n)) for n in ("last_name_en", "address"))
    lines = F.array_join(F.coalesce("mrz_lines", F.array().cast("array<string>")), "|")
    return merge.merged(first.unionByName(second)).select(
        F.col("page_id").alias("k"), name["value"].alias("name"), name["confidence"].alias("sure"), address["value"].alias("address"), lines.alias("lines"), "notes", F.array_join("warnings", "; ").alias("warnings")
    )


@query(
    """SELECT k, CASE WHEN k % 3 = 1 THEN '2010-01-01' ELSE '2015-02-05' END AS issue, CASE WHEN k % 3 = 1 THEN 'medium' ELSE 'high' END AS issue_sure,
  CASE k % 3 WHEN 0 THEN '2025-02-05' WHEN 1 THEN '2015-02-05' END AS expiry, CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS expiry_sure,
  CASE WHEN k % 4 < 2 THEN '9' ELSE '' END || CAST(k AS STRING) AS number, CASE WHEN k % 4 = 0 THEN 'medium' ELSE 'high' END AS number_sure,
  CASE WHEN k % 5 = 0 THEN 'F' END AS sex, CAST(NULL AS STRING) AS licence FROM (SELECT o_orderkey AS k FROM orders)"""
)
def identity_cleaned(spark, sf_dir):
    """Cards with swapped or equal dates, anchored numbers, a gated sex and a field that no card carries."""
    k, high = F.col("o_orderkey"), F.lit("high")
    number = k.cast("string")
    fields = _fields(
        date_of_issue=(F.lit("5.2.2015"), high), date_of_expiry=(F.when(k % 3 == 0, "05.02.2025").when(k % 3 == 1, "1.1.2010").otherwise("05/02/2015"), high),
        id_number=(F.when(k % 4 != 1, number), high), sex=(F.lit("F"), high), license_number=(F.lit("77"), high),
    )
    anchors = F.when(k % 4 < 2, F.create_map(F.lit("id_number"), F.concat(F.lit("9"), number)))
    cards = _orders(spark, sf_dir).select(k.alias("k"), F.lit("teudat_zehut").alias("document_type"), fields.alias("fields"), F.when(k % 5 == 0, F.array(F.lit("sex"))).alias("printed"), anchors.alias("anchors"))
    of = lambda name: F.try_element_at("fields", F.lit(name))
    return clean.identity(cards).select(
        "k", of("date_of_issue")["value"].alias("issue"), of("date_of_issue")["confidence"].alias("issue_sure"), of("date_of_expiry")["value"].alias("expiry"),
        of("date_of_expiry")["confidence"].alias("expiry_sure"), of("id_number")["value"].alias("number"), of("id_number")["confidence"].alias("number_sure"), of("sex")["value"].alias("sex"),
        of("license_number")["value"].alias("licence"),
    )


@query(
    """SELECT k, CASE WHEN k % 4 = 1 THEN '300000007' WHEN k % 4 = 0 THEN '123456782' ELSE '123456783' END AS id_number, CASE WHEN k % 4 = 1 THEN 'medium' ELSE 'high' END AS id_confidence,
  CASE WHEN k % 3 = 0 THEN 'Bank B' ELSE 'read' END AS bank, CAST(k % 900 + 100 AS STRING) AS branch, CASE WHEN k % 2 = 0 THEN '123456782' END AS drawer FROM (SELECT o_orderkey AS k FROM orders)"""
)
def cheques_cleaned(spark, sf_dir):
    """Cheques with the bank's listed name, a branch of five digits and short numbers, and re-read identity numbers."""
    k, high = F.col("o_orderkey"), F.lit("high")
    fields = _fields(
        bank_code=(F.when(k % 3 == 0, "011").otherwise("99"), high), bank_name=(F.lit("read"), high), drawer_id_number=(F.when(k % 2 == 0, "1234-56782").otherwise("12345"), high),
        branch_number=(F.concat((k % 900 + 100).cast("string"), F.when(k % 5 == 0, "-41").otherwise("")), high),
    )
    read = F.when(k % 4 == 0, "123456782").when(k % 4 == 1, "0300000007").otherwise("123456783")
    again = F.when(k % 4 == 1, "300000007").when(k % 4 == 3, "123456783").otherwise("123456782")
    none = F.lit(None)
    cheques = _orders(spark, sf_dir).select(
        k.alias("k"), F.lit("cheque").alias("document_type"), fields.alias("fields"), none.cast("array<string>").alias("printed"), none.cast("map<string,string>").alias("anchors"),
        read.alias("id_number"), again.alias("reread"), high.alias("id_confidence"),
    )
    of = lambda name: F.try_element_at("fields", F.lit(name))["value"]
    return clean.reread_ids(clean.cheque(cheques, {"11": "Bank B"})).select("k", "id_number", "id_confidence", of("bank_name").alias("bank"), of("branch_number").alias("branch"), of("drawer_id_number").alias("drawer"))
