"""Analytics of the request log: listing, facets, usage windows and dashboard aggregates.

One row a request: id, user_id, created_at, status, doc_type, verdict, mode, source, backend,
model, tokens_in, tokens_out, latency_ms, cost_usd, result_enc. Every operator takes the whole
log and groups by user where a caller would ask for one user, so a page of one user is a filter
on its result, and the partition column of the stored log is ``user_id``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OK, PENDING, INTERRUPTED = 200, 102, 500
PAGE_DEFAULT, PAGE_MAX, DETAIL_PAGE = 50, 200, 20
# Document families of region types, and classifier words for the same.
FAMILIES: dict[str, list[str]] = {
    "teudat_zehut": ["teudat_zehut", "teudat_zehut_back", "teudat_zehut_sefach"],
    "israeli_passport": ["israeli_passport"],
    "foreign_passport": ["foreign_passport"],
    "israeli_drivers_license": ["israeli_drivers_license"],
    "disability_card": ["disability_card"],
    "senior_citizen_card": ["senior_citizen_card"],
    "weapon_license": ["weapon_license"],
    "cheque": ["cheque", "cheque_back"],
    "not_a_document": ["not_a_document", "other", "unreadable"],
}
ALIASES = {"sefach": "teudat_zehut", "drivers_license": "israeli_drivers_license", "cheque_front": "cheque"}


def family(doc_type: Column) -> Column:
    """Family of a region or classifier type; unknown types are no documents, null stays null."""
    known = {t: f for f, types in FAMILIES.items() for t in types} | ALIASES
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.when(doc_type.isNotNull(), F.coalesce(F.try_element_at(lookup, doc_type), F.lit("not_a_document")))


def status_label(status: Column) -> Column:
    return F.when(status == OK, "ok").when(status == PENDING, "pending").when(status.isNotNull(), "failed")


#: Tones of status words (fixed values); other words are neutral.
TONES = {
    "success": ["verified", "ok", "high", "accepted", "active"],
    "warning": ["partial", "pending", "medium", "running", "interrupted"],
    "destructive": ["mismatch", "failed", "low", "error", "revoked", "expired"],
}


def tone(word: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for t, words in TONES.items() for w in words for x in (w, t)])
    return F.coalesce(F.try_element_at(lookup, word), F.lit("neutral"))


def metadata(log: DataFrame) -> DataFrame:
    """All columns but the stored result, of which only its being there is told."""
    return log.withColumn("has_result", F.col("result_enc").isNotNull()).drop("result_enc")


def parse_filters(params: Mapping[str, str | Sequence[str]]) -> dict[str, str]:
    """The usable filters of request parameters: the first of repeated ones, none that is empty
    or malformed."""
    out = {}
    for name in ("family", "verdict", "status", "backend", "source", "from", "to"):
        value = params.get(name, "")
        value = value if isinstance(value, str) else next(iter(value), "")
        if not value or name == "status" and value not in ("ok", "pending", "failed"):
            continue
        if name in ("from", "to") and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            continue
        out[name] = value
    return out


def matches(filters: Mapping[str, str]) -> Column:
    """The conjunction of the given filters; days are UTC and inclusive, an unknown family holds
    for nothing."""
    created, out = F.col("created_at"), F.lit(True)
    if "family" in filters:
        out &= F.col("doc_type").isin(FAMILIES[filters["family"]]) if filters["family"] in FAMILIES else F.lit(False)
    for name in ("verdict", "backend", "source"):
        if name in filters:
            out &= F.col(name) == filters[name]
    if "status" in filters:
        out &= status_label(F.col("status")) == filters["status"]
    if "from" in filters:
        out &= created >= F.lit(filters["from"]).cast("timestamp")
    if "to" in filters:
        out &= created < F.lit(filters["to"]).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    return out


def page_bounds(limit: int | None, offset: int | None) -> tuple[int, int]:
    return min(max(limit if limit is not None else PAGE_DEFAULT, 1), PAGE_MAX), max(offset or 0, 0)


def page_arithmetic(total: Column, size: int, asked: Column) -> Column:
    """Struct (pages, page): at least one page, and the asked one (default 1) within them."""
    pages = F.greatest(F.ceil(total / size), F.lit(1)).cast("int")
    page = F.when(asked.rlike("^[0-9]{1,9}$"), asked.try_cast("int"))
    page = F.when(page >= 1, page).otherwise(1)
    return F.struct(pages.alias("pages"), F.least(page, pages).alias("page"))


def listing(log: DataFrame, filters: Mapping[str, str] | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Each user's page of requests, newest first, with ``position`` and the user's ``total``."""
    size, skip = page_bounds(limit, offset)
    rows = metadata(log.filter(matches(filters or {})))
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    totals = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    ranked = rows.withColumn("position", F.row_number().over(newest)).filter((F.col("position") > skip) & (F.col("position") <= skip + size))
    return ranked.join(totals, "user_id")


def stored_results(log: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked requests (id, user_id) with ``found`` and the stored result: one of another user
    is not found, one whose result was not kept is found without it."""
    rows = log.select("id", "user_id", "result_enc", F.lit(True).alias("_found"))
    return asked.join(rows, ["id", "user_id"], "left").select(*asked.columns, F.coalesce("_found", F.lit(False)).alias("found"), "result_enc")


def recent_page(log: DataFrame, asked: DataFrame, size: int = DETAIL_PAGE) -> DataFrame:
    """The page of requests that each user (user_id, page: text) asks for, clamped to the pages there are."""
    totals = log.groupBy("user_id").agg(F.count("*").alias("total"))
    pages = asked.join(totals, "user_id").withColumn("page", page_arithmetic(F.col("total"), F.lit(size), F.col("page"))["page"])
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = metadata(log).withColumn("position", F.row_number().over(newest))
    return ranked.join(pages, "user_id").filter((F.col("position") > (F.col("page") - 1) * size) & (F.col("position") <= F.col("page") * size))


def facets(log: DataFrame) -> DataFrame:
    """Per user: families in display order, and sorted verdicts, backends and sources."""
    order = F.array(*[F.lit(f) for f in FAMILIES])
    sets = log.groupBy("user_id").agg(
        F.collect_set(family(F.col("doc_type"))).alias("_families"), *[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("verdict", "backend", "source")]
    )
    return sets.withColumn("families", F.filter(order, lambda f: F.array_contains("_families", f))).drop("_families")


def dashboard(log: DataFrame, now: Column) -> DataFrame:
    """Per user, in one pass: total, last_30_days, median_latency_ms, cost_30_days, cost_total.

    The median is the lower one of successful requests; costs are those of successful priced
    requests, null without one."""
    recent = F.col("created_at") >= now - F.expr("INTERVAL 30 DAYS")
    ok = F.col("status") == OK
    return log.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(recent).alias("last_30_days"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) FILTER (WHERE status = {OK})").cast("long").alias("median_latency_ms"),
        F.sum(F.when(ok & recent, F.col("cost_usd"))).alias("cost_30_days"),
        F.sum(F.when(ok, F.col("cost_usd"))).alias("cost_total"),
    )


def by_family(log: DataFrame, *keys: str) -> DataFrame:
    """Successful requests by family (n, largest first)."""
    rows = log.filter((F.col("status") == OK) & F.col("doc_type").isNotNull())
    return rows.groupBy(*keys, family(F.col("doc_type")).alias("family")).agg(F.count("*").alias("n"))


def by_verdict(log: DataFrame, *keys: str) -> DataFrame:
    rows = log.filter((F.col("status") == OK) & F.col("verdict").isNotNull())
    return rows.groupBy(*keys, "verdict").agg(F.count("*").alias("n"))


def bar_widths(counts: DataFrame, n: str = "n", *keys: str) -> DataFrame:
    """Add ``width``: per cent of the largest count (of the keys' group), rounded half up."""
    tops = counts.groupBy(*keys).agg(F.max(n).alias("_top"))
    # without keys a single row
    joined = counts.join(tops, list(keys)) if keys else counts.join(F.broadcast(tops))
    width = F.when(F.col("_top") > 0, F.round(100 * F.col(n) / F.col("_top"))).otherwise(0).cast("int")
    return joined.withColumn("width", width).drop("_top")


def usage(log: DataFrame, now: Column, pending_window: str) -> DataFrame:
    """Per user: this UTC month's documents, successes and failures, all documents, and used
    trial documents: successful ones and reservations younger than ``pending_window``."""
    month = F.date_trunc("month", now)
    in_month, ok = F.col("created_at") >= month, F.col("status") == OK
    fresh = (F.col("status") == PENDING) & (F.col("created_at") > now - F.expr(f"INTERVAL {pending_window}"))
    counts = log.groupBy("user_id").agg(
        F.count_if(in_month).alias("docs_this_month"),
        F.count_if(in_month & ok).alias("ok_this_month"),
        F.count("*").alias("total"),
        F.count_if((F.col("mode") == "trial") & (ok | fresh)).alias("trial_used"),
    )
    failed = F.col("docs_this_month") - F.col("ok_this_month")
    return counts.select("user_id", F.date_format(month, "yyyy-MM").alias("month"), "docs_this_month", "ok_this_month", failed.alias("failed_this_month"), "total", "trial_used")


def sweep_pending(log: DataFrame, now: Column, pending_window: str) -> DataFrame:
    """Reservations older than the window become failures."""
    stale = (F.col("status") == PENDING) & (F.col("created_at") < now - F.expr(f"INTERVAL {pending_window}"))
    return log.withColumns({"error_code": F.when(stale, "INTERRUPTED").otherwise(F.col("error_code")), "status": F.when(stale, INTERRUPTED).otherwise(F.col("status"))})


def delete_results(log: DataFrame, chosen: Column) -> DataFrame:
    """Stored results of the chosen rows become null, and ``changed`` tells which had one."""
    gone = chosen & F.col("result_enc").isNotNull()
    return log.withColumns({"changed": gone, "result_enc": F.when(~chosen, F.col("result_enc"))})


def latest_state(changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The current row of each key of an append-only change log: the last value of every column
    that a later change does not leave null."""
    columns = [c for c in changes.columns if c not in (key, order)]
    return changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def tokens(calls: DataFrame, key: str = "document_id") -> DataFrame:
    """Token totals of each document's model calls; null counts as none."""
    return calls.groupBy(key).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens")])


def costs(documents: DataFrame, calls: DataFrame, prices: DataFrame, key: str = "document_id") -> DataFrame:
    """Cost in USD of each document: its calls' four token classes times the model's rates a
    million; null where a call has no price or there is no call. ``prices`` (backend, model,
    input, output, cache_read, cache_write) is a list of a few rows."""
    # a price list: its size is checked by Spark against the broadcast threshold
    priced = calls.join(prices, ["backend", "model"], "left")
    parts = [F.coalesce(F.col(f"{c}_tokens"), F.lit(0)) * F.col(c) for c in ("input", "output", "cache_read", "cache_write")]
    per_call = sum(parts[1:], parts[0])
    sums = priced.groupBy(key).agg(F.count("*").alias("_calls"), F.count("input").alias("_priced"), F.sum(per_call).alias("_sum"))
    cost = F.when(F.col("_calls") == F.col("_priced"), F.col("_sum") / 1_000_000)
    return documents.select(key).distinct().join(sums, key, "left").select(key, cost.alias("cost_usd"))


def per_user(log: DataFrame, now: Column) -> DataFrame:
    """Per user: documents, successes, documents of this month, last request."""
    return log.groupBy("user_id").agg(
        F.count("*").alias("docs"),
        F.count_if(F.col("status") == OK).alias("ok"),
        F.count_if(F.col("created_at") >= F.date_trunc("month", now)).alias("this_month"),
        F.max("created_at").alias("last_at"),
    )


def user_detail(log: DataFrame, now: Column, pending_window: str, settings: DataFrame | None = None) -> DataFrame:
    """Per user: aggregates, usage of the month and dashboard, side by side; with ``settings`` also
    whether results are stored (false unless set) and the chosen model. ``recent_page`` has the rows."""
    parts = [per_user(log, now), usage(log, now, pending_window).drop("total"), dashboard(log, now)]
    detail = parts[0].join(parts[1], "user_id").join(parts[2], "user_id")
    if settings is None:
        return detail
    return detail.join(settings.select("user_id", "store_results", "model"), "user_id", "left").withColumn("store_results", F.coalesce("store_results", F.lit(False)))
