"""Line deduplication by site-relative frequency.

A line's share of its host is the number of the host's pages with the line, divided
by all pages of the host. Lines above ``ratio`` are boilerplate and go from every page of
that host; the first copy goes too. A line of one page only (fewer than ``MIN_PAGES``) is no
repetition, so a host's only page keeps its lines.

Lines are compared without blanks, tabs and carriage returns at their ends, by a
64-bit hash. Blank lines are never boilerplate. A null host is a host of its own, a
null text stays null and still counts as a page, a page that loses all lines becomes
the empty text, and equal rows count as pages each.

A host has at most ``average distinct lines of a page / ratio`` boilerplate lines, but
hosts are unbounded, so the table is broadcast only up to ``BROADCAST_LINES`` lines;
beyond that it is joined by host, and the pages of a host with more than one page in
``HOT`` are dealt out in parts by a hash of their text, each with a copy of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.hot_keys import HOT
from papyrine.workspace import written

RATIO = 0.1
MIN_PAGES = 2
BROADCAST_LINES = 200_000


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """(host, line hash, pages with it, pages of the host) of every boilerplate line."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    distinct = F.array_distinct(F.transform(F.filter(lines, lambda x: ~_is_blank(x)), _line_key))
    own = pages.select(F.col(host).alias("host"), distinct.alias("lines"))
    totals = own.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = own.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages"))
    joined = counts.filter(F.col("pages") >= MIN_PAGES).alias("c").join(totals.alias("t"), F.expr("c.host <=> t.host"))
    return joined.filter(F.col("pages") > ratio * F.col("host_pages")).select("c.host", "line", "pages", "host_pages")


def _joined_in_parts(rows: DataFrame, of_host: DataFrame, found: DataFrame, n_pages: int, host: str, text: str) -> DataFrame:
    parts = F.ceil(F.col("host_pages") * HOT / n_pages).cast("int").alias("_parts")
    # hosts with more than one page in HOT: under HOT rows
    hot = found.filter(F.col("host_pages") * HOT > n_pages).select(F.col("host").alias("_hot"), parts).distinct()
    hot = F.broadcast(written(hot, "hot-hosts"))
    copies = of_host.join(hot, F.col("_host").eqNullSafe(F.col("_hot")), "left")
    copies = copies.select("_host", "_lines", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
    own = rows.join(hot, F.col("_row")[host].eqNullSafe(F.col("_hot")), "left")
    own = own.select("_row", F.pmod(F.xxhash64(F.col("_row")[text]), F.coalesce("_parts", F.lit(1))).cast("int").alias("_own"))
    return own.join(copies, F.col("_row")[host].eqNullSafe(F.col("_host")) & (F.col("_own") == F.col("_part")), "left")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """``pages`` with boilerplate lines cut out of ``text``, and the columns ``n_lines`` and
    ``n_dropped`` (null for a null text), which take the place of columns so named."""
    found = written(boilerplate(pages, host, text, ratio), "boilerplate")
    small = found.count() <= BROADCAST_LINES
    of_host = found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line").alias("_lines"))
    own = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    rows = pages.select(F.struct(*own).alias("_row"))  # the table's names cannot clash with those used here
    if small:
        joined = rows.join(F.broadcast(of_host), F.col("_row")[host].eqNullSafe(F.col("_host")), "left")
    else:
        joined = _joined_in_parts(rows, of_host, found, pages.count(), host, text)
    lines = F.split(F.col("_row")[text], "\n")
    kept = F.filter(lines, lambda x: _is_blank(x) | ~F.array_contains(F.col("_lines"), _line_key(x)))
    cut = joined.withColumns({"_all": F.size(lines), "_kept": F.when(F.col("_lines").isNull(), lines).otherwise(kept)})
    has_text = F.col("_row")[text].isNotNull()
    return cut.select(
        *[F.array_join("_kept", "\n").alias(c) if c == text else F.col("_row")[c].alias(c) for c in own],
        F.when(has_text, F.col("_all")).cast("long").alias("n_lines"),
        F.when(has_text, F.col("_all") - F.size("_kept")).cast("long").alias("n_dropped"),
    )
