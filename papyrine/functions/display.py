"""Text of figures and records as shown to people; a missing value is a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def duration(ms: Column) -> Column:
    return F.when(ms.isNull(), DASH).when(ms >= 1000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s"))).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def cost(usd: Column, decimals: int = 3) -> Column:
    least = 10.0**-decimals
    shown = F.concat(F.lit("$"), F.format_string(f"%.{decimals}f", usd))
    return F.when(usd.isNull(), DASH).when((usd > 0) & (usd < least / 2), F.lit(f"<${least:.{decimals}f}")).otherwise(shown)


def token_pair(tokens_in: Column, tokens_out: Column) -> Column:
    return F.concat_ws(" / ", F.format_number(tokens_in, 0), F.format_number(tokens_out, 0))


def file_size(size: Column) -> Column:
    kb = size / 1024
    whole = F.greatest(F.round(kb), F.lit(1)).cast("long").cast("string")
    return F.when(kb < 1024, F.concat(whole, F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", kb / 1024), F.lit(" MB")))


def field_date(text: Column) -> Column:
    """An exact ISO date or month as the documents print it; null for any other text."""
    shape = r"^\s*([0-9]{4})-(0[1-9]|1[0-2])(?:-(0[1-9]|[12][0-9]|3[01]))?\s*$"
    parts = [F.nullif(F.regexp_extract(text, shape, i), F.lit("")) for i in (3, 2, 1)]
    return F.when(text.rlike(shape), F.concat_ws(".", *parts))


def bank_label(code: Column, names: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.concat_ws(" · ", code.cast("string"), F.try_element_at(lookup, code.cast("string")))


def _line(*parts: Column) -> Column:
    return F.concat_ws(" · ", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def _day(text: Column) -> Column:
    return F.coalesce(field_date(text), text)


def _names(*columns: str) -> Column:
    return F.nullif(F.concat_ws(" / ", *[F.nullif(F.col(c), F.lit("")) for c in columns]), F.lit(""))


def _designated(date: Column) -> Column:
    return F.when(F.col("cancelled"), F.col("note")).otherwise(F.concat(F.lit("designated "), _day(date)))


def record_line(source: str, banks: dict[str, str] | None = None) -> Column:
    """One line of identifying data of a registry row, blanks left out."""
    if source == "companies":
        return _line(F.col("number"), F.coalesce("name_he", "name_en"), F.col("status"), F.col("violator"))
    if source == "boi_severe":
        return _line(F.col("id_number"), F.col("name"), F.concat(F.lit("until "), _day(F.col("end_date"))))
    if source == "boi_accounts":
        return _line(bank_label(F.col("bank"), banks or {}), F.col("branch"), F.col("account"), F.concat_ws("–", _day(F.col("start_date")), _day(F.col("end_date"))))
    if source == "nbctf_individuals":
        return _line(_names("name_he", "name_en", "name_ar"), _designated(F.col("designated")), F.col("designation"))
    return _line(_names("name_he", "name_en", "name_ar"), F.col("corp_id"), _designated(F.coalesce("designated_perm", "designated_temp")), F.col("designation"))
