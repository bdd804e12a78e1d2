"""Machine-readable zones (ICAO 9303): cleaning, layout and check digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.binding import let

LEAST_LINE = 25
TD1, TD3 = 30, 44


def clean_lines(lines: Column) -> Column:
    """Upper-case lines of the zone's alphabet, blanks removed, junk and short lines left out."""
    upper = F.transform(lines, lambda x: F.translate(F.upper(F.btrim(x, F.lit(" \t\n\x0b\f\r"))), " ", ""))
    return F.filter(upper, lambda x: x.rlike(f"^[A-Z0-9<]{{{LEAST_LINE},}}$"))


def refit(line: Column, length: Column) -> Column:
    """A line of another length that ends in fillers gets as many of them as its format asks."""
    core = F.rtrim(line, F.lit("<"))
    fits = (F.length(line) != length) & line.endswith("<") & (F.length(core) <= length)
    return F.when(fits, F.rpad(core, length, "<")).otherwise(line)


#: Letters count from 10 and fillers 0: the last digit of what each counts.
_LETTERS, _LAST_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ<", "012345678901234567890123450"


def check_digit(text: Column) -> Column:
    """Weighted 7-3-1 sum modulo 10; letters count from 10, fillers 0."""
    signs = F.split(F.translate(text, _LETTERS, _LAST_DIGITS), "")
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    weighed = F.transform(signs, lambda c, i: (F.ascii(c) - 48) * F.get(weights, i % 3))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10


def _holds(text: Column, digit: Column) -> Column:
    return F.when(digit == "<", F.translate(text, "<", "") == "").otherwise(check_digit(text).cast("string") == digit)


def _of_shape(lines: Column, td3: Callable[[Column, Column], Column], td1: Callable[[Column, Column], Column] | None = None) -> Column:
    """``td1`` of the first two of three lines of 30, ``td3`` of two lines of 44, null for any other
    shape. The lines are cleaned ones; each is worked out once, as the bodies use them many times."""

    def of_lines(clean: Column) -> Column:
        length = F.when(F.size(clean) == 3, TD1).otherwise(TD3)

        def of_fitted(fitted: Column) -> Column:
            body = lambda f: let(F.get(fitted, F.lit(0)), lambda a: let(F.get(fitted, F.lit(1)), lambda b: f(a, b)))
            shapes = F.when(F.size(fitted) == 2, body(td3))
            return F.when(F.forall(fitted, lambda x: F.length(x) == length), shapes.when(F.size(fitted) == 3, body(td1)) if td1 else shapes)

        return let(F.transform(clean, lambda x: refit(x, length)), of_fitted)

    return let(lines, of_lines)


def parse(lines: Column) -> Column:
    """Struct (format, document_number, optional, issuer, birth, sex, expiry, checks) of the cleaned
    ``lines``: three lines of 30 (TD1) or two of 44 (TD3); null for any other shape."""
    cut = F.substring

    def td3(a: Column, b: Column) -> Column:
        every = F.concat(cut(b, 1, 10), cut(b, 14, 7), cut(b, 22, 22))
        return F.struct(
            F.lit("TD3").alias("format"), cut(b, 1, 9).alias("document_number"), cut(b, 29, 14).alias("optional"), cut(a, 3, 3).alias("issuer"),
            cut(b, 14, 6).alias("birth"), cut(b, 21, 1).alias("sex"), cut(b, 22, 6).alias("expiry"),
            (_holds(cut(b, 1, 9), cut(b, 10, 1)) & _holds(cut(b, 14, 6), cut(b, 20, 1)) & _holds(cut(b, 22, 6), cut(b, 28, 1)) & _holds(cut(b, 29, 14), cut(b, 43, 1)) & _holds(every, cut(b, 44, 1))).alias("checks"),
        )

    def td1(a: Column, b: Column) -> Column:
        every = F.concat(cut(a, 6, 25), cut(b, 1, 7), cut(b, 9, 7), cut(b, 19, 11))
        return F.struct(
            F.lit("TD1").alias("format"), cut(a, 6, 9).alias("document_number"), cut(a, 16, 15).alias("optional"), cut(a, 3, 3).alias("issuer"),
            cut(b, 1, 6).alias("birth"), cut(b, 8, 1).alias("sex"), cut(b, 9, 6).alias("expiry"),
            (_holds(cut(a, 6, 9), cut(a, 15, 1)) & _holds(cut(b, 1, 6), cut(b, 7, 1)) & _holds(cut(b, 9, 6), cut(b, 15, 1)) & _holds(every, cut(b, 30, 1))).alias("checks"),
        )

    return _of_shape(lines, td3, td1)


def zone_date(text: Column, expiry: bool = False) -> Column:
    """YYMMDD to ISO text without a range check: expiries are 20xx, births up to 40 too."""
    year = F.substring(text, 1, 2)
    century = F.lit("20") if expiry else F.when(year.try_cast("int") <= 40, "20").otherwise("19")
    iso = F.concat(century, year, F.lit("-"), F.substring(text, 3, 2), F.lit("-"), F.substring(text, 5, 2))
    return F.when(text.rlike("^[0-9]{6}$"), iso)


def passport_type(lines: Column) -> Column:
    """``israeli_passport`` or ``foreign_passport`` by a TD3 zone's issuing state; else null."""
    return _of_shape(clean_lines(lines), lambda a, b: F.when(F.substring(a, 3, 3) == "ISR", "israeli_passport").otherwise("foreign_passport"))
