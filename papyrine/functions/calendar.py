"""Dates as read from documents and registry files. Dates stay ISO text: a month without a day
and unreadable text must survive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions.binding import let


_BLANKS = " \t\n\r\f\x0b"
_DIGITS = "0123456789"


def _two(text: Column) -> Column:
    return F.lpad(text, 2, "0")


def _number(text: Column, *lengths: int) -> Column:
    """Whether a part is all digits and as long as one of ``lengths``."""
    return F.length(text).isin(*lengths) & (F.translate(text, _DIGITS, "") == "")


def _shape(text: Column) -> Column:
    """``text`` with 0 for every digit."""
    return F.translate(text, _DIGITS, "0" * 10)


def printed_date(text: Column) -> Column:
    """``D.M.YYYY`` to ISO and ``M.YYYY`` to an ISO month (also with / and -), without a range
    check; anything else is trimmed."""
    bare = F.btrim(text, F.lit(_BLANKS))

    def read(p: Column) -> Column:
        whole = (F.size(p) == 3) & _number(p[0], 1, 2) & _number(p[1], 1, 2) & _number(p[2], 4)
        month = (F.size(p) == 2) & _number(p[0], 1, 2) & _number(p[1], 4)
        return F.when(whole, F.concat_ws("-", p[2], _two(p[1]), _two(p[0]))).when(month, F.concat_ws("-", p[1], _two(p[0])))

    return F.coalesce(let(F.split(F.translate(bare, "/-", ".."), "[.]"), read), bare)


def _last_day(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def cheque_date(text: Column) -> Column:
    """Handwritten ``D M YY`` or ``D M YYYY`` to ISO, two-digit years in the 2000s; impossible
    dates and other text are trimmed. February has 29 days."""
    bare = F.btrim(text, F.lit(_BLANKS))

    def read(p: Column) -> Column:
        day, month, year = (p[i].try_cast("int") for i in range(3))
        numbers = (F.size(p) == 3) & _number(p[0], 1, 2) & _number(p[1], 1, 2) & _number(p[2], 2, 4)
        last = _last_day(F.lit(2000), month)  # any February may have 29 days
        return F.when(numbers & month.between(1, 12) & day.between(1, last), F.concat_ws("-", F.when(F.length(p[2]) == 2, F.concat(F.lit("20"), p[2])).otherwise(p[2]), _two(p[1]), _two(p[0])))

    parts = F.split(bare, r"\s*[./,-]\s*|\s+")  # one mark with blanks around it, or blanks alone
    return F.when(_shape(bare) == "0000-00-00", bare).otherwise(F.coalesce(let(parts, read), bare))


def _possible(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a date that exists, from 1800 on; else null. Parts are texts of digits."""
    y, m, d = (x.try_cast("int") for x in (year, month, day))
    good = (y >= 1800) & m.between(1, 12) & d.between(1, _last_day(y, m))
    return F.when(good, F.concat_ws("-", F.lpad(year, 4, "0"), _two(month), _two(day)))


def iso_from_yyyymmdd(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_BLANKS))
    return F.when(_shape(bare) == "00000000", let(bare, lambda x: _possible(F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))))


def iso_from_yymmdd(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_BLANKS))
    return F.when(_shape(bare) == "000000", let(bare, lambda x: _possible(F.concat(F.lit("20"), F.substring(x, 1, 2)), F.substring(x, 3, 2), F.substring(x, 5, 2))))


def iso_from_dmy(text: Column) -> Column:
    def read(p: Column) -> Column:
        return F.when((F.size(p) == 3) & _number(p[0], 1, 2) & _number(p[1], 1, 2) & _number(p[2], 4), _possible(p[2], p[1], p[0]))

    return let(F.split(F.btrim(text, F.lit(_BLANKS)), "/"), read)


def iso_from_sheet_serial(serial: Column) -> Column:
    """Days since 1899-12-30, above zero."""
    return F.when(serial > 0, F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")).cast("string"))


def iso_from_cell(text: Column) -> Column:
    """A sheet's date cell: a five-digit serial, perhaps with a fraction, or D/M/YYYY text."""
    return F.when(text.rlike(r"^\s*[0-9]{5}(\.[0-9]+)?\s*$"), iso_from_sheet_serial(F.trim(text).try_cast("double"))).otherwise(iso_from_dmy(text))


def next_local_run(now: Column, zone: str, hour: int, minute: int) -> Column:
    """Next instant strictly after ``now`` (UTC) at which ``zone``'s clock reads the time."""
    local = F.from_utc_timestamp(now, zone)
    today = F.date_trunc("day", local) + F.expr(f"INTERVAL '{hour}:{minute}' HOUR TO MINUTE")
    due = F.to_utc_timestamp(today, zone)
    tomorrow = F.to_utc_timestamp(F.date_trunc("day", local) + F.expr(f"INTERVAL '1 {hour}:{minute}' DAY TO MINUTE"), zone)
    return F.when(due > now, due).otherwise(tomorrow)
