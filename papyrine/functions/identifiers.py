"""Identity numbers, account lines and keys, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest integer that survives a round trip through a double.
SAFE_INTEGER = (1 << 53) - 1


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def digits(text: Column) -> Column:
    """The ASCII digits of ``text``; null stays null."""
    return F.regexp_replace(text, "[^0-9]", "")


def number_of_digits(text: Column) -> Column:
    """All digits of ``text`` as one number; null without digits or beyond 2**53 - 1."""
    value = digits(text).try_cast("decimal(38,0)")
    return F.when(value <= SAFE_INTEGER, value.cast("bigint"))


def id_check(text: Column) -> Column:
    """Whether the 9-digit identity number holds its check digit (Luhn); shorter numbers are
    zero-padded, no digits or more than nine give null."""
    d = digits(text)
    return F.when(F.length(d).between(1, 9), luhn(F.lpad(d, 9, "0")))


def first_valid_id(lines: Column) -> Column:
    """First run ``d ddddddd d`` (blanks or hyphens optional) of an array of lines whose check
    digit holds, as nine digits."""
    runs = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"(?<![0-9])([0-9][\s-]?[0-9]{7}[\s-]?[0-9])(?![0-9])"), F.lit(1))))
    return F.try_element_at(F.filter(F.transform(runs, digits), lambda x: luhn(x)), F.lit(1))


def long_numbers(text: Column) -> Column:
    """Distinct numbers of five digits and more, in the order met."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]{5,}"), F.lit(0))
    values = F.transform(found, lambda x: x.try_cast("decimal(38,0)"))
    return F.array_distinct(F.transform(F.filter(values, lambda x: x <= SAFE_INTEGER), lambda x: x.cast("bigint")))


def same_number(a: Column, b: Column) -> Column:
    """Equal digits but for leading zeros, both sides being there; never null."""
    equal = F.ltrim(digits(a), F.lit("0")) == F.ltrim(digits(b), F.lit("0"))
    return F.coalesce((a != "") & (b != "") & equal, F.lit(False))


def micr_parts(line: Column) -> Column:
    """Struct (cheque_number, bank_code, branch_number, account_number) of a magnetic-ink line:
    its first and last digit groups, and the joined groups between as bank 2 + branch 3; null
    with fewer than three groups or under five digits between."""
    groups = F.regexp_extract_all(line, F.lit("[0-9]+"), F.lit(0))
    middle = F.array_join(F.slice(groups, 2, F.greatest(F.size(groups) - 2, F.lit(0))), "")
    return F.when(
        (F.size(groups) >= 3) & (F.length(middle) >= 5),
        F.struct(
            groups[0].alias("cheque_number"),
            F.substring(middle, 1, 2).alias("bank_code"),
            F.substring(middle, 3, 3).alias("branch_number"),
            F.element_at(groups, -1).alias("account_number"),
        ),
    )


def cheque_reference(lines: Column) -> Column:
    """Struct (bank_code, branch_number) of the first line ``5-10d 2d 5d 5-12d``."""
    shape = r"(?<![0-9])[0-9]{5,10}\s+([0-9]{2})\s+([0-9]{5})\s+[0-9]{5,12}(?![0-9])"
    line = F.try_element_at(F.filter(lines, lambda x: x.rlike(shape)), F.lit(1))
    branch = F.substring(F.regexp_extract(line, shape, 2), 1, 3)
    return F.when(line.isNotNull(), F.struct(F.regexp_extract(line, shape, 1).alias("bank_code"), branch.alias("branch_number")))


def sensitive_runs(text: Column, allowed: list[str]) -> Column:
    """Distinct 8- to 10-digit runs outside ``allowed``, each a struct (kind, value): ``id`` for
    nine digits with a valid check digit, else ``candidate``."""
    runs = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?<![0-9])[0-9]{8,10}(?![0-9])"), F.lit(0)))
    kept = F.filter(runs, lambda x: ~x.isin(allowed)) if allowed else runs
    kind = lambda x: F.when((F.length(x) == 9) & luhn(x), "id").otherwise("candidate")
    return F.transform(kept, lambda x: F.struct(kind(x).alias("kind"), x.alias("value")))


def masked(value: Column) -> Column:
    """The ends of a value: two and two of five characters and more, one and one of three or four."""
    n = F.length(value)
    return (
        F.when(n > 4, F.concat(F.substring(value, 1, 2), F.lit("…"), F.right(value, F.lit(2))))
        .when(n >= 3, F.concat(F.substring(value, 1, 1), F.lit("…"), F.right(value, F.lit(1))))
        .otherwise(F.when(value.isNotNull(), F.lit("…")))
    )


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)
