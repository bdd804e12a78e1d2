"""Clean-up of read records: one field chain, in a fixed order, for every document type.

Records hold ``document_type``, ``fields`` (map of name to struct(value, confidence)), ``anchors``
and ``printed`` (:mod:`papyrine.operators.anchors`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import calendar, names
from papyrine.functions.amounts import figure_amount
from papyrine.functions.identifiers import digits

# The fields that each type carries, fields gated by a printed label, bank names.
CARRIED = {
    "teudat_zehut": [
        "last_name_he", "first_name_he", "id_number", "date_of_birth", "date_of_issue", "date_of_expiry", "sex", "place_of_birth",
        "father_name_he", "mother_name_he",
    ],
    "teudat_zehut_back": [
        "id_number", "date_of_birth", "date_of_expiry", "sex", "last_name_en", "first_name_en",
    ],
    "teudat_zehut_sefach": [
        "last_name_he", "first_name_he", "id_number", "date_of_birth", "place_of_birth", "date_of_issue",
    ],
    "israeli_passport": [
        "last_name_he", "first_name_he", "last_name_en", "first_name_en", "id_number", "passport_number", "date_of_birth", "sex",
        "nationality", "place_of_birth", "father_name_he", "mother_name_he", "date_of_issue", "date_of_expiry",
    ],
    "foreign_passport": [
        "last_name_en", "first_name_en", "passport_number", "date_of_birth", "sex", "nationality", "place_of_birth", "date_of_issue",
        "date_of_expiry",
    ],
    "israeli_drivers_license": [
        "last_name_he", "first_name_he", "last_name_en", "first_name_en", "id_number", "date_of_birth", "date_of_issue", "date_of_expiry",
        "license_number", "address", "categories",
    ],
    "disability_card": [
        "last_name_he", "first_name_he", "last_name_en", "first_name_en", "id_number", "file_number", "date_of_expiry",
    ],
    "cheque": [
        "bank_name", "bank_code", "branch_number", "account_number", "cheque_number", "drawer_name", "drawer_id_number", "drawer_address",
        "drawer_phone", "payee", "amount", "amount_in_words", "date",
    ],
    "cheque_back": [
        "guarantor_name", "guarantor_id_number",
    ],
}
GATED = {"teudat_zehut": ["sex", "place_of_birth", "father_name_he", "mother_name_he"]}
DATES = ["date_of_birth", "date_of_issue", "date_of_expiry"]
DIGIT_FIELDS = ["cheque_number", "bank_code", "branch_number", "account_number", "drawer_id_number", "guarantor_id_number"]


def _field(value: Column, confidence: Column) -> Column:
    return F.struct(value.alias("value"), confidence.alias("confidence"))


def _carried(document_type: Column) -> Column:
    lookup = F.create_map(*[x for t, f in CARRIED.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in f]))])
    return F.try_element_at(lookup, document_type)


def _mapped(fields: Column, change) -> Column:
    """Fields with (name, value, confidence) -> field applied to each."""
    return F.transform_values(fields, lambda name, f: change(name, f["value"], f["confidence"]))


def gated(records: DataFrame) -> DataFrame:
    """Fields that a type does not carry, or whose gating label is not printed, become null."""
    carried, kind = _carried(F.col("document_type")), F.col("document_type")
    gate = F.coalesce(F.try_element_at(F.create_map(*[x for t, f in GATED.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in f]))]), kind), F.array().cast("array<string>"))
    printed = F.coalesce("printed", F.array().cast("array<string>"))
    none = _field(F.lit(None).cast("string"), F.lit("high"))
    drop = lambda n: (carried.isNotNull() & ~F.array_contains(carried, n)) | (F.array_contains(gate, n) & ~F.array_contains(printed, n))
    return records.withColumn("fields", _mapped(F.col("fields"), lambda n, v, c: F.when(drop(n), none).otherwise(_field(v, c))))


def anchored(records: DataFrame) -> DataFrame:
    """Anchors replace values that differ: ``medium`` over another value, ``high`` over none."""
    anchors = F.coalesce("anchors", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    carried = _carried(F.col("document_type"))

    def change(n: Column, v: Column, c: Column) -> Column:
        anchor = F.try_element_at(anchors, n)
        takes = anchor.isNotNull() & ~anchor.eqNullSafe(v) & (carried.isNull() | F.array_contains(carried, n))
        return F.when(takes, _field(anchor, F.when(F.coalesce(v, F.lit("")) != "", "medium").otherwise("high"))).otherwise(_field(v, c))

    return records.withColumn("fields", _mapped(F.col("fields"), change))


def identity(records: DataFrame) -> DataFrame:
    """Identity records cleaned: text, dates, categories, suspicious names, gates, anchors, and the
    order of issue and expiry (swapped ones are put right at medium, equal ones lose the expiry)."""

    def text(n: Column, v: Column, c: Column) -> Column:
        bare = F.when(F.coalesce(v, F.lit("")) != "", names.without_points(v)).otherwise(v)
        value = F.when(n.isin(DATES), calendar.printed_date(bare)).when(n == "categories", names.licence_categories(bare)).otherwise(bare)
        doubtful = n.isin("last_name_he", "first_name_he") & names.suspicious_hebrew_name(bare)
        return _field(value, F.when(doubtful, names.capped_confidence(c)).otherwise(c))

    out = anchored(gated(records.withColumn("fields", _mapped(F.col("fields"), text))))
    issue, expiry = (F.try_element_at("fields", F.lit(n))["value"] for n in ("date_of_issue", "date_of_expiry"))
    swapped, equal = F.coalesce(issue > expiry, F.lit(False)), F.coalesce(issue == expiry, F.lit(False))

    def order(n: Column, v: Column, c: Column) -> Column:
        fixed = F.when(n == "date_of_issue", expiry).otherwise(issue)
        dated = n.isin("date_of_issue", "date_of_expiry")
        return (
            F.when(dated & swapped, _field(fixed, names.capped_confidence(c)))
            .when((n == "date_of_expiry") & equal, _field(F.lit(None).cast("string"), F.lit("low")))
            .otherwise(_field(v, c))
        )

    return out.withColumn("fields", _mapped(F.col("fields"), order))


def cheque(records: DataFrame, banks: dict[str, str]) -> DataFrame:
    """Cheque records cleaned; ``banks`` maps codes to names, which replace the read name."""

    def clean(n: Column, v: Column, c: Column) -> Column:
        bare = F.when(F.coalesce(v, F.lit("")) != "", names.without_points(v)).otherwise(v)
        number = F.nullif(digits(bare), F.lit(""))
        branch = F.when(F.length(number) == 5, F.substring(number, 1, 3)).otherwise(number)
        person = F.when(F.length(number) == 9, number)
        value = (
            F.when(n == "branch_number", branch)
            .when(n.isin("drawer_id_number", "guarantor_id_number"), person)
            .when(n.isin(DIGIT_FIELDS), number)
            .when(n == "amount", figure_amount(bare)["value"])
            .when(n == "date", calendar.cheque_date(bare))
            .when(n == "payee", names.payee(bare))
            .when(n == "drawer_name", F.when(~names.is_form_label(bare), names.drawer_name(bare)))
            .otherwise(bare)
        )
        return _field(value, c)

    out = anchored(gated(records.withColumn("fields", _mapped(F.col("fields"), clean))))
    lookup = F.create_map(*[F.lit(x) for pair in banks.items() for x in pair])
    code = F.try_element_at("fields", F.lit("bank_code"))
    listed = F.try_element_at(lookup, F.ltrim(code["value"], F.lit("0")))
    return out.withColumn("fields", _mapped(F.col("fields"), lambda n, v, c: F.when((n == "bank_name") & listed.isNotNull(), _field(listed, code["confidence"])).otherwise(_field(v, c))))


def drawer_block(records: DataFrame) -> DataFrame:
    """The drawer fields of a re-read corner (``block`` map) replace the cheque's four, nulls
    included, where its number is nine digits with a valid check digit."""
    number = digits(F.try_element_at("block", F.lit("drawer_id_number"))["value"])
    good = F.coalesce((F.length(number) == 9) & F.call_function("luhn_check", number), F.lit(False))
    drawer = ["drawer_name", "drawer_id_number", "drawer_address", "drawer_phone"]
    taken = lambda n: F.coalesce(F.try_element_at("block", n), _field(F.lit(None).cast("string"), F.lit("high")))
    return records.withColumn("fields", F.transform_values("fields", lambda n, f: F.when(good & n.isin(drawer), taken(n)).otherwise(f)))


def reread_ids(records: DataFrame) -> DataFrame:
    """Accept a re-read identity number that equals the first but for leading zeros or is the only
    one whose check digit holds: columns id_number, reread -> id_number, id_confidence."""
    bare = lambda c: F.ltrim(digits(F.col(c)), F.lit("0"))
    valid = F.coalesce(F.call_function("luhn_check", F.lpad(digits(F.col("reread")), 9, "0")), F.lit(False))
    accepted = (F.coalesce(F.col("reread"), F.lit("")) != "") & (F.coalesce(F.col("id_number"), F.lit("")) != "") & (bare("id_number") == bare("reread")) & valid
    changed = accepted & (F.col("id_number") != F.col("reread"))
    return records.withColumns({"id_confidence": F.when(changed, "medium").otherwise(F.col("id_confidence")), "id_number": F.when(accepted, F.col("reread")).otherwise(F.col("id_number"))})
