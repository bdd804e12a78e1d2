"""Verdicts on read documents, from check digits and cross-checks of their own fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import mrz
from papyrine.functions.amounts import amount_in_words, two_decimals
from papyrine.functions.identifiers import digits, id_check, micr_parts, same_number


def _given(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def _check(field: str, visual: Column, reference: Column, match: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.nullif(visual, F.lit("")).alias("visual"), F.nullif(reference, F.lit("")).alias("reference"), F.coalesce(match, F.lit(False)).alias("match"))


def _counts(checks: Column) -> tuple[Column, Column, Column]:
    """(comparable, mismatched, matched) checks."""
    comparable = F.filter(checks, lambda c: c["visual"].isNotNull() & c["reference"].isNotNull())
    return F.size(comparable), F.size(F.filter(comparable, lambda c: ~c["match"])), F.size(F.filter(checks, lambda c: c["match"]))


def validate_identity(records: DataFrame) -> DataFrame:
    """Add id_valid, mrz_present, mrz_valid, cross_checks and verdict to identity records
    (document_type, id_number, date_of_birth, date_of_expiry, sex, mrz_lines)."""
    foreign = F.col("document_type") == "foreign_passport"
    own_id = F.when(~F.coalesce(foreign, F.lit(False)), F.col("id_number"))
    lines = mrz.clean_lines(F.filter(F.coalesce("mrz_lines", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    zone = F.col("_zone")
    optional = digits(zone["optional"])
    zone_id = F.when(optional != "", optional).otherwise(digits(zone["document_number"]))
    birth, expiry = mrz.zone_date(zone["birth"]), mrz.zone_date(zone["expiry"], expiry=True)
    sex, zone_sex = F.upper(F.col("sex")), zone["sex"]
    every = F.array(
        _check("id_number", digits(own_id), zone_id, _given(own_id) & _given(zone_id) & (F.ltrim(digits(own_id), F.lit("0")) == F.ltrim(zone_id, F.lit("0")))),
        _check("date_of_birth", F.col("date_of_birth"), birth, F.col("date_of_birth") == birth),
        _check("date_of_expiry", F.col("date_of_expiry"), expiry, F.col("date_of_expiry") == expiry),
        _check("sex", sex, zone_sex, sex == zone_sex),
    )
    told = F.filter(every, lambda c: (c["visual"].isNotNull() | c["reference"].isNotNull()) & ~(F.coalesce(F.col("document_type") == "foreign_passport", F.lit(False)) & (c["field"] == "id_number")))
    comparable, mismatched, matched = _counts(F.col("cross_checks"))
    verdict = (
        F.when(F.col("mrz_valid") & (comparable > 0) & (mismatched == 0), "verified")
        .when(mismatched > 0, "mismatch")
        .when(matched > 0, "partial")
        .otherwise("unverified")
    )
    return (
        records.withColumns({"id_valid": F.when(_given(own_id), id_check(own_id)), "_lines": lines})
        .withColumn("_zone", mrz.parse(F.col("_lines")))
        .withColumns(
            {
                "mrz_present": F.size("_lines") > 0,
                "mrz_valid": F.when(F.size("_lines") > 0, F.coalesce(zone["checks"], F.lit(False))),
                "cross_checks": F.when(zone.isNotNull(), told).otherwise(F.array().cast("array<struct<field:string,visual:string,reference:string,match:boolean>>")),
            }
        )
        .withColumn("verdict", verdict)
        .drop("_lines", "_zone")
    )


def validate_cheque(records: DataFrame) -> DataFrame:
    """Add id_valid, guarantor_id_valid, guarantor_is_drawer, micr_present, micr_parsed,
    cross_checks and verdict to cheque records (plain string fields, guarantor_signed)."""
    drawer, guarantor = F.col("drawer_id_number"), F.col("guarantor_id_number")
    amount, words = F.col("amount"), F.col("amount_in_words")
    figure, worded = amount.try_cast("decimal(18,2)"), F.col("_words")
    amount_check = F.when(
        _given(amount) | _given(words),
        _check("amount", F.coalesce(two_decimals(figure), amount), two_decimals(worded), figure == worded),
    )
    micr = F.col("_micr")
    lines = [
        F.when(micr.isNotNull(), _check(f, F.col(f), micr[f], same_number(F.col(f), micr[f])))
        for f in ("cheque_number", "bank_code", "branch_number", "account_number")
    ]
    told = F.filter(F.array(amount_check, *lines), lambda c: c.isNotNull() & (c["visual"].isNotNull() | c["reference"].isNotNull()))
    comparable, mismatched, _ = _counts(F.col("cross_checks"))
    bad_digit = ~F.coalesce("id_valid", F.lit(True)) | ~F.coalesce("guarantor_id_valid", F.lit(True))
    unrun = (_given(F.col("guarantor_name")) | F.coalesce("guarantor_signed", F.lit(False))) & F.col("guarantor_id_valid").isNull()
    verdict = (
        F.when((mismatched > 0) | bad_digit, "mismatch")
        .when(~F.col("micr_parsed"), "unverified")
        .when(unrun | (comparable != F.size("cross_checks")), "partial")
        .otherwise("verified")
    )
    same = F.ltrim(digits(guarantor), F.lit("0")) == F.ltrim(digits(drawer), F.lit("0"))
    return (
        records.withColumns({"_words": amount_in_words(words), "_micr": micr_parts(F.col("micr_line"))})
        .withColumns(
            {
                "id_valid": F.when(_given(drawer), id_check(drawer)),
                "guarantor_id_valid": F.when(_given(guarantor), id_check(guarantor)),
                "guarantor_is_drawer": F.when(_given(guarantor) & _given(drawer), same),
                "micr_present": F.col("micr_line").isNotNull(),
                "micr_parsed": micr.isNotNull(),
                "cross_checks": told,
            }
        )
        .withColumn("verdict", verdict)
        .drop("_words", "_micr")
    )
