"""Answers of the service: which record answers a request, its type and its ordered warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts of the warnings.
NOTHING = "No supported document was found on the page"
UNREADABLE = "Image quality too low to extract fields reliably"
BAD_ZONE = "MRZ checksums failed"
BAD_ID = "Israeli ID number failed its check-digit test"
ZONE_DIFFERS = "Visual fields do not match the MRZ"
UNTUNED = ("Field extraction for ", " is not tuned; values are best effort")
UNPARSED_LINE = "MICR line present but could not be parsed"
LINE_DIFFERS = "MICR present but does not match printed details"
WORDS_DIFFER = "amount in words does not match the figure"
UNPARSED_WORDS = "amount in words not parseable"
BAD_GUARANTOR = "guarantor ID failed its check-digit test"


def _no(x: Column) -> Column:
    return F.coalesce(~x, F.lit(False))


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _texts(*pairs: tuple[Column, str | Column]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(holds, text if isinstance(text, Column) else F.lit(text)) for holds, text in pairs]))


def identity_warnings(record: Column, classified: Column) -> Column:
    """Warnings of an identity record (document_type, notes, mrz_present, mrz_valid, id_valid, verdict)."""
    return _texts(
        (record["document_type"] == "unreadable", UNREADABLE),
        (_yes(record["mrz_present"]) & _no(record["mrz_valid"]), BAD_ZONE),
        (_no(record["id_valid"]), BAD_ID),
        (record["verdict"] == "mismatch", ZONE_DIFFERS),
        (record["notes"] != "", record["notes"]),
        (classified != "", F.concat(F.lit(UNTUNED[0]), classified, F.lit(UNTUNED[1]))),
    )


def cheque_warnings(record: Column) -> Column:
    """Warnings of a cheque record (document_type, notes, micr_present, micr_parsed, cross_checks,
    amount_in_words, id_valid, guarantor_id_valid); one reading of the amount alone is no difference."""
    both = F.filter(record["cross_checks"], lambda c: c["visual"].isNotNull() & c["reference"].isNotNull())
    line_differs = F.exists(both, lambda c: (c["field"] != "amount") & ~c["match"])
    compared = F.exists(both, lambda c: c["field"] == "amount")
    amount_differs = F.exists(both, lambda c: (c["field"] == "amount") & ~c["match"])
    return _texts(
        (record["document_type"] == "unreadable", UNREADABLE),
        (_yes(record["micr_present"]) & ~_yes(record["micr_parsed"]), UNPARSED_LINE),
        (line_differs, LINE_DIFFERS),
        (amount_differs, WORDS_DIFFER),
        ((record["amount_in_words"] != "") & ~_yes(compared), UNPARSED_WORDS),
        (_no(record["id_valid"]), BAD_ID),
        (_no(record["guarantor_id_valid"]), BAD_GUARANTOR),
        (record["notes"] != "", record["notes"]),
    )


def shaped(results: DataFrame, identity_types: list[str]) -> DataFrame:
    """Add ``branch`` (identity, cheque or not_a_document), ``document_type`` and ``warnings`` to
    results (identity and cheque: a struct or null; classified_type; run_warnings: array).

    A cheque answers unless a record of an identity type was read too; nothing read, or ``other``
    without a type from the classifier, is no document. The run's warnings come first, but for the
    one that says so. A null list of warnings counts as empty."""
    identity, cheque, classified = F.col("identity"), F.col("cheque"), F.col("classified_type")
    kind = identity["document_type"]
    given = F.coalesce("run_warnings", F.array().cast("array<string>"))
    branch = (
        F.when(cheque.isNotNull() & ~_yes(kind.isin(identity_types)), "cheque")
        .when(identity.isNull() | _yes((kind == "other") & classified.isNull()), "not_a_document")
        .otherwise("identity")
    )
    is_cheque, is_none = F.col("branch") == "cheque", F.col("branch") == "not_a_document"
    kinds = F.when(is_cheque, cheque["document_type"]).when(is_none, "not_a_document").otherwise(F.coalesce(F.nullif(classified, F.lit("")), kind))
    warnings = (
        F.when(is_cheque, F.concat(given, cheque_warnings(cheque)))
        .when(is_none, F.concat(F.array(F.lit(NOTHING)), given))
        .otherwise(F.concat(given, identity_warnings(identity, classified)))
    )
    return results.withColumn("branch", branch).withColumns({"document_type": kinds, "warnings": warnings})
