"""Schemas of records: the nested shape, the flat shape that readers answer in, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructField, StructType

FIELD = StructType([StructField("value", StringType()), StructField("confidence", StringType())])


def record_schema() -> StructType:
    """One row a document: its type, fields by name, zone lines and notes."""
    return StructType(
        [
            StructField("page_id", StringType()),
            StructField("document_type", StringType()),
            StructField("fields", MapType(StringType(), FIELD)),
            StructField("mrz_lines", ArrayType(StringType())),
            StructField("notes", StringType()),
        ]
    )


def flat_schema(fields: list[str], flags: list[str] = (), zone: bool = False) -> StructType:
    """What a reader is asked for: plain text fields, tri-state flags, zone lines where the type has
    them, and the names of the fields that it is unsure of."""
    columns = [StructField(f, StringType()) for f in fields] + [StructField(f, BooleanType()) for f in flags]
    columns += [StructField("mrz_lines", ArrayType(StringType()))] * zone
    return StructType([*columns, StructField("uncertain_fields", ArrayType(StringType()))])


def widened(fields: list[str], every: list[str]) -> Column:
    """Map of every field name to (value, confidence): ``medium`` where the reader was unsure,
    ``high`` else, and an absent field is null at ``high``."""
    unsure = F.coalesce("uncertain_fields", F.array().cast("array<string>"))

    def entry(name: str) -> Column:
        if name not in fields:
            return F.struct(F.lit(None).cast("string").alias("value"), F.lit("high").alias("confidence"))
        return F.struct(F.col(name).alias("value"), F.when(F.array_contains(unsure, name), "medium").otherwise("high").alias("confidence"))

    return F.map_from_arrays(F.array(*[F.lit(n) for n in every]), F.array(*[entry(n) for n in every]))


def sheet_document(sheets: DataFrame) -> DataFrame:
    """The card-shaped subset of appendix sheets: identity fields only, as records to merge."""
    names = ["last_name_he", "first_name_he", "id_number", "date_of_birth", "place_of_birth", "date_of_issue"]
    subset = F.map_filter("fields", lambda k, v: k.isin(names))
    return sheets.select("page_id", "pos", F.lit("teudat_zehut_sefach").alias("document_type"), subset.alias("fields"), F.lit(None).cast("array<string>").alias("mrz_lines"), F.lit(None).cast("string").alias("notes"))
