"""Merging the documents of one page into one record.

A record has ``page_id``, ``pos``, ``document_type``, ``fields`` (map of name to struct(value,
confidence)), ``mrz_lines`` and ``notes``. The fold over a page's few records is ordered by type
rank and position; pages are independent, so Spark shuffles by page once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.names import alphanumeric

# Whose fields win, types that only fill gaps, and field names in order.
PRIORITY = ["teudat_zehut", "israeli_passport", "israeli_drivers_license", "foreign_passport", "teudat_zehut_sefach", "teudat_zehut_back", "disability_card", "other", "cheque", "cheque_back", "unreadable"]
SECONDARY = ["teudat_zehut_sefach", "teudat_zehut_back"]
FIELDS = [
    "last_name_he", "first_name_he", "last_name_en", "first_name_en", "id_number", "passport_number", "date_of_birth", "sex", "nationality",
    "place_of_birth", "father_name_he", "mother_name_he", "date_of_issue", "date_of_expiry", "license_number", "address", "categories", "file_number",
]
_FIELD = "struct<value:string,confidence:string>"


def type_rank(document_type: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in PRIORITY]), document_type)


def merged(records: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, document_type, fields, mrz_lines, notes, warnings): one record a page."""
    item = F.struct(type_rank(F.col("document_type")).alias("rank"), "pos", "document_type", "fields", "mrz_lines", "notes")
    in_order = lambda a, b: F.when((a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["pos"] < b["pos"])), -1).otherwise(1)
    pages = records.groupBy(page).agg(F.array_sort(F.collect_list(item), in_order).alias("r"))
    names = F.array(*[F.lit(f) for f in FIELDS])
    first = F.element_at("r", 1)
    # a fold keeps the type it starts with, so its fields must be allowed to be null
    fields = F.transform_values(first["fields"], lambda n, f: F.try_element_at(first["fields"], n))
    start = F.struct(
        first["document_type"].alias("document_type"), fields.alias("fields"), first["mrz_lines"].alias("mrz_lines"), first["notes"].alias("notes"),
        F.array().cast("array<string>").alias("warnings"),
    )

    def value(fields: Column, name: Column) -> Column:
        return F.nullif(F.try_element_at(fields, name)["value"], F.lit(""))

    def step(state: Column, other: Column) -> Column:
        mine, theirs = state["fields"], other["fields"]
        id_mine, id_theirs = (alphanumeric(value(f, F.lit("id_number"))) for f in (mine, theirs))
        stranger = F.coalesce(id_mine != id_theirs, F.lit(False))
        fill_only = other["document_type"].isin(SECONDARY)
        differs = lambda n: F.coalesce(alphanumeric(value(mine, n)) != alphanumeric(value(theirs, n)), F.lit(False))

        def chosen(n: Column) -> Column:
            a, b = F.try_element_at(mine, n), F.try_element_at(theirs, n)
            surer = ~fill_only & differs(n) & (a["confidence"] != "high") & (b["confidence"] == "high")
            return F.when(value(theirs, n).isNotNull() & (value(mine, n).isNull() | surer), b).otherwise(a)

        conflicts = F.filter(names, lambda n: ~fill_only & differs(n))
        told = F.transform(conflicts, lambda n: F.concat(n, F.lit(" differs between "), state["document_type"], F.lit(" and "), other["document_type"]))
        ignored = F.array(F.concat(F.lit("Ignored a "), other["document_type"], F.lit(" block belonging to a different person (ID number differs)")))
        has_lines = F.size(F.coalesce(state["mrz_lines"], F.array().cast("array<string>"))) > 0
        notes = F.when(fill_only | (F.coalesce(other["notes"], F.lit("")) == ""), state["notes"]).otherwise(F.concat_ws("; ", F.nullif(state["notes"], F.lit("")), other["notes"]))
        return F.struct(
            state["document_type"].alias("document_type"),
            F.when(stranger, mine).otherwise(F.map_from_arrays(names, F.transform(names, chosen))).alias("fields"),
            F.when(stranger | has_lines, state["mrz_lines"]).otherwise(other["mrz_lines"]).alias("mrz_lines"),
            F.when(stranger, state["notes"]).otherwise(notes).alias("notes"),
            F.concat(state["warnings"], F.when(stranger, ignored).otherwise(told)).alias("warnings"),
        )

    rest = F.slice("r", 2, F.size("r"))
    # array_distinct keeps the first of equal warnings
    return pages.select(page, F.aggregate(rest, start, step).alias("m")).select(page, "m.document_type", "m.fields", "m.mrz_lines", "m.notes", F.array_distinct("m.warnings").alias("warnings"))


def merged_cheque(records: DataFrame, page: str = "page_id") -> DataFrame:
    """First front and first back of each page; fields that the back holds replace the front's."""
    place = F.row_number().over(Window.partitionBy(page, "document_type").orderBy("pos"))
    ranked = records.filter(F.col("document_type").isin("cheque", "cheque_back")).withColumn("_n", place)
    side = lambda t: F.first(F.when((F.col("document_type") == t) & (F.col("_n") == 1), F.col("fields")), ignorenulls=True)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{_FIELD}>"))
    sides = ranked.groupBy(page).agg(side("cheque").alias("f"), side("cheque_back").alias("b"), F.count_if(F.col("_n") > 1).alias("extra_sides"))
    back = F.map_filter(F.coalesce("b", none), lambda k, v: F.coalesce(v["value"] != "", F.lit(False)))
    front = F.map_filter(F.coalesce("f", none), lambda k, v: ~F.map_contains_key(back, k))
    return sides.select(page, F.map_concat(front, back).alias("fields"), "extra_sides")


def flattened(records: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, name, value, confidence) of every field that holds something."""
    return records.select(page, F.explode("fields").alias("name", "f")).select(page, "name", "f.value", "f.confidence").filter("value <> ''")


def run_diff(left: DataFrame, right: DataFrame, file: str = "file") -> DataFrame:
    """(file, name, left, right) wherever two runs of flattened records tell different things."""
    a, b = left.select(file, "name", F.col("value").alias("left")), right.select(file, "name", F.col("value").alias("right"))
    return a.join(b, [file, "name"], "full").filter(~F.col("left").eqNullSafe(F.col("right")))
