"""Appendix sheet records: from blocks to a record, cleaned, and as rows to show.

A sheet has ``fields`` (map of name to struct(value, confidence)), ``address`` (struct of texts and
confidence), ``spouse`` and ``children`` (persons: names, id_number, date_of_birth, sex,
confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions import calendar, names
from papyrine.functions.identifiers import digits

PERSON = "struct<last_name_he:string,first_name_he:string,id_number:string,date_of_birth:string,sex:string,confidence:string>"
ADDRESS = "struct<street:string,house_number:string,entrance:string,apartment:string,city:string,postal_code:string,confidence:string>"
FIELD = "struct<value:string,confidence:string>"
HOLDER = ["last_name_he", "first_name_he", "id_number", "date_of_birth", "place_of_birth", "date_of_issue"]
STATUS = ["previous_last_name_he", "previous_first_name_he", "maiden_name_he", "marital_status", "nationality", "father_name_he", "mother_name_he"]
FORMER = ["previous_last_name_he", "previous_first_name_he", "maiden_name_he"]
SHOWN = ["id_number", "last_name_he", "first_name_he", *FORMER, "marital_status", "nationality", "date_of_birth", "place_of_birth", "father_name_he", "mother_name_he", "date_of_issue"]
PLACE = ["street", "house_number", "entrance", "apartment", "city", "postal_code"]
PERSONAL = ["last_name_he", "first_name_he", "id_number", "date_of_birth", "sex"]


def _field(value: Column, confidence: Column) -> Column:
    return F.struct(value.alias("value"), confidence.alias("confidence"))


def _given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def assembled(blocks: DataFrame) -> DataFrame:
    """Sheets of flat blocks: ``holder`` (names of HOLDER and PLACE, confidence), ``status`` (names of
    STATUS, spouse_last_name_he, spouse_first_name_he, spouse_id_number, confidence; may be null) and
    ``children``. Every value has its block's confidence."""
    absent = _field(F.lit(None).cast("string"), F.lit("high"))
    held = [(n, _field(F.col(f"holder.{n}"), F.col("holder.confidence"))) for n in HOLDER]
    told = [(n, F.when(F.col("status").isNotNull(), _field(F.col(f"status.{n}"), F.col("status.confidence"))).otherwise(absent)) for n in STATUS]
    every = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in held + told]), F.array(*[f for _, f in held + told]))
    none = F.lit(None).cast("string")
    spouse = F.struct(*[F.col(f"status.spouse_{n}").alias(n) for n in PERSONAL[:3]], none.alias("date_of_birth"), none.alias("sex"), F.col("status.confidence").alias("confidence"))
    address = F.struct(*[F.col(f"holder.{n}").alias(n) for n in PLACE], F.col("holder.confidence").alias("confidence"))
    return blocks.withColumns({"fields": every, "address": address, "spouse": F.when(F.col("status").isNotNull(), spouse)}).drop("holder", "status")


def _clean_person(p: Column) -> Column:
    last, first = names.without_points(p["last_name_he"]), names.without_points(p["first_name_he"])
    doubtful = names.suspicious_hebrew_name(last) | names.suspicious_hebrew_name(first)
    return F.struct(
        last.alias("last_name_he"), first.alias("first_name_he"), F.nullif(digits(p["id_number"]), F.lit("")).alias("id_number"), calendar.printed_date(p["date_of_birth"]).alias("date_of_birth"),
        names.sex_code(p["sex"]).alias("sex"), F.when(doubtful, names.capped_confidence(p["confidence"])).otherwise(p["confidence"]).alias("confidence"),
    )


def _somebody(p: Column) -> Column:
    return _given(p["last_name_he"]) | _given(p["first_name_he"]) | _given(p["id_number"]) | _given(p["date_of_birth"])


def cleaned(sheets: DataFrame) -> DataFrame:
    """Sheets with clean text, digits, dates and codes; a status word among former names goes home,
    and blank persons and children with the holder's number go."""

    def text(n: Column, f: Column) -> Column:
        value = F.when(_given(f["value"]), names.without_points(f["value"])).otherwise(f["value"])
        shaped = F.when(n == "id_number", F.nullif(digits(value), F.lit(""))).when(n.isin("date_of_birth", "date_of_issue"), calendar.printed_date(value)).otherwise(value)
        return _field(shaped, F.when(n.endswith("_name_he") & names.suspicious_hebrew_name(value), names.capped_confidence(f["confidence"])).otherwise(f["confidence"]))

    out = sheets.withColumn("fields", F.transform_values("fields", text))
    value = lambda n: F.try_element_at("fields", F.lit(n))["value"]
    stray = F.coalesce(*[F.when(names.marital_status(value(n)).isNotNull(), value(n)) for n in FORMER])

    def home(n: Column, f: Column) -> Column:
        moved = n.isin(FORMER) & names.marital_status(f["value"]).isNotNull()
        found = (n == "marital_status") & ~_given(f["value"]) & stray.isNotNull()
        return F.when(moved, _field(F.lit(None).cast("string"), F.lit("high"))).when(found, _field(stray, F.lit("medium"))).otherwise(f)

    out = out.withColumn("fields", F.transform_values("fields", home))
    place = {n: F.nullif(names.without_points(F.col(f"address.{n}")), F.lit("")) for n in PLACE}
    street = names.street_without_number(place["street"], place["house_number"])
    address = F.struct(F.coalesce(street, place["street"]).alias("street"), *[place[n].alias(n) for n in PLACE[1:]], F.col("address.confidence").alias("confidence"))
    anywhere = F.coalesce(*[place[n] for n in ("street", "house_number", "city", "postal_code")]).isNotNull()
    spouse = _clean_person(F.col("spouse"))
    holder = F.try_element_at("fields", F.lit("id_number"))["value"]
    children = F.transform(F.coalesce("children", F.array().cast(f"array<{PERSON}>")), _clean_person)
    kept = F.filter(children, lambda c: _somebody(c) & ~F.coalesce(_given(holder) & (c["id_number"] == holder), F.lit(False)))
    return out.withColumns({"address": F.when(anywhere, address), "spouse": F.when(F.col("spouse").isNotNull() & _somebody(spouse), spouse), "children": kept})


def status_code(sheets: DataFrame) -> DataFrame:
    return sheets.withColumn("marital_status_code", names.marital_status(F.try_element_at("fields", F.lit("marital_status"))["value"]))


def rows(sheets: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, section, pos, name, value, confidence) of everything a sheet holds, in order."""
    item = lambda section, name, v, c: F.struct(F.lit(section).alias("section"), name.alias("name"), v.alias("value"), c.alias("confidence"))
    own = [item("sefach", F.lit(n), F.try_element_at("fields", F.lit(n))["value"], F.try_element_at("fields", F.lit(n))["confidence"]) for n in SHOWN]
    own += [item("sefach", F.lit(f"address.{n}"), F.col(f"address.{n}"), F.col("address.confidence")) for n in PLACE]
    own += [item("sefach", F.lit(f"spouse.{n}"), F.col(f"spouse.{n}"), F.col("spouse.confidence")) for n in PERSONAL]
    children = F.flatten(F.transform(F.coalesce("children", F.array().cast(f"array<{PERSON}>")), lambda c, i: F.array(*[item("children", F.format_string(f"children[%d].{n}", i), c[n], c["confidence"]) for n in PERSONAL])))
    every = F.filter(F.concat(F.array(*own), children), lambda x: _given(x["value"]))
    return sheets.select(key, F.posexplode(every).alias("pos", "r")).select(key, "r.section", "pos", "r.name", "r.value", "r.confidence")


def section_counts(sheets: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, section, n): rows of each section that has any."""
    return rows(sheets, key).groupBy(key, "section").agg(F.count("*").alias("n"))
