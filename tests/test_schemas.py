from pyspark.sql import functions as F

from papyrine import schemas


def test_flat_and_wide(spark):
    flat = schemas.flat_schema(["id_number", "sex"], ["signed"], zone=True)
    assert flat.names == ["id_number", "sex", "signed", "mrz_lines", "uncertain_fields"]
    rows = spark.createDataFrame([("1", None, True, None, ["sex"]), ("2", "F", None, None, None)], flat)
    found = rows.select(schemas.widened(["id_number", "sex"], ["id_number", "sex", "address"]).alias("f")).collect()
    assert [{k: tuple(v) for k, v in r.f.items()} for r in found] == [
        {"id_number": ("1", "high"), "sex": (None, "medium"), "address": (None, "high")},
        {"id_number": ("2", "high"), "sex": ("F", "high"), "address": (None, "high")},
    ]
    assert schemas.record_schema().names[1] == "document_type"
    sheets = spark.createDataFrame([("p", 0, {"id_number": ("1", "high"), "marital_status": ("x", "low")})], "page_id string, pos int, fields map<string,struct<value:string,confidence:string>>")
    assert list(schemas.sheet_document(sheets).select(F.col("fields")).first()[0]) == ["id_number"]
