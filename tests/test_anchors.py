"""Anchors in transcripts, and the clean-up that applies them."""

from pyspark.sql import functions as F

from papyrine.operators import anchors, clean

FIELDS = "document_type string, fields map<string,struct<value:string,confidence:string>>, anchors map<string,string>, printed array<string>"


def apply(spark, f, transcripts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(transcripts)], "i int, lines array<string>")
    return [r[0] for r in rows.withColumn("y", f(F.col("lines"))).orderBy("i").select("y").collect()]


def test_parents(spark):
    found = apply(
        spark,
        anchors.parents,
        [["שם האב", "יוסף", "שם האם", "רחל", "תאריך הלידה", "31.05.1992"], ["שם האב", "כהן", "דנה", "31.05.1992"], ["שם האב", "כהן", "דנה", "יוסף", "רחל", "05.02.1968"], ["x"], []],
    )
    assert [(r.father_name_he, r.mother_name_he) for r in found] == [("יוסף", "רחל"), (None, None), ("יוסף", "רחל"), (None, None), (None, None)]
    assert (found[2].last_name_he, found[2].first_name_he) == ("כהן", "דנה")


def test_labels(spark):
    assert apply(spark, anchors.printed_labels, [["الجنس"], ["مكان الولادة"], ["garbled"], ["מקום הלידן", "בתוקף עד"], []]) == [["sex"], ["place_of_birth"], [], ["place_of_birth", "date_of_expiry"], []]
    assert apply(spark, anchors.sex, [["המין", "זכר"], ["זכר"], ["המין", "x"]]) == ["M", None, None]
    titles = [["תעודת נכה"], ["תעודת זהות"], ["תעודתזהו"], ["תעודת נהות"], ["נכה"], []]
    assert apply(spark, anchors.titled_type, titles) == ["disability_card", None, None, None, None, None]
    found = apply(spark, anchors.names, [["שם המשפחה", "כהן", "השם הפרטי", "דנה"], ["x"]])
    assert [tuple(r) for r in found] == [("כהן", "דנה"), (None, None)]


def test_identity_cleaning(spark):
    fields = {"sex": ("F", "high"), "date_of_issue": ("1.2.2030", "high"), "date_of_expiry": ("1.2.2020", "high"), "last_name_he": ("כהנ", "high"), "license_number": ("5", "high"), "id_number": ("111", "low"), "father_name_he": ("x", "high")}
    rows = [("teudat_zehut", fields, {"id_number": "123456782", "license_number": "9"}, ["father_name_he"])]
    found = clean.identity(spark.createDataFrame(rows, FIELDS)).first().fields
    told = {k: (v.value, v.confidence) for k, v in found.items()}
    assert told == {
        "sex": (None, "high"), "date_of_issue": ("2020-02-01", "medium"), "date_of_expiry": ("2030-02-01", "medium"), "last_name_he": ("כהנ", "medium"), "license_number": (None, "high"), "id_number": ("123456782", "medium"), "father_name_he": ("x", "high"),
    }


def test_cheque_cleaning(spark):
    fields = {"branch_number": ("14841", "high"), "bank_code": ("011", "low"), "bank_name": ("y", "high"), "drawer_id_number": ("12", "high"), "amount": ("4,500.—", "high"), "payee": ("שלמו ל", "high"), "date": ("6.4.25", "high"), "sex": ("M", "high")}
    rows = [("cheque", fields, None, None)]
    found = clean.cheque(spark.createDataFrame(rows, FIELDS), {"11": "Discount"}).first().fields
    assert {k: v.value for k, v in found.items()} == {"branch_number": "148", "bank_code": "011", "bank_name": "Discount", "drawer_id_number": None, "amount": "4500.00", "payee": None, "date": "2025-04-06", "sex": None}
    assert found["bank_name"].confidence == "low"


def test_name_like_the_first_name_label(spark):
    """A mother's name that resembles the label of the first name; the labels beside it are no names."""
    cards = [["שם האב", "הדלגאר", "שם האם", "סשרט", "-"], ["שם האב", "סשרט", "שם האם", "טנקהאר"], ["כהן", "סשרט", "דנה"]]
    assert [tuple(r) for r in apply(spark, anchors.names, cards)] == [(None, None), (None, None), ("כהן", "דנה")]
