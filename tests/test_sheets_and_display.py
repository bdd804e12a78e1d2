"""Appendix sheets, display text, pixels and run tallies."""

from pyspark.sql import functions as F

from papyrine.functions import display, pixels
from papyrine.operators import runs, sheets

SHEET = "page_id int, pos int, id_number string, first_name_he string, last_name_he string, street string, children_ids array<string>, spouse_id string"
CARD = "page_id int, card_id string, card_first string, card_last string"


def test_sheet_selection(spark):
    rows = [
        (1, 0, "300000007", "דנה", "כהן", "x", None, None),
        (2, 0, "123456783", "דנה", "ישראל", "x", ["123456783", "123456782"], "123456783"),
        (3, 0, "300000007", None, "כהן", "x", None, None),
        (4, 0, "300000007", "רות", "לוי", "x", None, None), (4, 1, "123456782", "דנה", "כהן", "x", None, None), (4, 2, "123456782", "דנה", "כהן", "x", None, None),
        (5, 0, "9", "דנה", "כ", "דנה", None, None),
    ]
    joined = sheets.matched_by_name(spark.createDataFrame(rows, SHEET), spark.createDataFrame([(i, "123456782", "דנה", "ישראלי" if i == 2 else "כהן") for i in (1, 2, 3, 4)], CARD))
    found = {r.page_id: r for r in sheets.selected(joined).collect()}
    assert (found[1].id_number, found[1].id_confidence) == ("123456782", "medium")
    assert found[2].id_number == "123456782" and found[2].id_confidence == "high"
    assert [w for w in found[2].warnings if "child #1" in w] and [w for w in found[2].warnings if "spouse" in w] and len(found[2].warnings) == 2
    assert (found[3].id_number, found[3].id_confidence) == ("300000007", "low")
    assert found[4].pos == 1 and len(found[4].warnings) == 2
    assert found[5].warnings == [] or found[5].id_number == "9"
    rescue = {(r.page_id, r.pos): r.rescue for r in sheets.needs_rescue(joined).collect()}
    assert rescue[(1, 0)] and not rescue[(2, 0)] and not rescue[(4, 1)]
    cut = sheets.completed_names(spark.createDataFrame([(1, 0, "1", "דנ", "כהן", "x", None, None)], SHEET).join(spark.createDataFrame([(1, "1", "דנה", "כהן")], CARD), "page_id")).first()
    assert cut.first_name_he == "דנה" and cut.cut_short == ["first_name_he"]


def test_display(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(display.duration(F.lit(999))) == "999ms" and one(display.duration(F.lit(1500))) == "1.5s" and one(display.duration(F.lit(None).cast("int"))) == "—"
    assert one(display.cost(F.lit(0.0451))) == "$0.045" and one(display.cost(F.lit(0.0001))) == "<$0.001" and one(display.cost(F.lit(0.0))) == "$0.000"
    assert one(display.token_pair(F.lit(1200), F.lit(3))) == "1,200 / 3"
    assert one(display.file_size(F.lit(100))) == "1 KB" and one(display.file_size(F.lit(1_572_864))) == "1.5 MB"
    assert one(display.field_date(F.lit("2023-02-19"))) == "19.02.2023" and one(display.field_date(F.lit("2014-03"))) == "03.2014" and one(display.field_date(F.lit("2014-13"))) is None
    row = spark.createDataFrame([(11, 148, 99, "2020-01-01", None)], "bank int, branch int, account long, start_date string, end_date string")
    assert row.select(display.record_line("boi_accounts", {"11": "Discount"})).first()[0] == "11 · Discount · 148 · 99 · 01.01.2020"


def test_pixels(spark):
    data = bytearray([255] * 300)
    data[0:3] = [0, 0, 0]
    data[3:6] = [0, 0, 200]
    rows = spark.createDataFrame([(("f", 10, 10, 3, 16, bytes(data)),)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    found = rows.select(pixels.shares(F.col("image")).alias("s")).select("s.*", pixels.has_ink(F.col("s")).alias("inked")).first()
    assert abs(found.ink - 0.02) < 1e-9 and abs(found.colour - 0.01) < 1e-9 and found.inked
    inner = rows.select(pixels.shares(F.col("image"), 0.2).alias("s")).first().s
    assert inner.ink == 0


def test_tallies(spark):
    results = spark.createDataFrame([("a", "verified", 10, True), ("b", None, 20, None), ("c", "verified", 30, False)], "file string, verdict string, latency_ms int, micr_parsed boolean")
    assert {r.verdict: (r.n, r.mean_latency_ms, r.micr_parsed) for r in runs.verdict_tally(results).collect()} == {"verified": (2, 20.0, 1), "error": (1, 20.0, 0)}
    status = spark.createDataFrame([("a", "ok", "2"), ("b", "error", "2"), ("c", "ok", "1"), ("d", "never", None)], "source string, status string, started_at string")
    found = runs.refresh_summary(status, F.lit("2")).first()
    assert found.ok == ["a"] and found.failed == ["b"]
