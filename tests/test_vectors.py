"""Inputs and expected outputs of single operators."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from papyrine.functions import amounts, calendar, geometry, identifiers, mrz, names
from papyrine.operators import merge, triage, validation


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def check(spark, f, vectors, kind="string"):
    got = apply(spark, f, [v for v, _ in vectors], kind)
    assert got == [w for _, w in vectors]


def test_id_check(spark):
    check(spark, identifiers.id_check, [("012345674", True), ("012345675", False), ("12345674", True), ("0123 4567-4", True), ("", None), ("1234567890", None), (None, None), ("123456782", True), ("123456783", False)])


def test_numbers(spark):
    check(spark, identifiers.number_of_digits, [("1 2345678 2", 123456782), ("51-000000-3", 510000003), ("000000123456", 123456), ("1" * 20, None), ("1" * 45, None), ("abc", None), (None, None)])
    check(spark, identifiers.long_numbers, [("ID 12345, 12345; 999 67890", [12345, 67890]), (None, [])])
    lines = [(["1 2345678 2"], "123456782"), (["123456782"], "123456782"), (["1-2345678-2"], "123456782"), (["מספר 123456782"], "123456782"), (["1 2345678 3"], None), (["31.05.1992"], None), ([], None)]
    check(spark, identifiers.first_valid_id, lines, "array<string>")


def test_micr(spark):
    vectors = [
        ("70450812 20 50377 0000918273", ("70450812", "20", "503", "0000918273")),
        (":70450812: 2050377 0000918273", ("70450812", "20", "503", "0000918273")),
        ("70450812 20 503 77 0000918273", ("70450812", "20", "503", "0000918273")),
        ("6120455 31 26809 44556677", ("6120455", "31", "268", "44556677")),
        ("98 7654", None), ("70450812 20 0000918273", None), (None, None),
    ]
    got = apply(spark, identifiers.micr_parts, [v for v, _ in vectors])
    assert [g and tuple(g) for g in got] == [w for _, w in vectors]
    got = apply(spark, identifiers.cheque_reference, [["x", "80001234 11 14841 0000123456"], ["80001234 114 14841 0000123456"], ["03-1234567"]], "array<string>")
    assert [g and tuple(g) for g in got] == [("11", "148"), None, None]


def test_amount_in_words(spark):
    vectors = [
        ('ששת אלפים ומאתיים ש"ח', "6200"), ("ארבעים ושבע ש\"ח ושלושים אגורות", "47.30"), ("תשע מאות שקלים חדשים", "900"), ("שמונת אלפים", "8000"),
        ("שלוש מאות עשרים אלף ומאה", "320100"), ("אלפיים וחמישים שח בלבד", "2050"), ("שלוש עשרה", "13"), ("ארבעה עשר", "14"), ("מילה אחרת", None), ("מאתיים תפוחים", None), (None, None), ("", None),
    ]
    check(spark, amounts.amount_in_words, [(w, None if v is None else Decimal(v)) for w, v in vectors])


def test_amount_in_figures(spark):
    vectors = [
        ("7,310.—", "7310.00"), ("2900 xx/xx", "2900.00"), ("518,204", "518204.00"), ("9,041.75", "9041.75"), ("63.-", "63.00"), ("X 3117 X", "3117.00"),
        ("|4085|", "4085.00"), ("/ 5521 /", "5521.00"), ("₪ 38 xx", "38.00"), ("812 x/-", "812.00"), ("007,50", "7.50"), ("410.2", None), ("77.123", None), ("3,44,555", None),
    ]
    got = apply(spark, amounts.figure_amount, [v for v, _ in vectors])
    assert [(g["value"], g["parsed"]) for g in got] == [(w or v, w is not None) for v, w in vectors]
    assert tuple(apply(spark, amounts.figure_amount, [None])[0]) == (None, False)


def test_dates(spark):
    check(spark, calendar.cheque_date, [("6.4.25", "2025-04-06"), ("18.9.2015", "2015-09-18"), ("6/4/25", "2025-04-06"), ("31.2.25", "31.2.25"), (" 2015-09-18 ", "2015-09-18"), ("29.2.23", "2023-02-29"), (None, None)])
    check(spark, calendar.printed_date, [("03.2014", "2014-03"), ("3/2014", "2014-03"), ("12-2031", "2031-12"), ("6.4.1990", "1990-04-06"), (" x ", "x"), (None, None), ("45.99.2001", "2001-99-45")])
    check(spark, calendar.iso_from_yyyymmdd, [("20260910", "2026-09-10"), ("20260231", None), ("00000000", None), ("17991231", None)])
    check(spark, calendar.iso_from_yymmdd, [("260910", "2026-09-10")])
    check(spark, calendar.iso_from_dmy, [("01/05/2028", "2028-05-01"), ("31/02/2026", None)])
    check(spark, calendar.iso_from_cell, [("46275", "2026-09-10"), ("46275.5", "2026-09-10"), ("01/05/2028", "2028-05-01"), ("x", None)])


def test_next_local_run(spark):
    vectors = [("2026-01-10 01:00:00", "2026-01-10 02:00:00"), ("2026-01-10 02:00:00", "2026-01-11 02:00:00"), ("2026-07-10 00:30:00", "2026-07-10 01:00:00")]
    run = lambda x: calendar.next_local_run(x.cast("timestamp"), "Asia/Jerusalem", 4, 0).cast("string")
    check(spark, run, vectors)


def test_names(spark):
    vectors = [
        ("שָׁלוֹם", "שלום"), ("مُحَمَّد", "محمد"), ("عـــلي", "علي"), ('בע"מ', "בעמ"), ("בע״מ", "בעמ"), ("בע~מ", "בעמ"), ("ג׳ורג'", "גורג"), ("תל־אביב", "תל אביב"),
        ("  Al-Asima   NEWS ", "al asima news"), (None, ""),
    ]
    check(spark, lambda x: names.normalized_name(x, composed=False), vectors)
    check(spark, names.payee, [("שלמו ל", None), ("בלבד", None), ("לכבוד", None), ("PAY TO", None), ("שלמו לישראל ישראלי", "ישראל ישראלי"), ("PAY TO John Example", "John Example"), ("שלמה לוי", "שלמה לוי"), (None, None)])
    check(spark, names.drawer_name, [("ישראל ישראלי ת.ז. 123456782", "ישראל ישראלי"), ("ת.ד. 15", "ת.ד. 15")])
    check(spark, names.licence_categories, [("b; c1,", "B, C1"), (" ; ", None), (None, None)])
    check(spark, names.marital_status, [("נשואה", "married"), ("רווק ", "single"), ("x", None)])
    check(spark, names.company_text, [(" א~ב ", 'א"ב'), (" ", None)])
    check(spark, names.cell_or_null, [("--/--/----", None), (" x ", "x"), ("", None)])


def test_name_index(spark):
    rows = spark.createDataFrame([(["acme", "israel", "ltd"],)], "tokens array<string>")
    hit = lambda words, whole: rows.select(names.name_matches(F.col("tokens"), words, whole)).first()[0]
    assert hit(["acm", "lt"], False) and not hit(["acm"], True) and hit(["ltd", "acme"], True)
    assert hit(["acme#isr"], False) and not hit(["acme#ltd"], False) and not hit(["#"], False)


TD3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
TD1 = ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]


@pytest.mark.parametrize(
    "case, lines, told, expected",
    [
        ("all agree", TD3, dict(id_number="184226", date_of_birth="1974-08-12", date_of_expiry="2012-04-15", sex="F"), (True, True, "verified")),
        ("other birth", TD3, dict(date_of_birth="1990-01-01"), (True, True, "mismatch")),
        ("only id", TD3, dict(id_number="184226"), (True, True, "verified")),
        ("broken digit", [TD3[0], TD3[1][:-1] + "1"], dict(id_number="184226"), (True, False, "partial")),
        ("card", TD1, dict(id_number="D23145890"), (True, True, "verified")),
        ("leading zero", TD1, dict(id_number="0D23145890"), (True, True, "verified")),
        ("one line", TD3[:1], {}, (True, False, "unverified")),
        ("three long lines", [TD3[0]] * 3, {}, (True, False, "unverified")),
        ("no lines", [], {}, (False, None, "unverified")),
        ("junk", ["null", None], {}, (False, None, "unverified")),
        ("null", None, {}, (False, None, "unverified")),
        ("foreign", TD3, dict(document_type="foreign_passport", id_number="9", date_of_birth="1974-08-12", date_of_expiry="2012-04-15", sex="f"), (True, True, "verified")),
        ("short by one filler", [TD3[0][:-1], TD3[1]], dict(id_number="184226"), (True, True, "verified")),
        ("short by three", [TD3[0][:-3], TD3[1]], dict(id_number="184226"), (True, True, "verified")),
        ("too long by two", [TD3[0] + "<<", TD3[1]], dict(id_number="184226"), (True, True, "verified")),
        ("last character missing", [TD3[0], TD3[1][:-1]], dict(id_number="184226"), (True, False, "unverified")),
    ],
)
def test_identity_verdicts(spark, case, lines, told, expected):
    row = dict(document_type="israeli_passport", id_number=None, date_of_birth=None, date_of_expiry=None, sex=None) | told
    records = spark.createDataFrame([(*row.values(), lines)], ", ".join(f"{c} string" for c in row) + ", mrz_lines array<string>")
    found = validation.validate_identity(records).first()
    assert (found.mrz_present, found.mrz_valid, found.verdict) == expected
    if case == "foreign":
        assert found.id_valid is None and "id_number" not in [c["field"] for c in found.cross_checks]


def test_passport_types(spark):
    israeli = [TD3[0].replace("UTO", "ISR"), TD3[1]]
    check(spark, mrz.passport_type, [(israeli, "israeli_passport"), (TD3, "foreign_passport"), (TD1, None), ([], None), (None, None), (["null"], None)], "array<string>")


def test_cheque_verdicts(spark):
    base = dict(
        cheque_number="70311245", bank_code="20", branch_number="507", account_number="918273", drawer_id_number="246813574", guarantor_name=None, guarantor_id_number=None,
        amount="750.00", amount_in_words="שבע מאות וחמישים שקלים", micr_line="70311245 20 50712 0000918273",
    )
    own = "24681357" + str((10 - sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate("24681357"))) % 10)
    base["drawer_id_number"], wrong = own, own[:8] + str((int(own[8]) + 3) % 10)
    cases = [
        ({}, "verified"), ({"account_number": "918274"}, "mismatch"), ({"drawer_id_number": wrong}, "mismatch"), ({"amount": "751.00"}, "mismatch"), ({"guarantor_id_number": wrong}, "mismatch"),
        ({"branch_number": None}, "partial"), ({"amount_in_words": "מילה"}, "partial"), ({"amount": "2000 x/x", "amount_in_words": None}, "partial"), ({"micr_line": None}, "unverified"), ({"micr_line": "7 3"}, "unverified"),
        ({"guarantor_id_number": "300000007"}, "verified"), ({"guarantor_name": "y"}, "partial"),
    ]
    rows = [(i, *(base | change).values(), None) for i, (change, _) in enumerate(cases)]
    records = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} string" for c in base) + ", guarantor_signed boolean")
    found = validation.validate_cheque(records).orderBy("i").collect()
    assert [r.verdict for r in found] == [v for _, v in cases]
    assert found[10].guarantor_is_drawer is False and found[10].guarantor_id_valid is True


def test_geometry(spark):
    pages = [
        (0, [[100, 100, 300, 340]], 1000, 1000, [["none"], True]), (1, [[100, 100, 300, 340]], 2000, 2000, [[None], False]), (2, [[0, 0, 300, 1000]], 1000, 1000, [[None], False]),
        (3, [[0, 0, 280, 1000]], 1000, 1000, [["none"], True]), (4, [[0, 0, 900, 900], [100, 100, 600, 600]], 1000, 1000, [[None, "none"], False]), (5, [[0, 0, 500, 500], [0, 0, 500, 500]], 1000, 1000, [[None, None], False]),
    ]
    df = spark.createDataFrame([p[:4] for p in pages], "i int, boxes array<array<int>>, w int, h int").withColumn("k", geometry.box_kinds(F.col("boxes"), F.col("w"), F.col("h")))
    found = df.orderBy("i").select("k", geometry.page_is_junk(F.col("k"))).collect()
    assert [list(r) for r in found] == [p[4] for p in pages]


def test_resolution(spark):
    rows = [
        ("teudat_zehut", True, 1011.0, 640.0, 1920, 1080, 300), ("teudat_zehut", True, 1485.0, 900.0, 2528, 3504, 300), ("teudat_zehut", False, 500.0, 300.0, 1264, 1752, 150), ("teudat_zehut", False, 500.0, 300.0, 1080, 1920, None), ("cheque_front", True, 608.0, 300.0, 1080, 1920, 97),
    ]
    df = spark.createDataFrame(rows, "kind string, sure boolean, l double, s double, w int, h int, want int")
    dpi = geometry.estimated_dpi(*[F.col(c) for c in ("kind", "sure", "l", "s", "w", "h")], F.lit(False), F.lit(True))
    assert [r[0] for r in df.select(dpi).collect()] == [r[-1] for r in rows]
    import math

    t = math.radians(25)
    box = (856 * math.cos(t) + 540 * math.sin(t), 856 * math.sin(t) + 540 * math.cos(t))
    edges = spark.range(1).select(geometry.document_edges(F.lit(box[0]), F.lit(box[1]), F.lit(25.0)).alias("e")).first().e
    assert abs(edges["long"] - 856) < 1 and abs(edges["short"] - 540) < 1


def test_degenerate_and_votes(spark):
    check(spark, geometry.is_degenerate, [([str(i % 4) for i in range(134)], True), ([str(min(i, 26)) for i in range(28)], False), ([], False)], "array<string>")
    votes = lambda up, down: [("0", 1.0)] * up + [("180", 1.0)] * down
    check(spark, geometry.decided_rotation, [(votes(8, 0), 0), (votes(0, 8), 180), (votes(4, 3), None), (votes(5, 4), None), (votes(6, 4), 0), ([], None)], "array<struct<label:string,score:double>>")


def test_triage(spark):
    rows = [(0, i, k, 0) for i, k in enumerate(["cheque_front", "teudat_zehut", "none", "sefach"])] + [(1, i, k, t) for i, (k, t) in enumerate([("cheque_front", 500), ("cheque_back", 900), ("cheque_front", 100), ("cheque_back", 700), ("none", 0)])]
    found = triage.selected(spark.createDataFrame(rows, "page_id int, idx int, kind string, top int")).filter("read").orderBy("page_id", "idx").collect()
    assert [(r.page_id, r.idx) for r in found] == [(0, 1), (0, 3), (1, 2), (1, 3)]


def test_merge(spark):
    def rec(page, pos, kind, lines=None, notes=None, **fields):
        return (page, pos, kind, {k: (v, c) for k, (v, c) in fields.items()}, lines, notes)

    rows = [
        rec(1, 0, "teudat_zehut_back", ["L"], "back", sex=("F", "high"), id_number=("1-2", "low")),
        rec(1, 1, "teudat_zehut", None, "front", id_number=("12", "high"), last_name_he=("A", "low"), sex=("", "high")),
        rec(1, 2, "israeli_passport", None, "pass", last_name_he=("B", "high"), date_of_birth=("x", "high"), id_number=("12", "high")),
        rec(1, 3, "israeli_drivers_license", None, None, id_number=("99", "high"), address=("elsewhere", "high")),
        rec(2, 0, "other", None, None, sex=("M", "low")),
    ]
    schema = "page_id int, pos int, document_type string, fields map<string,struct<value:string,confidence:string>>, mrz_lines array<string>, notes string"
    found = {r.page_id: r for r in merge.merged(spark.createDataFrame(rows, schema)).collect()}
    one = found[1]
    assert one.document_type == "teudat_zehut" and one.mrz_lines == ["L"] and one.notes == "front; pass"
    assert one.fields["last_name_he"]["value"] == "B" and one.fields["sex"]["value"] == "F" and one.fields["date_of_birth"]["value"] == "x"
    assert one.fields["address"] is None
    assert one.warnings == ["last_name_he differs between teudat_zehut and israeli_passport", "Ignored a israeli_drivers_license block belonging to a different person (ID number differs)"]
    assert found[2].warnings == [] and found[2].fields["sex"]["value"] == "M"
    cheques = [rec(1, 0, "cheque", amount=("5", "high"), payee=("p", "high")), rec(1, 1, "cheque_back", payee=("q", "low"), amount=("", "low")), rec(1, 2, "cheque", amount=("6", "high"))]
    two = merge.merged_cheque(spark.createDataFrame(cheques, schema)).first()
    assert two.extra_sides == 1 and two.fields["payee"]["value"] == "q" and two.fields["amount"]["value"] == "5"


def test_crop_margin_of_whole_pixels(spark):
    """A margin of 0.03 of 80 thousandths of 2,500 pixels is 6 pixels, not just under."""
    row = spark.createDataFrame([([420, 328, 460, 408], 1800, 2500)], "b array<int>, w int, h int")
    assert row.select(geometry.crop_pixels(F.col("b"), F.col("w"), F.col("h"))).first()[0] == [753, 814, 830, 1026]


@pytest.mark.parametrize("told", [mrz.parse, mrz.passport_type])
def test_zone_lines_refitted_once(spark, told):
    """However many fields are cut from a line, it is refitted in one place of the expression."""
    assert told(F.col("x"))._jc.toString().count("rpad") == 1


def test_zone_queries_use_all_cores(spark, sf_dir):
    for name in ("identity_verdicts", "zones_refitted"):
        assert contract.queries()[name](spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
