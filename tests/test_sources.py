"""Registry files, snapshots, and search over what was loaded."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from papyrine.operators import registries
from papyrine.sources import registry_files
from papyrine.sources.snapshots import SnapshotStore


def workbook(rows, shared=True):
    strings = sorted({c for row in rows for c in row if c})
    cells = []
    for n, row in enumerate(rows, 1):
        out = ""
        for i, c in enumerate(row):
            if not c:
                continue
            ref = f"{chr(65 + i)}{n}"
            out += f'<c r="{ref}" t="s"><v>{strings.index(c)}</v></c>' if shared else f'<c r="{ref}" t="inlineStr"><is><t>{c.replace("&", "&amp;")}</t></is></c>'
        cells.append(f'<row r="{n}">{out}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s.replace("&", "&amp;")}</t></si>' for s in strings)}</sst>")
    return file.getvalue()


def test_account_list(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"00,bank,1,260910,7,3,99\r\n0111148000001234562025010120270101\r\n0110001000000000992020010120210231\r\n\r\n")
    rows, date = registry_files.accounts(registry_files.text_lines(spark, str(path)))
    assert date == "2026-09-10"
    assert [tuple(r) for r in rows.orderBy("bank").collect()] == [(10, 1, 99, "2020-01-01", None), (11, 148, 123456, "2025-01-01", "2027-01-01")]
    path.write_bytes(b"00,bank,1,260910,7,4,99\r\n0111148000001234562025010120270101\r\n")
    with pytest.raises(ValueError, match="line count"):
        registry_files.accounts(registry_files.text_lines(spark, str(path)))
    path.write_bytes(b"00,bank,1,260910,7,2,99\r\n01x\r\n")
    with pytest.raises(ValueError, match="malformed"):
        registry_files.accounts(registry_files.text_lines(spark, str(path)))


def test_severe_list_in_a_legacy_code_page(spark, tmp_path):
    path = tmp_path / "s.txt"
    path.write_bytes("00,bank,1,260910,7,2,99\r\n01 212 510000003 01/05/2028 דוגמה בע\"מ \r\n".encode("cp1255"))
    rows, _ = registry_files.severe(registry_files.legacy_lines(spark, str(path)))
    row = rows.first()
    assert (row.id_number, row.name, row.end_date, row.tokens) == (510000003, 'דוגמה בע"מ', "2028-05-01", ["דוגמה", "בעמ"])


@pytest.mark.parametrize("shared", [True, False])
def test_designation_sheet(spark, tmp_path, shared):
    grid = [["מספר", "שם"], ["Internal  Seq. ID", "Name (English)", "ID & passport", "Date"], ["1", "Ann Example", "ID 12345678, P 99887", "46275"], ["2", "Bob", "", "בוטל ביום 1"], ["", "tail"]]
    (tmp_path / "x.xlsx").write_bytes(workbook(grid, shared))
    rows = registry_files.sheets(spark, str(tmp_path / "x.xlsx"))
    people = registry_files.by_headers(rows, {"name_en": r"name \(english\)", "id_text": "passport", "designated": "^date"}, key="internal seq. id")
    people = registry_files.indexed_people(people, ["name_en"], "id_text").withColumn("d", registry_files.designation(F.col("designated")))
    found = people.orderBy("seq").collect()
    assert [(r.seq, r.name_en, r.ids, r.tokens, r.d.date, r.d.cancelled) for r in found] == [(1, "Ann Example", [12345678, 99887], ["ann", "example"], "2026-09-10", False), (2, "Bob", [], ["bob"], None, True)]
    with pytest.raises(ValueError, match="no column"):
        registry_files.by_headers(rows, {"x": "nowhere"}, key="internal seq. id")


def test_company_pages(spark, tmp_path):
    def page(n, records, total=3):
        (tmp_path / f"p{n}.json").write_text(json.dumps({"page": n, "success": True, "result": {"total": total, "records": records}}))

    page(1, [{"no": "510000003", "name": "A~B", "city": ""}, {"no": "2", "name": "X", "city": None}])
    page(2, [{"no": "510000003", "name": "later", "city": "c"}])
    pages = spark.read.json(str(tmp_path))
    found = registry_files.companies(pages, {"name_he": "name", "city": "city"}, "no").orderBy("number").collect()
    assert [(r.number, r.name_he, r.city) for r in found] == [(2, "X", None), (510000003, 'A"B', None)]
    page(2, [], total=3)
    with pytest.raises(ValueError, match="declared"):
        registry_files.companies(spark.read.json(str(tmp_path)), {"name_he": "name"}, "no").count()


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/registry")
    assert store.status("companies")["status"] == "never" and store.read("companies") is None
    assert store.refresh("companies", lambda: (spark.range(3), "2026-09-10"))["row_count"] == 3
    assert store.refresh("companies", lambda: (spark.range(0), None))["status"] == "error"
    assert store.read("companies").count() == 3 and store.status("companies")["data_date"] == "2026-09-10"
    assert store.refresh("companies", lambda: (spark.range(5), "2026-09-11"))["status"] == "ok"
    assert store.read("companies").count() == 5 and list(store.tables(["companies", "boi_severe"])) == ["companies"]
    store._put("companies", store.status("companies") | {"status": "running"})
    store.interrupt_running(["companies"])
    assert store.status("companies")["status"] == "interrupted" and store.read("companies").count() == 5


def test_one_refresh_at_a_time(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/registry")
    seen = []

    def load():
        seen.append(store.refresh_all({"companies": load}))
        return spark.range(2), None

    def broken():
        raise OSError("gone")

    told = store.refresh_all({"boi_severe": broken, "companies": load})
    assert [r["status"] for r in told] == ["error", "ok"] and seen == [None]
    (tmp_path / "registry" / "refresh.running").write_text("")
    assert store.refresh_all({"companies": load}) is None
    store.interrupt_running(["companies"])
    assert store.refresh_all({"companies": lambda: (spark.range(1), None)})[0]["row_count"] == 1


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "boi_accounts": spark.createDataFrame([(11, 148, 123456, "2020-01-01", "2027-01-01"), (10, 1, 99, "2020-01-01", "2021-01-01")], "bank int, branch int, account long, start_date string, end_date string"),
        "boi_severe": spark.createDataFrame([(510000003, "דוגמה", None, ["דוגמה"])], "id_number long, name string, end_date string, tokens array<string>"),
        "nbctf_individuals": spark.createDataFrame([(1, False, ["דוגמן", "ישראל"], [300000007])], "seq int, cancelled boolean, tokens array<string>, ids array<bigint>"),
        "nbctf_orgs": spark.createDataFrame([(1, True, ["דוגמאות"], [510000003])], "seq int, cancelled boolean, tokens array<string>, ids array<bigint>"),
        "companies": spark.createDataFrame([(510000003, "פעילה", ["דוגמה"])], "number long, status string, tokens array<string>"),
    }


def test_search(spark, tables):
    def totals(**params):
        return {r.source: (r.total, r.name_only) for r in registries.search(tables, registries.Query.parsed(params)).collect()}

    assert totals(id="510000003") == {"boi_severe": (1, False), "nbctf_orgs": (1, False), "companies": (1, False)}
    assert totals(bank="11", branch="148", account="123456") == {"boi_accounts": (1, False)}
    assert totals(name="דוגמ") == {"boi_severe": (1, False), "nbctf_individuals": (1, True), "nbctf_orgs": (1, True), "companies": (1, False)}
    assert totals(bank="11", branch="148") == totals(id="1", account="2") == {}
    assert registries.applicability(registries.Query(id=1, account=2))[0] == []


def test_screen(spark, tables):
    payloads = spark.createDataFrame(
        [(1, "510000003", "510000003", ["300000007", None], None, "0510000003", "11", "148", "123456", "ישראל", "דוגמן", "x", "y"), (2, None, None, None, None, None, "11", None, "1", "ישראל", "דוגמ", None, None)],
        "document_id long, id_number string, spouse_id_number string, child_id_numbers array<string>, drawer_id_number string, guarantor_id_number string, bank_code string, branch_number string, account_number string, first_name_he string, last_name_he string, first_name_en string, last_name_en string",
    )
    found = registries.screen(payloads, tables, F.lit("2026-09-13")).orderBy("pos", "source_pos").collect()
    assert [(r.document_id, r.field, r.source, r.level) for r in found] == [
        (1, "id_number", "boi_severe", "alert"), (1, "id_number", "nbctf_orgs", "info"), (1, "id_number", "companies", "info"), (1, "child_id_number", "nbctf_individuals", "alert"), (1, "account", "boi_accounts", "alert"), (1, "name_he", "nbctf_individuals", "alert"),
    ]
    checked = {r.document_id: r.checked for r in registries.checked_keys(payloads, tables).collect()}
    assert checked == {1: ["id_number", "child_id_number", "account", "name_he"], 2: ["name_he"]}
    text = json.dumps({"alerts": [], "infos": [{"source": "companies", "by": "id", "count": 2}]})
    parsed = spark.createDataFrame([(text,), ("{bad",), (None,), ('{"error":"REGISTRIES_UNAVAILABLE"}',), ("[]",)], "x string").select(registries.parsed_summary(F.col("x")).alias("p")).collect()
    assert [r.p is not None for r in parsed] == [True, False, False, True, False]
