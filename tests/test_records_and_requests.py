"""Sheet records, request decisions, accounts and log operators without an oracle."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from papyrine.operators import accounts, request_log, requests, sheet_records

SHEET = f"page_id int, fields map<string,{sheet_records.FIELD}>, address {sheet_records.ADDRESS}, spouse {sheet_records.PERSON}, children array<{sheet_records.PERSON}>"


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_sheet_records(spark):
    fields = {"id_number": ("12345 6782", "high"), "maiden_name_he": ("נשואה", "low"), "marital_status": (None, "high"), "date_of_birth": ("1.2.1990", "high"), "last_name_he": ("כהנ", "high")}
    children = [("כהן", "א", "123456782", None, "זכר", "high"), (None, None, "", None, None, "high"), ("לוי", "ב", "3-0000-0007", "5.6.2010", "F", "high")]
    rows = [(1, fields, ("הרצל 5", "5", None, "", "חיפה", None, "medium"), (None, None, "", None, "M", "low"), children), (2, {}, (None, None, None, None, None, None, "high"), None, None)]
    found = {r.page_id: r for r in sheet_records.status_code(sheet_records.cleaned(spark.createDataFrame(rows, SHEET))).collect()}
    a = found[1]
    assert a.fields["id_number"].value == "123456782" and a.fields["date_of_birth"].value == "1990-02-01" and a.fields["last_name_he"].confidence == "medium"
    assert a.fields["maiden_name_he"].value is None and tuple(a.fields["marital_status"]) == ("נשואה", "medium") and a.marital_status_code == "married"
    assert (a.address.street, a.address.house_number, a.address.apartment) == ("הרצל", "5", None) and a.spouse is None
    assert [(c.id_number, c.date_of_birth, c.sex) for c in a.children] == [("300000007", "2010-06-05", "F")]
    assert found[2].address is None and found[2].children == []
    told = sheet_records.rows(spark.createDataFrame(rows, SHEET)).filter("page_id = 1").orderBy("pos").collect()
    assert told[0].name == "id_number" and "children[2].sex" in [r.name for r in told] and {r.section for r in told} == {"sefach", "children"}
    assert {(r.page_id, r.section): r.n for r in sheet_records.section_counts(spark.createDataFrame(rows, SHEET)).collect()}[(1, "children")] == 9


def test_assembled_sheet(spark):
    holder = "struct<" + ",".join(f"{c}:string" for c in [*sheet_records.HOLDER, *sheet_records.PLACE, "confidence"]) + ">"
    status = "struct<" + ",".join(f"{c}:string" for c in [*sheet_records.STATUS, "spouse_last_name_he", "spouse_first_name_he", "spouse_id_number", "confidence"]) + ">"
    blocks = spark.createDataFrame([(1, tuple("h" for _ in range(12)) + ("low",), None), (2, tuple("h" for _ in range(12)) + ("low",), tuple("s" for _ in range(10)) + ("medium",))], f"page_id int, holder {holder}, status {status}")
    found = {r.page_id: r for r in sheet_records.assembled(blocks).collect()}
    assert tuple(found[1].fields["id_number"]) == ("h", "low") and tuple(found[1].fields["nationality"]) == (None, "high") and found[1].spouse is None
    assert tuple(found[2].fields["nationality"]) == ("s", "medium") and found[2].spouse.id_number == "s"


def test_request_decisions(spark):
    choose = lambda *a: tuple(one(spark, requests.engine_choice(*[F.lit(x).cast("string") for x in a], ["m"])))
    assert choose("hosted", "local", "m", "l") == ("cloud", "m") and choose("hosted", None, "other", None) == ("cloud", None)
    assert choose("none", "local", "m", "l") == ("local", "l") and choose("none", "x", "m", "l") == (None, None) and choose("none", "cloud", "other", None) == ("cloud", "other")
    assert requests.settings_patch({"store_results": True, "model": "m", "backend": 5, "x": 1}, ["m"], by_key=True) == {"model": "m"}
    assert requests.settings_patch({"store_results": False, "model": "z"}, ["m"], by_key=True) == {"store_results": False}
    assert tuple(one(spark, requests.error_answer(F.lit("rate_limited")))) == (429, "UPSTREAM_LIMIT") and one(spark, requests.error_answer(F.lit("x"))) is None
    assert one(spark, requests.known_error(F.lit("A"), ["A"])) == "A" and one(spark, requests.known_error(F.lit("B"), ["A"])) == "GENERIC"
    assert one(spark, requests.has_prefix(F.lit("big-5"), ["big-"], [])) and not one(spark, requests.has_prefix(F.lit("big-5"), ["big-"], ["big-5"]))
    assert one(spark, requests.frame_label(F.lit("israeli_passport"), F.lit(True), F.lit("x"))) == "passport" and one(spark, requests.frame_label(F.lit("weapon_license"), F.lit(True), F.lit("x"))) is None
    assert one(spark, requests.frame_label(F.lit("sefach"), F.lit(False), F.lit("x"))) == "x"
    assert tuple(one(spark, requests.frame_route(F.lit("cheque_back")))) == ("cheque", "cheque_back") and tuple(one(spark, requests.frame_route(F.lit("q")))) == ("generic", None)
    assert one(spark, requests.published_type(F.lit("other"), F.lit("weapon_license"), F.lit(False))) == "weapon_license"
    assert not one(spark, requests.may_change_user(F.lit("a"), F.lit("admin"), F.lit("a"), F.lit("delete"))) and one(spark, requests.may_change_user(F.lit("a"), F.lit("admin"), F.lit("b"), F.lit("delete")))


def test_accounts(spark):
    users = spark.createDataFrame([("u", "A@x.y", "admin"), ("v", "b@x.y", "user")], "user_id string, email string, role string")
    keys = spark.createDataFrame([("u", "h1", None), ("gone", "h2", None), ("v", "h3", "2024")], "user_id string, hash string, revoked_at string")
    assert [r.hash for r in accounts.resolve_keys(keys, users).collect()] == ["h1"]
    invitations = spark.createDataFrame([(1, "c@x.y", "u", "pending", 5, 10), (2, "c@x.y", None, "pending", 6, 100), (3, "d@x.y", "z", "accepted", 1, 2)], "id int, email string, invited_by string, status string, created_at long, expires_at long")
    found = {r.id: (r.status, r.inviter_email) for r in accounts.with_inviter(invitations, users, F.lit(50)).collect()}
    assert found == {1: ("expired", "A@x.y"), 2: ("pending", None), 3: ("accepted", None)}
    current = {r.id: r.status for r in accounts.current_invitations(invitations).collect()}
    assert current == {1: "revoked", 2: "pending", 3: "accepted"}
    sign_ups = spark.createDataFrame([("n", "C@x.y ", True, 50), ("m", "c@x.y", False, 50), ("o", "q@x.y", True, 50)], "user_id string, email string, verified boolean, at long")
    assert [(r.user_id, r.invitation_id) for r in accounts.admitted(sign_ups, invitations).collect()] == [("n", 2)]
    first = {r.user_id: (r.role, r.email) for r in accounts.registered(sign_ups.select("user_id", "email", (F.col("at") + F.when(F.col("user_id") == "o", -1).otherwise(0)).alias("at"))).collect()}
    assert first == {"n": ("user", "c@x.y"), "m": ("user", "c@x.y"), "o": ("admin", "q@x.y")}
    mode = lambda *a: one(spark, accounts.request_mode(F.lit(a[0]), *[F.lit(x) for x in a[1:]]))
    assert [mode("none", False, False, 9, 1), mode("x", True, False, 9, 1), mode("x", False, True, 9, 1), mode("x", False, False, 0, 1), mode("x", False, False, 1, 1)] == ["local", "byok", "trial", "trial", "exhausted"]
    assert tuple(one(spark, accounts.model_parts(F.lit("local/a/b:8")))) == ("local", "a/b:8")
    assert one(spark, accounts.budget_key(F.lit("api"), F.lit(None).cast("string"), F.lit("u"))) == "api:user:u"
    visits = spark.createDataFrame([("u", t) for t in (0, 30, 59, 60, 61, 200)], "user_id string, s long").select("user_id", F.timestamp_seconds("s").alias("at"))
    assert [r.written_at.second + 60 * r.written_at.minute for r in accounts.throttled_last_seen(visits).orderBy("written_at").collect()] == [0, 60, 200]
    base = spark.createDataFrame([("u", "m1", True)], "user_id string, model string, store boolean")
    patches = spark.createDataFrame([("u", "m2", 1), ("u", None, 2), ("w", "m3", 1)], "user_id string, model string, seq long")
    assert {r.user_id: (r.model, r.store) for r in accounts.upserted(base, patches, "user_id", "seq").collect()} == {"u": ("m2", True), "w": ("m3", None)}
    left = accounts.without_user({"keys": keys}, users.filter("user_id = 'u'").select("user_id"))["keys"]
    assert {r.hash for r in left.collect()} == {"h2", "h3"}


def test_log_states_and_pages(spark):
    changes = spark.createDataFrame([("d", 1, 102, None), ("d", 2, 200, "cheque"), ("e", 1, 102, None)], "id string, seq int, status int, doc_type string")
    assert {r.id: (r.status, r.doc_type) for r in request_log.latest_state(changes).collect()} == {"d": (200, "cheque"), "e": (102, None)}
    assert request_log.page_bounds(None, None) == (50, 0) and request_log.page_bounds(999, -4) == (200, 0) and request_log.page_bounds(0, 3) == (1, 3)
    assert tuple(one(spark, request_log.page_arithmetic(F.lit(101), 50, F.lit("9")))) == (3, 3) and tuple(one(spark, request_log.page_arithmetic(F.lit(0), 50, F.lit("x")))) == (1, 1)
    assert request_log.parse_filters({"status": "bad", "from": "2024-1-1", "verdict": ["v", "w"], "family": ""}) == {"verdict": "v"}
    log = spark.createDataFrame([("a", "cheque")], "id string, doc_type string")
    assert log.filter(request_log.matches({"family": "nothing"})).isEmpty() and not log.filter(request_log.matches({"family": "cheque"})).isEmpty()


def test_admitted_without_pairs(spark):
    """The newest live invitation of an address against a search over all of them; no join by address."""
    rng = random.Random(11)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    sent = [(i, rng.choice([" A@x.test", "b@x.test", "c@x.test"]), rng.choice(["pending", "pending", "revoked"]), s := rng.randrange(400), s + rng.randrange(0, 120)) for i in range(500)]
    asked = [(u, rng.choice(["a@x.test", "B@x.test", "d@x.test"]), rng.random() < 0.8, rng.randrange(500)) for u in range(400)]
    asked += [(u, "a@x.test", True, rng.randrange(500)) for u in range(0, 400, 9)]
    expected = {}
    for user, address, verified, s in asked:
        for i, to, status, created, until in sent:
            if verified and status == "pending" and to.strip().lower() == address.lower() and created <= s < until:
                expected[user] = max(expected.get(user, (-1, -1)), (created, i))
    invitations = spark.createDataFrame([(i, a, t, at(c), at(u)) for i, a, t, c, u in sent], "id long, email string, status string, created_at timestamp, expires_at timestamp")
    sign_ups = spark.createDataFrame([(u, a, v, at(s)) for u, a, v, s in asked], "user_id long, email string, verified boolean, at timestamp")
    found = accounts.admitted(sign_ups, invitations)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.user_id, r.invitation_id) for r in found.collect()]
    assert len(got) == len(expected) > 100 and dict(got) == {u: i for u, (_, i) in expected.items()}
