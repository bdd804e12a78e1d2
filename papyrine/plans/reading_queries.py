"""Queries over transcripts, zones, frames, decisions, sheets, runs and generations, with their DuckDB SQL.

Names come from the tables' texts: Latin letters become Hebrew ones by a fixed table that both sides share.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrine.functions import calendar, geometry, mrz, names, tilt
from papyrine.operators import anchors, merge, registries, requests, runs, sheet_records, sheets, triage
from papyrine.plans.adapters import view
from papyrine.plans.queries import query
from papyrine.sources import registry_files
from papyrine.sources.generations import History, Migration
from papyrine.sources.run_corpus import RunCorpus
from papyrine.sources.snapshots import SnapshotStore
from papyrine.workspace import fresh_path

# A Hebrew letter for each Latin one.
LATIN, HEBREW = "abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיעלמנסעפקקרשתאבגד"


def _hebrew(word: str) -> str:
    return f"translate({word}, '{LATIN}', '{HEBREW}')"


def _weighed(text: str) -> str:
    """SQL of the sum over eight digits of which every second one counts double, by its digits' sum."""
    digit = lambda i: f"CAST(substr({text}, {i}, 1) AS INT)"
    return " + ".join(digit(i) if i % 2 else f"CASE WHEN {digit(i)} > 4 THEN 2 * {digit(i)} - 9 ELSE 2 * {digit(i)} END" for i in range(1, 9))


def _with_check(text: str) -> str:
    return f"{text} || CAST((10 - ({_weighed(text)}) % 10) % 10 AS STRING)"


_EIGHT = "lpad(CAST(conv_id * 7919 % 100000000 AS STRING), 8, '0')"
#: Two words of every turn in Hebrew letters, and a number with its check digit.
TURNS = f"""SELECT conv_id * 100 + turn AS k, a, b, id FROM (
  SELECT conv_id, turn, {_hebrew("regexp_extract(lower(text), '([a-z]+)[^a-z]+([a-z]+)', 1)")} AS a, {_hebrew("regexp_extract(lower(text), '([a-z]+)[^a-z]+([a-z]+)', 2)")} AS b, {_with_check(_EIGHT)} AS id FROM {{conversations}})
WHERE a <> '' AND b <> '' AND length(a) <= 20 AND length(b) <= 20"""


def turns(spark, sf_dir):
    return spark.sql(TURNS, conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


TURNS_SQL = TURNS.replace("{conversations}", "conversations")


@query(
    f"""SELECT k, CASE WHEN k % 4 = 0 THEN a WHEN k % 4 = 2 THEN b END AS last_name_he, CASE WHEN k % 4 = 0 THEN b WHEN k % 4 = 2 THEN a END AS first_name_he,
  CASE WHEN k % 4 = 1 THEN a END AS father_name_he, CASE WHEN k % 4 = 1 THEN b END AS mother_name_he, CASE WHEN k % 4 = 3 THEN CASE WHEN k % 3 = 0 THEN 'F' ELSE 'M' END END AS sex,
  CASE WHEN k % 5 > 0 THEN id END AS id_number, CASE WHEN k % 7 = 0 THEN '11' END AS bank_code, CASE WHEN k % 7 = 0 THEN substr(id, 1, 3) END AS branch_number,
  CASE k % 4 WHEN 1 THEN 'father_name_he,mother_name_he' WHEN 3 THEN 'sex' ELSE '' END || CASE WHEN k % 6 = 0 THEN CASE WHEN k % 4 IN (1, 3) THEN ',' ELSE '' END || 'date_of_expiry' ELSE '' END AS printed
FROM ({TURNS_SQL})"""
)
def anchors_found(spark, sf_dir):
    """Names above and below their label, parents of an old card, sex, number, cheque line and labels."""
    k, a, b, number = F.col("k"), F.col("a"), F.col("b"), F.col("id")
    card = F.when(k % 4 == 0, F.array(a, F.lit("שם פרטי"), b)).when(k % 4 == 1, F.array(F.lit("שם האב"), a, F.lit("שם האם"), b)).when(k % 4 == 2, F.array(F.lit("12.3"), b, F.lit("השם הפרטי:"), a)).otherwise(F.array(F.lit("המין"), F.when(k % 3 == 0, "נקבה").otherwise("זכר")))
    printed_id = F.concat(F.substring(number, 1, 1), F.lit(" "), F.substring(number, 2, 7), F.lit("-"), F.substring(number, 9, 1))
    wrong = F.concat(F.substring(number, 1, 8), ((F.substring(number, 9, 1).cast("int") + 1) % 10).cast("string"))
    cheque = F.concat(F.lit("80012345 11 "), F.substring(number, 1, 5), F.lit(" 000123456789"))
    lines = F.concat(card, F.array(F.lit("-"), wrong, F.when(k % 5 > 0, printed_id).otherwise("")), F.when(k % 7 == 0, F.array(cheque)).otherwise(F.array(F.lit("."))), F.when(k % 6 == 0, F.array(F.lit("בתוקף עד"))).otherwise(F.array(F.lit(","))))
    found = anchors.with_anchors(turns(spark, sf_dir).withColumn("lines", lines))
    told = [F.try_element_at("anchors", F.lit(f)).alias(f) for f in ("last_name_he", "first_name_he", "father_name_he", "mother_name_he", "sex", "id_number", "bank_code", "branch_number")]
    return found.select("k", *told, F.array_join(F.array_sort("printed"), ",").alias("printed"))


@query(
    f"""SELECT k, CASE k % 5 WHEN 0 THEN NULL ELSE a || ' ' || b END AS payee, CASE WHEN k % 3 = 0 THEN a ELSE a || ' ' || b END AS drawer,
  CASE k % 4 WHEN 0 THEN 'married' WHEN 1 THEN 'widowed' END AS status, right(a, 1) IN ('כ', 'מ', 'נ', 'פ', 'צ') AS doubtful, a || ' ' || b AS bare, a || b AS core FROM ({TURNS_SQL})"""
)
def names_read(spark, sf_dir):
    """Payees and drawers without their printed labels, marital status, final letters, points."""
    k, a, b, number = F.col("k"), F.col("a"), F.col("b"), F.col("id")
    both = F.concat_ws(" ", a, b)
    written = F.when(k % 5 == 0, "שלמו לפקודת: ").when(k % 5 == 1, F.concat(F.lit("לפקודת - "), both)).when(k % 5 == 2, F.concat(F.lit("Pay to the order of "), both)).otherwise(both)
    drawn = F.when(k % 3 == 0, F.concat(a, F.lit(" ת.ז. "), number)).otherwise(both)
    status = F.when(k % 4 == 0, "נשוי/אה").when(k % 4 == 1, "אַלְמָן").otherwise(a)
    pointed = F.concat(F.lit("  "), a, F.lit("\u05b8 "), b, F.lit("\u05bc "))
    marital = names.marital_status(F.when(k % 4 == 0, F.regexp_replace(status, "/אה", "")).otherwise(status))
    return turns(spark, sf_dir).select(
        "k", names.payee(written).alias("payee"), names.drawer_name(drawn).alias("drawer"), marital.alias("status"), names.suspicious_hebrew_name(a).alias("doubtful"),
        names.without_points(pointed).alias("bare"), names.hebrew_core(F.concat(a, F.lit("\u05b8-1 "), b)).alias("core"),
    )


@query(
    """SELECT k, rpad(upper_line, 44, '<') AS upper, CASE WHEN k % 2 = 0 THEN 'israeli_passport' ELSE 'foreign_passport' END AS type, k % 3 > 0 AS whole,
  CASE WHEN k % 3 > 0 THEN substr(data_line, 1, 9) END AS number FROM zones""",
    "zones",
)
def zones_refitted(spark, sf_dir):
    """Zones in lower case, with blanks and missing fillers, between lines that are none; every third lacks its data line."""
    k = F.col("k")
    state = F.when(k % 2 == 0, "ISR").otherwise("UTO")
    upper, data = F.regexp_replace(F.col("upper_line"), "UTO", state), F.col("data_line")
    short = F.concat(F.regexp_replace(F.lower(upper), "<+$", "<"), F.lit("  "))
    printed = F.concat(F.array(F.lit("PASSPORT"), short), F.array(F.concat(F.substring(data, 1, 20), F.lit(" "), F.substring(data, 21, 24))), F.when(k % 3 > 0, F.array(F.lit("signature of bearer"))).otherwise(F.array(F.rpad(F.lit("X"), 30, "1"))))
    lines = mrz.clean_lines(printed)
    zones = view(spark, sf_dir, "zones", spread=True).withColumn("lines", lines)
    fitted = mrz.refit(F.col("lines")[0], F.lit(mrz.TD3))
    # each a column of its own, so that it is worked out once
    read = zones.withColumns({"fitted": fitted, "zone": mrz.parse(F.col("lines")), "kind": mrz.passport_type(F.slice(printed, 1, 3))})
    return read.select("k", F.regexp_replace("fitted", "ISR", "UTO").alias("upper"), F.col("kind").alias("type"), F.col("zone").isNotNull().alias("whole"), F.col("zone.document_number").alias("number"))


_BOX_KIND = "CASE (page_id + x1) % 6 WHEN 0 THEN 'cheque_front' WHEN 1 THEN 'cheque_back' WHEN 2 THEN 'none' ELSE 'sefach' END"
_FRAMES = f"SELECT page_id, idx, x1, y1, {_BOX_KIND} AS kind, x2 % 3 = 0 AS sure, CASE y2 % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'unreadable' ELSE 'cheque' END AS document_type, CAST(60 + y2 % 200 AS INT) AS dpi FROM (SELECT *, row_number() OVER (PARTITION BY page_id, idx ORDER BY x1, y1, x2, y2) AS n FROM boxes WHERE x1 < 400) WHERE n = 1"


@query(
    f"""WITH f AS ({_FRAMES}), c AS (SELECT *, kind <> 'none' AND row_number() OVER (PARTITION BY page_id, kind <> 'none' ORDER BY idx) <= 4 AS candidate FROM f)
SELECT page_id, idx, candidate, NOT candidate AND kind <> 'none' AS beyond, sure OR kind = 'cheque_back' AND bool_or(kind = 'cheque_front' AND sure) OVER p AS confirmed,
  document_type NOT IN ('other', 'unreadable') OR NOT bool_or(document_type NOT IN ('other', 'unreadable')) OVER p AS merged, min(dpi) OVER p < 135 AS low,
  CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, idx) AS INT) AS place FROM c WINDOW p AS (PARTITION BY page_id)""",
    "boxes",
)
def frames_triaged(spark, sf_dir):
    """The first four possible frames, those beyond them, confirmed backs, what is merged, low resolution, reading order."""
    frames = spark.sql(_FRAMES.replace("FROM boxes", "FROM {boxes}"), boxes=view(spark, sf_dir, "boxes"))
    first = triage.candidates(frames)
    beyond = requests.beyond_cap(frames, first)
    marked = lambda df, name: df.select("page_id", "idx", F.lit(True).alias(name))
    on = ["page_id", "idx"]
    out = triage.back_inherits(frames).join(marked(first, "candidate"), on, "left").join(marked(beyond, "beyond"), on, "left").join(marked(triage.mergeable(frames), "merged"), on, "left")
    out = out.join(triage.resolution_warning(frames).select("page_id", "low"), "page_id")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(*triage.region_order(F.array("x1", "y1")), "idx"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("page_id", "idx", no("candidate"), no("beyond"), "confirmed", no("merged"), "low", place.alias("place"))


@query(
    """SELECT page_id, n >= 8 AND 5 * n_tall >= 4 * n AS sideways, cells FROM (
  SELECT page_id, count(*) AS n, count(*) FILTER ((x2 - x1) < 2 * (y2 - y1)) AS n_tall,
    (SELECT string_agg(greatest(CAST(trunc((1 - c - 0.05::DOUBLE) * any_value(width) / 2) AS INT), 0) || ',' || greatest(CAST(trunc((r - 0.05::DOUBLE) * any_value(height) / 2) AS INT), 0), ' ' ORDER BY r, c)
     FROM range(2) a(r), range(2) b(c)) AS cells FROM boxes GROUP BY page_id)""",
    "boxes",
)
def pages_turned(spark, sf_dir):
    """Pages whose text boxes stand up, and the corners of a sheet's cells in two rows and columns."""
    boxes = view(spark, sf_dir, "boxes")
    pages = boxes.groupBy("page_id").agg(F.collect_list((F.col("x2") - F.col("x1")) < 2 * (F.col("y2") - F.col("y1"))).alias("tall"), F.first("width").alias("width"), F.first("height").alias("height"))
    cells = F.transform(geometry.grid_cells(F.col("width"), F.col("height"), 2, 2, 0.05), lambda c: F.concat_ws(",", c["box"][0].cast("string"), c["box"][1].cast("string")))
    return pages.select("page_id", geometry.lies_sideways(F.col("tall")).alias("sideways"), F.array_join(cells, " ").alias("cells"))


@query(
    """WITH b AS (SELECT page_id, x1 AS x, y1 AS y FROM boxes UNION SELECT page_id, x2, y2 FROM boxes),
d AS (SELECT p.page_id, q.x - p.x AS dx, q.y - p.y AS dy FROM b p JOIN b q ON p.page_id = q.page_id AND (p.x, p.y) < (q.x, q.y)),
s AS (SELECT d.page_id, dx, dy, (max(x * dx + y * dy) - min(x * dx + y * dy))::BIGINT AS w, (max(x * dy - y * dx) - min(x * dy - y * dx))::BIGINT AS h FROM (SELECT DISTINCT * FROM d) d JOIN b ON d.page_id = b.page_id GROUP BY ALL)
SELECT page_id, min((w * h)::DOUBLE / (dx * dx + dy * dy)) AS area FROM s GROUP BY page_id""",
    "boxes",
)
def page_tilts(spark, sf_dir):
    """The least rectangle around the frames' corners; the SQL tries every direction between two corners."""
    points = view(spark, sf_dir, "boxes").groupBy("page_id").agg(F.flatten(F.collect_list(F.array("x1", "x2"))).alias("xs"), F.flatten(F.collect_list(F.array("y1", "y2"))).alias("ys"))
    return points.select("page_id", tilt.rectangle(F.col("xs"), F.col("ys"))["area"].alias("area"))


@query(
    """SELECT event_id, CASE WHEN user_id % 3 = 0 OR event_id % 2 = 0 THEN 'cloud' ELSE 'local' END AS backend,
  CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_id % 5 < 2 THEN 'm' || CAST(event_id % 5 AS STRING) END WHEN event_id % 2 = 0 THEN 'm' || CAST(event_id % 5 AS STRING) ELSE 'own' END AS model,
  CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 429 WHEN 'view' THEN 422 END AS status, CASE event_type WHEN 'error' THEN 'OVERLOADED' WHEN 'click' THEN 'UPSTREAM_LIMIT' WHEN 'view' THEN 'UNREADABLE' END AS code,
  CASE event_type WHEN 'click' THEN 'UPSTREAM_LIMIT' WHEN 'error' THEN 'OVERLOADED' ELSE 'GENERIC' END AS told, props LIKE '{"k": 1%' AND props NOT LIKE '{"k": 13%' AS takes,
  CASE WHEN event_id % 4 = 0 THEN 'cheque_front' WHEN event_id % 4 = 1 THEN NULL ELSE 'id_card_back' END AS label, CASE WHEN event_id % 4 = 0 THEN 'cheque' ELSE 'generic' END AS route,
  CASE WHEN event_id % 4 = 0 THEN 'cheque' WHEN event_id % 4 > 1 THEN 'teudat_zehut_back' END AS expected_type, CASE WHEN event_id % 4 = 1 THEN 'weapon_license' ELSE 'other' END AS published,
  user_id % 4 = 0 AND (event_id % 150 <> user_id OR event_type = 'view') AS may FROM events"""
)
def requests_decided(spark, sf_dir):
    """Engine, error answer, options, frame route, published type and rights of every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    event, user = F.col("event_id"), F.col("user_id")
    model = F.concat(F.lit("m"), (event % 5).cast("string"))
    chosen = requests.engine_choice(F.when(user % 3 == 0, "hosted").otherwise("own"), F.when(event % 2 == 0, "cloud").otherwise("local"), model, F.lit("own"), ["m0", "m1"])
    failure = F.when(F.col("event_type") == "error", "overloaded").when(F.col("event_type") == "click", "rate_limited").when(F.col("event_type") == "view", "unreadable").otherwise("stranger")
    answer = requests.error_answer(failure)
    kind = F.when(event % 4 == 0, "cheque_front").when(event % 4 == 1, "weapon_license").when(event % 4 == 2, "none").otherwise("cheque_back")
    sure = event % 4 < 3
    label = requests.frame_label(kind, sure, F.lit("id_card_back"))
    route = requests.frame_route(label)
    action = F.when(F.col("event_type") == "view", "rename").otherwise("demote")
    return events.select(
        "event_id", chosen["backend"].alias("backend"), chosen["model"].alias("model"), answer["status"].alias("status"), answer["code"].alias("code"), requests.known_error(answer["code"], ["UPSTREAM_LIMIT", "OVERLOADED"]).alias("told"),
        requests.has_prefix(F.col("props"), ['{"k": 1'], ['{"k": 13']).alias("takes"), label.alias("label"), route["route"].alias("route"), route["expected_type"].alias("expected_type"),
        requests.published_type(F.lit("other"), kind, sure).alias("published"), requests.may_change_user(event % 150, F.when(user % 4 == 0, "admin").otherwise("user"), user, action).alias("may"),
    )


@query(
    f"""WITH t AS (SELECT k, a, b, id, substr(id, 1, 8) || CAST((CAST(right(id, 1) AS INT) + 1) % 10 AS STRING) AS wrong FROM ({TURNS_SQL}))
SELECT k AS page_id, CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END AS pos, CASE WHEN k % 4 = 3 THEN wrong ELSE id END AS id_number,
  CASE k % 4 WHEN 3 THEN 'low' ELSE 'high' END AS id_confidence, CAST(CASE k % 4 WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 1 END AS INT) AS n_warnings FROM t"""
)
def sheets_chosen(spark, sf_dir):
    """Two sheets a page: the holder's with a misread number, a stranger's, one without names, or the card's own."""
    k, a, b, number = F.col("k"), F.col("a"), F.col("b"), F.col("id")
    wrong = F.concat(F.substring(number, 1, 8), ((F.right(number, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    none = F.lit(None).cast("string")
    stranger = F.struct(F.lit("123456782").alias("id_number"), F.lit("אחר").alias("first_name_he"), F.lit("לגמרי").alias("last_name_he"))
    own = F.struct(F.when(k % 4 == 1, wrong).when(k % 4 == 3, wrong).otherwise(number).alias("id_number"), F.when(k % 4 == 3, none).otherwise(a).alias("first_name_he"), F.when(k % 4 == 3, none).otherwise(b).alias("last_name_he"))
    other = F.when(k % 4 == 0, own).otherwise(stranger)
    both = F.when(k % 4 == 3, F.array(other, own)).otherwise(F.array(own, other))
    found = turns(spark, sf_dir).select(k.alias("page_id"), "a", "b", "id", F.posexplode(both).alias("pos", "s")).filter("s.id_number <> '123456782' or id <> '123456782'")
    rows = found.select("page_id", "pos", "s.*", none.alias("street"), F.array().cast("array<string>").alias("children_ids"), none.alias("spouse_id"))
    cards = turns(spark, sf_dir).select(k.alias("page_id"), number.alias("card_id"), a.alias("card_first"), b.alias("card_last"))
    chosen = sheets.selected(sheets.matched_by_name(rows, cards))
    return chosen.select("page_id", F.col("pos").cast("int").alias("pos"), "id_number", "id_confidence", F.size("warnings").alias("n_warnings"))


@query(
    """SELECT backend AS run, coalesce(verdict, 'error') AS verdict, count(*) AS n, CAST(round(1000 * avg(latency_ms)) AS BIGINT) AS mean_us, count(*) FILTER (id % 3 = 0) AS micr_parsed,
  count(*) FILTER (verdict IS NOT NULL AND source IN ('web', 'api')) AS uncertain FROM request_log GROUP BY ALL""",
    "request_log",
)
def run_corpus_tallies(spark, sf_dir):
    """Two runs written as JSON, one of them twice and once without its manifest, read back and tallied."""
    log = view(spark, sf_dir, "request_log").select(F.col("id").cast("string").alias("file"), "backend", "verdict", "latency_ms", (F.col("id") % 3 == 0).alias("micr_parsed"), F.when(F.col("source") == "web", "low").when(F.col("source") == "api", "medium").otherwise("high").alias("confidence"))
    corpus = RunCorpus(spark, fresh_path(spark, "runs"))
    for name in ("local", "cloud", "cloud"):
        corpus.write(name, log.filter(F.col("backend") == name).drop("backend"))
    log.limit(1).drop("backend").write.json(f"{corpus.root}/run=local/attempt=killed")
    found = corpus.read()
    tallies = [runs.verdict_tally(found.filter(F.col("run") == r)).withColumn("run", F.lit(r)) for r in ("local", "cloud")]
    fields = found.filter("verdict is not null").select("run", F.concat_ws("/", "run", "verdict").alias("name"), "confidence")
    uncertain = runs.uncertain_fields(fields).select(F.split("name", "/")[0].alias("run"), F.split("name", "/")[1].alias("verdict"), F.col("n").alias("uncertain"))
    every = tallies[0].unionByName(tallies[1]).join(uncertain, ["run", "verdict"], "left")
    return every.select("run", "verdict", "n", F.round(1000 * F.col("mean_latency_ms")).cast("long").alias("mean_us"), "micr_parsed", F.coalesce("uncertain", F.lit(0)).alias("uncertain"))


CUSTOMERS = History(
    {"c_custkey": "int", "c_name": "string", "c_acctbal": "float"},
    [Migration({"c_mktsegment": ("string", "NONE")}), Migration({"c_nationkey": ("int", -1)}, {"c_custkey": "bigint", "c_acctbal": "double"})],
)


@query(
    """SELECT CAST(c_custkey % 3 AS INT) AS generation, CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CASE WHEN c_custkey % 3 = 2 THEN c_acctbal::DOUBLE ELSE c_acctbal::FLOAT::DOUBLE END AS c_acctbal,
  CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'NONE' END AS c_mktsegment, CAST(CASE WHEN c_custkey % 3 > 1 THEN c_nationkey ELSE -1 END AS INT) AS c_nationkey FROM customer"""
)
def generations_read(spark, sf_dir):
    """Customers in snapshots of three versions, read at the latest."""
    paths = []
    for version in range(3):
        paths.append(fresh_path(spark, "generation"))
        CUSTOMERS.write(spark.read.parquet(f"{sf_dir}/customer.parquet").filter(F.col("c_custkey") % 3 == version), paths[-1], version)
    return CUSTOMERS.read(spark, paths)


@query(
    """SELECT 'boi_severe' AS source, 'ok' AS status, CAST(2 AS BIGINT) AS generation, count(*) FILTER (end_date IS NULL) AS row_count, CAST(sum(id_number) FILTER (end_date IS NULL) AS BIGINT) AS sum_ids FROM boi_severe
UNION ALL SELECT 'companies', 'error', CAST(1 AS BIGINT), count(*), CAST(sum(number) AS BIGINT) FROM companies""",
    "boi_severe",
    "companies",
)
def snapshots_refreshed(spark, sf_dir):
    """A source loaded twice shows its second load; one whose second load fails keeps its first."""
    store = SnapshotStore(spark, fresh_path(spark, "registry"))
    severe, companies = view(spark, sf_dir, "boi_severe"), view(spark, sf_dir, "companies")

    def fail():
        raise OSError("unreachable")

    store.refresh_all({"boi_severe": lambda: (severe, None), "companies": lambda: (companies, None)})
    store.refresh_all({"companies": fail, "boi_severe": lambda: (severe.filter("end_date is null"), None)})
    out = None
    for source, key in (("boi_severe", "id_number"), ("companies", "number")):
        told = store.status(source)
        row = store.read(source).agg(F.lit(source).alias("source"), F.lit(told["status"]).alias("status"), F.lit(told["generation"]).cast("long").alias("generation"), F.count("*").alias("row_count"), F.sum(key).alias("sum_ids"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    """SELECT bank, branch, account, start_date, end_date, '2024-01-31' AS date FROM boi_accounts WHERE bank IS NOT NULL""",
    "boi_accounts",
)
def registry_accounts_loaded(spark, sf_dir):
    """Restricted accounts as fixed-width files, one a bank, each with its counted header, read back."""
    rows = view(spark, sf_dir, "boi_accounts").filter("bank is not null")
    day = lambda c: F.coalesce(F.regexp_replace(c, "-", ""), F.lit("00000000"))
    padded = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    line = F.concat(F.lit("01"), padded("bank", 2), padded("branch", 3), padded("account", 11), day("start_date"), day("end_date"))
    heads = rows.groupBy("bank").agg(F.concat(F.lit("00,LIST,1,240131,x,"), (F.count("*") + 1).cast("string")).alias("value")).select("bank", F.lit(0).alias("n"), "value")
    path = fresh_path(spark, "registry-files")
    both = heads.unionByName(rows.select("bank", F.lit(1).alias("n"), line.alias("value")))
    both.repartition("bank").sortWithinPartitions("bank", "n").select(F.col("bank").alias("of"), "value").write.partitionBy("of").text(path)
    found, date = registry_files.accounts(registry_files.text_lines(spark, path))
    return found.withColumn("date", F.lit(date))


@query("SELECT CAST(number AS BIGINT) AS number, name_en, status, city || ' \"x\"' AS city FROM companies", "companies")
def registry_companies_loaded(spark, sf_dir):
    """Companies as pages of JSON answers, every seventh told again on a later page with another name; the first record counts."""
    rows = view(spark, sf_dir, "companies")
    record = lambda name: F.struct(F.col("number").cast("string").alias("no"), name.alias("english name"), F.col("status").alias("state"), F.concat(F.col("city"), F.lit(" ~x~ ")).alias("town"))
    told = rows.select((F.col("number") % 10).cast("int").alias("page"), record(F.col("name_en")).alias("r"))
    again = rows.filter(F.col("number") % 7 == 0).select(F.lit(10).alias("page"), record(F.lit("later")).alias("r"))
    every = told.unionByName(again)
    pages = every.groupBy("page").agg(F.collect_list("r").alias("records")).join(F.broadcast(every.agg(F.count("*").alias("total"))))  # one row
    path = fresh_path(spark, "company-pages")
    pages.select("page", F.lit(True).alias("success"), F.struct("total", "records").alias("result")).write.json(path)
    read = spark.read.schema("page int, success boolean, result struct<total: long, records: array<struct<no: string, `english name`: string, state: string, town: string>>>").json(path)
    return registry_files.companies(read, {"name_en": "english name", "status": "state", "city": "town"}, "no")


_CAPPED = "CASE WHEN right({0}, 1) IN ('כ', 'מ', 'נ', 'פ', 'צ') THEN 'medium' ELSE 'high' END"
_DOUBTFUL = "CASE WHEN right(a, 1) IN ('כ', 'מ', 'נ', 'פ', 'צ') OR right(b, 1) IN ('כ', 'מ', 'נ', 'פ', 'צ') THEN 'medium' ELSE 'high' END"


@query(
    f"""WITH t AS ({TURNS_SQL}), r AS (
  SELECT k, 1 AS o, 'sefach' AS section, 'id_number' AS name, id AS value, 'high' AS confidence FROM t UNION ALL SELECT k, 2, 'sefach', 'last_name_he', a, {_CAPPED.format("a")} FROM t
  UNION ALL SELECT k, 3, 'sefach', 'first_name_he', b, {_CAPPED.format("b")} FROM t
  UNION ALL SELECT k, 4, 'sefach', 'maiden_name_he', a, 'low' FROM t WHERE k % 2 = 0
  UNION ALL SELECT k, 5, 'sefach', 'marital_status', CASE WHEN k % 3 = 0 THEN 'נשוי' ELSE 'גרושה' END, CASE WHEN k % 3 = 0 THEN 'medium' ELSE 'low' END FROM t WHERE k % 2 = 0
  UNION ALL SELECT k, 6, 'sefach', 'date_of_birth', '1990-0' || CAST(1 + k % 9 AS STRING) || '-03', 'high' FROM t
  UNION ALL SELECT k, 7, 'sefach', 'address.street', a, 'high' FROM t UNION ALL SELECT k, 8, 'sefach', 'address.house_number', '7', 'high' FROM t UNION ALL SELECT k, 9, 'sefach', 'address.city', b, 'high' FROM t
  UNION ALL SELECT k, 10, 'sefach', 'spouse.last_name_he', b, 'low' FROM t WHERE k % 2 = 0 UNION ALL SELECT k, 11, 'sefach', 'spouse.first_name_he', a, 'low' FROM t WHERE k % 2 = 0
  UNION ALL SELECT k, 12, 'sefach', 'spouse.id_number', '000000018', 'low' FROM t WHERE k % 2 = 0
  UNION ALL SELECT k, 13, 'children', 'children[0].last_name_he', b, {_DOUBTFUL} FROM t UNION ALL SELECT k, 14, 'children', 'children[0].first_name_he', a, {_DOUBTFUL} FROM t
  UNION ALL SELECT k, 15, 'children', 'children[0].id_number', '123', {_DOUBTFUL} FROM t UNION ALL SELECT k, 16, 'children', 'children[0].date_of_birth', '2003-02-01', {_DOUBTFUL} FROM t
  UNION ALL SELECT k, 17, 'children', 'children[0].sex', 'M', {_DOUBTFUL} FROM t)
SELECT k AS page_id, section, CAST(row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS INT) AS pos, name, value, confidence, count(*) OVER (PARTITION BY k, section) AS n FROM r"""
)
def sheets_recorded(spark, sf_dir):
    """Blocks of appendix sheets as records, cleaned and listed: a status among former names, a street with
    its number, a child with the holder's number and a blank one, spouses on every second sheet."""
    k, a, b, number = F.col("k"), F.col("a"), F.col("b"), F.col("id")
    none = F.lit(None).cast("string")
    text = lambda *pairs: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in pairs])
    birth = F.concat(F.lit("3."), (1 + k % 9).cast("string"), F.lit(".1990"))
    holder = text(
        ("last_name_he", F.concat(F.lit(" "), a)), ("first_name_he", F.concat(b, F.lit("\u05b8 "))), ("id_number", F.concat(F.substring(number, 1, 5), F.lit("-"), F.substring(number, 6, 4))), ("date_of_birth", birth), ("place_of_birth", none), ("date_of_issue", none),
        ("street", F.concat(a, F.lit(" 7"))), ("house_number", "7"), ("entrance", ""), ("apartment", none), ("city", b), ("postal_code", none), ("confidence", "high"),
    )
    status = text(
        ("previous_last_name_he", none), ("previous_first_name_he", F.when(k % 3 == 0, "נשוי")), ("maiden_name_he", a), ("marital_status", F.when(k % 3 > 0, "גרושה")), ("nationality", none), ("father_name_he", none), ("mother_name_he", none),
        ("spouse_last_name_he", b), ("spouse_first_name_he", a), ("spouse_id_number", "0000-00018"), ("confidence", "low"),
    )
    child = lambda last, first, n, born, sex: F.struct(*[x.alias(c) for x, c in zip((last, first, n, born, sex, F.lit("high")), ("last_name_he", "first_name_he", "id_number", "date_of_birth", "sex", "confidence"))])
    children = F.array(child(a, b, number, none, none), child(b, a, F.lit("12-3"), F.lit("1.2.2003"), F.lit("זכר")), child(F.lit(""), none, F.lit("-"), none, F.lit("M")))
    blocks = turns(spark, sf_dir).select(k.alias("page_id"), holder.alias("holder"), F.when(k % 2 == 0, status).alias("status"), children.alias("children"))
    cleaned = sheet_records.cleaned(sheet_records.assembled(blocks))
    return sheet_records.rows(cleaned).join(sheet_records.section_counts(cleaned), ["page_id", "section"]).select("page_id", "section", "pos", "name", "value", "confidence", "n")


@query(
    f"""WITH t AS ({TURNS_SQL})
SELECT k AS page_id, 'amount' AS name, substr(id, 1, 4) || '.00' AS value, 'high' AS confidence FROM t WHERE k % 3 < 2
UNION ALL SELECT k, 'payee', CASE WHEN k % 3 = 1 THEN a ELSE b END, CASE WHEN k % 3 = 1 THEN 'high' ELSE 'low' END FROM t WHERE k % 3 > 0 OR k % 2 = 0
UNION ALL SELECT k, 'payee', a, 'high' FROM t WHERE k % 3 = 0 AND k % 2 = 1"""
)
def cheques_merged(spark, sf_dir):
    """Sides of cheques: a front with an endorsed back, a front whose back holds nothing, a back alone; later fronts are left out."""
    k, a, b, number = F.col("k"), F.col("a"), F.col("b"), F.col("id")
    field = lambda v, c: F.struct(v.alias("value"), F.lit(c).alias("confidence"))
    front = F.create_map(F.lit("amount"), field(F.concat(F.substring(number, 1, 4), F.lit(".00")), "high"), F.lit("payee"), field(a, "high"), F.lit("date"), field(F.lit(None).cast("string"), "high"))
    back = F.create_map(F.lit("payee"), field(F.when((k % 3 == 1) | ((k % 3 == 0) & (k % 2 == 1)), "").otherwise(b), "low"))
    later = F.create_map(F.lit("amount"), field(F.lit("1.00"), "high"))
    side = lambda kind, fields: F.struct(F.lit(kind).alias("document_type"), fields.alias("fields"))
    sides = F.when(k % 3 == 2, F.array(side("cheque_back", back))).otherwise(F.array(side("cheque", front), side("cheque_back", back), side("cheque", later), side("other", later)))
    records = turns(spark, sf_dir).select(k.alias("page_id"), F.posexplode(sides).alias("pos", "s")).select("page_id", "pos", "s.*")
    return merge.flattened(merge.merged_cheque(records))


@query(
    """SELECT event_id, epoch_us(CASE WHEN ts < date_trunc('day', ts) + INTERVAL 1 HOUR THEN date_trunc('day', ts) + INTERVAL 1 HOUR ELSE date_trunc('day', ts) + INTERVAL 25 HOUR END) AS next_us,
  CASE WHEN event_id % 4 = 0 THEN user_id END AS alerts, CASE WHEN event_id % 4 = 1 THEN 'REGISTRIES_UNAVAILABLE' END AS error, event_id % 4 < 2 AS parsed,
  CASE WHEN event_id % 3 = 0 THEN CAST(CAST(ts AS DATE) AS STRING) END AS date, CASE event_id % 3 WHEN 1 THEN 'בוטל ' || CAST(user_id AS STRING) END AS note, event_id % 3 = 1 AS cancelled FROM events"""
)
def refreshes_planned(spark, sf_dir):
    """The next run after each event, stored check summaries, and designation cells."""
    event, user = F.col("event_id"), F.col("user_id")
    item = F.concat(F.lit('{"alerts": [{"source": "companies", "by": "id", "count": '), user.cast("string"), F.lit('}], "infos": [], "checked": ["id_number"]}'))
    summary = F.when(event % 4 == 0, item).when(event % 4 == 1, '{"error": "REGISTRIES_UNAVAILABLE"}').when(event % 4 == 2, '{"error": "OTHER"}').otherwise("{not json")
    cell = F.when(event % 3 == 0, F.date_format("ts", "d/M/yyyy")).when(event % 3 == 1, F.concat(F.lit(" בוטל "), user.cast("string"))).otherwise("--/--/----")
    found = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"s": registries.parsed_summary(summary), "d": registry_files.designation(cell), "next": calendar.next_local_run(F.col("ts").cast("timestamp"), "Asia/Jerusalem", 3, 0)})
    return found.select(
        "event_id", F.unix_micros("next").alias("next_us"), F.col("s.alerts")[0]["count"].cast("long").alias("alerts"), F.col("s.error").alias("error"), F.col("s").isNotNull().alias("parsed"),
        F.col("d.date").alias("date"), F.col("d.note").alias("note"), F.col("d.cancelled").alias("cancelled"),
    )
