"""Literal values against str.find over every text and value."""

import random

import duckdb
import pytest

import __spark_entry__ as contract
from papyrine.operators import literals


def brute(texts, values):
    out = set()
    for key, text in texts:
        low = (text or "").lower()
        for needle in {v.strip().lower() for v in values if v} - {""}:
            at = low.find(needle)
            while at != -1 and key is not None:
                out.add((key, needle, text[at : at + len(needle)]))
                at = low.find(needle, at + 1)
    return out


@pytest.mark.parametrize("part", [1 << 18, 64])
def test_literals_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(literals, "PART", part)
    monkeypatch.setattr(literals, "HOT", 3)
    rng = random.Random(6)
    alphabet = "aAbB éÉ漢1\n"
    texts = [(n, "".join(rng.choices(alphabet, k=rng.randint(0, 300)))) for n in range(60)] + [(60, None), (61, ""), (None, "aaa"), (62, "aAaAaA" * 50), (62, "later row of 62")]
    values = ["a", "aa", "AAA", " b ", "", None, "aba", "é漢", "row of", "aaaaaaaaa"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(300)]
    found = literals.find_literals(spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, hash int").repartition(4), spark.createDataFrame([(v,) for v in values], "value string"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, values)


def test_ten_thousand_values(spark):
    rng = random.Random(8)
    values = [f"{rng.randrange(10**9):09d}" for _ in range(5_000)] + [f"Name{rng.randrange(10**6)} of {rng.randrange(999)}" for _ in range(5_000)]
    texts = [(n, " ".join(["filler"] * rng.randint(0, 50) + rng.sample(values, 3) + ["x" + values[0].upper()])) for n in range(200)]
    found = literals.find_literals(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(v,) for v in values], "value string"))
    assert {tuple(r) for r in found.collect()} == brute(texts, values)


def test_empty_tables(spark):
    texts, values = spark.createDataFrame([(1, "abc")], "doc_id long, text string"), spark.createDataFrame([("b",)], "value string")
    assert literals.find_literals(texts.limit(0), values).count() == 0 and literals.find_literals(texts, values.limit(0)).count() == 0


def test_query_on_odd_characters(spark, tmp_path):
    """Values that end in line ends or unusual blanks, capitals without a lower case of one character or
    with two, against DuckDB."""
    tables = {
        "documents": ("doc_id long, text string", [(1, "x ΑΣ y"), (2, "ας ασ"), (3, "İstanbul i̇stanbul"), (4, "one two\n"), (5, "one two"), (6, "\u00a0ab\u3000cd"), (7, "\tab"), (8, "istanbul"), (9, None)]),
        "benchmark": ("item_id long, text string", [(7, "ΑΣ "), (8, "_İstanbul"), (4, "....wo\nxyz"), (14, "\u3000ab........"), (77, None), (21, "\tab" + " " * 30)]),
        "conversations": ("conv_id long, turn long, text string", [(5, 0, "..two\n three"), (10, 0, "..\u00a0ab"), (10, 1, "..x"), (15, 0, "..stanbul")]),
    }
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = {tuple(r) for r in contract.queries()["literal_hits"](spark, str(tmp_path)).collect()}
    assert found == set(con.execute(contract.oracle_sql()["literal_hits"]).fetchall()) and len(found) == 9


def test_found_keeps_its_place(spark):
    texts = spark.createDataFrame([(1, "İİ Abc")], "doc_id long, text string")
    assert [r.found for r in literals.find_literals(texts, spark.createDataFrame([("abc",)], "value string")).collect()] == ["Abc"]


@pytest.mark.parametrize("limit, most", [("LONGEST", 64), ("LONGEST", 3), ("MOST_BYTES", 100), ("MOST_CELLS", 2_000), ("MOST_CELLS", 1)])
def test_held_literals_equal_brute_force(spark, monkeypatch, limit, most):
    """Values all in the automaton, some of them or none, and keys that repeat."""
    monkeypatch.setattr(literals, limit, most)
    rng = random.Random(9)
    alphabet = "aAbB éÉ漢Σİ\0\n"
    texts = [(n, "".join(rng.choices(alphabet, k=rng.randint(0, 300)))) for n in range(60)] + [(60, None), (61, ""), (None, "aaa"), (62, "aAaAaA" * 50), (62, "later row of 62, aaa"), (62, "aaa")]
    values = ["a", "aa", "AAA", " b ", "", None, "aba", "é漢", "row of", "aaaaaaaaa", "\0", "a\0", "aa" * 40] + ["".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(300)]
    held = literals.held_literals(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame([(v,) for v in values], "value string"))
    got = [tuple(r) for r in held.collect()]
    expected = {(k, n) for k, t in texts for n in {literals.lowered(v.strip()) for v in values if v} - {""} if k is not None and n in literals.lowered(t or "")}
    assert held.columns == ["doc_id", "needle"] and len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("chunk, span", [(1 << 22, 1 << 10), (64, 16), (1, 1)])
def test_automaton_at_its_seams(monkeypatch, chunk, span):
    monkeypatch.setattr(literals, "CHUNK", chunk)
    monkeypatch.setattr(literals, "SPAN", span)
    rng = random.Random(10)
    texts = ["".join(rng.choices("abcé", k=rng.choice([0, 1, 5, 200]))) for _ in range(40)]
    values = sorted({"".join(rng.choices("abcéd", k=rng.randint(1, 12))).encode() for _ in range(200)})
    rows, places = literals._Automaton(values).held(texts)
    got = list(zip(rows.tolist(), places.tolist()))
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, t in enumerate(texts) for j, v in enumerate(values) if v.decode() in t}


def test_held_literals_of_empty_tables(spark):
    texts, values = spark.createDataFrame([("x", "abc")], "name string, text string"), spark.createDataFrame([("b",)], "value string")
    held = [literals.held_literals(t, v, key="name") for t, v in ((texts, values), (texts.limit(0), values), (texts, values.limit(0)))]
    assert [[tuple(r) for r in h.collect()] for h in held] == [[("x", "b")], [], []] and all(h.columns == ["name", "needle"] for h in held)


def test_query_keeps_no_occurrences(spark, sf_dir, monkeypatch):
    """What the query writes and shuffles is bounded by values and texts, however often values occur."""
    tables, written = {}, literals.written

    def counted(df, name, path=None):
        out = written(df, name, path)
        tables[name] = out.count()
        return out

    monkeypatch.setattr(literals, "written", counted)
    hits = contract.queries()["literal_hits"](spark, sf_dir)
    assert set(tables) == {"needles", "repeated-keys"} and 0 < tables["needles"] < 1_000 and tables["repeated-keys"] == 0
    assert "HashAggregate" not in hits._jdf.queryExecution().executedPlan().toString()
