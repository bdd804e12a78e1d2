"""The posting index against the same search over all names, and with a snapshot."""

import random

import pytest
from pyspark.sql import functions as F

from papyrine.functions import names
from papyrine.operators import registries
from papyrine.operators.postings import NAME_GAP, NameIndex
from papyrine.sources.snapshots import SnapshotStore

PEOPLE = [
    (1, "Anna-Maria O'Neil", "רות כהן"), (2, "Maria Anna Neil", None), (3, "Annabel", "כהן רות"), (4, None, "כהנא"), (5, "Société Générale", None), (6, "SOCIETE GENERALE A.G.", ""), (7, "neil", "Anna"),
    (8, "Anna", "Maria"), (9, "o.k. Corral", None), (10, "ok corral o k", None),
]


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(2)
    words = ["tide", "tidal", "pier", "heron", "her", "gull"]
    more = [(n, " ".join(rng.choices(words, k=rng.randint(1, 5))), None) for n in range(100, 300)]
    table = spark.createDataFrame(PEOPLE + more, "seq int, name_en string, name_he string")
    return table.withColumn("tokens", names.name_tokens(F.col("name_en")))


@pytest.fixture(scope="module")
def index(people):
    return NameIndex.build(people.repartition(5), [F.col("tokens")], ["seq"])


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("query", ["anna", "ann", "anna maria", "maria/anna", "o.k", "neil o", "societe gen", "tide pier", "pier/her", "her her", "tid/gull heron", "zzz", "...", "pier ..."])
def test_index_equals_the_search_of_all_names(people, index, query, whole):
    words = registries.Query.parsed({"name": query}).name
    want = sorted(r.seq for r in people.filter(names.name_matches(F.col("tokens"), words, whole)).collect())
    found = index.matches(words, whole)
    rows, total = index.first_records(found, 7)
    assert total == len(want) and sorted(r.seq for r in rows.collect()) == want[:7]


def test_no_words_match_nothing(index):
    assert index.matches([]).count() == 0


def test_phrases_stay_in_one_name(spark):
    table = spark.createDataFrame(PEOPLE, "seq int, name_en string, name_he string")
    both = NameIndex.build(table, [names.name_tokens(F.col("name_en")), names.name_tokens(F.col("name_he"))], ["seq"])
    seqs = lambda words: sorted(r.seq for r in both.first_records(both.matches(words), 50)[0].collect())
    assert seqs(["anna maria"]) == [1] and seqs(["anna", "maria"]) == [1, 2, 8] and seqs(["neil", "anna"]) == [2, 7] or seqs(["neil", "anna"]) == [1, 2, 7]
    assert both.postings.agg(F.max("position")).head()[0] >= NAME_GAP


def test_tokens_prune_the_scan(index):
    terms = index.postings.filter((F.col("token") >= "ann") & (F.col("token") < "ann\U0010ffff"))
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(token,ann)" in plan and "LessThan(token,ann" in plan
    assert "GreaterThanOrEqual(token,tid)" in index.matches(["tid"])._jdf.queryExecution().executedPlan().toString()


def test_search_uses_the_index(people, index):
    query = registries.Query.parsed({"name": "tide"})
    plain = registries.search({"nbctf_individuals": people}, query)
    indexed = registries.search({"nbctf_individuals": people}, query, indexes={"nbctf_individuals": index})
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, indexed.collect()))


def test_index_is_written_with_the_snapshot(spark, people, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/r")
    build = lambda rows, path: NameIndex.build(rows, [F.col("tokens")], ["seq"], path)
    assert store.index("nbctf_individuals") is None
    store.refresh("nbctf_individuals", lambda: (people.filter("seq < 10"), None), build)
    assert store.index("nbctf_individuals").matches(["anna"]).count() == 4
    store.refresh("nbctf_individuals", lambda: (people, None), build)
    failed = store.refresh("nbctf_individuals", lambda: (people, None), lambda rows, path: 1 / 0)
    assert failed["status"] == "error" and store.status("nbctf_individuals")["generation"] == 2
    tables, indexes = store.tables(["nbctf_individuals", "companies"]), store.indexes(["nbctf_individuals", "companies"])
    found = registries.search(tables, registries.Query.parsed({"name": "tide"}), indexes=indexes)
    assert found.count() == min(50, people.filter(F.array_contains("tokens", "tide")).count())
    store.refresh("nbctf_individuals", lambda: (people.filter("seq = 1"), None), build)
    store.drop_old("nbctf_individuals")
    assert not (tmp_path / "r/nbctf_individuals/index-1").exists() and (tmp_path / "r/nbctf_individuals/index-2").exists()
