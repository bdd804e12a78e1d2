"""The URL model: n-grams against plain Python, and verdicts on hosts that its table does not hold."""

import numpy as np
from pyspark.sql import functions as F

from papyrine.llm import queries, url_filters


def test_ngrams_of_a_batch_are_those_of_each_url():
    hosts = ["a.example.com", "", "x", "ünï.test", "a.example.com", "b"]
    paths = ["/en/7", "", "", "/ü/漢", "/en/7", "/aaaaaaa"]
    index, row, size = url_filters._sparse(hosts, paths)
    for i, (h, p) in enumerate(zip(hosts, paths)):
        alone, _, n = url_filters._sparse([h], [p])
        assert np.array_equal(index[row == i], alone) and size[i] == n[0]
        grams = {(part, t[k : k + n]) for part, t in ((0, f"^{h}$".encode() if h or p else b""), (1, p.encode())) for n in (3, 4, 5) for k in range(len(t) - n + 1)}
        assert (row == i).sum() in (len(grams), len(grams) - 1)  # two may share a place
    assert not (row == 1).any()


def test_verdicts_outside_the_rules(spark):
    found = queries.op4_url_filters(spark, "/root/testdata/sf0.1").filter("rule is null")
    blocked = found.groupBy("host").agg(F.count_if(F.col("verdict") == "block").alias("blocked"), F.count("*").alias("n")).collect()
    bad = {w for word in ("casino", "bets", "ads", "pills", "adult", "spam") for w in [r.host for r in blocked] if word in w}
    assert {r.host for r in blocked if r.blocked} <= bad
    assert sum(r.blocked for r in blocked if r.host in bad) >= 0.8 * sum(r.n for r in blocked if r.host in bad)


def test_repeated_rows_and_clashing_columns(spark):
    labelled = queries.labelled_urls(spark)
    pages = spark.createDataFrame([(1, "https://WWW.Casino-poker.example.net/de/17?b", "h", 1), (1, "https://WWW.Casino-poker.example.net/de/17?b", "h", 1), (2, None, "h", 2), (3, "no scheme", None, None), (None, "://", "h", 3)], "page_id long, url string, host string, score int")
    rows = sorted(map(tuple, url_filters.judge(pages, labelled, []).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    assert rows == sorted([(1, "www.casino-poker.example.net", "/de/17", None, "block")] * 2 + [(2, "", "", None, "allow"), (3, "", "", None, "allow"), (None, "", "", None, "allow")], key=repr)
