"""Every operator: nulls, empty and very long texts, ties, repeated rows, empty tables and
columns whose names an operator uses itself."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papyrine.llm import (
    decontamination,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    substring_dedup,
    token_counts,
    url_filters,
)

PROSE = "The heron stood in the shallow water and waited for the tide to turn. Nobody on the pier had seen it arrive. By noon it was gone again, and the gulls had come back. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _key long, _row string, rep long, run string, n_lines string, n_removed string, rate string, host string"


def rows(*items):
    return [(i, t, lang, source, None if t is None else len(t), "x", 7, "r", 1, "u", "n", "m", "q", "h") for i, t, lang, source in items]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        rows(
            (1, PROSE * 3, "en", "a"),
            (2, PROSE * 3, "en", "a"),
            (2, PROSE * 3, "en", "a"),
            (3, None, "en", "a"),
            (4, "", None, "a"),
            (5, "12 34", "en", None),
            (6, PROSE * 3000, "en", "b"),
            (7, "un deux trois quatre cinq six sept huit neuf dix onze douze", "fr", "b"),
            (None, PROSE, "en", "b"),
            (8, PROSE, None, None),
        ),
        SCHEMA,
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "clean"), (2, 1, 0, "clean"), (7, 0, 1, "low"), (None, 1, 0, None), (4, None, None, None)], "doc_id long, quality int, toxic int, domain string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Nobody on the pier had seen it arrive. By noon it was gone again"), (2, None), (3, ""), (4, "the tide")], "item_id long, text string")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_mixing(spark, docs, empty, labels):
    targets = {"clean": 0.7, "low": 0.3}
    found = mixing.mix_to_targets(docs, labels, targets).collect()
    assert len(found) == docs.count() and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in found)
    assert {r.rate for r in found if r.doc_id in (3, 4)} == {1.0}
    same = {r.rate for r in found if r.doc_id in (1, 2)}
    assert len(same) == 1
    assert mixing.mix_to_targets(empty, labels, targets).count() == 0
    assert mixing.mix_to_targets(docs, labels.limit(0), targets).count() == docs.count()


def test_token_counts(spark, docs, empty, tmp_path):
    import public_tokenizers

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    for _ in range(2):  # a cold and a warm cache
        found = token_counts.count_tokens(docs, path, cache)
        assert found.count() == docs.count()
        assert by_id(found)[3].n_tokens == 0 and by_id(found)[4].n_bytes == 0 and by_id(found)[6].n_tokens > 90_000
    assert token_counts.count_tokens(empty, path, f"file://{tmp_path}/other").count() == 0


def test_quality_classifier(spark, docs, empty, labels):
    found = quality_classifier.classify(docs, labels)
    assert found.count() == docs.count()
    assert found.filter("score is null or score < 0 or score > 1").isEmpty()
    assert {round(r.score, 6) for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(empty, labels).count() == 0


def test_url_filters(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/70?x#y"), (5, "https://sub.x.net/de/1"), (6, "x://h#f"), (7, "https://x.example.net/de/8" + "9" * 5000), (None, "http://a.org/es/")],
        "page_id long, url string",
    )
    labelled = spark.createDataFrame([("http://casino.test/a", 1), ("http://news.test/a", 0), (None, 1), ("http://x.test", None)], "url string, blocked int")
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    found = by_id(url_filters.judge(pages, labelled, rules), "page_id")
    assert (found[1].host, found[1].path, found[3].host, found[3].verdict) == ("", "", "", "allow")
    assert (found[4].host, found[4].path, found[4].rule, found[4].verdict) == ("a.example.com", "/en/70", "example.com/en/7", "allow")
    assert (found[5].rule, found[6].host, found[6].path) == ("net/de/", "h", "")
    assert found[7].rule == "example.net/de/8" and found[7].verdict == "block" and found[None].rule == "org/es/"
    assert url_filters.judge(pages.limit(0), labelled, rules).count() == 0
    assert url_filters.judge(pages, labelled.limit(0), []).filter("verdict <> 'allow'").isEmpty()


def test_quality_rules(spark, docs, empty):
    found = by_id(quality_rules.judge(docs))
    assert found[3].n_words == 0 and found[3].base_failed and not found[3].kept
    assert found[6].n_repeat_words == found[6].n_words and found[6].base_failed
    assert quality_rules.judge(docs).count() == docs.count()
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_substring_dedup(spark, docs, empty):
    found = by_id(substring_dedup.remove_repeats(docs))
    assert found[3].text is None and found[3].n_removed == 0
    assert found[2].text == "" and found[2].first_docs == [1]
    assert found[1].text == PROSE and found[6].text == ""
    assert found[None].text == PROSE and "_row" in found[1].asDict() and found[1].rep == 1
    assert substring_dedup.remove_repeats(docs).count() == docs.count()
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_near_dedup(spark, docs, empty):
    found = by_id(near_dedup.near_duplicates(docs))
    assert set(found) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert found[2].class_id == 1 and found[1].n_links == 0 and found[3].class_id == 3 and found[4].class_id == 4
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.count() == docs.count() - 2 and kept.columns == docs.columns


def test_line_dedup(spark, docs, empty):
    lines = spark.createDataFrame(rows(*[(i, f"own line {i}\n menu \n\nown end {i}\r", "en", None) for i in range(20)], (None, None, None, None)), SCHEMA)
    found = by_id(line_dedup.drop_boilerplate(lines))
    assert found[3].text == "own line 3\n\nown end 3\r" and (found[3].n_lines, found[3].n_dropped) == (4, 1)
    assert found[None].text is None and found[None].n_dropped is None
    assert line_dedup.drop_boilerplate(docs).count() == docs.count()
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_language_id(spark, docs, empty):
    flagged = docs.withColumn("held_out", F.lit(False))
    found = by_id(language_id.identify(flagged, "held_out"))
    assert found[3].lang_pred == found[4].lang_pred == found[5].lang_pred == "und" and found[5].score == 0
    assert found[7].lang_pred == "fr" and found[6].lang_pred == "en" and 0 < found[6].score <= 1
    assert language_id.identify(empty.withColumn("held_out", F.lit(False)), "held_out").count() == 0
    untaught = language_id.identify(docs.withColumn("held_out", F.lit(True)), "held_out")
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_decontamination(spark, docs, empty, benchmark):
    found = decontamination.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.edit_distance) for r in found} == {(i, 1, 0) for i in (1, 2, 6, 8, None)}
    assert decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontamination.keep_clean(docs, benchmark).columns == docs.columns


def test_pipeline_stages_take_empty_tables(spark, empty, sf_dir):
    bare = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, bare, sf_dir).count() == 0
