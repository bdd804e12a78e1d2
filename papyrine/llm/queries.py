"""The queries over the ``llm`` operators, with their production parameters."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import decontamination, exact_dedup, importance_resampling, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup, token_counts, url_filters, whitening
from papyrine.workspace import shared_folder

CONTEXT_TOKENS = 1024
#: Shares of the mixture's tokens by domain.
DOMAIN_TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Words of host names in the labelled URL table (fixed values).
BLOCKED_WORDS = "casino poker bets betting slots jackpot lottery pills pharmacy viagra cialis meds spam clickbait malware phishing warez torrent crack keygen porn xxx adult escort cams ads adserver track tracker popup banner affiliate loan payday replica cheap free win prize".split()
ALLOWED_WORDS = "news blog wiki docs library museum school university science history garden recipes music travel weather sports health research journal archive forum community code developer support help about maps city hotel family art books film photo design water river forest market".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_to_targets(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), DOMAIN_TARGETS)
    shares = [F.col("posterior")[i].alias(f"p_{name}") for i, name in enumerate(DOMAIN_TARGETS)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # one cache for each input folder, so figures on a new input are those of an empty cache
    cache = f"{shared_folder(spark)}/papyrine/token-cache-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(key_remainder(3) != 1)
    scores = quality_classifier.classify(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", (key_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Parts of made-up names of ordinary sites (fixed values): a consonant or two, a vowel, perhaps a consonant.
ONSETS, VOWELS, CODAS = "b c d f g h j k l m n p r s t v w z bl br cl cr dr fl fr gl gr pl pr sc sh sl sm sn sp st str sw th tr wh ch".split(), "a e i o u ai ea ee ou".split(), ["", *"n r s t l m d nd nt st ng ck sh th".split()]
ORDINARY_NAMES, PATHS_A_NAME = 4_000, 9


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table: each word alone and with others of its class in a host, and
    made-up names of two to four syllables as ordinary sites. Both classes have the same paths and domains."""
    rows = []
    for words, blocked in ((BLOCKED_WORDS, 1), (ALLOWED_WORDS, 0)):
        names = [f"{w}{joint}{words[(i + step) % len(words)]}" for i, w in enumerate(words) for step, joint in ((7, "-"), (13, "-"), (5, ""))]
        rows += _urls([*words, *names] * PATHS_A_NAME, blocked)
    rng = random.Random(0)
    made = lambda: "".join(rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(CODAS) for _ in range(rng.randint(2, 4)))
    return spark.createDataFrame(rows + _urls([made() for _ in range(ORDINARY_NAMES)], 0), "url string, blocked int")


def _urls(names: list[str], blocked: int) -> list[tuple[str, int]]:
    prefixes, domains, langs, tails = ("", "www.", "m.", "blog."), ("com", "net", "org"), ("en", "de", "fr", "es"), ("", ".html", "/", "?page=2", "#top")
    return [(f"https://{prefixes[i % 4]}{name}.example.{domains[i % 3]}/{langs[i // 3 % 4]}/{37 * i % 9973}{tails[i % 5]}", blocked) for i, name in enumerate(names)]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), labelled_urls(spark), URL_RULES)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_sentences", "n_removed", "first_docs", F.md5("text").alias("text_md5"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", key_remainder(4) == 2)
    return language_id.identify(docs, "held_out").select("doc_id", "held_out", "lang_pred", "score", "accepted", "cross_entropy")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_words=1)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest=True)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


_WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: CRC-32 (polynomial 0xEDB88320) of a word's UTF-8 bytes in DuckDB: a table of 256 rests, then a fold over the bytes.
_CRC_SQL = """rests AS (SELECT list(c ORDER BY i) AS rest FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i))),
crcs AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(h), 2), lambda p: ('0x' || substr(h, p + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, rest[xor(c & 255, b) + 1]))) % 10000 AS bucket FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM words UNION SELECT word FROM target_words)), rests)"""

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_url_filters": op4_url_filters,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": """
WITH l AS (
  SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
counts AS (SELECT source, k, count(*) AS pages FROM (SELECT DISTINCT doc_id, source, k FROM k WHERE k <> '') GROUP BY source, k),
totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
boilerplate AS (
  SELECT c.source, c.k FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.pages >= 2 AND c.pages > 0.1 * t.host_pages
), judged AS (
  SELECT k.*, b.k IS NOT NULL AS gone FROM k LEFT JOIN boilerplate b ON k.source IS NOT DISTINCT FROM b.source AND k.k = b.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_md5
FROM judged GROUP BY doc_id
""",
    "op11_importance_resampling": f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD_SQL}')) AS word FROM documents
), target_words AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD_SQL}')) AS word FROM benchmark
), {_CRC_SQL},
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM words JOIN crcs USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM target_words JOIN crcs USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000)) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight FROM documents
  LEFT JOIN (SELECT doc_id, count(*) AS n, sum(gain)::DOUBLE AS total FROM words JOIN crcs USING (word) JOIN gains USING (bucket) GROUP BY doc_id) USING (doc_id)
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weights
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
""",
    "op12_exact_dedup": r"""
WITH bare AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER same = 1 AS kept, sha256(bare) AS text_sha256
FROM bare WINDOW same AS (PARTITION BY bare ORDER BY chars DESC, doc_id)
""",
}
