"""Quality rules: word and line counts, then perplexity bands of an n-gram model.

The base rules are plain counts. Documents that pass them are judged by a modified
Kneser-Ney character n-gram model of their language, counted by Spark over all
distinct texts (:mod:`papyrine.llm.kneser_ney`). A language's band of log perplexity
runs from its lower to its upper fence, quartile -/+ ``fence`` interquartile ranges
of all its distinct texts (by a 64-bit digest), so copies do not narrow it, and a range
counts as ``LEAST_RANGE`` at least; documents outside the band are rejected. The mean over a short text
scatters more, so below ``STEADY_WORDS`` words the fences stand wider by the root of
the ratio. Characters, not words, are the units: symbol runs, shouted or tabular text move
character perplexity as much as word perplexity, and scripts without blanks have no words.

Null texts count as empty: zero words, so the base rules reject them. A null
language is the language ``und``. Equal documents get equal verdicts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.arrays import U64, Words, code_points, is_space, mix, text_blocks
from papyrine.llm.kneser_ney import count_ngrams, judged, own_log_table
from papyrine.workspace import written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Interquartile ranges between a quartile and the end of the band.
FENCE = 3.0
#: The narrowest interquartile range of log perplexity; languages of ordinary texts have 0.03.
LEAST_RANGE = 0.02
#: Words from which a text's mean is taken as steady.
STEADY_WORDS = 300


def _duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    repeated = 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            repeated += line in seen
            seen.add(line)
    return repeated


def _repeat_words(words: Words) -> np.ndarray:
    """Words of each text that lie in a three-word window found twice or more in it."""
    n_texts = len(words.of_text) - 1
    hashes, text = words.hashes(), words.text_index()
    if len(hashes) < 3:
        return np.zeros(n_texts, np.int64)
    windows = mix(hashes[:-2] * U64(3) + mix(hashes[1:-1]) * U64(5) + mix(mix(hashes[2:])) * U64(7))
    windows = mix(windows + mix(text[:-2].astype(U64) + U64(1)))
    whole = text[:-2] == text[2:]
    order = np.sort(windows[whole])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(len(hashes), bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, windows), len(twice) - 1)
        hit = whole & (twice[at] == windows)
        for k in range(3):
            covered[k : len(covered) - 2 + k] |= hit
    return np.add.reduceat(np.concatenate((covered, [False])).astype(np.int64), np.minimum(words.of_text[:-1], len(covered))) * (np.diff(words.of_text) > 0)


def base_counts(texts: list[str]) -> pd.DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    parts = []
    symbol = np.zeros(128, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    for a, b in text_blocks(texts):
        points, bounds = code_points(texts[a:b])
        words = Words(points, bounds, ~is_space(points))
        lengths = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
        marks = np.concatenate(([0], np.cumsum(symbol[np.minimum(points, 127)])))
        parts.append(
            pd.DataFrame(
                {
                    "n_words": np.diff(words.of_text),
                    "word_chars": np.diff(lengths[words.of_text]),
                    "n_symbols": np.diff(marks[bounds]),
                    "n_dup_lines": [_duplicate_lines(t) for t in texts[a:b]],
                    "n_repeat_words": _repeat_words(words),
                }
            ).astype("int64")
        )
    return pd.concat(parts, ignore_index=True)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, lang, digest of the text, the base counts, log_perplexity) of every document, under the
    model of its language, which counts each of its texts once; rows with a null key all count."""

    def judge(part: pd.DataFrame, texts: list[str], sums: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        counts = base_counts(texts)
        perplexity = np.where(n > 0, -sums[:, 0] / np.maximum(n, 1), np.nan).round(6)
        return part.assign(**{c: counts[c].to_numpy() for c in COUNTS}, log_perplexity=perplexity)

    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    rows = rows.withColumn("_digest", F.xxhash64("_text"))
    # the digest and another hash: a text is left out where an equal one is counted, and only there
    rows = rows.withColumn("_other", F.hash("_text", F.lit(7)))
    rows = rows.withColumn("_mark", F.xxhash64(key, "lang", "_digest", "_other"))
    narrow = written(rows.select(F.col(key).alias("_key"), "lang", "_digest", "_other", "_mark"), "text-marks")
    same = ["lang", "_digest", "_other"]
    repeated = narrow.groupBy(*same).agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    copies = written(narrow.join(written(repeated, "repeated-texts"), same).filter("_key > _first").select("_mark"), "copies")
    # eight bytes a copy: Spark broadcasts them where they are few, and shuffles the texts once more where they are not
    once = rows.join(copies, "_mark", "left_anti")
    top = written(count_ngrams(once, "lang", "_text", "all"), "ngram-counts")
    logs = written(own_log_table(top, modified=True), "ngram-logs")
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, lang string, _digest long, {', '.join(f'{c} long' for c in COUNTS)}, log_perplexity double"
    return judged(rows, [key, "lang", "_digest"], "_text", "lang", "all", logs, judge, schema)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fence: float = FENCE) -> DataFrame:
    """(key, base counts, log_perplexity, base_failed, kept) of every document."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = written(measure(docs, key, text, lang).withColumn("base_failed", failed), "quality-rules")
    quartiles = (
        measured.filter(~F.col("base_failed"))
        .groupBy("lang", "_digest")
        .agg(F.min("log_perplexity").alias("log_perplexity"))
        .groupBy("lang")
        .agg(F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias("q"))
        .select(
            "lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"),
            (fence * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_RANGE))).alias("room"),
        )
    )
    room = F.col("room") * F.sqrt(F.greatest(F.lit(1.0), STEADY_WORDS / F.greatest(F.col("n_words"), F.lit(1))))
    kept = ~F.col("base_failed") & F.col("log_perplexity").between(F.col("low") - room, F.col("high") + room)
    # one row a language; a written table, so Spark knows its size
    return measured.join(written(quartiles, "perplexity-bands"), "lang", "left").withColumn("kept", F.coalesce(kept, F.lit(False))).drop("low", "high", "room", "lang", "_digest")


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the documents that the rules reject; rows with a null key stay."""
    bad = written(judge(docs, key, text, lang).filter(~F.col("kept")).select(key), "rejected")
    return docs.join(bad, key, "left_anti").select(*docs.columns)
