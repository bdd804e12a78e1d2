"""Language identification by interpolated Kneser-Ney character models.

One character model per language is counted over the training rows
(:mod:`papyrine.llm.kneser_ney`). A text gets the language whose model has the
lowest cross-entropy per character; ties go to the first name in order. Rejection is
calibrated on training rows that no model has counted: one text in ``CALIBRATION``, by a hash
of the text, so that copies stay together, but never a language's only text. A language's
limit is a high quantile of the cross-entropy that those of its texts have which get that
language; a text above the limit of its best language has ``accepted`` false. A language
without such rows rejects none.

Training rows are those with a text and a language outside the held-out ones. Null texts and
texts without a letter are ``und`` with score 0 and not accepted. Rows with a null key and
rows that share one are judged like all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.kneser_ney import count_ngrams, judged, model_of
from papyrine.workspace import written

UNDETERMINED = "und"
#: Characters whose evidence the score counts at most; longer texts are no surer.
SCORE_CHARS = 40
CALIBRATION = 10


def _roles(docs: DataFrame, held_out: str, key: str, text: str, lang: str) -> DataFrame:
    """(key, held_out, _text, _lang, _counts): the languages of training rows, and whether a model counts them."""
    rows = docs.select(key, held_out, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.when(~F.col(held_out) & F.col(text).isNotNull(), F.col(lang)).alias("_lang"))
    digest = F.xxhash64("_text")
    # one row a language; a written table, so Spark knows its size and need not shuffle the texts
    first = written(rows.filter("_lang is not null").groupBy("_lang").agg(F.min(digest).alias("_first")), "first-texts")
    counts = F.col("_lang").isNotNull() & ((F.pmod(digest, F.lit(CALIBRATION)) != 0) | (digest == F.col("_first")))
    return rows.join(first, "_lang", "left").withColumn("_counts", F.coalesce(counts, F.lit(False))).drop("_first")


def predict(rows: DataFrame, logs: DataFrame, langs: list[str], carried: list[str]) -> DataFrame:
    """(carried columns, lang_pred, score, cross_entropy) of every row; cross-entropy in nats a
    character, NaN where the language is undetermined. ``logs`` has a column a language."""

    def judge(part: pd.DataFrame, texts: list[str], sums: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        # other characters are one class; runs of them say nothing about the language
        lettered = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts)) & bool(langs)
        pred, score, entropy = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.full(len(texts), np.nan)
        if lettered.any():
            bits = -sums[lettered] / n[lettered][:, None]
            best, every = bits.argmin(axis=1), np.arange(len(bits))
            evidence = np.exp(-(bits - bits.min(axis=1, keepdims=True)) * np.minimum(n[lettered], SCORE_CHARS)[:, None])
            pred[lettered] = np.array(langs, object)[best]
            score[lettered] = (evidence / evidence.sum(axis=1, keepdims=True))[every, best]
            entropy[lettered] = bits[every, best]
        return part.assign(lang_pred=pred, score=score, cross_entropy=entropy)

    columns = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return judged(rows, carried, "_text", None, "letters", logs, judge, f"{columns}, lang_pred string, score double, cross_entropy double")


def reject(predicted: DataFrame, share: float = 0.999, slack: float = 1.05) -> DataFrame:
    """Add ``accepted``: cross-entropy within ``slack`` times the ``share`` quantile of the
    uncounted training rows that got their own language."""
    limits = (
        predicted.filter((F.col("_lang") == F.col("lang_pred")) & ~F.col("_counts"))
        .groupBy("lang_pred")
        .agg((slack * F.percentile_approx("cross_entropy", share, 10_000)).alias("_limit"))
    )
    limits = written(limits, "entropy-limits")
    accepted = (F.col("lang_pred") != UNDETERMINED) & F.coalesce(F.col("cross_entropy") <= F.col("_limit"), F.lit(True))
    return predicted.join(limits, "lang_pred", "left").withColumn("accepted", accepted).drop("_limit")


def identify(docs: DataFrame, held_out: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, cross_entropy, accepted): learn from the rows where
    ``held_out`` is false and predict every row of ``docs``."""
    rows = _roles(docs, held_out, key, text, lang)
    # n-grams of texts that no model counts have a null group
    grams = written(count_ngrams(rows.withColumn("_grp", F.when(F.col("_counts"), F.col("_lang"))), "_grp", "_text", "letters"), "ngram-counts")
    langs = sorted(r["grp"] for r in grams.select("grp").distinct().collect() if r["grp"] is not None)  # one name a language
    model = model_of(grams, "letters", modified=False)
    needed = grams.select("gram").distinct().select("gram", F.explode(F.array(*[F.lit(x) for x in langs]).cast("array<string>")).alias("grp"))
    by_lang = [F.max(F.when(F.col("grp") == x, F.col("log_p"))).alias(f"log_{i}") for i, x in enumerate(langs)]
    logs = model.log_table(needed).groupBy("gram").agg(*by_lang) if langs else grams.select("gram")
    predicted = written(predict(rows, written(logs, "ngram-logs"), langs, [key, held_out, "_lang", "_counts"]), "languages")
    return reject(predicted).drop("_lang", "_counts")
