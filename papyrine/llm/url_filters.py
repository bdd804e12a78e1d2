"""URL filters: explicit host and path rules, else logistic regression on n-grams.

Features are the character 3- to 5-grams of ``^host$`` and of ``path``, each hashed
into ``2**BITS`` weights; the two parts have hashes of their own. The model is fitted
on a small labelled URL table (at most ``MAX_LABELLED`` rows, checked) by full-batch
gradient descent with L2 on the driver; weights (256 KB) go to the tasks. One labelled
row in ``HELD_OUT`` is left out of the fit, and a URL is blocked above the score that at
most ``FALSE_BLOCKS`` of the ordinary rows left out exceed (0.5 at least).

Null URLs and URLs without ``://`` have an empty host and path; the model judges
the empty features by its intercept, held at or below zero, so they are allowed.
Equal URLs get equal verdicts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.arrays import mix

BITS = 16
MAX_LABELLED = 100_000
HELD_OUT = 5
FALSE_BLOCKS = 1e-3
_U64 = np.uint64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path up to ``?`` or ``#``; empty where there is none."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(found, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(found, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. A rule is (verdict, host,
    path); it fits its host and all subdomains where the URL's path starts with its path."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    choices = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in longest_first
    ]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*choices, none)


def _grams(texts: list[str], part: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, weight index) of the 3- to 5-grams of all texts, by bytes."""
    data = [t.encode("utf-8", "replace") for t in texts]
    points = np.frombuffer(b"".join(data), np.uint8).astype(_U64) + _U64(1)
    row = np.repeat(np.arange(len(data)), [len(d) for d in data])
    rows, places = [], []
    for n in (3, 4, 5):
        if len(points) < n:
            continue
        code = np.full(len(points) - n + 1, _U64(16 * part + n))
        for i in range(n):
            code = code * _U64(257) + points[i : len(points) - n + 1 + i]
        inside = row[: len(code)] == row[n - 1 :]
        rows.append(row[: len(code)][inside])
        places.append(mix(code[inside]) >> _U64(64 - BITS))
    return np.concatenate([*rows, np.empty(0, np.int64)]), np.concatenate([*places, np.empty(0, _U64)]).astype(np.int64)


def _sparse(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight indexes, row of each, indexes of each row) of the distinct n-grams of every URL; an empty
    host and path have none."""
    host = _grams([f"^{h}$" if h or p else "" for h, p in zip(hosts, paths)], 0)
    path = _grams(paths, 1)
    keys = np.unique((np.concatenate((host[0], path[0])) << BITS) | np.concatenate((host[1], path[1])))
    row = keys >> BITS
    return keys & ((1 << BITS) - 1), row, np.maximum(np.bincount(row, minlength=len(hosts)), 1)


def _margins(weights: np.ndarray, intercept: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    index, row, size = _sparse(hosts, paths)
    return intercept + np.bincount(row, weights[index], len(hosts)) / np.sqrt(size)


def fit(labelled: DataFrame, url: str = "url", label: str = "blocked", steps: int = 600, rate: float = 8.0, l2: float = 1e-5) -> tuple[np.ndarray, float, float]:
    """(weights, intercept, score above which a URL is blocked) from a table of URLs and 0/1 labels; rows
    with a null are left out and both classes weigh the same."""
    host, path = host_and_path(F.col(url))
    left_out = F.pmod(F.xxhash64("host", "path"), F.lit(HELD_OUT)) == 0
    rows = labelled.select(host.alias("host"), path.alias("path"), F.col(label).cast("double").alias("y")).dropna().withColumn("left_out", left_out)
    sample = rows.orderBy("host", "path", "y").limit(MAX_LABELLED + 1).toArrow().to_pandas()
    if len(sample) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs; sample them first")
    weights, intercept = np.zeros(1 << BITS), 0.0
    if sample["y"].nunique() < 2:
        return weights, -1.0, 0.5
    known = sample[~sample["left_out"]]
    if known["y"].nunique() < 2:
        known = sample  # too few to leave any out
    index, row, size = _sparse(known["host"].tolist(), known["path"].tolist())
    scale, y = 1 / np.sqrt(size), known["y"].to_numpy()
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(intercept + np.bincount(row, weights[index], len(y)) * scale))) - y) * weight
        weights -= rate * (np.bincount(index, (error * scale)[row], len(weights)) + l2 * weights)
        intercept = min(0.0, intercept - rate * error.sum())
    ordinary = sample[sample["left_out"] & (sample["y"] == 0)]
    scores = np.sort(_scores(weights, intercept, ordinary["host"].tolist(), ordinary["path"].tolist()))
    allowed = math.floor(FALSE_BLOCKS * len(scores))
    return weights, intercept, max(0.5, float(scores[-1 - allowed])) if len(scores) else 0.5


def _scores(weights: np.ndarray, intercept: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    return 1 / (1 + np.exp(-_margins(weights, intercept, hosts, paths)))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row; score is the model's probability of block."""
    weights, intercept, least = fit(labelled)
    shared = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(_scores(shared.value, intercept, hosts.tolist(), paths.tolist()))

    host, path = host_and_path(F.col(url))
    parts = pages.select(key, host.alias("host"), path.alias("path")).withColumn("score", score("host", "path"))
    fit_rule = parts.withColumn("_r", matching_rule(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("score") > least, "block").otherwise("allow")
    return fit_rule.select(key, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", learned).alias("verdict"), "score")
