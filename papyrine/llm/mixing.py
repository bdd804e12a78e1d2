"""Mixing documents to target token shares with soft domain membership.

A classifier fitted on a labelled table gives every document a probability for each
domain (posterior). Rates ``r >= 0``, one a document, are fitted so that the expected
tokens of each domain, ``sum r * tokens * posterior``, come as near to the targets as
least squares can: projected gradient descent from ``r = 1``, with every domain's
error weighed by the inverse of its own curvature and Nesterov's momentum. Distances
between rates are weighed by tokens, so a document's step depends on its posterior
alone and a few very long documents do not slow the others. The step length is the
inverse of the largest eigenvalue of the domains' curvature; the fit ends when the
targets are met, when a step moves nothing any more or, where no rates meet them, after
``STEPS`` steps; a warning reports what is missing. A step needs a few numbers a domain from the whole corpus, which
Spark sums; a task replays the steps for its documents from those few numbers, so no
rates are stored between steps. Expected tokens of all domains together stay those of
the corpus.

The first steps weigh the domains' errors by the inverse of the whole curvature matrix of
the documents that have a rate above zero: such a step meets the targets at once unless it
takes rates to zero, so a few steps mostly end the fit. A step that brings the totals no nearer
is taken back and halved; where that leads nowhere, the slower steps above take over.

Features of the classifier are the distinct lower-case words of a text and the
character pairs with a symbol, hashed into ``2**BITS`` places. It is fitted on at most
``MAX_LABELLED`` labelled rows, those with the smallest hash of the key. Only telling
places count: those of ``LEAST_ROWS`` rows or more whose chi-square statistic with a
domain exceeds ``TELLING``; the many words of one text or two would drown the others.

Null texts count as empty; without words a document has no tokens, the posteriors of
the labelled rows' shares, and rate 1. Without labelled rows all domains are equally
likely. Rows with the same text get the same rate.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.arrays import U64, Words, code_points, is_space, mix, text_blocks
from papyrine.llm.kneser_ney import scored
from papyrine.workspace import written

BITS = 18
MAX_LABELLED = 6_000
LEAST_ROWS = 5
#: Chi-square, one degree of freedom: chance passes it for less than one place in a million.
TELLING = 25.0
#: The error of a share of tokens that ends the rate fit, the share of tokens that a settled fit
#: still moves in a step, and the steps after which rates that are still drawing nearer to targets out
#: of reach are taken as they are.
TOLERANCE, STILL, STEPS = 1e-4, 1e-7, 200
#: Passes of the first steps, the part of the largest curvature below which a direction counts as none,
#: and the part of a step below which halving it leads nowhere.
QUICK_STEPS, LEAST_CURVATURE, LEAST_SHARE = 40, 1e-6, 1e-3


def hashed_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first feature of each text and the end, features, words of each text)."""
    parts, sizes, n_words = [], [], []
    for a, b in text_blocks(texts):
        points, bounds = code_points([t.lower() for t in texts[a:b]])
        words = Words(points, bounds, ~is_space(points))
        # the word without marks at its ends says more than the word with them
        letters = Words(points, bounds, (points >= 97) & (points <= 122) | (points >= 0xC0))
        symbol = np.flatnonzero((points[:-1] < 127) & (points[:-1] > 32) & ~((points[:-1] >= 97) & (points[:-1] <= 122)))
        pair_text = np.searchsorted(bounds, symbol, "right") - 1
        pairs = mix(points[symbol].astype(U64) << U64(32) | points[symbol + 1].astype(U64))
        text = np.concatenate((letters.text_index(), pair_text)).astype(U64)
        place = np.concatenate((letters.hashes(), pairs)) >> U64(64 - BITS)
        keys = np.unique((text << U64(BITS)) | place)
        parts.append((keys & U64((1 << BITS) - 1)).astype(np.int64))
        sizes.append(np.bincount((keys >> U64(BITS)).astype(np.int64), minlength=b - a))
        n_words.append(np.diff(words.of_text))
    if not parts:
        return np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.concatenate(parts), np.concatenate(n_words)


def _margins(weights: np.ndarray, intercept: np.ndarray, starts: np.ndarray, features: np.ndarray) -> np.ndarray:
    size = np.diff(starts)
    row = np.repeat(np.arange(len(size)), size)
    scale = 1 / np.sqrt(np.maximum(size, 1))
    sums = np.column_stack([np.bincount(row, weights[features, k], len(size)) for k in range(weights.shape[1])])
    return intercept + sums * scale[:, None]


def _telling(places: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each place, whether rows with it differ from the others in their domains."""
    n, size = len(y), 1 << BITS
    seen = np.bincount(places, minlength=size).astype(np.float64)
    out = np.zeros(size, bool)
    for own in y.T:
        expected, spread = seen * own.mean(), seen * (1 - seen / n) * own.mean() * (1 - own.mean())
        excess = np.maximum(np.abs(np.bincount(places, own[rows], size) - expected) - 0.5, 0)
        out |= excess**2 > TELLING * spread
    return out & (seen >= LEAST_ROWS)


def _kept(telling: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` and ``places`` of the telling places alone."""
    keep = telling[places]
    return np.concatenate(([0], np.cumsum(keep)))[starts], places[keep]


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", domain: str = "domain", steps: int = 150, rate: float = 4.0, l2: float = 2e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(telling places, weights, intercept) of a softmax regression, from the labelled rows of ``docs``."""
    known = labels.select(key, F.col(domain).alias("_domain")).filter(F.col("_domain").isin(domains))
    chosen = known.orderBy(F.xxhash64(key), key, "_domain").limit(MAX_LABELLED)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), key)

    def features(batch: pd.DataFrame) -> pd.DataFrame:
        starts, places, _ = hashed_features(batch["_text"].tolist())
        return pd.DataFrame({"key": batch[key].astype(str), "domain": batch["_domain"], "places": np.split(places.astype(np.int32), starts[1:-1])})

    sample = scored(rows, [key, "_domain", "_text"], features, "key string, domain string, places array<int>").toArrow().to_pandas().sort_values(["key", "domain"])
    y = np.array([[d == name for name in domains] for d in sample["domain"]], float).reshape(-1, len(domains))
    prior = np.log((y.sum(axis=0) + 1) / (len(y) + len(domains)))
    weights, intercept = np.zeros((1 << BITS, len(domains))), prior
    if not len(y):
        return np.zeros(1 << BITS, bool), weights, intercept
    size = np.array([len(p) for p in sample["places"]])
    places = np.concatenate([*sample["places"], np.empty(0, np.int64)]).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(size)))
    telling = _telling(places, np.repeat(np.arange(len(y)), size), y)
    starts, places = _kept(telling, starts, places)
    size = np.diff(starts)
    row, scale = np.repeat(np.arange(len(y)), size), 1 / np.sqrt(np.maximum(size, 1))
    # adaptive steps: rare telling words get as far as frequent ones
    seen = np.full_like(weights, 1e-8)
    for _ in range(steps):
        error = (_softmax(_margins(weights, intercept, starts, places)) - y) / len(y)
        for k in range(len(domains)):
            g = np.bincount(places, (error[:, k] * scale)[row], len(weights)) + l2 * weights[:, k]
            seen[:, k] += g * g
            weights[:, k] -= rate / 10 * g / np.sqrt(seen[:, k])
        intercept = intercept - rate * error.sum(axis=0)
    return telling, weights, intercept


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", domain: str = "domain") -> DataFrame:
    """(key, n_tokens, posterior array<double>) of every document; tokens are words."""
    return _scored(docs, _scorer(docs, labels, domains, key, text, domain), key, text)


def _scorer(docs: DataFrame, labels: DataFrame, domains: list[str], key: str, text: str, domain: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to (posteriors, tokens), for tasks."""
    telling, weights, intercept = fit_domains(docs, labels, domains, key, text, domain)
    shared = docs.sparkSession.sparkContext.broadcast((telling, weights.astype(np.float32), intercept))

    def score(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        starts, places, n_words = hashed_features(texts)
        telling, weights, intercept = shared.value
        return _softmax(_margins(weights, intercept, *_kept(telling, starts, places))), n_words

    return score


def _scored(docs: DataFrame, scorer: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], key: str, text: str) -> DataFrame:
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        p, n_words = scorer(batch["_text"].tolist())
        return pd.DataFrame({key: batch[key], "n_tokens": n_words, "posterior": list(p)})

    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return scored(rows, [key, "_text"], score, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, posterior array<double>")


def _replayed(shares: np.ndarray, history: list[tuple[float, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates, point of the next gradient, point before the last step) after the steps of
    ``history``: (momentum, gradient multipliers by domain)."""
    rate = point = before = np.ones(len(shares))
    for momentum, multipliers in history:
        new = np.maximum(point - shares @ multipliers, 0)
        rate, point, before = new, new + momentum * (new - rate), point
    return rate, point, before


def _domain_sums(measured: DataFrame, history: list[tuple[float, np.ndarray]], scale: float, k: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Expected load of each domain at the rates and at the next gradient's point, the share of the
    corpus's tokens that the last step moved, and the curvature of the documents with a rate, over
    all documents."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * k + 1 + k * k)
        for batch in batches:
            shares, size = _shares(batch)
            total += _batch_sums(shares, size / scale, history)
        yield pd.DataFrame({"place": range(len(total)), "load": total})

    sums = measured.select("n_tokens", "posterior").mapInPandas(partial, "place int, load double")
    rows = sums.groupBy("place").agg(F.sum("load").alias("load")).orderBy("place").collect()
    found = np.array([r["load"] for r in rows])
    return found[:k], found[k : 2 * k], float(found[2 * k]), found[2 * k + 1 :].reshape(k, k)


def _batch_sums(shares: np.ndarray, size: np.ndarray, history: list[tuple[float, np.ndarray]]) -> np.ndarray:
    rate, point, before = _replayed(shares, history)
    curvature = (shares * (size * (rate > 0))[:, None]).T @ shares
    return np.concatenate(((rate * size) @ shares, (point * size) @ shares, [np.abs(rate - before) @ size], curvature.ravel()))


def _shares(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, 0 where a document has no tokens; tokens)."""
    tokens = batch["n_tokens"].to_numpy(np.float64)
    return np.stack(batch["posterior"].to_numpy()) * (tokens > 0)[:, None], tokens


def fit_rates(measured: DataFrame, targets: np.ndarray) -> tuple[list[tuple[float, np.ndarray]], float]:
    """(steps, largest error of a domain's share of tokens): what :func:`with_rates` replays.

    Stops where the targets are met, where a step moves nothing any more, or after ``STEPS`` plain steps
    towards targets out of reach; what the totals then lack is the second result."""
    k = len(targets)
    tokens, p = F.col("n_tokens").cast("double"), [F.col("posterior")[i] for i in range(k)]
    pairs = [F.sum(tokens * p[i] * p[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]
    totals = measured.agg(F.sum(tokens).alias("tokens"), *pairs).first()
    scale = totals["tokens"] or 0.0
    if not scale:
        return [], 0.0
    curvature = np.array([[totals[f"c{i}_{j}"] / scale for j in range(k)] for i in range(k)])
    own = np.diag(curvature)
    weight = np.where(own > 0, 1 / np.where(own > 0, own, 1), 0.0)
    # the inverse of the largest eigenvalue: no step can be too bold
    step = 1 / np.linalg.eigvalsh(np.sqrt(weight)[:, None] * curvature * np.sqrt(weight))[-1]
    sums = lambda history: _domain_sums(measured, history, scale, k)
    history, residual = _quick_steps(sums, targets, weight)
    if residual < TOLERANCE:
        return history, residual
    return _plain_steps(sums, targets, weight, step)


def _quick_steps(sums: Callable[[list], tuple], targets: np.ndarray, weight: np.ndarray) -> tuple[list[tuple[float, np.ndarray]], float]:
    """(steps, residual) of projected gradient with errors weighed by the inverse curvature of the documents
    with a rate, until the targets are met or ``QUICK_STEPS`` passes are over."""
    history: list[tuple[float, np.ndarray]] = []
    loads, _, _, curvature = sums(history)
    best, share = loads - targets, 1.0
    for _ in range(QUICK_STEPS):
        if np.abs(best).max() < TOLERANCE:
            break
        own, axes = np.linalg.eigh(curvature)
        kept = own > LEAST_CURVATURE * max(own[-1], 0.0)
        multipliers = axes[:, kept] @ ((axes[:, kept].T @ best) / own[kept])
        tried = [*history, (0.0, share * multipliers)]
        loads, _, moved, new_curvature = sums(tried)
        error = loads - targets
        if weight @ error**2 < weight @ best**2:
            history, best, curvature, share = tried, error, new_curvature, min(1.0, 2 * share)
        elif moved < STILL or share < LEAST_SHARE:
            break
        else:
            share /= 2
    return history, float(np.abs(best).max())


def _plain_steps(sums: Callable[[list], tuple], targets: np.ndarray, weight: np.ndarray, step: float) -> tuple[list[tuple[float, np.ndarray]], float]:
    """(steps, residual) of accelerated projected gradient with each domain's error weighed alone."""
    history: list[tuple[float, np.ndarray]] = []
    previous, run = np.inf, 0
    while True:
        rated, pointed, moved, _ = sums(history)
        error = rated - targets
        residual = float(np.abs(error).max())
        if residual < TOLERANCE or run and moved < STILL or len(history) == STEPS:
            return history, residual
        loss = float(weight @ error**2)
        if loss > previous and run:  # overshot: momentum starts anew from the rates
            history[-1], run = (0.0, history[-1][1]), 0
            pointed = rated
        previous = loss
        run += 1
        history.append((run / (run + 3), step * weight * (pointed - targets)))


def _fitted(measured: DataFrame, targets: dict[str, float]) -> list[tuple[float, np.ndarray]]:
    history, residual = fit_rates(measured, np.array(list(targets.values())) / sum(targets.values()))
    if residual >= TOLERANCE:
        warnings.warn(f"no rates meet the targets: the nearest found leave a domain's share of tokens off by {residual:.2g}", stacklevel=3)
    return history


def with_rates(measured: DataFrame, targets: dict[str, float], key: str = "doc_id") -> DataFrame:
    """``measured`` (from :func:`posteriors`, domains in the order of ``targets``) with ``rate``."""
    history = _fitted(measured, targets)

    def rates(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(rate=_replayed(_shares(batch)[0], history)[0])

    columns = [key, "n_tokens", "posterior"]
    return scored(measured, columns, rates, f"`{key}` {measured.schema[key].dataType.simpleString()}, n_tokens long, posterior array<double>, rate double")


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain") -> DataFrame:
    """(key, n_tokens, posterior, rate) of every document, for token shares ``targets``."""
    measured = written(posteriors(docs, labels, list(targets), key, text, domain), "posteriors")
    return with_rates(measured, targets, key)


def rated_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``rate``, which take the place of columns so named. Every row gets
    the rate of its own text, whatever its key; texts are read again instead of being shuffled."""
    scorer = _scorer(docs, labels, list(targets), key, text, domain)
    history = _fitted(written(_scored(docs, scorer, key, text), "posteriors"), targets)

    @F.pandas_udf("n_tokens long, rate double")
    def rated(texts: pd.Series) -> pd.DataFrame:
        p, n_words = scorer(texts.tolist())
        return pd.DataFrame({"n_tokens": n_words, "rate": _replayed(p * (n_words > 0)[:, None], history)[0]})

    own = [c for c in docs.columns if c not in ("n_tokens", "rate")]
    rows = docs.select(F.struct(*own).alias("_row"))  # the table's names cannot clash with those used here
    rows = rows.withColumn("_rated", rated(F.coalesce(F.col("_row")[text], F.lit(""))))
    return rows.select(*[F.col("_row")[c].alias(c) for c in own], "_rated.n_tokens", "_rated.rate")
