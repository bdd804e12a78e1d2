"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes a row of numeric features of its text. The model is a sum of
lookup tables: one for each feature and one for each of the chosen feature pairs.
They are learned by cyclic boosting: in every round each feature in turn gets a
shallow tree (a few splits of its bins) fitted to the current gradients, and its
leaf values are added to that feature's table; afterwards the pairs that explain
most of the remaining gradient get two-split trees over both features. Scoring adds
one table entry a feature and a pair.

The model is fitted on at most ``MAX_LABELLED`` labelled rows, those with the
smallest hash of the key. With one class only, the score is that class's rate.
Null texts count as empty; empty texts have all features zero and are scored too.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.arrays import U64, Words, code_points, is_space, mix, sums_by_text, text_blocks
from papyrine.llm.kneser_ney import scored
from papyrine.llm.quality_rules import base_counts
from papyrine.workspace import written

MAX_LABELLED = 40_000
BINS = 32
FEATURES = (
    "log_words", "mean_word", "long_words", "short_words", "symbols", "pipes", "exclamations", "upper", "digits",
    "punctuation", "repeat_words", "dup_lines", "distinct_words", "words_a_line", "words_a_sentence", "marked_words",
)


def text_features(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    parts = []
    for a, b in text_blocks(texts):
        block = texts[a:b]
        points, bounds = code_points(block)
        base = base_counts(block)
        words = Words(points, bounds, ~is_space(points))
        lengths = (words.ends - words.starts).astype(np.float64)
        n_words = np.maximum(base["n_words"].to_numpy(), 1)
        n_chars = np.maximum(np.diff(bounds) - 1, 1)

        def share(mask: np.ndarray) -> np.ndarray:
            return sums_by_text(mask, bounds) / n_chars

        def word_mean(values: np.ndarray) -> np.ndarray:
            return sums_by_text(values, words.of_text) / n_words

        ascii_points = points < 128
        other = ascii_points & (points > 32) & ~((points >= 97) & (points <= 122)) & ~((points >= 65) & (points <= 90)) & ~((points >= 48) & (points <= 57))
        symbol = np.isin(points, [ord(c) for c in "#*$%&|<>"])
        text = words.text_index()
        keyed = np.sort(mix(words.hashes() + mix(text.astype(U64) + U64(1))) >> U64(20) | (text.astype(U64) << U64(44)))
        first = np.concatenate(([True], keyed[1:] != keyed[:-1])) if len(keyed) else np.zeros(0, bool)
        distinct = np.bincount((keyed[first] >> U64(44)).astype(np.int64), minlength=b - a)
        marked = np.concatenate(([0], np.cumsum(symbol | (points == ord("!")))))
        lines = sums_by_text(points == 10, bounds)
        ends = sums_by_text((points == 46) | (points == 33) | (points == 63), bounds)
        parts.append(
            np.column_stack(
                (
                    np.log1p(base["n_words"]), word_mean(lengths), word_mean(lengths > 12), word_mean(lengths < 3), share(symbol), share(points == ord("|")),
                    share(points == ord("!")), share((points >= 65) & (points <= 90)), share((points >= 48) & (points <= 57)), share(other & ~symbol),
                    base["n_repeat_words"] / n_words, base["n_dup_lines"] / np.maximum(lines, 1), distinct / n_words, n_words / np.maximum(lines, 1),
                    n_words / np.maximum(ends, 1), word_mean((marked[words.ends] - marked[words.starts]) > 0),
                )
            )
        )
        parts[-1][base["n_words"].to_numpy() == 0] = 0
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Additive:
    """Bin edges by feature, one table a feature, and tables of feature pairs."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, features[:, j], "right") for j, e in enumerate(self.edges)])

    def scores(self, features: np.ndarray) -> np.ndarray:
        bins = self.bins(features)
        margin = np.full(len(features), self.intercept)
        for j, table in enumerate(self.tables):
            margin += table[bins[:, j]]
        for (i, j), table in self.pairs.items():
            margin += table[bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-margin))


def _leaf(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return -g / (h + l2)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, l2: float = 5.0) -> np.ndarray:
    """Leaf value of each bin of the best tree with ``leaves`` leaves, grown greedily."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                best = max(best, (gains.max(), int(at[gains.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    values = [_leaf(cg[b] - cg[a], ch[b] - ch[a], l2) for a, b in zip(cuts, cuts[1:])]
    return np.repeat(values, np.diff(cuts))


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float = 5.0) -> tuple[float, np.ndarray]:
    """(gain, values) of the best cut of both features into four rectangles."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    inner = slice(1, -1)

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, rows, columns, total = c[inner, inner], c[inner, -1:], c[-1:, inner], c[-1, -1]
        return [a, rows - a, columns - a, total - rows - columns + a]

    gs, hs = quarters(cg), quarters(ch)
    gains = sum(x**2 / (y + l2) for x, y in zip(gs, hs))
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    values = [_leaf(x[i, j], y[i, j], l2) for x, y in zip(gs, hs)]
    low, left = np.arange(g.shape[0])[:, None] <= i, np.arange(g.shape[1])[None, :] <= j
    return float(gains[i, j]), np.where(low, np.where(left, values[0], values[1]), np.where(left, values[2], values[3]))


def fit_additive(features: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, n_pairs: int = 6, pair_rounds: int = 30) -> Additive:
    """Cyclic boosting of one table a feature, then of the ``n_pairs`` strongest pairs."""
    n_features = len(FEATURES)
    if not len(y) or y.min() == y.max():
        rate_of_one = (y.sum() + 0.5) / (len(y) + 1)
        return Additive(float(np.log(rate_of_one / (1 - rate_of_one))), [np.empty(0)] * n_features, [np.zeros(1)] * n_features, {})
    edges = [np.unique(np.quantile(features[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_features)]
    model = Additive(float(np.log(y.mean() / (1 - y.mean()))), edges, [np.zeros(len(e) + 1) for e in edges], {})
    bins = model.bins(features)
    margin = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = gradients()
            step = rate * _shallow_tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)))
            table += step
            margin += step[bins[:, j]]
    sizes = [len(t) for t in model.tables]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        at, shape = bins[:, i] * sizes[j] + bins[:, j], (sizes[i], sizes[j])
        g, h = gradients()
        return np.bincount(at, g, sizes[i] * sizes[j]).reshape(shape), np.bincount(at, h, sizes[i] * sizes[j]).reshape(shape)

    able = [p for p in combinations(range(n_features), 2) if sizes[p[0]] > 1 and sizes[p[1]] > 1]
    strongest = sorted(able, key=lambda p: -_pair_tree(*grids(*p))[0])[:n_pairs]
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for i, j in strongest}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            step = rate * _pair_tree(*grids(i, j))[1]
            table += step
            margin += step[bins[:, i], bins[:, j]]
    return model


def featurize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features array<float>) of every row, from the whole text alone."""

    def features(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: batch[key], "features": list(text_features(batch["_text"].tolist()).astype(np.float32))})

    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return scored(rows, [key, "_text"], features, f"`{key}` {docs.schema[key].dataType.simpleString()}, features array<float>")


def fit(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Additive:
    """The model of the labelled rows of ``features``; rows with a null label are left out."""
    labelled = features.join(labels.select(key, F.col(label).cast("double").alias("_y")).dropna(), key)
    # a hash order is no order of content; equal keys follow by label and features
    sample = labelled.orderBy(F.xxhash64(key), key, "_y").limit(MAX_LABELLED).select("features", "_y").toArrow().to_pandas()
    matrix = np.stack(sample["features"].to_numpy()).astype(np.float64) if len(sample) else np.zeros((0, len(FEATURES)))
    return fit_additive(matrix, sample["_y"].to_numpy())


def score(features: DataFrame, model: Additive, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of ``features``."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(batch["features"].to_numpy()).astype(np.float64)
        return pd.DataFrame({key: batch[key], "score": shared.value.scores(matrix)})

    return scored(features, [key, "features"], add, f"`{key}` {features.schema[key].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, score) of every document; ``labels`` are the rows to learn from."""
    features = written(featurize(docs, key, text), "quality-features")
    return score(features, fit(features, labels, key, label), key)
