"""Substring deduplication by sliding sentence spans.

A text is cut into sentences after ``.``, ``!`` and ``?`` and at line ends. Long sentences are cut
further: of every ``MAX_WORDS`` consecutive words of a sentence, after the one with the smallest
hash. Where a cut falls is thus a matter of the ``MAX_WORDS`` words around it, wherever the passage
stands. Spans are runs of at least ``RUN`` consecutive sentences and ``MIN_WORDS`` words: from every
sentence on the shortest, and up to every sentence the shortest. All but the first and last
``MAX_WORDS - 1`` words of a repeated passage are cut alike, at one word in ``MAX_WORDS`` at least,
so any 51 words hold three sentences in common and lose 23 words or more; at most 14 stay at
each end, none where the passage is made of whole sentences. Spans are hashed (words in lower
case) and joined globally: the one in the document with the smallest key, and there the first, is
the first; sentences under any other occurrence are removed, the rest of the text is kept
character by character.

Null and short texts have no span and stay as they are. Rows with a null key neither lose
sentences nor count as first. Rows that share a key are taken as one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.arrays import U64, Words, code_points, is_space, mix, text_blocks
from papyrine.llm.hot_keys import hot_keys, split_join
from papyrine.workspace import written

RUN = 3
MAX_WORDS = 8
MIN_WORDS = 12
#: A span's sentences fit into four bits: it has RUN of them, or under MIN_WORDS words before the last.
SPAN_BITS = 4
#: Span rows that a task hands on at once.
EMIT_ROWS = 200_000


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower-case code points, one for one."""
    return np.fromiter((ord(chr(p).lower()[0]) for p in range(0x110000)), np.uint32, 0x110000)


@dataclass
class Pieces:
    """Sentences of a block of texts: first word, word after the last, text, first character."""

    words: Words
    hashes: np.ndarray
    first: np.ndarray
    end: np.ndarray
    text: np.ndarray
    #: first sentence of each text, and the end
    of_text: np.ndarray


def _cut_long(hashes: np.ndarray, breaks: np.ndarray) -> None:
    """Adds to the sentence ends ``breaks`` the word with the smallest hash (the last of equal
    ones) of every ``MAX_WORDS`` consecutive words of a sentence."""
    m = len(hashes) - MAX_WORDS + 1
    if m <= 0:
        return
    sentence = np.concatenate(([0], np.cumsum(breaks[:-1])))
    least, at = hashes[:m].copy(), np.zeros(m, np.int64)
    for k in range(1, MAX_WORDS):
        other = hashes[k : k + m]
        smaller = other <= least
        least[smaller], at[smaller] = other[smaller], k
    whole = sentence[:m] == sentence[MAX_WORDS - 1 :]
    breaks[(np.arange(m) + at)[whole]] = True


def pieces(texts: list[str]) -> tuple[Pieces, np.ndarray]:
    """(sentences, first character of each text and the end) of a block of texts."""
    points, bounds = code_points(texts)
    words = Words(_lower()[points], bounds, ~is_space(points))
    hashes, text = words.hashes(), words.text_index()
    n = len(hashes)
    if not n:
        empty = np.empty(0, np.int64)
        return Pieces(words, hashes, empty, empty, empty, np.zeros(len(texts) + 1, np.int64)), bounds
    last = points[words.ends - 1]
    lines = np.cumsum(points == 10)
    breaks = (last == 46) | (last == 33) | (last == 63)
    breaks[:-1] |= (lines[words.starts[1:] - 1] > lines[words.ends[:-1] - 1]) | (text[1:] != text[:-1])
    _cut_long(hashes, breaks)
    first = np.flatnonzero(np.concatenate(([True], breaks[:-1])))
    own = text[first]
    return Pieces(words, hashes, first, np.append(first[1:], n), own, np.searchsorted(own, np.arange(len(texts) + 1))), bounds


def _spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, span hash, first sentence and number of sentences in one, whether the text
    had the span before) of every span."""
    p, _ = pieces(texts)
    n = len(p.first)
    i = np.arange(n)
    forward = np.maximum(i + RUN - 1, np.searchsorted(p.end, p.first + MIN_WORDS))
    backward = np.minimum(i - RUN + 1, np.searchsorted(p.first, p.end - MIN_WORDS, "right") - 1)
    start, stop = np.concatenate((i, backward)), np.concatenate((forward, i))
    inside = (start >= 0) & (stop < n)
    start, stop = start[inside], stop[inside]
    inside = p.text[start] == p.text[stop]
    both = np.unique(start[inside] << SPAN_BITS | stop[inside] - start[inside])
    start, count = both >> SPAN_BITS, (both & (1 << SPAN_BITS) - 1) + 1
    up, down = Words.powers(len(p.hashes) + 1)
    sums = np.concatenate(([U64(0)], np.cumsum(p.hashes * up[: len(p.hashes)], dtype=U64)))
    a, b = p.first[start], p.end[start + count - 1]
    run = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64))
    text = p.text[start]
    keyed = mix(run + mix(text.astype(U64) + U64(1)))
    order = np.argsort(keyed, kind="stable")
    again = np.zeros(len(order), bool)
    again[order[1:]] = keyed[order[1:]] == keyed[order[:-1]]
    return text, run.view(np.int64), (start - p.of_text[text]) << SPAN_BITS | count, again


def spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run, span, again) of every span of every text."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts = batch[key].to_numpy(), batch["_text"].tolist()
            for i, j in text_blocks(texts):
                index, run, span, again = _spans(texts[i:j])
                for a in range(0, len(index), EMIT_ROWS):
                    part = slice(a, a + EMIT_ROWS)
                    yield pd.DataFrame({key: keys[i + index[part]], "run": run[part], "span": span[part], "again": again[part]})

    rows = docs.select(key, F.col(text).alias("_text")).dropna()
    return rows.mapInPandas(of, f"`{key}` {docs.schema[key].dataType.simpleString()}, run long, span long, again boolean")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans, first_docs): for every document with a non-first span, those spans and the
    documents that hold the first occurrences."""
    every = written(spans(docs, key, text), "spans")
    repeated = written(every.groupBy("run").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).filter("_n > 1"), "repeated-runs")
    hot = hot_keys(repeated, "run", "_n", every.count())
    later = split_join(every, repeated.select("run", "_first"), "run", hot).filter(F.col("again") | (F.col(key) > F.col("_first")))
    # the spans of one document: no larger than its text
    return later.groupBy(key).agg(F.collect_set("span").alias("spans"), F.sort_array(F.collect_set("_first")).alias("first_docs"))


def kept_text(text: str, found: np.ndarray | None) -> tuple[str, int, int]:
    """(text without the sentences of the spans, sentences, removed sentences)."""
    p, _ = pieces([text])
    n = len(p.first)
    if found is None or not len(found):
        return text, n, 0
    gone = np.zeros(n + 1, np.int64)
    begins, counts = np.asarray(found) >> SPAN_BITS, np.asarray(found) & (1 << SPAN_BITS) - 1
    np.add.at(gone, np.minimum(begins, n), 1)
    np.add.at(gone, np.minimum(begins + counts, n), -1)
    lost = np.cumsum(gone[:-1]) > 0
    edges = [0, *p.words.starts[p.first[1:]], len(text)]
    return "".join(text[a:b] for a, b, out in zip(edges, edges[1:], lost) if not out), n, int(lost.sum())


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated sentences cut out of ``text``, and the columns ``n_sentences``,
    ``n_removed`` and ``first_docs`` (empty where nothing was removed), which take the place
    of columns so named."""
    found = written(repeated_spans(docs, key, text), "repeated-spans").toDF("_key", "_spans", "_first")

    def cut(lists: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = [(None, 0, 0) if t is None else kept_text(t, s) for s, t in zip(lists, texts)]
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])

    cut_udf = F.pandas_udf(cut, "text string, n_sentences long, n_removed long")
    own = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "first_docs")]
    rows = docs.select(F.struct(*own).alias("_row"))  # the table's names cannot clash with those used here
    joined = rows.join(found, F.col("_row")[key] == F.col("_key"), "left").withColumn("_cut", cut_udf("_spans", F.col("_row")[text]))
    empty = F.array().cast(f"array<{docs.schema[key].dataType.simpleString()}>")
    return joined.select(
        *[F.col("_cut.text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in own],
        "_cut.n_sentences", "_cut.n_removed", F.coalesce("_first", empty).alias("first_docs"),
    )
