"""Benchmark decontamination under word edit distance.

A document holds an item of ``n`` words where one of its windows of ``n`` words turns
into the item by at most ``EDITS * n`` word insertions, deletions and substitutions,
or by none where the item has under ``EDITED_WORDS`` words. Words are runs of letters
and digits in lower case; in scripts without blanks every character is one.

1. Seeds: ``e`` edits leave a run of ``ceil((n - e) / (e + 1))`` words of an item as it
   was, so windows without such a run are no matches; the others start where a shared
   run says, up to ``e`` words earlier or later. Windows with fewer than ``n - e`` words
   of the item are no matches either.
2. CGK embedding: a random walk over a window repeats or passes on each word by a hash
   of step and word, which maps edit distance to Hamming distance. Windows whose
   sampled places of the embedding agree with an item's in one of several repetitions
   are verified first. The number of repetitions is fitted for each class of item lengths:
   random edits of the items, as many as are allowed, are to be found at the rate ``RECALL``;
   where ``MAX_REPETITIONS`` do not reach it, more windows are left to step 3.
3. Verification by the exact edit distance. It goes on to every window that no repetition
   found, unless the words it lacks alone make it farther than one that was found, so
   what is reported does not depend on the embedding.

Items go to the tasks in blocks of about ``BLOCK_WORDS`` words; each block is one pass over the
documents, without a shuffle. In a block, items stand by classes of length, powers of two, so
a long one does not widen the arrays of the others. Items under ``least_words`` words are left out (with 1,
those without any word), as are null items; null texts hold nothing. Equal items are reported each. Of several windows the closest
counts, then the first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.arrays import U64, Words, code_points, mix, text_blocks
from papyrine.workspace import written

EDITS = 0.2
RECALL = 0.99
#: Items of fewer words must be held word for word.
EDITED_WORDS = 8
#: Words of an item from which it is searched, unless the caller says otherwise (the queries search every item).
MIN_ITEM_WORDS = 8
#: Words, padded, of the items that are searched in one pass.
BLOCK_WORDS = 1 << 22
WALKS = 4
#: Places of the embedding that must agree in one repetition.
SAMPLED = 6
MAX_REPETITIONS = 96
#: Pairs of a shared run and an item, and words of windows, that are handled at once.
PAIRS, CELLS = 500_000, 1 << 21
#: Blocks of scripts without blanks: Thai, Lao, Burmese, Khmer, kana and ideographs.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(p).isalnum() for p in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _alone() -> np.ndarray:
    """Whether each code point is a word of its own: letters, digits and vowel signs of ``UNSPACED``."""
    out = np.zeros(0x110000, bool)
    for low, high in UNSPACED:
        out[low : high + 1] = [unicodedata.category(chr(p))[0] in "LMN" for p in range(low, high + 1)]
    return out


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the end)."""
    points, bounds = code_points([t.lower() for t in texts])
    alone = _alone()[points]
    inside = _letters()[points] | alone
    words = Words(points, bounds, inside)
    if alone.any():
        joined = inside[1:] & inside[:-1] & ~alone[1:] & ~alone[:-1]
        words.starts = np.flatnonzero(inside & ~np.concatenate(([False], joined)))
        words.ends = np.flatnonzero(inside & ~np.concatenate((joined, [False]))) + 1
        words.of_text = np.searchsorted(words.starts, bounds)
    return words.hashes(), words.of_text


def _runs(hashes: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(max(len(hashes) - q + 1, 0), U64)
    for k in range(q):
        out = mix(out * U64(3) + hashes[k : k + len(out)])
    return out


def allowed_edits(n: np.ndarray) -> np.ndarray:
    return np.where(n < EDITED_WORDS, 0, np.floor(EDITS * n + 1e-9)).astype(np.int64)


def cgk(windows: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """Embeddings (3 columns a word) of word windows, 0 beyond their ends."""
    steps = 3 * windows.shape[1]
    padded = np.concatenate((windows, np.zeros((len(windows), 1), U64)), axis=1)
    at, rows = np.zeros(len(windows), np.int64), np.arange(len(windows))
    out = np.empty((len(windows), steps), U64)
    for t in range(steps):
        word = padded[rows, at]
        out[:, t] = word
        coin = (word ^ U64((walk * 1000 + t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * U64(0xD6E8FEB86659FD93)
        at = np.minimum(at + (coin >> U64(63)).astype(np.int64), lengths)
    return out


def _samples(embedded: np.ndarray, lengths: np.ndarray, repetition: int) -> np.ndarray:
    """One hash of the sampled places; places are shares of the item's own length."""
    shares = np.random.default_rng(repetition).random(SAMPLED)
    out = mix(lengths.astype(U64) + U64(repetition * 1_000_003))
    rows = np.arange(len(embedded))
    for share in shares:
        out = mix(out * U64(3) + embedded[rows, (share * 3 * lengths).astype(np.int64)])
    return out


def edit_distances(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of equally long word rows."""
    width = left.shape[1]
    row = np.broadcast_to(np.arange(width + 1), (len(left), width + 1)).copy()
    out = np.zeros(len(left), np.int64)
    for i in range(1, width + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        change = row[:, :-1] + (left[:, i - 1 : i] != right)
        np.minimum(change, row[:, 1:] + 1, out=new[:, 1:])
        # an insertion costs one more than its left neighbour: a running minimum
        ramp = np.arange(width + 1)
        new = np.minimum.accumulate(new - ramp, axis=1) + ramp
        row = new
        done = lengths == i
        out[done] = row[done, i]
    return out


def _matrix(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    columns = np.arange(lengths.max() if len(lengths) else 1)
    index = np.minimum(starts[:, None] + columns, len(hashes) - 1)
    return np.where(columns < lengths[:, None], hashes[index], U64(0))


@dataclass
class Items:
    """One block of items: words, seed runs, sampled hashes by repetition, and marks at the
    places of every item's words."""

    ids: list
    words: np.ndarray
    lengths: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    samples: np.ndarray
    marks: np.ndarray


def _places(words: np.ndarray, item: np.ndarray, n_places: int) -> np.ndarray:
    """Place of a word of an item among the marks. Two words may meet in one: a window then
    seems to have more of the item's words than it has, never fewer."""
    keys = (words ^ mix(item.astype(U64) + U64(1))) * U64(0xD6E8FEB86659FD93)
    return (keys >> U64(65 - n_places.bit_length())).astype(np.int64)


def _hashes(words: np.ndarray, lengths: np.ndarray, repetitions: int) -> Iterator[tuple[int, np.ndarray]]:
    for walk in range(WALKS):
        if walk < repetitions:
            embedded = cgk(words, lengths, walk)
            for repetition in range(walk, repetitions, WALKS):
                yield repetition, _samples(embedded, lengths, repetition)


def _fitted_repetitions(words: np.ndarray, lengths: np.ndarray) -> int:
    """Repetitions that find randomly edited items at the rate ``RECALL``."""
    rng = np.random.default_rng(7)
    # fewer draws where verifying one takes long
    draws = int(np.clip(10 * CELLS // words.shape[1] ** 2, 4, 400))
    pick = rng.integers(0, len(words), draws)
    edited, n = np.zeros((draws, words.shape[1]), U64), lengths[pick]
    for i, p in enumerate(pick):
        row = list(words[p, : lengths[p]])
        for _ in range(int(allowed_edits(lengths[p : p + 1])[0])):
            at, kind = rng.integers(0, len(row)), rng.integers(0, 3)
            row[at : at + int(kind > 0)] = [U64(rng.integers(1, 1 << 62))] * int(kind < 2)
        row = (row + [U64(rng.integers(1, 1 << 62)) for _ in range(len(words[p]))])[: lengths[p]]
        edited[i, : lengths[p]] = row
    near = edit_distances(edited, words[pick], n) <= allowed_edits(n)
    if not near.any():
        return MAX_REPETITIONS
    met = np.zeros((MAX_REPETITIONS, draws), bool)
    originals = dict(_hashes(words[pick], n, MAX_REPETITIONS))
    for repetition, own in _hashes(edited, n, MAX_REPETITIONS):
        met[repetition] = own == originals[repetition]
    reached = np.maximum.accumulate(met, axis=0)[:, near].mean(axis=1)
    return int(np.argmax(reached >= RECALL)) + 1 if reached[-1] >= RECALL else MAX_REPETITIONS


def prepare(ids: list, texts: list[str], least_words: int = MIN_ITEM_WORDS) -> Items | None:
    hashes, bounds = _words(texts)
    lengths = np.diff(bounds)
    kept = lengths >= max(least_words, 1)
    if not kept.any():
        return None
    ids = [i for i, k in zip(ids, kept) if k]
    starts, lengths = bounds[:-1][kept], lengths[kept]
    words = _matrix(hashes, starts, lengths)
    edits = allowed_edits(lengths)
    sizes = -(-(lengths - edits) // (edits + 1))
    seeds = {}
    for q in np.unique(sizes):
        runs, items, offsets = [], [], []
        for i in np.flatnonzero(sizes == q):
            own = _runs(words[i, : lengths[i]], int(q))
            runs.append(own)
            items.append(np.full(len(own), i))
            offsets.append(np.arange(len(own)))
        runs_ = np.concatenate(runs)
        order = np.argsort(runs_, kind="stable")
        seeds[int(q)] = runs_[order], np.concatenate(items)[order], np.concatenate(offsets)[order]
    samples = np.stack([h for _, h in sorted(_hashes(words, lengths, _fitted_repetitions(words, lengths)), key=lambda x: x[0])])
    marks = np.zeros(1 << max(16, 4 + int(lengths.sum()).bit_length()), bool)
    item, at = np.nonzero(np.arange(words.shape[1]) < lengths[:, None])
    marks[_places(words[item, at], item, len(marks))] = True
    return Items(ids, words, lengths, seeds, samples, marks)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, value) of every value of the ranges ``low .. high - 1``."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]


def _slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices whose ``sizes`` add up to about ``limit``."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield slice(a, b)
        a = b


def _last(*columns: np.ndarray) -> np.ndarray:
    """Index of the last row of each group: equal in all ``columns`` but the last, which orders it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[-1:] = True
    for column in columns[:-1]:
        new[:-1] |= column[order[1:]] != column[order[:-1]]
    return order[new]


def _seeded(hashes: np.ndarray, bounds: np.ndarray, items: Items, found_runs: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, first and last start of the windows around a shared run) of a block of texts."""
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for q, (runs, own, offsets) in items.seeds.items():
        found = found_runs[q] = found_runs[q] if q in found_runs else _runs(hashes, q)
        if not len(found):
            continue
        inside = text_of[: len(found)] == text_of[q - 1 :]
        filter_ = np.zeros(1 << 20, bool)
        filter_[runs >> U64(44)] = True
        at = np.flatnonzero(filter_[found >> U64(44)] & inside)
        low, high = np.searchsorted(runs, found[at], "left"), np.searchsorted(runs, found[at], "right")
        for part in _slices(high - low, PAIRS):
            of, seed = _ranges(low[part], high[part])
            item, begin, text = own[seed], at[part][of] - offsets[seed], text_of[at[part][of]]
            n = items.lengths[item]
            edits = allowed_edits(n)
            # a window has the item's size; a shorter text is one window with nothing beyond its end
            most = np.maximum(bounds[text + 1] - n, bounds[text])
            first, last = np.clip(begin - edits, bounds[text], most), np.clip(begin + edits, bounds[text], most)
            kept = _last(item, first, last)
            item, first, last = item[kept], first[kept], last[kept]
            # without edits the first window of a text is the closest
            word_for_word = edits[kept] == 0
            again = np.zeros(len(item), bool)
            again[1:] = word_for_word[1:] & (item[1:] == item[:-1]) & (text_of[first[1:]] == text_of[first[:-1]])
            yield item[~again], first[~again], last[~again]


def _windows(hashes: np.ndarray, bounds: np.ndarray, items: Items, found_runs: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, least distance) of the distinct windows of a block of texts that have a run
    and enough words of an item."""
    parts = [np.empty((3, 0), np.int64)]
    for item, first, last in _seeded(hashes, bounds, items, found_runs):
        n = items.lengths[item]
        wide = np.argsort(last - first + n, kind="stable")
        item, first, last, n = item[wide], first[wide], last[wide], n[wide]
        end = bounds[np.searchsorted(bounds, first, "right")]
        for part in _slices(last - first + n, CELLS):
            i, a, size = item[part], first[part], (last - first + n)[part]
            at = a[:, None] + np.arange(size[-1])
            of, column = np.nonzero((at < end[part][:, None]) & (np.arange(size[-1]) < size[:, None]))
            held = np.zeros((len(i), size[-1] + 1), np.int32)
            held[of, column + 1] = items.marks[_places(hashes[a[of] + column], i[of], len(items.marks))]
            held = np.cumsum(held, axis=1, dtype=np.int32)
            of, start = _ranges(a, last[part] + 1)
            n_ = n[part][of]
            least = n_ - (held[of, start - a[of] + n_] - held[of, start - a[of]])
            near = least <= allowed_edits(n_)
            parts.append(np.stack((i[of], start, least))[:, near])
    item, start, least = np.concatenate(parts, axis=1)
    kept = _last(item, start, least)
    return item[kept], start[kept], least[kept]


def find(texts: list[str], *groups: Items) -> pd.DataFrame:
    """(text, item, distance, start): every item held by every text; items are numbered through the groups."""
    parts = [pd.DataFrame({"text": [], "item": [], "distance": [], "start": []}).astype("int64")]
    for a, b in text_blocks(texts):
        hashes, bounds = _words(texts[a:b])
        found_runs: dict[int, np.ndarray] = {}
        before = 0
        for items in groups:
            found = _found_in_block(hashes, bounds, items, found_runs)
            parts.append(found.assign(text=found["text"] + a, item=found["item"] + before))
            before += len(items.ids)
    return pd.concat(parts).sort_values(["text", "item", "distance", "start"]).drop_duplicates(["text", "item"])


def _found_in_block(hashes: np.ndarray, bounds: np.ndarray, items: Items, found_runs: dict[int, np.ndarray]) -> pd.DataFrame:
    item, start, least = _windows(hashes, bounds, items, found_runs)
    order = np.argsort(items.lengths[item], kind="stable")
    item, start, least = item[order], start[order], least[order]
    text, n = np.searchsorted(bounds, start, "right") - 1, items.lengths[item]
    _, pair = np.unique(item * len(bounds) + text, return_inverse=True)
    closest, distance = allowed_edits(n[np.unique(pair, return_index=True)[1]]), np.full(len(item), -1)

    def words(part: np.ndarray) -> np.ndarray:
        inside = np.arange(n[part].max()) < (bounds[text[part] + 1] - start[part])[:, None]
        return np.where(inside, _matrix(hashes, start[part], n[part]), U64(0))

    def verify(rows: np.ndarray) -> None:
        for part in _slices(n[rows], CELLS):
            own = rows[part]
            left = words(own)
            distance[own] = edit_distances(left, items.words[item[own], : left.shape[1]], n[own])
            np.minimum.at(closest, pair[own], distance[own])

    met = np.zeros(len(item), bool)
    for part in _slices(n, CELLS // 4):
        for repetition, own in _hashes(words(np.arange(len(n))[part]), n[part], len(items.samples)):
            met[part] |= own == items.samples[repetition, item[part]]
    verify(np.flatnonzero(met))
    verify(np.flatnonzero(~met & (least <= closest[pair])))
    good = (distance >= 0) & (distance <= allowed_edits(n))
    return pd.DataFrame({"text": text[good], "item": item[good], "distance": distance[good], "start": (start - bounds[text])[good]})


def _blocks(benchmark: DataFrame, item: str, item_text: str, least_words: int) -> Iterator[list[Items]]:
    """Groups of items, one a class of lengths, with about ``BLOCK_WORDS`` words together."""
    classes: dict[int, tuple[list, list[str]]] = {}
    held = 0
    for row in benchmark.select(item, item_text).dropna().orderBy(item, item_text).toLocalIterator():
        length = len(_words([row[1]])[0])
        ids, texts = classes.setdefault(length.bit_length(), ([], []))
        ids.append(row[0])
        texts.append(row[1])
        held += 1 << length.bit_length()
        if held >= BLOCK_WORDS:
            yield _prepared(classes, least_words)
            classes, held = {}, 0
    yield _prepared(classes, least_words)


def _prepared(classes: dict[int, tuple[list, list[str]]], least_words: int) -> list[Items]:
    return [x for _, (ids, texts) in sorted(classes.items()) if (x := prepare(ids, texts, least_words))]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least_words: int = MIN_ITEM_WORDS) -> DataFrame:
    """(key, item, n_item_words, edit_distance, similarity, start_word): every item held by
    every document."""
    schema = (
        f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {benchmark.schema[item].dataType.simpleString()}, "
        "n_item_words long, edit_distance long, similarity double, start_word long"
    )
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_text is not null")

    def search(block: list[Items]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            groups = shared.value
            ids, lengths = [i for x in groups for i in x.ids], np.concatenate([x.lengths for x in groups])
            for batch in batches:
                found = find(batch["_text"].tolist(), *groups)
                n = lengths[found["item"].to_numpy(np.int64)]
                yield pd.DataFrame(
                    {
                        key: batch["_key"].to_numpy()[found["text"].to_numpy(np.int64)],
                        item: [ids[i] for i in found["item"]],
                        "n_item_words": n,
                        "edit_distance": found["distance"].to_numpy(),
                        "similarity": 1 - found["distance"].to_numpy() / n,
                        "start_word": found["start"].to_numpy(),
                    }
                )

        return rows.mapInPandas(of, schema)

    found = [search(block) for block in _blocks(benchmark, item, item_text, least_words) if block]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = MIN_ITEM_WORDS) -> DataFrame:
    """``docs`` without the documents that hold an item of ``benchmark``."""
    held = written(contaminated(docs, benchmark, key, text, least_words=least_words).select(key).distinct(), "contaminated")
    return docs.join(held, key, "left_anti").select(*docs.columns)
