"""Occurrences of a table of literal values in all texts, in one pass over the texts.

Values are compared in lower case, character by character (see :func:`lowered`), without white space
at their ends.

:func:`held_literals` tells which texts hold which values. Tasks carry the texts through an automaton of
the values (Aho-Corasick, over bytes), many places at once, so a value costs nothing where it does not
occur and each is named once a text; no occurrence is written or shuffled. Values that one table does not
hold, the longest ones, go the way of :func:`find_literals`.

:func:`find_literals` tells their spellings too. A value of n characters is
filed under the hash of its first 2^k characters, 2^k <= n < 2^(k+1), so a text is hashed once for
each k that occurs, whatever the number of values. Hashes that no value has are dropped where they
are made, by a bitmap of at most ``MOST_BITS`` bits; the others carry their window of the text to a
join with the values, which compares all characters. Values with more than one in ``HOT`` of the
windows are met by broadcast, so a value in very many texts is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.workspace import written

HOT = 1_000
#: Bits of the bitmap: 16 a value, within these bounds (2 to 16 MB).
LEAST_BITS, MOST_BITS = 24, 27
_U64 = np.uint64
#: Multiplier of the rolling hash (fixed value, odd) and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters hashed at once; a longer text is taken in overlapping parts.
PART = 1 << 18
#: The automaton takes values of at most so many bytes, so many bytes of them in all, and a table of so many
#: cells of 4 bytes. Others go by join.
LONGEST, MOST_BYTES, MOST_CELLS = 64, 1 << 20, 1 << 25
#: Bytes of texts looked through at once, in lanes of so many bytes, and rows of an Arrow batch of what is found.
CHUNK, SPAN, ROWS = 1 << 22, 1 << 10, 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, _U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(_U64)
    x ^= x >> _U64(31)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(29)
    return x


def window_hashes(text: str, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size the hashes of all windows of so many characters, as long integers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sums = np.concatenate(([_U64(0)], np.cumsum(_mixed(points + 1) * _powers(_BASE, len(points))[: len(points)], dtype=_U64)))
    down = _powers(_INVERSE, len(points))
    return {n: _mixed((sums[n:] - sums[:-n]) * down[: len(sums) - n]).view(np.int64) for n in sizes if n <= len(points)}


def _class(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def lowered(text: str) -> str:
    """Every character's own lower case, so that no character depends on those around it and the text
    keeps its length: a capital sigma at a word's end and a dotted capital I are like any other."""
    return text.replace("Σ", "σ").replace("İ", "i").lower()


def needles(values: DataFrame, value: str = "value", blanks: str | None = None) -> DataFrame:
    """(needle, size, hash) of the distinct values that are not blank, written; ``blanks`` are the
    characters cut off their ends, all white space if null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = sorted({lowered(v.strip(blanks)) for v in batch["v"] if v is not None} - {""})
            sizes = [_class(len(v)) for v in plain]
            yield pd.DataFrame({"needle": plain, "size": np.array(sizes, np.int32), "hash": np.array([window_hashes(v[:s], [s])[s][0] for v, s in zip(plain, sizes)], np.int64)})

    return written(values.select(F.col(value).alias("v")).mapInPandas(run, "needle string, size int, hash long").distinct(), "needles")


def _bitmap(filed: DataFrame) -> tuple[np.ndarray, int]:
    n = filed.count()
    bits = min(max(LEAST_BITS, (16 * n).bit_length()), MOST_BITS)
    word = F.shiftrightunsigned("hash", 64 - bits + 6).cast("int")
    bit = F.shiftrightunsigned("hash", 64 - bits).bitwiseAND(F.lit(63)).cast("int")
    words = filed.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for row in words.collect():  # at most 2^(MOST_BITS - 6) words
        out[row.w] = row.b
    return out.view(_U64), bits


def _windows(texts: DataFrame, filed: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash, low, own): windows of the texts that may begin with a needle, in lower case and as written."""
    sizes = sorted(r.size for r in filed.select("size").distinct().collect())  # at most 31
    bitmap, bits = _bitmap(filed)
    held = texts.sparkSession.sparkContext.broadcast(bitmap)
    kind = texts.schema[key].dataType.simpleString()

    def of_text(own: str) -> set[tuple[int, str, str]]:
        low, found = lowered(own), set()
        reach = 2 * (sizes[-1] if sizes else 1)
        for start in range(0, len(low), PART):
            for size, hashes in window_hashes(low[start : start + PART + reach], sizes).items():
                at = hashes.view(_U64) >> _U64(64 - bits)
                near = np.flatnonzero((held.value[(at >> _U64(6)).astype(np.int64)] >> (at & _U64(63))) & _U64(1))
                for i in near.tolist():
                    found.add((int(hashes[i]), low[start + i : start + i + 2 * size - 1], own[start + i : start + i + 2 * size - 1]))
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, own in zip(batch["k"], batch["t"]):
                if found := of_text(own):
                    hashes, low, cut = zip(*found)
                    yield pd.DataFrame({"k": pd.Series([k] * len(found), dtype=batch["k"].dtype), "hash": np.array(hashes, np.int64), "low": low, "own": cut})

    rows = texts.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter("k is not null")
    return written(rows.mapInPandas(run, f"k {kind}, hash long, low string, own string"), "literal-windows")


def _spellings(texts: DataFrame, filed: DataFrame, key: str, text: str) -> DataFrame:
    windows = _windows(texts, filed, key, text)
    counts = windows.groupBy("hash").agg(F.count("*").alias("n"))
    hot = written(counts.filter(F.col("n") * HOT > windows.count()).select("hash"), "hot-literals")  # under HOT rows
    few = filed.select("hash", "needle").join(F.broadcast(hot), "hash", "left_semi")
    rest = windows.join(F.broadcast(hot), "hash", "left_anti").join(filed.select("hash", "needle"), "hash")
    met = rest.unionByName(windows.join(F.broadcast(few), "hash"))
    held = met.filter(F.startswith("low", "needle"))
    return held.select(F.col("k").alias(key), "needle", F.left("own", F.char_length("needle")).alias("found")).distinct()


def find_literals(texts: DataFrame, values: DataFrame, key: str = "doc_id", text: str = "text", value: str = "value", blanks: str | None = None) -> DataFrame:
    """(key, needle, found) of every different spelling of every value in every text, overlapping
    occurrences too. Null and blank values and null texts have none; rows with a null key are left
    out; rows that repeat a key are one text's parts. ``blanks`` as in :func:`needles`."""
    return _spellings(texts, needles(values, value, blanks), key, text)


class _Tree:
    """The tree of all beginnings of sorted values: a row a value, a column a byte. Bytes that no value has
    are class 0."""

    def __init__(self, values: list[bytes]):
        self.sizes = np.fromiter(map(len, values), np.int64, len(values))
        shape = len(values), int(self.sizes.max())
        inside = np.arange(shape[1]) < self.sizes[:, None]
        own = np.array(values, f"S{shape[1]}").view(np.uint8).reshape(shape)
        used = np.unique(own[inside])
        self.classes = np.zeros(256, np.uint8)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.steps = np.where(inside, self.classes[own], 0)
        self.new = np.ones(shape, bool)  # where a row leaves the one above
        np.logical_or.accumulate(self.steps[1:] != self.steps[:-1], axis=1, out=self.new[1:])
        self.new &= inside
        self.states = 1 + int(self.new.sum())
        self.bits = len(used).bit_length()
        self.cells = self.states << self.bits


class _Automaton:
    """Aho-Corasick over the bytes of sorted values, which are numbered from 1."""

    def __init__(self, values: list[bytes]):
        tree = _Tree(values)
        self.classes, self.bits, self.n, self.reach = tree.classes, tree.bits, len(values), tree.new.shape[1] - 1
        step = np.zeros((tree.states, 1 << tree.bits), np.int32)  # next states, shifted to their first cell
        self.longest = np.zeros(tree.states, np.int32)  # the longest value that ends in a state
        self.shorter = np.zeros(self.n + 1, np.int32)  # the next shorter value at a value's end
        back, above, made = np.zeros(tree.states, np.int64), np.zeros(self.n, np.int64), 1
        for depth in range(self.reach + 1):
            new, here = np.flatnonzero(tree.new[:, depth]), made - 1 + np.cumsum(tree.new[:, depth])
            state, before, by = here[new], above[new], tree.steps[new, depth]
            if depth:
                back[state] = step[back[before], by] >> self.bits
            step[before, by] = state << self.bits
            step[state] = step[back[state]]
            self.longest[state] = self.longest[back[state]]
            ends = np.flatnonzero(tree.sizes == depth + 1)
            self.shorter[ends + 1] = self.longest[here[ends]]
            self.longest[here[ends]] = ends + 1
            above, made = here, made + len(new)
        self.step = step.ravel()

    def _ends(self, joined: np.ndarray, start: int) -> np.ndarray:
        """The longest value that ends at each of the next CHUNK bytes; lanes begin ``reach`` bytes early."""
        n = min(CHUNK, len(joined) - start)
        lanes, early = -(-n // SPAN), min(start, self.reach)
        classes = np.zeros(self.reach + lanes * SPAN, np.uint8)
        classes[self.reach - early : self.reach + n] = self.classes[joined[start - early : start + n]]
        by_step = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(classes, SPAN + self.reach)[::SPAN].T)
        state, at = np.zeros(lanes, np.int32), np.zeros(lanes, np.int64)
        out = np.empty((SPAN, lanes), np.int32)
        for i, by in enumerate(by_step):
            np.add(state, by, out=at)
            if i >= self.reach:
                state = out[i - self.reach]
            np.take(self.step, at, out=state, mode="clip")
        return np.ascontiguousarray(self.longest.take(out >> self.bits).T).ravel()[:n]

    def held(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, value) by their places, each pair once."""
        low = [lowered(t).encode() for t in texts]
        joined = np.frombuffer(b"\xff".join([*low, b""]), np.uint8)  # a byte that no text has
        ended, first = [], 0
        for start in range(0, len(joined), CHUNK):
            longest, of = self._ends(joined, start), first + np.cumsum(joined[start : start + CHUNK] == 0xFF)
            at, first = np.flatnonzero(longest), of[-1]
            ended.append(_distinct(of[at] * (self.n + 1) + longest[at]))
        every = [_distinct(np.concatenate(ended))]
        while len(every[-1]):
            text, value = np.divmod(every[-1], self.n + 1)
            value = self.shorter[value]
            every.append(_distinct((text * (self.n + 1) + value)[value > 0]))
        text, value = np.divmod(_distinct(np.concatenate(every)), self.n + 1)
        return text, value - 1


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=-1) > 0]


def _shortest(filed: DataFrame) -> tuple[list[bytes], int]:
    """The shortest needles, as many as the automaton may hold, and the bytes of the longest of them."""
    size = F.octet_length("needle")
    counts = sorted(filed.groupBy(size.alias("size")).agg(F.count("*").alias("n")).filter(F.col("size") <= LONGEST).collect())
    totals = accumulate(size * n for size, n in counts)
    longest = max((row.size for row, total in zip(counts, totals) if total <= MOST_BYTES), default=0)
    few = sorted(r.needle.encode() for r in filed.filter(size <= longest).select("needle").collect())  # at most MOST_BYTES
    while few and _Tree(few).cells > MOST_CELLS:
        longest -= 1
        few = [v for v in few if len(v) <= longest]
    return few, longest


def _even(rows: DataFrame) -> DataFrame:
    """``rows`` as they lie, or dealt anew where one task would have over twice its share of a core."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    if max(counts, default=0) * cores <= 2 * sum(counts):
        return rows
    return rows.repartition(2 * cores, F.xxhash64("k", "t"))


def _scanned(texts: DataFrame, few: list[bytes], key: str, text: str) -> DataFrame:
    """(key, needle) of the values ``few`` by the automaton, each pair once."""
    held = texts.sparkSession.sparkContext.broadcast(few)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, named = _Automaton(held.value), pa.array([v.decode() for v in held.value])
        for batch in batches:
            keys, own = batch.column("k"), batch.column("t")
            chunk = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // CHUNK
            starts = np.flatnonzero(np.diff(chunk, prepend=-1))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(chunk)]):
                rows, values = automaton.held(own.slice(start, stop - start).to_pylist())
                for at in range(0, len(rows), ROWS):
                    part = keys.take(pa.array(start + rows[at : at + ROWS])), named.take(pa.array(values[at : at + ROWS]))
                    yield pa.RecordBatch.from_arrays(list(part), ["k", "needle"])

    def found(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(run, f"k {kind}, needle string").withColumnRenamed("k", key)

    rows = texts.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter("k is not null")
    repeated = written(rows.groupBy("k").count().filter("count > 1").select("k"), "repeated-keys")
    dealt = _even(rows)
    if repeated.isEmpty():
        return found(dealt)
    parts = found(dealt.join(repeated, "k", "left_semi")).distinct()
    return found(dealt.join(repeated, "k", "left_anti")).unionByName(parts)


def held_literals(texts: DataFrame, values: DataFrame, key: str = "doc_id", text: str = "text", value: str = "value", blanks: str | None = None) -> DataFrame:
    """(key, needle) of every value in every text, each pair once, under the rules of :func:`find_literals`.
    Only what rows of repeated keys hold is shuffled. ``texts`` is read twice more for its keys alone, so it
    should be a table."""
    filed = needles(values, value, blanks)
    few, longest = _shortest(filed)
    rest = filed.filter(F.octet_length("needle") > longest)
    if few and rest.isEmpty():
        return _scanned(texts, few, key, text)
    joined = _spellings(texts, rest, key, text).select(key, "needle").distinct()
    return joined.unionByName(_scanned(texts, few, key, text)) if few else joined
