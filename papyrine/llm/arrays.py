"""Vectorised helpers over a batch of texts; they run inside Arrow-fed tasks.

A batch is one long array of code points in which every text is followed by one
separator, so a single NumPy pass covers many short texts or one very long one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
#: Code points handled at once: a few tens of MB of intermediate arrays.
BLOCK_CHARS = 1 << 19
#: Odd multipliers of the hash tables below (fixed values).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SEPARATOR = 0x0A


def text_blocks(texts: Sequence[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` code points; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points with a separator after each text, start of each text and the end)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return points, np.concatenate(([0], np.cumsum(lengths)))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = values.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct_inverse(keys: np.ndarray, bits: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique(keys, return_inverse=True)`` without the order, by hash tables in cache."""
    inverse = np.empty(len(keys), np.int64)
    found: list[np.ndarray] = []
    base, rest, where = 0, keys, None
    for multiplier in MULTIPLIERS:
        if not len(rest):
            break
        slots = ((rest * U64(multiplier)) >> U64(64 - bits)).astype(np.int64)
        table = np.zeros(1 << bits, U64)
        table[slots] = rest
        same = table[slots] == rest
        used = np.zeros(1 << bits, bool)
        used[slots] = True
        ids = np.cumsum(used) - 1 + base
        found.append(table[used])
        if same.all():
            if where is None:
                return found[0], ids[slots]
            inverse[where] = ids[slots]
            rest = rest[:0]
            break
        kept = slots[same]
        places = np.flatnonzero(same) if where is None else where[same]
        inverse[places] = ids[kept]
        where = np.flatnonzero(~same) if where is None else where[~same]
        rest = rest[~same]
        base += len(found[-1])
    if len(rest):
        more, back = np.unique(rest, return_inverse=True)
        inverse[where] = back + base
        found.append(more)
    return (np.concatenate(found) if found else keys[:0]), inverse


class Words:
    """The words of a block: runs of characters outside ``breaks``."""

    #: Multiplier of the word hash and its inverse modulo 2**64.
    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)
    _powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, points: np.ndarray, bounds: np.ndarray, inside: np.ndarray):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.points, self.starts, self.ends = points, edges[::2], edges[1::2]
        #: first word of each text, and the end
        self.of_text = np.searchsorted(self.starts, bounds)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls._powers is None or len(cls._powers[0]) < n:
            size = max(n, BLOCK_CHARS + 1)
            up, down = np.full(size, U64(cls.BASE)), np.full(size, U64(cls.INVERSE))
            up[0] = down[0] = 1
            cls._powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls._powers

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's characters."""
        up, down = self.powers(len(self.points) + 1)
        sums = np.concatenate(([U64(0)], np.cumsum(mix(self.points) * up[: len(self.points)], dtype=U64)))
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def text_index(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of_text) - 1), np.diff(self.of_text))


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``; 0 for an empty range."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def is_space(points: np.ndarray) -> np.ndarray:
    """U+0020 and U+0009 to U+000D."""
    return (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
