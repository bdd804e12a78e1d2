"""Importance resampling, exact deduplication and whitening against plain Python and NumPy."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from papyrine.llm import exact_dedup, importance_resampling, queries, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, max_n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, max_n, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, max_n)[1])
    t = Counter(bucket(f) for x in target for f in features(x, max_n)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for key, text in docs:
        words, own = features(text, max_n)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        score = None
        if key is not None:
            h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(words), len(own), weight, score, None])
    able = sorted((r for r in out if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for place, row in enumerate(able[: len(able) * percent // 100], 1):
        row[5] = place
    return Counter(map(tuple, out))


TEXTS = [
    (1, "The cat sat on THE mat, the end."), (2, None), (3, ""), (4, "--- ..."), (5, "Äpfel über ÄPFEL 漢字 x1 X1"), (6, "tide " * 500), (7, "the the the cat"), (7, "the the the cat"), (None, "cat " * 9),
    *[(n, " ".join(f"w{(n * k) % 17}" for k in range(n % 40))) for n in range(8, 90)],
]
TARGET = ["the cat and the tide", None, "Äpfel w3 w5", ""]


@pytest.mark.parametrize("max_n,buckets,block", [(1, 10_000, 400_000), (1, 7, 30), (2, 50, 30), (3, 10_000, 100)])
def test_resampling_equals_brute_force(spark, monkeypatch, max_n, buckets, block):
    monkeypatch.setattr(importance_resampling, "BLOCK_WORDS", block)
    docs = spark.createDataFrame([(k, t, 1, "b") for k, t in TEXTS], "doc_id long, text string, block int, key string").repartition(3)
    target = spark.createDataFrame([(t, 3) for t in TARGET], "text string, words int")
    found = importance_resampling.resample(docs, target, max_n, buckets, percent=30, least_words=5)
    want = resampled(TEXTS, TARGET, max_n, buckets, 30, 5)
    assert Counter(map(tuple, found.collect())) == want


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame(TEXTS[:5], "doc_id long, text string")
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert importance_resampling.resample(nothing, docs).count() == 0
    alone = importance_resampling.resample(docs, nothing, least_words=1)
    assert Counter(map(tuple, alone.collect())) == resampled(TEXTS[:5], [], 1, 10_000, 10, 1)


def copies(rows):
    groups = defaultdict(list)
    for at, (key, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), key is None, key or 0, at, key))
    out = Counter()
    for bare, members in groups.items():
        best = min(members)
        for m in members:
            out[(m[4], best[4], len(members), hashlib.sha256(bare.encode()).hexdigest())] += 1
    return out


SAME_LENGTH = [(n, "x" * 70 + f"{n % 3}") for n in range(100, 130)]  # equal length and prefix, three texts
COPIES = [
    (1, "a b\tc"), (2, "abc"), (3, "ab c "), (4, None), (5, ""), (6, " \n\r\x0b\x0c"), (7, "abd"), (8, "é" * 5000), (9, "é" * 5000 + " "), (10, "a b"), (11, "ab"), (12, "🙂 🙂"), (13, "🙂🙂"),
    (13, "🙂🙂"), (None, "🙂🙂"), (None, "only"), *SAME_LENGTH, *[(1000 + n, "the hot text, again") for n in range(300)],
]


@pytest.mark.parametrize("broadcast,hot", [(200_000, 1_000), (0, 1_000), (0, 3)])
def test_exact_groups_equal_brute_force(spark, monkeypatch, broadcast, hot):
    monkeypatch.setattr(exact_dedup, "BROADCAST_PAIRS", broadcast)
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    docs = spark.createDataFrame([(k, t, "p", 3) for k, t in COPIES], "doc_id long, text string, _prefix string, _n int").repartition(5)
    rows = exact_dedup.exact_groups(docs, digest=True).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == copies(COPIES)
    assert sum(r.kept for r in rows) == len({re.sub(r"[\x20\x09-\x0d]", "", t or "") for _, t in COPIES})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_single_texts_are_not_hashed_whole(spark):
    docs = spark.createDataFrame(COPIES, "doc_id long, text string")
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert rows[8].text_sha256 and rows[1].text_sha256
    assert rows[10].text_sha256 is None and rows[10].kept and rows[10].group_size == 1
    # of the same length as others but of another prefix
    assert rows[7].text_sha256 is None and rows[11].text_sha256 is None
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_dedup_stays_in_the_jvm(spark, sf_dir):
    plan = queries.op12_exact_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def whitened(vectors, k):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], np.int64)
    n, sums = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ axes / np.sqrt(values), values / ((x - sums / n) ** 2).sum(axis=1).mean()


@pytest.mark.parametrize("d,n", [(64, 300), (3, 50), (40, 120)])
def test_whitening_equals_numpy(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((n, d)) * np.linspace(0.5, 0.1, d)).astype(np.float32)
    odd = [(-1, None), (-2, [None] + [0.1] * (d - 1)), (-3, [float("nan")] * d), (-4, [float("inf")] + [0.0] * (d - 1)), (-5, []), (-6, [0.5] * (d + 1))]
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(i, v, "x") for i, v in odd], "vec_id long, embedding array<float>, component string").repartition(4)
    rows = whitening.whiten(table).collect()
    k = min(8, d)
    deviation, white, explained = whitened(vectors, k)
    assert len(rows) == n * k and {r.component for r in rows} == set(range(1, k + 1))
    got = np.zeros((n, k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained - explained[r.component - 1]) < 1e-9
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-8


def test_lobpcg_certifies_large_matrices():
    q = np.random.default_rng(5).standard_normal((200, 200))
    matrix = q @ q.T
    values, axes, residuals, passes = whitening.leading_eigenpairs(lambda b: matrix @ b, 200, 8)
    assert passes > 3 and residuals.max() <= whitening.TOLERANCE * values[0]
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:8]).max() < 1e-9 * values[0]
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    for rows in ([(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])]):
        found = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
        assert len(found) == 2 * len(rows) and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in found)
    # one direction only: the second component has no variance
    line = whitening.whiten(spark.createDataFrame([(i, [i / 4, i / 4]) for i in range(9)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)


def test_deviations_beyond_a_long_are_null():
    x = np.array([[10**6, 0], [0, 0]])
    assert whitening._deviations(x, [10**6, 0], 2) == [10**12, 10**12]
    assert whitening._deviations(x, [10**15, 0], 10**9) == [0, None]
