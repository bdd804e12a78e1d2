"""Each stage of the pipeline against plain Python on its own input."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from papyrine.llm import line_dedup, quality_rules
from papyrine.workspace import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "n_tokens", "rate"]


def test_quality_stage(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    counts = quality_rules.base_counts(list(before.values()))
    failed = {i for i, r in zip(before, counts.itertuples()) if r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words}
    assert not failed & set(after) and all(after[i] == before[i] for i in after)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()} - failed
    assert len(good - set(after)) < 0.02 * len(good)


def test_line_stage(stages):
    before = {r.doc_id: r for r in stages[1].collect()}
    after = {r.doc_id: r for r in stages[2].collect()}
    pages, total = defaultdict(Counter), Counter(r.source for r in before.values())
    for r in before.values():
        pages[r.source].update({x.strip(" \t\r") for x in r.text.split("\n")} - {""})
    assert set(after) == set(before)
    for i, r in before.items():
        gone = {x for x, n in pages[r.source].items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * total[r.source]}
        want = "\n".join(x for x in r.text.split("\n") if x.strip(" \t\r") not in gone)
        assert after[i].text == want and after[i].n_chars == len(want)


def test_near_duplicate_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    words = {i: t.lower().split() for i, t in before.items()}
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)]) for i, w in words.items()}
    holders = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            holders[g].add(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j in {j for g in s for j in holders[g] if j > i}:
            shared = sum((s & sets[j]).values())
            if shared >= 0.8 * (sum(s.values()) + sum(sets[j].values()) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(after) == {i for i in sets if find(i) == i}


def test_decontamination_stage(spark, stages):
    before, after = texts(stages[3]), texts(stages[4])
    plain = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def near(window, item):
        row = list(range(len(item) + 1))
        for i, x in enumerate(window, 1):
            row, last = [i] + row[1:], row
            for j, y in enumerate(item, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1] <= 0.2 * len(item)

    held = set()
    for i, text in before.items():
        words = plain(text)
        places = defaultdict(list)
        for k in range(len(words) - 2):
            places[tuple(words[k : k + 3])].append(k)
        for item in items:
            n, e = len(item), int(0.2 * len(item))
            # an item within reach shares three words in a row; look around each such place
            starts = {k - o + d for o in range(n - 2) for k in places.get(tuple(item[o : o + 3]), ()) for d in range(-e, e + 1)}
            seeds = Counter(k - o for o in range(n - 2) for k in places.get(tuple(item[o : o + 3]), ()))
            if seeds and any(near(words[max(s, 0) : max(s, 0) + n], item) for s in starts if sum(seeds[s + d] for d in range(-e, e + 1)) >= 2):
                held.add(i)
    assert set(after) == set(before) - held and all(after[i] == before[i] for i in after)


def test_mixing_stage(stages):
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in stages[4].collect())
    assert all(r.rate >= 0 and r.n_tokens == len(r.text.split()) for r in rows)
    weight, tokens = np.array([r.rate for r in rows]), np.array([r.n_tokens for r in rows])
    assert abs((weight * tokens).sum() / tokens.sum() - 1) < 0.02
