"""Hot groups, large alphabets and long items on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np

from papyrine.llm import decontamination, kneser_ney, language_id, line_dedup, near_dedup, token_counts


def test_near_copies_and_a_common_passage(spark):
    """A large group of near copies, and a passage that makes up most of many documents of different sizes."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = rng.choices(vocabulary, k=120)
    texts = []
    for _ in range(400):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = f"e{rng.random()}"
        texts.append(" ".join(copy))
    passage = rng.choices(vocabulary, k=100)
    texts += [" ".join(passage + [f"o{i}-{k}" for k in range(rng.randint(3, 60))]) for i in range(400)]
    sets = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(str.split, texts)]
    weight = [sum(s.values()) for s in sets]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g])
        for j in shared:
            if find(i) != find(j):
                both = sum((s & sets[j]).values())
                if both >= 0.8 * (weight[i] + weight[j] - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        for g in s:
            holders[g].add(i)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(rows).collect()}
    assert found == {i: find(i) for i in range(len(texts))}


def test_probabilities_sum_to_one(spark):
    """After any seen context, over a large alphabet, and under the table of a text's own n-grams too."""
    rng = np.random.default_rng(5)
    points = 0x4E00 + np.minimum(rng.zipf(1.3, 60_000), 3_000)
    texts = ["".join(map(chr, part)) for part in points.reshape(-1, 60)]
    counts = kneser_ney.count_ngrams(spark.createDataFrame([("zh", t) for t in texts], "g string, t string"), "g", "t", "all")
    model = kneser_ney.model_of(counts, "all", modified=True)
    classes = sorted({int(x) for x in kneser_ney.ngram_keys(texts, "all")[2]})
    for context in (texts[0][:3], texts[7][10:13], texts[3][:1] * 3):
        start = int(kneser_ney.ngram_keys([context + "a"], "all")[0][-1]) >> kneser_ney.CLASS_BITS
        keys = np.array([start << kneser_ney.CLASS_BITS | c for c in classes], np.uint64)
        # the classes never seen share what is left, one part of all
        assert 0.99 < np.exp(model.log_probs(keys, ["zh"])[:, 0]).sum() <= 1 + 1e-6
    own = {r["gram"]: r["log_p"] for r in kneser_ney.own_log_table(counts, modified=True).collect()}
    table = {r["gram"]: r["log_p"] for r in model.log_table(counts).collect()}
    assert own.keys() == table.keys() and all(abs(own[g] - table[g]) < 1e-6 for g in own)


def test_language_argmin_and_ties(spark):
    rows = [(i, "abc abc abc", lang, False) for i, lang in enumerate(["xx", "yy"])] + [(9, "abc", None, True), (10, "abc", None, True), (11, None, None, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    found = {r.doc_id: (r.lang_pred, round(r.score, 3)) for r in language_id.identify(docs, "held_out").collect()}
    assert found[9] == found[10] == ("xx", 0.5) and found[11] == ("und", 0.0)


def test_skewed_hosts_give_the_same_lines(spark, monkeypatch):
    rows = [(i, f"menu\nown {i}", "big" if i % 10 else f"host{i % 30}") for i in range(600)] + [(1000, "menu\nalone", "lonely")]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(tuple(r) for r in line_dedup.drop_boilerplate(pages).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted(tuple(r) for r in line_dedup.drop_boilerplate(pages).collect()) == one
    assert dict((r[0], r[1]) for r in one)[1000] == "menu\nalone" and dict((r[0], r[1]) for r in one)[5] == "own 5"


def test_hot_digests_are_counted(spark, tmp_path):
    import public_tokenizers

    rows = [(i, "the same text" if i % 3 else f"text number {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache").collect()
    assert len(found) == 3000 and {r.n_tokens for r in found if r.doc_id % 3} == {3}


def test_items_of_every_length(spark):
    """Items of 1 to 1,000 words in one search, edited as far as is allowed."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(5000)]
    items, docs = [], []
    for i, n in enumerate((1, 3, 8, 20, 59, 150, 300, 1000)):
        words = [f"q{i}x{k}" if n < 8 else w for k, w in enumerate(rng.choices(vocabulary, k=n))]
        copy = list(words)
        for place in rng.sample(range(n), int(0.2 * n) if n >= 8 else 0):
            copy[place] = rng.choice(vocabulary)
        items.append((i, " ".join(words)))
        docs.append((i, " ".join(rng.choices(vocabulary, k=30) + copy + rng.choices(vocabulary, k=30))))
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least_words=1)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(len(items))}
