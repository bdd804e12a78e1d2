"""Operators that SQL cannot express, against plain Python on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from papyrine.llm import arrays, decontamination, kneser_ney, mixing, near_dedup, quality_rules, queries, substring_dedup, token_counts


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]


def test_distinct_inverse_is_unique():
    keys = np.random.default_rng(1).integers(0, 500_000, 400_000).astype(np.uint64)
    found, inverse = arrays.distinct_inverse(keys, bits=10)
    assert len(set(found.tolist())) == len(found) == len(np.unique(keys))
    assert (found[inverse] == keys).all()


def test_base_counts(texts):
    odd = ["", " \t", "a", "a b c a b c", "x\nx\n\ny\n \n \n", "é#$ ü|<>\x0b&%*", "one two three four", "a a a", "\u2003 wide\u00a0blank", "a b\nc a b c"]
    every = odd + list(texts.values())
    found = quality_rules.base_counts(every)
    for text, row in zip(every, found.itertuples()):
        words = words_of(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        assert row.n_words == len(words) and row.word_chars == sum(map(len, words))
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert row.n_dup_lines == len(lines) - len(set(lines)) and row.n_repeat_words == len(covered)


def test_token_counts_are_the_librarys(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in queries.op2_token_counts(spark, sf_dir).collect()}
    for doc_id, text in texts.items():
        assert found[doc_id].n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert found[doc_id].n_bytes == len(text.encode())
    rng = random.Random(3)
    parts = ["a", "Ab", " ", "  ", "\n", "\t", "'s", "'ll ", "12", "é", "\u00a0", "\u2003", "\u3000", "\x85", "\x1c", "\u200b", "漢字", "🙂", ".", "!!", "<|endoftext|>", "\r\n", "ſ", "\u2028", "\x0b", "\u1680"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    count = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert count(made) == [len(library.encode(t, add_special_tokens=False).ids) for t in made]


def test_other_vocabularies(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    some = list(texts.values())[:20]
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.counter(public_tokenizers.path("word_bpe_49k.json"))(some) == [len(word.encode(t, add_special_tokens=False).ids) for t in some]
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))(some) == [len(piece.encode(t)) for t in some]


def test_kneser_ney_probabilities(spark):
    """The model's interpolated probabilities, by the textbook formula on explicit n-grams."""
    samples = ["abracadabra", "cadabra abra", "bracada", "aaaa b", "dab"] * 2
    model = kneser_ney.fit(spark.createDataFrame([("x", t) for t in samples], "g string, t string"), "g", "t", "letters", modified=True)
    n = kneser_ney.ORDER
    lut = kneser_ney.alphabet("letters")
    coded = [(0,) * (n - 1) + tuple(int(lut[ord(c)]) for c in t) for t in samples]
    grams = {n: Counter(t[i : i + n] for t in coded for i in range(len(t) - n + 1))}
    for k in range(n - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def p(gram):
        if not gram:
            return 1 / (len(grams[1]) + 1)
        k = len(gram)
        followers = [c for g, c in grams[k].items() if g[:-1] == gram[:-1]]
        if not followers:
            return p(gram[1:])
        d = (0, *kneser_ney._discounts([sum(c == i for c in grams[k].values()) for i in range(1, 5)], True))
        own = max(grams[k][gram] - d[min(grams[k][gram], 3)], 0)
        return (own + sum(d[min(c, 3)] for c in followers) * p(gram[1:])) / sum(followers)

    keys, bounds, _ = kneser_ney.ngram_keys(["abraxas", "zz"], "letters")
    got = model.log_probs(keys, ["x"])[:, 0]
    coded = [(0,) * (n - 1) + tuple(int(lut[ord(c)]) for c in t) for t in ("abraxas", "zz")]
    want = [math.log(p(t[i : i + n])) for t in coded for i in range(len(t) - n + 1)]
    assert np.allclose(got, want, atol=1e-4)


def test_language_accuracy_on_held_out(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = [r for r in queries.op9_language_id(spark, sf_dir).collect() if r.held_out]
    assert len(found) > 30 and np.mean([lang[r.doc_id] == r.lang_pred for r in found]) > 0.95


def test_quality_accuracy_on_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = [r for r in queries.op3_quality_classifier(spark, sf_dir).collect() if r.held_out and r.doc_id in label]
    assert len(found) > 100 and np.mean([label[r.doc_id] == r.predicted for r in found]) > 0.95


def test_quality_rules_keep_good_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    found = [r for r in queries.op5_quality_rules(spark, sf_dir).collect() if r.doc_id in good and not r.base_failed]
    assert np.mean([r.kept for r in found]) > 0.97


def test_copies_do_not_change_verdicts(spark):
    """One text fills 85 % of a language: it and the other documents fare as without the copies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'")
    rows = [tuple(r) for r in docs.orderBy("doc_id").limit(60).select("doc_id", "text", "lang").collect()]
    alone = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    kept = next(r for r in rows if alone[r[0]].kept)
    every = rows + [(10**9 + i, kept[1], "en") for i in range(340)]
    random.Random(2).shuffle(every)
    found = quality_rules.judge(spark.createDataFrame(every, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r for r in found if r.doc_id < 10**9} == alone
    assert {(r.kept, r.log_perplexity) for r in found if r.doc_id >= 10**9} == {(True, alone[kept[0]].log_perplexity)}


def sentences_of(text):
    """The operator's sentences, checked: they make up the text and end where they may."""
    p, _ = substring_dedup.pieces([text])
    edges = [0, *p.words.starts[p.first[1:]], len(text)] if len(p.first) else [0, len(text)]
    found = [text[a:b] for a, b in zip(edges, edges[1:])]
    assert "".join(found) == text
    for piece, nxt in zip(found, found[1:]):
        words = words_of(piece)
        assert 0 < len(words) <= substring_dedup.MAX_WORDS
        assert not any(w[-1] in ".!?" for w in words[:-1]) and "\n" not in piece.strip(" \t\n\v\f\r")
    return [tuple(w.lower() for w in words_of(x)) for x in found], found


def test_substring_dedup(spark, sf_dir, texts):
    run, least = substring_dedup.RUN, substring_dedup.MIN_WORDS
    places, want = defaultdict(list), {}
    for doc_id in sorted(texts):
        words, found = sentences_of(texts[doc_id])
        want[doc_id] = [found, set()]
        n, size = len(words), [len(w) for w in words]
        ends = [next((j for j in range(i + run - 1, n) if sum(size[i : j + 1]) >= least), None) for i in range(n)]
        starts = [next((i for i in range(j - run + 1, -1, -1) if sum(size[i : j + 1]) >= least), None) for j in range(n)]
        for i, j in {(i, j) for i, j in enumerate(ends) if j is not None} | {(i, j) for j, i in enumerate(starts) if i is not None}:
            places[tuple(w for x in words[i : j + 1] for w in x)].append((doc_id, i, j))
    for found in places.values():
        for doc_id, i, j in sorted(found)[1:]:
            want[doc_id][1].update(range(i, j + 1))
    for r in queries.op6_substring_dedup(spark, sf_dir).collect():
        pieces, gone = want[r.doc_id]
        assert (r.n_sentences, r.n_removed) == (len(pieces), len(gone))
        assert r.text_md5 == hashlib.md5("".join(p for i, p in enumerate(pieces) if i not in gone).encode()).hexdigest()


def test_a_long_repeated_passage_goes(spark):
    """Over 50 words of whole sentences, in between other sentences, are removed wholly."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]

    def sentence(n):
        return " ".join(rng.choices(vocabulary, k=n)).capitalize() + ". "

    for shape in ([51], [30, 22], [9] * 6, [2, 48, 3], [20, 4, 4, 26], [1] * 55):
        passage = "".join(sentence(n) for n in shape)
        rows = [(i, "".join(sentence(rng.randint(3, 30)) for _ in range(4)) + passage + "".join(sentence(12) for _ in range(4))) for i in range(4)]
        found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.text for r in found} == {t if i == 0 else t.replace(passage, "") for i, t in rows}


def test_a_passage_inside_sentences_goes(spark):
    """Dropped between any two words, a passage of over 50 words goes but for its ends."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    for _ in range(5):
        passage = [w + rng.choice(["", "", "", ",", "."]) for w in rng.choices(vocabulary, k=60)]
        rows = [(i, " ".join(rng.choices(vocabulary, k=70) + passage + rng.choices(vocabulary, k=70))) for i in range(3)]
        found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        for r in found:
            left = set(passage) & set(r.text.split())
            assert len(set(rows[r.doc_id][1].split()) - set(passage) - set(r.text.split())) == 0
            assert left == set(passage) if r.doc_id == 0 else len(left) < 34


def test_any_51_words_share_spans():
    rng = random.Random(16)
    vocabulary = [f"w{i}" for i in range(5000)]
    for marks in (0, 0.05, 0.2):
        for _ in range(150):
            passage = [w + ("." if rng.random() < marks else "") for w in rng.choices(vocabulary, k=51)]
            made = [" ".join(rng.choices(vocabulary, k=40) + passage + rng.choices(vocabulary, k=40)) for _ in range(2)]
            one, other = (substring_dedup._spans([t]) for t in made)
            gone = np.flatnonzero(np.isin(other[1], one[1]))
            left = substring_dedup.kept_text(made[1], other[2][gone])[0].split()
            assert 23 <= 131 - len(left) <= 51


def test_near_duplicates(spark, texts):
    rng = random.Random(11)
    rows = dict(texts)
    base = [t for t in texts.values() if 100 < len(t.split()) < 600][:25]
    for n, text in enumerate(base):  # chains and stars of edited copies
        words = text.split()
        for c in range(8):
            copy = list(words)
            for _ in range(1 + c % 4):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            rows[10_000 + 100 * n + c] = " ".join(copy)
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)]) for i, w in ((i, t.lower().split()) for i, t in rows.items())}
    holders = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            holders[g].add(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    checked = set()
    for i, s in sets.items():
        for j in {j for g in s for j in holders[g] if j > i} - {j for a, j in checked if a == i}:
            shared = sum((s & sets[j]).values())
            if shared >= 0.8 * (sum(s.values()) + sum(sets[j].values()) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = near_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: find(i) for i in sets}


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    elements = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    for shift in (0.0, 0.4, 1.0):
        a, b = rng.random(300) * 3, None
        b = a + shift * (rng.random(300) - 0.3) * 2
        b = np.maximum(b, 0.05)
        owner = np.repeat([0, 1], 300)
        signature = near_dedup.dart_signatures(owner, np.concatenate((elements, elements)), np.concatenate((a, b)), 2, k=4000)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert (signature > 0).all() and abs((signature[0] == signature[1]).mean() - want) < 0.035


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 60)))) for i in range(60)]
    docs, want = [], set()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + row[1:], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    for i, text in items:
        words = text.split()
        for share in (0.0, 0.1, 0.2, 0.35):
            copy = list(words)
            for _ in range(int(share * len(words))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            around = [rng.choices(vocabulary, k=40) for _ in range(2)]
            docs.append((len(docs), " ".join(around[0] + copy + around[1])))
            whole = docs[-1][1].split()
            near = min(distance(whole[s : s + len(words)], words) for s in range(30, 51))
            if near <= decontamination.EDITS * len(words):
                want.add((len(docs) - 1, i))
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_decontamination_finds_long_edited_items():
    """Items of 150 to 400 words with as many edits as are allowed, insertions and deletions too."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(2000)]
    for size in (150, 400):
        texts = [rng.choices(vocabulary, k=size) for _ in range(30)]
        items = decontamination.prepare(list(range(30)), [" ".join(t) for t in texts])
        docs = []
        for words in texts:
            copy = list(words)
            for place in sorted(rng.sample(range(size), int(0.2 * size) // 2), reverse=True):
                kind = rng.randrange(3)
                copy[place : place + (kind > 0)] = [rng.choice(vocabulary)] * (kind < 2)
            for place in rng.sample(range(len(copy)), int(0.2 * size) - int(0.2 * size) // 2 - abs(len(copy) - size)):
                copy[place] = rng.choice(vocabulary)
            docs.append(" ".join(rng.choices(vocabulary, k=30) + copy + rng.choices(vocabulary, k=30)))
        found = decontamination.find(docs, items)
        assert set(zip(found["text"], found["item"])) == {(i, i) for i in range(30)}


def test_short_and_unspaced_items_are_searched():
    texts = ["what is the tallest peak of earth", "why", "世界で一番高い山はどこにありますか", "ภูเขาที่สูงที่สุดในโลกคืออะไร"]
    items = decontamination.prepare(list("abcd"), texts, least_words=1)
    docs = [
        "Quiz: What is the tallest peak of Earth?", "what is the tallest hill of earth", "so, WHY not; why",
        "問題、世界で一番高い山はどこにありますか。答え", "世界で一番高い川はどこにありますか", "世界で一番大きい", "ถาม ภูเขาที่สูงที่สุดในโลกคืออะไร ตอบ",
    ]
    found = decontamination.find(docs, items)
    assert list(zip(found["text"], found["item"], found["distance"], found["start"])) == [(0, 0, 0, 1), (2, 1, 0, 1), (3, 2, 0, 2), (4, 2, 1, 0), (6, 3, 0, 3)]


def test_edit_distances():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 4, (200, 12)).astype(np.uint64), rng.integers(0, 4, (200, 12)).astype(np.uint64)
    lengths = rng.integers(1, 13, 200)
    got = decontamination.edit_distances(left, right, lengths)
    for a, b, n, d in zip(left.tolist(), right.tolist(), lengths, got):
        row = list(range(n + 1))
        for i in range(1, n + 1):
            row, last = [i] + [0] * n, row
            for j in range(1, n + 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
        assert row[-1] == d


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(1, 900)), [float(x) for x in rng.dirichlet((0.3, 0.2, 0.1))]) for i in range(3000)]
    measured = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    found = mixing.with_rates(measured, {"a": 1.0, "b": 2.0, "c": 1.0}).collect()
    load = sum(r.rate * r.n_tokens * np.array(r.posterior) for r in found) / sum(r.n_tokens for r in found)
    assert np.allclose(load, (0.25, 0.5, 0.25), atol=2e-3) and min(r.rate for r in found) >= 0


def test_rates_meet_targets_with_a_few_huge_documents(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(50, 900)), [[0.99, 0.005, 0.005], [0.005, 0.99, 0.005], [0.005, 0.005, 0.99]][int(rng.choice(3, p=(0.6, 0.3, 0.1)))]) for i in range(3000)]
    rows += [(3000 + i, 200_000, [0.9, 0.05, 0.05]) for i in range(10)]
    measured = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    found = mixing.with_rates(measured, {"clean": 0.90, "low": 0.08, "toxic": 0.02}).collect()
    load = sum(r.rate * r.n_tokens * np.array(r.posterior) for r in found) / sum(r.n_tokens for r in found)
    assert np.allclose(load, (0.90, 0.08, 0.02), atol=2e-4) and min(r.rate for r in found) >= 0


def test_rates_report_targets_out_of_reach(spark):
    rows = [(i, 10 + i, [0.5, 0.5]) for i in range(50)] + [(50, 0, [0.5, 0.5])]
    measured = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="off by 0.4"):
        found = mixing.with_rates(measured, {"a": 0.9, "b": 0.1}).collect()
    assert np.allclose([r.rate for r in found], 1.0)


def test_rates_need_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    margins = rng.normal(0, 1.5, (2000, 3))
    p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
    measured = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(rng.lognormal(6, 1.2, 2000) + 1, p))], "doc_id long, n_tokens long, posterior array<double>").cache()
    passes, sums = [], mixing._domain_sums
    monkeypatch.setattr(mixing, "_domain_sums", lambda *a: passes.append(1) or sums(*a))
    found = mixing.with_rates(measured, {"clean": 0.90, "low": 0.08, "toxic": 0.02}).collect()
    load = sum(r.rate * r.n_tokens * np.array(r.posterior) for r in found) / sum(r.n_tokens for r in found)
    assert np.allclose(load, (0.90, 0.08, 0.02), atol=2e-4) and min(r.rate for r in found) >= 0 and len(passes) <= 20


def test_domain_posteriors(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = queries.domain_labels(spark, sf_dir)
    names = list(queries.DOMAIN_TARGETS)
    label = {r.doc_id: r.domain for r in labels.collect()}
    learn = labels.filter("doc_id % 3 <> 0")
    found = mixing.posteriors(spark.read.parquet(f"{sf_dir}/documents.parquet"), learn, names).filter("doc_id % 3 = 0").collect()
    assert np.mean([names[int(np.argmax(r.posterior))] == label[r.doc_id] for r in found if r.doc_id in label]) > 0.9
