"""Importance resampling towards a target distribution of hashed word n-grams.

Texts are read once, in blocks of about ``BLOCK_WORDS`` words. A block keeps its distinct words, its
distinct n-grams as tuples of word numbers, and for every text the numbers and counts of its
n-grams. All that is global works on these: the distinct words of all blocks make the dictionary
(word, id, counts), whose rows are the tuples of one id too; longer n-grams become tuples of ids, and
equal ones are added up over blocks; the bytes of each distinct tuple are put together from the
dictionary and hashed once; the counts of the buckets give every bucket's gain; gains go back to
tuples, to blocks and to texts. A frequent word is one row a block, so no word and no n-gram is a hot
key; copies of a text only make a block's counts larger.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased.
Null texts are empty. A row with a null key has no noise and is never drawn; rows that repeat a key
are ranked each. Columns besides key and text take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from papyrine.llm.hot_keys import hot_keys, split_join
from papyrine.operators.numbering import numbered
from papyrine.workspace import written

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
DRAWN_PERCENT = 10
BLOCK_WORDS = 1_000_000
#: Bytes of a text to those of its words: lower case, and a blank for all that is no part of a word.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: A block's row has ``words``, ``tuples`` of two words and more, and ``totals`` of words and then of tuples; a
#: text's row has the numbers of those it holds, rising, each less the one before, and how often.
CODED = "block long, target boolean, key {key}, n_words long, grams array<int>, counts array<int>, words array<binary>, tuples array<array<int>>, totals array<long>"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    """Texts, by the numbers of their words."""

    def __init__(self, number: int, target: bool):
        self.number, self.target, self.words = number, target, _Numbers()
        self.keys, self.ids, self.sizes, self.size = [], [], [], 0

    def add(self, key, text: bytes) -> None:
        found = text.translate(_TABLE).split()
        self.keys.append(key)
        self.sizes.append(len(found))
        self.ids.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        self.size += len(found) + 1

    def coded(self, max_n: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each text, and one for the block."""
        ids, of_text = np.concatenate(self.ids).astype(np.int64), np.repeat(np.arange(len(self.keys)), self.sizes)
        grams, texts, tuples, known = [], [], [], 0
        level, level_tuples = ids, np.arange(len(self.words))[:, None]
        for n in range(1, max_n + 1):
            if n > 1:  # a longer run is one of the runs before and a word
                inside = of_text[: len(level) - 1] == of_text[n - 1 :]
                codes = level[:-1] * len(self.words) + ids[n - 1 :]
                found, back = np.unique(codes[inside], return_inverse=True)
                level_tuples = np.hstack([level_tuples[found // len(self.words)], (found % len(self.words))[:, None]])
                level = np.zeros(len(codes), np.int64)
                level[inside] = back
                grams.append(back + known)
                texts.append(of_text[: len(codes)][inside])
            else:
                grams.append(level)
                texts.append(of_text)
            tuples.append(level_tuples)
            known += len(level_tuples)
        width = max(1, known)
        pairs, counts = np.unique(np.concatenate(texts) * width + np.concatenate(grams), return_counts=True)
        own, bounds = pairs % width, np.searchsorted(pairs, np.arange(len(self.keys) + 1) * width)
        totals = np.bincount(own, weights=counts, minlength=known).astype(np.int64)
        bounds_of = lambda sizes: np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        longer = [t for t in tuples if t.shape[1] > 1]
        sizes = np.concatenate([np.full(len(t), t.shape[1]) for t in longer] or [np.zeros(0, np.int32)])
        flat = pa.ListArray.from_arrays(bounds_of(sizes), np.concatenate([t.ravel() for t in longer] or [np.zeros(0)]).astype(np.int32))
        steps = np.diff(own, prepend=0)
        steps[bounds[:-1][np.diff(bounds) > 0]] = own[bounds[:-1][np.diff(bounds) > 0]]
        rows = len(self.keys)
        of_texts = pa.array([*bounds.tolist(), len(own)], pa.int32())  # the block's own row has none
        last = lambda values: pa.concat_arrays([pa.nulls(rows, pa.list_(values.type)), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)])
        columns = [
            pa.array(np.full(rows + 1, self.number)), pa.array(np.full(rows + 1, self.target)), pa.array([*self.keys, None], schema.field("key").type), pa.array([*self.sizes, None], pa.int64()),
            pa.ListArray.from_arrays(of_texts, pa.array(steps.astype(np.int32))), pa.ListArray.from_arrays(of_texts, pa.array(counts.astype(np.int32))),
            last(pa.array(list(self.words), pa.binary())), last(flat), last(pa.array(totals)),
        ]
        return pa.record_batch(columns, schema=schema)


def coded(self, max_n: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each text, and one for the block."""
        ids, of_text = np.concatenate(self.ids).astype(np.int64), np.repeat(np.arange(len(self.keys)), self.sizes)
        grams, texts, tuples, known = [], [], [], 0
        level, level_tuples = ids, np.arange(len(self.words))[:, None]
        for n in range(1, max_n + 1):
            if n > 1:  # a longer run is one of the runs before and a word
                inside = of_text[: len(level) - 1] == of_text[n - 1 :]
                codes = level[:-1] * len(self.words) + ids[n - 1 :]
                found, back = np.unique(codes[inside], return_inverse=True)
                level_tuples = np.hstack([level_tuples[found // len(self.words)], (found % len(self.words))[:, None]])
                level = np.zeros(len(codes), np.int64)
                level[inside] = back
                grams.append(back + known)
                texts.append(of_text[: len(codes)][inside])
            else:
                grams.append(level)
                texts.append(of_text)
            tuples.append(level_tuples)
            known += len(level_tuples)
        width = max(1, known)
        pairs, counts = np.unique(np.concatenate(texts) * width + np.concatenate(grams), return_counts=True)
        own, bounds = pairs % width, np.searchsorted(pairs, np.arange(len(self.keys) + 1) * width)
        totals = np.bincount(own, weights=counts, minlength=known).astype(np.int64)
        sizes = np.concatenate([np.full(len(t), t.shape[1]) for t in tuples])
        flat = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.concatenate([t.ravel() for t in tuples]).astype(np.int32))
        rows = len(self.keys)
        columns = [
            pa.array(np.full(rows + 1, self.number)), pa.array(np.full(rows + 1, self.target)), pa.array([*self.keys, None], schema.field("key").type), pa.array([*self.sizes, None], pa.int64()),
            pa.ListArray.from_arrays(pa.array([*bounds.tolist(), len(own)], pa.int32()), pa.array(own.astype(np.int32))),
            pa.ListArray.from_arrays(pa.array([*bounds.tolist(), len(own) + known], pa.int32()), pa.array(np.concatenate([counts, totals]))),
            pa.array([None] * rows + [list(self.words)], pa.list_(pa.binary())), pa.concat_arrays([pa.nulls(rows, pa.list_(flat.type)), pa.ListArray.from_arrays(pa.array([0, known], pa.int32()), flat)]),
        ]
        return pa.record_batch(columns, schema=schema)


def coded(docs: DataFrame, target: DataFrame, max_n: int, key: str, text: str, target_text: str) -> DataFrame:
    """Both tables as rows of ``CODED``, written."""
    kind = docs.schema[key].dataType
    schema = pa.schema(
        [("block", pa.int64()), ("target", pa.bool_()), ("key", to_arrow_type(kind)), ("n_words", pa.int64()), ("grams", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("words", pa.list_(pa.binary())), ("tuples", pa.list_(pa.list_(pa.int32()))), ("totals", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, block = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            for of_target, k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if block and (block.target != of_target or block.size > BLOCK_WORDS):
                    yield block.coded(max_n, schema)
                    block = None
                if block is None:
                    made, block = made + 1, _Block(made, of_target)
                block.add(k, content.as_py())
        if block:
            yield block.coded(max_n, schema)

    content = lambda name: F.coalesce(F.col(name), F.lit("")).cast("binary").alias("text")
    both = docs.select(F.lit(False).alias("target"), F.col(key).alias("key"), content(text))
    both = both.unionAll(target.select(F.lit(True), F.lit(None).cast(kind), content(target_text)))
    return written(both.mapInArrow(run, CODED.format(key=kind.simpleString())), "coded-texts")


def _sides() -> list[Column]:
    return [F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).alias(name) for name, side in (("s", ~F.col("target")), ("t", F.col("target")))]


def dictionary(blocks: DataFrame, buckets: int) -> DataFrame:
    """(word, s, t, bucket, id) of the distinct words of all blocks: occurrences in the table and in the
    target, and the bucket of the word's bytes, hashed once."""
    every = blocks.select("target", F.inline(F.arrays_zip(F.col("words").alias("word"), F.slice("totals", F.lit(1), F.size("words")).alias("n"))))
    counts = every.groupBy("word").agg(*_sides()).withColumn("bucket", F.crc32("word") % buckets)
    return numbered(counts, name="id", start=0)


def block_tuples(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(block, target, gram, tuple, n): each n-gram of two words and more of a block, as a tuple of word
    ids. Written."""
    held = blocks.select("block", F.posexplode("words").alias("at", "word")).join(words.select("word", "id"), "word")
    ids = held.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "id")))["id"].alias("ids"))  # as many as the block has words
    whole = blocks.join(ids, "block")  # one row a block
    tuples = F.transform("tuples", lambda own: F.transform(own, lambda i: F.col("ids")[i]))
    every = F.zip_with(tuples, F.slice("totals", F.size("ids") + 1, F.size("tuples")), lambda t, n: F.struct(t.alias("tuple"), n.alias("n")))
    listed = whole.select("block", "target", F.size("ids").alias("first"), F.posexplode(every).alias("at", "e"))
    return written(listed.select("block", "target", (F.col("first") + F.col("at")).alias("gram"), "e.*"), "block-tuples")


def hashed_tuples(tuples: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """(tuple, bucket, s, t) of each distinct tuple, its bytes put together and hashed once. Written."""
    counts = written(tuples.groupBy("tuple").agg(*_sides()), "tuple-counts")
    members = counts.select("tuple", F.posexplode("tuple").alias("at", "id"))
    of_id = written(members.groupBy("id").agg(F.count("*").alias("n")), "tuples-of-words")
    total = of_id.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    named = split_join(members, words.select("id", "word"), "id", hot_keys(of_id, "id", "n", total))  # a word can be in a large part of all tuples
    spelt = named.groupBy("tuple").agg(F.sort_array(F.collect_list(F.struct("at", "word")))["word"].alias("spelt"))  # as many as a tuple has words
    spaced = F.transform("spelt", lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit(b" "), w)))
    whole = F.aggregate(spaced, F.lit(b""), lambda a, w: F.concat(a, w))
    return written(spelt.select("tuple", (F.crc32(whole) % buckets).alias("bucket")).join(counts, "tuple"), "hashed-tuples")


def bucket_gains(hashed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets of (bucket, s, t) that occur: at most ``buckets`` rows, written."""
    counts = written(hashed.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")), "bucket-counts")
    S, T = (x or 0.0 for x in counts.agg(F.sum("s"), F.sum("t")).head())
    ratio = ((F.col("t") + 1) * (S + buckets)) / ((F.col("s") + 1) * (T + buckets))
    return written(counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")), "bucket-gains")


def text_weights(texts: DataFrame, of_block: DataFrame, key_type: str) -> DataFrame:
    """(key, n_words, n_features, weight) of each text: the floored mean of its n-grams' gains, which
    ``of_block`` has as (block, gram, gain). Written."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        gain = np.zeros(right.num_rows, np.int64)
        gain[right["gram"].to_numpy()] = right["gain"].to_numpy()
        grams, counts = left["grams"].combine_chunks(), left["counts"].combine_chunks()
        ends = np.concatenate(([0], np.cumsum(grams.value_lengths().to_numpy())))
        steps, n = grams.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        at = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
        own = at[1:] - np.repeat(at[ends[:-1]], np.diff(ends))  # steps start afresh in every text
        total = lambda v: (x := np.concatenate(([0], np.cumsum(v))))[ends[1:]] - x[ends[:-1]]
        features, sums = total(n), total(n * gain[own] if len(own) else n)
        weight = sums // np.maximum(features, 1)
        return pa.table([left["key"], left["n_words"], pa.array(features), pa.array(weight)], names=["key", "n_words", "n_features", "weight"])

    own = texts.select(F.col("block").alias("of"), "key", "n_words", "grams", "counts")
    pairs = own.groupBy("of").cogroup(of_block.groupBy("block"))
    return written(pairs.applyInArrow(run, f"key {key_type}, n_words long, n_features long, weight long"), "text-weights")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a key in thousandths, floored: the same for a key in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / math.exp2(32))))


def resample(
    docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of ``docs``.

    A draw without replacement with probabilities that follow the weights: the ``percent`` of the
    rows of at least ``least_words`` words that have the highest sums of weight and noise get ranks
    1, 2, ...; the other rows have a null rank."""
    kind = docs.schema[key].dataType.simpleString()
    rows = coded(docs, target, max_n, key, text, target_text)
    blocks = rows.filter("words is not null").select("block", "target", "words", "tuples", "totals")
    words = dictionary(blocks, buckets)
    hashed = words.select("bucket", "s", "t")
    if max_n > 1:
        tuples = block_tuples(blocks, words)
        longer = hashed_tuples(tuples, words, buckets)
        hashed = hashed.unionByName(longer.select("bucket", "s", "t"))
    gains = F.broadcast(bucket_gains(hashed, buckets))
    own = blocks.filter("not target").select("block", F.posexplode("words").alias("gram", "word"))
    of_block = own.join(words.filter("s > 0").join(gains, "bucket").select("word", "gain"), "word").select("block", "gram", "gain")
    if max_n > 1:
        of_long = tuples.filter("not target").join(longer.filter("s > 0").join(gains, "bucket").select("tuple", "gain"), "tuple")
        of_block = of_block.unionByName(of_long.select("block", "gram", "gain"))
    texts = text_weights(rows.filter("words is null and not target"), of_block, kind)
    scored = texts.withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = scored.filter(able).count() * percent // 100
    ranked = numbered(scored.filter(able), F.desc("score"), "key", name="rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).withColumnRenamed("key", key)
