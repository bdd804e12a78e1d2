"""Character n-gram language models with Kneser-Ney smoothing, counted and looked up by Spark.

Every text position is one n-gram of ``ORDER`` character classes, packed into 64 bits (16 a
class), so lower orders are bit masks of it. A character of the basic plane is a class of its
own; those beyond share 2,048 classes, and a model gives probabilities of classes. Tasks
pre-aggregate their partition and emit distinct (group, n-gram, count) rows; Spark sums them and
derives the continuation counts of the lower orders. Counts are exact and none is dropped: the
model is a table, sorted by packed n-gram, that grows with the corpus.

Scoring never moves the model as a whole. The log probability of every distinct n-gram is worked
out by joins of its suffixes with the tables of the orders. Texts are dealt out in blocks of
about ``BLOCK_CHARS`` characters; the distinct n-grams of a block are joined with their log
probabilities, and a task gets a block's texts with a sorted array of its own n-grams, which it
looks up by binary search. What a task holds is bounded by its block, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.arrays import U64, distinct_inverse, mix, sums_by_text, text_blocks
from papyrine.workspace import written

ORDER = 4
CLASS_BITS = 16
#: Rows that a task keeps before it emits what it has counted so far.
EMIT_ROWS = 2_000_000
#: Characters of the texts that one task looks up together.
BLOCK_CHARS = 1 << 24
#: Log probabilities are whole multiples of this, so their sums are exact and equal texts have equal sums.
GRAIN = 2.0**-24


def _folded(points: np.ndarray) -> np.ndarray:
    # 0 and 1 stand for other things: their characters take two code points that no character has
    low = np.where(points < 2, 0xFFFE + points, points)
    return np.where(points < 0x10000, low, 0xD800 + (mix(points) % U64(2048)).astype(np.int64)).astype(np.uint16)


@lru_cache(maxsize=2)
def alphabet(kind: str) -> np.ndarray:
    """Class of each code point. ``letters``: lower-cased letters, all else one class;
    ``all``: every character, digits one class."""
    points = np.arange(0x110000)
    if kind == "letters":
        lower = np.fromiter((ord(chr(p).lower()[0]) if chr(p).isalpha() else 0 for p in range(0x110000)), np.int64, 0x110000)
        return np.where(lower > 0, _folded(lower), 1).astype(np.uint16)
    digit = np.fromiter((chr(p).isdigit() for p in range(0x110000)), bool, 0x110000)
    return np.where(digit, 1, _folded(points)).astype(np.uint16)


def ngram_keys(texts: list[str], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram ending at each character, first character of each text and the end, classes)."""
    pad = ORDER - 1
    gap = "\n" * pad
    points = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    inside = np.ones(len(points), bool)
    starts = pad + np.concatenate(([0], np.cumsum(lengths + pad)))[:-1]
    for k in range(1, pad + 1):
        inside[starts - k] = False
    classes = np.where(inside, alphabet(kind)[points], 0).astype(U64)
    keys = classes.copy()
    for k in range(1, ORDER):
        keys[k:] |= classes[:-k] << U64(CLASS_BITS * k)
    return keys[inside], np.concatenate(([0], np.cumsum(lengths))), classes[inside]


def count_ngrams(df: DataFrame, group: str, text: str, kind: str) -> DataFrame:
    """(grp, gram, c): occurrences of every n-gram of the highest order, over all rows.

    Null texts have none; a null group is a group."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def emit() -> Iterator[pd.DataFrame]:
            for grp, parts in held.items():
                grams, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
                for i in range(0, len(grams), 100_000):
                    yield pd.DataFrame({"grp": grp, "gram": grams[i : i + 100_000].view(np.int64), "c": counts[i : i + 100_000]})

        for batch in batches:
            for grp, part in batch.groupby("grp", dropna=False):
                texts = part["text"].tolist()
                for a, b in text_blocks(texts):
                    keys, _, _ = ngram_keys(texts[a:b], kind)
                    if not len(keys):
                        continue
                    grams, inverse = distinct_inverse(keys)
                    held.setdefault(grp if isinstance(grp, str) else None, []).append((grams, np.bincount(inverse)))
                    size += len(grams)
                    if size > EMIT_ROWS:
                        yield from emit()
                        held, size = {}, 0
        yield from emit()

    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(text).alias("text")).filter("text is not null")
    return rows.mapInPandas(counted, "grp string, gram long, c long").groupBy("grp", "gram").agg(F.sum("c").alias("c"))


def _suffix(gram: Column, order: int) -> Column:
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << CLASS_BITS * order) - 1))


def all_orders(top: DataFrame) -> DataFrame:
    """(grp, k, gram, c): counts for the highest order, continuation counts for the lower ones."""
    longer = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _suffix(F.col("gram"), k + 1).alias("gram")) for k in range(1, ORDER)]))
    seen = top.select("grp", longer.alias("x")).select("grp", "x.k", "x.gram").distinct()
    shorter = F.coalesce(*[F.when(F.col("k") == k, _suffix(F.col("gram"), k)) for k in range(1, ORDER)])
    lower = seen.groupBy("grp", "k", shorter.alias("gram")).agg(F.count("*").alias("c"))
    return lower.unionByName(top.select("grp", F.lit(ORDER).alias("k"), "gram", "c"))


def _discounts(n: list[int], modified: bool) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from the counts of counts n1 to n4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    if not modified:
        return y, y, y
    own = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3)]
    return tuple(min(max(d, 0.05), i) for i, d in zip((1, 2, 3), own))  # type: ignore[return-value]


def _shapes(orders: DataFrame, modified: bool) -> DataFrame:
    """(grp, k, types, d1, d2, d3): n-grams and discounts of each order."""
    c = F.col("c")
    counts = orders.groupBy("grp", "k").agg(*[F.count_if(c == i).alias(f"n{i}") for i in range(1, 5)], F.count("*").alias("types"))

    def discounts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = [_discounts([int(r[i]) for i in range(4)], modified) for r in batch[["n1", "n2", "n3", "n4"]].itertuples(index=False)]
            yield pd.concat((batch[["grp", "k", "types"]], pd.DataFrame(d, columns=["d1", "d2", "d3"], index=batch.index)), axis=1)

    return counts.mapInPandas(discounts, "grp string, k int, types long, d1 double, d2 double, d3 double")


def _discount(c: Column) -> Column:
    return F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def _left_over(c: Column) -> Column:
    """What of a count is left after its discount."""
    return F.greatest(c - _discount(c), F.lit(0.0))


def _whole_grains(p: Column) -> Column:
    return F.rint(F.log(p) / GRAIN) * GRAIN


def own_log_table(top: DataFrame, modified: bool) -> DataFrame:
    """(grp, gram, log_p) of the counted n-grams ``top`` under the model of their own counts: what
    :meth:`Model.log_table` gives for them, in fewer joins. Every suffix of a counted n-gram is a counted one, and a context has no more n-grams than there are classes."""
    orders = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = orders[k + 1].groupBy("grp", _suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("c"))
    shorter = None
    for k in range(1, ORDER + 1):
        own = orders[k].withColumn("k", F.lit(k))
        rows = own.join(_shapes(own, modified), ["grp", "k"]).withColumn("context", F.shiftrightunsigned("gram", CLASS_BITS))
        of_context = Window.partitionBy("grp", "context")
        total, held_back = F.sum("c").over(of_context), F.sum(_discount(F.col("c"))).over(of_context)
        rows = rows.select("grp", "gram", "types", (_left_over(F.col("c")) / total).alias("part"), (held_back / total).alias("weight"))
        if shorter is None:
            shorter = rows.select("grp", "gram", (F.col("part") + F.col("weight") / (F.col("types") + 1)).alias("p"))
        else:
            rest = shorter.select("grp", F.col("gram").alias("rest"), "p")
            rows = rows.withColumn("rest", _suffix(F.col("gram"), k - 1)).join(rest, ["grp", "rest"])
            shorter = rows.select("grp", "gram", (F.col("part") + F.col("weight") * F.col("p")).alias("p"))
    return shorter.select("grp", "gram", _whole_grains(F.col("p")).alias("log_p"))


@dataclass
class Model:
    """Tables of one model: ``grams`` (grp, k, gram, discounted count), ``contexts`` (grp, k,
    context, total, back-off weight) and ``classes`` (grp, base: the probability of any class)."""

    kind: str
    grams: DataFrame
    contexts: DataFrame
    classes: DataFrame

    def log_table(self, needed: DataFrame) -> DataFrame:
        """(grp, gram, log_p) of every row of ``needed`` (grp, gram): the natural log of the
        interpolated probability of an n-gram's last character. Groups without a model give none."""
        wanted = {ORDER: needed.select("grp", "gram").distinct()}
        for k in range(ORDER - 1, 0, -1):
            wanted[k] = wanted[k + 1].select("grp", _suffix(F.col("gram"), k).alias("gram")).distinct()
        shorter = self.classes.select("grp", F.col("base").alias("p"))
        for k in range(1, ORDER + 1):
            own = self.grams.filter(F.col("k") == k).select("grp", "gram", "discounted")
            context = self.contexts.filter(F.col("k") == k).select("grp", "context", "total", "weight")
            rows = wanted[k].withColumn("context", F.shiftrightunsigned("gram", CLASS_BITS))
            rows = rows.join(own, ["grp", "gram"], "left").join(context, ["grp", "context"], "left")
            if k > 1:
                rows = rows.withColumn("rest", _suffix(F.col("gram"), k - 1)).join(shorter.withColumnRenamed("gram", "rest"), ["grp", "rest"])
            else:
                rows = rows.join(shorter, "grp")
            p = F.coalesce("discounted", F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("p")
            shorter = rows.select("grp", "gram", F.coalesce(p, "p").alias("p"))
        return shorter.select("grp", "gram", _whole_grains(F.col("p")).alias("log_p"))

    def log_probs(self, keys: np.ndarray, groups: list[str]) -> np.ndarray:
        """Log probabilities of a few n-grams by group, for a look at a model."""
        spark = self.grams.sparkSession
        rows = spark.createDataFrame([(g, int(x)) for g in groups for x in np.unique(keys).view(np.int64)], "grp string, gram long")
        found = {(r["grp"], r["gram"]): r["log_p"] for r in self.log_table(rows).collect()}
        return np.array([[found[g, int(x)] for g in groups] for x in keys.view(np.int64)], np.float64)


def model_of(top: DataFrame, kind: str, modified: bool) -> Model:
    """The smoothed model of counted n-grams ``top`` (grp, gram, c); rows with a null group do not count."""
    orders = written(all_orders(top.filter("grp is not null")), "ngram-orders")
    c = F.col("c")
    shapes = written(_shapes(orders, modified), "discounts")
    discounted = orders.join(shapes, ["grp", "k"])
    grams = written(discounted.select("grp", "k", "gram", _left_over(c).alias("discounted")).sortWithinPartitions("grp", "k", "gram"), "ngram-model")
    contexts = (
        orders.groupBy("grp", "k", F.shiftrightunsigned("gram", CLASS_BITS).alias("context"))
        .agg(F.sum("c").alias("total"), F.count_if(c == 1).alias("n1"), F.count_if(c == 2).alias("n2"), F.count_if(c > 2).alias("n3"))
        .join(shapes, ["grp", "k"])
        .select("grp", "k", "context", "total", ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("weight"))
    )
    contexts = written(contexts.sortWithinPartitions("grp", "k", "context"), "ngram-contexts")
    return Model(kind, grams, contexts, shapes.filter("k = 1").select("grp", (1 / (F.col("types") + 1)).alias("base")))


def fit(df: DataFrame, group: str, text: str, kind: str, modified: bool) -> Model:
    """Count all rows of ``df`` and return the smoothed model of each group."""
    return model_of(written(count_ngrams(df, group, text, kind), "ngram-counts"), kind, modified)


#: From a block's carried columns, its texts, their sums of log probabilities (a column a model) and
#: their numbers of characters, the rows to return.
Judge = Callable[[pd.DataFrame, list[str], np.ndarray, np.ndarray], pd.DataFrame]


def _packed_blocks(docs: DataFrame, carried: Sequence[str], text: str, group: Column) -> DataFrame:
    """(_block, _grp, _z, _c0, ...) of every row, by block."""
    n_chars = docs.agg(F.sum(F.char_length(text).cast("long"))).first()[0] or 0
    n_blocks = -(-max(n_chars, 1) // BLOCK_CHARS)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        return texts.map(lambda t: pack(t.encode("utf-8", "surrogatepass")))

    block = F.pmod(F.xxhash64(*carried, text), F.lit(n_blocks)).cast("int").alias("_block")
    rows = docs.select(block, group.cast("string").alias("_grp"), packed(text).alias("_z"), *[F.col(x).alias(f"_c{i}") for i, x in enumerate(carried)])
    return rows.repartition(n_blocks, "_block")


def _unpacked(part: pd.DataFrame) -> list[str]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(z).decode("utf-8", "surrogatepass") for z in part["_z"]]


def _block_ngrams(rows: DataFrame, kind: str) -> DataFrame:
    """(_block, grp, gram): the distinct n-grams of each group in each block."""

    def distinct(part: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"_block": [], "grp": [], "gram": []}).astype({"_block": "int32", "grp": object, "gram": "int64"})]
        for grp, some in part.groupby("_grp"):
            texts = _unpacked(some)
            found = [distinct_inverse(ngram_keys(texts[a:b], kind)[0])[0] for a, b in text_blocks(texts)]
            grams = np.unique(np.concatenate([*found, np.empty(0, U64)]))
            out.append(pd.DataFrame({"_block": part["_block"].iloc[0], "grp": grp, "gram": grams.view(np.int64)}))
        return pd.concat(out, ignore_index=True)

    return rows.groupBy("_block").applyInPandas(distinct, "_block int, grp string, gram long")


def judged(docs: DataFrame, carried: Sequence[str], text: str, group: str | None, kind: str, logs: DataFrame, judge: Judge, schema: str) -> DataFrame:
    """``judge`` over all rows of ``docs``, block by block.

    ``logs`` has a row for every n-gram (``gram``; with ``group``, ``grp`` and ``gram``) of the texts and
    a column of log probabilities a model. Texts and groups must not be null. The texts are shuffled
    once: both uses of their exchange, for a block's n-grams and to look them up, have the same plan."""
    columns = [x for x in logs.columns if x not in ("grp", "gram")]
    rows = _packed_blocks(docs, carried, text, F.col(group) if group else F.lit(""))
    grams = _block_ngrams(rows, kind)
    known = grams.join(logs, ["grp", "gram"]) if group else grams.drop("grp").join(logs, "gram").withColumn("grp", F.lit(""))

    def look_up(part: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        texts = _unpacked(part)
        sums, sizes = np.zeros((len(texts), len(columns))), np.zeros(len(texts), np.int64)
        tables = {grp: x for grp, x in table.groupby("grp")}
        for grp, some in part.reset_index(drop=True).groupby("_grp"):
            at = some.index.to_numpy()
            if grp not in tables:  # texts without a character
                continue
            grams = tables[grp]["gram"].to_numpy().view(U64)
            order = np.argsort(grams)
            grams, values = grams[order], tables[grp][columns].to_numpy(np.float64)[order]
            own = [texts[i] for i in at]
            for a, b in text_blocks(own):
                keys, bounds, _ = ngram_keys(own[a:b], kind)
                if len(keys):
                    unique, inverse = distinct_inverse(keys)
                    sums[at[a:b]] = sums_by_text(values[np.searchsorted(grams, unique)][inverse], bounds)
                sizes[at[a:b]] = np.diff(bounds)
        return judge(part[[f"_c{i}" for i in range(len(carried))]].set_axis(list(carried), axis=1), texts, sums, sizes)

    return rows.groupBy("_block").cogroup(known.groupBy("_block")).applyInPandas(look_up, schema)


def scored(df: DataFrame, columns: list[str], score: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``score`` over Arrow batches of ``columns``."""
    return df.select(*columns).mapInPandas(lambda batches: (score(b) for b in batches if len(b)), schema)
