"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its five-word shingles (lower case) with their numbers
of occurrences. Two documents are linked where the weighted Jaccard similarity of
their sets is ``THRESHOLD`` or more; a class is a connected component of links.

Signatures. Every unit of weight of an element is a cell, and hashed darts fall on a
cell as a Poisson process along a rank axis that is dealt out in slabs. A dart hits
one of ``COORDINATES`` coordinates; the signature keeps the dart of lowest rank for
each. A set looks only at darts up to a rank inverse to its total weight, so the work
is the number of cells plus ``k ln k`` darts, whatever ``k``. Two sets agree in a
coordinate with probability equal to their similarity.

Candidates. ``BANDS`` bands of ``ROWS`` coordinates are joined; at similarity 0.8 a
pair misses all bands with probability 3e-5. Equal word sequences are collapsed first,
so groups of exact copies are one member. A member is paired with the smallest members
of its buckets, those that it meets in ``MEETINGS`` bands and the one that it meets most,
not with all others; pairs are verified on the whole texts. Documents in buckets that
still hold several components are looked at more closely: two sets of similarity 0.8
share an element among the rarest that make up 0.2 of either one's weight, and what both
hold from the first shared one on must reach the overlap asked for. In rounds, the members
of such an element, one of every component, are each paired with the one that leaves most
room for a partner and with their neighbour in the order of weights, so a round has no
more than two pairs a member; a link that is found joins its components, and the rounds
end when they find few. What is then left to test, members of different
components that share a rare element, is tested pair by pair, split by Spark where an
element is frequent. So no link between components is missed among documents that share a
bucket: members of one component are never paired, and a passage that thousands of
documents hold makes no pairs of them unless it makes up most of their weight.

Null texts are never duplicates. Texts under five words are one shingle: only equal
ones match. Empty texts equal each other. Rows that share a key are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.arrays import U64, Words, code_points, is_space, mix, text_blocks
from papyrine.llm.components import connected_components
from papyrine.workspace import written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5
COORDINATES = BANDS * ROWS
#: Bands in which a member meets the smallest one of its buckets to be paired with it.
MEETINGS = 3
#: Sets of less weight match only equal sets: similarity 0.8 of different ones needs 5.
LEAST_WEIGHT = 4
#: Share of links among its pairs below which a round is the last. It decides about work, not results.
FEW_LINKS = 0.1
#: Members of an element, about, that one task puts in order; each round deals them out anew.
CHUNK = 1_000


def _slabs(limit: float) -> list[tuple[float, float]]:
    """(start, width) of the slabs of the rank axis up to ``limit``; a fixed partition."""
    out, start, width = [], 0.0, 2.0**-10
    while start < limit:
        out.append((start, width))
        start += width
        width = min(start, 64.0)
    return out


def _poisson_limits(mean: float) -> np.ndarray:
    """Distribution function of the Poisson law, up to where nothing is left."""
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 14))
    return np.cumsum(np.exp(-mean + n * np.log(mean) - np.concatenate(([0.0], np.cumsum(np.log(n[1:]))))))


def _unit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(11)) * 2.0**-53


def dart_signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_sets: int, k: int = COORDINATES) -> np.ndarray:
    """``k`` minhashes (0: none) of each of ``n_sets`` weighted sets.

    ``owner`` is the set of each of the hashed ``elements``; weights may be fractions.
    """
    whole = np.ceil(weights).astype(np.int64)
    owner_of = np.repeat(owner, whole)
    nth = np.arange(len(owner_of)) - np.repeat(np.cumsum(whole) - whole, whole)
    cells = mix(np.repeat(elements, whole) + nth.astype(U64) * U64(0xD6E8FEB86659FD93))
    cover = np.minimum(np.repeat(weights, whole) - nth, 1.0)
    total = np.bincount(owner, weights, n_sets)
    reach = np.where(total > 0, k * (np.log(k) + 3) / np.maximum(total, 1e-12), 0.0)
    signature = np.zeros(n_sets * k, U64)
    open_sets = total > 0
    while open_sets.any():
        best = np.full(n_sets * k, np.inf)
        chosen = open_sets[owner_of]
        own, cell, part = owner_of[chosen], cells[chosen], cover[chosen]
        far = reach[own]
        for s, (start, width) in enumerate(_slabs(far.max())):
            inside = far > start
            if not inside.all():
                own, cell, part, far = own[inside], cell[inside], part[inside], far[inside]
            hashed = mix(cell + U64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            darts = np.searchsorted(_poisson_limits(width), _unit(hashed), "right")
            hit = np.flatnonzero(darts)
            many = darts[hit]
            of = np.repeat(hit, many)
            d = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            dart = mix(hashed[of] + (d + 1).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
            rank = start + width * _unit(dart)
            place = mix(dart)
            good = (rank <= far[of]) & (_unit(mix(place + U64(1))) < part[of])
            slot = own[of][good] * k + (place[good] % U64(k)).astype(np.int64)
            rank, dart = rank[good], dart[good]
            np.minimum.at(best, slot, rank)
            first = rank == best[slot]
            signature[slot[first]] = dart[first] | U64(1)
        lacking = np.isinf(best.reshape(n_sets, k)).any(axis=1)
        open_sets &= lacking
        signature.reshape(n_sets, k)[open_sets] = 0
        reach = np.where(open_sets, 2 * reach, reach)
    return signature.reshape(n_sets, k)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, occurrences) of a block, and by text the hash of all its words."""
    points, bounds = code_points([t.lower() for t in texts])
    words = Words(points, bounds, ~is_space(points))
    hashes, text, n_words = words.hashes(), words.text_index(), np.diff(words.of_text)
    n = len(hashes)
    rolled = np.zeros(n, U64)
    for k in range(SHINGLE):
        rolled[: n - k] = mix(rolled[: n - k] * U64(3) + hashes[k:]) if n > k else rolled[: n - k]
    position = np.arange(n) - np.repeat(words.of_text[:-1], n_words)
    whole = position + SHINGLE <= n_words[text]
    alone = (position == 0) & (n_words[text] < SHINGLE)
    at = np.flatnonzero(alone)
    if len(at):  # a short text's only shingle is its words and their number
        size = n_words[text[at]]
        value = size.astype(U64)
        for k in range(SHINGLE - 1):
            value = np.where(k < size, mix(value + hashes[np.minimum(at + k, n - 1)]), value)
        rolled[at] = value
    keep = whole | alone
    text, rolled = text[keep], rolled[keep]
    # one key for (text, shingle): the text's number on top of 44 bits of the shingle to sort by
    order = np.argsort((text.astype(U64) << U64(44)) | (rolled >> U64(20)), kind="stable")
    text, rolled = text[order], rolled[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (rolled[1:] != rolled[:-1])
    starts = np.flatnonzero(new)
    return text[starts], rolled[starts], np.diff(np.append(starts, len(text)))


def word_digests(texts: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each text's word sequence."""
    points, bounds = code_points([t.lower() for t in texts])
    words = Words(points, bounds, ~is_space(points))
    hashes, text = words.hashes(), words.text_index()
    position = (np.arange(len(hashes)) - np.repeat(words.of_text[:-1], np.diff(words.of_text))).astype(U64)
    out = np.zeros((len(texts), 2), U64)
    for j, step in enumerate((0x9E3779B97F4A7C15, 0xA0761D6478BD642F)):
        np.add.at(out[:, j], text, mix(mix(hashes ^ U64(step)) + position * U64(step)))
    return out.view(np.int64)


def band_hashes(texts: list[str]) -> list[np.ndarray | None]:
    """``BANDS`` hashes of each text's signature; none where only equal texts can match."""
    text, elements, counts = shingles(texts)
    total = np.bincount(text, counts, len(texts))
    able = total[text] >= LEAST_WEIGHT
    signature = dart_signatures(text[able], elements[able], counts[able].astype(np.float64), len(texts))
    parts = signature.reshape(len(texts), BANDS, ROWS)
    folded = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(texts), BANDS)).copy()
    for r in range(ROWS):
        folded = mix(folded * U64(3) + parts[:, :, r])
    return [row if w >= LEAST_WEIGHT else None for row, w in zip(folded.view(np.int64), total)]


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    out = []
    sizes = [a + b for a, b in zip(left, right)]
    for a, b in text_blocks(sizes):
        keys, owners, counts = [], [], []
        for texts in (left[a:b], right[a:b]):
            text, elements, n = shingles(texts)
            keys.append(mix(elements + mix(text.astype(U64) + U64(1))))
            owners.append(text)
            counts.append(n)
        _, i, j = np.intersect1d(keys[0], keys[1], assume_unique=True, return_indices=True)
        shared = np.bincount(owners[0][i], np.minimum(counts[0][i], counts[1][j]), b - a)
        total = sum(np.bincount(o, n, b - a) for o, n in zip(owners, counts)) - shared
        out.append(np.divide(shared, total, out=np.zeros(b - a), where=total > 0))
    return np.concatenate(out) if out else np.zeros(0)


def _sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, d1, d2, bands) of every document with a text."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].tolist()
            for a, b in text_blocks(texts):
                digest = word_digests(texts[a:b])
                yield pd.DataFrame({"key": batch["key"].iloc[a:b].to_numpy(), "d1": digest[:, 0], "d2": digest[:, 1], "bands": band_hashes(texts[a:b])})

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("_text")).dropna()
    return rows.mapInPandas(of, f"key {docs.schema[key].dataType.simpleString()}, d1 long, d2 long, bands array<long>")


def _bodies(members: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(rep, body): the whole texts of ``members``, one row a key."""
    bodies = docs.select(F.col(key).alias("rep"), F.col(text).alias("body")).join(members.select("rep").distinct(), "rep", "left_semi")
    return written(bodies.groupBy("rep").agg(F.max("body").alias("body")), "candidate-texts")


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(a, b, similarity) of every pair, from the whole texts."""
    similarity = F.pandas_udf(lambda x, y: pd.Series(similarities(x.tolist(), y.tolist())), "double")
    joined = pairs.join(bodies.toDF("a", "ta"), "a").join(bodies.toDF("b", "tb"), "b")
    return written(joined.select("a", "b", similarity("ta", "tb").alias("similarity")), "similarities")


def _linked(tested: DataFrame) -> DataFrame:
    return tested.filter(F.col("similarity") >= THRESHOLD)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links) of every document: the smallest key of its class, and the number of
    links of its word sequence that were verified on the way to the class (not all that it has).
    Rows with a null key are left out."""
    sketch = written(_sketch(docs, key, text), "sketches")
    classes = written(sketch.groupBy("d1", "d2").agg(F.min("key").alias("rep"), F.first("bands", ignorenulls=True).alias("bands")), "classes")
    # a hash holds its band's number, so buckets of different bands never meet
    banded = classes.filter("bands is not null").select("rep", F.explode("bands").alias("hash"))
    ends = banded.groupBy("hash").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("hash", "low")
    # documents in a bucket with another document, and the bucket's smallest one
    buckets = written(banded.join(written(ends, "bucket-ends"), "hash"), "buckets")
    bodies = _bodies(buckets, docs, key, text)
    meetings = buckets.filter("low <> rep").groupBy("rep", "low").agg(F.count("*").alias("n"))
    most = meetings.groupBy("rep").agg(F.max_by("low", F.struct("n", "low")).alias("low"))
    often = meetings.filter(F.col("n") >= MEETINGS).select("rep", "low")
    pairs = often.union(most.select("rep", "low")).distinct().select(F.col("low").alias("a"), F.col("rep").alias("b"))
    tested = _verified(pairs, bodies)
    labels = connected_components(_linked(tested)).toDF("rep", "root")
    labelled = buckets.join(labels, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    spread = labelled.groupBy("hash").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("hash")
    mixed = written(labelled.join(spread, "hash").groupBy("rep").agg(F.min("root").alias("root")), "mixed-documents")
    tested = _between_components(mixed, tested, bodies)
    links = _linked(tested)
    roots = connected_components(links)
    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    of_class = classes.select("d1", "d2", "rep").join(roots.toDF("rep", "root"), "rep", "left").join(degree, "rep", "left")
    of_class = of_class.select("d1", "d2", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    found = sketch.select("key", "d1", "d2").join(of_class, ["d1", "d2"]).groupBy("key").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    without = docs.filter(F.col(text).isNull() & F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    without = without.join(found, "key", "left_anti").select("key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(without).withColumnRenamed("key", key)


def _weighted_shingles(mixed: DataFrame, bodies: DataFrame) -> DataFrame:
    """(rep, shingle, weight, total) of every shingle of the given documents."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["body"].tolist()
            for a, b in text_blocks(texts):
                owner, elements, counts = shingles(texts[a:b])
                total = np.bincount(owner, counts, b - a)
                keys = batch["rep"].to_numpy()[a + owner]
                yield pd.DataFrame({"rep": keys, "shingle": elements.view(np.int64), "weight": counts.astype(float), "total": total[owner]})

    kind = mixed.schema["rep"].dataType.simpleString()
    return bodies.join(mixed.select("rep"), "rep", "left_semi").mapInPandas(of, f"rep {kind}, shingle long, weight double, total double")


def _rare_elements(mixed: DataFrame, bodies: DataFrame) -> DataFrame:
    """(shingle, df, rep, total, rest): the elements of each document's rarest fifth that another document
    has too, how many have it, and the weight of the document from there on, in the order of rareness."""
    every = written(_weighted_shingles(mixed, bodies), "shingles")
    frequency = every.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    shared = every.join(frequency, "shingle")
    # elements of one document; those held by no other come first and are not rows here
    rarest = Window.partitionBy("rep").orderBy("df", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("rep")
    before = F.col("total") - F.sum("weight").over(own) + F.coalesce(F.sum("weight").over(rarest), F.lit(0.0))
    prefix = shared.withColumn("before", before).filter(F.col("before") <= (1 - THRESHOLD) * F.col("total") + 1e-6)
    return written(prefix.select("shingle", "df", "rep", "total", (F.col("total") - F.col("before")).alias("rest")), "rare-elements")


def _enough(left: str, right: str) -> Column:
    """Whether what two documents hold from a shared element on can make up a link."""
    total = F.col(f"{left}.total") + F.col(f"{right}.total")
    return F.least(f"{left}.rest", f"{right}.rest") >= THRESHOLD / (1 + THRESHOLD) * total - 1e-6


def _between_components(mixed: DataFrame, tested: DataFrame, bodies: DataFrame) -> DataFrame:
    """``tested`` and the pairs tested between the components of ``mixed`` (rep, root)."""
    rare = _rare_elements(mixed, bodies)
    ordered = [F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")]
    turn = 0
    while True:
        # one member of every component that an element has: at first the one with the most room for
        # a partner's weight, later any
        room = (1 + THRESHOLD) / THRESHOLD * F.col("rest") - F.col("total")
        choice = -room if turn == 0 else F.xxhash64("rep", F.lit(turn))
        member = F.struct("rep", "root", "total", "rest", "df", room.alias("room"))
        one = rare.join(mixed, "rep").groupBy("shingle", "root").agg(F.min_by(member, F.struct(choice, "rep")).alias("m"))
        one = written(one.select("shingle", "m.*", F.pmod(F.xxhash64("root", F.lit(turn)), F.ceil(F.col("m.df") / CHUNK)).alias("chunk")), "members")
        # it meets the element's member with the most room, and the next of about its own weight
        roomy = one.groupBy("shingle").agg(F.max_by(F.struct("rep", "root", "total", "rest"), F.struct("room", "rep")).alias("r"), F.count("*").alias("n"))
        roomy = written(roomy.filter("n > 1").select("shingle", "r"), "roomy-members")
        own = F.struct("rep", "root", "total", "rest").alias("l")
        beside = Window.partitionBy("shingle", "chunk").orderBy("total", "rep")
        met = one.join(roomy, "shingle").select(own, "r").filter("l.root <> r.root")
        met = met.unionByName(one.filter("room >= total").select(own, F.lag(F.struct("rep", "root", "total", "rest")).over(beside).alias("r"))).filter(_enough("l", "r"))
        more = _verified(met.select(*ordered).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), bodies)
        tested = tested.unionByName(more)
        tried, found = more.agg(F.count("*"), F.count_if(F.col("similarity") >= THRESHOLD)).first()
        if found:
            ends = mixed.select("rep", "root")
            joined = _linked(more).join(ends.toDF("a", "ra"), "a").join(ends.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            moved = connected_components(joined).toDF("root", "new")
            mixed = written(mixed.join(moved, "root", "left").select("rep", F.coalesce("new", "root").alias("root")), "mixed-documents")
        turn += 1
        if found <= FEW_LINKS * tried:
            break
    labelled = rare.join(mixed, "rep")
    left, right = labelled.alias("l"), labelled.alias("r")
    rest = left.join(right, F.expr("l.shingle = r.shingle and l.rep < r.rep and l.root <> r.root") & _enough("l", "r"))
    rest = rest.select(*ordered).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    return tested.unionByName(_verified(rest, bodies))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents whose class has a smaller key."""
    gone = written(near_duplicates(docs, key, text).filter(F.col(key) != F.col("class_id")).select(key), "duplicates")
    return docs.join(gone, key, "left_anti").select(*docs.columns)
