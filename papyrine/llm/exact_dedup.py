"""Exact deduplication by progressive refinement, with builtin functions only.

Texts are equal when they are identical after every blank (U+0020, U+0009 to U+000D) is deleted.
Rows are grouped by the length of that text, the groups are refined by the hash of its first
``PREFIX_CHARS`` characters, and only rows of groups that still hold two rows or more are hashed
whole (SHA-256). Lengths and prefixes are counted before any join, so a text with a third of all
rows is one row of these tables.

Of equal texts the row with the most code points in its original text stays, then the smallest
key; a null key comes after all others, and of rows that repeat even the key one stays. Null texts
count as empty. Columns of the table other than key and text take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.hot_keys import HOT, hot_keys
from papyrine.workspace import written

PREFIX_CHARS = 64
#: Surviving (length, prefix) pairs that are broadcast at most (16 bytes each); more are joined by shuffle.
BROADCAST_PAIRS = 200_000
#: The blanks (fixed values).
BLANKS = " \t\n\x0b\x0c\r"


def without_blanks(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _levels(docs: DataFrame, text: str) -> DataFrame:
    """(key, n_chars, bare text, its length in bytes, its prefix hash), whatever the names in ``docs``."""
    bare = docs.select("_id", F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_chars"), without_blanks(F.col(text)).alias("_bare"))
    return bare.withColumns({"_length": F.octet_length("_bare"), "_prefix": F.xxhash64(F.left("_bare", F.lit(PREFIX_CHARS)))})


def surviving_pairs(levels: DataFrame) -> DataFrame:
    """(length, prefix, n) of the groups of two rows or more: by length first, then by prefix."""
    pairs = written(levels.groupBy("_length", "_prefix").agg(F.count("*").alias("_n")), "pairs")
    lengths = pairs.groupBy("_length").agg(F.sum("_n").alias("_rows")).filter("_rows > 1")
    return written(pairs.join(lengths, "_length", "left_semi").filter("_n > 1"), "surviving-pairs")


def _marked(levels: DataFrame, pairs: DataFrame, total: int) -> DataFrame:
    """``levels`` with ``_n``, null where no other row can be equal."""
    on = ["_length", "_prefix"]
    if pairs.count() <= BROADCAST_PAIRS:
        return levels.join(F.broadcast(pairs), on, "left")
    hot = F.broadcast(pairs.filter(F.col("_n") * HOT > total))  # under HOT rows
    rest = levels.join(hot, on, "left_anti").join(pairs, on, "left")
    return rest.unionByName(levels.join(hot, on))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    ``text_sha256`` is null for rows that the first two levels found alone, unless ``digest`` asks
    for it."""
    levels = _levels(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_text")
    marked = _marked(levels, surviving_pairs(levels), docs.count())
    whole = F.sha2(F.col("_bare").cast("binary"), 256)
    alone = F.col("_n").isNull()
    hashed = written(
        marked.select("_id", "_chars", alone.alias("_alone"), (whole if digest else F.when(~alone, whole)).alias("_sha")).withColumn("_place", F.monotonically_increasing_id()), "whole-hashes"
    )
    tied = hashed.filter("not _alone").withColumn("_rank", F.struct(-F.col("_chars"), F.col("_id").isNull(), F.col("_id"), F.col("_place")))
    groups = written(tied.groupBy("_sha").agg(F.count("*").alias("_size"), F.min("_rank").alias("_best")), "text-groups")
    hot = F.broadcast(hot_keys(groups, "_sha", "_size", hashed.count()))
    few = F.broadcast(groups.join(hot, "_sha", "left_semi"))
    rest = tied.join(hot, "_sha", "left_anti").join(groups, "_sha")
    out = [F.col("_id").alias(key), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256")]
    same = tied.join(few, "_sha").unionByName(rest)
    same = same.withColumns({"keep_id": F.col("_best")["_id"], "group_size": F.col("_size"), "kept": F.col("_best")["_place"] == F.col("_place")})
    single = hashed.filter("_alone").withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return single.select(*out).unionByName(same.select(*out))
