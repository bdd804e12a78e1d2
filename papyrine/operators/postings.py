"""A positional posting index over the names of a registry.

Three tables, written once with a snapshot: the records in their order (``_place`` tells it), the
postings (token, record, position) and the vocabulary (token, records that hold it), both sorted by
token, so a whole token is a point and the beginning of one a range that Parquet's statistics prune
by. Postings are ranged too; a token that very many records hold is spread over many files.

A query is a list of words that must all be held. A word of several tokens is a phrase: its tokens
stand side by side in one name of the record; names of other languages or kinds are apart. Unless whole words are asked for, the last token of each word may only begin one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.names import query_tokens
from papyrine.operators.numbering import PLACE, placed
from papyrine.workspace import fresh_path

#: Beyond every character that a token can hold.
LAST_CHARACTER = "\U0010ffff"
#: Positions of a record's next name start so much later.
NAME_GAP = 1 << 20
POSTINGS = "token string, record long, position int"
VOCABULARY = "token string, records long"


@dataclass(frozen=True)
class Term:
    """One token of a query: the word it is of, its place in it, and whether it may only begin a token."""

    word: int
    offset: int
    token: str
    prefix: bool

    def condition(self) -> Column:
        if not self.prefix:
            return F.col("token") == self.token
        return (F.col("token") >= self.token) & (F.col("token") < self.token + LAST_CHARACTER)


def terms_of(words: list[str], whole: bool) -> list[list[Term]]:
    """The terms of each normalised word. A word without a letter or digit has none."""
    split = [query_tokens(w) for w in words]
    return [[Term(at, i, t, i == len(tokens) - 1 and not whole) for i, t in enumerate(tokens)] for at, tokens in enumerate(split)]


def _occurrences(tokens: Column, first: int) -> Column:
    held = F.coalesce(tokens, F.array().cast("array<string>"))
    return F.transform(held, lambda t, i: F.struct((i + first).alias("position"), t.alias("token")))


@dataclass(frozen=True)
class NameIndex:
    """The index of one table; ``records`` has the table's columns and ``_place``."""

    records: DataFrame
    postings: DataFrame
    vocabulary: DataFrame

    @classmethod
    def build(cls, table: DataFrame, tokens: list[Column], order: list[str], path: str | None = None) -> NameIndex:
        """Write the index of ``table`` at ``path``. ``tokens`` are arrays, one a name of the record, null
        or empty where it lacks that name."""
        spark = table.sparkSession
        path = path or fresh_path(spark, "name-index")
        placed(table, *order, path=f"{path}/records")
        records = spark.read.parquet(f"{path}/records")
        names = [_occurrences(t, i * NAME_GAP) for i, t in enumerate(tokens)]
        every = records.select(F.col(PLACE).alias("record"), F.inline(F.concat(*names))).select("token", "record", "position")
        every.repartitionByRange("token", "record", "position").sortWithinPartitions("token", "record", "position").write.parquet(f"{path}/postings")
        counts = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("token").agg(F.count_distinct("record").alias("records"))
        counts.sortWithinPartitions("token").write.parquet(f"{path}/vocabulary")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> NameIndex:
        return cls(spark.read.parquet(f"{path}/records"), spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary"))

    def frequencies(self, terms: list[Term]) -> list[int]:
        """Records that each term may be in (of a beginning: summed over its tokens): one number a term."""
        sums = [F.coalesce(F.sum(F.when(t.condition(), F.col("records"))), F.lit(0)).alias(f"n{i}") for i, t in enumerate(terms)]
        wanted = terms[0].condition()
        for t in terms[1:]:
            wanted |= t.condition()
        return list(self.vocabulary.filter(wanted).agg(*sums).head())

    def _held(self, term: Term) -> DataFrame:
        """(record, start): where the term's word would begin."""
        return self.postings.filter(term.condition()).select("record", (F.col("position") - term.offset).alias("start")).distinct()

    def matches(self, words: list[str], whole: bool = False) -> DataFrame:
        """(record) of the records that hold every word; the rarest word is looked up first and the
        others meet what it has left. No words, or a word without a letter or digit, match nothing."""
        phrases = terms_of(words, whole)
        every = [t for phrase in phrases for t in phrase]
        rare = dict(zip(every, self.frequencies(every))) if phrases and all(phrases) else {}
        if not rare or not all(rare.values()):
            return self.postings.filter("false").select("record")
        found = None
        for phrase in sorted(phrases, key=lambda p: min(rare[t] for t in p)):
            by_rarity = sorted(phrase, key=rare.__getitem__)
            held = self._held(by_rarity[0])
            for term in by_rarity[1:]:
                held = held.join(self._held(term), ["record", "start"])
            held = held.select("record").distinct()
            found = held if found is None else found.join(held, "record", "left_semi")
        return found

    def first_records(self, matches: DataFrame, limit: int) -> tuple[DataFrame, int]:
        """(the first ``limit`` matched records in the table's order, all matches' number). The places of
        at most ``limit`` + 1 records pass the driver and prune the files of records."""
        top = [r.record for r in matches.orderBy("record").limit(limit + 1).collect()]
        return self.records.filter(F.col(PLACE).isin(top[:limit])), matches.count() if len(top) > limit else len(top)
