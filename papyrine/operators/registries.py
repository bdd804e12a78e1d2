"""Search of registry snapshots and screening of read documents against them.

Registry tables carry their name tokens (``tokens``, from
:func:`papyrine.functions.names.name_tokens`) and, where the source prints numbers as text,
their distinct numbers (``ids``); both are built once at load time.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.identifiers import SAFE_INTEGER, number_of_digits
from papyrine.functions.names import holds_phrase, name_matches, normalized_name, tokens_of
from papyrine.operators.numbering import PLACE
from papyrine.operators.postings import NameIndex
from papyrine.workspace import written

# Sources in order, the search fields that each carries, and lookup keys in order.
CARRIED = {
    "boi_accounts": ["bank", "branch", "account"],
    "boi_severe": ["id", "name"],
    "nbctf_individuals": ["id", "name"],
    "nbctf_orgs": ["id", "name"],
    "companies": ["id", "name"],
}
ID_SOURCES = ["boi_severe", "nbctf_individuals", "nbctf_orgs", "companies"]
LOOKUP_KEYS = ["id_number", "spouse_id_number", "child_id_number", "drawer_id_number", "guarantor_id_number", "account", "name_he", "name_en"]
ACTIVE_COMPANY = "פעילה"
RESULT_LIMIT, MATCH_LIMIT = 50, 10
#: Order of each source's rows.
ORDER = {"boi_accounts": ["bank", "branch", "account"], "boi_severe": ["id_number"], "nbctf_individuals": ["seq"], "nbctf_orgs": ["seq"], "companies": ["number"]}
NUMBER_COLUMN = {"boi_severe": "id_number", "companies": "number"}


def _plain_name(text: str) -> str:
    """The query side of :func:`papyrine.functions.names.normalized_name`."""
    import re
    import unicodedata

    out = re.sub("[־‐-―-]", " ", unicodedata.normalize("NFC", text))
    out = re.sub("[׳״'\"`~]", "", re.sub("[֑-ֽֿ-ׇً-ٰٟـ]", "", out))
    return " ".join(out.lower().split())


@dataclass
class Query:
    """A registry query: numbers, or null, and the words of a name."""

    id: int | None = None
    bank: int | None = None
    branch: int | None = None
    account: int | None = None
    name: list[str] = field(default_factory=list)

    @classmethod
    def parsed(cls, params: Mapping[str, str]) -> Query:
        def number(text: str) -> int | None:
            digits = "".join(c for c in text if c in "0123456789")
            return int(digits) if digits and int(digits) <= SAFE_INTEGER else None

        return cls(*[number(params.get(f, "")) for f in ("id", "bank", "branch", "account")], _plain_name(params.get("name", "")).split())

    @property
    def filled(self) -> list[str]:
        return [f for f in ("id", "bank", "branch", "account") if getattr(self, f) is not None] + ["name"] * bool(self.name)

    @property
    def valid(self) -> bool:
        """Bank and branch alone only narrow an account."""
        return self.id is not None or self.account is not None or len(" ".join(self.name)) >= 2


def applicability(query: Query) -> tuple[list[str], dict[str, list[str]]]:
    """(sources that carry every filled field, the missing fields of the others)."""
    missing = {s: [f for f in query.filled if f not in carried] for s, carried in CARRIED.items()}
    return [s for s, m in missing.items() if not m], {s: m for s, m in missing.items() if m}


def active(end_date: Column, today: Column) -> Column:
    return F.coalesce(end_date >= today, F.lit(False))


def source_filter(source: str, query: Query, whole: bool = False) -> Column:
    """Conjunction of the filled fields; a null field adds nothing."""
    out = F.lit(True)
    if source == "boi_accounts":
        for name in ("account", "bank", "branch"):
            if getattr(query, name) is not None:
                out &= F.col(name) == getattr(query, name)
        return out
    if query.id is not None:
        own = F.col(NUMBER_COLUMN[source]) == query.id if source in NUMBER_COLUMN else F.array_contains("ids", F.lit(query.id).cast("bigint"))
        out &= own
    if query.name:
        out &= name_matches(F.col("tokens"), query.name, whole)
    return out


def search(tables: Mapping[str, DataFrame], query: Query, limit: int = RESULT_LIMIT, whole: bool = False, indexes: Mapping[str, NameIndex] | None = None) -> DataFrame:
    """(source, position, total, name_only, record) of the query over every loaded source that
    carries all its fields; at most ``limit`` rows a source, sources with rows first by the
    order of ``group_position``. ``record`` is the row as JSON.

    A source with an index answers names from it; only the others read all names."""
    searched = [s for s in applicability(query)[0] if s in tables] if query.valid else []
    parts = []
    for i, source in enumerate(searched):
        name_only = source.startswith("nbctf_") and bool(query.name) and query.id is None
        if query.name and source in (indexes or {}):
            index = indexes[source]
            found = index.matches(query.name, whole)
            if query.id is not None:
                numbered = index.records.filter(source_filter(source, Query(id=query.id))).select(F.col(PLACE).alias("record"))
                found = numbered.join(found, "record", "left_semi")
            rows, n = index.first_records(found, limit)
        else:
            rows, n = tables[source].filter(source_filter(source, query, whole)), None
        shown = [c for c in tables[source].columns if c not in ("tokens", "ids")]
        ranked = rows.orderBy(*ORDER[source]).limit(limit).select(F.to_json(F.struct(*shown)).alias("record"), *ORDER[source])
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*ORDER[source]))  # at most `limit` rows
        ranked = ranked.withColumn("position", place)
        if n is None:
            ranked = ranked.join(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row
        else:
            ranked = ranked.withColumn("total", F.lit(n).cast("long"))
        parts.append(ranked.select(F.lit(i).alias("group_position"), F.lit(source).alias("source"), "position", "total", F.lit(name_only).alias("name_only"), "record"))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "group_position int, source string, position int, total long, name_only boolean, record string")
    return reduce(DataFrame.unionByName, parts)


def lookups(payloads: DataFrame) -> DataFrame:
    """What each payload offers to look up: (document_id, pos, field, by, id, bank, branch,
    account, words).

    Payload columns: document_id, id_number, spouse_id_number, child_id_numbers (array),
    drawer_id_number, guarantor_id_number, bank_code, branch_number, account_number, and first
    and last names in ``he`` and ``en``. A number met under an earlier key is left out."""
    none = F.lit(None).cast("bigint")
    no_words = F.lit(None).cast("array<string>")

    def item(key: str, by: str, id_=none, bank=none, branch=none, account=none, words=no_words) -> Column:
        return F.struct(F.lit(key).alias("field"), F.lit(by).alias("by"), id_.alias("id"), bank.alias("bank"), branch.alias("branch"), account.alias("account"), words.alias("words"))

    numbers = [item(k, "id", number_of_digits(F.col(k))) for k in ("id_number", "spouse_id_number")]
    children = F.transform(F.coalesce("child_id_numbers", F.array().cast("array<string>")), lambda x: item("child_id_number", "id", number_of_digits(x)))
    later = [item(k, "id", number_of_digits(F.col(k))) for k in ("drawer_id_number", "guarantor_id_number")]
    triple = [number_of_digits(F.col(c)) for c in ("bank_code", "branch_number", "account_number")]
    account = F.when(triple[0].isNotNull() & triple[1].isNotNull() & triple[2].isNotNull(), item("account", "account", none, *triple))
    # each step a column of its own, so that none is worked out once for every use
    people = []
    for lang in ("he", "en"):
        first, last = F.col(f"first_name_{lang}"), F.col(f"last_name_{lang}")
        words = F.filter(F.split(normalized_name(F.concat_ws(" ", first, last)), " "), lambda w: w != "")
        payloads = payloads.withColumn(f"_words_{lang}", F.when((F.trim(first) != "") & (F.trim(last) != ""), words))
        words = F.col(f"_words_{lang}")
        people.append(F.when((F.size(words) >= 2) & F.forall(words, lambda w: F.length(w) >= 2), item(f"name_{lang}", "name", words=words)))
    every = F.concat(F.array(*numbers), children, F.array(*later), F.array(account, *people))
    offered = F.filter(every, lambda x: x.isNotNull() & ((x["by"] != "id") | x["id"].isNotNull()))
    rows = payloads.withColumn("_offered", offered).withColumn("_ids", F.transform("_offered", lambda x: x["id"]))
    kept = F.filter("_offered", lambda x, i: (x["by"] != "id") | (F.array_position("_ids", x["id"]) == i + 1))
    return rows.select("document_id", F.posexplode(kept).alias("pos", "l")).select("document_id", "pos", "l.*")


def _level(source: str, today: Column) -> Column:
    alert = {
        "boi_accounts": active(F.col("end_date"), today),
        "boi_severe": F.coalesce(F.col("end_date") >= today, F.lit(True)),
        "nbctf_individuals": ~F.coalesce("cancelled", F.lit(False)),
        "nbctf_orgs": ~F.coalesce("cancelled", F.lit(False)),
        "companies": ~F.col("status").eqNullSafe(ACTIVE_COMPANY),
    }[source]
    return F.when(alert, "alert").otherwise("info")


def _rarest_tokens(people: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``people`` with ``phrases``, the tokens of each of its words, and ``_w``, the token of the name that
    the fewest records have; names with a token that no record has are left out."""
    split = written(people.withColumn("phrases", F.transform("words", tokens_of)), "name-lookups")
    tokens = F.array_distinct(F.flatten("phrases"))
    every = split.select("document_id", "pos", F.size(tokens).alias("_size"), F.explode(tokens).alias("_w")).join(vocabulary.select(F.col("token").alias("_w"), F.col("records").alias("_n")), "_w")
    one = every.groupBy("document_id", "pos").agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"), F.count("*").alias("_found"), F.first("_size").alias("_size"))
    return split.join(one.filter("_found = _size").select("document_id", "pos", "_w"), ["document_id", "pos"])


def _named(people: DataFrame, source: str, levelled: DataFrame, index: NameIndex | None) -> DataFrame:
    """Name lookups with the records that hold every word whole: from the index where the source has
    one, else from the tokens of all its rows, exploded once."""
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in ORDER[source]]).alias("record_key")
    held = ["record_key", "level", F.col(ORDER[source][0]).alias("_o0"), "tokens"]
    if index is None:
        by_token = levelled.select(key, "level", "tokens", F.explode(F.array_distinct("tokens")).alias("_w"), F.col(ORDER[source][0]).alias("_o0"))
        vocabulary = written(by_token.groupBy(F.col("_w").alias("token")).agg(F.count("*").alias("records")), "token-counts")
        found = _rarest_tokens(people, vocabulary).join(by_token, "_w")
    else:
        places = index.postings.select(F.col("token").alias("_w"), F.col("record").alias(PLACE)).distinct()
        rows = levelled.withColumn("record_key", key).select(PLACE, *held)
        found = _rarest_tokens(people, index.vocabulary).join(places, "_w").join(rows, PLACE)
    return found.filter(F.forall("phrases", lambda p: holds_phrase(F.col("tokens"), p, F.lit(True))))


def screen(payloads: DataFrame, tables: Mapping[str, DataFrame], today: Column, indexes: Mapping[str, NameIndex] | None = None) -> DataFrame:
    """(document_id, field, by, pos, source, row_pos, level, record_key) of every match: each
    lookup against every loaded source that carries it, at most ``MATCH_LIMIT`` rows a lookup
    and source.

    Lookups are exploded first, so each source is one equi-join; names join on that of their
    tokens which the fewest records have, and are checked in full behind it."""
    wanted = written(lookups(payloads), "lookups")
    parts = []
    for i, (source, table) in enumerate((s, tables[s]) for s in CARRIED if s in tables):
        index = (indexes or {}).get(source)
        levelled = (table if index is None else index.records).withColumn("level", _level(source, today))
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in ORDER[source]])
        if source == "boi_accounts":
            rows = levelled.select(key.alias("record_key"), "level", "bank", "branch", "account", *[F.col(c).alias(f"_o{n}") for n, c in enumerate(ORDER[source])])
            found = [wanted.filter(F.col("by") == "account").join(rows, ["bank", "branch", "account"])]
        else:
            order = F.col(ORDER[source][0]).alias("_o0")
            number = F.col(NUMBER_COLUMN[source]).alias("id") if source in NUMBER_COLUMN else F.explode("ids").alias("id")
            by_id = levelled.select(key.alias("record_key"), "level", number, order)
            found = [wanted.filter(F.col("by") == "id").drop("bank", "branch", "account").join(by_id, "id")]
            if source == "nbctf_individuals":
                found.append(_named(wanted.filter(F.col("by") == "name"), source, levelled, index))
        columns = ["document_id", "field", "by", "pos", "level", "record_key"]
        orders = [f"_o{n}" for n in range(len(ORDER[source]))]
        for rows in found:
            place = F.row_number().over(Window.partitionBy("document_id", "pos").orderBy(*orders, "record_key"))
            ranked = rows.select(*columns, *orders).withColumn("row_pos", place).filter(F.col("row_pos") <= MATCH_LIMIT)
            parts.append(ranked.select(*columns, F.lit(i).alias("source_pos"), F.lit(source).alias("source"), "row_pos"))
    return reduce(DataFrame.unionByName, parts)


def checked_keys(payloads: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(document_id, checked): the lookup keys that ran on a loaded source, in fixed order."""
    runs = {"id": any(s in tables for s in ID_SOURCES), "account": "boi_accounts" in tables, "name": "nbctf_individuals" in tables}
    ran = lookups(payloads).filter(F.col("by").isin([by for by, on in runs.items() if on]))
    order = F.array(*[F.lit(k) for k in LOOKUP_KEYS])
    sets = ran.groupBy("document_id").agg(F.collect_set("field").alias("f"))
    return sets.select("document_id", F.filter(order, lambda k: F.array_contains("f", k)).alias("checked"))


def in_order(matches: DataFrame) -> DataFrame:
    """``matches`` with ``place`` in their document: alerts before infos, each by lookup, source and row. A
    document has at most ``MATCH_LIMIT`` of them a lookup and source."""
    order = Window.partitionBy("document_id").orderBy(F.col("level") != "alert", "pos", "source_pos", "row_pos")
    return matches.withColumn("place", F.row_number().over(order))


def summary(matches: DataFrame) -> DataFrame:
    """(document_id, level, source, by, n, first): counts in the order of first appearance."""
    place = F.col("pos") * 1000 + F.col("source_pos") * 100 + F.col("row_pos")
    return matches.groupBy("document_id", "level", "source", "by").agg(F.count("*").alias("n"), F.min(place).alias("first"))


def parsed_summary(text: Column) -> Column:
    """Struct (alerts, infos, checked, error) of a stored summary; null if it is malformed."""
    item = "array<struct<source:string,by:string,count:int>>"
    parsed = F.from_json(text, f"alerts {item}, infos {item}, checked array<string>, error string", {"mode": "PERMISSIVE"})
    good = (parsed["error"] == "REGISTRIES_UNAVAILABLE") | (parsed["alerts"].isNotNull() & parsed["infos"].isNotNull())
    return F.when(F.coalesce(good, F.lit(False)), parsed)
