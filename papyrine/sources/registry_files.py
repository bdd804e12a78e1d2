"""Readers of registry files: fixed-width lists, sheets and paged JSON, as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions.calendar import iso_from_cell, iso_from_dmy, iso_from_yymmdd, iso_from_yyyymmdd
from papyrine.functions.identifiers import long_numbers
from papyrine.functions.names import cell_or_null, company_text, joined_aliases, name_tokens

HEADER = r"^00,[^,]*,[^,]*,([0-9]{6}),[^,]*,([0-9]+)"
ACCOUNT = r"^01([0-9]{2})([0-9]{3})([0-9]{11})([0-9]{8})([0-9]{8})\s*$"
SEVERE = r"^01 [0-9]{3} ([0-9]{9}) ([0-9]{2}/[0-9]{2}/[0-9]{4}) ?(.*)$"
NAMESPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of UTF-8 or ASCII files, without blank lines at the end."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r$", "").alias("line"))
    return lines.filter(F.trim("line") != "")


def legacy_lines(spark: SparkSession, path: str, encoding: str = "cp1255") -> DataFrame:
    """(file, line) of files in a legacy code page; one file is one task."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                lines = content.decode(encoding).split("\n")
                yield pd.DataFrame({"file": file, "line": [x.rstrip("\r") for x in lines if x.strip()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, line string")


def checked_rows(lines: DataFrame, shape: str, what: str) -> tuple[DataFrame, str | None]:
    """(rows of the shape, date of the header). Raises where the header is missing, its line
    count is wrong, or a line has another shape."""
    is_header = F.col("line").rlike(HEADER)
    told = lines.groupBy("file").agg(
        F.max(F.when(is_header, F.regexp_extract("line", HEADER, 2))).cast("long").alias("declared"),
        F.max(F.when(is_header, iso_from_yymmdd(F.regexp_extract("line", HEADER, 1)))).alias("date"),
        F.count("*").alias("found"),
        F.count_if(~is_header & ~F.col("line").rlike(shape)).alias("malformed"),
    )
    dates = []
    for row in told.toLocalIterator():  # one row a file
        if row.declared is None:
            raise ValueError(f"{what}: unrecognised header line")
        if row.declared != row.found:
            raise ValueError(f"{what}: header line count {row.declared}, file has {row.found}")
        if row.malformed:
            raise ValueError(f"{what}: {row.malformed} malformed lines")
        dates.append(row.date)
    if not dates:
        raise ValueError(f"{what}: empty")
    return lines.filter(~is_header), max((d for d in dates if d), default=None)


def accounts(lines: DataFrame) -> tuple[DataFrame, str | None]:
    """Restricted accounts: bank, branch, account, start_date, end_date; and the file's date."""
    rows, date = checked_rows(lines, ACCOUNT, "restricted accounts")
    part = lambda i: F.regexp_extract("line", ACCOUNT, i)
    return rows.select(part(1).cast("int").alias("bank"), part(2).cast("int").alias("branch"), part(3).cast("bigint").alias("account"), iso_from_yyyymmdd(part(4)).alias("start_date"), iso_from_yyyymmdd(part(5)).alias("end_date")), date


def severe(lines: DataFrame) -> tuple[DataFrame, str | None]:
    """Severely restricted corporations: id_number, name, end_date, tokens; and the file's date."""
    rows, date = checked_rows(lines, SEVERE, "severely restricted corporations")
    part = lambda i: F.regexp_extract("line", SEVERE, i)
    name = F.trim(part(3))
    return rows.select(part(1).cast("bigint").alias("id_number"), name.alias("name"), iso_from_dmy(part(2)).alias("end_date"), name_tokens(name).alias("tokens")), date


def _cell_column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def first_sheet(content: bytes) -> list[list[str]]:
    """Rows of text cells of a workbook's first sheet; absent cells are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{NAMESPACE}t"))
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{NAMESPACE}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not sheets:
            raise ValueError("no sheet in the workbook")
        rows = []
        for row in ElementTree.fromstring(book.read(sheets[0])).iter(f"{NAMESPACE}row"):
            cells: dict[int, str] = {}
            for n, cell in enumerate(row.iter(f"{NAMESPACE}c")):
                value, kind = cell.findtext(f"{NAMESPACE}v"), cell.get("t")
                written = text(cell) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value or ""
                cells[_cell_column(cell.get("r")) if cell.get("r") else n] = written
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, cells) of the first sheet of every workbook; one workbook is one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                found = first_sheet(content)
                yield pd.DataFrame({"file": file, "row": range(len(found)), "cells": found})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, row int, cells array<string>")


def by_headers(rows: DataFrame, columns: dict[str, str], key: str = "internal seq") -> DataFrame:
    """Sheet rows as named columns. The header row is the first with ``key`` in a cell; each
    column is where its pattern matches a header (lower case, single blanks). Rows stay whose
    cell under ``key`` is a number. Raises where a header is missing."""
    plain = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")))
    header = rows.select("row", plain.alias("h")).filter(F.exists("h", lambda c: c.contains(key))).orderBy("row").limit(1).collect()
    if not header:
        raise ValueError("no header row")
    places = {}
    for name, pattern in {"_key": re.escape(key), **columns}.items():
        at = next((i for i, h in enumerate(header[0].h) if re.search(pattern, h)), None)
        if at is None:
            raise ValueError(f"no column for {name}")
        places[name] = F.trim(F.coalesce(F.get("cells", F.lit(at)), F.lit("")))
    picked = rows.filter(F.col("row") > header[0].row).select(*[c.alias(n) for n, c in places.items()])
    return picked.filter(F.col("_key").rlike("^[0-9]+$")).withColumnRenamed("_key", "seq").withColumn("seq", F.col("seq").cast("int"))


def designation(cell: Column, cancelled_word: str = "בוטל") -> Column:
    """Struct (date, note, cancelled): a date, or a note that may tell a cancellation."""
    date = iso_from_cell(cell)
    note = F.when(date.isNull(), cell_or_null(cell))
    return F.struct(date.alias("date"), note.alias("note"), F.coalesce(note.contains(cancelled_word), F.lit(False)).alias("cancelled"))


def indexed_people(rows: DataFrame, names: list[str], id_text: str) -> DataFrame:
    """Add the search columns of a designation list: ``tokens`` of all names and ``ids``."""
    return rows.withColumns({"tokens": name_tokens(*[F.col(n) for n in names]), "ids": long_numbers(F.col(id_text))})


def aliases(cells: list[Column]) -> Column:
    return joined_aliases(F.array(*[cell_or_null(c) for c in cells]))


def companies(pages: DataFrame, columns: dict[str, str], number: str, page: str = "page") -> DataFrame:
    """Companies of paged JSON answers (page, success, result.total, result.records): the first
    record of a number by page and place wins. Raises where a page failed or the rows read are
    not the declared total. ``columns`` maps our names to the records' keys."""
    counted = pages.agg(F.bool_and("success").alias("ok"), F.max("result.total").alias("total"), F.sum(F.size("result.records")).alias("read")).first()
    if not counted.ok or counted.total != counted.read:
        raise ValueError(f"companies: {counted.read} rows read, {counted.total} declared")
    records = pages.select(page, F.posexplode("result.records").alias("_pos", "r"))
    rows = records.select(page, "_pos", F.col(f"r.`{number}`").cast("bigint").alias("number"), *[company_text(F.col(f"r.`{k}`").cast("string")).alias(n) for n, k in columns.items()])
    first = F.row_number().over(Window.partitionBy("number").orderBy(page, "_pos"))
    return rows.withColumn("_n", first).filter("_n = 1 and number is not null").drop("_n", "_pos", page)
