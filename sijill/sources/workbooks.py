"""Workbooks as DataFrames: the cells of each file's first sheet, read on the workers with the standard library."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import hijri, names

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, row int, cells array<string>"
#: What a header may be called. The first header that holds one of them, as it stands or in lower case, is the column.
HEADERS = {
    "name": ("الاسم", "اسم", "name"),
    "notes": ("الملاحظات", "ملاحظات", "notes"),
    "dates": ("التواريخ", "تواريخ", "dates"),
    "page": ("الصفحة", "صفحات", "page"),
    "rank": ("الرتبة", "رتبة", "rank"),
}
EXCEL_CONFIDENCE = 0.98
EXCEL_SNIPPET = "Excel"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _column(reference: str) -> int:
    at = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def _number(value: str) -> str:
    return value[:-2] if re.fullmatch(r"-?\d+\.0", value) else value


def sheet(content: bytes) -> list[list[str | None]]:
    """Rows of the active sheet."""
    with zipfile.ZipFile(BytesIO(content)) as book:
        parts = set(book.namelist())
        shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts else []
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        view = workbook.find(f"{MAIN}bookViews/{MAIN}workbookView")
        sheets = workbook.findall(f"{MAIN}sheets/{MAIN}sheet")
        chosen = sheets[int(view.get("activeTab", 0)) if view is not None else 0]
        relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in relations if r.get("Id") == chosen.get(RELATION)).lstrip("/")
        rows: list[list[str | None]] = []
        for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{MAIN}row"):
            number = int(row.get("r", len(rows) + 1))
            rows += [[] for _ in range(number - len(rows))]
            for nth, cell in enumerate(row.findall(f"{MAIN}c")):
                at = _column(cell.get("r")) if cell.get("r") else nth
                value, kind = cell.find(f"{MAIN}v"), cell.get("t")
                text = _text(cell) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else _number(value.text or "") if kind in (None, "n") else value.text
                cells = rows[number - 1]
                cells += [None] * (at + 1 - len(cells))
                cells[at] = text
        return rows


def read_cells(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, row, cells) of workbooks; row counts from 0. A file is read whole on one worker."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                found = sheet(content)
                yield pd.DataFrame({"path": [path] * len(found), "row": range(len(found)), "cells": found})

    ship(spark)
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(rows, CELLS)


def _header(cells: Column, kinds: tuple[str, ...]) -> Column:
    """Place of the first header of a kind; null if none."""
    matching = lambda h: F.exists(F.array(*[F.lit(k) for k in kinds]), lambda k: F.contains(h, k) | F.contains(F.lower(h), k))
    marks = F.transform(cells, lambda h: F.coalesce(matching(names.trimmed(h)), F.lit(False)))
    return F.nullif(F.array_position(marks, F.lit(True)), F.lit(0)).cast("int") - 1


def _field(at: Column) -> Column:
    return F.get("cells", at)


def _filled(value: Column) -> Column:
    return F.when(names.trimmed(value) != "", value)


def master_rows(cells: DataFrame) -> DataFrame:
    """(source, ord, name, notes, dates, page, rank) of master sheets: row 0 is the header; rows without a name go; a page that is no
    whole number is 0."""
    heads = cells.where("row = 0").select("path", *[_header(F.col("cells"), kinds).alias(f"at_{k}") for k, kinds in HEADERS.items()])
    rows = cells.where("row > 0").join(F.broadcast(heads), "path")  # a row a file
    name = names.trimmed(_field(F.coalesce("at_name", F.lit(0))))
    return rows.select(
        F.col("path").alias("source"), F.struct("path", "row").alias("ord"), name.alias("name"), _filled(_field(F.col("at_notes"))).alias("notes"), _filled(_field(F.col("at_dates"))).alias("dates"),
        F.coalesce(_field(F.col("at_page")).try_cast("long"), F.lit(0)).alias("page"), names.trimmed(_field(F.col("at_rank"))).alias("rank"),
    ).where(F.coalesce("name", F.lit("")) != "")


def occurrences(rows: DataFrame) -> DataFrame:
    """The rows' notes as occurrences, for evidence.from_notes."""
    return rows.select(
        names.key(F.col("name")).alias("person_key"), "ord", "source", "name", F.coalesce("rank", F.lit("")).alias("rank_title"), "notes", F.when(F.col("page") == 0, 1).otherwise(F.col("page")).alias("page"),
        F.lit(EXCEL_CONFIDENCE).alias("confidence"), F.lit(1).alias("agreement"), F.lit(1.0).alias("association"), F.lit(0).alias("row_index"),
    )


def listed_dates(rows: DataFrame, from_notes: DataFrame) -> DataFrame:
    """Evidence from the dates column: parts between | , ; each parsed, or else searched, and verified as written; a person's date that
    the notes up to that row, or an earlier part, already gave isn't repeated."""
    parts = rows.select(names.key(F.col("name")).alias("person_key"), "ord", "page", F.posexplode(F.split("dates", "[|,;]+")).alias("part", "raw"))
    parts = parts.withColumn("raw", names.trimmed(F.col("raw"))).where(F.col("raw") != "").withColumn("date", hijri.parse(F.col("raw")))
    whole = parts.where(F.col("date").isNotNull()).select("person_key", "ord", "page", "part", F.lit(0).alias("nth"), "date", F.col("raw").alias("original_text"), F.lit(1.0).alias("confidence"), F.lit(False).alias("needs_review"), F.lit("").alias("review_reason"), F.lit(EXCEL_SNIPPET).alias("snippet"))
    searched = parts.where(F.col("date").isNull()).drop("date").select("*", F.posexplode(hijri.extract(F.col("raw"))).alias("nth", "d"))
    scored = searched.withColumn("s", hijri.evidence(F.col("d.date"), F.col("d.repaired"), F.lit(EXCEL_CONFIDENCE), F.lit(1), F.lit(1.0)))
    found = scored.select("person_key", "ord", "page", "part", "nth", F.col("d.date").alias("date"), F.col("d.raw").alias("original_text"), F.col("s.confidence").alias("confidence"), F.col("s.needs_review").alias("needs_review"), F.col("s.review_reason").alias("review_reason"), F.substring("raw", 1, 200).alias("snippet"))
    first = Window.partitionBy("person_key", "date").orderBy("ord", "part", "nth")
    every = whole.unionByName(found).withColumn("_place", F.row_number().over(first)).where("_place = 1")
    noted = from_notes.groupBy("person_key", "date").agg(F.min("ord").alias("_noted"))
    fresh = every.join(noted, ["person_key", "date"], "left").where(F.col("_noted").isNull() | (F.col("_noted") > F.col("ord")))
    return fresh.select(
        "person_key", "ord", F.lit(0).alias("nth"), "date", "original_text", F.when(F.col("page") == 0, 1).otherwise(F.col("page")).alias("page"), "confidence", F.lit(True).alias("verified"), "needs_review", "review_reason",
        F.lit(1).alias("agreement"), F.lit(1.0).alias("association"), "snippet",
    )


def target_rows(cells: DataFrame) -> DataFrame:
    """(id, ord, name) of target sheets: the name column by its header; without one, the first column, whose first row is data."""
    heads = cells.where("row = 0").select("path", _header(F.col("cells"), HEADERS["name"]).alias("at"))
    rows = cells.join(F.broadcast(heads), "path").where(F.col("at").isNull() | (F.col("row") > 0))
    name = _field(F.coalesce("at", F.lit(0)))
    return rows.where(name.isNotNull()).select(F.sha1(F.concat_ws("#", "path", "row")).substr(1, 8).alias("id"), F.struct("path", "row").alias("ord"), name.alias("name"))
