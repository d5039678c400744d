"""Rankings as text, JSON, workbooks and snapshots. Nothing is written but where the caller says."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of the exports.
TITLE, RULE = "الترتيب", "القاعدة: الأقدم في أحدث تاريخ يتقدّم؛ عند التعادل يُفحص التاريخ السابق."
RANKING_HEADERS = ("الترتيب", "الاسم", "أحدث تاريخ", "التاريخ السابق", "عدد التواريخ", "الحالة", "سبب الترتيب")
INDEX_HEADERS = ("م", "الاسم", "الرتبة", "الصفحات", "التواريخ (الأحدث ← الأقدم)")
DATES_TITLE, DATES_HEADERS = "التواريخ التفصيلية", ("الاسم", "التواريخ (الأحدث ← الأقدم)")
RULES = {"order": "newest_to_oldest_sequence", "compare": "older_wins_at_first_difference", "no_invented_tiebreakers": True}
NONE, CUT = "—", 180


def rank_label() -> Column:
    return F.coalesce(F.nullif(F.col("rank_display"), F.lit("")), F.col("rank").cast("string"), F.lit(NONE))


def text_rows(ranked: DataFrame) -> DataFrame:
    """(position, line) of the rows with a rank."""
    line = F.concat(rank_label(), F.lit(". "), F.coalesce("original_name", F.lit("")), F.lit(" — أحدث: "), F.coalesce("latest_date", F.lit(NONE)), F.lit(" ("), F.col("date_count"), F.lit(" تاريخ) — "), F.col("status"))
    return ranked.where(F.col("rank").isNotNull()).select("position", line.alias("line"))


def write_text(ranked: DataFrame, summary: DataFrame, path: str, title: str = TITLE) -> None:
    """The whole report as ordered text files: a heading with counts, the ranked rows, the rule."""
    counts = F.concat(F.lit("مرتّب: "), "ranked_successfully", F.lit(" · تعادل: "), "tied", F.lit(" · غير محسوم: "), "unresolved")
    head = summary.select(F.explode(F.array(F.struct(F.lit(-3).cast("long").alias("position"), F.lit(title).alias("line")), F.struct(F.lit(-2).cast("long").alias("position"), counts.alias("line")))).alias("r")).select("r.*")
    foot = summary.select(F.lit((1 << 62)).cast("long").alias("position"), F.lit(RULE).alias("line"))
    head.unionByName(text_rows(ranked)).unionByName(foot).orderBy("position").select("line").write.mode("overwrite").text(path)


def audit(ranked: DataFrame) -> DataFrame:
    """(position, json): a row's whole record."""
    return ranked.select("position", F.to_json(F.struct(*[c for c in ranked.columns if c != "seq"]), {"ignoreNullFields": "false"}).alias("json"))


def write_audit(ranked: DataFrame, summary: DataFrame, path: str) -> None:
    """results/ with a record a line, and summary/ with the counts and the rule."""
    audit(ranked).orderBy("position").select("json").write.mode("overwrite").text(f"{path}/results")
    rule = F.struct(*[F.lit(v).alias(k) for k, v in RULES.items()]).alias("rule")
    summary.select("*", rule, F.current_timestamp().alias("exported_at")).write.mode("overwrite").json(f"{path}/summary")


def ranking_table(ranked: DataFrame) -> DataFrame:
    """The seven columns of the ranking sheet, all rows."""
    filled = lambda c: F.coalesce(c, F.lit(NONE))
    return ranked.select("position", rank_label().alias("rank_label"), "original_name", filled("latest_date").alias("latest_date"), filled("previous_date").alias("previous_date"), F.coalesce("date_count", F.lit(0)).alias("date_count"), "status", F.coalesce("explanation", F.lit("")).alias("explanation"))


def printed_table(ranked: DataFrame, formal: bool = False) -> DataFrame:
    """What a printed page shows: all rows with a cut explanation, or, formally, the ranked rows alone."""
    rows = ranking_table(ranked.where(F.col("rank").isNotNull()) if formal else ranked)
    return rows.withColumn("explanation", F.substring("explanation", 1, CUT))


def dates_table(ranked: DataFrame) -> DataFrame:
    return ranked.select("position", "original_name", F.array_join(F.coalesce("date_list", F.array().cast("array<string>")), " | ").alias("dates"))


def master_index(people: DataFrame) -> DataFrame:
    """(m, name, rank_title, pages, dates) from people in order (position, original_name, rank_title, pages, date_list)."""
    return people.select((F.col("position") + 1).alias("m"), F.col("original_name").alias("name"), F.coalesce("rank_title", F.lit("")).alias("rank_title"), F.array_join(F.col("pages").cast("array<string>"), "، ").alias("pages"), F.array_join("date_list", " | ").alias("dates"))


def _sheet(rows) -> str:
    body = []
    for r, row in enumerate(rows, 1):
        cells = "".join(f'<c t="n"><v>{v}</v></c>' if isinstance(v, int) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v or "")))}</t></is></c>' for v in row)
        body.append(f'<row r="{r}">{cells}</row>')
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView rightToLeft="1" workbookViewId="0"/></sheetViews><sheetData>{"".join(body)}</sheetData></worksheet>'


def workbook(sheets: dict[str, list]) -> bytes:
    """A right-to-left workbook of sheets (title: rows)."""
    out, main = BytesIO(), "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        n = range(1, len(sheets) + 1)
        book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in n) + "</Types>")
        book.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="rId1" Type="{main}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{main}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(t)}" sheetId="{k}" r:id="rId{k}"/>' for k, t in zip(n, sheets)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{main}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{main}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
        for k, rows in zip(n, sheets.values()):
            book.writestr(f"xl/worksheets/sheet{k}.xml", _sheet(rows))
    return out.getvalue()


def ranking_workbook(ranked: DataFrame) -> bytes:
    """A workbook is one file for people to read, so its rows come to the driver, one partition at a time; a large ranking is written by write_audit."""
    rows = [list(r)[1:] for r in ranking_table(ranked).orderBy("position").toLocalIterator()]
    dates = [list(r)[1:] for r in dates_table(ranked).orderBy("position").toLocalIterator()]
    return workbook({TITLE: [RANKING_HEADERS, *rows], DATES_TITLE: [DATES_HEADERS, *dates]})


def index_workbook(people: DataFrame) -> bytes:
    return workbook({TITLE: [INDEX_HEADERS, *[list(r) for r in master_index(people).orderBy("m").toLocalIterator()]]})


def snapshot_name(session_id: str) -> str:
    """A file's name of a session's: letters, digits, _ and - of it, 64 at most."""
    return re.sub(r"[^\w-]+", "", session_id)[:64]


def write_snapshot(results: DataFrame, summary: DataFrame, session_id: str, folder: str) -> None:
    write_audit(results, summary, f"{folder}/{snapshot_name(session_id)}.json")
