"""Hijri dates as Column expressions.

A date is an int, year * 10000 + month * 100 + day: it orders like the date, and a 30th of any month is
legal, which DATE would refuse. None of the functions calls Python on the workers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits, and the ranges of a legal date.
ARABIC_DIGITS, PERSIAN_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
FIRST_YEAR, LAST_YEAR, MONTHS, DAYS = 1300, 1600, 12, 30
#: Patterns of year first and of day first.
YEAR_FIRST = r"(?U)(?<!\d)(1[0-9]{3,4})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})(?!\d)"
DAY_FIRST = r"(?U)(?<!\d)([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*(1[0-9]{3,4})(?!\d)"
#: Reasons for a review, in the order in which the first one wins.
REASON_YEAR = "تصحيح سنة OCR (رقم زائد في البداية)"
REASON_ROW = "ارتباط التاريخ بصف الشخص غير مؤكد هندسيًا"
REASON_LOW = "ثقة منخفضة في التعرف على التاريخ"
LEVELS = ("أحدث تاريخ", "التاريخ الثاني (الأسبق)", "التاريخ الثالث", "التاريخ الرابع", "التاريخ الخامس")


def western_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS + PERSIAN_DIGITS, ASCII_DIGITS * 2)


def ordinal(year: Column, month: Column, day: Column) -> Column:
    """The date's int; null if it's out of range."""
    legal = year.between(FIRST_YEAR, LAST_YEAR) & month.between(1, MONTHS) & day.between(1, DAYS)
    return F.when(legal, year * 10000 + month * 100 + day)


def year_of(date: Column) -> Column:
    return F.floor(date / 10000).cast("int")


def iso(date: Column, separator: str = "-") -> Column:
    text = F.format_string(f"%04d{separator}%02d{separator}%02d", year_of(date), (F.floor(date / 100) % 100).cast("int"), (date % 100).cast("int"))
    return F.when(date.isNotNull(), text)


def display(date: Column) -> Column:
    return iso(date, "/")


def display_ar(date: Column) -> Column:
    return F.translate(display(date), ASCII_DIGITS, ARABIC_DIGITS)


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n).try_cast("int")


def _unmarked(text: Column) -> Column:
    """Without the marks of the Hijri era."""
    text = F.replace(western_digits(text), F.lit("هـ"), F.lit(" "))
    return F.replace(F.regexp_replace(text, r"(?U)(?<=\d)\s*ه(?:ـ)?\b", " "), F.lit("H"), F.lit(" "))


def parse(text: Column) -> Column:
    """The one date of a text. The first year-first match decides, legal or not; else the first day-first match, if its day
    can't be a month. Null for null, nothing found, an illegal date, or a five-digit year."""
    text = _unmarked(text)
    day, month, year = (_group(text, DAY_FIRST, n) for n in (1, 2, 3))
    unambiguous = (day > 12) | (month > 12)
    return (
        F.when(text.rlike(YEAR_FIRST), ordinal(*(_group(text, YEAR_FIRST, n) for n in (1, 2, 3))))
        .when(text.rlike(DAY_FIRST) & unambiguous, ordinal(year, month, day))
    )


def _found(raw: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    year, month, day = (_group(raw, pattern, n) for n in order)
    repaired = year.between(10000 + FIRST_YEAR, 10000 + LAST_YEAR)
    clear = F.lit(True) if order[0] == 1 else (day > 12) | (month > 12)
    return F.struct(F.when(clear, ordinal(F.when(repaired, year - 10000).otherwise(year), month, day)).alias("date"), raw.alias("raw"), F.coalesce(repaired, F.lit(False)).alias("repaired"))


def extract(text: Column) -> Column:
    """array<struct<date int, raw string, repaired boolean>>: all legal dates of a text, the year-first ones first, each
    date once. A five-digit year loses its leading 1. Empty for null."""
    text = F.coalesce(western_digits(text), F.lit(""))
    year_first = F.transform(F.regexp_extract_all(text, F.lit(YEAR_FIRST), F.lit(0)), lambda raw: _found(raw, YEAR_FIRST, (1, 2, 3)))
    day_first = F.transform(F.regexp_extract_all(text, F.lit(DAY_FIRST), F.lit(0)), lambda raw: _found(raw, DAY_FIRST, (3, 2, 1)))
    legal = F.filter(F.concat(year_first, day_first), lambda x: x["date"].isNotNull())
    # A fold binds each date once: an expression that stands twice would search the text again for every date.
    empty = F.array().cast("array<struct<date:int,raw:string,repaired:boolean>>")
    return F.aggregate(legal, empty, lambda found, x: F.when(F.exists(found, lambda y: y["date"] == x["date"]), found).otherwise(F.concat(found, F.array(x))))


def evidence(date: Column, repaired: Column, confidence: Column, agreement: Column, association: Column, hint: Column | None = None) -> Column:
    """struct<confidence, needs_review, review_reason, verified> of one reading. hint: a year that most of the document's dates have."""
    no = F.lit(None).cast("string")
    score = F.least(confidence, association)
    score, reason = F.when(repaired, F.least(score, F.lit(0.82))).otherwise(score), F.when(repaired, F.lit(REASON_YEAR)).otherwise(no)
    review = repaired
    if hint is not None:
        year = year_of(date)
        off = F.abs(year - hint)
        alike = (F.floor(year / 100) == F.floor(hint / 100)) | (year % 100 == hint % 100)
        near, far = F.coalesce((off >= 20) & alike, F.lit(False)), F.coalesce((off >= 30) & ~alike, F.lit(False))
        score = F.when(near, F.least(score, F.lit(0.7))).when(far, F.least(score, F.lit(0.65))).otherwise(score)
        said = F.when(near, F.concat(F.lit("سنة مشبوهة ("), year, F.lit(") مقارنة بسياق المستند (~"), hint, F.lit(")"))).when(far, F.concat(F.lit("سنة بعيدة عن سياق المستند ("), year, F.lit(")")))
        reason, review = F.coalesce(reason, said), review | near | far
    loose = association < 0.85
    score, reason, review = F.when(loose, F.least(score, F.lit(0.82))).otherwise(score), F.coalesce(reason, F.when(loose, F.lit(REASON_ROW))), review | loose
    score = F.when((agreement <= 1) & (confidence < 0.95), F.least(score, F.lit(0.88))).otherwise(score)
    low = score < 0.85
    reason, review = F.coalesce(reason, F.when(low, F.lit(REASON_LOW)), F.lit("")), review | low
    return F.struct(score.alias("confidence"), review.alias("needs_review"), reason.alias("review_reason"), (~review & (score >= 0.93)).alias("verified"))


def safe(confidence: Column, needs_review: Column, agreement: Column, association: Column) -> Column:
    """Whether a reading may be verified without a person."""
    return ~needs_review & (confidence >= 0.93) & (agreement >= 2) & (association >= 0.95)


def level_label(level: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in LEVELS]), level), F.concat(F.lit("التاريخ رقم "), level + 1))
