"""Arabic names as Column expressions: keys, softer keys, similarity, and what can be a name."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that keys leave out or unify.
MARKS = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0640]"
ALEFS, ALEF = "أإآٱ", "ا"
INVISIBLE = "[\u200c\u200d\u200e\u200f\u202a-\u202e\ufeff]"
FOREIGN = r"(?U)[^\u0600-\u06FF\u0750-\u077F\s()\u0640\-]"
TRAILING_RANKS = ("عريف", "مريف", "هريف", "جندي", "رقيب")
SOFT_FROM, SOFT_TO = "ىةؤئگڤ", "يهويكف"
#: Titles of rank as written on rosters, and their misreadings.
RANKS = (
    "عريف", "جندي", "جندى", "جندي اول", "جندي أول", "جندى اول", "جندى أول", "رقيب", "و. رقيب", "و رقيب",
    "وكيل رقيب", "ملازم", "نقيب", "رائد", "مقدم", "عقيد", "عميد", "لواء",
)
MISREAD_RANKS = ("مريف", "هريف")
#: Patterns of headers, of dates in a cell, of row numbers, and of words that no name has.
HEADER = "(الملاحظات|الاسم|الأسم|الرتبة|سراء|تطبيق|الفرقة|صفحة|الصفحة)"
DATE_IN_CELL = r"[٠-٩0-9]{3,4}(?U:\s*)[/\-.\s](?U:\s*)[٠-٩0-9]{1,2}"
ROW_NUMBER = r"^[٠-٩0-9]{1,3}[\-–.]?$"
TARGET_RANK = r"(?U)\b(عريف|جندي\s*أول|جندي\s*اول|جندي|جندى|رقيب|و\.?\s*رقيب|وكيل\s*رقيب|ملازم|نقيب)\b"
NO_NAME = (
    "(وزارة|المملكة|الداخلية|حرس|الحدود|قيادة|قطاع|بيان|التكميل|اليومي|أفراد|المنفذ|التوقيع|الرتبة|الأسم|الاسم|معد|الملاحظات|إجازة|اجازة|"
    "رخصة|تأخير|تاخير|موجود|نضار|بسم|الله|اللّه|الرحمن|الرحيم|الموافق|يوم|الثلاثاء|الاثنين|الأحد|السبت|الخميس|الجمعة|الأربعاء|"
    "عنه|لمدة|ساعة|ساعات|أيام|اعتبارا|اعتبارًا|الموجود)"
)
ARABIC = r"[\u0600-\u06FF]"


#: What NFKC changes in names: Arabic presentation forms, full-width signs and blanks; and letters that a mark behind them changes.
COMPATIBLE = "[\\u00a0\\u2000-\\u200a\\u202f\\u3000\\ufb50-\\ufdff\\ufe70-\\ufefe\\uff01-\\uff5e]"
_FORMS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in ((0xA0, 0xA0), (0x2000, 0x200A), (0x202F, 0x202F), (0x3000, 0x3000), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE), (0xFF01, 0xFF5E)) for c in range(a, b + 1)}
_COMPOSED = {x: y for c in range(0x0620, 0x06D6) for m in "\u0653\u0654\u0655" for x in [chr(c) + m] for y in [unicodedata.normalize("NFC", x)] if x != y}


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nfkc(text: Column) -> Column:
    """NFKC of a text of Arabic letters, full-width signs and blanks; most texts pass by the first look."""
    # One literal: a name's key stands many times in a plan.
    forms = F.str_to_map(F.lit("\x01".join(f"{form}\x02{plain}" for form, plain in _FORMS.items() if form != plain)), F.lit("\x01"), F.lit("\x02"))
    spelled = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(forms, c), c))
    text = F.when(text.rlike(COMPATIBLE), F.array_join(spelled, "")).otherwise(text)
    for pair, letter in _COMPOSED.items():
        text = F.replace(text, F.lit(pair), F.lit(letter))
    return text


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def single_spaced(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def key(text: Column, nfkc: bool = True) -> Column:
    """The conservative identity key. Empty for null. nfkc: presentation forms count as the letters they show."""
    text = F.coalesce(text, F.lit(""))
    text = F.translate(F.regexp_replace(_bound(text, _nfkc) if nfkc else text, MARKS, ""), ALEFS, ALEF * len(ALEFS))
    text = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), r"(?U)^[\d٠-٩]+\s*[\-–.]\s*", "")
    text = F.regexp_replace(F.regexp_replace(text, FOREIGN, " "), rf"(?U)\s+({'|'.join(TRAILING_RANKS)})\s*$", "")
    return single_spaced(text)


def soft_of_key(keyed: Column) -> Column:
    """A softer key of a key, for candidates only."""
    text = F.regexp_replace(F.translate(keyed, SOFT_FROM, SOFT_TO), r"\([^)]*\)", " ")
    return single_spaced(F.replace(text, F.lit("عبد ال"), F.lit("عبدال")))


def soft(text: Column, nfkc: bool = True) -> Column:
    return soft_of_key(key(text, nfkc))


def tokens(text: Column) -> Column:
    """The words of a text whose blanks are single."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def token_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, by code points; 0 if either is empty."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.levenshtein(a, b) / longer))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _same_length(a: Column, b: Column, first: Column, family: Column) -> Column:
    n, each = F.size(a), F.zip_with(a, b, token_similarity)
    inner = F.slice(each, F.lit(2), F.greatest(n - 2, F.lit(0)))
    middle = _sum(inner) / F.greatest(F.lit(1), n - 2)
    score = F.when(n == 2, first * 0.5 + family * 0.5).otherwise(first * 0.32 + family * 0.32 + middle * 0.36)
    other_father = (n >= 3) & (first == 1.0) & (family == 1.0) & (F.array_min(inner) < 0.75)
    return F.when(other_father, F.least(score, F.lit(0.88))).otherwise(score)


def _aligned(shorter: Column, longer: Column) -> Column:
    """Sum of the similarities of an ordered alignment: each word takes the best of what is left, of equals the last."""

    def step(state: Column, word: Column) -> Column:
        rest = F.slice(longer, state["at"] + 1, F.greatest(F.size(longer) - state["at"], F.lit(0)))
        best = F.array_max(F.transform(rest, lambda other, i: F.struct(token_similarity(word, other).alias("s"), i.alias("i"))))
        taken = F.struct((state["at"] + best["i"] + 1).alias("at"), (state["total"] + best["s"]).alias("total"))
        return F.when(F.size(rest) > 0, taken).otherwise(state)

    return F.aggregate(shorter, F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("total")), step, lambda state: state["total"])


def _other_length(a: Column, b: Column, first: Column, family: Column) -> Column:
    swap = F.size(a) >= F.size(b)
    shorter, longer = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    aligned = _aligned(shorter, longer) / F.greatest(F.lit(1), F.size(longer))
    score = first * 0.28 + family * 0.28 + aligned * 0.44
    return score * F.greatest(F.lit(0.55), F.lit(1.0) - F.abs(F.size(a) - F.size(b)) * 0.13)


def similarity(key_a: Column, key_b: Column, soft_a: Column, soft_b: Column, words_a: Column, words_b: Column) -> Column:
    """Similarity of two names in 0..1, from their keys, soft keys and words of the soft keys: 1 only for equal keys, 0.94
    for equal soft keys, else 0.99 at most. Null or empty names are the caller's to leave out."""
    first = token_similarity(F.get(words_a, F.lit(0)), F.get(words_b, F.lit(0)))
    family = token_similarity(F.get(words_a, F.size(words_a) - 1), F.get(words_b, F.size(words_b) - 1))
    score = F.when(F.size(words_a) == F.size(words_b), _same_length(words_a, words_b, first, family)).otherwise(_other_length(words_a, words_b, first, family))
    score = F.when((first < 0.6) | (family < 0.6), score * 0.72).otherwise(score)
    return (
        F.when(key_a == key_b, 1.0)
        .when(soft_a == soft_b, 0.94)
        .when((F.size(words_a) == 0) | (F.size(words_b) == 0), 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)))
    )


def name_similarity(a: Column, b: Column) -> Column:
    """Of two texts; 0 if either is null or empty."""
    soft_a, soft_b = soft(a), soft(b)
    empty = F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe("")
    return F.when(empty, 0.0).otherwise(similarity(key(a), key(b), soft_a, soft_b, tokens(soft_a), tokens(soft_b)))


def with_similarity(df: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """df with the similarity of two texts. Keys, soft keys and words are columns first, so none is computed twice."""
    df = df.withColumns({"_empty": F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe(""), "_ka": key(a), "_kb": key(b)})
    df = df.withColumns({"_sa": soft_of_key(F.col("_ka")), "_sb": soft_of_key(F.col("_kb"))}).withColumns({"_wa": tokens(F.col("_sa")), "_wb": tokens(F.col("_sb"))})
    score = similarity(*[F.col(c) for c in ("_ka", "_kb", "_sa", "_sb", "_wa", "_wb")])
    return df.withColumn(name, F.when(F.col("_empty"), 0.0).otherwise(score)).drop("_empty", "_ka", "_kb", "_sa", "_sb", "_wa", "_wb")


def similarity_bound(n_a: Column, n_b: Column) -> Column:
    """The most that names of so many words can score, equal keys aside."""
    fewer, more = F.least(n_a, n_b), F.greatest(n_a, n_b)
    return F.when(n_a == n_b, 1.0).otherwise((F.lit(0.56) + F.lit(0.44) * fewer / more) * F.greatest(F.lit(0.55), F.lit(1.0) - (more - fewer) * 0.13))


def ocr_key(text: Column, nfkc: bool = True) -> Column:
    """A reading's key when readings vote."""
    text = F.translate(_nfkc(text) if nfkc else text, "٠١٢٣٤٥٦٧٨٩", "0123456789")
    return trimmed(F.regexp_replace(text, "(?U)[\\s\u200e\u200f]+", " "))


def clean_cell(text: Column) -> Column:
    """A roster cell without its row number and rank."""
    text = single_spaced(F.regexp_replace(trimmed(text), r"(?U)^[٠-٩0-9]+\s*[\-–.]\s*", ""))
    for rank in sorted(RANKS, key=len, reverse=True):
        text = F.regexp_replace(text, rf"\s*{re.escape(rank)}\z", "")
    for rank in MISREAD_RANKS:
        text = F.replace(text, F.lit(rank), F.lit(""))
    return trimmed(text)


def is_rank(text: Column) -> Column:
    return _bound(key(text), _is_rank_key)


def _is_rank_key(keyed: Column) -> Column:
    return keyed.isin(*RANKS, "اول", "أول") | keyed.rlike(r"(?U)^و\.?\s*رقيب$") | keyed.startswith("جندي") | keyed.startswith("جندى")


def _digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[\d٠-٩]"))


def is_name_cell(text: Column) -> Column:
    """Whether a roster cell reads like a person's name."""
    return _bound(clean_cell(text), lambda cleaned: _bound(key(cleaned), lambda keyed: _is_name(cleaned, keyed)))


def _is_name(cleaned: Column, keyed: Column) -> Column:
    wrong = is_rank(keyed) | keyed.rlike(HEADER) | cleaned.rlike(DATE_IN_CELL) | cleaned.rlike(ROW_NUMBER) | (_digits(cleaned) >= 4)
    return (F.char_length(keyed) >= 6) & F.size(tokens(keyed)).between(2, 6) & ~wrong & keyed.rlike(ARABIC + "{3,}")


def strip_fields(text: Column) -> Column:
    """A target line without its label, rank and row number."""
    text = F.regexp_replace(F.regexp_replace(trimmed(text), r"(?U)^(الأسم|الاسم)\s*:\s*", ""), TARGET_RANK, " ")
    text = F.regexp_replace(text, r"(?U)^[٠-٩0-9]+\s*[-–.]?\s*", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^[ \\-–.،]+|[ \\-–.،]+$", "")


def is_target_name(text: Column) -> Column:
    """Whether a line of a target list reads like a person's name."""
    return _bound(key(strip_fields(text)), _is_target_key)


def _is_target_key(keyed: Column) -> Column:
    words = tokens(keyed)
    return (F.char_length(keyed) >= 6) & F.size(words).between(2, 6) & ~keyed.rlike(NO_NAME) & (_digits(keyed) == 0) & F.forall(words, lambda w: w.rlike(ARABIC))
