"""The subpackage's registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import license_scan
from .chat_format import OP3_SQL, op3_chat_format
from .decontaminate import OP9_SQL, op9_decontaminate
from .html_text import op7_html_text
from .lang_id import op1_lang_id
from .license_scan import op8_license_scan
from .lm_score import op10_lm_score
from .nearest import op2_nearest
from .ngram_join import OP5_SQL, op5_ngram_join
from .sentencepieces import op6_sentencepieces
from .token_counts import op4_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lang_id": op1_lang_id,
    "op2_nearest": op2_nearest,
    "op3_chat_format": op3_chat_format,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_join": op5_ngram_join,
    "op6_sentencepieces": op6_sentencepieces,
    "op7_html_text": op7_html_text,
    "op8_license_scan": op8_license_scan,
    "op9_decontaminate": op9_decontaminate,
    "op10_lm_score": op10_lm_score,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": OP3_SQL,
    "op5_ngram_join": OP5_SQL,
    "op8_license_scan": license_scan.oracle_sql(),
    "op9_decontaminate": OP9_SQL,
}
