"""A corpus through four stages: language, near copies, benchmark leaks, token ids.

Each stage's function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's docs. All but the last return the columns of documents. Stages 2 to 4 need hash signatures, models or
tables on the workers, so there is no SQL for the whole; the tests hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sijill.llm.common import table, written
from sijill.llm.decontaminate import decontaminate
from sijill.llm.lang_id import keep_identified
from sijill.llm.ngram_join import keep_one_of_each
from sijill.llm.sentencepieces import encode_documents

STAGES = [
    ("language_id", keep_identified),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece_ids", encode_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
