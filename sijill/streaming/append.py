"""Evidence that keeps arriving: occurrence files are scored as they come, and the ranking is recomputed from all evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import evidence as ev

OCCURRENCES = "person_key string, ord long, notes string, page long, confidence double, agreement int, association double"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of evidence from occurrence files (Parquet) of a folder. Row by row, so without state or watermark."""
    return ev.from_notes(spark.readStream.schema(OCCURRENCES).parquet(folder))


def append(spark: SparkSession, folder: str, evidence_path: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Appends what is new to the evidence table, each file once, then calls `then` with the whole table. A batch that is replayed after a
    failure overwrites its own folder, so nothing counts twice."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{evidence_path}/batch={number}")
        if then is not None:
            then(batch.sparkSession.read.parquet(evidence_path).drop("batch"))

    return scored(spark, folder).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
