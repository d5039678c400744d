"""What jobs on a cluster need: shared tables that cut lineage, and this package on the Python workers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, one machine makes a local one; a cluster can't."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='sijill-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: df as a table in the shared folder, read again with its own schema. What is used more than once is
    computed once, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sijill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_side(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts both. Spark takes arrays, exploded rows and small files for far smaller than their rows, and would
    collect them in the driver to send them to all executors."""
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application: they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sijill-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
