"""Lists, folders, snapshots and recorded readings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The suffixes that a folder scan takes, and those of each kind.
PDF, WORKBOOKS, IMAGES = (".pdf",), (".xlsx", ".xlsm"), (".png", ".jpg", ".jpeg", ".heic", ".tif", ".tiff")
READING = T.StructType([T.StructField(n, k) for n, k in (("text", T.StringType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("w", T.DoubleType()), ("h", T.DoubleType()), ("confidence", T.DoubleType()))])
#: The columns of an OCR engine's tab-separated output.
TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def names(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, ord, name) from text files, a name a line."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("name"))
    return lines.select(F.sha1(F.concat_ws("#", "path", "line")).substr(1, 8).alias("id"), F.struct("path", "line").alias("ord"), "name")


def typed(spark: SparkSession, given: list[str]) -> DataFrame:
    """(id, ord, name) from names that somebody typed."""
    rows = [(f"n{k}", ("", k), name) for k, name in enumerate(given)]
    return spark.createDataFrame(rows, "id string, ord struct<path:string,line:long>, name string")


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (*PDF, *WORKBOOKS, *IMAGES)) -> DataFrame:
    """(path, content), by path, of a folder's files of the suffixes. Read by Spark, so any file system will do."""
    globbed = "*{" + ",".join(suffixes + tuple(s.upper() for s in suffixes)) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", globbed).load(folder).select("path", "content").orderBy("path")


def by_kind(paths: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Master paths as (pdfs, workbooks, ignored)."""
    kind = lambda suffixes: [p for p in paths if p.lower().endswith(suffixes)]
    pdfs, books = kind(PDF), kind(WORKBOOKS)
    return pdfs, books, [p for p in paths if p not in pdfs and p not in books]


def readings_json(lines: DataFrame) -> DataFrame:
    """Readings from JSON lines (page, source, line): y from the bottom; lines that can't be read go."""
    parsed = lines.withColumn("r", F.from_json("line", READING))
    legible = F.coalesce(F.col("r.text"), F.lit("")) != ""
    number = lambda name: F.coalesce(F.col(f"r.{name}"), F.lit(0.0)).alias(name)
    return parsed.where(legible & F.col("r.x").isNotNull()).select("page", F.col("r.text").alias("text"), *[number(c) for c in ("x", "y", "w", "h", "confidence")], "source")


def readings_tsv(lines: DataFrame) -> DataFrame:
    """Readings from an OCR engine's tab-separated lines (page, source, line, width, height): pixels from the top become shares from
    the bottom; lines without text or with a negative confidence go; confidences are percents."""
    parsed = lines.withColumn("r", F.from_csv("line", TSV, {"sep": "\t", "quote": "", "mode": "PERMISSIVE"}))
    read = parsed.where((F.col("r.conf") >= 0) & (F.trim("r.text") != ""))
    share = lambda value, of: (value / F.col(of)).cast("double")
    return read.select(
        "page", F.trim("r.text").alias("text"), share(F.col("r.left"), "width").alias("x"), (1 - share(F.col("r.top") + F.col("r.height"), "height")).alias("y"),
        share(F.col("r.width"), "width").alias("w"), share(F.col("r.height"), "height").alias("h"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r.conf") / 100)).alias("confidence"), "source",
    )


def snapshots(spark: SparkSession, folder: str, most: int = 20) -> DataFrame:
    """The newest snapshots (session_id, phase, summary, mtime): a top-k report."""
    rows = spark.read.schema("phase string, summary map<string, string>").option("multiLine", True).json(folder)
    name = F.regexp_extract("_metadata.file_path", r"([A-Za-z0-9_-]+)(?:\.json)?(?:/[^/]*)?$", 1)
    return rows.select(name.alias("session_id"), "phase", "summary", F.col("_metadata.file_modification_time").alias("mtime")).orderBy(F.desc("mtime")).limit(most)
