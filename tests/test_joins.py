"""No join sends exploded rows, or rows with arrays, through the driver: Spark takes them for small."""

import pytest
from pyspark.sql import functions as F

from sijill.operators import ranking, tokens, verifier


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def people(spark):
    dates = F.array(F.lit(14430101), F.lit(14430101) + F.col("id").cast("int") % 20)
    return spark.range(100).select("id", F.format_string("p%03d", "id").alias("original_name"), F.format_string("p%03d", "id").alias("normalized_name"), dates.alias("dates"))


def test_ranking_sorts_its_joins(people):
    found = ranking.classes(people.withColumn("seq", ranking.history(F.col("dates"))))
    for df in (ranking.bounds(found), ranking.rank_people(people), ranking.versus_previous(ranking.rank_people(people))):
        text = plan(df)
        assert "SortMergeJoin" in text and "BroadcastHashJoin [seq" not in text and "BroadcastHashJoin [prefix" not in text and "BroadcastHashJoin [position" not in text


def pages(spark):
    marks = spark.range(9).select((F.col("id") % 3).alias("page"), F.concat(F.lit("t"), "id").alias("text"), F.lit(0.2).alias("x"), F.lit(0.33).alias("y"), F.lit(0.15).alias("w"), F.lit(0.1).alias("h"))
    grid = spark.range(3).select(F.col("id").alias("page"), F.lit(0.1).alias("notes_right"), F.lit(0.2).alias("name_left"), F.lit(0.4).alias("name_right"))
    return marks, spark.range(6).select((F.col("id") % 3).alias("page"), (F.floor(F.col("id") / 3) * 0.2 + 0.5).alias("y")), grid


def test_bands_sort_their_joins(spark):
    assert "Broadcast" not in plan(tokens.in_bands(*pages(spark)))


def test_highlights_sort_their_joins(spark):
    pixels = spark.range(9).select((F.col("id") % 3).alias("page"), F.col("id").cast("int").alias("px"), F.lit(22).alias("py"), F.lit(30).alias("hue"), F.lit(90).alias("saturation"), F.lit(120).alias("value"))
    assert "Broadcast" not in plan(tokens.highlight_scores(pages(spark)[0], pixels, spark.range(3).select(F.col("id").alias("page"), F.lit(40).alias("width"), F.lit(40).alias("height"))))


def test_rules_sort_their_join(spark):
    dark = spark.range(200).select(F.lit(1).cast("long").alias("page"), F.col("id").alias("px"), F.lit(0).cast("long").alias("py"), F.lit(True).alias("dark"))
    found = tokens.ruled(dark, "px", "py", F.lit(200))
    assert "Broadcast" not in plan(found) and found.count() == 1


def test_readings_sort_their_join(spark):
    answers = spark.range(2).select(F.col("id").alias("batch"), F.lit("{}").alias("payload"))
    asked = spark.range(2).select(F.col("id").cast("string").alias("row_id"), F.array(F.lit("a")).alias("candidates"))
    assert "Broadcast" not in plan(verifier.readings(answers, asked))
