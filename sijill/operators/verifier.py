"""A second reader's answers: validation, and what they may confirm. They never add a person or a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import sorted_side
from ..functions import hijri, names
from . import identity

#: Thresholds, and the decisions written beside a row.
LEGIBLE, ALIKE, LOCAL, SELECTED, LONGEST = 0.95, 0.95, 0.80, 0.78, 220
CONFIRMED, DISAGREEMENT, UNREADABLE = "confirmed", "disagreement", "unreadable"
PAGE_ROWS, TARGET_ROWS, MOST_ROWS = 80, 60, 200


def bounded(value: int, default: int) -> int:
    """A configured number of rows, held to 1..200."""
    return max(1, min(MOST_ROWS, value if value is not None else default))


def readings(payloads: DataFrame, asked: DataFrame) -> DataFrame:
    """(row_id, transcription, selected_candidate, dates, confidence, legible) from JSON (batch, payload) for asked rows (row_id,
    candidates): the first valid answer of each. Unknown rows, wrong types, long texts and candidates that weren't offered go."""
    each = payloads.select("batch", F.posexplode(F.expr("try_variant_get(try_parse_json(payload), '$.rows', 'array<variant>')")).alias("nth", "v"))
    kind = lambda path: F.expr(f"schema_of_variant(try_variant_get(v, '$.{path}', 'variant'))")
    text = lambda path: F.expr(f"try_variant_get(v, '$.{path}', 'string')")
    valid = (
        (kind("row_id") == "STRING") & (kind("transcription") == "STRING") & (kind("selected_candidate") == "STRING") & (kind("legible") == "BOOLEAN")
        & kind("confidence").rlike(r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$") & kind("dates").isin("ARRAY<STRING>", "ARRAY<VOID>")
    )
    checked = each.where(F.coalesce(valid, F.lit(False))).select(
        "batch", "nth", text("row_id").alias("row_id"), text("transcription").alias("transcription"), text("selected_candidate").alias("selected_candidate"),
        F.expr("try_variant_get(v, '$.dates', 'array<string>')").alias("dates"), F.expr("try_variant_get(v, '$.confidence', 'double')").alias("confidence"), F.expr("try_variant_get(v, '$.legible', 'boolean')").alias("legible"),
    )
    offered = checked.join(sorted_side(asked.select("row_id", "candidates")), "row_id").where((F.char_length("transcription") <= LONGEST) & ((F.col("selected_candidate") == "") | F.array_contains("candidates", F.col("selected_candidate"))))
    order = Window.partitionBy("row_id").orderBy("batch", "nth")
    dates = F.array_distinct(F.filter(F.transform("dates", names.trimmed), lambda d: d != ""))
    first = offered.withColumn("place", F.row_number().over(order)).where("place = 1")
    return first.select("row_id", names.trimmed(F.col("transcription")).alias("transcription"), "selected_candidate", dates.alias("dates"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence"), "legible")


def normalized_dates(dates: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(dates, hijri.parse))))


def uncertain_targets(targets: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """(row_id, candidates) worth a second reading: with candidates, not yet read well; the first `most`."""
    offered = F.filter(F.transform(F.slice("candidates", 1, identity.CANDIDATES), lambda c: names.trimmed(c["name"])), lambda n: n != "")
    strong = (F.col("status") == identity.VERIFIED) & (F.coalesce("visual_confidence", F.lit(0.0)) >= 0.9) & (F.coalesce("ocr_agreement", F.lit(0)) >= 2)
    return targets.where(~strong).select(F.col("id").alias("row_id"), "ord", offered.alias("candidates")).where(F.size("candidates") > 0).orderBy("ord").limit(bounded(most, TARGET_ROWS)).drop("ord")


def confirm_targets(targets: DataFrame, answers: DataFrame) -> DataFrame:
    """targets after second readings, with hybrid_decision: confirmed only where reading, proposal and both similarities agree."""
    a = answers.select(F.col("row_id").alias("id"), *[F.col(c).alias(f"r_{c}") for c in ("transcription", "selected_candidate", "confidence", "legible")])
    rows = targets.join(a, "id", "left")
    selected = F.col("r_selected_candidate")
    rows = names.with_similarity(names.with_similarity(rows, F.col("original_name"), selected, "_local"), F.col("r_transcription"), selected, "_read")
    chosen = F.coalesce(F.get(F.filter("candidates", lambda c: c["name"] == selected), F.lit(0))["confidence"], F.lit(0.0))
    local = F.col("_local")
    alike = (names.key(F.col("r_transcription")) == names.key(selected)) | (F.col("_read") >= ALIKE)
    agreed = (
        F.col("r_legible") & (F.col("r_confidence") >= LEGIBLE) & (selected != "") & (selected == F.coalesce("matched_master_name", F.lit(""))) & (F.col("status") != identity.AMBIGUOUS)
        & (chosen >= SELECTED) & (identity.candidate_gap() >= identity.GAP) & (local >= LOCAL) & alike
    )
    agreed = F.coalesce(agreed, F.lit(False))
    score = F.round(F.least(F.lit(0.995), F.greatest(F.col("confidence"), local) * 0.38 + chosen * 0.32 + F.col("r_confidence") * 0.30), 4)
    rows = rows.withColumn("_agreed", agreed).withColumn("_score", score)
    decision = F.when(F.col("r_legible").isNull(), F.lit(None)).when(~F.col("r_legible"), UNREADABLE).when(F.col("_agreed"), CONFIRMED).otherwise(DISAGREEMENT)
    return rows.withColumns({
        "hybrid_decision": decision,
        "normalized_name": F.when(F.col("_agreed"), names.key(selected)).otherwise(F.col("normalized_name")),
        "matched_master_name": F.when(F.col("_agreed"), selected).otherwise(F.col("matched_master_name")),
        "status": F.when(F.col("_agreed"), identity.VERIFIED).otherwise(F.col("status")),
        "confidence": F.when(F.col("_agreed"), F.col("_score")).otherwise(F.col("confidence")),
    }).select(*targets.columns, "hybrid_decision")


def _local_dates() -> Column:
    return F.array_sort(F.transform(hijri.extract(F.col("notes")), lambda d: d["date"]))


def row_id() -> Column:
    return F.concat(F.lit("m"), F.col("page"), F.lit("r"), F.col("row_index"))


def uncertain_rows(page_rows: DataFrame, most: int = PAGE_ROWS) -> DataFrame:
    """(row_id, candidates) of each page's first `most` rows that are worth a second reading: uncertain dates, or what may be one."""
    dates = F.size(_local_dates())
    weak = (F.col("confidence") < 0.93) | (F.col("agreement") < 2) | (F.col("association") < 0.95)
    missed = (dates == 0) & F.col("notes").rlike(r"[٠-٩0-9]{3,5}(?U:\s*)[/\-.]")
    first = page_rows.where(F.col("row_index") < bounded(most, PAGE_ROWS))
    return first.where(((dates > 0) & weak) | missed).where(F.col("original_name") != "").select(row_id().alias("row_id"), F.array("original_name").alias("candidates"))


def confirm_rows(page_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Roster rows after second readings, with hybrid_decision: the name must agree for its confidence, and equal dates for theirs."""
    a = answers.select("row_id", *[F.col(c).alias(f"r_{c}") for c in ("transcription", "selected_candidate", "dates", "confidence", "legible")])
    rows = page_rows.withColumn("row_id", row_id()).join(a, "row_id", "left")
    rows = names.with_similarity(rows, F.col("r_transcription"), F.col("original_name"), "_read").withColumn("_local", _local_dates())
    same_name = (names.key(F.col("r_transcription")) == names.key(F.col("original_name"))) | (F.col("_read") >= ALIKE)
    named = F.coalesce(F.col("r_legible") & (F.col("r_confidence") >= LEGIBLE) & (F.col("r_selected_candidate") == F.col("original_name")) & same_name, F.lit(False))
    local = F.col("_local")
    dated = F.coalesce((F.size(local) > 0) & (local == normalized_dates(F.col("r_dates"))), F.lit(False))
    rows = rows.withColumns({"_named": named, "_dated": dated, "_none": F.size(local) == 0})
    both = F.col("_named") & F.col("_dated")
    decision = F.when(F.col("r_legible").isNull(), F.lit(None)).when(~F.col("r_legible"), UNREADABLE).when(F.col("_named") & (F.col("_dated") | F.col("_none")), CONFIRMED).otherwise(DISAGREEMENT)
    return rows.withColumns({
        "hybrid_decision": decision,
        "name_confidence": F.when(F.col("_named"), F.greatest("name_confidence", F.lit(0.96))).otherwise(F.col("name_confidence")),
        "confidence": F.when(both, F.greatest("confidence", F.lit(0.96))).otherwise(F.col("confidence")),
        "agreement": F.when(both, F.greatest("agreement", F.lit(2))).otherwise(F.col("agreement")),
    }).select(*page_rows.columns, "hybrid_decision")
