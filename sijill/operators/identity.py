"""Identity of targets: exact keys, fuzzy proposals, corrections. A fuzzy match never verifies anybody.

Tables: `person` (person_key, original_name, pages, ord), `target` (id, ord, original_name, normalized_name, confidence,
status, candidates array<struct<name, normalized, confidence, pages>>, matched_master_name, user_corrected_name,
visual_confidence, ocr_agreement). Master lists are rosters; the fuzzy join blocks both sides by what a
score of 0.52 needs, instead of pairing all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import names

#: Statuses of a target.
VERIFIED, NEEDS_REVIEW, UNKNOWN = "مؤكد", "يحتاج مراجعة", "غير معروف"
AMBIGUOUS, NOT_IN_MASTER = "الاسم غير محسوم ويحتاج مراجعة", "غير موجود في الملف الرئيسي"
#: Thresholds.
CANDIDATE, PROPOSAL, RIVAL, GAP, CANDIDATES, NEAR, SURE = 0.52, 0.62, 0.68, 0.10, 7, 0.88, 0.97
CANDIDATE_TYPE = "array<struct<name:string,normalized:string,confidence:double,pages:array<bigint>>>"


def display_name() -> Column:
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(filled("user_corrected_name"), filled("matched_master_name"), F.col("original_name"))


def soft_parts(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """df with the soft key, its words and their number."""
    return df.withColumn(f"{prefix}soft", names.soft_of_key(F.col(key))).withColumn(f"{prefix}words", names.tokens(F.col(f"{prefix}soft"))).withColumn(f"{prefix}n", F.size(f"{prefix}words"))


def scored_pairs(queries: DataFrame, master: DataFrame, least: float = CANDIDATE) -> DataFrame:
    """(query_key, person_key, score) of all pairs that reach `least`: queries (query_key) and persons are paired through the numbers of words that
    can, with a bound on the score before the similarity itself."""
    q = soft_parts(queries.select("query_key").where(F.col("query_key") != "").distinct(), "query_key", "q_")
    p = soft_parts(master.select("person_key"), "person_key", "p_")
    # The word counts that occur are few; pairs of them that can reach `least` make the blocks.
    blocks = q.select("q_n").distinct().join(F.broadcast(p.select("p_n").distinct()), names.similarity_bound(F.col("q_n"), F.col("p_n")) >= least)
    pairs = q.join(F.broadcast(blocks), "q_n").join(p, "p_n")
    score = names.similarity(F.col("query_key"), F.col("person_key"), F.col("q_soft"), F.col("p_soft"), F.col("q_words"), F.col("p_words"))
    return pairs.select("query_key", "person_key", score.alias("score")).where(F.col("score") >= least)


def matches(queries: DataFrame, master: DataFrame) -> DataFrame:
    """(query_key, status, match_confidence, candidates, matched): each distinct key against the master list. Exact keys
    verify; the rest get up to seven candidates, a proposal if the best is good and clear, or ambiguity."""
    keys = queries.select("query_key").distinct()
    known = master.select("person_key", "original_name", "pages")
    one = lambda score: F.struct(F.col("original_name").alias("name"), F.col("person_key").alias("normalized"), score.alias("confidence"), F.col("pages").cast("array<bigint>").alias("pages"))
    exact = keys.join(known, keys["query_key"] == known["person_key"]).where(F.col("query_key") != "")
    exact = exact.select("query_key", F.lit(VERIFIED).alias("status"), F.lit(1.0).alias("match_confidence"), F.array(one(F.lit(1.0))).cast(CANDIDATE_TYPE).alias("candidates"), F.col("original_name").alias("matched"))
    rest = keys.join(known.select(F.col("person_key").alias("query_key")), "query_key", "left_anti")
    place = Window.partitionBy("query_key").orderBy(F.desc("score"), "person_key")
    top = scored_pairs(rest, master).withColumn("place", F.row_number().over(place)).where(F.col("place") <= CANDIDATES)
    listed = top.join(known, "person_key").groupBy("query_key").agg(F.array_sort(F.collect_list(F.struct("place", "score", one(F.round("score", 4)).alias("c")))).alias("top"))
    best, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    rival = (best["score"] >= RIVAL) & F.coalesce((second["c"]["normalized"] != best["c"]["normalized"]) & (best["score"] - second["score"] < GAP), F.lit(False))
    some = master.select("person_key").limit(1).agg(F.count(F.lit(1)).alias("has_master"))
    status = F.when(F.col("has_master") == 0, NEEDS_REVIEW).when(best.isNull(), NOT_IN_MASTER).when(rival, AMBIGUOUS).when(best["score"] >= PROPOSAL, NEEDS_REVIEW).otherwise(NOT_IN_MASTER)
    fuzzy = rest.join(listed, "query_key", "left").join(F.broadcast(some)).select(
        "query_key", status.alias("status"), F.coalesce(best["score"], F.lit(0.0)).alias("match_confidence"),
        F.coalesce(F.transform("top", lambda x: x["c"]), F.array()).cast(CANDIDATE_TYPE).alias("candidates"),
        F.when(~rival & (best["score"] >= PROPOSAL), best["c"]["name"]).alias("matched"),
    )
    return exact.unionByName(fuzzy)


def targets(listed: DataFrame, master: DataFrame) -> DataFrame:
    """Targets from a list (id, ord, name): names of three characters at least, the first of each key, matched."""
    named = listed.withColumn("original_name", names.trimmed(F.coalesce("name", F.lit("")))).where(F.char_length("original_name") >= 3)
    named = named.withColumn("query_key", names.key(F.col("original_name")))
    first = written(named.groupBy("query_key").agg(F.min_by(F.struct("id", "ord", "original_name"), "ord").alias("t")).select("query_key", "t.*"), "first")
    found = first.join(matches(first, master), "query_key")
    made = found.select(
        "id", "ord", "original_name", F.col("query_key").alias("normalized_name"), F.round("match_confidence", 4).alias("confidence"), "status", "candidates",
        F.col("matched").alias("matched_master_name"), F.lit(None).cast("string").alias("user_corrected_name"), F.lit(None).cast("double").alias("visual_confidence"), F.lit(None).cast("int").alias("ocr_agreement"),
    )
    return written(made, "targets")


def from_readings(readings: DataFrame, master: DataFrame) -> DataFrame:
    """Targets from read names (id, page, y, text, confidence, agreement): an exact match read faintly or once needs a review; the
    most certain reading of each key stays; ordered by page, then downwards."""
    rows = readings.withColumn("query_key", names.key(F.col("text")))
    found = rows.join(matches(rows, master), "query_key")
    visual = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    found = found.withColumns({
        "visual_confidence": visual,
        "identity": F.round(visual * 0.58 + F.col("match_confidence") * 0.42, 4),
        "status": F.when((F.col("status") == VERIFIED) & ((visual < 0.82) | (F.col("agreement") < 2)), NEEDS_REVIEW).otherwise(F.col("status")),
    })
    place = Window.partitionBy("query_key").orderBy(F.desc("identity"), "page", F.desc("y"), "id")
    best = found.withColumn("place", F.row_number().over(place)).where("place = 1")
    return best.select(
        "id", F.struct("page", (-F.col("y")).alias("down")).alias("ord"), F.col("text").alias("original_name"), F.col("query_key").alias("normalized_name"), F.col("identity").alias("confidence"),
        "status", "candidates", F.col("matched").alias("matched_master_name"), F.lit(None).cast("string").alias("user_corrected_name"), "visual_confidence", F.col("agreement").cast("int").alias("ocr_agreement"),
    )


def appended(present: DataFrame, new: DataFrame) -> DataFrame:
    """Targets and the new ones whose key isn't there."""
    return present.unionByName(new.join(present.select("normalized_name"), "normalized_name", "left_anti"))


def near_duplicates(master: DataFrame, least: float = NEAR) -> DataFrame:
    """(a, b, score), a before b: pairs of names that may be one person. A score of 0.88 needs equally many words, and if
    there are three, first and family words of 0.625 each, so each pair shares a block of (words, length of the first word within its bounds)."""
    p = soft_parts(master.select("person_key", "original_name", "ord"), "person_key", "")
    first = F.char_length(F.get("words", F.lit(0)))
    p = p.withColumn("length", first)
    left, right = p.alias("l"), p.alias("r")
    # Similarity s of two words needs lengths within a factor of s; a first word under 0.5 can't reach 0.88 with any others.
    alike = F.least("l.length", "r.length") >= F.greatest("l.length", "r.length") * 0.5
    alike = F.coalesce(alike, F.lit(True))  # names without words
    pairs = left.join(right, (F.col("l.n") == F.col("r.n")) & (F.col("l.ord") < F.col("r.ord")) & alike)
    score = names.similarity(F.col("l.person_key"), F.col("r.person_key"), F.col("l.soft"), F.col("r.soft"), F.col("l.words"), F.col("r.words"))
    return pairs.select(F.col("l.person_key").alias("a"), F.col("r.person_key").alias("b"), score.alias("score"), F.col("l.original_name").alias("name_a"), F.col("r.original_name").alias("name_b"), F.col("l.ord").alias("ord_a"), F.col("r.ord").alias("ord_b")).where(F.col("score") >= least)


def flag_near_duplicates(master: DataFrame) -> DataFrame:
    """Persons with the names of their near duplicates as aliases, and a review flag. Nobody is merged."""
    pairs = near_duplicates(master)
    both = pairs.select(F.col("a").alias("person_key"), F.col("ord_b").alias("o"), F.col("name_b").alias("alias")).unionByName(pairs.select(F.col("b").alias("person_key"), F.col("ord_a").alias("o"), F.col("name_a").alias("alias")))
    found = both.groupBy("person_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "alias"))), lambda x: x["alias"]).alias("_near"))
    rows = master.join(found, "person_key", "left")
    empty = F.array().cast("array<string>")
    aliases = F.col("aliases") if "aliases" in master.columns else empty
    flag = F.col("identity_needs_review") if "identity_needs_review" in master.columns else F.lit(False)
    return rows.withColumn("aliases", F.array_distinct(F.concat(F.coalesce(aliases, empty), F.coalesce("_near", empty)))).withColumn("identity_needs_review", F.coalesce(flag, F.lit(False)) | F.col("_near").isNotNull()).drop("_near")


def candidate_gap() -> Column:
    first, second = F.get("candidates", F.lit(0))["confidence"], F.get("candidates", F.lit(1))["confidence"]
    return F.when(second.isNotNull(), first - second).when(first.isNotNull(), 1.0).otherwise(0.0)


def auto_commands(targets_: DataFrame, least: float = SURE) -> DataFrame:
    """(seq, id, action, name): what can be confirmed without a person."""
    matched, status = F.coalesce(F.col("matched_master_name"), F.lit("")) != "", F.col("status")
    read = F.col("visual_confidence").isNotNull() | F.col("ocr_agreement").isNotNull()
    faint = read & ((F.coalesce("visual_confidence", F.lit(0.0)) < 0.9) | (F.coalesce("ocr_agreement", F.lit(0)) < 2))
    clear = (F.size("candidates") < 2) | (candidate_gap() >= GAP)
    confirm = (status == VERIFIED) & matched
    adopt = ~confirm & matched & (F.col("confidence") >= least) & ~status.isin(AMBIGUOUS, NOT_IN_MASTER) & ~faint & clear
    return targets_.where(confirm | adopt).select(F.lit(0).cast("long").alias("seq"), "id", F.when(confirm, "confirm").otherwise("set_name").alias("action"), F.when(~confirm, F.col("matched_master_name")).alias("name"))


def corrected(targets_: DataFrame, commands: DataFrame, master: DataFrame) -> DataFrame:
    """Targets after commands (seq, id, action, name): confirm, set_name, choose_candidate, reject; unknown ids and empty names do nothing.

    Naming commands overwrite what came before them, whatever it was, and the other two only change the status (and
    confirm the corrected name). So a target's state follows from its last naming command, then from the last of the
    others after it: no replay, two lookups."""
    said = commands.withColumn("name", names.trimmed(F.coalesce("name", F.lit(""))))
    naming = said.where(F.col("action").isin("set_name", "choose_candidate") & (F.col("name") != ""))
    last_name = naming.groupBy("id").agg(F.max_by(F.struct("seq", "action", "name"), "seq").alias("n"))
    last_name = last_name.withColumn("query_key", names.key(F.col("n.name")))
    found = last_name.join(matches(last_name, master).withColumnsRenamed({"status": "m_status", "candidates": "m_candidates"}), "query_key")
    exact, chosen = F.col("m_status") == VERIFIED, F.col("n.action") == "choose_candidate"
    matched_key = names.key(F.col("matched"))
    # A chosen name that only resembles a person is that person; one that resembles nobody is nobody.
    found = found.select(
        "id", F.col("n.seq").alias("n_seq"), F.col("n.name").alias("n_name"), F.col("matched").alias("n_matched"), exact.alias("n_exact"), "match_confidence", "m_candidates",
        F.when(chosen & ~exact & F.col("matched").isNotNull(), matched_key).otherwise(F.col("query_key")).alias("n_key"),
        F.when(~chosen | exact, F.col("m_status")).when(F.col("matched").isNotNull(), VERIFIED).otherwise(NOT_IN_MASTER).alias("n_status"),
    )
    rows = targets_.join(found, "id", "left")
    named = F.col("n_seq").isNotNull()
    rows = rows.withColumns({
        "user_corrected_name": F.when(named, F.col("n_name")).otherwise(F.col("user_corrected_name")),
        "normalized_name": F.when(named, F.col("n_key")).otherwise(F.col("normalized_name")),
        "matched_master_name": F.when(named, F.col("n_matched")).otherwise(F.col("matched_master_name")),
        "status": F.when(named, F.col("n_status")).otherwise(F.col("status")),
        "confidence": F.when(named & ~F.col("n_exact"), F.col("match_confidence")).otherwise(F.col("confidence")),
        "candidates": F.when(named & ~F.col("n_exact"), F.col("m_candidates")).otherwise(F.col("candidates")),
    })
    others = said.where(F.col("action").isin("confirm", "reject")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "action"))).alias("_others"))
    after = F.filter("_others", lambda c: c["seq"] > F.coalesce("n_seq", F.lit(-1)))
    matched = F.coalesce(F.col("matched_master_name"), F.lit("")) != ""
    effective = F.filter(after, lambda c: (c["action"] == "reject") | matched)
    last, confirms = F.element_at(effective, -1)["action"], F.exists(effective, lambda c: c["action"] == "confirm")
    rows = rows.join(others, "id", "left").withColumn("_last", F.when(F.size(effective) > 0, last)).withColumn("_confirms", F.coalesce(confirms, F.lit(False)))
    return rows.withColumns({
        "user_corrected_name": F.when(F.col("_confirms"), F.col("matched_master_name")).otherwise(F.col("user_corrected_name")),
        "status": F.when(F.col("_last") == "confirm", VERIFIED).when(F.col("_last") == "reject", UNKNOWN).otherwise(F.col("status")),
    }).select(*targets_.columns)


def summary(targets_: DataFrame) -> DataFrame:
    """One row: target_total, target_verified, target_needs_review, target_not_in_master."""
    count = lambda *status: F.count_if(F.col("status").isin(*status))
    return targets_.agg(F.count(F.lit(1)).alias("target_total"), count(VERIFIED).alias("target_verified"), count(NEEDS_REVIEW, AMBIGUOUS).alias("target_needs_review"), count(UNKNOWN, NOT_IN_MASTER).alias("target_not_in_master"))


def resolved(targets_: DataFrame, master: DataFrame, softly: bool = True) -> DataFrame:
    """Targets with person_key: by the display name's key, else by the matched name's key, else by the soft key if exactly one
    person has it. soft_hits says how many do."""
    keys = master.select("person_key")
    rows = targets_.withColumns({"_shown": names.key(display_name()), "_matched": names.key(F.col("matched_master_name")), "_soft": names.soft(display_name())})
    rows = rows.join(keys.select(F.col("person_key").alias("_shown"), F.col("person_key").alias("_by_shown")), "_shown", "left")
    rows = rows.join(keys.select(F.col("person_key").alias("_matched"), F.col("person_key").alias("_by_matched")), "_matched", "left")
    by_soft = master.groupBy(names.soft(F.col("original_name")).alias("_soft")).agg(F.count(F.lit(1)).alias("_hits"), F.min("person_key").alias("_by_soft"))
    rows = rows.join(by_soft, "_soft", "left")
    exact = F.coalesce("_by_shown", "_by_matched")
    one = F.when((F.col("_hits") == 1) & F.lit(softly), F.col("_by_soft"))
    return rows.withColumn("person_key", F.coalesce(exact, one)).withColumn("soft_hits", F.when(exact.isNull() & F.lit(softly), F.coalesce("_hits", F.lit(0))).otherwise(0)).drop("_shown", "_matched", "_soft", "_by_shown", "_by_matched", "_hits", "_by_soft")
