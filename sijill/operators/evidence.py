"""Date evidence: from notes to readings, from readings to people, and reviews.

Tables: `occurrence` (ord, source, page, name, rank_title, notes, confidence, agreement, association, row_index),
`evidence` (person_key, ord, date, original_text, page, confidence, verified, needs_review, review_reason, agreement,
association, snippet), `person` (person_key, original_name, rank_title, pages, notes_texts, aliases, n_occurrences,
identity_needs_review). `ord` orders what came first; no reading is ever dropped from `evidence`, duplicates go only
from histories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hijri, names

#: What a person's review writes.
REVIEWED, ADDED = "اعتماد صريح من المستخدم", "أضافه المستخدم"
SNIPPET = 240


def from_notes(occurrences: DataFrame, hint: Column | None = None) -> DataFrame:
    """One row a legal date of each occurrence's notes, scored. Occurrences need person_key, ord, notes, page, confidence,
    agreement and association; null numbers take the defaults of a plain reading (0.9, 1, 1.0)."""
    rows = occurrences.withColumns({
        "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.9)),
        "agreement": F.coalesce(F.col("agreement").cast("int"), F.lit(1)),
        "association": F.coalesce(F.col("association").cast("double"), F.lit(1.0)),
    })
    found = rows.select("*", F.posexplode(hijri.extract(F.col("notes"))).alias("nth", "d"))
    scored = hijri.evidence(F.col("d.date"), F.col("d.repaired"), F.col("confidence"), F.col("agreement"), F.col("association"), hint)
    return found.withColumn("s", scored).select(
        "person_key", "ord", "nth", F.col("d.date").alias("date"), F.col("d.raw").alias("original_text"), "page",
        F.col("s.confidence").alias("confidence"), F.col("s.verified").alias("verified"), F.col("s.needs_review").alias("needs_review"), F.col("s.review_reason").alias("review_reason"),
        "agreement", "association", F.substring("notes", 1, SNIPPET).alias("snippet"),
    )


def first_of(value: Column, order: Column, condition: Column | None = None) -> Column:
    """Aggregate: the first value by order, of those under the condition."""
    return F.min_by(value, F.when(F.lit(True) if condition is None else condition, order))


def in_order(value: Column, order: Column) -> Column:
    """Aggregate: distinct values, in the order of their first appearance."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
    return F.array_distinct(F.array_compact(listed))


def people(occurrences: DataFrame) -> DataFrame:
    """Persons by key from occurrences (with person_key): the first name, the first rank that isn't empty, pages and notes."""
    order, rank = F.col("ord"), F.col("rank_title")
    return occurrences.where(F.col("person_key") != "").groupBy("person_key").agg(
        first_of(F.col("name"), order).alias("original_name"),
        F.coalesce(first_of(rank, order, F.coalesce(rank, F.lit("")) != ""), F.lit("")).alias("rank_title"),
        in_order(F.col("page"), order).alias("pages"),
        F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.struct(order, "notes")))), lambda x: x["notes"]).alias("notes_texts"),
        F.count(F.lit(1)).alias("n_occurrences"),
        F.min(order).alias("ord"),
    )


def merge_people(*sources: DataFrame) -> DataFrame:
    """Union of person tables by key, in the order given: the first name, the first rank that isn't empty, notes, pages and
    aliases once each, in order; a review flag of any source."""
    every = None
    for k, source in enumerate(sources):
        part = source.withColumn("_source", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    for name, kind in (("aliases", "array<string>"), ("identity_needs_review", "boolean")):
        if name not in every.columns:
            every = every.withColumn(name, F.lit(None).cast(kind))
    order = F.struct("_source", "ord")
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(F.col(c), F.array()).alias("v")))), lambda x: x["v"])))
    return every.groupBy("person_key").agg(
        first_of(F.col("original_name"), order).alias("original_name"),
        F.coalesce(first_of(F.col("rank_title"), order, F.coalesce(F.col("rank_title"), F.lit("")) != ""), F.lit("")).alias("rank_title"),
        flat("pages").alias("pages"), flat("notes_texts").alias("notes_texts"), flat("aliases").alias("aliases"),
        F.sum("n_occurrences").alias("n_occurrences"),
        F.coalesce(F.bool_or("identity_needs_review"), F.lit(False)).alias("identity_needs_review"),
        F.min("ord").alias("ord"),
    )


def rename(people_: DataFrame, evidence: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """A person under a new name, merged into whoever has that key. old: a key, else a name; nothing changes if neither is found
    or the new name is empty."""
    if not new.strip():
        return people_, evidence
    by_key, by_name = F.col("person_key") == old, (F.col("original_name") == old) | (F.col("person_key") == names.key(F.lit(old)))
    found = people_.agg(F.coalesce(F.min(F.when(by_key, F.col("person_key"))), F.min_by("person_key", F.when(by_name, F.col("ord")))).alias("old_key"))
    target = names.key(F.lit(new.strip()))
    rows = people_.join(F.broadcast(found))  # one row
    is_it = F.col("person_key").eqNullSafe(F.col("old_key"))
    # The renamed person is merged last, so an existing bearer of the name keeps name and rank.
    renamed = rows.where(is_it).withColumns({"person_key": target, "original_name": F.lit(new.strip())}).drop("old_key")
    merged = merge_people(rows.where(~is_it).drop("old_key"), renamed).select(*[c for c in people_.columns])
    keyed = evidence.join(F.broadcast(found)).withColumn("person_key", F.when(F.col("person_key").eqNullSafe(F.col("old_key")), target).otherwise(F.col("person_key"))).drop("old_key")
    return merged, keyed


def histories(evidence: DataFrame, only_verified: bool = True) -> DataFrame:
    """(person_key, dates): distinct dates, newest first."""
    rows = evidence.where("verified") if only_verified else evidence
    return rows.groupBy("person_key").agg(F.sort_array(F.collect_set("date"), asc=False).alias("dates"))


def year_hint(evidence: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent year of each group; of equals, the one that came first."""
    counted = evidence.groupBy(*by, hijri.year_of(F.col("date")).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return counted.groupBy(*by).agg(F.max_by("year", F.struct("n", (-F.col("first")).alias("first"))).alias("hint"))


def revalidated(evidence: DataFrame, hint: Column) -> DataFrame:
    """Readings 20 years or more off the hint lose their verification."""
    year = hijri.year_of(F.col("date"))
    off = F.abs(year - hint) >= 20
    said = F.concat(F.lit("سنة مشبوهة ("), year, F.lit(") — سياق المستند ~"), hint)
    return evidence.withColumns({
        "review_reason": F.when(off & (F.coalesce(F.col("review_reason"), F.lit("")) == ""), said).otherwise(F.col("review_reason")),
        "confidence": F.when(off, F.least("confidence", F.lit(0.7))).otherwise(F.col("confidence")),
        "verified": F.col("verified") & ~off,
        "needs_review": F.col("needs_review") | off,
    })


def bulk_verified(evidence: DataFrame, unverify: bool = False) -> DataFrame:
    """Verifies what is safe; unverify: and takes the verification from what needs a review."""
    safe = hijri.safe(F.col("confidence"), F.col("needs_review"), F.col("agreement"), F.col("association"))
    kept = F.col("verified") & ~F.col("needs_review") if unverify else F.col("verified")
    return evidence.withColumn("verified", kept | safe)


def material_pending(evidence: DataFrame) -> DataFrame:
    """Unverified readings whose date the person has no verified reading of: they could change the ranking."""
    verified = evidence.where("verified").select("person_key", "date").distinct()
    return evidence.where(~F.col("verified")).join(verified, ["person_key", "date"], "left_anti")


def reviewed(evidence: DataFrame, people_: DataFrame, reviews: DataFrame) -> DataFrame:
    """Evidence after reviews (seq, name, action, date, page), applied in the order of seq: verify_all, verify_date, delete_date,
    add_date. A review finds its person by key, else the first one with its soft key; dates are given with - or /.

    The last effect wins without replaying: a reading is deleted if a delete of its date came after it was there, and
    verified if any verifying review came after it was there, so one pass over the matching reviews decides."""
    keyed = reviews.withColumn("_key", names.key(F.col("name")))
    exact = keyed.join(people_.select(F.col("person_key").alias("_key"), F.col("person_key").alias("_exact")), "_key", "left")
    softly = people_.groupBy(names.soft(F.col("original_name")).alias("_soft")).agg(F.min_by("person_key", "ord").alias("_softly"))
    found = exact.withColumn("_soft", names.soft_of_key(F.col("_key"))).join(softly, "_soft", "left")
    found = found.withColumn("person_key", F.coalesce("_exact", "_softly")).where(F.col("person_key").isNotNull())
    legal = F.col("date").rlike(r"^\d{4}([-/])\d{2}\1\d{2}$")
    found = found.withColumn("given", F.when(legal, F.regexp_replace("date", "[-/]", "").cast("int")))

    added = found.where((F.col("action") == "add_date") & hijri.parse(F.col("date")).isNotNull()).select(
        "person_key", F.lit(None).cast(evidence.schema["ord"].dataType).alias("ord"), F.lit(0).alias("nth"), hijri.parse(F.col("date")).alias("date"), F.col("date").alias("original_text"),
        F.coalesce(F.col("page").cast("long"), F.lit(0)).alias("page"), F.lit(1.0).alias("confidence"), F.lit(True).alias("verified"), F.lit(False).alias("needs_review"),
        F.lit("").alias("review_reason"), F.lit(1).alias("agreement"), F.lit(1.0).alias("association"), F.lit(ADDED).alias("snippet"), F.col("seq").alias("_since"),
    )
    present = evidence.withColumn("_since", F.lit(-1)).select(*[F.col(c) for c in added.columns]).unionByName(added)
    by_person = found.groupBy("person_key").agg(
        F.max(F.when(F.col("action") == "verify_all", F.col("seq"))).alias("_all"),
        F.collect_list(F.when(F.col("action") == "verify_date", F.struct("given", "seq"))).alias("_each"),
        F.collect_list(F.when(F.col("action") == "delete_date", F.struct("given", "seq"))).alias("_gone"),
    )  # reviews are typed by people, so a person's are few
    since = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<struct<given:int,seq:bigint>>")), lambda r: (r["given"] == F.col("date")) & (r["seq"] > F.col("_since")))
    rows = present.join(by_person, "person_key", "left")
    all_ = F.coalesce(F.col("_all") > F.col("_since"), F.lit(False))
    one = since("_each")
    return (
        rows.where(~F.coalesce(since("_gone"), F.lit(False)))
        .withColumns({"verified": F.col("verified") | all_ | one, "needs_review": F.col("needs_review") & ~all_ & ~one, "review_reason": F.when(all_, REVIEWED).otherwise(F.col("review_reason"))})
        .select(*evidence.columns)
    )


def page_offsets(sources: DataFrame) -> DataFrame:
    """(source, offset) from (source, last_page): each file's pages follow those of the files before. The running maximum of
    offset plus pages, over files (few)."""
    before = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    return sources.withColumn("offset", F.coalesce(F.sum(F.coalesce("last_page", F.lit(0))).over(before), F.lit(0)))


def payload(people_: DataFrame, evidence: DataFrame, most_people: int = 300, most_dates: int = 12) -> DataFrame:
    """The people with most readings, and their newest dates: a top-k report."""
    counted = evidence.groupBy("person_key").agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.slice(F.sort_array(F.collect_set("date"), asc=False), 1, most_dates).alias("dates"),
        F.count_if(F.col("needs_review")).alias("needs_review_dates"),
    )
    joined = people_.join(counted, "person_key", "left").fillna(0, ["n_readings", "needs_review_dates"])
    return joined.orderBy(F.desc("n_readings"), "original_name").limit(most_people)
