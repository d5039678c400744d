"""Whole runs: sources to a master list, targets to identities, evidence to a ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import hijri, names
from ..operators import evidence as ev
from ..operators import identity, ranking, tokens
from ..sources import listings, workbooks

#: Explanations of rows without a rank, and the warning on thin evidence.
BLOCKED_TEXT = "أُوقف ترتيب هذا الشخص لأن %d تاريخًا فريدًا غير معتمد قد يغيّر مفتاح الترتيب. يجب مراجعة التواريخ أولًا."
SKIPPED_TEXT = "لم يُدرَج في الترتيب بسبب حالة الاسم أو غياب التواريخ."
PENDING_TEXT = " ⚠ يوجد %d تاريخًا بحاجة مراجعة."


@dataclass
class RunContext:
    """What a run tells people beside its tables."""

    phase: str = "init"
    messages: list[str] = field(default_factory=list)

    def tell(self, phase: str, message: str) -> None:
        self.phase = phase
        self.messages.append(message)


@dataclass(frozen=True)
class Master:
    people: DataFrame
    evidence: DataFrame


def kept(master: Master) -> Master:
    """A master as tables: every later step reads them several times."""
    return Master(written(master.people, "master"), written(master.evidence, "evidence"))


def master_from_rows(rows: DataFrame) -> Master:
    """From workbook rows (see workbooks.master_rows)."""
    rows = written(rows, "rows")
    seen = workbooks.occurrences(rows)
    noted = written(ev.from_notes(seen.where(F.col("notes").isNotNull())), "noted")
    listed = workbooks.listed_dates(rows.where(F.col("dates").isNotNull()), noted)
    # Pages come from notes, and from rows whose dates column could be parsed and that name a page.
    paged = rows.where(F.col("dates").isNotNull() & (F.col("page") != 0) & F.exists(F.split("dates", "[|,;]+"), lambda p: hijri.parse(p).isNotNull()))
    pages = seen.where(F.col("notes").isNotNull()).select("person_key", "ord", "page").unionByName(paged.select(names.key(F.col("name")).alias("person_key"), "ord", "page"))
    listed_pages = pages.groupBy("person_key").agg(ev.in_order(F.col("page"), F.col("ord")).alias("pages"))
    people = ev.people(seen).drop("pages").join(listed_pages, "person_key", "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<bigint>")))
    return kept(Master(identity.flag_near_duplicates(written(people, "people")), noted.unionByName(listed)))


def master_from_pages(page_rows: DataFrame, source: str = "") -> Master:
    """From roster rows (see tokens.page_rows)."""
    seen = page_rows.select(
        names.key(F.col("original_name")).alias("person_key"), F.struct(F.lit(source).alias("path"), (F.col("page") * 1_000_000 + F.col("row_index")).cast("int").alias("row")).alias("ord"), F.lit(source).alias("source"), F.col("original_name").alias("name"),
        F.col("rank").alias("rank_title"), "notes", "page", "confidence", "agreement", "association", "row_index",
    ).where(F.col("person_key") != "")
    return kept(Master(identity.flag_near_duplicates(written(ev.people(seen), "people")), ev.from_notes(seen)))


def master_from_readings(readings: DataFrame, rules: DataFrame | None = None, boundaries: DataFrame | None = None) -> Master:
    """From the readings of scanned pages, with their vertical rules (page, x) and horizontal ones (page, y) where they were found."""
    voted = written(tokens.voted(readings), "voted")
    if rules is None or boundaries is None:
        return master_from_pages(tokens.page_rows(tokens.clustered_columns(voted)))
    grid = tokens.columns(rules)
    gridless = voted.join(grid.select("page"), "page", "left_anti")
    placed = tokens.in_bands(voted.join(grid.select("page"), "page", "left_semi"), boundaries, grid)
    return master_from_pages(tokens.page_rows(placed.unionByName(tokens.clustered_columns(gridless))))


def merged(*masters: Master) -> Master:
    """Several masters as one, in the order given; near duplicates are flagged anew."""
    evidence = masters[0].evidence
    for m in masters[1:]:
        evidence = evidence.unionByName(m.evidence)
    return kept(Master(identity.flag_near_duplicates(written(ev.merge_people(*[m.people for m in masters]), "people")), evidence))


def shifted(masters: list[Master]) -> list[Master]:
    """Masters of scanned files with pages numbered on through all files. The offset comes from the pages that named people."""
    out, offset = [], F.lit(0)
    for m in masters:
        last = m.people.agg(F.coalesce(F.max(F.array_max("pages")), F.lit(0)).alias("last"))  # one row
        out.append((m, last))
    done: list[Master] = []
    before = None
    for m, last in out:
        if before is None:
            done.append(m)
            before = last.withColumnRenamed("last", "offset")
            continue
        people = m.people.join(F.broadcast(before)).withColumn("pages", F.transform("pages", lambda p: p + F.col("offset"))).drop("offset")
        done.append(Master(people, m.evidence.join(F.broadcast(before)).withColumn("page", F.coalesce("page", F.lit(0)) + F.col("offset")).drop("offset")))
        after = people.agg(F.coalesce(F.max(F.array_max("pages")), F.lit(0)).alias("last"))
        before = before.join(F.broadcast(after)).select(F.greatest("offset", "last").alias("offset"))
    return done


def load_master(spark: SparkSession, paths: list[str], context: RunContext, scanned: list[Master] | None = None) -> Master | None:
    """A master from workbooks, after what was scanned from pages. Other files are named in the messages and left out."""
    pdfs, books, other = listings.by_kind(paths)
    for path in other:
        context.messages.append(f"تم تجاهل صيغة غير مدعومة: {path.rsplit('/', 1)[-1]}")
    found = shifted(scanned or []) + [master_from_rows(workbooks.master_rows(workbooks.read_cells(spark, book))) for book in books]
    if not found:
        context.tell("error", "لم يُرفع أي ملف رئيسي.")
        return None
    context.tell("master_loaded", f"تم دمج {len(paths)} ملف.")
    return found[0] if len(found) == 1 else merged(*found)


def blocked(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(person_key, n_pending, pending_pages) of the people whose unverified readings could change their place."""
    pending = ev.material_pending(evidence.join(rows.select("person_key").distinct(), "person_key", "left_semi"))
    return pending.groupBy("person_key").agg(F.count(F.lit(1)).alias("n_pending"), F.array_sort(F.collect_set("page")).alias("pending_pages"))


def run(targets: DataFrame, master: Master, auto_verify: bool = False, softly: bool = True, detail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, summary): verified targets ranked, all others appended without a rank.

    The gates, in order: the target's status; its person; one row a person (the first target); pending readings. A
    verified target whose soft key several people share becomes ambiguous."""
    found = identity.resolved(targets.withColumn("shown", identity.display_name()), master.people, softly)
    ambiguous = (F.col("status") == identity.VERIFIED) & F.col("person_key").isNull() & (F.col("soft_hits") > 1)
    found = written(found.withColumn("status", F.when(ambiguous, identity.AMBIGUOUS).otherwise(F.col("status"))), "found")
    usable = found.where((F.col("status") == identity.VERIFIED) & F.col("person_key").isNotNull())
    first = Window.partitionBy("person_key").orderBy("ord")
    chosen = usable.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("id", "person_key")
    chosen = written(chosen, "chosen")
    own = master.evidence.join(chosen.select("person_key"), "person_key", "left_semi")
    own = written(ev.bulk_verified(own, unverify=True) if auto_verify else own, "own")
    stopped = written(blocked(chosen, own), "stopped")
    free = chosen.join(stopped.select("person_key"), "person_key", "left_anti")
    pending = own.groupBy("person_key").agg(F.count_if(~F.col("verified")).alias("pending_date_review_count"))
    people = written(
        free.join(master.people.select("person_key", "original_name"), "person_key")
        .join(ev.histories(own), "person_key", "left")
        .join(pending, "person_key", "left")
        .select("id", "original_name", F.col("person_key").alias("normalized_name"), "dates", F.coalesce("pending_date_review_count", F.lit(0)).alias("pending_date_review_count")),
        "rankable",
    )
    ranked = ranking.explained(ranking.rank_people(people), detail)
    thin = (F.col("date_count") > 0) & (F.col("pending_date_review_count") > 0)
    ranked = written(ranked.withColumn("explanation", F.concat("explanation", F.when(thin, F.format_string(PENDING_TEXT, "pending_date_review_count")).otherwise(""))), "ranked")
    left = found.join(free.select("id"), "id", "left_anti").join(chosen.join(stopped, "person_key").select("id", "n_pending", "pending_pages"), "id", "left")
    after = Window.orderBy("ord")
    total = people.agg(F.count(F.lit(1)).alias("total"))
    unranked = left.withColumn("nth", F.row_number().over(after)).join(F.broadcast(total)).select(
        "id", F.col("shown").alias("original_name"), "normalized_name", (F.col("total") + F.col("nth") - 1).alias("position"),
        F.when(F.col("n_pending").isNotNull(), ranking.NEEDS_REVIEW).otherwise(F.col("status")).alias("status"),
        F.when(F.col("n_pending").isNotNull(), F.format_string(BLOCKED_TEXT, "n_pending")).otherwise(SKIPPED_TEXT).alias("explanation"), F.lit(0).alias("date_count"), "pending_pages",
    )
    results = ranked.unionByName(unranked, allowMissingColumns=True)

    review = F.col("status").isin(identity.NEEDS_REVIEW, identity.AMBIGUOUS)
    lost = F.col("status").isin(identity.NOT_IN_MASTER, identity.UNKNOWN) | ((F.col("status") == identity.VERIFIED) & F.col("person_key").isNull())
    gates = found.agg(F.count_if(review).alias("skipped"), F.count_if(lost).alias("not_found"))
    stops = chosen.join(stopped, "person_key").agg(F.count(F.lit(1)).alias("blocked_by_pending_dates"))
    sums = people.agg(F.count(F.lit(1)).alias("ranked_candidates"), F.coalesce(F.sum("pending_date_review_count"), F.lit(0)).alias("pending_date_review_total"))
    one = ranking.summary(ranked).crossJoin(gates).crossJoin(stops).crossJoin(sums).crossJoin(identity.summary(found))  # single rows
    return results, one.withColumn("skipped_needs_review", F.col("skipped") + F.col("blocked_by_pending_dates")).drop("skipped")


def run_list(targets: DataFrame, master: Master) -> tuple[DataFrame, DataFrame]:
    """The command line's run: every proposal is accepted, and all readings of the people found are verified."""
    adopt = targets.where((F.coalesce("matched_master_name", F.lit("")) != "") | (F.col("status") == identity.VERIFIED))
    commands = adopt.select(F.lit(0).cast("long").alias("seq"), "id", F.lit("set_name").alias("action"), F.coalesce("matched_master_name", "original_name").alias("name"))
    settled = written(identity.corrected(targets, commands, master.people), "settled")
    people = settled.where(F.col("status") == identity.VERIFIED).select(names.key(identity.display_name()).alias("person_key")).distinct().withColumn("_trusted", F.lit(True))
    trusted = F.coalesce("_trusted", F.lit(False))
    evidence = master.evidence.join(people, "person_key", "left").withColumns({
        "verified": F.col("verified") | trusted, "needs_review": F.col("needs_review") & ~trusted, "review_reason": F.when(trusted, ev.REVIEWED).otherwise(F.col("review_reason")),
    }).drop("_trusted")
    return run(settled, Master(master.people, evidence))


def compare_people(master: Master, a: str, b: str) -> DataFrame:
    """One row: two people of the master compared on all their dates, verified or not; none if either is unknown."""
    dates = ev.histories(master.evidence, only_verified=False)
    known = master.people.join(dates, "person_key", "left").select("person_key", "original_name", ranking.history(F.col("dates")).alias("seq"))
    side = lambda name, s: known.where(F.col("person_key") == names.key(F.lit(name))).select(F.col("original_name").alias(f"{s}_name"), F.col("seq").alias(f"{s}_seq"))
    both = side(a, "a").crossJoin(side(b, "b"))  # a row each
    return both.withColumn("c", ranking.compare(F.col("a_seq"), F.col("b_seq"))).select("a_name", "b_name", "c.result", "c.level", hijri.display(F.col("c.date_a")).alias("date_a"), hijri.display(F.col("c.date_b")).alias("date_b"), F.transform("a_seq", hijri.display).alias("a_dates"), F.transform("b_seq", hijri.display).alias("b_dates"))


def audit_person(results: DataFrame, person_id: str) -> DataFrame:
    return results.where(F.col("id") == person_id)
