"""The engine's registered queries on the driver's tables, and the same in SQL.

People are customers and their evidence is their orders; an order's date becomes a Hijri one by shifting the year and
holding the day to 30. At the grain of months and years histories share prefixes, so ties and unresolved
places occur. Part names, letter by letter in Arabic, are the names to match. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import sorted_side
from .functions import hijri, names
from .operators import evidence as ev
from .operators import identity, ranking, tokens, verifier
from .plans import ranking_run
from .sinks import exports
from .sources import workbooks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LATIN = "abcdefghijklmnopqrstuvwxyz"
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنو"
SEGMENT = "BUILDING"


def register(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hijri_of(date: Column, grain: str = "day") -> Column:
    month = F.lit(1) if grain == "year" else F.month(date)
    day = F.least(F.dayofmonth(date), F.lit(30)) if grain == "day" else F.lit(1)
    return (F.year(date) - 554) * 10000 + month * 100 + day


def sql_date(grain: str = "day") -> str:
    month = "1" if grain == "year" else "month(o_orderdate)"
    day = "least(day(o_orderdate), 30)" if grain == "day" else "1"
    return f"CAST((year(o_orderdate) - 554) * 10000 + {month} * 100 + {day} AS INT)"


def people(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    """Customers with orders and their dates."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", hijri_of(F.col("o_orderdate"), grain).alias("date"))
    return orders.groupBy("o_custkey").agg(F.collect_set("date").alias("dates")).select(F.col("o_custkey").alias("id"), F.format_string("Customer#%09d", "o_custkey").alias("original_name"), F.format_string("Customer#%09d", "o_custkey").alias("normalized_name"), "dates")


def sql_people(grain: str) -> str:
    return f"""p AS (SELECT o_custkey AS id, printf('Customer#%09d', o_custkey) AS name, list_sort(list_distinct(list({sql_date(grain)})), 'DESC') AS seq FROM orders GROUP BY o_custkey),
c AS (SELECT seq, count(*) AS size FROM p GROUP BY seq),
pre AS (SELECT a.seq, b.seq AS other, b.size FROM c a JOIN c b ON len(b.seq) < len(a.seq) AND a.seq[1:len(b.seq)] = b.seq)"""


#: The definition, class by class: who precedes, who can't be compared, and the component's smallest place.
SQL_BOUNDS = """
before AS (SELECT a.seq, sum(b.size) AS n FROM c a JOIN c b ON b.seq < a.seq AND NOT (len(b.seq) < len(a.seq) AND a.seq[1:len(b.seq)] = b.seq) GROUP BY a.seq),
after AS (SELECT a.seq, sum(b.size) AS n FROM c a JOIN c b ON b.seq > a.seq AND NOT (len(a.seq) < len(b.seq) AND b.seq[1:len(a.seq)] = a.seq) GROUP BY a.seq),
peers AS (SELECT seq, sum(size) AS n FROM (SELECT seq, size FROM pre UNION ALL SELECT other, (SELECT size FROM c WHERE c.seq = pre.seq) FROM pre) GROUP BY seq),
b AS (SELECT c.seq, c.size, 1 + coalesce(before.n, 0) AS rank_min, (SELECT sum(size) FROM c) - coalesce(after.n, 0) - c.size + 1 AS rank_max, coalesce(peers.n, 0) AS peers
  FROM c LEFT JOIN before USING (seq) LEFT JOIN after USING (seq) LEFT JOIN peers USING (seq)),
root AS (SELECT seq, arg_min(other, len(other)) AS root FROM pre GROUP BY seq),
r AS (SELECT b.*, CASE WHEN b.peers = 0 THEN b.rank_min ELSE coalesce(rb.rank_min, b.rank_min) END AS rank,
  CASE WHEN b.peers > 0 THEN 'تعادل غير محسوم بالبيانات المتاحة' WHEN b.size > 1 THEN 'تعادل' ELSE 'مرتّب' END AS status
  FROM b LEFT JOIN root USING (seq) LEFT JOIN b rb ON rb.seq = root.root)"""


def _bounds(grain: str) -> None:
    sql = f"""WITH {sql_people(grain)}, {SQL_BOUNDS}
SELECT p.id, CAST(r.rank AS BIGINT) AS rank, CAST(r.rank_min AS BIGINT) AS rank_min, CAST(r.rank_max AS BIGINT) AS rank_max, r.rank_min = r.rank_max AS rank_exact, r.status,
  CAST(CASE WHEN r.peers > 0 THEN 1 + r.peers ELSE r.size END AS BIGINT) AS group_size FROM p JOIN r USING (seq)"""

    @register(f"rank_bounds_{grain}", sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = ranking.rank_people(people(spark, sf_dir, grain))
        return ranked.select("id", "rank", "rank_min", "rank_max", "rank_exact", "status", F.col("group_size").cast("long").alias("group_size"))


for _grain in ("day", "month", "year"):
    _bounds(_grain)


@register("rank_status_counts", f"""WITH {sql_people('month')}, {SQL_BOUNDS}
SELECT count(*) AS total, count(*) FILTER (status = 'مرتّب') AS ranked_successfully, count(*) FILTER (status = 'تعادل') AS tied,
  count(*) FILTER (status LIKE '%غير محسوم%') AS unresolved, CAST(0 AS BIGINT) AS no_dates FROM p JOIN r USING (seq)""")
def rank_status_counts(spark, sf_dir):
    return ranking.summary(ranking.rank_people(people(spark, sf_dir, "month")))


@register("rank_position_order", f"WITH {sql_people('year')} SELECT id, row_number() OVER (ORDER BY seq, name, id) - 1 AS position FROM p")
def rank_position_order(spark, sf_dir):
    return ranking.rank_people(people(spark, sf_dir, "year")).select("id", "position")


@register("tie_classes", f"WITH {sql_people('year')} SELECT array_to_string(seq, ',') AS history, size FROM c WHERE size > 1")
def tie_classes(spark, sf_dir):
    found = ranking.classes(people(spark, sf_dir, "year").withColumn("seq", ranking.history(F.col("dates"))))
    return found.where("size > 1").select(F.array_join(F.col("seq").cast("array<string>"), ",").alias("history"), "size")


@register("unresolved_pairs", f"WITH {sql_people('month')} SELECT array_to_string(pre.seq, ',') AS longer, array_to_string(other, ',') AS shorter, c.size AS n_longer, pre.size AS n_shorter FROM pre JOIN c USING (seq)")
def unresolved_pairs(spark, sf_dir):
    found = ranking.prefix_pairs(ranking.classes(people(spark, sf_dir, "month").withColumn("seq", ranking.history(F.col("dates")))))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select(joined("seq").alias("longer"), joined("prefix").alias("shorter"), F.col("size").alias("n_longer"), F.col("prefix_size").alias("n_shorter"))


@register("unresolved_with", f"""WITH {sql_people('month')}, peers AS (SELECT seq, other FROM pre UNION ALL SELECT other, seq FROM pre)
SELECT a.id, string_agg(b.name, ',' ORDER BY b.name) AS unresolved_with FROM p a JOIN peers ON peers.seq = a.seq JOIN p b ON b.seq = peers.other GROUP BY a.id""")
def unresolved_with(spark, sf_dir):
    rows = people(spark, sf_dir, "month").withColumn("seq", ranking.history(F.col("dates")))
    return rows.join(ranking.unresolved_names(rows), "seq").select("id", F.array_join("unresolved_with", ",").alias("unresolved_with"))


@register("strict_precedence", """WITH h AS (SELECT n_nationkey AS id, list_sort(list_distinct(list(CAST((year(o_orderdate) - 554) * 10000 + month(o_orderdate) * 100 + 1 AS INT))), 'DESC') AS seq
  FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY n_nationkey)
SELECT a.id, b.id AS other_id FROM h a JOIN h b ON a.seq < b.seq AND NOT (len(a.seq) < len(b.seq) AND b.seq[1:len(a.seq)] = a.seq)""")
def strict_precedence(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    rows = orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = rows.groupBy(F.col("n_nationkey").alias("id")).agg(F.collect_set(hijri_of(F.col("o_orderdate"), "month")).alias("dates"))
    return ranking.precedence(found.select("id", ranking.history(F.col("dates")).alias("seq")))


@register("compare_pairs", f"""WITH {sql_people('month')}, q AS (SELECT a.id, a.seq AS x, b.seq AS y, list_filter(range(1, greatest(len(a.seq), len(b.seq)) + 1), lambda i: a.seq[i] IS DISTINCT FROM b.seq[i]) AS d FROM p a JOIN p b ON b.id = a.id + 1)
SELECT id, CASE WHEN len(d) = 0 THEN 'tie' WHEN x[d[1]] IS NULL OR y[d[1]] IS NULL THEN 'unresolved' WHEN x[d[1]] < y[d[1]] THEN 'a' ELSE 'b' END AS result,
  CAST(CASE WHEN len(d) = 0 THEN len(x) ELSE d[1] - 1 END AS INT) AS level FROM q""")
def compare_pairs(spark, sf_dir):
    a = people(spark, sf_dir, "month").select("id", ranking.history(F.col("dates")).alias("x"))
    b = a.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return a.join(b, "id").withColumn("c", ranking.compare(F.col("x"), F.col("y"))).select("id", "c.result", "c.level")


@register("vs_previous", f"""WITH {sql_people('month')}, {SQL_BOUNDS},
o AS (SELECT p.id, p.name, p.seq, r.rank, r.status, lag(p.name) OVER w AS previous, lag(p.seq) OVER w AS pseq, lag(r.rank) OVER w AS prank, lag(r.status) OVER w AS pstatus FROM p JOIN r USING (seq) WINDOW w AS (ORDER BY p.seq, p.name, p.id)),
d AS (SELECT *, list_filter(range(1, len(seq) + 1), lambda i: seq[i] IS DISTINCT FROM pseq[i])[1] AS k FROM o WHERE previous IS NOT NULL AND status NOT LIKE '%غير محسوم%' AND pstatus NOT LIKE '%غير محسوم%' AND rank <> prank)
SELECT id, previous, CAST(k - 1 AS INT) AS level, printf('%04d/%02d/%02d', pseq[k] // 10000, pseq[k] // 100 % 100, pseq[k] % 100) AS prev_date, printf('%04d/%02d/%02d', seq[k] // 10000, seq[k] // 100 % 100, seq[k] % 100) AS this_date FROM d""")
def vs_previous(spark, sf_dir):
    rows = ranking.versus_previous(ranking.rank_people(people(spark, sf_dir, "month")))
    return rows.where(F.col("vs_previous").isNotNull()).select("id", "vs_previous.*")


@register("no_dates_tail", """WITH t AS (SELECT count(DISTINCT o_custkey) AS total FROM orders WHERE o_orderpriority = '1-URGENT'),
u AS (SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))
SELECT id, total + 1 AS rank, total + row_number() OVER (ORDER BY c_name, id) - 1 AS position, count(*) OVER () AS group_size FROM u, t""")
def no_dates_tail(spark, sf_dir):
    dates = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.collect_set(hijri_of(F.col("o_orderdate"))).alias("dates"))
    customers = read(spark, sf_dir, "customer")
    rows = customers.join(dates, customers["c_custkey"] == dates["o_custkey"], "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("original_name"), F.col("c_name").alias("normalized_name"), "dates")
    return ranking.rank_people(rows).where(F.col("status") == ranking.NO_DATES).select("id", "rank", "position", "group_size")


@register("latest_previous_dates", f"""WITH {sql_people('day')} SELECT id, printf('%04d/%02d/%02d', seq[1] // 10000, seq[1] // 100 % 100, seq[1] % 100) AS latest_date,
  CASE WHEN len(seq) > 1 THEN printf('%04d/%02d/%02d', seq[2] // 10000, seq[2] // 100 % 100, seq[2] % 100) END AS previous_date, CAST(len(seq) AS INT) AS date_count FROM p""")
def latest_previous_dates(spark, sf_dir):
    return ranking.rank_people(people(spark, sf_dir, "day")).select("id", "latest_date", "previous_date", "date_count")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as readings: status and priority say how well they were read."""
    confidence = F.lit(1.0) - F.substring("o_orderpriority", 1, 1).cast("int") * 0.03
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("person_key"), F.col("o_orderkey").alias("ord"), F.lit(0).alias("nth"), hijri_of(F.col("o_orderdate")).alias("date"), F.lit("").alias("original_text"), (F.col("o_orderkey") % 7).alias("page"), confidence.alias("confidence"),
        (F.col("o_orderstatus") != "P").alias("verified"), (F.col("o_orderkey") % 11 == 0).alias("needs_review"), F.lit("").alias("review_reason"), (1 + F.col("o_orderkey") % 3).cast("int").alias("agreement"), (F.lit(1.0) - (F.col("o_orderkey") % 5) * 0.02).alias("association"), F.lit("").alias("snippet"),
    )


SQL_EVIDENCE = f"""e AS (SELECT o_custkey AS person_key, o_orderkey AS ord, {sql_date()} AS date, o_orderkey % 7 AS page, CAST(1.0 AS DOUBLE) - CAST(o_orderpriority[1] AS INT) * CAST(0.03 AS DOUBLE) AS confidence, o_orderstatus <> 'P' AS verified,
  o_orderkey % 11 = 0 AS needs_review, 1 + o_orderkey % 3 AS agreement, CAST(1.0 AS DOUBLE) - (o_orderkey % 5) * CAST(0.02 AS DOUBLE) AS association FROM orders)"""
SQL_SAFE = "(NOT needs_review AND confidence >= 0.93 AND agreement >= 2 AND association >= 0.95)"


@register("people_payload_topk", f"""WITH {SQL_EVIDENCE}, n AS (SELECT person_key, count(*) AS n_readings, list_sort(list_distinct(list(date)), 'DESC')[1:12] AS dates, count(*) FILTER (needs_review) AS needs_review_dates FROM e GROUP BY 1)
SELECT c_name AS original_name, n_readings, array_to_string(dates, ',') AS dates, needs_review_dates FROM customer JOIN n ON person_key = c_custkey ORDER BY n_readings DESC, c_name LIMIT 300""")
def people_payload_topk(spark, sf_dir):
    known = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_key"), F.col("c_name").alias("original_name"))
    return ev.payload(known, evidence(spark, sf_dir)).select("original_name", "n_readings", F.array_join(F.col("dates").cast("array<string>"), ",").alias("dates"), "needs_review_dates")


@register("year_mode_hint", f"""WITH {SQL_EVIDENCE}, y AS (SELECT person_key, date // 10000 AS year, count(*) AS n, min(ord) AS first FROM e GROUP BY ALL)
SELECT person_key, CAST(arg_max(year, n * 100000000 - first) AS INT) AS hint FROM y GROUP BY person_key""")
def year_mode_hint(spark, sf_dir):
    return ev.year_hint(evidence(spark, sf_dir), ["person_key"])


@register("revalidated_dates", f"WITH {SQL_EVIDENCE} SELECT ord, CASE WHEN abs(date // 10000 - 1464) >= 20 THEN least(confidence, 0.7) ELSE confidence END AS confidence, verified AND abs(date // 10000 - 1464) < 20 AS verified, needs_review OR abs(date // 10000 - 1464) >= 20 AS needs_review FROM e")
def revalidated_dates(spark, sf_dir):
    return ev.revalidated(evidence(spark, sf_dir), F.lit(1464)).select("ord", "confidence", "verified", "needs_review")


def written_date(date: Column, kind: Column) -> Column:
    """A date as people write it, in one of five ways."""
    y, m, d = F.floor(date / 10000).cast("int"), (F.floor(date / 100) % 100).cast("int"), (date % 100).cast("int")
    return (
        F.when(kind == 0, hijri.display(date)).when(kind == 1, hijri.display_ar(date)).when(kind == 2, F.format_string("%d-%d-%dهـ", y, m, d))
        .when(kind == 3, F.format_string("%02d/%02d/%04d", d, m, y)).otherwise(F.format_string("1%04d / %d / %d", y, m, d))
    )


@register("hijri_parse", f"WITH {SQL_EVIDENCE} SELECT ord, CASE WHEN ord % 5 < 3 OR (ord % 5 = 3 AND date % 100 > 12) THEN date END AS parsed FROM e")
def hijri_parse(spark, sf_dir):
    return evidence(spark, sf_dir).select("ord", hijri.parse(written_date(F.col("date"), F.col("ord") % 5)).alias("parsed"))


@register("hijri_extract_notes", f"""WITH {SQL_EVIDENCE} SELECT person_key, date, bool_and(ord % 5 = 4) AS always_repaired FROM e WHERE ord % 5 <> 3 OR date % 100 > 12 GROUP BY ALL""")
def hijri_extract_notes(spark, sf_dir):
    """Each customer's dates written one after another, and found again."""
    notes = evidence(spark, sf_dir).groupBy("person_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("ord") % 5 == 4).alias("repaired"), "ord", written_date(F.col("date"), F.col("ord") % 5).alias("t")))), lambda x: x["t"]), " ثم ").alias("notes"))
    # A date found in several ways is given once: plainly, if it was plain anywhere.
    found = notes.select("person_key", F.explode(hijri.extract(F.col("notes"))).alias("d")).select("person_key", "d.date", "d.repaired")
    plain = evidence(spark, sf_dir).where("ord % 5 != 4 AND (ord % 5 != 3 OR date % 100 > 12)").select("person_key", "date").distinct().withColumn("plain", F.lit(True))
    return found.join(plain, ["person_key", "date"], "left").select("person_key", "date", F.col("plain").isNull().alias("always_repaired"))


@register("date_scoring", f"""WITH {SQL_EVIDENCE}, a AS (SELECT *, ord % 5 = 4 AS repaired, least(confidence, association) AS c0 FROM e), b AS (SELECT *, CASE WHEN repaired THEN least(c0, 0.82) ELSE c0 END AS c1 FROM a),
c AS (SELECT *, CASE WHEN association < 0.85 THEN least(c1, 0.82) ELSE c1 END AS c2 FROM b), d AS (SELECT *, CASE WHEN agreement <= 1 AND confidence < 0.95 THEN least(c2, 0.88) ELSE c2 END AS c3 FROM c)
SELECT ord, c3 AS confidence, repaired OR association < 0.85 OR c3 < 0.85 AS needs_review, NOT (repaired OR association < 0.85 OR c3 < 0.85) AND c3 >= 0.93 AS verified FROM d""")
def date_scoring(spark, sf_dir):
    rows = evidence(spark, sf_dir).withColumn("s", hijri.evidence(F.col("date"), F.col("ord") % 5 == 4, F.col("confidence"), F.col("agreement"), F.col("association")))
    return rows.select("ord", "s.confidence", "s.needs_review", "s.verified")


@register("bulk_verify_safe", f"WITH {SQL_EVIDENCE} SELECT ord, verified OR {SQL_SAFE} AS verified FROM e")
def bulk_verify_safe(spark, sf_dir):
    return ev.bulk_verified(evidence(spark, sf_dir)).select("ord", "verified")


@register("auto_verify", f"WITH {SQL_EVIDENCE} SELECT ord, (verified AND NOT needs_review) OR {SQL_SAFE} AS verified FROM e")
def auto_verify(spark, sf_dir):
    return ev.bulk_verified(evidence(spark, sf_dir), unverify=True).select("ord", "verified")


@register("material_pending_block", f"WITH {SQL_EVIDENCE} SELECT person_key, count(*) AS n_pending, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM e WHERE NOT verified AND (person_key, date) NOT IN (SELECT (person_key, date) FROM e WHERE verified) GROUP BY person_key")
def material_pending_block(spark, sf_dir):
    found = ranking_run.blocked(evidence(spark, sf_dir), evidence(spark, sf_dir))
    return found.select("person_key", "n_pending", F.array_join(F.col("pending_pages").cast("array<string>"), ",").alias("pages"))


@register("unique_dates", f"WITH {SQL_EVIDENCE} SELECT person_key, array_to_string(list_sort(list_distinct(list(date)), 'DESC'), ',') AS dates FROM e WHERE verified GROUP BY person_key")
def unique_dates(spark, sf_dir):
    return ev.histories(evidence(spark, sf_dir)).select("person_key", F.array_join(F.col("dates").cast("array<string>"), ",").alias("dates"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of two rosters: those of urgent orders, and the rest."""
    o = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("person_key"), o.alias("ord"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("second"), F.concat(F.lit("n"), o % 4).alias("name"),
        F.when(o % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), o % 5)).alias("rank_title"), (o % 7).alias("page"), F.when(o % 2 == 0, F.concat(F.lit("t"), o % 9)).alias("notes"),
    )


@register("occurrence_people", """WITH o AS (SELECT *, 'n' || o_orderkey % 4 AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'r' || o_orderkey % 5 END AS rank_title FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS person_key, arg_min(name, o_orderkey) AS original_name, coalesce(arg_min(rank_title, o_orderkey) FILTER (rank_title <> ''), '') AS rank_title, count(*) AS n_occurrences,
  coalesce(string_agg('t' || o_orderkey % 9, ',' ORDER BY o_orderkey) FILTER (o_orderkey % 2 = 0), '') AS notes FROM o GROUP BY 1""")
def occurrence_people(spark, sf_dir):
    return ev.people(occurrences(spark, sf_dir)).select("person_key", "original_name", "rank_title", "n_occurrences", F.array_join("notes_texts", ",").alias("notes"))


@register("merge_sources", """WITH o AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderpriority IN ('1-URGENT', '2-HIGH') AS second, 'n' || o_orderkey % 4 AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'r' || o_orderkey % 5 END AS rank_title, o_orderkey % 7 AS page FROM orders),
f AS (SELECT k, page, min((second, ord)) AS place FROM o GROUP BY ALL), g AS (SELECT k, string_agg(page, ',' ORDER BY place) AS pages FROM f GROUP BY k)
SELECT CAST(k AS VARCHAR) AS person_key, arg_min(name, (second, ord)) AS original_name, coalesce(arg_min(rank_title, (second, ord)) FILTER (rank_title <> ''), '') AS rank_title, any_value(pages) AS pages, count(*) AS n_occurrences FROM o JOIN g USING (k) GROUP BY k""")
def merge_sources(spark, sf_dir):
    rows = occurrences(spark, sf_dir)
    merged = ev.merge_people(ev.people(rows.where("NOT second")), ev.people(rows.where("second")))
    return merged.select("person_key", "original_name", "rank_title", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "n_occurrences")


@register("page_offsets", "WITH s AS (SELECT c_nationkey AS source, CAST(max(c_custkey % 40) AS BIGINT) AS last_page FROM customer GROUP BY 1) SELECT source, CAST(coalesce(sum(last_page) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM s")
def page_offsets(spark, sf_dir):
    files = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("source")).agg(F.max(F.col("c_custkey") % 40).alias("last_page"))
    return ev.page_offsets(files).select("source", "offset")


def arabic(name: Column) -> Column:
    return F.translate(name, LATIN, ARABIC)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as persons."""
    parts = read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    name = arabic(F.col("p_name"))
    return parts.select(names.key(name).alias("person_key"), name.alias("original_name"), F.array("ord").alias("pages"), "ord", F.col("p_name").alias("latin"))


#: How a supplier writes a part's name: as it is, with a letter left out, or with one changed.
SQL_MISSPELT = "CASE s_suppkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'l', '') WHEN 2 THEN replace(replace(p_name, 'e', 'o'), 'r', 'b') ELSE 'x' || p_name || 'xx' END"


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: each supplier asks for a part's name, well or badly spelt."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = read(spark, sf_dir, "supplier").join(parts, F.col("p_partkey") == F.col("s_suppkey"))
    return rows.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), arabic(F.expr(SQL_MISSPELT)).alias("name"), F.expr(SQL_MISSPELT).alias("latin"))


SQL_MASTER = "m AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY p_name)"
SQL_LISTED = f"t AS (SELECT s_suppkey AS id, {SQL_MISSPELT} AS name FROM supplier JOIN part ON p_partkey = s_suppkey)"


def _sql_token(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b}))) END"


#: Every name here has two words.
SQL_PAIRS = f"""w AS (SELECT DISTINCT t.name AS q, m.name AS p, {_sql_token("string_split(t.name, ' ')[1]", "string_split(m.name, ' ')[1]")} AS f, {_sql_token("string_split(t.name, ' ')[2]", "string_split(m.name, ' ')[2]")} AS g FROM t, m),
s AS (SELECT q, p, CASE WHEN q = p THEN 1.0 ELSE least(0.99, (0.5 * f + 0.5 * g) * CASE WHEN f < 0.6 OR g < 0.6 THEN 0.72 ELSE 1.0 END) END AS score FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, translate(p, '{LATIN}', '{ARABIC}')) AS place FROM s WHERE score >= 0.52)"""
SQL_MATCH = f"""{SQL_MASTER}, {SQL_LISTED}, {SQL_PAIRS},
b AS (SELECT q, max(CASE WHEN place = 1 THEN score END) AS s1, max(CASE WHEN place = 2 THEN score END) AS s2, max(CASE WHEN place = 1 THEN p END) AS p1 FROM k GROUP BY q),
x AS (SELECT t.id, t.name, s1, s2, p1, CASE WHEN s1 = 1.0 THEN 'مؤكد' WHEN s1 IS NULL THEN 'غير موجود في الملف الرئيسي' WHEN s1 >= 0.68 AND s1 - s2 < 0.10 THEN 'الاسم غير محسوم ويحتاج مراجعة' WHEN s1 >= 0.62 THEN 'يحتاج مراجعة' ELSE 'غير موجود في الملف الرئيسي' END AS status FROM t LEFT JOIN b ON b.q = t.name)"""


@register("exact_match", f"WITH {SQL_MASTER}, {SQL_LISTED} SELECT id, m.name IS NOT NULL AS found FROM t LEFT JOIN m USING (name)")
def exact_match(spark, sf_dir):
    keyed = listed(spark, sf_dir).withColumn("person_key", names.key(F.col("name")))
    known = master(spark, sf_dir).select("person_key", F.lit(True).alias("known"))
    return keyed.join(known, "person_key", "left").select("id", F.coalesce("known", F.lit(False)).alias("found"))


@register("fuzzy_match_top7", f"WITH {SQL_MASTER}, {SQL_LISTED}, {SQL_PAIRS} SELECT q AS query, p AS candidate, place FROM k WHERE place <= 7 AND NOT EXISTS (SELECT 1 FROM m WHERE m.name = q)")
def fuzzy_match_top7(spark, sf_dir):
    known = master(spark, sf_dir)
    found = identity.matches(listed(spark, sf_dir).select(names.key(F.col("name")).alias("query_key")), known).where(F.col("status") != identity.VERIFIED)
    top = found.select("query_key", F.posexplode("candidates").alias("place", "c"))
    latin = lambda c: F.translate(c, ARABIC, LATIN)
    return top.select(latin(F.col("query_key")).alias("query"), latin(F.col("c.name")).alias("candidate"), (F.col("place") + 1).cast("long").alias("place"))


@register("ambiguity_gap", f"WITH {SQL_MATCH} SELECT id, status, CASE WHEN status IN ('مؤكد', 'يحتاج مراجعة') THEN p1 END AS matched FROM x")
def ambiguity_gap(spark, sf_dir):
    rows = listed(spark, sf_dir).withColumn("query_key", names.key(F.col("name")))
    found = rows.join(identity.matches(rows, master(spark, sf_dir)), "query_key")
    return found.select("id", "status", F.translate("matched", ARABIC, LATIN).alias("matched"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.targets(listed(spark, sf_dir), master(spark, sf_dir))


SQL_TARGETS = f"{SQL_MATCH}, y AS (SELECT x.* FROM x JOIN (SELECT name, min(id) AS id FROM t GROUP BY name) USING (id, name))"


@register("target_summary", f"WITH {SQL_TARGETS} SELECT count(*) AS target_total, count(*) FILTER (status = 'مؤكد') AS target_verified, count(*) FILTER (status IN ('يحتاج مراجعة', 'الاسم غير محسوم ويحتاج مراجعة')) AS target_needs_review, count(*) FILTER (status = 'غير موجود في الملف الرئيسي') AS target_not_in_master FROM y")
def target_summary(spark, sf_dir):
    return identity.summary(targets(spark, sf_dir))


@register("append_targets_anti", f"WITH {SQL_TARGETS} SELECT id, status FROM y WHERE id % 2 = 0 UNION ALL SELECT id, status FROM y WHERE id % 2 = 1 AND name NOT IN (SELECT name FROM y WHERE id % 2 = 0)")
def append_targets_anti(spark, sf_dir):
    every = targets(spark, sf_dir)
    return identity.appended(every.where("id % 2 = 0"), every.where("id % 2 = 1").unionByName(every.where("id % 2 = 0"))).select("id", "status")


@register("auto_confirm", f"WITH {SQL_TARGETS} SELECT id, 'confirm' AS action FROM y WHERE status = 'مؤكد' UNION ALL SELECT id, 'set_name' FROM y WHERE status = 'يحتاج مراجعة' AND s1 >= 0.75 AND (s2 IS NULL OR round(s1, 4) - round(s2, 4) >= 0.10)")
def auto_confirm(spark, sf_dir):
    return identity.auto_commands(targets(spark, sf_dir), least=0.75).select("id", "action")


@register("apply_corrections", f"""WITH {SQL_TARGETS}, z AS (SELECT *, status IN ('مؤكد', 'يحتاج مراجعة') AS has_match FROM y)
SELECT id, CASE WHEN id % 3 = 0 AND has_match THEN 'مؤكد' WHEN id % 3 = 1 THEN 'غير معروف' ELSE status END AS status FROM z""")
def apply_corrections(spark, sf_dir):
    rows = targets(spark, sf_dir)
    action = F.when(F.col("id") % 3 == 0, "confirm").when(F.col("id") % 3 == 1, "reject").otherwise("none")
    commands = rows.select(F.lit(0).cast("long").alias("seq"), "id", action.alias("action"), F.lit(None).cast("string").alias("name"))
    return identity.corrected(rows, commands, master(spark, sf_dir)).select("id", "status")


@register("near_duplicates", f"WITH {SQL_MASTER}, t AS (SELECT name FROM m), {SQL_PAIRS} SELECT x.name AS a, y.name AS b FROM k JOIN m x ON x.name = k.q JOIN m y ON y.name = k.p WHERE score >= 0.88 AND x.ord < y.ord")
def near_duplicates(spark, sf_dir):
    latin = lambda c: F.translate(F.col(c), ARABIC, LATIN)
    return identity.near_duplicates(master(spark, sf_dir)).select(latin("a").alias("a"), latin("b").alias("b"))


@register("soft_collision_guard", f"WITH {SQL_MASTER}, g AS (SELECT replace(name, 'small', 'large') AS soft, count(*) AS hits FROM m GROUP BY 1) SELECT m.name, CASE WHEN hits = 1 THEN 'one' ELSE 'several' END AS found FROM m JOIN g ON soft = replace(m.name, 'small', 'large')")
def soft_collision_guard(spark, sf_dir):
    """Names whose two spellings differ in letters that the soft key unifies."""
    written_ = lambda c: F.translate(F.replace(F.replace(c, F.lit("small"), F.lit("ىىى")), F.lit("large"), F.lit("ييي")), LATIN, ARABIC)
    known = master(spark, sf_dir).select(names.key(written_(F.col("latin"))).alias("person_key"), written_(F.col("latin")).alias("original_name"), "latin", "ord")
    asked = known.select("latin", F.lit(None).cast("string").alias("user_corrected_name"), F.lit(None).cast("string").alias("matched_master_name"), F.translate("original_name", "يى", "ئئ").alias("original_name"))
    found = identity.resolved(asked, known)
    return found.select(F.col("latin").alias("name"), F.when(F.col("person_key").isNotNull(), "one").otherwise("several").alias("found"))


@register("apply_date_reviews", f"""WITH {SQL_EVIDENCE}, v AS (SELECT e.*, person_key % 4 AS kind, (SELECT max(date) FROM e l WHERE l.person_key = e.person_key) AS last FROM e)
SELECT person_key, date, verified OR kind = 0 OR (kind = 1 AND date = last) AS verified, needs_review AND kind <> 0 AND NOT (kind = 1 AND date = last) AS needs_review FROM v WHERE NOT (kind = 2 AND date = last)
UNION ALL SELECT person_key, 14000101, true, false FROM v WHERE kind = 3 GROUP BY person_key""")
def apply_date_reviews(spark, sf_dir):
    """A review a customer, by number: all, the newest date, without the newest date, or one date more."""
    own = evidence(spark, sf_dir).withColumn("person_key", arabic(F.translate(F.col("person_key").cast("string"), "0123456789", LATIN[:10])))
    known = own.groupBy("person_key").agg(F.min("ord").alias("ord"), F.max("date").alias("last")).withColumn("original_name", F.col("person_key"))
    number = lambda c: F.translate(F.translate(c, ARABIC, LATIN), LATIN[:10], "0123456789").cast("long")
    kind = number(F.col("person_key")) % 4
    action = F.element_at(F.array(*[F.lit(x) for x in ("verify_all", "verify_date", "delete_date", "add_date")]), (kind + 1).cast("int"))
    reviews = known.select(F.lit(1).cast("long").alias("seq"), F.col("person_key").alias("name"), action.alias("action"), F.when(kind == 3, "1400/01/01").otherwise(hijri.iso(F.col("last"))).alias("date"), F.lit(0).alias("page"))
    return ev.reviewed(own, known, reviews).select(number(F.col("person_key")).alias("person_key"), "date", "verified", "needs_review")


SQL_RUN = f"""WITH {SQL_EVIDENCE}, a AS (SELECT person_key, date, (verified AND NOT needs_review) OR {SQL_SAFE} AS verified FROM e), blocked AS (SELECT DISTINCT person_key FROM a WHERE NOT verified AND (person_key, date) NOT IN (SELECT (person_key, date) FROM a WHERE verified)),
t AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = '{SEGMENT}'),
f AS (SELECT id FROM t WHERE id NOT IN (SELECT person_key FROM blocked)),
d AS (SELECT f.id, list_sort(list_distinct(list(date) FILTER (verified)), 'DESC') AS seq FROM f LEFT JOIN a ON person_key = id GROUP BY f.id),
p AS (SELECT * FROM d WHERE len(seq) > 0), c AS (SELECT seq, count(*) AS size FROM p GROUP BY seq), pre AS (SELECT a.seq, b.seq AS other, b.size FROM c a JOIN c b ON len(b.seq) < len(a.seq) AND a.seq[1:len(b.seq)] = b.seq), {SQL_BOUNDS}
"""


@register("run_ranking_full", SQL_RUN + """SELECT id, CAST(rank AS BIGINT) AS rank, status, CAST(len(p.seq) AS INT) AS date_count FROM p JOIN r USING (seq)
UNION ALL SELECT id, (SELECT count(*) FROM p) + 1, 'بدون تواريخ صالحة', 0 FROM d WHERE seq IS NULL OR len(seq) = 0
UNION ALL SELECT id, NULL, 'يحتاج مراجعة', 0 FROM t WHERE id IN (SELECT person_key FROM blocked)""")
def run_ranking_full(spark, sf_dir):
    """The gates and the ranking for the customers of one segment, among all customers."""
    return segment_run(spark, sf_dir)[0].select("id", "rank", "status", "date_count")


def segment_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lettered = lambda c: arabic(F.translate(c.cast("string"), "0123456789", LATIN[:10]))
    own = evidence(spark, sf_dir).withColumn("person_key", lettered(F.col("person_key")))
    customers = read(spark, sf_dir, "customer")
    known = customers.select(lettered(F.col("c_custkey")).alias("person_key"), lettered(F.col("c_custkey")).alias("original_name"), F.col("c_custkey").alias("ord"))
    wanted = customers.where(F.col("c_mktsegment") == SEGMENT).select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), lettered(F.col("c_custkey")).alias("original_name"), lettered(F.col("c_custkey")).alias("normalized_name"), F.lit(1.0).alias("confidence"), F.lit(identity.VERIFIED).alias("status"),
        F.lit(None).cast(identity.CANDIDATE_TYPE).alias("candidates"), lettered(F.col("c_custkey")).alias("matched_master_name"), F.lit(None).cast("string").alias("user_corrected_name"),
    )
    return ranking_run.run(wanted, ranking_run.Master(known, own), auto_verify=True)


@register("export_text_rows", f"""WITH {sql_people('month')}, {SQL_BOUNDS}
SELECT id, CASE WHEN rank_min = rank_max THEN CAST(CAST(rank_min AS BIGINT) AS VARCHAR) ELSE CAST(rank_min AS BIGINT) || '–' || CAST(rank_max AS BIGINT) END || '. ' || name || ' — أحدث: ' || printf('%04d/%02d/%02d', seq[1] // 10000, seq[1] // 100 % 100, seq[1] % 100) || ' (' || len(seq) || ' تاريخ) — ' || status AS line FROM p JOIN r USING (seq)""")
def export_text_rows(spark, sf_dir):
    ranked = ranking.rank_people(people(spark, sf_dir, "month"))
    return exports.text_rows(ranked).join(sorted_side(ranked.select("position", "id")), "position").select("id", "line")


@register("master_index", f"WITH {sql_people('day')}, n AS (SELECT id, name, seq, row_number() OVER (ORDER BY name) AS m FROM p) SELECT m, name, '' AS rank_title, CAST(id % 9 AS VARCHAR) || '، ' || CAST(id % 9 + 1 AS VARCHAR) AS pages, array_to_string(list_transform(seq, lambda d: printf('%04d/%02d/%02d', d // 10000, d // 100 % 100, d % 100)), ' | ') AS dates FROM n")
def master_index(spark, sf_dir):
    rows = people(spark, sf_dir, "day").select("*", F.transform(ranking.history(F.col("dates")), hijri.display).alias("date_list"), F.array(F.col("id") % 9, F.col("id") % 9 + 1).alias("pages"), F.lit(None).cast("string").alias("rank_title"))
    return exports.master_index(ranking.numbered(rows, F.substring("original_name", 1, 14), ["original_name"], "position"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings of a page an order: their numbers are read twice or thrice, sometimes otherwise."""
    i = F.col("l_linenumber")
    base = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), i, F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"), "l_suppkey")
    text = F.concat(F.lit("w"), (F.col("l_suppkey") + F.when(F.col("k") == 2, i % 2).otherwise(0)).cast("string"))
    return base.select("page", text.alias("text"), (i * 0.1).alias("x"), (1 - i * 0.08).alias("y"), F.lit(0.05).alias("w"), F.lit(0.02).alias("h"), (F.lit(0.9) + F.col("k") * 0.02).alias("confidence"), F.concat(F.lit("pass"), "k").alias("source"))


@register("vote_fusion", """WITH r AS (SELECT l_orderkey AS page, l_linenumber AS i, k, 'w' || (l_suppkey + CASE WHEN k = 2 THEN l_linenumber % 2 ELSE 0 END) AS text, 0.9::DOUBLE + k * 0.02::DOUBLE AS confidence FROM lineitem, (SELECT unnest([0, 1, 2]) AS k)),
g AS (SELECT page, i, text, count(DISTINCT k) AS n, sum(confidence) AS total, avg(confidence) AS mean, max(confidence) AS best, min(k) AS ord FROM r GROUP BY ALL),
a AS (SELECT *, count(*) OVER (PARTITION BY page, i) AS n_keys, row_number() OVER (PARTITION BY page, i ORDER BY n DESC, round(total, 9) DESC, length(text) DESC, ord, text) AS place FROM g),
s AS (SELECT *, least(1::DOUBLE, best * 0.55::DOUBLE + mean * 0.25::DOUBLE + n / 3 * 0.20::DOUBLE) AS score FROM a WHERE place = 1)
SELECT page, text, CAST(n AS INT) AS agreement, round(CASE WHEN n = 1 THEN score * 0.82 ELSE score END, 6) AS confidence, CAST(least(n_keys - 1, 6) AS INT) AS n_alternatives FROM s""")
def vote_fusion(spark, sf_dir):
    return tokens.voted(readings(spark, sf_dir)).select("page", "text", "agreement", F.round("confidence", 6).alias("confidence"), F.size("alternatives").alias("n_alternatives"))


@register("row_cluster", "SELECT l_orderkey AS page, count(DISTINCT l_linenumber) AS n_rows FROM lineitem GROUP BY 1")
def row_cluster(spark, sf_dir):
    return tokens.clustered_rows(readings(spark, sf_dir)).groupBy("page").agg(F.count_distinct("row").alias("n_rows"))


@register("page_lines", "SELECT l_orderkey AS page, count(DISTINCT l_linenumber) AS n_lines FROM lineitem GROUP BY 1")
def page_lines(spark, sf_dir):
    return tokens.lines(readings(spark, sf_dir)).groupBy("page").agg(F.count(F.lit(1)).alias("n_lines"))


SQL_RULES = "v AS (SELECT s_suppkey AS page, unnest([0.04 + s_suppkey % 5 / 100.0, 0.60, 0.70 + s_suppkey % 3 / 100.0, 0.77, 0.857, 0.93 + s_suppkey % 4 / 100.0, 0.985]) AS x FROM supplier), d AS (SELECT DISTINCT page, CAST(x AS DOUBLE) AS x FROM v)"


@register("column_selection", f"""WITH {SQL_RULES}, l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x) AS i, min(x) OVER (PARTITION BY page) AS f, max(x) OVER (PARTITION BY page) AS z FROM d),
k AS (SELECT r.page, n.x AS notes_right, nl.x AS name_left, nr.x AS name_right, abs(r.x - nr.x - 0.055::DOUBLE) + 0.70::DOUBLE * abs(nr.x - nl.x - 0.17::DOUBLE) + 0.80::DOUBLE * abs(nl.x - n.x - 0.065::DOUBLE) + 0.20::DOUBLE * abs(r.x - r.z) AS score
  FROM l r JOIN l nr ON nr.page = r.page AND nr.i < r.i AND nr.i >= 3 AND r.x - nr.x BETWEEN 0.025::DOUBLE AND 0.115::DOUBLE JOIN l nl ON nl.page = r.page AND nl.i < nr.i AND nl.i >= 2 AND nr.x - nl.x BETWEEN 0.10::DOUBLE AND 0.32::DOUBLE
  JOIN l n ON n.page = r.page AND n.i < nl.i AND nl.x - n.x BETWEEN 0.025::DOUBLE AND 0.14::DOUBLE AND n.x - r.f >= 0.30::DOUBLE WHERE r.x >= 0.90::DOUBLE AND r.i >= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score, notes_right, name_left, name_right) AS place FROM k)
SELECT page, notes_right, name_left, name_right FROM b WHERE place = 1""")
def column_selection(spark, sf_dir):
    s = F.col("s_suppkey")
    rules = read(spark, sf_dir, "supplier").select(s.alias("page"), F.explode(F.array((s % 5) / 100.0 + 0.04, F.lit(0.60), (s % 3) / 100.0 + 0.70, F.lit(0.77), F.lit(0.857), (s % 4) / 100.0 + 0.93, F.lit(0.985))).alias("x")).distinct()
    return tokens.columns(rules).select("page", "notes_right", "name_left", "name_right")


@register("reading_validation", """WITH a AS (SELECT o_orderkey AS id, o_custkey, o_orderkey % 6 AS k FROM orders)
SELECT CAST(id AS VARCHAR) AS row_id, CASE WHEN k = 1 THEN '' ELSE 'c' || o_custkey END AS selected_candidate, CAST(CASE WHEN k = 2 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence, k <> 1 AS legible FROM a WHERE k < 3""")
def reading_validation(spark, sf_dir):
    """An answer an order: valid, illegible, overconfident, of another candidate, of a wrong type, or of nobody's row."""
    k, o = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    rows = read(spark, sf_dir, "orders")
    own = F.concat(F.lit("c"), "o_custkey")
    asked = rows.select(o.alias("row_id"), F.array(own).alias("candidates"))
    selected = F.when(k == 1, "").when(k == 3, "other").otherwise(own)
    confidence = F.when(k == 2, "7.5").when(k == 4, '"0.5"').otherwise("0.5")
    answer = F.concat(F.lit('{"rows": [{"row_id": "'), F.when(k == 5, F.concat(F.lit("x"), o)).otherwise(o), F.lit('", "transcription": " t ", "selected_candidate": "'), selected, F.lit('", "dates": ["1447/01/02", " "], "confidence": '), confidence, F.lit(', "legible": '), (k != 1).cast("string"), F.lit("}]}"))
    found = verifier.readings(rows.select(F.col("o_orderkey").alias("batch"), answer.alias("payload")), asked)
    return found.select("row_id", "selected_candidate", "confidence", "legible")


def _word(n: int) -> str:
    return f"split_part(p_name, ' ', {n})"


#: Names of two to four words; every fourth one differs from another in its middle word only.
SQL_BRAND = "concat('b', translate(substr(p_brand, 7, 1), '0123456789', 'abcdefghij'), 'ran')"
SQL_FULL = f"CASE p_partkey % 4 WHEN 0 THEN concat_ws(' ', {_word(1)}, lower(p_type), {_word(2)}) WHEN 1 THEN concat_ws(' ', {_word(1)}, replace(lower(p_type), 'o', 'x'), {_word(2)}) WHEN 2 THEN concat_ws(' ', {_word(1)}, lower(p_type), {SQL_BRAND}, {_word(2)}) ELSE p_name END"
#: How they are asked for: as they are, without the middle, with a word more, with a letter less, or with two words more.
SQL_ASKED = f"CASE s_suppkey % 5 WHEN 0 THEN {SQL_FULL} WHEN 1 THEN p_name WHEN 2 THEN concat_ws(' ', {_word(1)}, lower(p_type), 'bin', {_word(2)}) WHEN 3 THEN concat_ws(' ', {_word(1)}, lower(p_type), substr({_word(2)}, 2)) ELSE concat_ws(' ', {_word(1)}, replace(lower(p_type), 'e', 'o'), {SQL_BRAND}, 'bin', {_word(2)}) END"


def full_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.expr(SQL_FULL).alias("latin"), "p_partkey").groupBy("latin").agg(F.min("p_partkey").alias("ord"))
    name = arabic(F.col("latin"))
    return parts.select(names.key(name).alias("person_key"), name.alias("original_name"), F.array("ord").alias("pages"), "ord")


def _sql_similarity(a: str, b: str) -> str:
    """Of two lists of words: word by word if they are equally many, else by the ordered alignment."""
    alike = lambda x, y: f"(CAST(1 AS DOUBLE) - CAST(levenshtein({x}, {y}) AS DOUBLE) / greatest(length({x}), length({y})))"
    first, family = alike(f"{a}[1]", f"{b}[1]"), alike(f"{a}[-1]", f"{b}[-1]")
    inner = f"list_transform(range(2, len({a})), lambda i: {alike(f'{a}[i]', f'{b}[i]')})"
    same = f"CASE WHEN len({a}) = 2 THEN {first} * 0.5::DOUBLE + {family} * 0.5::DOUBLE ELSE least({first} * 0.32::DOUBLE + {family} * 0.32::DOUBLE + list_sum({inner}) / (len({a}) - 2) * 0.36::DOUBLE, CASE WHEN {first} = 1 AND {family} = 1 AND list_min({inner}) < 0.75 THEN 0.88::DOUBLE ELSE 9.0::DOUBLE END) END"
    few, many = f"(CASE WHEN len({a}) < len({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN len({a}) < len({b}) THEN {b} ELSE {a} END)"
    best = f"list_sort(list_transform(range(s.at + 1, len({many}) + 1), lambda i: {{'s': {alike('x.w', f'{many}[i]')}, 'i': i}}), 'DESC')[1]"
    step = f"list_transform([{best}], lambda g: {{'at': coalesce(g.i, s.at), 'total': s.total + coalesce(g.s, 0::DOUBLE), 'w': x.w}})[1]"
    total = f"list_reduce(list_prepend({{'at': 0::BIGINT, 'total': 0::DOUBLE, 'w': ''}}, list_transform({few}, lambda w: {{'at': 0::BIGINT, 'total': 0::DOUBLE, 'w': w}})), lambda s, x: {step}).total"
    other = f"({first} * 0.28::DOUBLE + {family} * 0.28::DOUBLE + {total} / len({many}) * 0.44::DOUBLE) * greatest(0.55::DOUBLE, 1.0::DOUBLE - abs(len({a}) - len({b})) * 0.13::DOUBLE)"
    return f"CASE WHEN {a} = {b} THEN 1::DOUBLE ELSE least(0.99::DOUBLE, (CASE WHEN len({a}) = len({b}) THEN {same} ELSE {other} END) * CASE WHEN {first} < 0.6 OR {family} < 0.6 THEN 0.72::DOUBLE ELSE 1::DOUBLE END) END"


SQL_FULL_MASTER = f"m AS (SELECT {SQL_FULL} AS name, min(p_partkey) AS ord FROM part GROUP BY 1), v AS (SELECT name, ord, string_split(name, ' ') AS w FROM m)"


@register("near_duplicates_full_names", f"WITH {SQL_FULL_MASTER}, pairs AS (SELECT a.name AS a, b.name AS b, {_sql_similarity('a.w', 'b.w')} AS score FROM v a JOIN v b ON a.ord < b.ord) SELECT a, b, round(score, 6) AS score FROM pairs WHERE score >= 0.88")
def near_duplicates_full_names(spark, sf_dir):
    latin = lambda c: F.translate(F.col(c), ARABIC, LATIN).alias(c)
    return identity.near_duplicates(full_master(spark, sf_dir)).select(latin("a"), latin("b"), F.round("score", 6).alias("score"))


@register("fuzzy_full_names", f"WITH {SQL_FULL_MASTER}, t AS (SELECT DISTINCT {SQL_ASKED} AS name FROM supplier JOIN part ON p_partkey = s_suppkey), q AS (SELECT name, string_split(name, ' ') AS w FROM t WHERE name NOT IN (SELECT name FROM m)), pairs AS (SELECT a.name AS query, b.name AS candidate, {_sql_similarity('a.w', 'b.w')} AS score FROM q a, v b) SELECT query, candidate, round(score, 6) AS score FROM pairs WHERE score >= 0.52")
def fuzzy_full_names(spark, sf_dir):
    """Every pair of an asked and a known name that can be a candidate: names of two to five words."""
    known = full_master(spark, sf_dir)
    parts = read(spark, sf_dir, "part")
    asked = read(spark, sf_dir, "supplier").join(parts, F.col("p_partkey") == F.col("s_suppkey")).select(names.key(arabic(F.expr(SQL_ASKED))).alias("query_key")).distinct()
    rest = asked.join(known.select(F.col("person_key").alias("query_key")), "query_key", "left_anti")
    latin = lambda c: F.translate(F.col(c), ARABIC, LATIN)
    return identity.scored_pairs(rest, known).select(latin("query_key").alias("query"), latin("person_key").alias("candidate"), F.round("score", 6).alias("score"))


SQL_PART_MISSPELT = SQL_MISSPELT.replace("s_suppkey", "p_partkey")
#: A proposal for each part's misspelt name, and what a second reader said of it.
SQL_SECOND = f"""SELECT p_partkey AS id, p_name, {SQL_PART_MISSPELT} AS written, p_partkey % 7 AS k, CAST(0.70 + (p_partkey % 4) * 0.09 AS DOUBLE) AS c1, CAST(0.70 + (p_partkey % 4) * 0.09 - 0.04 - (p_partkey % 3) * 0.08 AS DOUBLE) AS c2, p_partkey % 10 <> 9 AS answered,
  CASE WHEN p_partkey % 11 = 3 THEN 'zzzz yyyy' ELSE p_name END AS transcription, CASE WHEN p_partkey % 13 = 5 THEN '' ELSE p_name END AS selected, CAST(0.9 + (p_partkey % 6) * 0.02 AS DOUBLE) AS sure, p_partkey % 9 <> 4 AS legible FROM part"""


def second_readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Targets of every part, and the answers for them."""
    read(spark, sf_dir, "part").createOrReplaceTempView("sijill_part")
    rows = spark.sql(SQL_SECOND.replace("FROM part", "FROM sijill_part"))
    own = arabic(F.col("p_name"))
    candidate = lambda name, c: F.struct(name.alias("name"), names.key(name).alias("normalized"), F.col(c).alias("confidence"), F.array().cast("array<bigint>").alias("pages"))
    status = F.when(F.col("k") == 0, identity.AMBIGUOUS).when(F.col("k") == 1, identity.VERIFIED).otherwise(identity.NEEDS_REVIEW)
    targets_ = rows.select(
        "id", F.col("id").alias("ord"), arabic(F.col("written")).alias("original_name"), names.key(arabic(F.col("written"))).alias("normalized_name"), F.col("c1").alias("confidence"), status.alias("status"),
        F.array(candidate(own, "c1"), candidate(F.lit("قققق كككك"), "c2")).cast(identity.CANDIDATE_TYPE).alias("candidates"), own.alias("matched_master_name"),
        F.when(F.col("id") % 2 == 0, 0.95).alias("visual_confidence"), F.when(F.col("id") % 2 == 0, 2).alias("ocr_agreement"),
    )
    answers = rows.where("answered").select(F.col("id").alias("row_id"), arabic(F.col("transcription")).alias("transcription"), arabic(F.col("selected")).alias("selected_candidate"), F.col("sure").alias("confidence"), "legible")
    return targets_, answers


@register("uncertain_targets", f"SELECT id AS row_id, 2 AS n_candidates FROM ({SQL_SECOND}) WHERE NOT (k = 1 AND id % 2 = 0) ORDER BY id LIMIT 60")
def uncertain_targets(spark, sf_dir):
    """The first sixty targets that are worth a second reading: a batch has no more."""
    return verifier.uncertain_targets(second_readings(spark, sf_dir)[0]).select("row_id", F.size("candidates").alias("n_candidates"))


@register("confirm_targets", f"""WITH r AS ({SQL_SECOND}), f AS (SELECT *, {_sql_token("string_split(written, ' ')[1]", "string_split(p_name, ' ')[1]")} AS f1, {_sql_token("string_split(written, ' ')[2]", "string_split(p_name, ' ')[2]")} AS f2 FROM r),
l AS (SELECT *, CASE WHEN selected = '' THEN 0 WHEN written = p_name THEN 1 ELSE least(0.99::DOUBLE, (0.5::DOUBLE * f1 + 0.5::DOUBLE * f2) * CASE WHEN f1 < 0.6 OR f2 < 0.6 THEN 0.72::DOUBLE ELSE 1::DOUBLE END) END AS local FROM f),
a AS (SELECT *, answered AND legible AND sure >= 0.95 AND selected <> '' AND k <> 0 AND c1 >= 0.78 AND c1 - c2 >= 0.10 AND local >= 0.80 AND transcription = selected AS agreed FROM l)
SELECT id, CASE WHEN NOT answered THEN NULL WHEN NOT legible THEN 'unreadable' WHEN agreed THEN 'confirmed' ELSE 'disagreement' END AS hybrid_decision, CASE WHEN agreed OR k = 1 THEN 'مؤكد' WHEN k = 0 THEN 'الاسم غير محسوم ويحتاج مراجعة' ELSE 'يحتاج مراجعة' END AS status,
  round(CASE WHEN agreed THEN least(0.995::DOUBLE, greatest(c1, local) * 0.38::DOUBLE + c1 * 0.32::DOUBLE + sure * 0.30::DOUBLE) ELSE c1 END, 4) AS confidence FROM a""")
def confirm_targets(spark, sf_dir):
    return verifier.confirm_targets(*second_readings(spark, sf_dir)).select("id", "hybrid_decision", "status", F.round("confidence", 4).alias("confidence"))


#: Roster rows, one an order, with their dates in the notes, and a second reader's answers.
SQL_ROWS = f"""r AS (SELECT o_orderkey AS id, {sql_date()} AS date, o_orderkey % 3 <> 0 AS dated, o_orderkey % 6 = 0 AS stub, 0.90::DOUBLE + (o_orderkey % 4) * 0.02::DOUBLE AS confidence, 0.88::DOUBLE + (o_orderkey % 3) * 0.05::DOUBLE AS name_confidence, CAST(1 + o_orderkey % 2 AS INT) AS agreement,
  CASE WHEN o_orderkey % 12 = 1 THEN 0.9::DOUBLE ELSE 1::DOUBLE END AS association, o_orderkey % 10 <> 9 AS answered, o_orderkey % 9 <> 4 AS legible, o_orderkey % 8 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 6 >= 3 AS named, o_orderkey % 5 <> 0 AS same_date FROM orders)"""


def roster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").withColumns({"date": hijri_of(F.col("o_orderdate")), "name": arabic(F.translate(F.col("o_custkey").cast("string"), "0123456789", LATIN[:10]))})
    notes = F.when(o % 3 != 0, hijri.display(F.col("date"))).when(o % 6 == 0, "1447 / ").otherwise("")
    page_rows = rows.select(
        o.alias("id"), F.floor(o / 50).alias("page"), (o % 50).cast("int").alias("row_index"), F.col("name").alias("original_name"), F.lit("").alias("rank"), notes.alias("notes"), (F.lit(0.9) + (o % 4) * 0.02).alias("confidence"),
        (F.lit(0.88) + (o % 3) * 0.05).alias("name_confidence"), (1 + o % 2).cast("int").alias("agreement"), F.when(o % 12 == 1, 0.9).otherwise(1.0).alias("association"),
    )
    answers = rows.where(o % 10 != 9).select(
        F.concat(F.lit("m"), F.floor(o / 50), F.lit("r"), o % 50).alias("row_id"), F.when(o % 7 == 0, arabic(F.lit("zzzz"))).otherwise(F.col("name")).alias("transcription"), F.when(o % 8 == 0, "").otherwise(F.col("name")).alias("selected_candidate"),
        F.array(F.when(o % 5 == 0, "1300/01/01").otherwise(hijri.display(F.col("date")))).alias("dates"), (F.lit(0.9) + (o % 6) * 0.02).alias("confidence"), (o % 9 != 4).alias("legible"),
    )
    return page_rows, answers


@register("uncertain_rows", f"WITH {SQL_ROWS} SELECT 'm' || id // 50 || 'r' || id % 50 AS row_id FROM r WHERE (dated AND (confidence < 0.93 OR agreement < 2 OR association < 0.95)) OR stub")
def uncertain_rows(spark, sf_dir):
    return verifier.uncertain_rows(roster(spark, sf_dir)[0]).select("row_id")


@register("confirm_rows", f"""WITH {SQL_ROWS}, a AS (SELECT *, answered AND legible AND named AS n, answered AND dated AND same_date AS d FROM r)
SELECT id, CASE WHEN NOT answered THEN NULL WHEN NOT legible THEN 'unreadable' WHEN n AND (d OR NOT dated) THEN 'confirmed' ELSE 'disagreement' END AS hybrid_decision, CASE WHEN n THEN greatest(name_confidence, 0.96) ELSE name_confidence END AS name_confidence,
  CASE WHEN n AND d THEN greatest(confidence, 0.96) ELSE confidence END AS confidence, CASE WHEN n AND d THEN greatest(agreement, 2) ELSE agreement END AS agreement FROM a""")
def confirm_rows(spark, sf_dir):
    return verifier.confirm_rows(*roster(spark, sf_dir)).select("id", "hybrid_decision", "name_confidence", "confidence", "agreement")


#: Ten rows a page, .06 apart, with a name and a date each; odd pages have more horizontal rules, every fifth has none.
SQL_PAGES = f"""t AS (SELECT p_partkey AS page, p_name, j, 0.055 + 0.06 * j + (p_partkey % 3) * 0.001 AS c FROM part, (SELECT unnest(range(10)) AS j)),
y AS (SELECT p_partkey AS page, unnest(CASE WHEN p_partkey % 2 = 1 THEN [0.1, 0.2, 0.29, 0.292, 0.45, 0.62] ELSE [0.1, 0.2, 0.29, 0.292, 0.62] END) AS y FROM part WHERE p_partkey % 5 <> 0),
z AS (SELECT page, y AS top, lead(y) OVER (PARTITION BY page ORDER BY y) AS bottom, row_number() OVER (PARTITION BY page ORDER BY y) AS band FROM y), b AS (SELECT * FROM z WHERE bottom - top BETWEEN 0.004 AND 0.22),
i AS (SELECT t.*, band, row_number() OVER (PARTITION BY t.page, band ORDER BY j) - 1 AS part, count(*) OVER (PARTITION BY t.page, band) AS n FROM t JOIN b ON b.page = t.page AND c >= top AND c < bottom),
p AS (SELECT page, p_name, j, band, part, CASE WHEN n = 1 THEN 0.98 ELSE 0.86 END AS association FROM i UNION ALL SELECT page, p_name, j, j, 0, 0.68 FROM t WHERE page % 5 = 0)"""


def pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens, horizontal rules and grid of a page a part."""
    p, j = F.col("p_partkey"), F.col("j")
    parts = read(spark, sf_dir, "part")
    c = F.lit(0.055) + j * 0.06 + (p % 3) * 0.001
    at = lambda x, text, confidence, agreement: F.struct(F.lit(x).alias("x"), text.alias("text"), confidence.alias("confidence"), agreement.cast("int").alias("agreement"))
    both = F.array(at(0.78, arabic(F.col("p_name")), F.lit(0.9) + (j % 5) * 0.01, F.lit(2)), at(0.10, F.format_string("%04d/%02d/%02d", F.lit(1440), j + 1, (p % 28 + 1).cast("int")), F.lit(0.95), 1 + j % 2))
    rows = parts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(p.alias("page"), c.alias("c"), F.explode(both).alias("t"))
    found = rows.select("page", "t.text", "t.x", (1 - F.col("c") - 0.01).alias("y"), F.lit(0.12).alias("w"), F.lit(0.02).alias("h"), "t.confidence", "t.agreement")
    listed = lambda *ys: F.array(*[F.lit(y) for y in ys])
    rules = parts.where(p % 5 != 0).select(p.alias("page"), F.explode(F.when(p % 2 == 1, listed(0.1, 0.2, 0.29, 0.292, 0.45, 0.62)).otherwise(listed(0.1, 0.2, 0.29, 0.292, 0.62))).alias("y"))
    grid = parts.select(p.alias("page"), F.lit(0.717).alias("notes_right"), F.lit(0.770).alias("name_left"), F.lit(0.926).alias("name_right"))
    return found, rules, grid


@register("row_bands", f"WITH {SQL_PAGES} SELECT page, band, round(top, 3) AS top, round(bottom, 3) AS bottom FROM b")
def row_bands(spark, sf_dir):
    return tokens.bands(pages(spark, sf_dir)[1]).select("page", F.col("band").cast("long").alias("band"), F.round("top", 3).alias("top"), F.round("bottom", 3).alias("bottom"))


@register("tokens_in_bands", f"WITH {SQL_PAGES} SELECT page, CAST(band AS BIGINT) AS band, CAST(part AS BIGINT) AS part, CAST(association AS DOUBLE) AS association, CAST(2 AS BIGINT) AS n_tokens FROM p")
def tokens_in_bands(spark, sf_dir):
    placed = tokens.in_bands(*pages(spark, sf_dir))
    return placed.groupBy("page", F.col("row.band").cast("long").alias("band"), F.col("row.part").cast("long").alias("part"), "association").agg(F.count(F.lit(1)).alias("n_tokens"))


@register("page_rows", f"""WITH {SQL_PAGES}, q AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY page ORDER BY band, part) - 1 AS INT) AS row_index, CAST(1 + j % 2 AS INT) AS agreement, least(association, 0.95)::DOUBLE AS score FROM p)
SELECT page, row_index, p_name AS name, printf('1440/%02d/%02d', j + 1, page % 28 + 1) AS notes, round(CASE WHEN agreement = 2 AND association >= 0.95 THEN least(0.99, score + 0.04) ELSE score END, 6) AS confidence, round(0.9 + (j % 5) * 0.01, 6)::DOUBLE AS name_confidence, agreement FROM q""")
def page_rows(spark, sf_dir):
    found = tokens.page_rows(tokens.in_bands(*pages(spark, sf_dir)))
    return found.select("page", "row_index", F.translate("original_name", ARABIC, LATIN).alias("name"), "notes", F.round("confidence", 6).alias("confidence"), F.round("name_confidence", 6).alias("name_confidence"), "agreement")


@register("target_readings", "SELECT p_partkey AS page, p_name AS name, round(0.85 + (p_partkey % 2) * 0.05, 6)::DOUBLE AS confidence, CAST(2 AS INT) AS agreement FROM part WHERE p_partkey % 3 <> 0")
def target_readings(spark, sf_dir):
    """A list page a part: its name's two words on two lines, read once on one of them; on every third page too far apart."""
    p = F.col("p_partkey")
    place = lambda line, word: F.struct(F.lit(line).alias("line"), F.element_at(F.split("p_name", " "), word).alias("text"), F.when(p % 3 == 0, F.lit(0.9 - 0.4 * (word - 1))).otherwise(F.lit(0.9 - 0.1 * word)).alias("x"))
    rows = read(spark, sf_dir, "part").select(p.alias("page"), F.explode(F.array(*[place(line, word) for line in (0, 1) for word in (1, 2)])).alias("t"))
    second = F.col("t.line") == F.col("page") % 2
    found = rows.select("page", arabic(F.col("t.text")).alias("text"), "t.x", (F.lit(0.5) - F.col("t.line") * 0.2).alias("y"), F.lit(0.08).alias("w"), F.lit(0.02).alias("h"), (F.lit(0.85) + F.col("t.line") * 0.05).alias("confidence"), F.when(second, 2).otherwise(1).alias("agreement"))
    return tokens.target_readings(found).select("page", F.translate("text", ARABIC, LATIN).alias("name"), F.round("confidence", 6).alias("confidence"), "agreement")


@register("axis_clusters", """WITH d AS (SELECT DISTINCT o_custkey AS page, o_orderkey * 7 % 1000 AS i FROM orders), g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY page ORDER BY i) <= 12 THEN 0 ELSE 1 END AS fresh FROM d), r AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY i) AS run FROM g)
SELECT page, round(avg(i) / 2000, 8) AS "at" FROM r GROUP BY page, run""")
def axis_clusters(spark, sf_dir):
    marked = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_orderkey") * 7 % 1000).alias("index")).distinct()
    return tokens.clustered_axis(marked, F.lit(2000)).select("page", F.round("at", 8).alias("at"))


@register("ruled_lines", """WITH x AS (SELECT s_suppkey AS page, px, py, CAST((px * (py + 1 + s_suppkey % 7)) % 10 < 2 + py AS INT) AS dark FROM supplier, (SELECT unnest(range(200)) AS px), (SELECT unnest(range(8)) AS py)),
w AS (SELECT *, sum(dark) OVER (PARTITION BY page, py ORDER BY px ROWS BETWEEN 79 PRECEDING AND CURRENT ROW) AS n FROM x) SELECT page, py AS "index" FROM w WHERE px >= 79 GROUP BY page, py HAVING max(n / 80) >= 0.60""")
def ruled_lines(spark, sf_dir):
    s = F.col("s_suppkey")
    grid = read(spark, sf_dir, "supplier").select(s, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("px")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("py"))
    dark = grid.select(s.alias("page"), "px", "py", ((F.col("px") * (F.col("py") + 1 + s % 7)) % 10 < 2 + F.col("py")).alias("dark"))
    return tokens.ruled(dark, "px", "py", F.lit(200))


@register("highlight_scores", """WITH k AS (SELECT s_suppkey AS page, n FROM supplier, (SELECT unnest(range(3)) AS n)),
x AS (SELECT page, n, px, py FROM k, (SELECT unnest(range(40)) AS px), (SELECT unnest(range(40)) AS py) WHERE px >= floor((0.21 + 0.2 * n - 0.006) * 40) AND px < floor((0.21 + 0.2 * n + 0.15 + 0.006) * 40) AND py >= 22 AND py < 27)
SELECT page, 't' || n AS text, round(avg(CASE WHEN (px * 3 + py * 5 + page) % 40 BETWEEN 24 AND 82 AND (px * 7 + page) % 140 >= 70 AND py * 11 % 210 >= 105 THEN 1 ELSE 0 END), 6) AS highlight FROM x GROUP BY page, n""")
def highlight_scores(spark, sf_dir):
    """Pages of 40 by 40 pixels with three tokens."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"))
    marks = s.select("page", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).select("page", F.concat(F.lit("t"), "n").alias("text"), (F.lit(0.21) + F.col("n") * 0.2).alias("x"), F.lit(0.33).alias("y"), F.lit(0.15).alias("w"), F.lit(0.1).alias("h"))
    side = F.sequence(F.lit(0), F.lit(39))
    dots = s.select("page", F.explode(side).alias("px")).select("*", F.explode(side).alias("py"))
    pixels = dots.select("page", "px", "py", ((F.col("px") * 3 + F.col("py") * 5 + F.col("page")) % 40).alias("hue"), ((F.col("px") * 7 + F.col("page")) % 140).alias("saturation"), (F.col("py") * 11 % 210).alias("value"))
    sizes = s.select("page", F.lit(40).alias("width"), F.lit(40).alias("height"))
    return tokens.highlight_scores(marks, pixels, sizes).select("page", "text", F.round("highlight", 6).alias("highlight"))


@register("highlight_selection", """WITH k AS (SELECT l_orderkey AS page, l_linenumber AS n, l_suppkey % 9 = 0 AS lit FROM lineitem), a AS (SELECT *, bool_or(lit) OVER (PARTITION BY page) AS any_lit FROM k)
SELECT page, n, CASE WHEN any_lit THEN 'highlighted' ELSE 'all_names' END AS selection_mode, count(*) AS n_tokens FROM a WHERE lit OR NOT any_lit GROUP BY ALL""")
def highlight_selection(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.when(F.col("l_suppkey") % 9 == 0, 0.5).alias("highlight"))
    return tokens.highlighted(rows).groupBy("page", "n", "selection_mode").agg(F.count(F.lit(1)).alias("n_tokens"))


@register("level_labels", """SELECT DISTINCT l_linenumber AS level, CASE l_linenumber WHEN 0 THEN 'أحدث تاريخ' WHEN 1 THEN 'التاريخ الثاني (الأسبق)' WHEN 2 THEN 'التاريخ الثالث' WHEN 3 THEN 'التاريخ الرابع' WHEN 4 THEN 'التاريخ الخامس' ELSE 'التاريخ رقم ' || (l_linenumber + 1) END AS label FROM lineitem""")
def level_labels(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("level")).distinct().select("level", hijri.level_label(F.col("level")).alias("label"))


@register("ocr_keys", f"SELECT o_orderkey AS id, printf('%04d/%02d/%02d x', date // 10000, date // 100 % 100, date % 100) AS key FROM (SELECT o_orderkey, {sql_date()} AS date FROM orders)")
def ocr_keys(spark, sf_dir):
    text = F.concat(F.lit(" "), hijri.display_ar(hijri_of(F.col("o_orderdate"))), F.lit(" ‏  x "))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), names.ocr_key(text).alias("key"))


@register("clean_cells", "SELECT p_partkey AS id, p_name AS name, p_partkey % 3 <> 2 AS is_name FROM part")
def clean_cells(spark, sf_dir):
    """Roster cells: a row number, a name and a rank; every third one holds a date too, so it is no name."""
    p = F.col("p_partkey")
    cell = F.concat((p % 50).cast("string"), F.lit(" - "), arabic(F.col("p_name")), F.when(p % 3 == 1, " جندي أول").otherwise(" رقيب"))
    dated = F.when(p % 3 == 2, F.concat(cell, F.lit(" 1447/01/02"))).otherwise(cell)
    return read(spark, sf_dir, "part").select(p.alias("id"), F.translate(names.clean_cell(cell), ARABIC, LATIN).alias("name"), names.is_name_cell(dated).alias("is_name"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook a nation: its customers, under Arabic or English headers; odd nations have no header."""
    nation, c = F.col("c_nationkey"), F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("f"), nation).alias("path"), (c + 1).cast("int").alias("row"),
        F.array(F.when(c % 3 == 0, "x").otherwise((c % 40).cast("string")), F.when(c % 7 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name")), F.when(c % 5 != 0, F.concat(F.lit("1447/01/"), c % 20 + 1))).alias("cells"),
    )
    head = F.when(nation % 2 == 0, F.array(F.lit("الصفحة"), F.lit(" الاسم "), F.lit("التواريخ"))).otherwise(F.array(F.lit("Page no"), F.lit("Full NAME"), F.lit("Dates")))
    return rows.unionByName(read(spark, sf_dir, "customer").select(F.concat(F.lit("f"), nation).alias("path"), F.lit(0).alias("row"), head.alias("cells")).distinct())


@register("workbook_masters", "SELECT 'f' || c_nationkey AS source, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN '1447/01/' || (c_custkey % 20 + 1) END AS dates, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 40 END AS page FROM customer WHERE c_custkey % 7 <> 0")
def workbook_masters(spark, sf_dir):
    return workbooks.master_rows(sheets(spark, sf_dir)).select("source", "name", "dates", "page")


@register("workbook_targets", "SELECT 'f' || c_nationkey AS source, CAST(c_custkey + 1 AS INT) AS row, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE ' ' || c_name END AS name FROM customer")
def workbook_targets(spark, sf_dir):
    return workbooks.target_rows(sheets(spark, sf_dir)).select(F.col("ord.path").alias("source"), F.col("ord.row").alias("row"), "name")


@register("workbook_evidence", "SELECT c_name AS name, 14470000 + 100 + c_custkey % 20 + 1 AS date, CAST(CASE WHEN c_custkey % 3 = 0 OR c_custkey % 40 = 0 THEN 1 ELSE c_custkey % 40 END AS BIGINT) AS page, true AS verified FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0")
def workbook_evidence(spark, sf_dir):
    """The dates columns as evidence, by person: Latin names become Arabic letters first."""
    rows = workbooks.master_rows(sheets(spark, sf_dir)).withColumn("number", F.regexp_extract("name", "[0-9]+", 0)).withColumn("name", arabic(F.translate("number", "0123456789", LATIN[:10])))
    rows = rows.where(F.col("dates").isNotNull())
    noted = spark.createDataFrame([], "person_key string, date int, ord struct<path:string,row:int>")
    found = workbooks.listed_dates(rows, noted)
    number = F.translate(F.translate("person_key", ARABIC, LATIN), LATIN[:10], "0123456789")
    return found.select(F.concat(F.lit("Customer#"), number).alias("name"), "date", F.col("page").cast("long").alias("page"), "verified")


@register("rename_merge", f"""WITH {SQL_EVIDENCE}, n AS (SELECT CASE WHEN person_key = 5 THEN 6 ELSE person_key END AS id, min(ord) AS first, count(*) AS n_occurrences FROM e GROUP BY 1)
SELECT id, n_occurrences, (SELECT count(DISTINCT date) FROM e WHERE CASE WHEN e.person_key = 5 THEN 6 ELSE e.person_key END = n.id) AS n_dates FROM n""")
def rename_merge(spark, sf_dir):
    """Customer 5 turns out to be customer 6."""
    lettered = lambda c: arabic(F.translate(c.cast("string"), "0123456789", LATIN[:10]))
    spelled = lambda n: "".join(ARABIC[int(x)] for x in str(n))
    own = evidence(spark, sf_dir).withColumn("person_key", lettered(F.col("person_key")))
    rows = occurrences(spark, sf_dir).withColumn("person_key", lettered(F.col("person_key"))).withColumn("name", F.col("person_key"))
    people_, after = ev.rename(ev.people(rows), own, spelled(5), spelled(6))
    number = F.translate(F.translate("person_key", ARABIC, LATIN), LATIN[:10], "0123456789").cast("long")
    dates = ev.histories(after, only_verified=False).select("person_key", F.size("dates").cast("long").alias("n_dates"))
    return people_.join(dates, "person_key").select(number.alias("id"), "n_occurrences", "n_dates")


@register("run_summary", SQL_RUN + """SELECT (SELECT count(*) FROM t) AS target_total, (SELECT count(*) FROM p) + (SELECT count(*) FROM d WHERE seq IS NULL OR len(seq) = 0) AS total, (SELECT count(DISTINCT id) FROM t JOIN blocked ON person_key = id) AS blocked_by_pending_dates,
  (SELECT count(*) FROM a JOIN f ON f.id = person_key WHERE NOT verified) AS pending_date_review_total, (SELECT count(*) FROM p JOIN r USING (seq) WHERE status = 'مرتّب') AS ranked_successfully, (SELECT count(*) FROM p JOIN r USING (seq) WHERE status = 'تعادل') AS tied, (SELECT count(*) FROM d WHERE seq IS NULL OR len(seq) = 0) AS no_dates""")
def run_summary(spark, sf_dir):
    one = segment_run(spark, sf_dir)[1]
    return one.select(*[F.col(c).cast("long").alias(c) for c in ("target_total", "total", "blocked_by_pending_dates", "pending_date_review_total", "ranked_successfully", "tied", "no_dates")])


@register("audit_person", f"WITH {sql_people('month')}, {SQL_BOUNDS} SELECT p.id, CAST(r.rank AS BIGINT) AS rank, r.status FROM p JOIN r USING (seq) WHERE p.id = (SELECT min(id) FROM p)")
def audit_person(spark, sf_dir):
    """The customer of smallest number: one row of the results."""
    ranked = ranking.rank_people(people(spark, sf_dir, "month"))
    return ranking_run.audit_person(ranked, ranked.agg(F.min("id")).first()[0]).select("id", "rank", "status")


@register("ranking_table", f"""WITH {sql_people('month')}, {SQL_BOUNDS}
SELECT row_number() OVER (ORDER BY seq, name, id) - 1 AS position, CASE WHEN rank_min = rank_max THEN CAST(CAST(rank_min AS BIGINT) AS VARCHAR) ELSE CAST(rank_min AS BIGINT) || '–' || CAST(rank_max AS BIGINT) END AS rank_label, name AS original_name,
  printf('%04d/%02d/%02d', seq[1] // 10000, seq[1] // 100 % 100, seq[1] % 100) AS latest_date, CASE WHEN len(seq) > 1 THEN printf('%04d/%02d/%02d', seq[2] // 10000, seq[2] // 100 % 100, seq[2] % 100) ELSE '—' END AS previous_date, CAST(len(seq) AS INT) AS date_count, status FROM p JOIN r USING (seq)""")
def ranking_table(spark, sf_dir):
    ranked = ranking.rank_people(people(spark, sf_dir, "month")).withColumn("explanation", F.lit(""))
    return exports.ranking_table(ranked).drop("explanation")
