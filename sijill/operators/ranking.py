"""Ranking of histories as a partial order.

A history is the distinct dates of a person, newest first. Of two histories the one with the older date at the
first difference precedes; if one ends before they differ, they can't be compared, and neither is preferred. So
histories are incomparable exactly if one is a proper prefix of the other, and the whole order follows from the
lexicographic one: with `less` people whose history sorts before mine, `pre` people whose history is a proper prefix of
mine, and `ext` people whose history properly extends mine, at least less - pre people precede me, and my last
possible place is 1 + less + ext.

That takes one ranking and one equi-join with prefixes, O(sum of lengths) rows; no pairs of people are made. The global
ranking doesn't pass through one task: histories are ranked within their newest date, and the dates' totals (there
are about 108 thousand legal dates) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import sorted_side, written
from ..functions import hijri

#: Statuses of a ranked row.
RANKED, TIE, UNRESOLVED, NO_DATES = "مرتّب", "تعادل", "تعادل غير محسوم بالبيانات المتاحة", "بدون تواريخ صالحة"
NOT_FOUND, NEEDS_REVIEW = "غير موجود في الملف الرئيسي", "يحتاج مراجعة"
#: Explanations.
SEQUENCE = "تسلسل تواريخ «%s» (من الأحدث للأقدم): %s. "
UNRESOLVED_TEXT = "الموضع الممكن من %d إلى %d؛ تعذّر حسم المقارنة مع %s لأن أحد التسلسلين انتهى بعد بادئة متطابقة. لم يُختلق كسر تعادل."
TIE_TEXT = "تعادل تام بين %s: التسلسل التاريخي الموثق متطابق بالكامل. لم يُطبَّق أي كسر تعادل إضافي."
RANKED_TEXT = "الموضع %d محسوم بالمقارنة المعجمية التاريخية؛ الأقدم يتقدم عند أول اختلاف."
NO_DATES_TEXT = "لا توجد تواريخ صالحة ومعتمدة؛ لا يدخل في المقارنة التاريخية."
FIRST_TEXT = " (الأول في الترتيب حسب القاعدة)."
AFTER_TEXT = " جاء بعد «%s» لأن عند %s تاريخه %s أحدث من %s."
BEFORE_NAMES, AFTER_NAMES = " يسبق حتمًا: ", " يسبقه حتمًا: "


def history(dates: Column) -> Column:
    """Distinct dates, newest first; a null array is empty, null dates go."""
    return F.sort_array(F.array_distinct(F.array_compact(F.coalesce(dates, F.array().cast("array<int>")))), asc=False)


def compare(a: Column, b: Column) -> Column:
    """struct<result, level, date_a, date_b> of two histories: a, b (who precedes), tie or unresolved."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
    date_a, date_b = F.get(a, at - 1), F.get(b, at - 1)
    result = F.when(at == 0, "tie").when(date_a.isNull() | date_b.isNull(), "unresolved").when(date_a < date_b, "a").otherwise("b")
    decided = result.isin("a", "b")
    return F.struct(
        result.alias("result"),
        F.when(at == 0, F.size(a)).otherwise(at - 1).alias("level"),
        F.when(decided, date_a).alias("date_a"),
        F.when(decided, date_b).alias("date_b"),
    )


def numbered(df: DataFrame, bucket: Column, order: list[str], name: str, weight: Column | None = None) -> DataFrame:
    """df with a global running number: the rows (or the weight) that stand before. bucket must order like `order`'s
    beginning, and have few values; only its totals pass through one task."""
    weight = F.lit(1) if weight is None else weight
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy("_bucket").agg(F.sum(weight).alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumn("_within", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return counted.join(F.broadcast(totals.withColumnRenamed("_bucket", "_of")), counted["_bucket"].eqNullSafe(F.col("_of"))).withColumn(name, (F.col("_offset") + F.col("_within")).cast("long")).drop("_bucket", "_of", "_within", "_offset")


def classes(people: DataFrame) -> DataFrame:
    """(seq, size): people of equal histories."""
    return people.where(F.size("seq") > 0).groupBy("seq").agg(F.count(F.lit(1)).alias("size"))


def prefix_pairs(found: DataFrame) -> DataFrame:
    """(seq, size, prefix, prefix_size): each class with each class whose history is a proper prefix of its own."""
    prefixes = F.filter(F.transform(F.sequence(F.lit(1), F.size("seq")), lambda k: F.slice("seq", F.lit(1), k)), lambda p: F.size(p) < F.size("seq"))
    cut = found.select("seq", "size", F.explode(prefixes).alias("prefix"))
    return cut.join(sorted_side(found.select(F.col("seq").alias("prefix"), F.col("size").alias("prefix_size"))), "prefix")


def bounds(found: DataFrame) -> DataFrame:
    """Classes with less, pre, ext, rank_min, rank_max and the shared rank of their component."""
    pairs = prefix_pairs(found)
    pre = pairs.groupBy("seq").agg(F.sum("prefix_size").alias("pre"), F.min_by("prefix", F.size("prefix")).alias("root"))
    ext = pairs.groupBy(F.col("prefix").alias("seq")).agg(F.sum("size").alias("ext"))
    ranked = numbered(found, F.get("seq", F.lit(0)), ["seq"], "less", F.col("size"))
    joined = ranked.join(sorted_side(pre), "seq", "left").join(sorted_side(ext), "seq", "left").fillna(0, ["pre", "ext"])
    joined = joined.withColumn("root", F.coalesce("root", "seq"))
    roots = joined.select(F.col("seq").alias("root"), F.col("less").alias("root_less"))
    return joined.join(sorted_side(roots), "root").select(
        "seq", "size", "less", "pre", "ext",
        (F.col("less") - F.col("pre") + 1).alias("rank_min"),
        (F.col("less") + F.col("ext") + 1).alias("rank_max"),
        (F.col("root_less") + 1).alias("rank"),
    )


def rank_people(people: DataFrame) -> DataFrame:
    """people (id, original_name, normalized_name, dates array<int>) with their place in the partial order: position,
    rank, rank_min, rank_max, rank_exact, rank_display, status, group_size, seq and what is derived from it. People
    without dates share the place after all others. Other columns pass through."""
    people = written(people.withColumn("seq", history(F.col("dates"))).drop("dates"), "people")
    found = written(bounds(written(classes(people), "classes")), "bounds")
    dated = people.where(F.size("seq") > 0).join(sorted_side(found), "seq")
    open_ = (F.col("pre") + F.col("ext")) > 0
    dated = dated.select(
        *people.columns, "rank", "rank_min", "rank_max", (~open_).alias("rank_exact"),
        F.when(open_, UNRESOLVED).when(F.col("size") > 1, TIE).otherwise(RANKED).alias("status"),
        F.when(open_, 1 + F.col("pre") + F.col("ext")).otherwise(F.col("size")).alias("group_size"),
    )
    dated = numbered(dated, F.get("seq", F.lit(0)), ["seq", "normalized_name", "id"], "position")
    undated = people.where(F.size("seq") == 0)
    total = found.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"))
    undated = undated.join(undated.agg(F.count(F.lit(1)).alias("group_size")).join(F.broadcast(total)).hint("broadcast"))
    undated = numbered(undated, F.substring("normalized_name", 1, 2), ["normalized_name", "id"], "later")
    last = F.col("total") + 1
    undated = undated.select(
        *people.columns, last.alias("rank"), last.alias("rank_min"), last.alias("rank_max"), F.lit(True).alias("rank_exact"),
        F.lit(NO_DATES).alias("status"), "group_size", (F.col("total") + F.col("later")).alias("position"),
    )
    span = F.when(F.col("rank_exact"), F.col("rank_min").cast("string")).otherwise(F.concat("rank_min", F.lit("–"), "rank_max"))
    return dated.unionByName(undated).select(
        "*", span.alias("rank_display"),
        F.transform("seq", hijri.display).alias("date_list"), F.transform("seq", hijri.display_ar).alias("date_list_ar"),
        hijri.display(F.get("seq", F.lit(0))).alias("latest_date"), hijri.display(F.get("seq", F.lit(1))).alias("previous_date"),
        F.size("seq").alias("date_count"),
    )


def unresolved_names(people: DataFrame) -> DataFrame:
    """(seq, unresolved_with): the sorted names of the people that a class can't be compared with."""
    members = people.where(F.size("seq") > 0)
    pairs = prefix_pairs(classes(people)).select("seq", "prefix")
    both = pairs.select("seq", F.col("prefix").alias("peer")).unionByName(pairs.select(F.col("prefix").alias("seq"), F.col("seq").alias("peer")))
    named = both.join(sorted_side(members.select(F.col("seq").alias("peer"), "original_name")), "peer")
    return named.groupBy("seq").agg(F.array_sort(F.collect_list("original_name")).alias("unresolved_with"))


def precedence(people: DataFrame) -> DataFrame:
    """(id, other_id) of all pairs in which id strictly precedes other_id. As many rows as such pairs: for rosters, not corpora.
    A range join over the newest date of dated people; equal newest dates are compared further."""
    a = people.where(F.size("seq") > 0).select("id", "seq")
    b = a.select(F.col("id").alias("other_id"), F.col("seq").alias("other"))
    return a.join(b, compare(F.col("seq"), F.col("other"))["result"] == "a").select("id", "other_id")


def with_precedence(ranked: DataFrame) -> DataFrame:
    """Adds strictly_before (whom a person precedes) and strictly_after (who precedes them), names sorted."""
    pairs = precedence(ranked)
    names = ranked.select("id", "original_name")
    ahead = pairs.join(names.select(F.col("id").alias("other_id"), "original_name"), "other_id").groupBy("id").agg(F.array_sort(F.collect_list("original_name")).alias("strictly_before"))
    behind = pairs.join(names, "id").groupBy(F.col("other_id").alias("id")).agg(F.array_sort(F.collect_list("original_name")).alias("strictly_after"))
    empty = F.array().cast("array<string>")
    return ranked.join(ahead, "id", "left").join(behind, "id", "left").withColumns({c: F.coalesce(c, empty) for c in ("strictly_before", "strictly_after")})


def versus_previous(ranked: DataFrame) -> DataFrame:
    """Adds `vs_previous`, struct<previous, level, prev_date, this_date> where the row above decides, and `is_first`. The row
    above is found by its position, not by one sorted task."""
    above = ranked.select((F.col("position") + 1).alias("position"), F.struct("original_name", "seq", "status", "rank").alias("above"))
    joined = ranked.join(sorted_side(above), "position", "left")
    compared = compare(F.col("above.seq"), F.col("seq"))
    told = (F.col("status") != NO_DATES) & ~F.col("status").eqNullSafe(UNRESOLVED) & F.col("above").isNotNull() & ~F.col("above.status").isin(UNRESOLVED, NO_DATES) & (F.col("rank") != F.col("above.rank"))
    note = F.struct(F.col("above.original_name").alias("previous"), compared["level"].alias("level"), hijri.display(compared["date_a"]).alias("prev_date"), hijri.display(compared["date_b"]).alias("this_date"))
    first = (F.col("above").isNull() | (F.col("above.status") == NO_DATES)) & (F.col("rank") == 1) & (F.col("status") == RANKED)
    return joined.withColumn("vs_previous", F.when(told & (compared["result"] == "a"), note)).withColumn("is_first", first).drop("above")


def _quoted(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("«"), n, F.lit("»"))), " و ")


def explained(ranked: DataFrame, detail: bool = False) -> DataFrame:
    """Adds unresolved_with, explanation and comparison_path (JSON strings). detail: also who strictly precedes whom."""
    empty = F.array().cast("array<string>")
    ranked = written(ranked, "ranked")
    tied = ranked.where(F.col("status") == TIE).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("normalized_name", "id", "original_name"))).alias("_tied"))
    rows = versus_previous(ranked).join(sorted_side(unresolved_names(ranked)), "seq", "left").join(sorted_side(tied), "seq", "left")
    rows = rows.withColumn("unresolved_with", F.coalesce("unresolved_with", empty)).withColumn("_tied", F.transform("_tied", lambda x: x["original_name"]))
    if detail:
        pairs = with_precedence(ranked).select("id", "strictly_before", "strictly_after")
        rows = rows.join(pairs, "id", "left")
    else:
        rows = rows.withColumns({"strictly_before": empty, "strictly_after": empty})
    listed = lambda head, names: F.when(F.size(names) > 0, F.concat(F.lit(head), F.array_join(names, "، "), F.lit("."))).otherwise("")
    sequence = F.format_string(SEQUENCE, "original_name", F.array_join("date_list_ar", " ← "))
    text = (
        F.when(F.col("status") == UNRESOLVED, F.concat(sequence, F.format_string(UNRESOLVED_TEXT, "rank_min", "rank_max", _quoted(F.col("unresolved_with"))), listed(BEFORE_NAMES, F.col("strictly_before")), listed(AFTER_NAMES, F.col("strictly_after"))))
        .when(F.col("status") == TIE, F.format_string(TIE_TEXT, _quoted(F.col("_tied"))))
        .when(F.col("status") == RANKED, F.concat(sequence, F.format_string(RANKED_TEXT, "rank_min")))
        .otherwise(NO_DATES_TEXT)
    )
    v = F.col("vs_previous")
    after = F.when(v.isNotNull(), F.format_string(AFTER_TEXT, v["previous"], hijri.level_label(v["level"]), v["this_date"], v["prev_date"])).otherwise("")
    place = F.to_json(F.struct(F.lit("partial_order_bounds").alias("type"), "rank_min", "rank_max", "strictly_before", "strictly_after", "unresolved_with"))
    path = F.array(
        F.when(F.col("status") != NO_DATES, place),
        F.when(F.col("status") == TIE, F.to_json(F.struct(F.lit("full_tie").alias("type"), F.col("_tied").alias("group")))),
        F.when(v.isNotNull(), F.to_json(F.struct(F.lit("vs_previous").alias("type"), v["previous"].alias("previous"), v["level"].alias("level"), v["prev_date"].alias("prev_date"), v["this_date"].alias("this_date")))),
    )
    rows = rows.withColumn("explanation", F.concat(text, F.when(F.col("is_first"), FIRST_TEXT).otherwise(""), after))
    return rows.withColumn("comparison_path", F.array_compact(path)).drop("_tied", "is_first")


def summary(ranked: DataFrame) -> DataFrame:
    """One row: total, ranked_successfully, tied, unresolved, no_dates."""
    count = lambda status: F.count_if(F.col("status") == status)
    return ranked.agg(F.count(F.lit(1)).alias("total"), count(RANKED).alias("ranked_successfully"), count(TIE).alias("tied"), count(UNRESOLVED).alias("unresolved"), count(NO_DATES).alias("no_dates"))
