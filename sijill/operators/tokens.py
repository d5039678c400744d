"""Tokens of a page: votes over repeated readings, rows and columns of a roster, names of a target list.

A `token` row has page, text, x, y, w, h in 0..1 (y from the bottom), confidence, source, and after the votes also
agreement and alternatives. What groups greedily, in the order of the page, runs once a page in Arrow batches: a page is
bounded, so is its group. What is a vote, a band or a range is a plain plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship, sorted_side, written
from ..functions import names

#: A token's group by its first token.
VOTE = "page long, grp int, text string, x double, y double, w double, h double, confidence double, source string"
#: Tolerances and ranges of a roster's geometry.
ROW_TOLERANCE, LINE_TOLERANCE, BASELINE_GAP = 0.014, 0.012, 0.014
BAND_LEAST, BAND_MOST, WHOLE_ROW, SPLIT_ROW, LOOSE_ROW = 0.004, 0.22, 0.98, 0.86, 0.68
NAME_EDGE, NOTES_GAP = 0.64, 0.02
HIGHLIGHT, HUES, SATURATION, VALUE, PADDING = 0.035, (24, 82), 70, 105, 0.006
RULE_SHARE, RULE_WINDOW, RULE_PIXELS, RULES = 0.60, 0.24, 80, 5
ALTERNATIVES = 6


def cy() -> Column:
    """The centre, from the top."""
    return 1 - (F.col("y") + F.col("h") / 2)


def cx() -> Column:
    return F.col("x") + F.col("w") / 2


def page_by_page(tokens: DataFrame, group: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """Runs group over each page's tokens, sorted downwards and leftwards. Pages are dealt to tasks and stream through them in
    Arrow batches, so a task holds one page at a time, and small pages cost no call each."""
    order = [cy().alias("cy"), (-F.col("x")).alias("left")]
    dealt = tokens.select("*", *order).repartition("page").sortWithinPartitions("page", "cy", "left", "text")
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        rows = (row for batch in batches for row in batch.itertuples(index=False))
        for _, page in groupby(rows, key=lambda row: row.page):
            out += group(list(page))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=fields)
                out = []
        if out:
            yield pd.DataFrame(out, columns=fields)

    ship(tokens.sparkSession)
    return dealt.mapInPandas(run, schema)


def first_fit(rows: list, fits: Callable[[list, tuple], bool]) -> list[int]:
    """For rows in order, the first group that fits, else a new one."""
    groups: list[list] = []
    found = []
    for row in rows:
        for k, group in enumerate(groups):
            if fits(group, row):
                group.append(row)
                found.append(k)
                break
        else:
            groups.append([row])
            found.append(len(groups) - 1)
    return found


def vote_groups(readings: DataFrame) -> DataFrame:
    """readings with grp: repeated readings of one place. A reading joins the first group whose first reading it overlaps
    and resembles."""

    def group(page: list) -> list[tuple]:
        def fits(members: list, t: tuple) -> bool:
            f = members[0]
            near = abs(f.cy - t.cy) <= max(0.012, 0.65 * max(f.h, t.h)) and abs(f.x + f.w / 2 - t.x - t.w / 2) <= max(0.025, 0.55 * max(f.w, t.w))
            return near and (f.key == t.key or abs(len(f.text) - len(t.text)) <= 2)

        return [(*row[:9], grp) for row, grp in zip(page, first_fit(page, fits))]

    keyed = readings.select("page", "text", "x", "y", "w", "h", "confidence", "source").withColumn("key", names.ocr_key(F.col("text")))
    return page_by_page(keyed, group, "page long, text string, x double, y double, w double, h double, confidence double, source string, key string, grp int")


def voted(readings: DataFrame) -> DataFrame:
    """One token a group: the key with most sources, then most confidence, then the longest wins, then the first read, then the
    smallest; the losers stay as alternatives."""
    rows = written(vote_groups(readings), "votes").withColumn("ord", F.struct(cy().alias("cy"), (-F.col("x")).alias("right"), "source"))
    best = F.max_by(F.struct("text", "confidence"), F.struct("confidence", "source")).alias("best")
    keys = rows.groupBy("page", "grp", "key").agg(
        F.count_distinct("source").alias("n_sources"), F.sum("confidence").alias("total"), F.avg("confidence").alias("mean"), best, F.min("ord").alias("ord"),
        *[F.avg(c).alias(c) for c in ("x", "y", "w", "h")],
    )
    sources = rows.groupBy("page", "grp").agg(F.count_distinct("source").alias("all_sources"))
    order = Window.partitionBy("page", "grp").orderBy(F.desc("n_sources"), F.desc(F.round("total", 9)), F.desc(F.char_length("key")), "ord", "key")
    ranked = keys.withColumn("place", F.row_number().over(order))
    losers = ranked.where("place > 1").groupBy("page", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "best"))), lambda a: a["best"]).alias("alternatives"))
    won = ranked.where("place = 1").join(sorted_side(sources), ["page", "grp"]).join(sorted_side(losers), ["page", "grp"], "left")
    score = F.least(F.lit(1.0), F.col("best.confidence") * 0.55 + F.col("mean") * 0.25 + F.col("n_sources") / F.greatest(F.lit(1), "all_sources") * 0.20)
    alone = (F.col("n_sources") == 1) & (F.col("all_sources") > 1)
    return won.select(
        "page", "grp", F.col("best.text").alias("text"), "x", "y", "w", "h", F.when(alone, score * 0.82).otherwise(score).alias("confidence"), F.col("n_sources").cast("int").alias("agreement"),
        F.slice(F.coalesce("alternatives", F.array().cast("array<struct<text:string,confidence:double>>")), 1, ALTERNATIVES).alias("alternatives"), F.lit("consensus").alias("source"),
    )


def clustered_rows(tokens: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """tokens with row: by height, a new row where a token is off the running centre. One fold over each page's sorted heights."""
    heights = tokens.groupBy("page").agg(F.array_sort(F.collect_list(cy())).alias("heights"))  # a page's tokens: bounded

    def step(state: Column, c: Column) -> Column:
        stays = state["centre"].isNull() | (F.abs(c - state["centre"]) <= tolerance)
        row = F.when(stays, state["row"]).otherwise(state["row"] + 1)
        centre = F.when(state["centre"].isNull() | ~stays, c).otherwise(state["centre"] * 0.55 + c * 0.45)
        return F.struct(centre.alias("centre"), row.alias("row"), F.concat(state["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(None).cast("double").alias("centre"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("rows"))
    folded = heights.select("page", F.explode(F.arrays_zip("heights", F.aggregate("heights", start, step, lambda s: s["rows"]).alias("rows"))).alias("z"))
    rows = folded.select("page", F.col("z.heights").alias("_cy"), F.col("z.rows").alias("row")).distinct()
    return tokens.withColumn("_cy", cy()).join(sorted_side(rows), ["page", "_cy"]).drop("_cy")


def columns(rules: DataFrame) -> DataFrame:
    """(page, notes_right, name_left, name_right) from vertical rules (page, x): of all plausible layouts the one nearest to a
    roster's proportions. Pages without one have no row. Rules of a page are few."""
    nth = Window.partitionBy("page").orderBy("x")
    every = Window.partitionBy("page")
    lines = rules.select("page", "x", F.row_number().over(nth).alias("i"), F.count(F.lit(1)).over(every).alias("n"), F.min("x").over(every).alias("first"), F.max("x").over(every).alias("last")).where(F.col("n") >= RULES)
    side = lambda name: sorted_side(lines.select("page", F.col("x").alias(name), F.col("i").alias(f"{name}_i")))
    right = lines.where((F.col("x") >= 0.90) & (F.col("i") >= 5)).select("page", F.col("x").alias("right"), F.col("i").alias("right_i"), "first", "last")
    found = (
        right.join(side("name_right"), "page").where((F.col("name_right_i") < F.col("right_i")) & (F.col("name_right_i") >= 3) & (F.col("right") - F.col("name_right")).between(0.025, 0.115))
        .join(side("name_left"), "page").where((F.col("name_left_i") < F.col("name_right_i")) & (F.col("name_left_i") >= 2) & (F.col("name_right") - F.col("name_left")).between(0.10, 0.32))
        .join(side("notes_right"), "page").where((F.col("notes_right_i") < F.col("name_left_i")) & (F.col("name_left") - F.col("notes_right")).between(0.025, 0.14) & (F.col("notes_right") - F.col("first") >= 0.30))
    )
    score = (
        F.abs(F.col("right") - F.col("name_right") - 0.055) + F.abs(F.col("name_right") - F.col("name_left") - 0.17) * 0.70
        + F.abs(F.col("name_left") - F.col("notes_right") - 0.065) * 0.80 + F.abs(F.col("right") - F.col("last")) * 0.20
    )
    return found.groupBy("page").agg(F.min(F.struct(score.alias("score"), "notes_right", "name_left", "name_right")).alias("best")).select("page", "best.notes_right", "best.name_left", "best.name_right")


def bands(boundaries: DataFrame) -> DataFrame:
    """(page, band, top, bottom) between neighbouring horizontal rules (page, y), of a row's possible height."""
    nth = Window.partitionBy("page").orderBy("y")
    rows = boundaries.select("page", F.col("y").alias("top"), F.lead("y").over(nth).alias("bottom"), F.row_number().over(nth).alias("band"))
    return rows.where((F.col("bottom") - F.col("top") >= BAND_LEAST) & (F.col("bottom") - F.col("top") <= BAND_MOST))


def in_bands(tokens: DataFrame, boundaries: DataFrame, grid: DataFrame) -> DataFrame:
    """tokens with row (a struct that orders like the page) and association: how surely the row is one person's. A band with several
    baselines in the name column is cut between them. Pages without any row in a band fall back to clustered rows."""
    placed = tokens.withColumns({"cy": cy(), "cx": cx()}).join(sorted_side(bands(boundaries)), "page").where((F.col("cy") >= F.col("top")) & (F.col("cy") < F.col("bottom"))).join(sorted_side(grid), "page")
    is_name = (F.col("cx") >= F.col("name_left")) & (F.col("cx") <= F.col("name_right")) & F.col("text").rlike(names.ARABIC)

    def step(centres: Column, c: Column) -> Column:
        last = F.element_at(centres, -1)
        apart = (F.size(centres) == 0) | (F.abs(c - last) > BASELINE_GAP)
        return F.when(apart, F.concat(centres, F.array(c))).otherwise(F.concat(F.slice(centres, F.lit(1), F.greatest(F.size(centres) - 1, F.lit(0))), F.array((last + c) / 2)))

    centres = F.aggregate("heights", F.array().cast("array<double>"), lambda s, c: F.when(F.size(s) == 0, F.array(c)).otherwise(step(s, c)))
    by_band = placed.groupBy("page", "band").agg(F.array_sort(F.collect_list(F.when(is_name, F.col("cy")))).alias("heights")).select("page", "band", centres.alias("centres"))
    cuts = F.transform(F.filter("centres", lambda c, i: i > 0), lambda c, i: (F.get("centres", i) + c) / 2)
    placed = placed.join(sorted_side(by_band), ["page", "band"])
    part = F.size(F.filter(cuts, lambda cut: cut <= F.col("cy")))
    found = placed.withColumns({"row": F.struct("band", part.alias("part")), "association": F.when(F.size("centres") <= 1, WHOLE_ROW).otherwise(SPLIT_ROW)})
    kept = [*tokens.columns, "cy", "cx", "row", "association", "notes_right", "name_left", "name_right"]
    loose = clustered_rows(tokens.join(sorted_side(found.select("page").distinct()), "page", "left_anti")).withColumns({"cy": cy(), "cx": cx(), "row": F.struct(F.col("row").alias("band"), F.lit(0).alias("part")), "association": F.lit(LOOSE_ROW)}).join(sorted_side(grid), "page", "left")
    return found.select(*kept).unionByName(loose.select(*kept))


def clustered_columns(tokens: DataFrame) -> DataFrame:
    """Like in_bands, for pages without a grid."""
    none = F.lit(None).cast("double")
    return clustered_rows(tokens).withColumns({"cy": cy(), "cx": cx(), "row": F.struct(F.col("row").alias("band"), F.lit(0).alias("part")), "association": F.lit(LOOSE_ROW), "notes_right": none, "name_left": none, "name_right": none})


def page_rows(placed: DataFrame) -> DataFrame:
    """Roster rows (page, row_index, original_name, rank, notes, confidence, name_confidence, agreement, association) of placed
    tokens. Rows without a name go, and header rows without a date."""
    nth = Window.partitionBy("page").orderBy("row")
    gridded = F.col("name_left").isNotNull()
    dated = F.col("text").rlike(names.DATE_IN_CELL)
    in_name = F.when(gridded, F.col("cx").between(F.col("name_left"), F.col("name_right"))).otherwise(F.col("cx") >= NAME_EDGE) & ~dated
    by_row = Window.partitionBy("page", "row")
    rows = placed.withColumns({"_dated": dated, "_in_name": in_name, "_rank": names.is_rank(F.col("text"))})
    edge = F.coalesce(F.min(F.when(F.col("_in_name"), F.col("x"))).over(by_row), F.lit(NAME_EDGE))
    rows = rows.withColumns({
        "_in_notes": F.when(gridded, F.col("cx") < F.col("notes_right")).otherwise(F.col("x") < edge - NOTES_GAP),
        "_in_rank": F.when(gridded, (F.col("cx") >= F.col("notes_right")) & (F.col("cx") < F.col("name_left"))).otherwise(F.lit(True)) & F.col("_rank"),
        "row_index": F.dense_rank().over(nth) - 1,
    })
    listed = lambda condition, *fields: F.array_sort(F.collect_list(F.when(condition, F.struct(*fields))))
    down, leftwards = F.col("cy"), (-F.col("x")).alias("left")
    grouped = rows.groupBy("page", "row_index").agg(
        F.first("association").alias("association"),
        F.bool_or(F.col("text").rlike(names.HEADER)).alias("_header"), F.bool_or(F.col("_dated")).alias("_any_date"),
        listed(F.col("_in_name"), leftwards, "cy", "text", "confidence", "agreement").alias("_names"),
        F.min_by(names.key(F.col("text")), F.when(F.col("_in_rank"), F.struct(down, leftwards))).alias("rank"),
        listed(F.col("_in_notes") & (names.trimmed(F.col("text")) != ""), down, leftwards, "text").alias("_notes"),
        F.avg(F.when(F.col("_in_notes") & F.col("_dated"), F.col("confidence"))).alias("_date_confidence"),
        F.min(F.when(F.col("_in_notes") & F.col("_dated"), F.col("agreement"))).alias("_date_agreement"),
    )
    grouped = grouped.where(~F.col("_header") | F.col("_any_date"))
    read = lambda text, confidence, agreement: F.struct(agreement.alias("agreement"), confidence.alias("confidence"), names.clean_cell(text).alias("text"))
    single = F.transform("_names", lambda t: read(t["text"], t["confidence"], t["agreement"]))
    n = F.size("_names")
    joined = read(F.array_join(F.transform("_names", lambda t: t["text"]), " "), F.aggregate("_names", F.lit(0.0), lambda s, t: s + t["confidence"]) / F.greatest(n, F.lit(1)), F.array_min(F.transform("_names", lambda t: t["agreement"])))
    options = F.filter(F.concat(single, F.when(n > 0, F.array(joined)).otherwise(F.array().cast("array<struct<agreement:int,confidence:double,text:string>>"))), lambda o: names.is_name_cell(o["text"]))
    words = lambda o: F.size(names.tokens(o["text"])).between(2, 5)
    best = F.array_max(F.transform(options, lambda o: F.struct(o["agreement"].alias("agreement"), o["confidence"].alias("confidence"), words(o).alias("usual"), F.char_length(o["text"]).alias("length"), o["text"].alias("text"))))
    grouped = grouped.withColumn("_best", best).where(F.col("_best").isNotNull())
    score = F.least("association", F.coalesce(F.when(F.col("_date_confidence") > 0, F.col("_date_confidence")), F.col("_best.confidence")))
    sure = (F.coalesce("_date_agreement", F.lit(0)) >= 2) & (F.col("association") >= 0.95)
    return grouped.select(
        "page", "row_index", F.col("_best.text").alias("original_name"), F.coalesce("rank", F.lit("")).alias("rank"),
        F.array_join(F.transform("_notes", lambda t: names.trimmed(t["text"])), " ").alias("notes"),
        F.when(sure, F.least(F.lit(0.99), score + 0.04)).otherwise(score).alias("confidence"), F.col("_best.confidence").alias("name_confidence"),
        F.coalesce(F.least("_best.agreement", "_date_agreement"), F.col("_best.agreement")).alias("agreement"), "association",
    )


def lines(tokens: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """(page, line, text): tokens joined from right to left, in lines by their running mean height."""

    def group(page: list) -> list[tuple]:
        found = first_fit(page, lambda members, t: abs(t.cy - sum(m.cy for m in members) / len(members)) <= max(tolerance, t.h * 0.55))
        return [(t.page, line, t.left, t.text) for t, line in zip(page, found)]

    placed = page_by_page(tokens.select("page", "text", "x", "y", "h"), group, "page long, line int, left double, text string")
    return placed.groupBy("page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda t: t["text"]), " ").alias("text"))


def combined(tokens: DataFrame) -> DataFrame:
    """Tokens that read like a name, and those of neighbouring words joined from right to left; a wide gap parts a row."""

    letters = re.compile(names.ARABIC)

    def group(page: list) -> list[tuple]:
        rows = first_fit(page, lambda members, t: abs(sum(m.cy for m in members) / len(members) - t.cy) <= max(0.012, t.h * 0.65))
        out, before, segment, last = [], None, 0, None
        for row, t in sorted(zip(rows, page), key=lambda p: (p[0], p[1].left)):
            own = None
            if letters.search(t.text):
                apart = before is None or row != last or before.x - (t.x + t.w) > max(0.035, 1.8 * max(before.h, t.h))
                segment += apart
                before, last, own = t, row, segment
            out.append((t.page, row, own, t.left, t.text, t.x, t.y, t.w, t.h, t.cy, t.confidence, t.agreement))
        return out

    cut = page_by_page(tokens.select("page", "text", "x", "y", "w", "h", "confidence", "agreement"), group, "page long, row int, segment double, left double, text string, x double, y double, w double, h double, cy double, confidence double, agreement int")
    single = cut.select("page", names.strip_fields(F.col("text")).alias("text"), F.col("text").alias("raw"), "x", "y", "w", "h", "confidence", "agreement")
    top, bottom = F.min(F.col("cy") - F.col("h") / 2), F.max(F.col("cy") + F.col("h") / 2)
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda t: t["text"]), " ")
    joined = cut.where(F.col("segment").isNotNull()).groupBy("page", "row", "segment").agg(
        F.count(F.lit(1)).alias("n"), raw.alias("raw"), F.min("x").alias("x"), (1 - bottom).alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (bottom - top).alias("h"), F.avg("confidence").alias("confidence"), F.min("agreement").alias("agreement"),
    ).where("n > 1")
    joined = joined.select("page", names.strip_fields(F.col("raw")).alias("text"), "raw", "x", "y", "w", "h", "confidence", "agreement")
    return single.unionByName(joined).where(names.is_target_name(F.col("text")))


def target_readings(tokens: DataFrame) -> DataFrame:
    """The strongest reading of each name key of a page: most sources, then confidence, then the longest, then the first."""
    found = combined(tokens).withColumn("key", names.key(F.col("text")))
    order = Window.partitionBy("page", "key").orderBy(F.desc("agreement"), F.desc("confidence"), F.desc(F.char_length("text")), cy(), F.desc("x"))
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def highlighted(tokens: DataFrame) -> DataFrame:
    """Of pages with a highlighted token only those, of the others all. tokens need highlight."""
    page = Window.partitionBy("page")
    lit = F.coalesce("highlight", F.lit(0.0)) >= HIGHLIGHT
    return tokens.withColumn("_lit", lit).withColumn("_any", F.max("_lit").over(page)).where(F.col("_lit") | ~F.col("_any")).withColumn("selection_mode", F.when(F.col("_any"), "highlighted").otherwise("all_names")).drop("_lit", "_any")


def highlight_scores(tokens: DataFrame, pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """tokens with highlight, the share of coloured pixels (page, px, py, hue, saturation, value) in their padded boxes; sizes: (page,
    width, height). Pixels are found by page and row of the box."""
    c = cy()
    edge = lambda value, size: F.floor(value * F.col(size)).cast("int")
    boxes = tokens.withColumn("_id", F.monotonically_increasing_id()).join(sorted_side(sizes), "page").withColumns({
        "_left": F.greatest(F.lit(0), edge(F.col("x") - PADDING, "width")), "_right": F.least(F.col("width"), edge(F.col("x") + F.col("w") + PADDING, "width")),
        "_top": F.greatest(F.lit(0), edge(c - F.col("h") / 2 - PADDING, "height")), "_bottom": F.least(F.col("height"), edge(c + F.col("h") / 2 + PADDING, "height")),
    })
    rows = boxes.where((F.col("_right") > F.col("_left")) & (F.col("_bottom") > F.col("_top"))).select("page", "_left", "_right", F.explode(F.sequence("_top", F.col("_bottom") - 1)).alias("py"), "text", "x", "y")
    coloured = F.col("hue").between(*HUES) & (F.col("saturation") >= SATURATION) & (F.col("value") >= VALUE)
    inside = rows.join(sorted_side(pixels), ["page", "py"]).where((F.col("px") >= F.col("_left")) & (F.col("px") < F.col("_right")))
    share = inside.groupBy("page", "text", "x", "y").agg(F.avg(coloured.cast("int")).alias("highlight"))
    return tokens.join(sorted_side(share), ["page", "text", "x", "y"], "left").fillna(0.0, ["highlight"])


def clustered_axis(marked: DataFrame, size: Column, merge: float = 0.006) -> DataFrame:
    """(page, at): centres, as shares of the size, of runs of marked indices (page, index) that lie near each other."""
    order = Window.partitionBy("page").orderBy("index")
    near = F.greatest(F.lit(3), F.rint(size * merge))
    fresh = F.coalesce(F.col("index") - F.lag("index").over(order) > near, F.lit(True)).cast("int")
    runs = marked.withColumn("_size", size).withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(order))
    return runs.groupBy("page", "run").agg((F.avg("index") / F.first("_size")).alias("at")).select("page", "at")


def ruled(dark: DataFrame, along: str, across: str, length: Column) -> DataFrame:
    """(page, index): lines of pixels (page, px, py, dark) that are dark for most of some window. A moving sum over each line."""
    window = F.greatest(F.lit(RULE_PIXELS), F.floor(length * RULE_WINDOW)).cast("int")
    runs = Window.partitionBy("page", across).orderBy(along)
    summed = dark.withColumn("_window", window).withColumn("_sum", F.sum(F.col("dark").cast("int")).over(runs))
    lagged = summed.alias("a").join(summed.select("page", F.col(across), (F.col(along) + F.col("_window")).alias(along), F.col("_sum").alias("_before")).hint("merge").alias("b"), ["page", across, along], "left")
    whole = F.col(along) + 1 >= F.col("_window")
    share = (F.col("_sum") - F.coalesce("_before", F.lit(0))) / F.col("_window")
    return lagged.where(whole).groupBy("page", F.col(across).alias("index")).agg(F.max(share).alias("share")).where(F.col("share") >= RULE_SHARE).select("page", "index")
