"""License scans: an exact set-similarity join of text blocks with license templates.

Every line of a text is a block, and so is every run of 2 to RUN consecutive lines with words, as notices are wrapped; a run is a
block for a template only if it has at most twice as many words as the notice. A block is a set of words. A template (a set
of words, and a threshold t) matches a block that contains at least t of its words. Words are ordered by how many
documents hold them, rarest first. Three filters find the candidates, and lose none:

* prefix: a matching block holds one of the template's first |T| - ceil(t |T|) + 1 words;
* length: a matching block has at least ceil(t |T|) words;
* positional: if the first held word of the template stands at place p, at most |T| - p of its words can be held.

Candidates are then counted exactly. Phrase templates have t = 1, the whole text as block, and are verified
as words that stand consecutively. The order comes from a count over all documents of the templates' words
only; it has a row a template word, and the templates are a fixed list, so both are of proven size.

Defined results: a null or empty text has no words, no labels, null places and score 0; a phrase counts at
every place; repeated rows are rows; equally frequent words stand by spelling; columns of the input other
than id and text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: What the words are made of: a-z, digits, and everything beyond ASCII.
LETTER, LETTER_ANY_CASE = r"[0-9a-z\x{80}-\x{10FFFF}]", r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
NO_LETTER_ANY_CASE = LETTER_ANY_CASE.replace("[", "[^")

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Lines that licenses ask for, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "this work is licensed under a creative commons attribution license": "cc-by",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "all-rights-reserved",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  # distinct
    least: int  # words that a block must hold
    phrase: str = ""
    longest: int = 0  # words of a run of lines, at most


#: Lines of a run, at most: notices have up to 22 words, and lines wrapped at 40 characters 6.
RUN = 4


def templates(threshold: float = 0.8) -> list[Template]:
    found = [Template(label, tuple(dict.fromkeys(p.split())), len(set(p.split())), p) for p, label in PHRASES.items()]
    for text, label in NOTICES.items():
        words = tuple(dict.fromkeys(text.split()))
        found.append(Template(label, words, math.ceil(threshold * len(words) - 1e-9), longest=2 * len(text.split())))
    return found


def global_order(docs: DataFrame, text: Column, known: list[Template]) -> list[str]:
    """The templates' words, rarest first by the number of documents that hold them: one count over all documents."""
    words = sorted({w for t in known for w in t.words})
    # One scan for all: the held words of each text, each counted once.
    held = F.array_intersect(F.regexp_extract_all(text, F.lit(rf"{LETTER}+"), F.lit(0)), F.array(*[F.lit(w) for w in words]))
    counts = dict(docs.select(F.explode(held).alias("w")).groupBy("w").count().collect())
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def phrase_pattern(phrase: str) -> str:
    """The phrase's words, with no letter before, after, and something else between them, in any ASCII case."""
    return f"(?i)(?<!{LETTER_ANY_CASE})" + f"{NO_LETTER_ANY_CASE}+".join(map(re.escape, phrase.split())) + f"(?!{LETTER_ANY_CASE})"


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _matches(block: Column, template: Template, order: dict[str, int]) -> Column:
    """The filters and the exact count for a block's words that stand in some template."""
    ranked = sorted(template.words, key=order.__getitem__)
    n = len(ranked)
    prefix = F.arrays_overlap(block, _literal(ranked[: n - template.least + 1]))
    # The place of the first held word, the rarest: what is left bounds the overlap.
    overlap = F.array_intersect(_literal(ranked), block)
    place = F.array_position(_literal(ranked), F.get(overlap, F.lit(0)))
    return prefix & (F.size(block) >= template.least) & (n - place + 1 >= template.least) & (F.size(overlap) >= template.least)


def _blocks(text: Column, words_in, longest: int) -> Column:
    """array<struct<n, words>>: the words of each line (n: 0), and of each run of lines with n words, `longest` at most."""
    n_words = lambda x: F.regexp_count(x, F.lit(f"{LETTER_ANY_CASE}+")).cast("int")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(n_words(x).alias("n"), words_in(x).alias("words"))), lambda x: x["n"] > 0)

    def runs_of(lines: Column, size: int) -> Column:
        count = lambda i: sum((F.get(lines, i + j)["n"] for j in range(1, size)), F.get(lines, i)["n"])
        held = lambda i: F.array_distinct(F.concat(*[F.get(lines, i + j)["words"] for j in range(size)]))
        starts = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.size(lines) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, lambda i: count(i) <= longest), lambda i: F.struct(count(i).alias("n"), held(i).alias("words")))

    def runs(lines: Column) -> Column:
        alone = F.transform(lines, lambda x: F.struct(F.lit(0).alias("n"), x["words"].alias("words")))
        return F.filter(F.concat(alone, *[runs_of(lines, size) for size in range(2, RUN + 1)]), lambda b: F.size(b["words"]) > 0)

    return F.get(F.transform(F.array(lines), runs), F.lit(0))  # the lines are made once


def _largest_share(blocks: Column, template: Template, order: dict[str, int]) -> Column:
    """Null where no block matches."""
    held = F.filter(blocks, lambda b: (b["n"] <= template.longest) & _matches(b["words"], template, order))
    return F.array_max(F.transform(held, lambda b: F.size(F.array_intersect(b["words"], _literal(template.words))) / len(template.words)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """A row a document: numbers of words and phrase places, first and last place, labels, and the largest
    share of a template that a block holds, where it reaches the template's threshold (else 0)."""
    known = templates(threshold)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = {w: k for k, w in enumerate(global_order(docs, ascii_lower(F.col("text")), known))}
    vocabulary = _literal(sorted(order))
    phrases, notices = [t for t in known if t.phrase], [t for t in known if not t.phrase]
    # A line that holds no prefix word of any template matches none; most lines go here, before any array is made.
    rare = sorted({w for t in known for w in sorted(t.words, key=order.__getitem__)[: len(t.words) - t.least + 1]})
    candidate = F.col("text").rlike(f"(?i)(?<!{LETTER_ANY_CASE})(?:{'|'.join(rare)})(?!{LETTER_ANY_CASE})")
    words_in = lambda x: F.array_intersect(F.regexp_extract_all(ascii_lower(x), F.lit(rf"{LETTER}+"), F.lit(0)), vocabulary)
    blocks = _blocks(F.col("text"), words_in, max(t.longest for t in notices))
    no_label = F.array().cast("array<string>")
    rows = docs.withColumn("candidate", candidate)
    rows = rows.withColumn("whole", F.when(F.col("candidate"), words_in(F.col("text")))).withColumn("blocks", F.when(F.col("candidate"), blocks))
    for k, t in enumerate(phrases):
        found = F.col("candidate") & _matches(F.col("whole"), t, order)
        rows = rows.withColumn(f"n{k}", F.when(found, F.regexp_count("text", F.lit(phrase_pattern(t.phrase)))).otherwise(0))
    before_first, before_last = [], []
    for k, t in enumerate(phrases):
        pattern = phrase_pattern(t.phrase)
        start = F.regexp_instr("text", F.lit(pattern))
        head = F.when(F.col(f"n{k}") > 0, F.substring(F.col("text"), F.lit(1), start - 1))
        tail = F.when(F.col(f"n{k}") > 0, F.regexp_extract("text", r"(?s)^(.*)" + pattern, 1))
        n_words = lambda x: F.regexp_count(x, F.lit(f"{LETTER_ANY_CASE}+")).cast("long")
        before_first.append(n_words(head))
        before_last.append(n_words(tail))
    share = F.lit(0.0)
    labels = [F.when(F.col(f"n{k}") > 0, F.lit(t.label)) for k, t in enumerate(phrases)]
    for k, t in enumerate(phrases):
        share = F.greatest(share, F.when(F.col(f"n{k}") > 0, 1.0).otherwise(0.0))
    for t in notices:
        most = _largest_share(F.col("blocks"), t, order)
        rows = rows.withColumn(f"share_{len(labels)}", F.when(F.col("candidate"), most))
        share = F.greatest(share, F.coalesce(F.col(f"share_{len(labels)}"), F.lit(0.0)))
        labels.append(F.when(F.col(f"share_{len(labels)}").isNotNull(), F.lit(t.label)))
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(F.array_compact(x))), ",")
    return rows.select(
        "doc_id",
        F.regexp_count("text", F.lit(f"{LETTER_ANY_CASE}+")).cast("long").alias("n_words"),
        sum((F.col(f"n{k}") for k in range(len(phrases))), F.lit(0)).cast("long").alias("n_base"),
        F.least(*before_first).alias("first_word"),
        F.greatest(*before_last).alias("last_word"),
        joined(F.array(*labels[: len(phrases)])).alias("base_labels"),
        joined(F.array(*labels)).alias("labels"),
        share.cast("double").alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle_sql(threshold: float = 0.8) -> str:
    """The definition, without filters: places by list comparison, shares by counting every line's words."""
    letter = r"[0-9a-z\x{80}-\x{10FFFF}]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    places, marks, shares = [], [], []
    for t in templates(threshold):
        if t.phrase:
            own = t.phrase.split()
            places.append(f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(own) - 1}] = {listed(own)})")
        else:
            fits = f"(b.k = 1 OR len(b.l) <= {t.longest}) AND len(list_intersect(b.l, {listed(t.words)})) >= {t.least}"
            shares.append((t.label, f"list_max(list_transform(blocks, lambda b: CASE WHEN {fits} THEN len(list_intersect(b.l, {listed(t.words)})) / {len(t.words)}.0 ELSE 0 END))"))
    labels = list(PHRASES.values())
    marks = [f"CASE WHEN len(p{k}) > 0 THEN '{x}' END" for k, x in enumerate(labels)]
    notes = [f"CASE WHEN s{k} > 0 THEN '{x}' END" for k, (x, _) in enumerate(shares)]
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(x)}], lambda v: v IS NOT NULL))), ','), '')"
    every = f"flatten([{', '.join(f'p{k}' for k in range(len(labels)))}])"
    best = ", ".join([f"CASE WHEN len(p{k}) > 0 THEN 1.0 ELSE 0.0 END" for k in range(len(labels))] + [f"coalesce(s{k}, 0)" for k in range(len(shares))])
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all({lower}, '{letter}') AS w,
    list_filter(list_transform(string_split({lower}, chr(10)), lambda l: regexp_extract_all(l, '{letter}')), lambda l: len(l) > 0) AS lines FROM documents),
b AS (SELECT *, flatten(list_transform(range(1, {RUN} + 1), lambda k: list_transform(range(1, len(lines) - k + 2), lambda i: {{'k': k, 'l': flatten(lines[i:i + k - 1])}}))) AS blocks FROM t),
p AS (SELECT *, {', '.join(f'{x} AS p{k}' for k, x in enumerate(places))}, {', '.join(f'{x} AS s{k}' for k, (_, x) in enumerate(shares))} FROM b)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base,
  CAST(list_min({every}) - 1 AS BIGINT) AS first_word, CAST(list_max({every}) - 1 AS BIGINT) AS last_word,
  {joined(marks)} AS base_labels, {joined(marks + notes)} AS labels, CAST(greatest({best}) AS DOUBLE) AS score
FROM p
"""
