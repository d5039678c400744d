"""Benchmark decontamination: a containment search for short test items inside long documents.

Items are partitioned by size, the number n of their distinct shingles. Partition s holds the sizes for which n - ceil(t n) + 1 = s (at
t = 0.8: 1 to 4, 5 to 9, 10 to 14, ...), and its items' MinHash signatures are their s smallest shingle hashes. A document that contains
an item holds at least ceil(t n) of its shingles, so it misses at most s - 1 and holds one of the signature: every partition has full
recall. A document with fewer words than the partition's smallest item needs shingles isn't searched for in it. Documents have
no sketch, all their shingles are looked up, so their length costs no recall; one join serves all partitions. Candidates are verified by
counting shared shingles as text.

Words are runs of letters (ASCII or beyond) and digits, in lower case; an item of fewer words than a shingle
is one shingle of them all.

Defined results: items and documents without words match nothing; repeated rows and rows that share an id
count as one document or item; `contaminated` doesn't search rows without an id; `decontaminate` decides by text,
whatever the ids, and keeps rows without text; other columns are not read here, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, table, written

LETTERS = r"[0-9a-z\x{80}-\x{10FFFF}]+"
def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def _windows(words: Column, k: int, made, kind: str) -> Column:
    every = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: made([F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, every).otherwise(F.array().cast(f"array<{kind}>"))


def shingle_keys(words: Column, sizes: list[int]) -> Column:
    return F.concat(*[_windows(words, k, lambda w: F.xxhash64(*w), "bigint") for k in sizes])


def shingle_texts(words: Column, sizes: list[int]) -> Column:
    return F.concat(*[_windows(words, k, lambda w: F.concat_ws(" ", *w), "string") for k in sizes])


def item_shingles(items: DataFrame, item_id: str, text: str, n: int) -> tuple[DataFrame, list[int]]:
    """(item_id, k, shingle): each item's distinct shingles, and the shingle lengths that occur."""
    worded = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words_of(F.col(text).cast("string")).alias("w")).where(F.size("w") > 0)
    worded = worded.withColumn("k", F.least(F.size("w"), F.lit(n)))
    of = F.coalesce(*[F.when(F.col("k") == k, shingle_texts(F.col("w"), [k])) for k in range(1, n + 1)])
    shingles = written(worded.select("item_id", "k", F.explode(of).alias("shingle")).distinct(), "item-shingles")
    return shingles, sorted(r[0] for r in shingles.select("k").distinct().collect())  # n values at most


def signatures(shingles: DataFrame, threshold: float) -> DataFrame:
    """(key, item_id, least): the smallest hashes of each item, as many as its size partition's signatures have, and the fewest
    shingles that an item of the partition needs."""
    # The shingle's words are hashed one by one, as in the documents.
    w = F.split("shingle", " ")
    key = F.coalesce(*[F.when(F.size(w) == k, F.xxhash64(*[F.get(w, F.lit(j)) for j in range(k)])) for k in range(1, 6)])
    sized = shingles.withColumn("key", key).groupBy("item_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    needed = F.ceil(F.size("keys") * threshold - 1e-9).cast("int")
    parted = written(sized.select("item_id", "keys", needed.alias("needed"), (F.size("keys") - needed + 1).alias("part")), "item-parts")
    bounds = parted.groupBy("part").agg(F.min("needed").alias("least"))
    return parted.join(bounds, "part").select("item_id", "least", F.explode(F.slice("keys", F.lit(1), F.col("part"))).alias("key"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_held, containment) of each document that contains an item."""
    if not 1 <= n <= 5:
        raise ValueError("shingles have 1 to 5 words")
    shingles, sizes = item_shingles(items, item_id, item_text, n)
    spark = docs.sparkSession
    if not sizes:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {dict(items.dtypes)[item_id]}, n_shingles long, n_held long, containment double")
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), words_of(F.col(text).cast("string")).alias("w"))
    signed = broadcast_if_small(signatures(shingles, threshold), F.lit(24))
    keyed = docs.select("doc_id", F.size("w").alias("n_words"), F.explode(shingle_keys(F.col("w"), sizes)).alias("key"))
    hits = keyed.join(signed, "key").where(F.col("n_words") >= F.col("least"))
    candidates = written(hits.select("doc_id", "item_id").distinct(), "leak-candidates")
    found = broadcast_if_small(candidates.select("doc_id").distinct(), F.lit(16))
    held = docs.join(found, "doc_id", "left_semi").select("doc_id", F.explode(shingle_texts(F.col("w"), sizes)).alias("shingle"))
    held = held.join(broadcast_if_small(shingles.select("item_id", "shingle"), F.octet_length("shingle") + 24), "shingle").select("doc_id", "item_id", "shingle").distinct()
    counted = held.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_held"))
    totals = shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    return (
        counted.join(candidates, ["doc_id", "item_id"], "left_semi")
        .join(totals, "item_id")
        .where(F.col("n_held") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
        .select("doc_id", "item_id", "n_shingles", "n_held", (F.col("n_held") / F.col("n_shingles")).alias("containment"))
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops the documents whose text contains a benchmark item. A text is known by its 128-bit digest, so rows without
    an id are searched too, and a clean text doesn't go because another row has its id."""
    digest = "_" + max(docs.columns, key=len)  # no column has that name
    keyed = docs.withColumn(digest, F.unhex(F.md5("text")))
    leaked = contaminated(keyed, table(spark, sf_dir, "benchmark"), doc_id=digest).select(F.col("doc_id").alias(digest)).distinct()
    return keyed.join(broadcast_if_small(written(leaked, "leaked"), F.lit(32)), digest, "left_anti").select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every document's shingles against every item's.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS shingle FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
short AS (SELECT DISTINCT item_id, len(w) AS k FROM i WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT 5 AS k UNION SELECT k FROM short),
h AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS shingle FROM d, sizes WHERE len(w) >= k),
c AS (SELECT doc_id, item_id, count(*) AS n_held FROM h JOIN s USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_held, n_held / n_shingles AS containment
FROM c JOIN n USING (item_id) WHERE n_held >= ceil(0.8 * n_shingles - 1e-9)
"""
