"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

A document is the set of its word n-grams; two documents link when 100 |x & y| >= percent |x | y|. Documents
with equal sets form one class, and only classes are joined:

1. *Fragments.* The n-grams' order is cut into fragments, by the top of a key; each document's segment of a
   fragment goes there once, packed. A fragment has all occurrences of its n-grams, so it counts in how many
   classes each occurs, and returns only the n-grams of two classes or more. The global order is (min(classes,
   CAP), key), as one number: rarest first. An n-gram that is frequent within one task is known to be at CAP there,
   so the fragment gets a mark instead of its occurrences, and no fragment has an unbounded list.
2. *Prefix filter.* A linked class shares at least ceil(percent/100 * n) n-grams with others; classes with
   fewer shared n-grams go. Of the rest, the first n - ceil(percent/100 * n) + 1 n-grams of the order are the
   prefix: linked classes share one. Prefix n-grams make buckets.
3. *Pairs.* A bucket of few members, where all pairs are at most PAIRS times these, makes its pairs: those of sizes that can link, where
   behind the n-gram's places there are enough others (the first common n-gram of linked classes has such places), and
   where bitmaps of both classes' shared n-grams differ in no more bits than linked ones can. Of these pairs
   each class is compared with one first, and with the others if they lie in different components then.
   In other buckets the members meet one pivot, the class whose n-grams are the most frequent on average, so m members
   make m - 1 pairs. A pair's partial overlaps are counted segment by segment of the n-grams' order, and summed.
4. *Next buckets.* Members that all link with their pivot p are done. Else let x and y be two members that link, and
   o(x) the overlap that x needs at least with any member, by their sizes. If x and y share no n-gram that p lacks, then
   |x & p| >= |x & y| >= o(x), and so for y: they meet again in a bucket of (p, no n-gram), which holds the members with
   |x & p| >= o(x) and sizes that can link. Otherwise they share max(1, o(x) - |x & p|) n-grams that p lacks at least, and meet again in a bucket of
   (p, n-gram that p lacks), by the prefix of what they hold beyond p. What a group has in common stands in its pivot, and
   is gone in the next round. Pairs within a component can't change it, so buckets within one component go. In the
   others the pairs of different components meet by size and bitmap, within a task and without a row for each, and those that can
   link are compared. So the copies of one text that are too far from it, and the others, need no pivots of their own, of which
   there would be more the more copies there are. A bucket with more such pairs than PAIRS times the members, or with more than MINORS
   members outside its most frequent component, meets its pivot again, as in step 3. Pivots stand in one order of all classes and rise along the rounds, so these end.
5. *Components* of the links by label propagation with pointer jumping, in tables.

So the components are exact, the pairs are linear in the buckets, and nothing is capped. Links within a component aren't listed.

Keys are mixed from a word's 16 bytes, or from the BLAKE2 digest of a longer one. A class key has the set's size and 96 bits,
so of 10^11 classes two share a key with odds of 10^-7; an n-gram's number has 58 bits, so the overlap of a compared pair of 300 n-grams each
is off by one with odds of 10^-12.

Defined results: a document with fewer than n words has one n-gram, of all its words; without words (null,
empty, blank) it has none, and is its own component; repeated rows are rows of one class; ties do not arise;
other columns are not read, so clashing names do no harm. A null id stays a row, and never names a component
unless it stands alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, chunks, map_arrow, ship, table, text_buffers, words_of, written

#: N-grams of a fragment; more of them make more fragments.
FRAGMENT = 2_000_000
LEAST_FRAGMENTS = 48
#: Classes of an n-gram from which on the order takes it as frequent.
CAP = 32
CHUNK = 3 << 20
#: Segments of a class whose partial overlaps are counted apart.
SEGMENTS = 4
#: Pairs of a bucket for each of its members, up to which they are compared one by one.
PAIRS = 16
#: Members outside a bucket's most frequent component, up to which these meet all members by bitmap; rows of buckets in a task.
MINORS, DEALT = 16_384, 8_192
#: Longs of a bitmap of a class's shared n-grams.
BITS = 16
#: Bytes of a class key: the set's size, then the hash.
SIZE_BYTES, KEY_BYTES = 4, 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys for each word of the texts, A-Z in lower case, and the words' offsets by text. They are mixed from 16
    bytes: a word of up to 15 bytes and its length, or the digest of a longer one."""
    words, index, ends = words_of(raw, offsets)
    at = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
    length = np.diff(at)
    spelled = np.zeros((len(words), 16), np.uint8)
    for k in range(15):
        longer = np.flatnonzero(length > k)
        spelled[longer, k] = data[at[longer] + k]
    spelled[:, 15] = np.minimum(length, 15)
    for k in np.flatnonzero(length > 15):
        spelled[k, :15], spelled[k, 15] = np.frombuffer(hashlib.blake2b(data[at[k] : at[k + 1]].tobytes(), digest_size=15).digest(), np.uint8), 255
    low, high = spelled.view("<u8").astype(np.uint64).T
    first = mixed(low ^ mixed(high + np.uint64(0xD6E8FEB86659FD93)))
    second = mixed(high ^ mixed(first + low * np.uint64(0x9E3779B97F4A7C15)))
    return np.stack([first, second], axis=1)[index], ends


def combined(words: list[np.ndarray]) -> np.ndarray:
    """Two keys for each n-gram of words, one from each of the words' keys."""
    key = np.full(words[0].shape, len(words), dtype=np.uint64)
    for w in words:
        key = mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + w)
    return key


def ngram_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts as two keys, text by text; each text's number of them; and the texts' class keys."""
    rows = len(offsets) - 1
    words, ends = word_keys(raw, offsets)
    count = np.diff(ends)
    owner = np.repeat(np.arange(rows), count)
    first = np.flatnonzero(owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :])
    keys, own = [combined([words[first + j] for j in range(n)])], [owner[first]]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        keys.append(combined([words[ends[short] + j] for j in range(k)]))
        own.append(short)
    key, of = np.concatenate(keys), np.concatenate(own)
    # N-grams of a text that are equal stand together in the order of a key of both; one of each stays.
    both = mixed(key[:, 0] + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both)
    again = np.flatnonzero(both[order[1:]] == both[order[:-1]]) + 1
    fresh = np.ones(len(key), bool)
    fresh[order[again]] = False
    key, of = key[fresh], of[fresh]
    order = np.argsort(of, kind="stable") if (of[1:] < of[:-1]).any() else slice(None)  # short texts stand behind
    key, of = key[order], of[order]
    sizes = np.bincount(of, minlength=rows)
    total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(mixed(key ^ np.uint64(0xA0761D6478BD642F)), axis=0)])
    at = np.cumsum(sizes)
    sums = mixed(total[at] - total[at - sizes])
    classes = np.empty((rows, KEY_BYTES), np.uint8)
    classes[:, :SIZE_BYTES] = sizes.astype(">u4").view(np.uint8).reshape(rows, SIZE_BYTES)
    classes[:, SIZE_BYTES:] = sums.astype("<u8").view(np.uint8).reshape(rows, 16)[:, : KEY_BYTES - SIZE_BYTES]
    return key, sizes, classes


def size_of(class_key: Column) -> Column:
    """The number of n-grams of a class; keys stand in the order of these."""
    return F.conv(F.hex(F.substring(class_key, 1, SIZE_BYTES)), 16, 10).cast("long")


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """ends: n + 1 places in data, in its rows."""
    width = data.itemsize * math.prod(data.shape[1:])
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def class_rows(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, class_key): a row a document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("class_key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                _, sizes, classes = ngram_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), _binary(classes, np.arange(b - a + 1))], names=schema.names)

    return map_arrow(docs, run, schema)


#: part: a fragment, or one that only passes on; keys, counts: of classes; grams: 8 bytes each (tokens where passed on);
#: frequent: 8 bytes each, at CAP in the task.
PACKED = "part long, passed boolean, keys binary, counts binary, grams binary, frequent binary"
ENTRIES = "class_key binary, m int, tokens array<long>"


def _packed(part: np.ndarray, of: np.ndarray, grams: np.ndarray, classes: np.ndarray, passed: bool) -> pa.RecordBatch:
    """A row for each part; part and of: sorted."""
    new_part = np.ones(len(part), bool)
    new_part[1:] = part[1:] != part[:-1]
    new = new_part.copy()
    new[1:] |= of[1:] != of[:-1]
    starts, heads = np.flatnonzero(new), np.flatnonzero(new_part)
    counts = np.diff(np.append(starts, len(part))).astype("<u4")
    ends = np.append(np.searchsorted(starts, heads), len(starts))
    none = np.zeros(len(heads) + 1, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(part[heads].astype(np.int64)), pa.array(np.full(len(heads), passed)), _binary(classes[of[starts]], ends), _binary(counts, ends), _binary(grams, np.append(heads, len(part))), _binary(grams[:0], none)],
        names=["part", "passed", "keys", "counts", "grams", "frequent"],
    )


def segments(docs: DataFrame, text: str, n: int, fragments: int, cap: int) -> DataFrame:
    """The classes' segments, packed by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for a, b in chunks(offsets, CHUNK):
                key, sizes, classes = ngram_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                if not len(key):
                    continue
                of = np.repeat(np.arange(b - a), sizes)
                keep = np.zeros(b - a, bool)
                keep[np.unique(classes.view(f"S{KEY_BYTES}").ravel(), return_index=True)[1]] = True  # one of each class
                key, of = key[keep[of]], of[keep[of]]
                order = np.argsort(key[:, 0])
                key, of = key[order], of[order]
                edges = np.flatnonzero(np.concatenate([[True], key[1:, 0] != key[:-1, 0], [True]]))
                many = np.diff(edges) >= cap
                often = np.repeat(many, np.diff(edges))
                part = ((key[:, 0] >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
                rare = np.flatnonzero(~often)
                rare = rare[np.argsort(part[rare] * (b - a) + of[rare])]
                if len(rare):
                    yield _packed(part[rare], of[rare], key[rare, 1], classes, False)
                known = np.flatnonzero(often)
                if len(known):
                    heads = edges[:-1][many]
                    at = np.append(np.flatnonzero(np.diff(part[heads], prepend=-1)), len(heads))
                    none = np.zeros(len(at), np.int64)
                    blank = [_binary(key[:0, 1], none)] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(part[heads[at[:-1]]]), pa.array(np.zeros(len(at) - 1, bool)), *blank, _binary(key[heads, 1], at)], names=["part", "passed", "keys", "counts", "grams", "frequent"])
                    known = known[np.argsort(of[known], kind="stable")]
                    # Their number is known: a part to pass them on, by the class.
                    to = (classes[of[known], -1].astype(np.int64) * 256 + classes[of[known], -2]) % fragments
                    known, to = known[np.argsort(to, kind="stable")], np.sort(to, kind="stable")
                    yield _packed(to, of[known], _token(key[known, 1], np.full(len(known), cap)), classes, True)

    return map_arrow(docs.select(F.col(text).cast("string")), run, PACKED)


def _token(key: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """An n-gram's place in the global order, one number: in how many classes it occurs (to CAP), then 58 bits of its key."""
    return (key >> np.uint64(6) | (seen.astype(np.uint64) - np.uint64(1)) << np.uint64(58)).view(np.int64)


def _entries(keys: np.ndarray, of: np.ndarray, tokens: np.ndarray) -> pa.Table:
    """of: sorted places in keys."""
    rows, counts = np.unique(of, return_counts=True)
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.table({"class_key": _binary(keys[rows], np.arange(len(rows) + 1)), "m": pa.array(counts.astype(np.int32)), "tokens": pa.ListArray.from_arrays(ends, pa.array(tokens))})


def shared_ngrams(key: tuple, group: pa.Table, cap: int) -> pa.Table:
    """Of one fragment: each class's n-grams that stand in another class too."""
    passed = key[1].as_py()
    blob = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
    keys, counts = blob("keys", np.uint8).reshape(-1, KEY_BYTES), blob("counts", "<u4")
    of = np.repeat(np.arange(len(keys)), counts)
    if passed:
        return _entries(keys, of, blob("grams", "<i8"))
    grams, frequent = blob("grams", "<u8"), np.unique(blob("frequent", "<u8"))
    # The copies in other tasks send the same segment again, but for what was frequent in one of the tasks.
    halves = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 0], halves[:, 1]))
    place = np.zeros(len(keys), np.int64)
    place[order[1:]] = np.cumsum((halves[order[1:]] != halves[order[:-1]]).any(axis=1))
    order = np.lexsort((place[of], grams))
    grams, of, whose = grams[order], of[order], place[of][order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (whose[1:] != whose[:-1])
    grams, of = grams[fresh], of[fresh]
    edges = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]])) if len(grams) else np.zeros(1, np.int64)
    seen = np.repeat(np.minimum(np.diff(edges), cap), np.diff(edges))
    if len(frequent) and len(grams):
        seen = np.where(frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams, cap, seen)
    kept = np.flatnonzero(seen > 1)
    kept = kept[np.argsort(of[kept], kind="stable")]
    return _entries(keys, of[kept], _token(grams[kept], seen[kept]))


def least_shared(n: Column, percent: int) -> Column:
    """ceil(percent n / 100)."""
    return F.floor((n * percent + 99) / 100).cast("long")


def ordered_classes(entries: DataFrame, percent: int) -> DataFrame:
    """(class_key, rank, tokens): classes that share enough n-grams to link, their shared n-grams in the global order. rank: less, the
    more frequent its n-grams are on average."""
    enough = entries.groupBy("class_key").agg(F.sum("m").alias("m")).where(F.col("m") >= least_shared(size_of(F.col("class_key")), percent))
    enough = broadcast_if_small(written(enough.select("class_key"), "enough"), F.lit(32))
    # One document's n-grams: the group is no larger than the document.
    whole = entries.join(enough, "class_key", "left_semi").groupBy("class_key").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    whole = whole.select("class_key", F.sort_array(F.array_distinct("tokens")).alias("tokens"))
    more = F.aggregate("tokens", F.lit(0).cast("long"), lambda total, t: total + F.shiftright(t, 58))
    return whole.select("class_key", F.floor(-1000 * more / size_of(F.col("class_key"))).cast("long").alias("rank"), "tokens")


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The n-grams that linked classes of n and m share at least."""
    return F.floor(((n + m) * percent + 99 + percent) / (100 + percent)).cast("long")


def first_buckets(classes: DataFrame, percent: int) -> DataFrame:
    """(p, token, class_key, rank, left): the shared n-grams within each class's prefix; p: empty, of no pivot; left: the class's n-grams from
    this one on, in the order."""
    n = size_of(F.col("class_key"))
    prefix, alone = n - least_shared(n, percent) + 1, n - F.size("tokens")
    held = F.slice("tokens", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int"))
    placed = classes.select("class_key", "rank", F.size("tokens").alias("shared"), F.posexplode(held).alias("at", "token"))
    return placed.select(F.lit(b"").alias("p"), "token", "class_key", "rank", (F.col("shared") - F.col("at")).alias("left"))


def by_size(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets of several members: those of few, and the others."""
    sizes = buckets.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    sized = buckets.join(sizes.where("n > 1"), "token")
    few = F.col("n") - 1 <= 2 * PAIRS
    return sized.where(few), sized.where(~few)


def possible(few: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(q, x): of small buckets, the pairs that can link by size, by the place of their n-gram, and by their bitmaps."""
    one, other = few.select("token", F.col("class_key").alias("q"), F.col("left").alias("left_q")), few.select("token", F.col("class_key").alias("x"), F.col("left").alias("left_x"))
    n_q, n_x = size_of(F.col("q")), size_of(F.col("x"))
    placed = F.least("left_q", "left_x") >= least_overlap(n_q, n_x, percent)
    met = one.join(other, "token").where((F.col("q") < F.col("x")) & (n_q * 100 >= n_x * percent) & placed).select("q", "x").distinct()
    return alike(written(met, "possible"), classes, percent)


def with_bits(classes: DataFrame) -> DataFrame:
    """classes with `bits`: of each place in a bitmap, whether an odd number of the shared n-grams lies there."""
    schema = T.StructType([*classes.schema.fields, T.StructField("bits", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rows = batch.column("tokens"), len(batch)
            of, places = np.repeat(np.arange(rows), tokens.value_lengths().to_numpy()), tokens.flatten().to_numpy() & (64 * BITS - 1)
            odd = np.bincount(of * (64 * BITS) + places, minlength=rows * 64 * BITS) & 1
            bits = np.packbits(odd.astype(bool)).view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BITS), pa.array(bits))], names=schema.names)

    return map_arrow(classes, run, schema)


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (q, x) whose bitmaps allow for a link: of shared n-grams that one of the two holds alone, there are as many as differing bits at least."""
    own = classes.select("class_key", F.size("tokens").alias("shared"), "bits")
    own = broadcast_if_small(own, F.lit(16 * BITS))
    of = lambda c: own.select(F.col("class_key").alias(c), F.col("shared").alias(f"{c}_shared"), F.col("bits").alias(f"{c}_bits"))
    apart = sum((F.bit_count(F.col("q_bits")[k].bitwiseXOR(F.col("x_bits")[k])) for k in range(BITS)), F.lit(0))
    needed = least_overlap(size_of(F.col("q")), size_of(F.col("x")), percent)
    return pairs.join(of("q"), "q").join(of("x"), "x").where(F.col("q_shared") + F.col("x_shared") - apart >= 2 * needed).select("q", "x")


def met_pivots(buckets: DataFrame) -> DataFrame:
    """(q, x, least): the members of buckets, their bucket's pivot, and the size of its smallest member."""
    pivots = buckets.groupBy("p", "token").agg(F.min(F.struct("rank", "class_key"))["class_key"].alias("q"), F.min("class_key").alias("smallest"), F.max("class_key").alias("largest"))
    pivots = pivots.where(F.col("smallest") != F.col("largest")).select("p", "token", "q", size_of(F.col("smallest")).alias("least"))
    return buckets.join(pivots, ["p", "token"]).where(F.col("class_key") != F.col("q")).groupBy("q", F.col("class_key").alias("x")).agg(F.min("least").alias("least"))


def compared(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (q, x, least), least null but for pivots q, with `linked`, x's rank, whether q holds enough of x for a link, and the prefix
    of what x holds beyond q: partial overlaps by segment, summed by pair."""
    segment = lambda g: F.filter("tokens", lambda t: t.bitwiseAND(F.lit(SEGMENTS - 1)) == g)
    met = written(pairs.select(F.explode(F.array("q", "x")).alias("class_key")).distinct(), "met")
    cut = classes.join(broadcast_if_small(met, F.lit(32)), "class_key", "left_semi").select("class_key", "rank", F.size("tokens").alias("shared"), F.explode(F.array(*[F.struct(F.lit(g).alias("g"), segment(g).alias("tokens")) for g in range(SEGMENTS)])).alias("s")).select("class_key", "rank", "shared", "s.*")
    left, right = cut.select(F.col("class_key").alias("q"), "g", F.col("tokens").alias("tokens_q")), cut.select(F.col("class_key").alias("x"), "g", "rank", "shared", F.col("tokens").alias("tokens_x"))
    partial = pairs.join(right, "x").join(left, ["q", "g"]).select("q", "x", "least", "rank", "shared", F.size(F.array_intersect("tokens_x", "tokens_q")).alias("part"), F.array_except("tokens_x", "tokens_q").alias("rest"))
    summed = partial.groupBy("q", "x", "least", "rank", "shared").agg(F.sum("part").alias("overlap"), F.flatten(F.collect_list("rest")).alias("rest"))
    n_q, n, overlap = size_of(F.col("q")), size_of(F.col("x")), F.col("overlap")
    linked = overlap * 100 >= (n_q + n - overlap) * percent
    needed = least_overlap(n, F.greatest(F.col("least"), least_shared(n, percent)), percent)
    prefix = (n - overlap) - F.greatest(needed - overlap, F.lit(1)) + 1
    held = F.greatest(prefix - (n - F.col("shared")), F.lit(0)).cast("int")
    return summed.select("q", "x", F.col("least").isNotNull().alias("pivot"), "rank", linked.alias("linked"), (overlap >= needed).alias("enough"), F.slice(F.sort_array("rest"), F.lit(1), held).alias("beyond"))


def next_buckets(counted: DataFrame, percent: int) -> DataFrame:
    """Of pivots that don't link with all whom they met: their members, by the n-grams beyond the pivot. For no n-gram stands a number
    below 0, of a range of sizes: sizes that can link lie in one range or two next to each other, and a member stands in its own and the next."""
    counted = counted.where("pivot")
    apart = counted.where(~F.col("linked")).select("q").distinct()
    again = counted.join(broadcast_if_small(written(apart, "apart"), F.lit(32)), "q", "left_semi")
    span = F.floor(F.ln(size_of(F.col("x"))) / (max(math.log(100 / percent), 1e-6) * (1 + 1e-9))).cast("long")
    tokens = F.when(F.col("enough"), F.concat("beyond", F.array(-1 - span, -2 - span))).otherwise(F.col("beyond"))
    return again.select(F.col("q").alias("p"), F.explode(tokens).alias("token"), F.col("x").alias("class_key"), "rank")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): the smallest vertex that each vertex of links reaches. Labels spread over links and then jump to
    their label's label, so a star takes one round and a chain the logarithm of its length."""
    both = written(links.select(F.col(a).alias("v"), F.col(b).alias("u")).unionByName(links.select(F.col(b).alias("v"), F.col(a).alias("u"))).distinct(), "links")
    labels = written(both.groupBy("v").agg(F.least(F.min("u"), F.min("v")).alias("label")), "labels")
    while True:
        spread = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        near = labels.join(spread, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        after = written(near.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = after.select("v", "label")
        if after.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: only the components that the links touch are joined."""
    if labels is None:
        return components(links)
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"{c}_label"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"), F.col("a").alias("v"), F.col("b").alias("u"))
    between = written(between.where(F.col("a") != F.col("b")), "between")
    if between.isEmpty():
        return labels
    merged = components(between)
    fresh = between.select("v").unionByName(between.select(F.col("u").alias("v"))).distinct().join(labels.select("v"), "v", "left_anti").select("v", F.col("v").alias("label"))
    renamed = merged.select(F.col("v").alias("label"), F.col("label").alias("new"))
    return written(labels.unionByName(fresh).join(renamed, "label", "left").select("v", F.coalesce("new", "label").alias("label")), "labels")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (q, x) in different components."""
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"{c}_label"))
    named = pairs.join(of("q"), "q", "left").join(of("x"), "x", "left")
    return named.where(F.coalesce("q_label", "q") != F.coalesce("x_label", "x")).select("q", "x")


def several(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that lie in several components, with their label."""
    labelled = buckets.join(labels.select(F.col("v").alias("class_key"), "label"), "class_key", "left").withColumn("label", F.coalesce("label", "class_key"))
    labelled = written(labelled.distinct(), "labelled")
    split = labelled.groupBy("p", "token").agg(F.min("label").alias("smallest"), F.max("label").alias("largest")).where(F.col("smallest") != F.col("largest"))
    return written(labelled.join(split.select("p", "token"), ["p", "token"]), "several")


def next_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(q, x, least): of buckets in several components, the pairs to compare, or where these are many, the members with their pivot."""
    own = broadcast_if_small(classes.select("class_key", F.size("tokens").alias("shared"), "bits"), F.lit(16 * BITS))
    dealt = F.pmod(F.xxhash64("p", "token"), F.lit(max(1, members.count() // DEALT)))
    pairs, minors = PAIRS, MINORS
    return members.join(own, "class_key").groupBy(dealt).applyInArrow(lambda group: pairs_left(group, percent, pairs, minors), "q binary, x binary, least long")


def pairs_left(group: pa.Table, percent: int, pairs: int, minors: int) -> pa.Table:
    """next_pairs of the buckets of one task. Each member outside a bucket's most frequent component meets all members of other
    components by size and bitmap. If there are more than `minors` such members, or more than `pairs` pairs for each member are left, all meet the pivot."""
    column = lambda name: group.column(name).combine_chunks()
    keys = np.frombuffer(b"".join(group.column("class_key").to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
    size = np.ascontiguousarray(keys[:, :SIZE_BYTES]).view(">u4").ravel().astype(np.int64)
    place = np.unique(keys.view(f"S{KEY_BYTES}").ravel(), return_inverse=True)[1]
    token, rank, shared = (group.column(name).to_numpy().astype(np.int64) for name in ("token", "rank", "shared"))
    pivot, label = (column(name).dictionary_encode().indices.to_numpy() for name in ("p", "label"))
    bits = column("bits").flatten().to_numpy().reshape(-1, BITS).view(np.uint64)
    order = np.lexsort((place, rank, token, pivot))
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = (token[order[1:]] != token[order[:-1]]) | (pivot[order[1:]] != pivot[order[:-1]])
    heads = np.flatnonzero(new)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in zip(heads[:-1], heads[1:]):
        at = order[a:b]
        found = differing(label[at], size[at], shared[at], bits[at], percent, pairs * len(at), minors)
        if found is None:
            out.append((np.full(len(at) - 1, at[0]), at[1:], np.full(len(at) - 1, size[at].min())))
        else:
            one, other = at[found[0]], at[found[1]]
            swap = place[one] > place[other]
            out.append((np.where(swap, other, one), np.where(swap, one, other), np.full(len(one), -1)))
    q, x, least = (np.concatenate(part) for part in zip(*out))
    return pa.table({"q": _binary(keys[q], np.arange(len(q) + 1)), "x": _binary(keys[x], np.arange(len(x) + 1)), "least": pa.array(least, mask=least < 0)})


def differing(label: np.ndarray, size: np.ndarray, shared: np.ndarray, bits: np.ndarray, percent: int, most: int, minors: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs of a bucket's members in different components that can link by size and bitmap; None if more than `most`, or too many to look at."""
    own, inverse, counts = np.unique(label, return_inverse=True, return_counts=True)
    minor = inverse != counts.argmax()
    rest = np.flatnonzero(minor)
    if len(rest) > minors:
        return None
    by_word, every, found, total = np.ascontiguousarray(bits.T), np.arange(len(label)), [(rest[:0], rest[:0])], 0
    step = max(1, (1 << 18) // len(label))
    for a in range(0, len(rest), step):
        some = rest[a : a + step]
        apart = np.zeros((len(some), len(label)), np.uint16)
        for word in by_word:
            apart += np.bitwise_count(word[some][:, None] ^ word)
        one, other = np.nonzero(apart <= np.maximum(shared[some][:, None] + shared - 2 * (((size[some][:, None] + size) * percent + 99 + percent) // (100 + percent)), -1))
        one = some[one]
        able = (label[one] != label[other]) & (~minor[other] | (every[one] < every[other])) & (np.minimum(size[one], size[other]) * 100 >= np.maximum(size[one], size[other]) * percent)
        found.append((one[able], other[able]))
        total += int(able.sum())
        if total > most:
            return None
    return tuple(np.concatenate(part) for part in zip(*found))


def class_labels(entries: DataFrame, percent: int) -> DataFrame:
    """(v, label) of all classes that link with another one."""
    classes = written(with_bits(ordered_classes(entries, percent)), "classes")
    few, many = by_size(written(first_buckets(classes, percent), "buckets"))
    waiting = written(possible(few, classes, percent), "waiting")
    unbounded = F.lit(None).cast("long").alias("least")
    pairs = met_pivots(many).unionByName(waiting.groupBy("x").agg(F.min("q").alias("q")).select("q", "x", unbounded))
    pairs = written(pairs.groupBy("q", "x").agg(F.min("least").alias("least")), "pairs")
    labels = None
    while True:
        counted = written(compared(pairs, classes, percent), "compared")
        labels = joined(labels, counted.where("linked").select(F.col("q").alias("a"), F.col("x").alias("b")))
        members = several(next_buckets(counted, percent), labels)
        fresh = next_pairs(members, classes, percent)
        if waiting is not None:
            fresh, waiting = fresh.unionByName(apart(waiting, labels).join(pairs, ["q", "x"], "left_anti").select("q", "x", unbounded)), None
        pairs = written(fresh.groupBy("q", "x").agg(F.min("least").alias("least")), "pairs")
        if pairs.isEmpty():
            return labels


def _classes_of(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """class_rows of the documents, and (v, label) of all classes that link with another one."""
    rows = written(class_rows(docs, doc_id, text, n), "class-rows")
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    fragments = max(LEAST_FRAGMENTS, math.ceil(total / FRAGMENT))
    ship(docs.sparkSession)
    cap = CAP
    packed = segments(docs, text, n, fragments, cap).groupBy("part", "passed")
    entries = written(packed.applyInArrow(lambda key, group: shared_ngrams(key, group, cap), ENTRIES), "shared")
    return rows, class_labels(entries, percent)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row a document."""
    rows, labels = _classes_of(docs, doc_id, text, n, percent)
    worded = rows.where(F.col("n_shingles") > 0)
    named = worded.groupBy("class_key").agg(F.min("doc_id").alias("first_id"))
    named = named.join(labels.select(F.col("v").alias("class_key"), "label"), "class_key", "left").withColumn("label", F.coalesce("label", "class_key"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "label").select("class_key", "component_id")
    return (
        worded.join(named, "class_key")
        .select("doc_id", "n_shingles", "component_id")
        .unionByName(rows.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with `_row`, which tells its rows apart and is the same whenever they are read: the place in a file; where docs are no files,
    a number that is written."""
    try:
        return docs.withColumn("_row", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    except AnalysisException:
        return written(docs.withColumn("_row", F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))), "numbered")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of rows that share four fifths of their five-word n-grams, and of those they reach, the one with the
    smallest id stays (a null id last). Rows are told apart by their place: neither a null id nor one that different
    texts share joins them. Rows without words all stay."""
    own = numbered(docs)
    rows, labels = _classes_of(own.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("_row").alias("row")).alias("key"), "text"), "key", "text", 5, 80)
    named = rows.where(F.col("n_shingles") > 0).join(labels.select(F.col("v").alias("class_key"), "label"), "class_key", "left").withColumn("label", F.coalesce("label", "class_key"))
    first = written(named.groupBy("label").agg(F.min("doc_id").alias("first")), "first")
    gone = written(named.join(first, "label").where(F.col("doc_id.row") != F.col("first.row")).select(F.col("doc_id.row").alias("_row")), "gone")
    return own.join(broadcast_if_small(gone, F.octet_length("_row.file") + 24), "_row", "left_anti").select(*docs.columns)


#: Links from counted common n-grams, and components by reach.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS grams FROM d),
n AS (SELECT doc_id, len(grams) AS n FROM s),
e AS (SELECT doc_id, unnest(grams) AS gram FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 90 * (x.n + y.n - o.o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""
