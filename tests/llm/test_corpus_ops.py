"""N-gram join, decontamination, nearest neighbours, LM scores and the pipeline: brute force and edge rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sijill.llm import decontaminate, lm_score, nearest, ngram_join, pieces
from sijill.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def copies(seed, groups=12, members=6, changes=3, words=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    line = [word() for _ in range(12)]
    out = []
    for _ in range(groups):
        base = line * (rng.random() < 0.5) + [word() for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own).upper() if rng.random() < 0.2 else "\n".join(own))
    rng.shuffle(out)
    return [None, "", "  \n ", "one", "ONE", "one two", "one two three", "One two\tthree", *out, out[0]]


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(texts, n, percent):
    sets, label = [shingles(t, n) for t in texts], list(range(len(texts)))
    changed = True
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return [len(s) for s in sets], label


@pytest.mark.parametrize(("n", "percent", "cap"), [(3, 90, 32), (5, 80, 32), (3, 70, 3), (2, 60, 2)])
def test_ngram_join_matches_brute_force(spark, monkeypatch, n, percent, cap):
    monkeypatch.setattr(ngram_join, "CAP", cap)
    monkeypatch.setattr(ngram_join, "LEAST_FRAGMENTS", 4)
    texts = copies(n + percent)
    rows = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, component_id int").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(rows, n=n, percent=percent).collect()}
    sizes, labels = brute_components(texts, n, percent)
    assert found == {k: (sizes[k], labels[k]) for k in range(len(texts))}


@pytest.mark.parametrize(("percent", "pairs"), [(90, 64), (85, 4), (75, 0), (60, 1)])
def test_hot_bucket_meets_its_pivot(spark, monkeypatch, percent, pairs):
    """Hundreds of texts of one base: by many edits unlike each other and the base, or in families of few edits."""
    monkeypatch.setattr(ngram_join, "LEAST_FRAGMENTS", 4)
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    rng = random.Random(percent)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(base)]
    for family in range(12):
        own = list(base)
        for k in rng.sample(range(80), rng.randint(1, 9)):
            own[k] = f"f{family}x{rng.randint(0, 3)}"
        own += [f"f{family}tail{k}" for k in range(rng.randint(0, 20))]
        for member in range(15):
            text = list(own)
            for k in rng.sample(range(80), rng.randint(0, 3)):
                text[k] = f"m{rng.randint(0, 40)}"
            texts.append(" ".join(text[: len(text) - rng.randint(0, 6)]))
    for k in range(150):
        text = list(base)
        for j in rng.sample(range(80), 8):
            text[j] = f"r{k}x{j}"
        texts.append(" ".join(text))
    met = []
    monkeypatch.setattr(ngram_join, "met_pivots", lambda b, f=ngram_join.met_pivots: met.append(f(b)) or met[-1])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(rows, percent=percent).collect()}
    sizes, labels = brute_components(texts, 3, percent)
    assert found == {k: (sizes[k], labels[k]) for k in range(len(texts))}
    assert sum(b.count() for b in met) < 0.25 * len(texts) ** 2 / 2


def test_far_copies_of_a_text_need_no_rounds(spark, monkeypatch):
    """Copies of one text, many of them too far from it to link: the rounds don't grow with their number."""
    monkeypatch.setattr(ngram_join, "LEAST_FRAGMENTS", 4)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)]
    for _ in range(420):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 5])):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], [f"e{rng.randint(0, 2)}"], [f"e{rng.randint(0, 900)}"]])
        texts.append(" ".join(text))
    met = []
    monkeypatch.setattr(ngram_join, "compared", lambda pairs, *rest, f=ngram_join.compared: met.append(pairs.count()) or f(pairs, *rest))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(rows, n=5, percent=80).collect()}
    sizes, labels = brute_components(texts, 5, 80)
    assert found == {k: (sizes[k], labels[k]) for k in range(len(texts))} and len(set(labels)) > 40
    assert len(met) == 2 and sum(met) <= 4 * len(texts)


def test_chance_meetings_are_not_compared(spark, monkeypatch):
    """Texts whose n-grams all occur in other texts by chance; only near copies are worth comparing."""
    monkeypatch.setattr(ngram_join, "LEAST_FRAGMENTS", 4)
    rng = random.Random(7)
    texts = [[f"w{rng.randint(0, 8)}" for _ in range(rng.randint(80, 160))] for _ in range(60)]
    for k in range(6):
        own = list(texts[k])
        own[rng.randrange(len(own))] = "w3"
        texts.append(own)
    met = []
    monkeypatch.setattr(ngram_join, "compared", lambda pairs, *rest, f=ngram_join.compared: met.append(pairs) or f(pairs, *rest))
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(rows).collect()}
    sizes, labels = brute_components([" ".join(t) for t in texts], 3, 90)
    assert found == {k: (sizes[k], labels[k]) for k in range(len(texts))} and labels[60:] == list(range(6))
    assert sum(p.count() for p in met) <= 2 * 6


def test_long_words_of_few_letters_differ(spark):
    """Words whose polynomial hash modulo 2 ** 64 is the same for every base."""
    texts = []
    for bits in (10, 11, 12):
        word = "".join("ab"[k.bit_count() % 2] for k in range(1 << bits))
        texts += [word, word.translate(str.maketrans("ab", "ba"))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join(rows).collect()} == {k: k for k in range(6)}
    assert ngram_join.keep_one_of_each(spark, rows, "").count() == 6


def test_ngram_join_edges(spark):
    schema = "doc_id long, text string"
    assert ngram_join.join(spark.createDataFrame([], schema)).count() == 0
    lonely = spark.createDataFrame([(1, "a b c d"), (2, None)], schema)
    assert {r.doc_id: r.component_id for r in ngram_join.join(lonely).collect()} == {1: 1, 2: 2}
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z"), (None, "x y z")], schema)
    kept = ngram_join.keep_one_of_each(spark, rows, "")
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3]


def test_one_of_each_decides_by_row(spark):
    one, two, three, four = (" ".join(f"{c}{k}" for k in range(30)) for c in "abcd")
    rows = [(None, one), (None, two), (5, three), (5, four), (3, four), (7, one), (8, None), (8, "")]
    kept = ngram_join.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("None", two), ("5", three), ("3", four), ("7", one), ("8", ""), ("8", "")])


def test_chains_join(spark):
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(9):  # each near the next, the ends far apart
        base = [*base]
        base[k * 11] = f"x{k}"
        texts.append(" ".join(base))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in ngram_join.join(rows).collect()} == {0}


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (3, 30), (30, 40), (40, 41), (41, 42)]
    found = {r.v: r.label for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 30: 1, 40: 1, 41: 1, 42: 1, 9: 9, 10: 9}


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(12)] + ["Two words", "", None, "same same same same same same"]
    docs = [None, "", "two", "now two WORDS here", *(" ".join([word() for _ in range(50)] + (items[k % 12].split()[: rng.choice([4, 30, 40])]) + [word() for _ in range(200)]) for k in range(40)), items[3].upper() + "!"]
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(docs)] + [(3, docs[3], 1)], "doc_id long, text string, n_held int")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_shingles, r.n_held) for r in decontaminate.contaminated(d, i).collect()}
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = {}
    for a, t in enumerate(docs):
        for b, x in enumerate(items):
            w = words(x)
            own = grams(w, min(5, len(w))) if w else set()
            held = own & grams(words(t), min(5, len(w))) if w else set()
            if own and len(held) >= math.ceil(0.8 * len(own) - 1e-9):
                want[a, b] = (len(own), len(held))
    assert found == want and (3, 12) in found
    assert decontaminate.contaminated(d, i.where("false")).count() == decontaminate.contaminated(d.where("false"), i).count() == 0


def test_size_partitions(spark):
    """An item that a document holds at the threshold exactly is found in every partition, whichever shingles are missing."""
    rng = random.Random(8)
    items = {n: [f"w{n}x{j}" for j in range(n + 4)] for n in range(1, 31)}  # n distinct shingles each
    docs = []
    for n, words in items.items():
        spare = n - math.ceil(0.8 * n - 1e-9)
        for cut in {0, spare, rng.randint(0, spare)}:  # the first shingles go, the last ones, or some of both
            docs.append((len(docs), " ".join(["a", *words[cut : len(words) - (spare - cut)], "b"]), n))
    d, i = spark.createDataFrame(docs, "doc_id long, text string, n int"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id int, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, i).collect()}
    assert found == {(k, n) for k, _, n in docs}
    parts = {r.item_id: r.n for r in decontaminate.signatures(decontaminate.item_shingles(i, "item_id", "text", 5)[0], 0.8).groupBy("item_id").count().withColumnRenamed("count", "n").collect()}
    assert parts == {n: n // 5 + 1 for n in items}


def test_decontamination_decides_by_text(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = "so: One two three four five six seven!"
    rows = [(None, leak, "a"), (None, "clean", "b"), (7, leak, "c"), (7, "clean too", "d"), (8, None, "e"), (None, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    kept = decontaminate.decontaminate(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == ["b", "d", "e", "f"]
    assert decontaminate.decontaminate(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 24))).astype(np.float32)
    x[100:140] = x[7]
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(x)] + [(5000, None, "c"), (5100, [0.0] * 24, "c"), (5200, [float("nan")] * 24, "c"), (5300, [1.0] * 23 + [None], "c"), (5400, [1.0], "c"), (11, (x[11] + 100).tolist(), "c"), (9000, x[207].tolist(), "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = nearest.nearest(vectors, F.col("vec_id") % 100 == 7).toPandas()
    x = x.astype(np.float64)
    hits = 0
    for q in range(7, 3000, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        want = np.lexsort((np.arange(3000), far))[:10]
        own = found[found.query_id == q].sort_values("rank")
        own = own[own.vec_id < 3000] if q == 207 else own
        assert q == 207 or own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, far[own.vec_id], atol=1e-12)
        assert list(zip(own.score, own.vec_id)) == sorted(zip(own.score, own.vec_id))
        hits += len(set(want) & set(own.vec_id))
    assert hits >= 0.95 * 300 - 1 and found[found.query_id == 7].vec_id.tolist() == list(range(100, 110))
    # Two vectors of one id are two rows: each finds the other, and both are found.
    twins = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [0.0, 9.0])], "vec_id long, embedding array<double>")
    asked = nearest.nearest(twins, F.col("vec_id") == 1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 3)) for r in asked) == [(1, 1, 1, 0.5), (1, 1, 1, 0.5), (1, 2, 2, 8.559), (1, 2, 2, 9.055)]
    few = vectors.where("vec_id in (7, 8, 9)")
    assert nearest.nearest(few, F.col("vec_id") == 7).count() == 2 and nearest.nearest(vectors.where("false"), F.lit(True)).count() == 0


def test_nearest_candidates_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 500)
    x = np.random.default_rng(6).standard_normal((6000, 32)).astype(np.float32)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(2)
    found = nearest.nearest(vectors, F.col("vec_id") % 100 == 0, rerank=24).toPandas()
    hits = 0
    for q in range(0, 6000, 100):
        far = ((x.astype(np.float64) - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(np.argsort(far)[:10]) & set(found[found.query_id == q].vec_id))
    assert hits >= 0.95 * 600


def test_lm_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 6)
    monkeypatch.setattr(lm_score, "STEPS", 60)
    rng = random.Random(9)
    docs = [None, "", "  ", "UNSEEN-WORD once", *(" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(1, 90))) for _ in range(60))]
    rows = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(docs)] + [(5, docs[5], "clash")], "doc_id long, text string, score string")
    found = lm_score.score(rows).toPandas()
    tokens = [[*WORD.findall((t or "").translate(LOW)), None] for t in docs]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(docs))]
    counts = collections.Counter(t for k in [*range(len(docs)), 5] if not held[k] for t in tokens[k])
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(docs) + 1
    for r in found.itertuples():
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), rel=1e-12)
        assert math.isfinite(r.score) and r.score < 0
    assert lm_score.score(rows.where("false")).count() == 0


def test_lm_learns_from_all_training_texts(spark, monkeypatch):
    """A first text longer than all others together, and cycles of words in the many that follow."""
    texts = ["alpha beta " * 300_000, *("gamma delta sigma omega " * 20 for _ in range(2300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    v = pieces.load()
    words = [lm_score.subwords(lm_score.words_of(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0], v) for x in texts[:2]]
    training = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 7 != 2]
    lengths = [300_000 * len(words[0][0]) + 1 if k == 0 else 20 * len(words[1][0]) + 1 for k in training]
    size = len(v.pieces) + 1
    rows = rows.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2).select("doc_id", "held_out", "text")
    made = written(lm_score.encoded(rows, ([], []), lm_score.places(np.ones(size)), 0.0, v), "encoded")
    counts = lm_score.summed_parts(made, size * (2 * (lm_score.OWN_CLASS + 1) + 1))
    wide = size * 2 * (lm_score.OWN_CLASS + 1)
    assert counts[:wide].sum() == 2 * sum(x - 1 for x in lengths) and counts[wide:].sum() == sum(lengths)
    learned = made.where("part is null and not held_out")
    n_windows = learned.agg(F.sum("n_windows")).first()[0]
    assert n_windows == sum(-(-x // (lm_score.WINDOW // 2)) for x in lengths)
    model = lm_score.untrained(counts[:wide], counts[wide:], lm_score.places(counts[wide:]), np.random.default_rng(0))
    ids, ends = lm_score.sequences(*lm_score.words_of(np.frombuffer(texts[1].encode(), np.uint8), np.array([0, len(texts[1])])), v)
    after = lm_score.trained(learned.select("ids"), n_windows, model)
    assert lm_score.log10_scores(after, ids, ends)[0] > 0.5 * lm_score.log10_scores(model, ids, ends)[0]


def plain_score(model, ids):
    """log10 probability of one sequence, id by id, without batches or windows of several targets."""
    w = {k: x.astype(np.float64) for k, x in model.weights.items()}
    half, total = lm_score.WINDOW // 2, 0.0
    for t, target in enumerate(ids):
        begin = t // half * half - half  # the window's first place
        seen = [(k - begin, model.start if k == 0 else int(ids[k - 1])) for k in range(max(0, begin), t + 1)]
        x = np.array([w["class"][model.class_of[i]] + w["id"][i] + w["place"][k] for k, i in seen])
        q, keys, values = x[-1] @ w["q"], x @ w["k"], x @ w["v"]
        a = np.exp(keys @ q / lm_score.WIDTH**0.5)
        h = x[-1] + (a / a.sum()) @ values @ w["o"]
        z = h + np.maximum(h @ w["up"] + w["up_bias"], 0) @ w["down"]
        logits = z @ w["out"] + w["out_bias"]
        total += logits[model.class_of[target]] - np.log(np.exp(logits).sum()) + model.log_within[target]
    return total / math.log(10)


def test_lm_matches_plain_score():
    rng = np.random.default_rng(8)
    ends = np.array([0, 1, 17, 34, 50, 150, 151])
    ids = rng.integers(0, 20, 151)
    ids[ends[1:] - 1] = 20
    model = lm_score.train(ids, ends, np.bincount(ids, minlength=21), steps=30)
    found = lm_score.log10_scores(model, ids, ends)
    assert found == pytest.approx([plain_score(model, ids[a:b]) for a, b in zip(ends[:-1], ends[1:])], rel=1e-4)


def log_probabilities(f):
    return f["logits"] - f["lse"][:, :, None]


def test_windows_score_each_id_once_and_causally():
    counts = np.array([5, 4, 3, 2, 1, 1, 1, 1, 9])
    rng = np.random.default_rng(0)
    ends = np.array([0, 1, 18, 60, 160])
    ids = rng.integers(0, 8, 160)
    ids[ends[1:] - 1] = 8
    model = lm_score.train(ids, ends, counts, steps=5)
    inputs, targets, of = lm_score.windows(ids, ends, model)
    assert [targets[of == k][targets[of == k] >= 0].tolist() for k in range(4)] == [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    embedded = lm_score.embedding(model.weights, model.class_of)
    log_p = log_probabilities(lm_score.forward(model.weights, embedded, inputs, model.pad))
    assert np.allclose(np.exp(log_p).sum(axis=2), 1, atol=1e-4)
    assert np.allclose(np.bincount(model.class_of[:9], np.exp(model.log_within))[np.unique(model.class_of[:9])], 1)
    later = inputs.copy()
    later[:, -1] = 3
    assert np.allclose(log_probabilities(lm_score.forward(model.weights, embedded, later, model.pad))[:, :-1], log_p[:, :-1], atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(1)
    counts = np.arange(1, 12)
    ids = rng.integers(0, 10, 64)
    ids[-1] = 10
    model = lm_score.train(ids, np.array([0, 64]), counts, steps=3)
    inputs, targets, _ = lm_score.windows(ids, np.array([0, 64]), model)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss():
        f = log_probabilities(lm_score.forward(w, lm_score.embedding(w, model.class_of), inputs, model.pad))
        rows, cols = np.nonzero(targets >= 0)
        return -f[rows, cols, model.class_of[targets[rows, cols]]].mean()

    g = lm_score.backward(w, model.class_of, inputs, targets, lm_score.forward(w, lm_score.embedding(w, model.class_of), inputs, model.pad))
    for name in w:
        at = tuple(rng.integers(0, s) for s in w[name].shape) if name not in ("class", "id") else ((model.class_of if name == "class" else np.arange(99))[inputs[0, 20]], 3)
        w[name][at] += 1e-5
        up = loss()
        w[name][at] -= 2e-5
        assert g[name][at] == pytest.approx((up - loss()) / 2e-5, rel=2e-2, abs=1e-6), name
        w[name][at] += 1e-5


def test_model_learns():
    rng = np.random.default_rng(3)
    ends = np.arange(0, 8001, 80)
    ids = (np.arange(8000) * 3 + rng.integers(0, 2, 8000) * 0) % 7  # a cycle: the next id follows from the last
    ids[ends[1:] - 1] = 8
    counts = np.bincount(ids, minlength=9)
    model = lm_score.train(ids, ends, counts, steps=200)
    before = lm_score.train(ids, ends, counts, steps=0)
    assert lm_score.log10_scores(model, ids[:800], ends[:11]).sum() > 0.5 * lm_score.log10_scores(before, ids[:800], ends[:11]).sum()


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    clean = [" ".join(word() for _ in range(80)) for _ in range(30)]
    near = clean[0].split()
    near[40] = "changed"
    item = " ".join(word() for _ in range(20))
    texts = [*clean, clean[1], " ".join(near), "12345 !!", None, " ".join([word() for _ in range(60)] + item.split())]
    spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == list(range(30))
    v = pieces.load()
    for r in found:
        spelled = "".join(v.pieces[i] for i in r.ids).replace("▁", " ")
        assert spelled == " " + texts[r.doc_id] and r.n_tokens == len(r.ids)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_lm_trains_on_every_window(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "STEPS", 1)
    monkeypatch.setattr(lm_score, "BATCH", 8)
    size, n = 300, 200
    counts = np.ones(size)
    place = lm_score.places(counts)
    model = lm_score.untrained(np.zeros(size * 2 * (lm_score.OWN_CLASS + 1)), counts, place, np.random.default_rng(0))
    rows = spark.createDataFrame([(bytearray(np.array([k, 250, 251, size - 1], lm_score.kind_of(model)).tobytes()),) for k in range(n)], "ids binary").coalesce(1)
    after = lm_score.trained(rows, n, model)
    assert (np.abs(after.weights["id"][:n]).sum(axis=1) > 0).all()  # each of these ids stands in one window


def test_lm_steps_go_by_blocks(monkeypatch):
    """A step's gradients are the same by blocks as by all windows at once; held back, so are its scores."""
    rng = np.random.default_rng(2)
    ends = np.cumsum([0, *rng.integers(1, 60, 20)])
    ids = rng.integers(0, 20, ends[-1])
    ids[ends[1:] - 1] = 20
    model = lm_score.train(ids, ends, np.bincount(ids, minlength=21), steps=20)
    inputs, targets, of = lm_score.windows(ids, ends, model)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    once = lm_score.backward(w, model.class_of, inputs, targets, lm_score.forward(w, lm_score.embedding(w, model.class_of), inputs, model.pad))
    scores = lm_score.log10_scores(model, ids, ends)
    monkeypatch.setattr(lm_score, "BLOCK", 7)
    parts = lm_score.backward(w, model.class_of, inputs, targets, pad=model.pad)
    assert once.keys() == parts.keys() == w.keys()
    for name in w:
        assert np.allclose(once[name], parts[name], rtol=1e-9, atol=1e-12), name
    assert lm_score.log10_scores(model, ids, ends) == pytest.approx(scores, rel=1e-5)
    half = [lm_score.windows(ids, ends, model, slice(k, None, 2)) for k in (0, 1)]
    assert all((whole[k::2] == part[k2]).all() for k2, whole in enumerate((inputs, targets, of)) for k, part in enumerate(half))


def test_lm_scores_beyond_bound_are_held():
    rng = np.random.default_rng(4)
    ids = np.append(rng.integers(0, 8, 63), 8)
    model = lm_score.train(ids, np.array([0, 64]), np.bincount(ids, minlength=9), steps=2)
    assert not lm_score.embedding(model.weights, model.class_of).far
    model.weights["q"] *= np.float32(1e4)
    assert lm_score.embedding(model.weights, model.class_of).far
    found = lm_score.log10_scores(model, ids, np.array([0, 64]))
    assert np.isfinite(found).all() and found[0] < 0
