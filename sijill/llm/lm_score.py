"""Scores of texts under a causal self-attention model of subword ids, and a word-count base.

A text is its words, A-Z in lower case, and one end mark; each word is a few subword ids (a blank and the
word, segmented once for each distinct word of a few MB). The model predicts the class of the next id from
the ids before it, and the id from its class: p(id | before) = p(class | before) p(id | class). Classes are
the most frequent ids, one each, and clusters of the others by their neighbours.

p(class | before) is one masked self-attention layer with a feed-forward layer, trained in numpy by Adam on windows of
all training texts, all of them: in ROUNDS rounds every task descends over a share of its texts' windows, and
the tasks' weights are averaged by their windows. (A corpus of fewer than STEPS batches is gone through repeatedly.) The neighbours that make the clusters, p(id | class) and the base are counted in all
training texts. Scoring cuts a text into windows of WINDOW ids that overlap by half; the attention is batched over windows
and masked, and each id is scored once, in the window where it stands in the second half, so with half a window before it at
least. The texts' ids are made once, and written.

The base of a text is the sum of log10((c + 1) / (N + V + 1)) over its words and its end: c how often the token
occurs in the training texts, N all their tokens, V their distinct ones. Words of large counts are looked up
in a table of at most FREQUENT words, sent to all workers; the rest are joined by word.

Defined results: a null, empty or blank text is its end mark alone; without training texts N and V are 0 and
the model is uniform over the ids; repeated rows are rows; a null id is a training row's; other columns are
not read, so clashing names do no harm. Texts are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from .common import chunks, crc_mod, map_arrow, table, text_buffers, words_of, written
from .sentencepieces import encode_words

CHUNK = 4 << 20
#: Bounds of what is sent to all workers: words, and bytes of a word.
FREQUENT, FREQUENT_BYTES = 200_000, 32
#: Windows of a task that trains, at least; rounds; and parts in which neighbours and weights are summed.
TASK_WINDOWS, ROUNDS, PARTS = 20_000, 2, 64
WINDOW, WIDTH, HIDDEN = 32, 16, 32
OWN_CLASS, CLUSTERS = 48, 16
STEPS, BATCH = 300, 256
#: Windows whose arrays a core's cache holds.
BLOCK = 64


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each word occurs; a row a word, a worker's chunks counted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for a, b in chunks(offsets, 2 * CHUNK):
                words, index, _ = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(words):
                    yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(np.bincount(index, minlength=len(words)))], names=["word", "n"])

    return map_arrow(docs.select(F.col(text).cast("string")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def subwords(words: pa.Array, vocabulary: pieces.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a blank and each word, one after another, and n + 1 offsets."""
    if not len(words):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), words.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    return encode_words(spaced, vocabulary)


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    class_of: np.ndarray  # (ids,)
    log_within: np.ndarray  # (ids,) log p(id | class)
    end: int
    start: int
    pad: int


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def places(counts: np.ndarray) -> np.ndarray:
    """Of each id, its place among the most frequent ones; OWN_CLASS for the others."""
    top = np.argsort(-counts, kind="stable")[:OWN_CLASS]
    place = np.full(len(counts), OWN_CLASS)
    place[top] = np.arange(len(top))
    return place


def neighbours(ids: np.ndarray, ends: np.ndarray, place: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """How often each id stands behind and before each of the most frequent ones, within a sequence; flat. among: the sequences counted."""
    wide = 2 * (OWN_CLASS + 1)
    inside = np.ones(max(0, len(ids) - 1), bool) if among is None else np.repeat(among, np.diff(ends))[:-1]
    inside[ends[1:-1] - 1] = False
    left, right = ids[:-1][inside], ids[1:][inside]
    return np.bincount(np.concatenate([right * wide + place[left], left * wide + OWN_CLASS + 1 + place[right]]), minlength=len(place) * wide)


def classes(beside: np.ndarray, place: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each id: the most frequent ids their own, the others by which of those stand beside them."""
    beside = beside.reshape(len(place), -1)
    x = _normal(np.sqrt(beside))
    seen = np.flatnonzero((beside.sum(axis=1) > 0) & (place == OWN_CLASS))
    of = rng.integers(0, CLUSTERS, len(place))  # ids that no training text has
    if len(seen) >= CLUSTERS:
        centres = x[rng.choice(seen, CLUSTERS, replace=False)]
        for _ in range(12):
            of[seen] = (x[seen] @ centres.T).argmax(axis=1)
            centres = _normal(np.stack([x[seen][of[seen] == c].sum(axis=0) if (of[seen] == c).any() else centres[c] for c in range(CLUSTERS)]))
    return np.where(place < OWN_CLASS, place, OWN_CLASS + of)


def windows(ids: np.ndarray, ends: np.ndarray, model: Model, among: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of id sequences (each with its end mark): inputs of each window, the ids to predict in its second half
    (-1: none), and the sequence; of the windows among. Before a sequence stands the start mark, and half a window of padding."""
    half, lengths = WINDOW // 2, np.diff(ends)
    count = -(-lengths // half)
    before = np.cumsum(count) - count
    of = np.repeat(np.arange(len(lengths)), count)
    # Rows of half a window: padding, the start mark and the ids of each sequence; a window is two rows.
    heads = before + 2 * np.arange(len(lengths))
    laid = np.full((count.sum() + 2 * len(lengths)) * half, model.pad, np.int64)
    laid[(heads + 1) * half] = model.start
    laid[np.repeat((heads + 1) * half + 1 - ends[:-1], lengths) + np.arange(len(ids))] = ids
    wanted = np.full(count.sum() * half, -1, np.int64)
    wanted[np.repeat(before * half - ends[:-1], lengths) + np.arange(len(ids))] = ids
    rows = np.arange(len(of)) + 2 * of
    laid, rows = laid.reshape(-1, half), rows[among]
    return np.concatenate([laid[rows], laid[rows + 1]], axis=1), wanted.reshape(-1, half)[among], of[among]


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w over the last axis, as one product of matrices."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


@dataclass
class Tables:
    """What all windows share. A place adds to an embedding, its query, key and value, as all are linear."""

    late: np.ndarray  # (ids, 2 WIDTH): the embedding and its query, scaled
    both: np.ndarray  # (ids, 2 WIDTH): the key, and the value as the output takes it
    late_place: np.ndarray
    both_place: np.ndarray
    query: np.ndarray  # matrices that lead from embeddings there
    pair: np.ndarray
    biases: tuple[np.ndarray, np.ndarray]  # a window's
    far: bool  # whether a score may lie beyond BOUND


def longest(x: np.ndarray) -> float:
    """The largest norm of a row."""
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))


def embedding(w: dict[str, np.ndarray], class_of: np.ndarray) -> Tables:
    half, x = WINDOW // 2, w["class"][class_of] + w["id"]
    query, pair = w["q"] * np.asarray(WIDTH**-0.5, x.dtype), np.concatenate([w["k"], w["v"] @ w["o"]], axis=1)
    late, both = np.concatenate([x, x @ query], axis=1), x @ pair
    late_place, both_place = np.concatenate([w["place"][half:], w["place"][half:] @ query], axis=1), w["place"] @ pair
    reach = (longest(late[:, WIDTH:]) + longest(late_place[:, WIDTH:])) * (longest(both[:, :WIDTH]) + longest(both_place[:, :WIDTH]))
    return Tables(late, both, late_place, both_place, query, pair, (np.tile(w["up_bias"], half), np.tile(w["out_bias"], half)), not reach < BOUND)


def total(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays, as a product."""
    return times(x, np.ones((x.shape[-1], 1), x.dtype))


def forward(w: dict[str, np.ndarray], tables: Tables, inputs: np.ndarray, pad: int, wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Everything that the backward pass needs, and for the second half of each window the classes' logits and the log of
    the sum of their exponents. Scores and logits are held to +-BOUND, which is far beyond what training reaches.
    wanted: places of the only logits to keep, if not all."""
    n = len(inputs)
    late = tables.late.take(inputs[:, WINDOW // 2 :], axis=0)
    late += tables.late_place
    both = tables.both.take(inputs, axis=0)
    both += tables.both_place
    q, k, v = late[..., WIDTH:], both[..., :WIDTH], both[..., WIDTH:]
    scores = q @ k.transpose(0, 2, 1)
    if tables.far:
        np.clip(scores, -BOUND, BOUND, out=scores)
    np.exp(scores, out=scores)
    scores *= SEEN
    padded = np.flatnonzero(inputs[:, 0] == pad)  # a window with padding behind the text has it after all its targets
    if len(padded):
        scores[padded] *= (inputs[padded] != pad)[:, None, :]
    share = 1 / total(scores)
    mixed = scores @ v
    mixed *= share
    h = mixed + late[..., :WIDTH]
    act = times(h, w["up"])
    rows = act.reshape(n, -1)
    rows += tables.biases[0]
    np.maximum(act, 0, out=act)
    z = times(act, w["down"])
    z += h
    logits = times(z, w["out"])
    rows = logits.reshape(n, -1)
    rows += tables.biases[1]
    np.clip(logits, -BOUND, BOUND, out=logits)
    hits = None if wanted is None else logits.reshape(-1).take(wanted)
    odds = np.exp(logits) if wanted is None else np.exp(logits, out=logits)
    sums = total(odds)
    return {"q": q, "k": k, "v": v, "a": scores, "share": share, "mixed": mixed, "h": h, "act": act, "z": z, "logits": logits, "hits": hits, "odds": odds, "sums": sums, "lse": np.log(sums)[:, :, 0]}


#: Of scores and logits: exp of it, summed over a window or the classes, is a float32.
BOUND = 80.0
SEEN = (np.arange(WINDOW)[None, :] <= np.arange(WINDOW // 2, WINDOW)[:, None]).astype(np.float32)


def back(w: dict[str, np.ndarray], wanted: np.ndarray, weight: np.ndarray, f: dict[str, np.ndarray], late: np.ndarray, both: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the sum of weighted negative log-probabilities of the wanted classes (by their places in the logits), for what is not
    linear in the embeddings. late and both receive those for each place of a window, as in Tables. Uses up f's odds and mixed."""
    flat = lambda a: a.reshape(-1, a.shape[-1])
    d, act = f["odds"], f["act"]
    d *= weight[:, :, None] / f["sums"]
    d.reshape(-1)[wanted] -= weight.reshape(-1)
    one = np.ones((1, len(wanted)), d.dtype)
    g = {"out": flat(f["z"]).T @ flat(d), "out_bias": (one @ flat(d))[0]}
    dz = times(d, w["out"].T)
    g["down"] = flat(act).T @ flat(dz)
    da = times(dz, w["down"].T)
    da *= act > 0
    g |= {"up": flat(f["h"]).T @ flat(da), "up_bias": (one @ flat(da))[0]}
    dz += times(da, w["up"].T)  # from here on of h
    late[..., :WIDTH] = dz
    f["mixed"] *= dz
    own = total(f["mixed"])
    own *= f["share"]
    dz *= f["share"]
    ds = dz @ f["v"].transpose(0, 2, 1)
    ds -= own
    ds *= f["a"]
    np.matmul(ds, f["k"], out=late[..., WIDTH:])
    np.matmul(ds.transpose(0, 2, 1), f["q"], out=both[..., :WIDTH])
    np.matmul(f["a"].transpose(0, 2, 1), dz, out=both[..., WIDTH:])
    return g


def by_id(inputs: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of x by their ids, n ids in all; two columns are added as one complex number."""
    inputs, wide = inputs.reshape(-1).astype(np.uint16 if n <= 1 << 16 else np.int64), x.shape[-1]  # short ids are sorted by digits
    order = np.argsort(inputs, kind="stable")
    inputs, pairs = inputs[order], x.reshape(-1, wide).view(np.complex64 if x.dtype == np.float32 else np.complex128)
    heads = np.flatnonzero(np.concatenate([[True], inputs[1:] != inputs[:-1]]))
    out = np.zeros((n, wide), x.dtype)
    out[inputs[heads]] = np.add.reduceat(pairs.take(order, axis=0), heads, axis=0).view(x.dtype)
    return out


def whole(w: dict[str, np.ndarray], class_of: np.ndarray, inputs: np.ndarray, tables: Tables, late: np.ndarray, both: np.ndarray) -> dict[str, np.ndarray]:
    """The other gradients, from late and both of all windows: summed by id and by place first, as all that follows is linear."""
    half, x, d = WINDOW // 2, tables.late[:, :WIDTH], WIDTH
    late_ids, both_ids = by_id(inputs[:, half:], late, len(x)), by_id(inputs, both, len(x))
    one = np.ones((1, len(inputs)), late.dtype)
    late_places, both_places = (one @ late.reshape(len(late), -1)).reshape(half, -1), (one @ both.reshape(len(both), -1)).reshape(WINDOW, -1)
    of_query = x.T @ late_ids[:, d:] + w["place"][half:].T @ late_places[:, d:]
    of_pair = x.T @ both_ids + w["place"].T @ both_places
    g = {"q": of_query * np.asarray(d**-0.5, x.dtype), "k": of_pair[:, :d], "v": of_pair[:, d:] @ w["o"].T, "o": w["v"].T @ of_pair[:, d:]}
    g["place"] = both_places @ tables.pair.T
    g["place"][half:] += late_places[:, :d] + late_places[:, d:] @ tables.query.T
    g["id"] = both_ids @ tables.pair.T + late_ids[:, :d] + late_ids[:, d:] @ tables.query.T
    at = class_of[:, None] * d + np.arange(d)
    g["class"] = np.bincount(at.reshape(-1), g["id"].reshape(-1), w["class"].size).reshape(w["class"].shape).astype(x.dtype)
    return g


def backward(w: dict[str, np.ndarray], class_of: np.ndarray, inputs: np.ndarray, targets: np.ndarray, f: dict[str, np.ndarray] | None = None, pad: int = -1) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log-probability of the targets' classes. f: the forward pass of all windows; without it, forward and
    backward go BLOCK windows at a time, so that what a pass makes stays in a core's cache."""
    tables, real = embedding(w, class_of), targets >= 0
    kind, n_classes = tables.late.dtype, w["out"].shape[1]
    wanted, weight = np.where(real, class_of[targets], 0), (real / max(1, real.sum())).astype(kind)
    late, both = np.empty((len(inputs), WINDOW // 2, 2 * WIDTH), kind), np.empty((len(inputs), WINDOW, 2 * WIDTH), kind)
    block, g = BLOCK if f is None else len(inputs), {}
    steps = np.arange(block * WINDOW // 2) * n_classes
    for a in range(0, len(inputs), block):
        at = slice(a, a + block)
        hit = wanted[at].reshape(-1)
        hit = hit + steps[: len(hit)]
        part = back(w, hit, weight[at], forward(w, tables, inputs[at], pad, hit) if f is None else f, late[at], both[at])
        g = {k: g[k] + x for k, x in part.items()} if a else part
    return g | whole(w, class_of, inputs, tables, late, both)


def untrained(beside: np.ndarray, counts: np.ndarray, place: np.ndarray, rng: np.random.Generator) -> Model:
    """The model before training, of the ids' neighbours and counts."""
    end, start, pad = len(counts) - 1, len(counts), len(counts) + 1
    own = classes(beside, place, rng)
    n_classes = OWN_CLASS + CLUSTERS
    in_class, of_class = np.bincount(own, minlength=n_classes), np.bincount(own, counts, minlength=n_classes)
    log_within = np.log(counts + 1.0) - np.log(np.maximum(of_class + in_class, 1))[own]
    class_of = np.concatenate([own, [n_classes, n_classes + 1]])  # the marks have input classes of their own
    init = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {
        "class": init(n_classes + 2, WIDTH, scale=0.3), "id": np.zeros((len(counts) + 2, WIDTH), np.float32), "place": init(WINDOW, WIDTH),
        "q": init(WIDTH, WIDTH, scale=0.25), "k": init(WIDTH, WIDTH, scale=0.25), "v": init(WIDTH, WIDTH, scale=0.25), "o": init(WIDTH, WIDTH, scale=0.25),
        "up": init(WIDTH, HIDDEN, scale=0.25), "up_bias": np.zeros(HIDDEN, np.float32), "down": init(HIDDEN, WIDTH, scale=0.2),
        "out": init(WIDTH, n_classes, scale=0.1), "out_bias": (np.log(of_class + 1.0) - np.log(of_class.sum() + n_classes)).astype(np.float32),
    }
    return Model(w, class_of, log_within.astype(np.float64), end, start, pad)


def descend(model: Model, inputs: np.ndarray, targets: np.ndarray, picks: Iterator[np.ndarray], rates: list[float]) -> None:
    """Adam, a step for each rate and batch of places in the windows."""
    w = model.weights
    names = [k for k in w if k != "id"]
    ends = np.cumsum([0, *(w[k].size for k in names)])
    dense = np.concatenate([w[k].reshape(-1) for k in names])
    w |= {k: dense[a:b].reshape(w[k].shape) for k, a, b in zip(names, ends[:-1], ends[1:])}  # views: what changes dense changes them
    first, second = ([np.zeros_like(dense), np.zeros_like(w["id"])] for _ in range(2))
    place, occurs = np.zeros(len(w["id"]), np.int64), np.zeros(len(w["id"]), bool)

    def moved(x: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, rate: float, step: int) -> None:
        m += np.float32(0.1) * (g - m)
        v += np.float32(0.01) * (g * g - v)
        down = np.sqrt(v / np.float32(1 - 0.99**step))
        down += np.float32(1e-8)
        x -= m * np.float32(rate / (1 - 0.9**step)) / down

    for step, (rate, pick) in enumerate(zip(rates, picks), 1):
        seen, wanted = inputs[pick], targets[pick].astype(np.int64)
        # Only the rows of ids that occur take part in a step.
        occurs[:] = False
        occurs[seen], occurs[wanted[wanted >= 0]] = True, True
        met = np.flatnonzero(occurs)
        place[met] = np.arange(len(met))
        own, pad = w | {"id": w["id"][met]}, int(place[model.pad]) if occurs[model.pad] else -1
        g = backward(own, model.class_of[met], place[seen], np.where(wanted >= 0, place[wanted], -1), pad=pad)
        moved(dense, np.concatenate([g[k].reshape(-1) for k in names]), first[0], second[0], rate, step)
        m, v = first[1][met], second[1][met]
        moved(own["id"], g["id"], m, v, rate, step)
        w["id"][met], first[1][met], second[1][met] = own["id"], m, v


def train(ids: np.ndarray, ends: np.ndarray, counts: np.ndarray, steps: int = STEPS, seed: int = 5) -> Model:
    """The model of sequences that one process holds, with the ids' counts in all training texts."""
    rng = np.random.default_rng(seed)
    place = places(counts)
    model = untrained(neighbours(ids, ends, place), counts, place, rng)
    if len(ids):
        inputs, targets, _ = windows(ids, ends, model)
        picks = (rng.integers(0, len(inputs), BATCH) for _ in range(steps))
        descend(model, inputs, targets, picks, [0.01 * min(1, k / 20) * (1 - k / (steps + 1)) for k in range(1, steps + 1)])
    return model


def summed_parts(rows: DataFrame, size: int) -> np.ndarray:
    """Counts that the tasks sent in parts, as (part, at, data), summed."""

    def summed(group: pa.Table) -> pa.Table:
        at = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("at")])
        n = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("data")])
        own, place = np.unique(at, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, place, n)
        return pa.table({"at": pa.array([own.tobytes()]), "data": pa.array([total.tobytes()])})

    out = np.zeros(size, np.int64)
    for row in rows.where("part is not null").select("part", "at", "data").groupBy("part").applyInArrow(summed, "at binary, data binary").collect():
        out[np.frombuffer(row["at"], np.int64)] = np.frombuffer(row["data"], np.int64)
    return out


def kind_of(model: Model) -> type:
    return np.uint16 if model.pad < 1 << 16 else np.int32


def id_groups(column: pa.Array, kind: type, most: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a to b of binary id sequences: their ids, and offsets; about `most` bytes at a time."""
    lengths = np.array([len(x.as_buffer()) for x in column], np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for a, b in chunks(ends, most):
        data = b"".join(x.as_py() for x in column.slice(a, b - a))
        yield a, b, np.frombuffer(data, kind).astype(np.int64), (ends[a : b + 1] - ends[a]) // np.dtype(kind).itemsize


def trained(sequences: DataFrame, n_windows: int, model: Model, seed: int = 5) -> Model:
    """The model trained on the windows of the sequences (ids: binary)."""
    if not n_windows or not STEPS:
        return model
    sequences = sequences.coalesce(max(1, n_windows // TASK_WINDOWS))
    repeats = -(-STEPS * BATCH // n_windows)
    kind, shapes = kind_of(model), {k: x.shape for k, x in model.weights.items()}

    def flat(w: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([w[k].reshape(-1) for k in shapes])

    def parted(x: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([math.prod(shape) for shape in shapes.values()])
        return {k: part.reshape(shapes[k]).copy() for k, part in zip(shapes, np.split(x, ends[:-1]))}

    for turn in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, model: Model = model) -> Iterator[pa.RecordBatch]:
            rng, mine = np.random.default_rng(seed + turn), []
            for batch in batches:
                for _, _, ids, ends in id_groups(batch.column(0), kind):
                    inputs, targets, _ = windows(ids, ends, model, slice(turn, None, ROUNDS))
                    mine.append((inputs.astype(kind), targets.astype(np.int32)))
            if not sum(len(x) for x, _ in mine):
                return
            inputs, targets = (np.concatenate(x) for x in zip(*mine))
            order = np.concatenate([rng.permutation(len(inputs)) for _ in range(repeats)])
            picks = np.array_split(order, -(-len(order) // BATCH))
            rates = [0.01 * min(1, k / 20) * (1 - (turn + k / (len(picks) + 1)) / ROUNDS) for k in range(1, len(picks) + 1)]
            out = Model({k: x.copy() for k, x in model.weights.items()}, model.class_of, model.log_within, model.end, model.start, model.pad)
            descend(out, inputs, targets, iter(picks), rates)
            parts = np.array_split(flat(out.weights), PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, len(inputs))), pa.array([x.tobytes() for x in parts])], names=["part", "n", "weights"])

        def mean(group: pa.Table) -> pa.Table:
            n = group.column("n").to_numpy().astype(np.float64)
            total = sum(k * np.frombuffer(x.as_py(), np.float32) for k, x in zip(n / n.sum(), group.column("weights")))
            return pa.table({"part": group.column("part").slice(0, 1), "weights": pa.array([total.astype(np.float32).tobytes()])})

        means = map_arrow(sequences, run, "part int, n long, weights binary").groupBy("part").applyInArrow(mean, "part int, weights binary").collect()
        if means:
            model = Model(parted(np.concatenate([np.frombuffer(x["weights"], np.float32) for x in sorted(means)])), model.class_of, model.log_within, model.end, model.start, model.pad)
    return model


def log10_scores(model: Model, ids: np.ndarray, ends: np.ndarray, tables: Tables | None = None) -> np.ndarray:
    """log10 probability of each id sequence (with its end mark). tables: the model's, where they are at hand."""
    inputs, targets, of = windows(ids, ends, model)
    tables = tables or embedding(model.weights, model.class_of)
    real, n_classes = targets >= 0, model.weights["out"].shape[1]
    wanted, found = np.where(real, model.class_of[targets], 0), np.where(real, model.log_within[np.maximum(targets, 0)], 0)
    steps = np.arange(BLOCK * WINDOW // 2) * n_classes
    for a in range(0, len(inputs), BLOCK):
        at = slice(a, a + BLOCK)
        hit = wanted[at].reshape(-1)
        f = forward(model.weights, tables, inputs[at], model.pad, hit + steps[: len(hit)])
        found[at] += (f["hits"].reshape(-1, WINDOW // 2) - f["lse"]) * real[at]
    return np.bincount(of, found.sum(axis=1), minlength=len(ends) - 1) / math.log(10)


def sequences(words: pa.Array, index: np.ndarray, ends: np.ndarray, vocabulary: pieces.Vocabulary, place: np.ndarray | None = None, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts, each with its end mark, one after another, and offsets. known: ids and offsets of words that were segmented
    before; place: each word's place among those, -1 for the others."""
    ids, at = known if known else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    place = np.full(len(words), -1) if place is None else place
    fresh = np.flatnonzero(place < 0)
    more, more_at = subwords(words.take(pa.array(fresh)), vocabulary)
    starts, widths = at[np.maximum(place, 0)], np.append(np.diff(at), 0)[np.maximum(place, 0)]
    starts[fresh], widths[fresh] = len(ids) + more_at[:-1], np.diff(more_at)
    width = widths[index]
    total = np.concatenate([[0], np.cumsum(width)])
    flat = np.concatenate([ids, more])[np.repeat(starts[index] - total[:-1], width) + np.arange(total[-1])]
    stops = total[ends[1:]]
    return np.insert(flat, stops, len(vocabulary.pieces)).astype(np.int64), np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])


def encoded(docs: DataFrame, frequent: tuple[list[bytes], list[int]], place: np.ndarray, log_end: float, vocabulary: pieces.Vocabulary) -> DataFrame:
    """A row a document of (doc_id, held_out, text): its ids, its numbers of tokens and windows, and the base's share of the frequent words;
    the other words with their times. And rows of parts: the counts of ids and neighbours in a task's training texts."""
    base = [("row", T.LongType()), ("n_tokens", T.LongType()), ("n_windows", T.LongType()), ("known", T.LongType()), ("logs", T.DoubleType()), ("words", T.ArrayType(T.BinaryType())), ("times", T.ArrayType(T.LongType())), ("ids", T.BinaryType()), ("part", T.IntegerType()), ("at", T.BinaryType()), ("data", T.BinaryType())]
    schema = T.StructType([*[T.StructField(x.name, x.dataType) for x in docs.schema.fields[:2]], *[T.StructField(*x) for x in base]])  # null in rows of parts
    known_ids = subwords(pa.array(frequent[0], pa.large_binary()), vocabulary)
    size, kind, half = len(place), kind_of(Model({}, place, place, len(place) - 1, len(place), len(place) + 1)), WINDOW // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, lookup_logs = pa.array(frequent[0], pa.large_binary()), np.append(np.log10(np.array(frequent[1], dtype=np.float64) + 1), 0.0)
        beside, row, types = np.zeros(size * (2 * (OWN_CLASS + 1) + 1), np.int64), TaskContext.get().partitionId() << 33, None
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            for a, b in chunks(offsets, CHUNK):
                part = batch.slice(a, b - a)
                found, index, stops = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held = pc.index_in(found, value_set=lookup).fill_null(-1).to_numpy().astype(np.int64) if len(found) else np.zeros(0, np.int64)
                ids, ends = sequences(found, index, stops, vocabulary, held, known_ids)
                learned = ~part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                beside[:-size] += neighbours(ids, ends, place, learned)
                beside[-size:] += np.bincount(ids[np.repeat(learned, np.diff(ends))], minlength=size)
                listed = held[index]
                summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[stops])
                of = np.repeat(np.arange(b - a), np.diff(stops))
                logs = np.bincount(of, lookup_logs[listed], minlength=b - a) + log_end
                rest = listed < 0
                pairs, often = np.unique(of[rest] * max(1, len(found)) + index[rest], return_counts=True)
                rows, which = pairs // max(1, len(found)), pairs % max(1, len(found))
                bounds = pa.array(np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, found.take(pa.array(which)).cast(pa.binary())), pa.ListArray.from_arrays(bounds, pa.array(often.astype(np.int64)))]
                data = ids.astype(kind)
                spelled = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
                columns = [part.column(0), part.column(1), pa.array(row + np.arange(b - a)), pa.array(np.diff(stops) + 1), pa.array(-(-np.diff(ends) // half)), pa.array(summed(listed >= 0)), pa.array(logs), *lists, spelled]
                types = [c.type for c in columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary()), pa.nulls(b - a, pa.binary())], names=schema.names)
                row += b - a
        met = np.flatnonzero(beside)
        if len(met):
            cuts = np.searchsorted(met, np.arange(PARTS + 1) * -(-len(beside) // PARTS))
            made = [(k, met[x:y].tobytes(), beside[met[x:y]].tobytes()) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if x < y]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(made), t) for t in types], *[pa.array(x, t) for x, t in zip(zip(*made), (pa.int32(), pa.binary(), pa.binary()))]], names=schema.names)

    return map_arrow(docs, run, schema)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, model_file: str = pieces.DEFAULT_MODEL) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    vocabulary = pieces.load(model_file)
    is_held = F.coalesce(crc_mod(doc_id, folds) == held, F.lit(False))
    docs = docs.select(F.col(doc_id).alias("doc_id"), is_held.alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    training = docs.where(~F.col("held_out"))
    counts = written(word_counts(training, "text"), "word-counts")
    n_docs = training.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = words + n_docs, distinct + (n_docs > 0)

    frequent, least = frequent_words(counts)
    size = len(vocabulary.pieces) + 1
    ids, ends = subwords(pa.array(frequent[0], pa.large_binary()), vocabulary)
    place = places(np.append(np.bincount(ids, np.repeat(np.array(frequent[1], np.float64), np.diff(ends)), minlength=size - 1), n_docs))
    rows = written(encoded(docs, frequent, place, math.log10(n_docs + 1), vocabulary), "encoded")
    gathered, wide = summed_parts(rows, size * (2 * (OWN_CLASS + 1) + 1)), size * 2 * (OWN_CLASS + 1)
    rows = rows.where("part is null")
    learned = rows.where(~F.col("held_out"))
    model = untrained(gathered[:wide], gathered[wide:], place, np.random.default_rng(5))
    model = trained(learned.select("ids"), learned.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0], model)

    own = rows.select("doc_id", "held_out", "row", "n_tokens", "known", "logs", "ids")
    kind, schema = kind_of(model), T.StructType([*own.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = embedding(model.weights, model.class_of)
        for batch in batches:
            for a, b, ids, ends in id_groups(batch.column(6), kind):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], pa.array(log10_scores(model, ids, ends, tables))], names=schema.names)

    scored = map_arrow(own, run, schema)
    rest = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare = counts.where((F.col("n") < least) | (F.octet_length("word") > FREQUENT_BYTES))
    met = rest.join(rare, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    whole = math.log10(tokens + distinct + 1)
    return scored.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.lit(int(n_docs > 0)) + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        "score",
    )


def frequent_words(counts: DataFrame) -> tuple[tuple[list[bytes], list[int]], int]:
    """Words and counts for all workers, and the least count of a word among them: the most frequent up to FREQUENT,
    all of a count or none, none longer than FREQUENT_BYTES."""
    short = counts.where(F.octet_length("word") <= FREQUENT_BYTES)
    # From a count of 2 ** k on, there are so many words: one row for each k.
    sizes = short.groupBy(F.floor(F.log2(F.col("n") + 0.5)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, k = 0, 64
    for size in sorted(sizes, reverse=True):
        if total + size["words"] > FREQUENT:
            break
        total, k = total + size["words"], size["k"]
    least = 1 << k
    found = short.where(F.col("n") >= least).toArrow() if k < 63 else None
    return (([], []) if found is None else (found.column("word").to_pylist(), found.column("n").to_pylist())), least if k < 63 else (1 << 62)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
