"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram of symbols is the product (binding) of its
letters' vectors, each rotated (permuted) by its place; a text is the sum (bundle) of its trigrams, and a
language the sum of its training texts. A text gets the language whose bundle has the largest cosine.

Defined results: texts that are null, empty or without any letter get ``und`` and score 0; equal cosines go
to the language that sorts first; repeated rows are rows; an empty training set leaves ``und`` everywhere;
other columns are passed through untouched, so clashing names can't arise (the operator's own columns
replace same-named ones). Texts are read whole, a few MB at a time.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, code_points, crc_mod, map_arrow, table, text_buffers

UNDETERMINED = "und"
#: Symbols: 0 for a run of non-letters, 1-26 for a-z, then buckets of all other letters.
SYMBOLS, OTHER = 128, 101
CHUNK = 1 << 20
#: Cells of a matrix of counts, and trigram vectors that are held at once.
CELLS, WIDE = 1 << 22, 1 << 13


@dataclass(frozen=True)
class Profiles:
    """Prototype vectors, one row for each language in sorted order."""

    languages: tuple[str, ...]
    vectors: np.ndarray  # (languages, dimensions), each of length 1
    seed: int


@functools.lru_cache(maxsize=1)
def symbol_of() -> np.ndarray:
    """Symbol by code point: letters in lower case, other letters in buckets, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            low = low if len(low) == 1 else c
            out[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % OTHER
    return out


@functools.lru_cache(maxsize=4)
def letter_vectors(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, dimensions))


def trigram_vectors(codes: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    letters = letter_vectors(dimensions, seed)
    first, second, third = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts in raw: the code of each trigram, the text it stands in (sorted), and which texts have a letter."""
    n = len(offsets) - 1
    cps, lengths = code_points(raw, offsets)
    symbols, owner = symbol_of()[cps], np.repeat(np.arange(n, dtype=np.int32), lengths)
    lettered = np.bincount(owner[symbols > 0], minlength=n) > 0
    keep = symbols > 0
    keep[:1] |= True
    keep[1:] |= (symbols[:-1] > 0) | (owner[1:] != owner[:-1])
    symbols, owner = symbols[keep].astype(np.int32), owner[keep]
    codes = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
    same = owner[:-2] == owner[2:]
    return codes[same], owner[:-2][same], lettered


def summed(codes: np.ndarray, owner: np.ndarray, rows: int, dimensions: int, seed: int) -> np.ndarray:
    """The bundle of each row's trigrams (float64 sums of whole numbers). The matrix of counts, rows by distinct trigrams, has
    CELLS cells at most: a taller one is halved, and a wider one is taken in parts. owner: sorted."""
    distinct, place = np.unique(codes, return_inverse=True)
    if rows > 1 and rows * len(distinct) > CELLS:
        half = rows // 2
        cut = np.searchsorted(owner, half)
        return np.concatenate([summed(codes[:cut], owner[:cut], half, dimensions, seed), summed(codes[cut:], owner[cut:] - half, rows - half, dimensions, seed)])
    out = np.zeros((rows, dimensions))
    if len(distinct):
        counts = np.bincount(owner.astype(np.int64) * len(distinct) + place, minlength=rows * len(distinct)).reshape(rows, -1).astype(np.float32)
        for start in range(0, len(distinct), WIDE):
            out += counts[:, start : start + WIDE] @ trigram_vectors(distinct[start : start + WIDE], dimensions, seed).astype(np.float32)
    return out


def bundles(raw: np.ndarray, offsets: np.ndarray, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bundles and which texts have a letter."""
    codes, owner, lettered = trigrams(raw, offsets)
    return summed(codes, owner, len(offsets) - 1, dimensions, seed), lettered


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = 512, seed: int = 7) -> Profiles:
    """Prototypes from every row of docs with a language. Each task sends one vector a language."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            labels = batch.column(1).to_pylist()
            for a, b in chunks(offsets, CHUNK):
                codes, owner, _ = trigrams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                names, of = np.unique(np.array(labels[a:b], dtype=object), return_inverse=True)
                order = np.argsort(of[owner], kind="stable")
                for name, row in zip(names, summed(codes[order], of[owner][order], len(names), dimensions, seed)):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(np.rint(row).astype(np.int64))],
                names=["lang", "pos", "value"],
            )

    known = docs.select(F.col(text).cast("string"), F.col(lang).cast("string")).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = map_arrow(known, sums, "lang string, pos int, value long").groupBy("lang", "pos").agg(F.sum("value").alias("value")).collect()
    made: dict[str, np.ndarray] = {}
    for name, pos, value in rows:
        made.setdefault(name, np.zeros(dimensions))[pos] = value
    names = tuple(sorted(k for k, v in made.items() if v.any()))
    vectors = np.stack([made[k] / np.linalg.norm(made[k]) for k in names]) if names else np.zeros((0, dimensions))
    return Profiles(names, vectors, seed)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its cosine, held to 0..1."""
    docs = docs.drop(pred, score)
    names, at = docs.columns, docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    arrow_names, dimensions = [*names, pred, score], profiles.vectors.shape[1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = profiles.vectors.T
        options = np.array([*profiles.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(at))
            best, cosine = np.full(batch.num_rows, len(options) - 1), np.zeros(batch.num_rows)
            for a, b in chunks(offsets, CHUNK) if profiles.languages else ():
                made, lettered = bundles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], dimensions, profiles.seed)
                near = made @ vectors / np.maximum(np.linalg.norm(made, axis=1), 1e-9)[:, None]
                top = near.argmax(axis=1)
                best[a:b] = np.where(lettered, top, len(options) - 1)
                cosine[a:b] = np.where(lettered, np.clip(near[np.arange(b - a), top], 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(options[best], pa.string()), pa.array(cosine)], names=arrow_names)

    return map_arrow(docs, label, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """Learns from the rows outside the held-out fold and labels all rows from their text alone."""
    known = docs.where(F.coalesce(crc_mod(doc_id, folds) != held, F.lit(True)))
    profiles = train(known, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(crc_mod(doc_id, folds) == held, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return predict(rows, profiles).drop("text")


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


#: In the pipeline: a text of m characters reads like none of the languages where its best cosine is below LEAST_COSINE - SLACK / m. The fewer
#: trigrams, the lower the cosine in any language; the bound is one function of the length.
LEAST_COSINE, SLACK = 0.1, 20.0


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents without a letter, and those unlike every learned language: their best cosine is below
    LEAST_COSINE - SLACK / m, m the text's number of characters."""
    profiles = train(docs.where(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(True))))
    labelled = predict(docs, profiles, pred="_lang_pred", score="_cosine")
    bound = LEAST_COSINE - SLACK / F.greatest(F.char_length("text"), F.lit(1))
    return labelled.where((F.col("_lang_pred") != UNDETERMINED) & (F.col("_cosine") >= bound)).select(*docs.columns)
