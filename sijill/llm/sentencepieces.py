"""SentencePiece encoding and decoding with a batched Viterbi search.

The distinct pre-tokens of a few MB of text are grouped by length; all words of a length advance together,
a character at a time. Hashes of all substrings up to the longest piece are looked up in sorted piece keys
(a hit is compared letter by letter), and the vectorised maximum over the pieces that end at a character is
stored as a backpointer; a word of more than pieces.LONG characters, which few others can equal, is walked
through alone, with the same sums. Decoding joins the pieces and bytes and turns U+2581 back into blanks.

Defined results: a null text encodes to null and decodes to null, an empty one to no ids and back; decoding
an encoded text gives the same text; equal scores keep the longest last piece; control ids decode to
nothing and bytes that are no UTF-8 to U+FFFD; repeated rows are rows; other columns pass through, except
ones named like the operator's results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces
from .common import chunks, map_arrow, table, text_buffers

CHUNK = 2 << 20
#: Characters of equal-length words that advance together.
CELLS = 1 << 17


def viterbi(chars: np.ndarray, vocabulary: pieces.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Segments of equal-length words (one a row): id of the piece that ends at each character of the best path
    (-1: unknown character), and its length (0: no piece of the path ends there)."""
    count, n = chars.shape
    longest = min(n, vocabulary.longest)
    where, key = [], None
    for length in range(1, longest + 1):
        tail = chars[:, length - 1 :].astype(np.uint64) + np.uint64(1)
        key = tail if key is None else key[:, :-1] * pieces.BASE + tail
        windows = np.lib.stride_tricks.sliding_window_view(chars, length, axis=1).reshape(-1, length) if length > 1 else chars.reshape(-1, 1)
        where.append(vocabulary.probe(length, key.reshape(-1), lambda hits, w=windows: w[hits]).reshape(count, -1))
    best = np.full((count, n + 1), -np.inf)
    best[:, 0] = 0.0
    back, piece = np.zeros((count, n + 1), np.int16), np.full((count, n + 1), -1, np.int32)
    for end in range(1, n + 1):
        for length in range(min(end, longest), 0, -1):
            at = where[length - 1][:, end - length]
            hit = at >= 0
            if length > 1 and not hit.any():
                continue
            own = vocabulary.scores[length][at] if length in vocabulary.scores else np.zeros(count)
            own = np.where(hit, own, vocabulary.unknown if length == 1 else -np.inf)
            candidate = best[:, end - length] + own
            better = candidate > best[:, end]
            best[better, end], back[better, end] = candidate[better], length
            known = better & hit
            piece[known, end] = vocabulary.ids[length][at[known]]
            piece[better & ~hit, end] = -1
    used, at, rows = np.zeros((count, n + 1), np.int16), np.full(count, n), np.arange(count)
    while len(rows):
        used[rows, at] = step = back[rows, at]
        at = at - step
        rows, at = rows[at > 0], at[at > 0]
    return piece[:, 1:], used[:, 1:]


def encode_words(words: pa.Array, vocabulary: pieces.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pre-tokens one after another, and n + 1 offsets."""
    cps, offsets = pieces.spelled(words)
    lengths = np.diff(offsets)
    piece, used = np.full(len(cps), -1, np.int32), np.zeros(len(cps), np.int16)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        n = int(lengths[order[a]])
        if n > pieces.LONG:
            for word in order[a:b]:
                own = slice(offsets[word], offsets[word + 1])
                piece[own], used[own] = pieces.long_path(cps[own], vocabulary)
            continue
        for start in range(a, b, max(1, CELLS // n)):
            at = offsets[order[start : min(b, start + max(1, CELLS // n))], None] + np.arange(n)
            piece[at], used[at] = viterbi(cps[at], vocabulary)
    width = np.where(used > 0, np.where(piece < 0, pieces.byte_count(cps), 1), 0)
    ends = np.concatenate([[0], np.cumsum(width)])
    ids = np.empty(ends[-1], np.int32)
    plain, spelled = np.flatnonzero((used > 0) & (piece >= 0)), np.flatnonzero((used > 0) & (piece < 0))
    ids[ends[plain]] = piece[plain]
    within = width[spelled]
    ids[np.repeat(ends[spelled] - np.cumsum(within) + within, within) + np.arange(within.sum())] = vocabulary.byte_id[pieces.utf8(cps[spelled])]
    return ids, ends[offsets]


def encode_batch(raw: np.ndarray, offsets: np.ndarray, vocabulary: pieces.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts one after another, and n + 1 offsets."""
    words, index, ends = pieces.pre_tokens(raw, offsets)
    if not len(words):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    ids, at = encode_words(words, vocabulary)
    width = np.diff(at)[index]
    total = np.concatenate([[0], np.cumsum(width)])
    return ids[np.repeat(at[:-1][index] - total[:-1], width) + np.arange(total[-1])], total[ends]


def piece_bytes(vocabulary: pieces.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """What each id decodes to, as bytes one after another, and offsets."""
    spelled = [
        b"" if control else bytes([int(piece[1:-1], 16)]) if byte else piece.replace(chr(pieces.SPACE), " ").encode()
        for piece, byte, control in zip(vocabulary.pieces, vocabulary.is_byte, vocabulary.is_control)
    ]
    return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelled])])


def decode_batch(ids: np.ndarray, offsets: np.ndarray, vocabulary: pieces.Vocabulary) -> tuple[bytes, np.ndarray]:
    """UTF-8 of id sequences one after another, and n + 1 byte offsets; the blank before each text is dropped."""
    data, at = piece_bytes(vocabulary)
    width = np.diff(at)[ids].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(width)])
    out = data[np.repeat(at[:-1][ids] - total[:-1], width) + np.arange(total[-1])]
    heads = total[offsets[:-1][np.diff(offsets) > 0]]
    heads = heads[heads < len(out)]
    heads = heads[out[heads] == 0x20]
    ends = total[offsets] - np.searchsorted(heads, total[offsets], side="left")
    return np.delete(out, heads).tobytes(), ends


def _added(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    df = df.drop(name)
    return df, T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = pieces.DEFAULT_MODEL, restored: str | None = None) -> DataFrame:
    """docs with the ids of each whole text, and with `restored` a column that says whether decoding them gave it back."""
    docs, schema = _added(docs, ids, T.ArrayType(T.IntegerType()))
    if restored:
        docs = docs.drop(restored)
        schema = T.StructType([*[f for f in schema.fields if f.name != restored], T.StructField(restored, T.BooleanType())])
    at, vocabulary = docs.columns.index(text), pieces.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(at))
            for a, b in chunks(offsets, CHUNK):
                own, ends_of_text = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                found, ends = encode_batch(own, ends_of_text, vocabulary)
                part = batch.slice(a, b - a)
                made = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found), mask=part.column(at).is_null())]
                if restored:
                    data, at_end = decode_batch(found, ends, vocabulary)
                    spelled = own.tobytes()
                    made.append(pa.array([data[at_end[k] : at_end[k + 1]] == spelled[ends_of_text[k] : ends_of_text[k + 1]] for k in range(b - a)]))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)

    return map_arrow(docs, run, schema)


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", model: str = pieces.DEFAULT_MODEL) -> DataFrame:
    """docs with the text of each id sequence."""
    docs, schema = _added(docs, text, T.StringType())
    names, at, vocabulary = [*docs.columns, text], docs.columns.index(ids), pieces.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(at).value_lengths().fill_null(0).to_numpy()
            for a, b in chunks(np.concatenate([[0], np.cumsum(widths, dtype=np.int64)]), CHUNK // 4):
                part = batch.slice(a, b - a)
                lists = part.column(at)
                data, ends = decode_batch(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(widths[a:b], dtype=np.int64)]), vocabulary)
                null = lists.is_null().to_pylist()
                made = [None if null[k] else data[ends[k] : ends[k + 1]].decode("utf-8", "replace") for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=names)

    return map_arrow(docs, run, schema)


def op6_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether decoding them gave the text back."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), restored="restored")
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "restored")


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are left, as ids."""
    coded = encode(docs.select("doc_id", "text"))
    return coded.select("doc_id", "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).otherwise(0).cast("long").alias("n_tokens"))
