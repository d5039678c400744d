"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a few MB of text are inserted in a trie, a level of all of them at a time. The
unigram forward score (and with it the number of tokens) of a prefix is computed once, at its node, from
the nodes up to a piece's length above it; the node at which a pre-token ends holds its count, and a
document's count is the sum over its pre-tokens. A pre-token of more than pieces.LONG characters is scored
alone, in time proportional to its length.

Defined results: a null or empty text has 0 tokens; equal scores keep the longest last piece; unknown
characters count their UTF-8 bytes; repeated rows are rows; other columns pass through, except ones named
like the operator's results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import pieces
from .common import chunks, map_arrow, table, text_buffers

CHUNK = 4 << 20


def counts(words: pa.Array, vocabulary: pieces.Vocabulary) -> np.ndarray:
    """Number of tokens of each distinct pre-token."""
    cps, offsets = pieces.spelled(words)
    lengths = np.diff(offsets)
    out = np.zeros(len(words), dtype=np.int64)
    for word in np.flatnonzero(lengths > pieces.LONG):  # beyond that depth hardly a prefix is shared
        own = cps[offsets[word] : offsets[word + 1]]
        piece, used = pieces.long_path(own, vocabulary)
        out[word] = np.where(used > 0, np.where(piece < 0, pieces.byte_count(own), 1), 0).sum()
    lengths = np.where(lengths > pieces.LONG, 0, lengths)
    order = np.argsort(-lengths, kind="stable")  # the words still open at a level stand first
    open_at = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    node = np.zeros(len(words), dtype=np.int64)  # of each word, in the level above
    longest = vocabulary.longest
    # For the last levels, newest first: parent, last character, forward score and tokens of each node.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(1, np.int64), np.zeros(1, np.uint32), np.zeros(1), np.zeros(1, np.int64))]
    suffixes: list[np.ndarray] = []  # keys of the last 1, 2, ... characters at each node of the level above
    for depth, still in enumerate(open_at):
        live = order[:still]
        chars = cps[offsets[live] + depth]
        edges, place = np.unique((node[:still] << 21) | chars, return_inverse=True)
        parent, char = edges >> 21, (edges & 0x1FFFFF).astype(np.uint32)
        step = char.astype(np.uint64) + np.uint64(1)
        suffixes = [step, *(s[parent] * pieces.BASE + step for s in suffixes[: longest - 1])]
        score, tokens = np.full(len(edges), -np.inf), np.zeros(len(edges), dtype=np.int64)
        up = [parent]  # places of the ancestors in the levels above
        for level in levels[: len(suffixes) - 1]:
            up.append(level[0][up[-1]])
        for length in range(len(suffixes), 0, -1):

            def spell(hits: np.ndarray, length: int = length) -> np.ndarray:
                columns = [char[hits]] + [levels[k][1][up[k][hits]] for k in range(length - 1)]
                return np.stack(columns[::-1], axis=1)

            at = vocabulary.probe(length, suffixes[length - 1], spell)
            above = levels[length - 1]
            own = vocabulary.scores[length][at] if length in vocabulary.scores else np.zeros(len(at))
            more = np.ones(len(at), dtype=np.int64)
            if length == 1:
                own = np.where(at < 0, vocabulary.unknown, own)
                more = np.where(at < 0, pieces.byte_count(char), 1)
                at = np.zeros(len(at), dtype=np.int64)
            candidate = np.where(at >= 0, above[2][up[length - 1]] + own, -np.inf)
            better = candidate > score
            score = np.where(better, candidate, score)
            tokens = np.where(better, above[3][up[length - 1]] + more, tokens)
        levels = [(parent, char, score, tokens), *levels[: longest - 1]]
        node = place
        ended = lengths[live] == depth + 1
        out[live[ended]] = tokens[place[ended]]
    return out


def count_tokens(docs: DataFrame, text: str = "text", model: str = pieces.DEFAULT_MODEL, n_words: str = "n_pretokens", n_tokens: str = "n_tokens") -> DataFrame:
    """docs with the numbers of pre-tokens and tokens of each whole text."""
    docs = docs.drop(n_words, n_tokens)
    names, at, vocabulary = [*docs.columns, n_words, n_tokens], docs.columns.index(text), pieces.load(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(n_tokens, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(at))
            found, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b in chunks(offsets, CHUNK):
                words, index, ends = pieces.pre_tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(words):
                    summed = np.concatenate([[0], np.cumsum(counts(words, vocabulary)[index])])
                    found[a:b], total[a:b] = np.diff(ends), np.diff(summed[ends])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(total)], names=names)

    return map_arrow(docs, count, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
