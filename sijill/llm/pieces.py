"""A unigram lattice over the pieces of a SentencePiece model file: vocabulary and pre-tokens.

A text's blanks become U+2581, one more stands before the text, and each character that no piece covers is
spelled in byte pieces; a U+2581 of the text itself is spelled in bytes too, so decoding restores the text
exactly. A pre-token starts at each blank that follows a non-blank, and before and after each line feed: no
piece spans such a place, so pre-tokens can be segmented one by one. The segmentation is the one of largest
summed score; among equals, each piece is the longest, read from the end.

A unigram file's scores are log-probabilities and taken as they are. A BPE file's are merge ranks, whole
numbers; there a piece of rank r has the log-probability of a Zipf-Mandelbrot law, of 1 / (r + FLATTEN).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import code_points, text_buffers

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
FLATTEN = 100
#: Stands for a U+2581 of the text; beyond Unicode, so in no piece.
LITERAL = 0x110000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: A piece's key sets one of 2**MARKED marks; only marked keys are looked up.
MARKED, SPREAD = 18, np.uint64(0xD6E8FEB86659FD93)


#: Characters from which a word advances alone, and characters of it whose pieces are looked up at a time.
LONG, STRIPE = 512, 1 << 17


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by length: sorted 64-bit keys, and for each key its id, score and code points."""

    keys: dict[int, np.ndarray]
    ids: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]
    spelled: dict[int, np.ndarray]
    marks: dict[int, np.ndarray]
    unknown: float
    byte_id: np.ndarray  # (256,)
    pieces: tuple[str, ...]  # by id, for decoding
    is_byte: np.ndarray
    is_control: np.ndarray

    @property
    def longest(self) -> int:
        return max(self.keys)

    def probe(self, length: int, keys: np.ndarray, chars) -> np.ndarray:
        """Places in the tables of that length, -1 for none. chars(hits): the substrings' code points, for the exact comparison."""
        table = self.keys.get(length)
        if table is None or not len(keys):
            return np.full(len(keys), -1, dtype=np.int64)
        out = np.full(len(keys), -1, dtype=np.int64)
        marked = np.flatnonzero(self.marks[length][mark_of(keys)])
        if len(marked):
            at = np.searchsorted(table, keys[marked])
            at[at == len(table)] = 0
            same = table[at] == keys[marked]
            hits, at = marked[same], at[same]
            true = (self.spelled[length][at] == chars(hits)).all(axis=1)
            out[hits[true]] = at[true]
        return out


def long_path(chars: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The best path of one long word, as `viterbi` gives it for equal-length ones. A step for all words at once would be a step
    for this one, so the pieces of a stripe are looked up together, and only those that occur are walked through: time in
    proportion to the length, with the same sums and the same choice among equals."""
    n, longest = len(chars), vocabulary.longest
    piece, back = np.full(n, -1, np.int32), np.zeros(n, np.int16)
    scores = [-np.inf] * (longest - 1) + [0.0]  # of the last `longest` ends before a stripe
    for a in range(0, n, STRIPE):
        b, low = min(n, a + STRIPE), max(0, a - longest + 1)
        own, key, found = chars[low:b], None, []
        for length in range(1, min(longest, b - low) + 1):
            tail = own[length - 1 :].astype(np.uint64) + np.uint64(1)
            key = tail if key is None else key[:-1] * BASE + tail
            windows = np.lib.stride_tricks.sliding_window_view(own, length)
            at = vocabulary.probe(length, key, lambda hits, w=windows: w[hits])
            start = np.arange(len(at)) if length == 1 else np.flatnonzero(at >= 0)
            start = start[low + start + length > a]
            at = at[start]
            known = at >= 0
            score, ids = np.full(len(at), vocabulary.unknown), np.full(len(at), -1, np.int32)
            if known.any():
                score[known], ids[known] = vocabulary.scores[length][at[known]], vocabulary.ids[length][at[known]]
            found.append((low + start + length - 1 - a, np.full(len(at), length, np.int16), score, ids))
        end, length, score, ids = (np.concatenate(part) for part in zip(*found))
        order = np.lexsort((-length, end))
        end, length, score, ids = end[order], length[order], score[order], ids[order]
        scores += [-np.inf] * (b - a)
        choice = [0] * (b - a)
        for k, (e, back_to, s) in enumerate(zip(end.tolist(), (end - length + longest).tolist(), score.tolist())):
            candidate = scores[back_to] + s
            if candidate > scores[e + longest]:
                scores[e + longest], choice[e] = candidate, k
        back[a:b], piece[a:b] = length[choice], ids[choice]
        scores = scores[-longest:]
    used, at = np.zeros(n, np.int16), n
    while at > 0:
        used[at - 1] = back[at - 1]
        at -= int(back[at - 1])
    return piece, used


def mark_of(keys: np.ndarray) -> np.ndarray:
    return keys * SPREAD >> np.uint64(64 - MARKED)


def hashed(chars: np.ndarray) -> np.ndarray:
    """Keys of equal-length strings, one a row."""
    key = np.zeros(len(chars), dtype=np.uint64)
    for column in chars.T:
        key = key * BASE + (column.astype(np.uint64) + np.uint64(1))
    return key


@functools.lru_cache(maxsize=2)
def load(model: str = DEFAULT_MODEL) -> Vocabulary:
    """Reads a SentencePiece file on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    n = m.get_piece_size()
    pieces = tuple(m.id_to_piece(i) for i in range(n))
    is_byte = np.array([m.is_byte(i) for i in range(n)])
    is_control = np.array([m.is_control(i) or m.is_unknown(i) for i in range(n)])
    by_length: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if not (is_byte[i] or is_control[i] or m.is_unused(i) or not piece):
            if "\n" in piece or chr(SPACE) in piece.lstrip(chr(SPACE)):
                raise ValueError(f"piece {i} spans pre-tokens")
            by_length.setdefault(len(piece), []).append(i)
    byte_id = np.full(256, -1, dtype=np.int32)
    for i in np.flatnonzero(is_byte):
        byte_id[int(pieces[i][1:-1], 16)] = i
    if (byte_id < 0).any():
        raise ValueError("the model has no byte fallback")
    own = {i: m.get_score(i) for members in by_length.values() for i in members}
    if all(x == int(x) for x in own.values()):
        ranked = sorted(own, key=lambda i: (-own[i], i))
        weight = np.log(sum(1 / (r + FLATTEN) for r in range(1, len(ranked) + 1)))
        own = {i: float(-np.log(r + FLATTEN) - weight) for r, i in enumerate(ranked, 1)}
    keys, ids, scores, spelled, marks = {}, {}, {}, {}, {}
    for length, members in by_length.items():
        chars = np.array([[ord(c) for c in pieces[i]] for i in members], dtype=np.uint32)
        key = hashed(chars)
        order = np.argsort(key, kind="stable")
        if len(np.unique(key)) < len(key):
            raise ValueError("two pieces have one key")
        keys[length], spelled[length] = key[order], chars[order]
        marks[length] = np.zeros(1 << MARKED, bool)
        marks[length][mark_of(key)] = True
        ids[length] = np.array(members, dtype=np.int32)[order]
        scores[length] = np.array([own[i] for i in members], dtype=np.float64)[order]
    unknown = min(float(s.min()) for s in scores.values()) - 10.0
    return Vocabulary(keys, ids, scores, spelled, marks, unknown, byte_id, pieces, is_byte, is_control)


def pre_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the texts in raw, each pre-token's place among them, and n + 1 offsets of the texts' pre-tokens."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    full = np.flatnonzero(lengths)  # an empty text has no pre-token
    heads = offsets[full]
    b = np.insert(raw, heads, 0x20)
    first = np.zeros(len(b), dtype=bool)
    first[heads + np.arange(len(full))] = True
    space, feed = b == 0x20, b == 0x0A
    first[1:] |= (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    starts = np.flatnonzero(first)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(b)).astype(np.int64)), pa.py_buffer(b)])
    coded = words.dictionary_encode()
    ends = np.cumsum(lengths + (lengths > 0))
    return coded.dictionary, coded.indices.to_numpy(), np.concatenate([[0], np.searchsorted(starts, ends)])


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of pre-tokens one after another, blanks as U+2581, and the pre-tokens' n + 1 offsets."""
    raw, offsets = text_buffers(words.cast(pa.large_string()))
    cps, lengths = code_points(raw, offsets)
    cps = np.where(cps == SPACE, np.uint32(LITERAL), np.where(cps == 0x20, np.uint32(SPACE), cps))
    return cps, np.concatenate([[0], np.cumsum(lengths)])


def byte_count(cps: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points."""
    cps = np.where(cps == LITERAL, SPACE, cps)
    return (1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)).astype(np.int32)


def utf8(cps: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points, one after another."""
    cps = np.where(cps == LITERAL, SPACE, cps).astype(np.uint32)
    return np.frombuffer(cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), dtype=np.uint8)
