"""Words of whole texts as numpy arrays, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from docloom.llm.hashing import byte_tokens, mix, prime_hashes, span_hashes

#: Bytes between the words of op6: the blank and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes between normalised words: all of ASCII but letters and digits. A byte from 0x80 on is
#: part of a letter.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = False
for _range in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B)):
    NOT_ALNUM[list(_range)] = False


def word_spans(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray):
    """``(starts, ends, first)``: the words' byte spans, and for each row the index of its first
    word, with the number of all words at the end."""
    inside = ~between[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(raw)]
    opens[rows] = inside[rows]
    starts = np.flatnonzero(opens)
    shut = np.zeros(len(raw) + 1, bool)
    shut[1:] = inside
    shut[1:-1] &= ~inside[1:] | opens[1:]
    ends = np.flatnonzero(shut)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(byte_tokens(raw), starts, ends)


def word_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words by which they are taken as equal."""
    return prime_hashes(byte_tokens(raw), starts, ends)


def set_hash(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set given as sorted distinct hashes."""
    place = np.arange(1, len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        a = int(np.bitwise_xor.reduce(mix(values + place * np.uint64(0x9E3779B97F4A7C15)))) if len(values) else 0
        b = int(np.add.reduce(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) if len(values) else 0
    return a, b ^ len(values)


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each word the number of its bytes among the distinct ones, and those."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    kind = pa.large_binary()
    words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[at])]).dictionary_encode()
    return np.asarray(words.indices), words.dictionary.to_pylist()
