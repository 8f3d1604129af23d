"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library.

A byte-level BPE encodes each word-like piece by itself, so the ids of a text are the ids of its
pieces in turn. ``Encoder`` cuts texts where the tokenizer's own pre-tokenizer always cuts: before
a single white-space character between two visible ones, and between an ASCII letter and ASCII
punctuation other than the apostrophe. Each distinct piece is then encoded once and remembered,
which is many times cheaper than encoding every occurrence. Texts for which these rules may not
hold (other kinds of white space, control characters, special-token strings, or another kind of
tokenizer) are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from docloom.llm.hashing import byte_tokens, prime_hashes

#: Distinct pieces that a worker remembers, and the slots of the table that holds them.
REMEMBERED, SLOTS = 1 << 20, 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC2:] = True  # starts a character; white space among them rules the text out
_LATER = np.zeros(256, bool)
_LATER[0x80:0xC0] = True  # continues a character
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_PUNCT[0x30:0x3A] = _PUNCT[0x41:0x5B] = _PUNCT[0x61:0x7B] = False
_PUNCT[0x27] = False
_ODD = re.compile("[\x00-\x08\x0b-\x1f\x7f\x85\xa0 ᠎ -‏ -  ⁠　﻿]".encode("utf-8", "surrogatepass").decode())


@lru_cache(maxsize=2)
def encoder(path: str) -> "Encoder":
    return Encoder(path)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec.get("pre_tokenizer") or {}
        self.byte_level = (
            spec["model"]["type"] == "BPE" and not spec.get("normalizer") and not spec["model"].get("dropout")
            and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space")
            and splitter.get("use_regex", True)
        )
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)  # hashes of remembered pieces; 0 is a free slot
        self.piece = np.zeros(SLOTS, np.int32)
        self.known = 0
        self.place = np.zeros(1 << 12, np.int64)  # where each piece's ids start in ``ids``
        self.count = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of a batch of UTF-8 texts."""
        n = len(offsets) - 1
        whole = bytes(raw)
        cuts = offsets.tolist()
        plain = [i for i in range(n) if self._is_odd(whole[cuts[i] : cuts[i + 1]])]
        ids, counts = self._by_pieces(raw, offsets, whole, plain)
        if plain:
            texts = [whole[cuts[i] : cuts[i + 1]].decode() for i in plain]
            own = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            ends = np.cumsum(counts)
            parts, last = [], 0
            for i, x in zip(plain, own):
                parts += [ids[last : ends[i]], x]
                last = ends[i]
                counts[i] = len(x)
            ids = np.concatenate([*parts, ids[last:]])
        out = np.zeros(n + 1, np.int64)
        np.cumsum(counts, out=out[1:])
        return ids, out

    def _is_odd(self, text: bytes) -> bool:
        if not self.byte_level:
            return True
        if any(s in text for s in self.special):
            return True
        return _ODD.search(text.decode()) is not None

    def _by_pieces(self, raw, offsets, whole, plain) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        left = np.ones(n, bool)
        left[plain] = False
        opens = np.zeros(len(raw) + 1, bool)
        if len(raw) > 2:
            before, here, after = raw[:-2], raw[1:-1], raw[2:]
            seen = _VISIBLE | _LATER
            opens[1:-2] = _SPACE[here] & seen[before] & seen[after]
            opens[1:-1] |= _LETTER[raw[:-1]] & _PUNCT[raw[1:]]
            opens[1:-1] |= _PUNCT[raw[:-1]] & _SPACE[raw[1:]] & np.append(seen[raw[2:]], False)
        opens[offsets] = True
        starts = np.flatnonzero(opens)
        starts = starts[starts < len(raw)]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        ends = np.append(starts[1:], len(raw))
        row = np.searchsorted(offsets, starts, side="right") - 1
        if plain:
            keep = left[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        hashes = prime_hashes(byte_tokens(raw), starts, ends) | np.uint64(1)
        piece = self._pieces(hashes, starts, ends, whole)
        at, size = self.place[piece], self.count[piece]
        total = np.cumsum(size)
        index = np.arange(total[-1] if len(total) else 0) + np.repeat(at - (total - size), size)
        return self.ids[index], np.bincount(row, weights=size, minlength=n).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of remembered pieces, -1 for others: linear probing, all at once."""
        out = np.full(len(hashes), -1, np.int32)
        left, slot = None, (hashes >> np.uint64(43)).astype(np.int64)
        while True:
            key = self.key[slot]
            hit = key == (hashes if left is None else hashes[left])
            go = ~hit & (key != 0)
            if left is None:
                out[hit] = self.piece[slot[hit]]
                left = np.flatnonzero(go)
            else:
                out[left[hit]] = self.piece[slot[hit]]
                left = left[go]
            if not len(left):
                return out
            slot = (slot[go] + 1) % SLOTS

    def _remember(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slot = (hashes >> np.uint64(43)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.key[slot] == 0)
            taken, first = np.unique(slot[free], return_index=True)
            now = free[first]
            self.key[taken], self.piece[taken] = hashes[now], numbers[now]
            wait = np.ones(len(hashes), bool)
            wait[now] = False
            hashes, numbers = hashes[wait], numbers[wait]
            slot = (slot[wait] + 1) % SLOTS

    def _pieces(self, hashes, starts, ends, whole) -> np.ndarray:
        """The numbers of a batch's pieces, after encoding those not met before."""
        if self.known > REMEMBERED:
            self._forget()
        piece = self._find(hashes)
        new = np.flatnonzero(piece < 0)
        if len(new):
            distinct, first, of = np.unique(hashes[new], return_index=True, return_inverse=True)
            at = new[first]
            texts = [whole[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            ids = self._encode_pieces(texts)
            count = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))
            numbers = np.arange(self.known, self.known + len(distinct), dtype=np.int32)
            self.place = _grown(self.place, self.known, self.used + np.cumsum(count) - count)
            self.count = _grown(self.count, self.known, count)
            self.ids = _grown(self.ids, self.used, flat)
            self.known, self.used = self.known + len(distinct), self.used + len(flat)
            self._remember(distinct, numbers)
            piece[new] = numbers[of]
        return piece

    def _encode_pieces(self, texts: list[str]) -> list[list[int]]:
        """A piece of letters is one word of the pre-tokenizer: its ids come from the library's
        BPE model directly, the others' from the whole tokenizer."""
        body = [(t[1:] if t[0] == " " else t).isalpha() for t in texts]
        words = "\n".join([t for t, b in zip(texts, body) if b])
        words = words.encode().decode("latin-1").translate(_BYTE_CHARS)
        tokenize = self.tokenizer.model.tokenize
        ids = [[k.id for k in tokenize(w)] for w in words.split("\n")] if words else []
        others = [t for t, b in zip(texts, body) if not b]
        more = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        ids, more = iter(ids), iter(more)
        return [next(ids) if b else next(more) for b in body]


def _grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    if used + len(more) > len(held):
        held = np.concatenate([held, np.zeros(max(len(held), len(more)), held.dtype)])
    held[used : used + len(more)] = more
    return held


def _byte_chars() -> dict[int, str | int]:
    """The printable character a byte-level BPE writes for each byte: itself where it is
    printable, else the next one from U+0100 on. The line feed stays, between pieces."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    chars = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    chars[0x0A] = "\n"
    return chars


_BYTE_CHARS = _byte_chars()
