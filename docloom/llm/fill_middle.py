"""Fill-in-the-middle transformation with a learned rank index for the cuts.

A cut is a number of code points, the text is UTF-8 bytes, so each cut needs the byte offset of a
code point's rank. ``RankIndex`` learns that function: it fits line segments to *all* boundary
offsets such that no boundary lies further than ``ERROR`` bytes from its line, and stores what is
left as one signed byte per boundary. A lookup takes the segment of the rank, predicts the offset
and adds the stored residual, which gives the exact offset. The index of a slice of texts holds a
byte per code point, however long the texts are.

Segments grow greedily: from its first boundary a segment keeps the range of slopes that serve all
its boundaries so far, and ends before the boundary that leaves none. The ranges are running
maxima and minima, so numpy looks at thousands of boundaries at a time.

Defined cases: a null or empty text is ``plain`` and empty; a text that holds one of the marks is
``plain``, so every output can be undone; a null ``doc_id`` is hashed as no digits; equal rows give
equal rows, other columns are left out; an empty table gives no rows. A text of one code point has
cuts 0 and 1 only; parts may be empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batch, byte_column, map_arrow, slices, text_of

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes that a boundary may lie off its line: with rounding, what a signed byte holds.
ERROR = 126
#: Bytes of text whose boundaries are fitted at a time, and boundaries looked at first.
BLOCK, FIRST_LOOK = 1 << 19, 256

_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
    ("middle_chars", pa.int64()), ("output", pa.binary()),
])
_OUT_TYPE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def boundaries(raw: np.ndarray) -> np.ndarray:
    """Offsets at which a code point starts."""
    return np.flatnonzero((raw & 0xC0) != 0x80)


def segment_end(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """Where the segment that starts at ``at`` ends, and its slope."""
    low, high, end, look = -np.inf, np.inf, at + 1, FIRST_LOOK
    while end < len(offsets):
        stop = min(len(offsets), end + look)
        run = np.arange(end - at, stop - at, dtype=np.float64)
        rise = (offsets[end:stop] - offsets[at]).astype(np.float64)
        lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
        highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
        fits = int(np.searchsorted(lows > highs, True))  # once empty, the range stays empty
        if fits:
            low, high = lows[fits - 1], highs[fits - 1]
        end += fits
        if end < stop:
            break
        look *= 4
    return end, (low + high) / 2 if end > at + 1 else 1.0


@dataclass
class RankIndex:
    """Rank of a boundary to its offset."""

    first: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, error: int = ERROR) -> RankIndex:
        """The index of all boundaries of ``raw``, its end included. Blocks bound the arrays."""
        first, offset, slope, residual = [], [], [], []
        rank = 0
        for base in range(0, len(raw) + 1, BLOCK):
            block = raw[base : base + BLOCK]
            offsets = boundaries(block) + base
            if base + BLOCK > len(raw):
                offsets = np.append(offsets, len(raw))
            at = 0
            while at < len(offsets):
                end, incline = segment_end(offsets, at, error)
                line = offsets[at] + np.rint(incline * np.arange(end - at)).astype(np.int64)
                residual.append((offsets[at:end] - line).astype(np.int8))
                first.append(rank + at)
                offset.append(int(offsets[at]))
                slope.append(incline)
                at = end
            rank += len(offsets)
        return cls(np.array(first), np.array(offset), np.array(slope), np.concatenate(residual))

    def __len__(self) -> int:
        return len(self.residual)

    def offsets_of(self, ranks: np.ndarray) -> np.ndarray:
        of = np.searchsorted(self.first, ranks, side="right") - 1
        line = np.rint(self.slope[of] * (ranks - self.first[of])).astype(np.int64)
        return self.offset[of] + line + self.residual[ranks]


def drawn(seed: int, doc_id: str = "doc_id") -> list[Column]:
    """Four numbers below 2^32 that a row draws from its id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    sha = F.sha2(key, 256)
    return [F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _transform(marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            raw, offsets = byte_column(part.column("text"))
            forms = part.column("form").to_pylist()
            draws = np.stack([np.asarray(part.column(c)) for c in ("h1", "h2")])
            for i, j in slices(offsets):
                cut = offsets[i : j + 1] - offsets[i]
                data = raw[offsets[i] : offsets[j]]
                index = RankIndex.of(data)
                starts = np.zeros(len(data) + 1, np.uint8)
                starts[:-1] = (data & 0xC0) != 0x80
                rank = _ranks(starts, cut)
                n = np.diff(rank)
                chosen = np.sort(draws[:, i:j] % (n + 1), axis=0)
                ends = index.offsets_of(chosen + rank[:-1])
                text = data.tobytes()
                out = []
                for form, a, x, y, b in zip(forms[i:j], cut[:-1].tolist(), *ends.tolist(), cut[1:].tolist()):
                    if form == "plain":
                        out.append(text[a:b])
                    elif form == "psm":
                        out.append(b"".join((p, text[a:x], s, text[y:b], m, text[x:y])))
                    else:
                        out.append(b"".join((s, text[y:b], p, text[a:x], m, text[x:y])))
                plain = np.array([f == "plain" for f in forms[i:j]])
                before = pa.array(chosen[0], mask=plain)
                middle = pa.array(chosen[1] - chosen[0], mask=plain)
                ids, form = part.column("doc_id").slice(i, j - i), part.column("form").slice(i, j - i)
                yield batch(_OUT, ids, n, form, before, middle, out)

    return job


def _ranks(starts: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """How many boundaries lie before each of the offsets ``cut``, in order."""
    ranks = np.zeros(len(cut), np.int64)
    full = np.flatnonzero(np.diff(cut))
    if len(full):
        counts = np.add.reduceat(starts, cut[full], dtype=np.int64)
        ranks[1:][full] = counts
    return np.cumsum(ranks)


def transform(
    docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for each row of ``docs``.

    Two drawn cuts part the text into prefix, middle and suffix. ``psm`` writes prefix, suffix and
    middle behind their marks, ``spm`` suffix, prefix and middle; ``plain`` leaves the text as it is.
    """
    h1, h2, h3, h4 = drawn(seed)
    text = text_of()
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2")
    )
    out = map_arrow(rows, _transform(marks), _OUT_TYPE)
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``transform`` was given, from its output and form alone."""
    part = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)
