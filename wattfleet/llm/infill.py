"""Fill-in-the-middle: a document is cut in three and its middle moved to the end.

Cuts fall between units of a text. Every character has a class; a unit ends at the
characters of some classes (`UNITS`), so the number of units before a place is a sum of
class ranks. A wavelet matrix over the classes of all texts of a chunk answers ranks at
many places at once, and the place after a given number of units is found by bisection
on them, for both cuts of all documents together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Classes of characters: a letter before another letter, the last letter of a run, and the rest.
INNER, LAST, DIGIT, SPACE, OTHER, NEWLINE = range(6)
_BITS = 3

#: The classes whose characters end a unit. A text that goes on after its last unit has one more.
UNITS = {
    "token": (LAST, DIGIT, SPACE, OTHER, NEWLINE),
    "line": (NEWLINE,),
    "character": (INNER, LAST, DIGIT, SPACE, OTHER, NEWLINE),
}

#: Code points that are handled together; a longer text is a chunk of its own.
_CHUNK = 1 << 21


class RankBits:
    """Bits with the number of ones before any place, in an eighth of the space plus as much again."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks of small codes: a level for each bit, zeros before ones, order kept inside both."""

    def __init__(self, codes: np.ndarray, bits: int = _BITS) -> None:
        self.size, self.levels = len(codes), []
        for bit in reversed(range(bits)):
            ones = (codes >> bit) & 1
            self.levels.append((bit, RankBits(ones), int(len(codes) - ones.sum())))
            codes = np.concatenate([codes[ones == 0], codes[ones == 1]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often ``code`` stands before each place."""
        low, high = np.zeros(1, np.int64), at
        for bit, ones, zeros in self.levels:
            if code >> bit & 1:
                low, high = zeros + ones.ones(low), zeros + ones.ones(high)
            else:
                low, high = low - ones.ones(low), high - ones.ones(high)
        return high - low


def classes(text: str, ends: np.ndarray) -> np.ndarray:
    """The class of each code point of joined texts that end at the places ``ends``."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = (points | 32) - np.uint32(97) < 26
    followed = np.append(letter[1:], False) if len(letter) else letter
    followed[ends[ends > 0] - 1] = False
    codes = np.full(len(points), OTHER, np.uint8)
    codes[points - np.uint32(48) < 10] = DIGIT
    codes[points == 32] = SPACE
    codes[points == 10] = NEWLINE
    codes[letter] = np.where(followed[letter], INNER, LAST)
    return codes


class Units:
    """Counts and places of units in the texts of a chunk."""

    def __init__(self, texts: list[str], unit: str) -> None:
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        codes = classes("".join(texts), self.ends)
        self.kinds, self.matrix = UNITS[unit], WaveletMatrix(codes)
        self.first = self.ended(self.starts)
        last = codes[np.maximum(self.ends - 1, 0)] if len(codes) else np.zeros(len(texts), np.uint8)
        unended = (self.ends > self.starts) & ~np.isin(last, self.kinds)
        self.n = self.ended(self.ends) - self.first + unended

    def ended(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each place."""
        return sum(self.matrix.rank(kind, at) for kind in self.kinds)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Code points of each text in its first ``units`` units, by bisection on ranks."""
        low, high = self.starts.copy(), self.ends.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = self.ended(middle) - self.first >= units
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low - self.starts


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > _CHUNK:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _hash(id_col: str, seed: str, group: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "token", seed: str = "1",
    plain_percent: int = 10, spm_percent: int = 20,
) -> DataFrame:
    """Rows ``(id, n, form, prefix_chars, middle_chars, output)``, one for each document.

    ``n`` counts the text's units. Both cuts, and whether a text stays plain or puts its
    suffix first, follow from the SHA-256 of seed and id (a null id counts as empty), so
    a row that is computed again is the same. A null text is empty. An empty text, and one
    that holds a mark, stays plain; its ``prefix_chars`` and ``middle_chars`` are null. Rows
    with equal ids are cut alike where their texts are equal; repeated rows stay. Other
    columns play no part. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[_hash(id_col, seed, g).alias(f"h{g}") for g in range(4)],
    )
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def moved(texts: list[str], h: list[np.ndarray]) -> list[list]:
        units = Units(texts, unit)
        a, b = h[0] % (units.n + 1), h[1] % (units.n + 1)
        first, second = units.cut(np.minimum(a, b)), units.cut(np.maximum(a, b))
        out: list[list] = [units.n.tolist(), [], [], [], []]
        for text, p, q, h3, h4 in zip(texts, first.tolist(), second.tolist(), h[2].tolist(), h[3].tolist(), strict=True):
            if not text or h3 % 100 >= 100 - plain_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                row = (PLAIN, None, None, text)
            elif h4 % 100 < spm_percent:
                row = (SPM, p, q - p, "".join([SUFFIX, text[q:], PREFIX, text[:p], MIDDLE, text[p:q]]))
            else:
                row = (PSM, p, q - p, "".join([PREFIX, text[:p], SUFFIX, text[q:], MIDDLE, text[p:q]]))
            for column, value in zip(out[1:], row, strict=True):
                column.append(value)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            hashes = [batch.column(f"h{g}").to_numpy() for g in range(4)]
            for start, end in _chunks(texts):
                made = moved(texts[start:end], [h[start:end] for h in hashes])
                ids = batch.column("id").slice(start, end - start)
                arrays = [pa.array(values, kind) for values, (_, kind) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *arrays], [id_col, *[name for name, _ in fields]])

    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from; no text that was cut holds a mark."""
    parts = F.split(output, "<[PSM]>", -1)
    at = [F.get(parts, F.lit(i)) for i in range(4)]
    return (
        F.when(form == PSM, F.concat(at[1], at[3], at[2]))
        .when(form == SPM, F.concat(at[2], at[3], at[1]))
        .otherwise(output)
    )
