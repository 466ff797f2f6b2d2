"""Removal of repeated and nearly repeated lines.

Lines get a MinHash signature over their character shingles: one pass over the
shingles, each hash competing in one of the signature's places (one permutation),
empty places filled from others in a fixed order. Bands of the signature are the
keys of a shuffle. Lines that meet are verified by their exact Jaccard similarity:
first each with the line of its key that meets most others, then, where a key still
holds lines of several components, the pairs across components; pairs inside a
component can add nothing. Distributed union-find joins the links, and the first line
of each component stays.

A line carries the number of its shingles and a bitmap they are hashed to. A bit that one
line has and the other has not stands for a shingle of its own, so the bitmaps bound the
similarity from above; pairs that cannot reach it never leave the join.

A line is named by the XXH64 of its text, so exact copies are one line from the start
and never meet as pairs. Texts move only for lines that share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.components import connected_components
from wattfleet.llm.decontaminate import with_candidates
from wattfleet.llm.rows import as_rows
from wattfleet.session import stored

SHINGLE = 8
SIMILARITY = 0.8
#: 12 bands of 5 values find a pair of similarity 0.8 with a chance of 99.2 %, one of 0.85 with 99.9 %.
BANDS = 12
ROWS = 5
_PLACES = BANDS * ROWS
_EMPTY = np.int64(1) << np.int64(40)
#: Characters worked on at a time: arrays of this length stay in the processor's cache.
_CHARS = 1 << 16
_SPACES = " \t\n\x0b\x0c\r"
#: 64-bit words of the bitmap of a line's shingles.
_WORDS = 32
_BITS = [f"bits{i}" for i in range(_WORDS)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _donors() -> np.ndarray:
    """For each place, all places in an order of its own."""
    rank = _mix(np.arange(1, _PLACES * _PLACES + 1, dtype=np.uint64)).reshape(_PLACES, _PLACES)
    return np.argsort(rank, axis=1)


_DONORS = _donors()


def _shingle_hashes(codes: np.ndarray, shingle: int) -> np.ndarray:
    """A hash of every run of ``shingle`` code points: a polynomial, whose runs of twice the length are two runs each."""
    hashes, size, factor = codes, 1, 0x9E3779B97F4A7C15
    for bit in f"{shingle:b}"[1:]:
        longer = hashes[:-size] * np.uint64(pow(factor, size, 1 << 64))
        longer += hashes[size:]
        hashes, size = longer, 2 * size
        if bit == "1":
            longer = hashes[:-1] * np.uint64(factor)
            longer += codes[size:]
            hashes, size = longer, size + 1
    return hashes


def _shingles(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the line of every shingle of the lines; a line shorter than a shingle is one shingle."""
    padded = [line if len(line) >= shingle else line + "\0" * (shingle - len(line)) for line in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(line) for line in padded], np.int64)
    hashes = _shingle_hashes(codes, shingle)
    whole = np.ones(len(hashes), bool)
    ends = np.cumsum(lengths)[:-1]
    for i in range(1, shingle):  # runs that go on into the next line
        whole[ends - i] = False
    return hashes[whole], np.repeat(np.arange(len(lines)), lengths - shingle + 1)


def signatures(lines: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """MinHash signatures, one row per line; a line shorter than a shingle is one shingle."""
    hashes, owner = _shingles(lines, shingle)
    hashes = _mix(hashes)
    place = ((hashes >> np.uint64(32)) * np.uint64(_PLACES) >> np.uint64(32)).astype(np.int64)
    value = (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)
    flat = np.full(len(lines) * _PLACES, _EMPTY, np.int64)
    np.minimum.at(flat, owner * _PLACES + place, value)
    table = flat.reshape(-1, _PLACES)
    row, col = np.nonzero(table == _EMPTY)
    given = table.copy()
    for turn in range(_PLACES):
        if not len(row):
            break
        found = table[row, _DONORS[col, turn]]
        hit = found != _EMPTY
        given[row[hit], col[hit]] = found[hit]
        row, col = row[~hit], col[~hit]
    return given


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per line and band."""
    parts = signature.astype(np.uint64).reshape(-1, BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(parts), 0)
    for i in range(ROWS):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys.view(np.int64)


def _name(line: str) -> int:
    value = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return value - (1 << 64) if value >> 63 else value


def _banded(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[str] = set()
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(line for line in text.split("\n") if line.strip(_SPACES))
            part, chars = [], 0
            for line in found:
                part.append(line)
                chars += len(line)
                if chars >= _CHARS:
                    yield rows(part)
                    part, chars = [], 0
            if part:
                yield rows(part)

    def rows(lines: list[str]) -> pa.RecordBatch:
        keys = band_keys(signatures(lines, shingle))
        names = np.array([_name(line) for line in lines], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(names, BANDS))], ["key", "line"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and line: those of keys with two lines or more, each once. Keeps one row between batches."""
    last, pending = None, False  # the newest distinct row, and whether it has not been given out
    for batch in batches:
        key, line = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        if last is not None:
            key, line = np.r_[last[0], key], np.r_[last[1], line]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])]
        key, line = key[fresh], line[fresh]
        after = np.r_[key[1:] == key[:-1], False]
        before = np.r_[False, key[1:] == key[:-1]]
        take = after | before
        if last is not None and not pending:
            take[0] = False
        last, pending = (key[-1], line[-1]), not take[-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[take]), pa.array(line[take])], ["key", "line"])


def jaccard(a: str, b: str, shingle: int = SHINGLE) -> float:
    """Of the sets of character shingles of two lines."""
    x, y = ({t[i : i + shingle] for i in range(max(len(t) - shingle + 1, 1))} for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _packed(line: str, shingle: int) -> np.ndarray | None:
    """The distinct shingles of eight characters as ascending numbers, a byte for each character; None if they do not fit."""
    if shingle != 8 or len(line) < shingle:
        return None
    try:
        coded = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    found = np.ndarray(len(coded) - 7, "<u8", coded, strides=(1,)).copy()
    found.sort()
    fresh = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=fresh[1:])
    return found[fresh]


class _Exact:
    """Exact Jaccard similarity by sets of shingles, kept for lines met again up to a bound of characters."""

    def __init__(self, shingle: int, bound: int = 1 << 16) -> None:
        self.shingle, self.bound = shingle, bound
        self.known: dict[str, np.ndarray | None] = {}
        self.chars = 0

    def shingles(self, line: str) -> np.ndarray | None:
        if line in self.known:
            return self.known[line]
        found = _packed(line, self.shingle)
        if self.chars + len(line) > self.bound:
            self.known.clear()
            self.chars = 0
        if len(line) <= self.bound:
            self.known[line] = found
            self.chars += len(line)
        return found

    def jaccard(self, a: str, b: str) -> float:
        x, y = self.shingles(a), self.shingles(b)
        if x is None or y is None:
            return jaccard(a, b, self.shingle)
        each = np.concatenate([x, y])
        each.sort()
        both = int(np.count_nonzero(each[1:] == each[:-1]))
        return both / (len(each) - both)


def _not_blank(line: Column) -> Column:
    # From the left only: it stops at the first other character, while the end of a line is found by a pass over it.
    return F.ltrim(line, F.lit(_SPACES)) != ""


def sketches(lines: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of its distinct shingles, and the bitmap of their hashes."""
    hashes, owner = _shingles(lines, shingle)
    order = np.argsort(hashes, kind="stable")  # owners ascend, and do so among equal hashes
    hashes, owner = hashes[order], owner[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
    hashes, owner = _mix(hashes[fresh]), owner[fresh]
    bits = np.zeros((len(lines), _WORDS * 64), np.uint8)
    bits[owner, (hashes % np.uint64(_WORDS * 64)).astype(np.int64)] = 1
    return np.bincount(owner, minlength=len(lines)), np.packbits(bits, axis=1, bitorder="little").view("<i8")


def _sketched(shingle: int):
    def rows(names: list[int], lines: list[str]) -> pa.RecordBatch:
        n, words = sketches(lines, shingle)
        ones = np.bitwise_count(words.view(np.uint64)).sum(axis=1)
        columns = [np.array(names, np.int64), n, ones, *words.T]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["line", "n", "ones", *_BITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lines, chars = [], [], 0
            for name, line in zip(batch.column("line").to_pylist(), batch.column("text").to_pylist(), strict=True):
                names.append(name)
                lines.append(line)
                chars += len(line)
                if chars >= _CHARS:
                    yield rows(names, lines)
                    names, lines, chars = [], [], 0
            if lines:
                yield rows(names, lines)

    return run


def _may_reach(x: str, y: str, similarity: float) -> Column:
    """Whether two sketches allow this similarity: of a line's own bits, each stands for a shingle the other lacks."""
    at = lambda side, c: F.col(f"{side}.{c}")
    both = sum((F.bit_count(at(x, b).bitwiseAND(at(y, b))) for b in _BITS), F.lit(0))
    bound = similarity - 1e-9
    sizes = (at(x, "n") >= bound * at(y, "n")) & (at(y, "n") >= bound * at(x, "n"))
    # A line shares at most n - ones + both of its shingles, and all together are at least n plus the other's own bits.
    # Both sides are solved for the common bits, so that these are counted once a pair.
    ones = at(x, "ones") + at(y, "ones")
    least = F.greatest(*(bound * (at(s, "n") + ones - at(s, "ones")) - at(s, "n") + at(s, "ones") for s in (x, y)))
    return sizes & (both * F.lit(1 + bound) >= least)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows ``(a, b)`` of ``pairs`` whose lines are similar enough."""

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        exact = _Exact(shingle)
        for left, right in batches:
            yield pd.Series([exact.jaccard(a, b) >= similarity for a, b in zip(left, right, strict=True)], dtype=bool)

    # A centre is the first line of many pairs: joined last, these follow each other, and its shingles are made once.
    joined = pairs.join(texts.select(F.col("line").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("line").alias("a"), F.col("text").alias("text_a")), "a"
    )
    return joined.where(similar("text_a", "text_b")).select("a", "b")


def _lines(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """Rows ``(id, text_hash, number, line[, text])`` of all lines that are not blank."""
    # The text is hashed before its lines are rows, once for all of them.
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("whole"))
    split = F.posexplode(F.split("whole", "\n")).alias("number", "text")
    listed = hashed.select("id", "text_hash", split).where(_not_blank(F.col("text")))
    columns = ["id", "text_hash", "number", F.xxhash64("text").alias("line")]
    return listed.select(*columns, *(["text"] if keep_text else []))


def near_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """Rows ``(node, component)`` of the distinct lines that are similar to another one, named by XXH64."""
    banded = docs.select(F.col(text_col)).mapInArrow(_banded(shingle), "key long, line long")
    sorted_rows = banded.repartition("key").sortWithinPartitions("key", "line")
    shared = stored(sorted_rows.mapInArrow(_shared, "key long, line long"), "shared-keys")

    wanted = shared.select("line").distinct()
    all_lines = _lines(docs, id_col, text_col, keep_text=True).select("line", "text")
    texts = with_candidates(all_lines, wanted.select(F.col("line").alias("key")), F.col("line"))
    texts = stored(texts.dropDuplicates(["line"]).join(wanted, "line", "left_semi"), "line-texts")

    sketched = stored(texts.mapInArrow(_sketched(shingle), ", ".join(f"{c} long" for c in ("line", "n", "ones", *_BITS))), "line-sketches")

    # The line that meets most others is the best guess at what the lines of its keys derive from.
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    degrees = shared.join(sizes, "key").groupBy("line").agg(F.sum("n").alias("degree"))
    centres = shared.join(degrees, "line").groupBy("key").agg(F.max_by("line", "degree").alias("a"))
    stars = shared.withColumnRenamed("line", "b").join(centres, "key").where("a <> b").select("a", "b").distinct()
    likely = (
        stars.join(sketched.alias("x"), F.col("a") == F.col("x.line"))
        .join(sketched.alias("y"), (F.col("b") == F.col("y.line")) & _may_reach("x", "y", similarity)).select("a", "b")
    )
    likely = stored(likely, "line-pairs")
    links = stored(_verified(likely, texts, shingle, similarity), "line-links")
    labels = connected_components(links)

    named = shared.join(labels.withColumnRenamed("node", "line"), "line", "left").select(
        "key", "line", F.coalesce("component", "line").alias("component")
    )
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_keys = stored(named.join(mixed.select("key"), "key", "left_semi"), "open-keys")
    # At most a key for each band.
    all_keys = open_keys.groupBy("line").agg(F.collect_list("key").alias("keys"))
    open_rows = stored(open_keys.join(all_keys, "line").join(sketched, "line"), "open-lines")
    # Lines that share several keys are a pair of the smallest only.
    across = open_rows.alias("x").join(
        open_rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.line") < F.col("y.line"))
        & (F.col("x.component") != F.col("y.component")) & _may_reach("x", "y", similarity)
        & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")),
    ).select(F.col("x.line").alias("a"), F.col("y.line").alias("b"))
    known = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = across.join(known, ["a", "b"], "left_anti")
    more = stored(_verified(rest, texts, shingle, similarity), "line-links")
    if more.isEmpty():
        return labels
    return connected_components(links.unionByName(more))


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """Rows ``(id, text_hash, numbers)``: per document the lines, from 0, that a component keeps elsewhere.

    A component keeps its first line by document id, null last, then text hash and line number.
    """
    places = stored(_lines(docs, id_col, text_col, keep_text=False), "line-places")
    labels = near_lines(docs, id_col, text_col, shingle, similarity)
    placed = places.join(labels.withColumnRenamed("node", "line"), "line", "left").select(
        F.coalesce("component", "line").alias("component"),
        F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "number").alias("place"),
    )
    # Two rows repeated in whole have the same places and count as one document.
    kept = placed.groupBy("component").agg(F.min("place").alias("kept"), F.max("place").alias("last")).where("kept <> last")
    gone = placed.join(kept.select("component", "kept"), "component").where("place <> kept")
    return gone.groupBy(F.col("place.id").alias("id"), F.col("place.text_hash").alias("text_hash")).agg(
        F.collect_set("place.number").alias("numbers")
    )


def _without(text: Column, numbers: Column) -> Column:
    # The one-element array binds the split lines, which would be split again for every line that stays.
    kept = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), numbers)
    bound = F.array(F.struct(F.split(text, "\n").alias("lines"), kept.alias("kept")))
    return F.array_join(F.get(F.transform(bound, lambda b: F.transform(b["kept"], lambda i: F.get(b["lines"], i))), F.lit(0)), "\n")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, and two columns of ``counts``.

    Lines are split at ``\\n``; blank lines never count and stay where they are. Null
    texts stay null with no lines. Ids may be null or repeated; rows repeated in whole
    keep the same lines. The first count is that of lines that are not blank before the
    removal, the second that of lines taken out. Other columns are kept, whatever their
    names; ``docs`` must not have columns named as the counts.
    """
    gone = stored(repeated_lines(docs, id_col, text_col, shingle, similarity), "repeated-lines")
    rows = as_rows(docs)
    text = F.col("row")[text_col]
    joined = rows.join(
        gone, (F.xxhash64(text) == F.col("text_hash")) & F.col("row")[id_col].eqNullSafe(F.col("id")), "left",
    )
    changed = F.col("numbers").isNotNull()
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, "\n"), _not_blank)))
    kept = [F.when(changed, _without(text, F.col("numbers"))).otherwise(text) if c == text_col else F.col("row")[c] for c in docs.columns]
    return joined.select(
        *[column.alias(c) for column, c in zip(kept, docs.columns, strict=True)], n_lines.cast("long").alias(counts[0]),
        F.when(changed, F.size("numbers")).otherwise(0).cast("long").alias(counts[1]),
    )
