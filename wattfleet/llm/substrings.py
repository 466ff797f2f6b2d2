"""Removal of passages that repeat across documents, by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the smallest hash among its
runs of `_RUN` words. Consecutive windows of a document that share their minimiser
travel together, as one string of words, to the bucket of that minimiser; so a word is
sent about three times instead of `window` times. Equal windows have equal minimisers
and meet in one bucket, where sorting brings them together. Hashes sort; where two are
equal the words themselves are compared.

Identical strings within some megabytes of text are settled before they travel: all but
those of the smallest document are repeats already. So a passage that millions of
documents share sends one string for each such batch. The strings for one group of
buckets form one compressed block per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfleet.session import stored

WINDOW = 13
_RUN = 2
#: Bytes of text worked on at a time; longer texts are cut into parts that overlap by a window less one word.
_CHUNK = 1 << 19
_PART_WORDS = 50_000
#: Bytes of text whose strings are compared, and dealt in blocks, together.
_BATCH = 1 << 23
#: Bytes hashed at a time.
_HASHED = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LAST = np.iinfo(np.int64).max  # stands for a null id: larger than any other


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    ones = np.ones(n, np.uint64)
    ones[1:] = np.uint64(_BASE)
    back = np.ones(n, np.uint64)
    back[1:] = np.uint64(_INVERSE)
    return np.cumprod(ones, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


class Hasher:
    """Hashes of any stretch of a buffer from sums of its prefixes."""

    def __init__(self, buffer: bytes) -> None:
        data = np.frombuffer(buffer, np.uint8)
        up, self.down = _powers(max(_HASHED.bit_length(), (len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _word_hashes(buffer: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word of a buffer; sums of prefixes take eight times the bytes, so they are made for a stretch at a time."""
    hashes = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(int(np.searchsorted(end, start[a] + _HASHED, "right")), a + 1)
        at = int(start[a])
        hashes[a:b] = Hasher(buffer[at : int(end[b - 1])])(start[a:b] - at, end[a:b] - at)
        a = b
    return hashes


def _runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive ones."""
    n = len(hashes) - width + 1
    runs = hashes[:n].copy()
    for i in range(1, width):
        runs *= np.uint64(_BASE)
        runs += hashes[i : i + n]
    return _mix(runs)


def _words(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and line of each word of lines joined by newlines, words being joined by single spaces."""
    data = np.frombuffer(buffer, np.uint8)
    breaks = np.flatnonzero((data == 32) | (data == 10))
    start, end = np.r_[0, breaks + 1], np.r_[breaks, len(data)]
    return start, end, np.cumsum(np.r_[0, data[breaks] == 10])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    n, reach, out = len(values) - width + 1, 1, values
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[:n], out[width - reach : width - reach + n])


def _super_kmers(buffer: bytes, window: int) -> tuple[np.ndarray, ...]:
    """Line, first word, first byte, end byte and minimiser of each super-k-mer of the lines of a buffer."""
    start, end, line = _words(buffer)
    n = len(start) - window + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    least = _smallest(_runs(_word_hashes(buffer, start, end), _RUN), window - _RUN + 1)
    valid = line[:n] == line[window - 1 :]
    head = valid & np.r_[True, (least[1:] != least[:-1]) | ~valid[:-1]]
    first = np.flatnonzero(head)
    stop = np.flatnonzero(valid & np.r_[head[1:] | ~valid[1:], True])  # the last window of each
    of_line = np.searchsorted(line, np.arange(line[-1] + 1))
    return line[first], first - of_line[line[first]], start[first], end[stop + window - 1], least[first].view(np.int64)


def _cut(window: int, groups: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in parts(batch):
                held.append(part)
                size += len(part[3])
                if size >= _BATCH:
                    yield from blocks(held)
                    held, size = [], 0
        yield from blocks(held)

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
        for doc, text_hash, text in zip(*batch.columns[:3], strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            name = _LAST if doc.as_py() is None else doc.as_py()
            for at in range(0, max(len(words) - window + 1, 0), _PART_WORDS):
                yield name, text_hash.as_py(), at, b" ".join(words[at : at + _PART_WORDS + window - 1])

    def blocks(items: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        docs, hashes, starts, strings, keys = [], [], [], [], []
        part: list[tuple[int, int, int, bytes]] = []

        def collect() -> None:
            if not part:
                return
            buffer = b"\n".join(p[3] for p in part)
            line, word, a, b, key = _super_kmers(buffer, window)
            docs.append(np.array([p[0] for p in part], np.int64)[line])
            hashes.append(np.array([p[1] for p in part], np.int64)[line])
            starts.append(np.array([p[2] for p in part], np.int64)[line] + word)
            strings.extend([buffer[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            keys.append(key)
            part.clear()

        size = 0
        for item in items:
            part.append(item)
            size += len(item[3])
            if size >= _CHUNK:
                collect()
                size = 0
        collect()
        if not docs:
            return
        doc, text_hash, start, key = (np.concatenate(x) for x in (docs, hashes, starts, keys))
        # Of equal strings those of the smallest document travel; the others are repeats already.
        best: dict[bytes, int] = {}
        order = np.argsort(doc, kind="stable").tolist()
        of = np.fromiter((best.setdefault(strings[i], i) for i in order), np.int64, len(order))
        first = np.empty(len(order), np.int64)
        first[order] = of
        settled = doc > doc[first]
        travels = ~settled
        count = np.array([s.count(b" ") for s in strings], np.int64) + 1
        if settled.any():
            yield block(-1, doc[settled], text_hash[settled], start[settled], b"", count[settled])
        group = (_mix(key.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        places = np.flatnonzero(travels)
        places = places[np.argsort(group[places], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, np.diff(group[places]) != 0, True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = places[a:b]
            yield block(int(group[at[0]]), doc[at], text_hash[at], start[at], b"\n".join([strings[i] for i in at.tolist()]), count[:0])

    def block(group: int, doc, text_hash, start, text: bytes, count) -> pa.RecordBatch:
        numbers = np.concatenate([doc, text_hash, start, count]).astype(np.int64)
        if group < 0:  # settled rows meet nobody, so they go anywhere
            group = int(abs(doc[0] + start[0]) % groups)
        return pa.RecordBatch.from_arrays(
            [pa.array([group]), pa.array([len(doc)]), pa.array([zstandard.compress(numbers.tobytes(), 1)]), pa.array([zstandard.compress(text, 1)])],
            ["group", "rows", "numbers", "text"],
        )

    return run


def repeated_windows(text: bytes, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and number within it of each window, of lines joined by newlines, that a line of a smaller document has too."""
    start, end, line = _words(text)
    n = len(start) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(line[:n] == line[window - 1 :])
    a, b, owner = start[at], end[at + window - 1], doc[line[at]]
    hashes = _runs(_word_hashes(text, start, end), window)[at]
    order = np.lexsort((owner, hashes))
    same = np.r_[False, hashes[order][1:] == hashes[order][:-1]]
    members = np.flatnonzero(same | np.r_[same[1:], False])
    if not len(members):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, same = order[members], same[members]
    words = [text[x:y] for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True)]
    equal = np.fromiter((x == y for x, y in zip(words[1:], words, strict=False)), bool, len(words) - 1)
    if (same[1:] & ~equal).any():  # different words under one hash: sort by the words themselves
        by_words = sorted(range(len(words)), key=lambda i: (words[i], owner[order[i]]))
        order, words = order[by_words], [words[i] for i in by_words]
        same = np.r_[False, np.fromiter((x == y for x, y in zip(words[1:], words, strict=False)), bool, len(words) - 1)]
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    gone = np.sort(at[order[owner[order] > owner[order[heads]]]])
    first = np.searchsorted(line, np.arange(line[-1] + 1))
    return line[gone], gone - first[line[gone]]


def _counted(window: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for number in range(len(batch)):
                row = batch.slice(number, 1).to_pylist()[0]
                if row["group"] != group:
                    yield from ranges(held)
                    group, held = row["group"], []
                held.append(row)
        yield from ranges(held)

    def ranges(held: list[dict]) -> Iterator[pa.RecordBatch]:
        docs, hashes, starts, texts = [], [], [], []
        for row in held:
            numbers, n = np.frombuffer(zstandard.decompress(row["numbers"]), np.int64), row["rows"]
            doc, text_hash, start = numbers[:n], numbers[n : 2 * n], numbers[2 * n : 3 * n]
            if len(numbers) > 3 * n:
                yield out(doc, text_hash, start, start + numbers[3 * n :])
            else:
                docs.append(doc)
                hashes.append(text_hash)
                starts.append(start)
                texts.append(zstandard.decompress(row["text"]))
        if not docs:
            return
        doc, text_hash, start = (np.concatenate(x) for x in (docs, hashes, starts))
        line, number = repeated_windows(b"\n".join(texts), doc, window)
        if len(line):
            # Windows that follow each other in a line make one stretch of words.
            head = np.r_[True, (np.diff(line) != 0) | (np.diff(number) != 1)]
            last = np.r_[head[1:], True]
            rows = line[head]
            yield out(doc[rows], text_hash[rows], start[rows] + number[head], start[rows] + number[last] + window)

    def out(doc, text_hash, start, end) -> pa.RecordBatch:
        known = pa.array(doc, mask=doc == _LAST)
        return pa.RecordBatch.from_arrays([known, pa.array(text_hash), pa.array(start), pa.array(end)], ["id", "text_hash", "start", "end"])

    return run


def repeated_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows ``(id, text_hash, start, end)``: words covered by windows that also start in a document of a smaller id.

    Stretches of one document may touch or overlap.
    """
    spark = docs.sparkSession
    groups = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    blocks = listed.mapInArrow(_cut(window, groups), "group long, rows long, numbers binary, text binary")
    dealt = blocks.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_counted(window), "id long, text_hash long, start long, end long")


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
])


@F.pandas_udf(_RESULT)
def _without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for text, start, end in zip(texts, starts, ends, strict=True):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if start is None or not len(start):
            rows.append((len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")))
            continue
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, np.asarray(start), 1)
        np.add.at(edges, np.asarray(end), -1)
        stays = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
        rows.append((len(words), len(words) - len(stays), b" ".join([words[i] for i in stays]).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows ``(id, n_words, n_removed, kept)``, one for each row of ``docs``; ids are whole numbers.

    ``kept`` are the words left, joined by single spaces. Words are what white space of
    ASCII separates. Null texts have no words. A null id is larger than any other. Rows
    of one id do not count against each other. Other columns play no part.
    """
    found = stored(repeated_stretches(docs, id_col, text_col, window), "stretches")
    gathered = found.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("s")).select(
        "id", "text_hash", F.col("s.start").alias("starts"), F.col("s.end").alias("ends")
    )
    listed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    joined = listed.alias("d").join(
        gathered.alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.text_hash") == F.col("g.text_hash")), "left"
    )
    return joined.select(F.col("d.id").alias(id_col), _without("d.text", "g.starts", "g.ends").alias("r")).select(id_col, "r.*")
