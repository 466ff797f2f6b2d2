"""Packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are cut at multiples of its length; each such piece
fills a sequence. The remainders are packed by first-fit decreasing: the largest first,
each into the first sequence with room, which a tournament tree over the sequences' free
space finds in logarithmic time. Documents are dealt into groups by a hash, in
proportion to the corpus, and every group is packed by itself, so a group's size does
not grow with the corpus and sequences differ in length of documents only by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.tokens import encoder

CAPACITY = 4096
#: Characters of text in a group, on average.
GROUP_CHARS = 8_000_000

_FIELDS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Bins:
    """Open sequences under a tournament tree: each inner node holds the most free space below it."""

    def __init__(self, most: int, capacity: int) -> None:
        self.size = 1 << max(most - 1, 0).bit_length()
        self.free = [capacity] * (2 * self.size)

    def first_fit(self, length: int) -> int:
        """Takes ``length`` from the first bin with room and returns the bin; one bin per item is enough."""
        free, node = self.free, 1
        while node < self.size:
            node *= 2
            if free[node] < length:
                node += 1
        free[node] -= length
        found = node - self.size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """The bin and the offset in it for each length; equal lengths are taken in the given order."""
    bins, filled = Bins(len(lengths), capacity), {}
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = bins.first_fit(lengths[i])
        placed[i] = (b, filled.get(b, 0))
        filled[b] = placed[i][1] + lengths[i]
    return placed


def pack_group(tokens: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of the documents with these token counts."""
    rest = [n % capacity for n in tokens]
    some = [i for i, r in enumerate(rest) if r]
    placed = dict(zip(some, first_fit_decreasing([rest[i] for i in some], capacity), strict=True))
    following = max((b for b, _ in placed.values()), default=-1) + 1
    pieces = []
    for i, n in enumerate(tokens):
        for start in range(0, n - rest[i], capacity):
            pieces.append((i, start, capacity, following, 0))
            following += 1
        if rest[i]:
            pieces.append((i, n - rest[i], rest[i], *placed[i]))
    return pieces


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, group_chars: int = GROUP_CHARS,
) -> DataFrame:
    """Rows ``(id, start, length, ids, doc_tokens, sequence_id, offset)``, one for each piece.

    ``tokenizer`` is a vocabulary file of the tokenizers library. A document's tokens are
    those of its whole text and ``end_id``; a null text is empty and has that one token.
    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers. Pieces of a
    sequence follow each other from offset 0 without gaps; ``padded_length`` gives its
    length with padding. A null id stays null, repeated rows are packed each on their
    own, other columns play no part. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = docs.agg(F.sum(F.length(text) + 4)).first()[0] or 0
    groups = max(1, -(-chars // group_chars))
    dealt = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(groups)).alias("group")
    )
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer).encode_all
        group, ids, coded = -1, [], []

        def packed() -> pa.RecordBatch:
            pieces = pack_group([len(c) // 4 for c in coded], capacity)
            names = pa.array(ids).take(pa.array([p[0] for p in pieces], pa.int64()))
            return pa.RecordBatch.from_arrays([
                names,
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([coded[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in pieces], pa.binary()),
                pa.array([len(coded[p[0]]) // 4 for p in pieces], pa.int64()),
                pa.array([(group << 32) + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ], [id_col, *[f.split()[0] for f in _FIELDS.split(", ")]])

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            names, numbers = batch.column("id").to_pylist(), batch.column("group").to_pylist()
            for name, number, found in zip(names, numbers, encode_all(batch.column("text"), end_id), strict=True):
                if number != group:
                    if coded:
                        yield packed().cast(_with_id(kind, id_col))
                    group, ids, coded = number, [], []
                ids.append(name)
                coded.append(found)
        if coded:
            yield packed().cast(_with_id(kind, id_col))

    ordered = dealt.repartition("group").sortWithinPartitions("group", "id", "text")
    return ordered.mapInArrow(run, f"`{id_col}` {id_type}, {_FIELDS}")


def _with_id(kind: pa.DataType, name: str) -> pa.Schema:
    types = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kind), *[(n, types[t]) for n, t in (f.split() for f in _FIELDS.split(", "))]])


def padded_length(tokens, capacity: int = CAPACITY):
    """Length with padding of a sequence of so many tokens: a power of two stays, all others go to ``capacity``."""
    return F.when(F.bit_count(tokens) == 1, tokens).otherwise(F.lit(capacity))
