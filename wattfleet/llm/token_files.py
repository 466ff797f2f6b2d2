"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are range-partitioned by id, so shards follow each other in the order of ids.
Within a shard, frequent pairs of neighbouring symbols are replaced by new symbols
(nonterminals), again and again, until no pair is frequent. A shard stores the rules, the
number of ids each expands to, the remaining sequence and, for every `_SAMPLE` symbols,
the place of the next one in the ids, so any stretch of ids is decoded without the rest.

A shard is one binary value of a table, so it lies on whatever file system Spark writes to:

    magic "RPG1" | uint32 documents, rules, symbols, first nonterminal | uint64 ids
    | int64 document ids | uint8 document id is null | uint32 ids per document
    | uint32 rules, two symbols each | uint32 expansion lengths | uint32 sequence | uint64 sampled places

All numbers are little-endian. A nonterminal is the first one plus the number of its rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfleet.llm.tokens import encoder, gathered
from wattfleet.session import shared_folder, stored

#: Ids of a shard; it ends with the document that fills it.
SHARD_IDS = 1 << 20
#: A pair is frequent from this count on in a shard: a rule takes 12 bytes and each use saves 4.
FREQUENT = 4
_SAMPLE = 128
_MAGIC = b"RPG1"


def _grouped(left: np.ndarray, right: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs as ascending codes, how often each occurs, and the places of all pairs in the order of their codes."""
    bits, wide = max(len(left) - 1, 1).bit_length(), n_symbols.bit_length()
    codes = left << wide
    codes |= right
    if 2 * wide + bits <= 63:  # a pair and its place fit one number, and numbers sort faster than places by numbers
        codes <<= bits
        codes |= np.arange(len(left))
        codes.sort()
        order = codes & ((1 << bits) - 1)
        codes >>= bits
    else:
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    pairs = codes[heads]
    return ((pairs >> wide) << 32) | (pairs & ((1 << wide) - 1)), np.diff(np.append(heads, len(codes))), order


class _Grammar:
    """Rules so far, and the pairs that get one in a round."""

    def __init__(self, first: int, frequent: int, kind: type) -> None:
        self.first, self.frequent, self.kind = first, frequent, kind
        self.rules, self.lengths, self.size = [], [np.ones(1, np.int64)], 0

    def weights(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair among the frequent ones, from 1 for the rarest; 0 for other pairs."""
        pairs, counts, order = _grouped(left.astype(np.int64), right.astype(np.int64), self.first + self.size)
        often = np.flatnonzero(counts >= self.frequent)
        often = often[np.argsort(counts[often], kind="stable")]
        ranks = np.zeros(len(pairs), self.kind)
        ranks[often] = np.arange(1, len(often) + 1)
        self.pairs = pairs[often]
        weight = np.empty(len(left), self.kind)
        weight[order] = np.repeat(ranks, counts)
        return weight

    def chosen(self, best: np.ndarray, weight: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places to replace and their new symbols, of those not beside a more frequent pair.

        ``same`` tells which places are beside the next one and hold the same pair.
        """
        on = np.flatnonzero(same & best[1:] & best[:-1]) + 1  # places that go on with a run, of which every second is taken
        number = np.arange(len(on))
        start = np.maximum.accumulate(np.where(np.diff(on, prepend=-1) > 1, number, 0))
        best[on[(number - start) % 2 == 0]] = False
        places = np.flatnonzero(best)
        weight = weight[places]
        worth = np.bincount(weight, minlength=len(self.pairs) + 1) >= self.frequent
        worth[0] = False
        taken = worth[weight]
        new, known = self.pairs[worth[1:]], np.concatenate(self.lengths)  # of ids first, then of rules
        left, right = new >> 32, new & 0xFFFFFFFF
        symbols = (np.cumsum(worth) - 1 + self.first + self.size).astype(self.kind)
        self.rules.append(np.stack([left, right], 1))
        self.lengths.append(known[np.maximum(left - self.first + 1, 0)] + known[np.maximum(right - self.first + 1, 0)])
        self.size += len(new)
        return places[taken], symbols[weight[taken]]


def re_pair(ids: np.ndarray, first: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules, their expansion lengths, and the sequence that is left.

    Each round counts pairs and replaces those frequent ones that are not beside a more
    frequent one; in a run of one symbol every second pair is taken. A pair that is rare
    stays so until one of its symbols is replaced, since each round makes symbols of its
    own. So the next round counts what is left of frequent pairs and the pairs with a new
    symbol only, until none is replaced. While these are many, a round passes over the
    whole sequence and closes it up; then replaced symbols leave holes.
    """
    n = len(ids)
    kind = np.int32 if first + n < 1 << 31 else np.int64
    grammar, seq = _Grammar(first, frequent, kind), ids.astype(kind)
    count = np.ones(max(n - 1, 0), bool)  # whether the pair that starts here is counted
    while 8 * np.count_nonzero(count) > n:
        at = np.flatnonzero(count)
        weight = np.zeros(n - 1, kind)
        weight[at] = grammar.weights(seq[at], seq[at + 1])
        count = weight > 0
        best = count.copy()
        best[1:] &= weight[1:] >= weight[:-1]
        best[:-1] &= weight[:-1] >= weight[1:]
        replaced, symbols = grammar.chosen(best, weight, weight[1:] == weight[:-1])
        if not len(replaced):
            count[:] = False
            break
        seq[replaced] = symbols
        count[replaced] = True
        count[np.maximum(replaced - 1, 0)] = True
        stays = np.ones(n, bool)
        stays[replaced + 1] = False
        seq, count = seq[stays], count[stays[:-1]]
        n = len(seq)
        count = count[: n - 1]

    stays, after, before = np.ones(n, bool), np.arange(1, n + 1), np.arange(-1, n - 1)
    at = np.flatnonzero(count)
    while len(at):
        weight = grammar.weights(seq[at], seq[after[at]])
        at, weight = at[weight > 0], weight[weight > 0]
        beside, best = after[at[:-1]] == at[1:], np.ones(len(at), bool)
        best[1:] &= ~beside | (weight[1:] >= weight[:-1])
        best[:-1] &= ~beside | (weight[:-1] >= weight[1:])
        places, symbols = grammar.chosen(best, weight, beside & (weight[1:] == weight[:-1]))
        if not len(places):
            break
        replaced = at[places]
        seq[replaced] = symbols
        gone = after[replaced]
        stays[gone] = False
        after[replaced] = following = after[gone]
        inner = following < n
        before[following[inner]] = replaced[inner]
        ahead = before[replaced]
        at = np.unique(np.concatenate([at, replaced, ahead[ahead >= 0]]))
        at = at[stays[at] & (after[at] < n)]
    if not grammar.size:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64), seq.astype(np.int64)
    return np.concatenate(grammar.rules), np.concatenate(grammar.lengths[1:]), seq[stays].astype(np.int64)


@dataclass
class Shard:
    """A shard's parts, read from its bytes without decoding."""

    docs: np.ndarray
    null: np.ndarray
    counts: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray
    places: np.ndarray
    first: int
    n_ids: int

    @classmethod
    def read(cls, data: bytes) -> Shard:
        if data[:4] != _MAGIC:
            raise ValueError("not a token shard")
        n_docs, n_rules, n_symbols, first = np.frombuffer(data, "<u4", 4, 4).tolist()
        (n_ids,) = np.frombuffer(data, "<u8", 1, 20).tolist()
        at, parts = 28, []
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", 2 * n_rules), ("<u4", n_rules), ("<u4", n_symbols),
                        ("<u8", -(-n_symbols // _SAMPLE))):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        docs, null, counts, rules, lengths, sequence, places = parts
        return cls(docs, null, counts, rules.reshape(-1, 2), lengths, sequence, places, first, n_ids)

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        sizes = np.ones(len(symbols), np.int64)
        inner = symbols >= self.first
        sizes[inner] = self.lengths[symbols[inner] - self.first]
        return sizes

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        sizes = self._sizes(symbols)
        places = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), "<u4")
        while len(symbols):
            inner = symbols >= self.first
            out[places[~inner]] = symbols[~inner]
            left, right = self.rules[symbols[inner] - self.first].astype(np.int64).T
            at = places[inner]
            symbols, places = np.concatenate([left, right]), np.concatenate([at, at + self._sizes(left)])
        return out

    def ids(self) -> np.ndarray:
        if int(self.lengths.sum(dtype=np.int64)) > self.n_ids:
            return self._expand(self.sequence)
        # Each rule is expanded once, and the symbols' stretches are gathered from the rules and the sequence itself.
        flat = self._expand(self.first + np.arange(len(self.rules)))
        ends = np.append(np.cumsum(self.lengths, dtype=np.int64), 0)
        starts = len(flat) + np.arange(len(self.sequence))
        inner = self.sequence >= self.first
        rule = self.sequence[inner] - self.first
        starts[inner] = ends[rule] - self.lengths[rule]
        return gathered(np.concatenate([flat, self.sequence]), starts, self._sizes(self.sequence))

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end``, from the symbols that hold them only."""
        start, end = max(start, 0), min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, "<u4")
        sample = int(np.searchsorted(self.places, start, "right")) - 1
        a, at = sample * _SAMPLE, int(self.places[sample])
        stop = int(np.searchsorted(self.places, end, "left"))
        b = min(stop * _SAMPLE, len(self.sequence))
        return self._expand(self.sequence[a:b])[start - at : end - at]


def write_shard(docs: list[int | None], coded: list[bytes], frequent: int = FREQUENT) -> bytes:
    """The bytes of a shard of documents, given the ids of each as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(coded), "<u4")
    first = int(ids.max()) + 1 if len(ids) else 0
    rules, lengths, seq = re_pair(ids, first, frequent)
    sizes = np.where(seq >= first, lengths[np.maximum(seq - first, 0)] if len(lengths) else 1, 1)
    places = (np.cumsum(sizes) - sizes)[::_SAMPLE]
    parts = [
        _MAGIC, np.array([len(docs), len(rules), len(seq), first], "<u4"), np.array([len(ids)], "<u8"),
        np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "u1"),
        np.array([len(c) // 4 for c in coded], "<u4"), rules.astype("<u4"), lengths.astype("<u4"), seq.astype("<u4"), places.astype("<u8"),
    ]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    shard_ids: int = SHARD_IDS, frequent: int = FREQUENT,
) -> str:
    """Writes the ids of all whole texts, each followed by ``end_id``, and returns the folder.

    Rows are in ascending order of their id, a whole number; null first, equal ids by
    text. A null text is empty. Rows of the table: ``(part, number, n_ids, shard)``;
    parts and the numbers in them are in the order of ids. Other columns play no part.
    """
    path = path or shared_folder(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, names, coded, size = TaskContext.get().partitionId(), 0, [], [], 0
        encode_all = encoder(tokenizer).encode_all

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([size], pa.int64()),
                pa.array([write_shard(names, coded, frequent)], pa.binary()),
            ], ["part", "number", "n_ids", "shard"])

        for batch in batches:
            for name, found in zip(batch.column("id").to_pylist(), encode_all(batch.column("text"), end_id), strict=True):
                names.append(name)
                coded.append(found)
                size += len(coded[-1]) // 4
                if size >= shard_ids:
                    yield shard()
                    number, names, coded, size = number + 1, [], [], 0
        if names:
            yield shard()

    listed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = listed.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(run, "part long, number long, n_ids long, shard binary").write.mode("overwrite").parquet(path)
    return path


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard.read(row["shard"])
            ids = shard.ids().tobytes()
            ends = np.cumsum(shard.counts.astype(np.int64))
            starts = ends - shard.counts
            n = len(ends)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["number"])), pa.array(shard.docs, mask=shard.null.astype(bool)),
                pa.array(starts), pa.array(shard.counts.astype(np.int64)),
                pa.array([ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
            ], ["part", "number", "id", "place", "n_tokens", "ids"])


def read_tokens(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows ``(id, start, n_tokens, ids)`` of the files below ``path``; ``start`` counts the ids before in all files."""
    table = spark.read.parquet(path)
    sizes = table.select("part", "number", "n_ids")
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.select("part", "number", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inside"))
    # One row for each task that wrote, so this window is small at any size.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    starts = inside.join(ahead, "part").select("part", "number", (F.col("ahead") + F.col("inside")).alias("first"))
    # As files of a known size: Spark broadcasts them below its threshold, and then the ids are not shuffled.
    starts = stored(starts, "shard-starts")
    rows = table.select("part", "number", "shard").mapInArrow(
        _decoded, "part long, number long, id long, place long, n_tokens long, ids binary"
    )
    return rows.join(starts, ["part", "number"]).select(
        F.col("id").alias(id_col), (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids"
    )
