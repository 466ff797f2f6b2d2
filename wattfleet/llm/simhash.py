"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance d share a variant within d/2 of both, so every
fingerprint emits all its variants within half the radius and equal variants meet
in a shuffle. An odd radius leaves one bit over: one of four blocks of 16 bits is
left out in turn. Of three differing bits some block holds one, and the other two
lie in the rest, where variants at distance one meet. That is 4 * 49 variants of 48
bits, against 2,081 for a ball of radius two.

Rows that meet under one variant need no list of pairs:

- equal in the left-out block: at most two bits apart, one link to the first of them;
- one bit apart in the block: at most three bits apart, one link per pair of block values;
- equal in the rest: linked where the block differs in three bits.

A bucket is bounded by geometry: 49 * 2**16 distinct fingerprints can share a variant,
whatever the table's size. Copies never meet here, since fingerprints are made
distinct by a partial aggregate before variants are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.llm.components import connected_components
from wattfleet.llm.rows import as_rows
from wattfleet.session import stored

SEED = 42
_BLOCK = 16
_BLOCKS = 64 // _BLOCK
_REST = 64 - _BLOCK
_REST_MASK = (1 << _REST) - 1
_FLIP_1 = np.array([1 << i for i in range(_BLOCK)], np.int64)
_FLIP_3 = np.array([sum(1 << i for i in c) for c in combinations(range(_BLOCK), 3)], np.int64)
_CHUNK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        line = b" ".join(words)
        starts = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]
        digest = xxhash.xxh64_intdigest
        n = len(words) - shingle + 1
        hashes = np.fromiter(
            (digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:], strict=False)), np.uint64, n
        )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column | str, shingle: int = 3) -> Column:
    """Fingerprint of a text column as a signed long: majority bits of the XXH64 of its word shingles.

    Upper-case ASCII letters are lowered; words are separated by ASCII white space.
    A text of fewer words than a shingle is one shingle; a null text or one without
    words has the fingerprint zero.
    """

    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return compute(F.col(text) if isinstance(text, str) else text)


def _variants(distinct: DataFrame, radius: int) -> DataFrame:
    """Rows ``(key, fp)``: every variant of each fingerprint within half the radius."""
    fp = F.col("fp")
    if radius % 2 == 0:
        flips = [0] + ([1 << i for i in range(63)] + [-(1 << 63)] if radius else [])
        return distinct.select(F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip"), "fp").select(
            fp.bitwiseXOR(F.col("flip")).alias("key"), "fp"
        )
    # Turned so that the left-out block is on top, where its number takes its place.
    rests = []
    for b in range(_BLOCKS):
        turn = b * _BLOCK + _BLOCK
        turned = F.shiftrightunsigned(fp, turn).bitwiseOR(F.shiftleft(fp, 64 - turn)) if turn < 64 else fp
        rests.append(turned.bitwiseAND(F.lit(_REST_MASK)).bitwiseOR(F.lit(b << _REST)))
    flips = [0] + ([1 << i for i in range(_REST)] if radius > 1 else [])
    return (
        distinct.select(F.explode(F.array(*rests)).alias("rest"), "fp")
        .select(F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip"), "rest", "fp")
        .select(F.col("rest").bitwiseXOR(F.col("flip")).alias("key"), "fp")
    )


def _rest(fps: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The 48 bits outside a block, in the order `_variants` puts them."""
    u, s = fps.view(np.uint64), (block * _BLOCK + _BLOCK).astype(np.uint64)
    turned = np.where(s < 64, (u >> (s % np.uint64(64))) | (u << ((np.uint64(64) - s) % np.uint64(64))), u)
    return (turned & np.uint64(_REST_MASK)).view(np.int64)


def _link_buckets(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within complete buckets, given as sorted keys with their fingerprints."""
    fresh = np.r_[True, key[1:] != key[:-1]]
    shared = ~(fresh & np.r_[fresh[1:], True])
    key, fp = key[shared], fp[shared]
    none = np.zeros(0, np.int64)
    if not len(key):
        return none, none
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    if radius % 2 == 0:
        first = fp[np.searchsorted(group, group)]
        return fp, first
    block = (key.view(np.uint64) >> np.uint64(_REST)).astype(np.int64)
    value = ((fp.view(np.uint64) >> (block * _BLOCK).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64)
    cell = (group << _BLOCK) | value
    order = np.argsort(cell, kind="stable")
    cell, fp, rest_of_key = cell[order], fp[order], key[order] & _REST_MASK
    cells, at = np.unique(cell, return_index=True)
    first = fp[at]
    left, right = [fp], [first[np.searchsorted(cells, cell)]]

    def meet(cells: np.ndarray, first: np.ndarray, flips: np.ndarray) -> None:
        for flip in flips:
            other = cells ^ flip
            place = np.minimum(np.searchsorted(cells, other), len(cells) - 1)
            hit = (cells[place] == other) & (cells < other)
            left.append(first[hit])
            right.append(first[place[hit]])

    meet(cells, first, _FLIP_1)
    if radius == 3:
        centre = _rest(fp, block[order]) == rest_of_key
        same = np.unique(cell[centre], return_index=True)
        several = np.isin(same[0] >> _BLOCK, (same[0] >> _BLOCK)[1:][np.diff(same[0] >> _BLOCK) == 0])
        if several.any():
            meet(same[0][several], fp[centre][same[1]][several], _FLIP_3)
    a, b = np.concatenate(left), np.concatenate(right)
    return a, b


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _link_buckets(key, fp, radius)
            low, high = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack([low, high], 1)[low != high], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(key) < _CHUNK:
                continue
            cut = np.searchsorted(key, key[-1])  # the last bucket may go on in the next batch
            if cut:
                yield links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield links(key, fp)

    return link


def near_links(fingerprints: DataFrame, column: str = "fp", max_distance: int = 3) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``max_distance`` bits (0 to 3)."""
    if max_distance not in range(4):
        raise ValueError("max_distance must be 0 to 3")
    distinct = fingerprints.select(F.col(column).alias("fp")).where("fp is not null").distinct()
    variants = _variants(distinct, max_distance).repartition("key").sortWithinPartitions("key")
    return variants.mapInArrow(_linker(max_distance), "a long, b long").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_distance: int) -> DataFrame:
    """Rows ``(id, text_hash, fp, root, component_id)``, one for each row of ``docs``."""
    prints = stored(
        docs.select(
            F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
            fingerprint(F.col(text_col), shingle).alias("fp"),
        ),
        "fingerprints",
    )
    by_print = prints.groupBy("fp").agg(F.min("id").alias("smallest"))
    links = stored(near_links(by_print, "fp", max_distance), "near-links")
    labels = connected_components(links)
    rooted = by_print.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "smallest", F.coalesce("component", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(smallest, "root"), "fp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3
) -> DataFrame:
    """Rows ``(id, fingerprint, component_id)``, one for each row of ``docs``.

    ``fingerprint`` is a signed long, ``component_id`` the smallest id reachable over
    links of at most ``max_distance`` differing bits, the row's own included. Null
    texts and texts without words have the fingerprint zero. A null id takes part and
    counts as larger than any other; a component of null ids only has a null id.
    Repeated rows stay repeated. Other columns of ``docs`` play no part.
    """
    return _classes(docs, id_col, text_col, shingle, max_distance).select(
        F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3
) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: the one with the smallest id.

    A null id counts as the largest. Of several rows with that id one stays, chosen by
    the values of all its columns. All columns of ``docs`` are kept.
    """
    found = _classes(docs, id_col, text_col, shingle, max_distance)
    rows = found.groupBy("root", "id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    place = F.struct(F.col("id").isNull(), "id", "text_hash", "rows")
    kept = rows.groupBy("root").agg(F.min(place).alias("k")).select(
        F.col("k.id").alias("_kept_id"), F.col("k.text_hash").alias("_kept_hash"), F.col("k.rows").alias("_rows")
    )
    kept = stored(kept, "kept")
    rows = as_rows(docs)
    same = (F.xxhash64(F.col("row")[text_col]) == F.col("_kept_hash")) & F.col("row")[id_col].eqNullSafe(F.col("_kept_id"))
    single = rows.join(kept.where("_rows = 1"), same, "left_semi")
    # Rows repeated with id and text are told apart by their other columns.
    repeated = rows.join(kept.where("_rows > 1"), same).groupBy("_kept_id", "_kept_hash").agg(
        F.min_by("row", F.to_json("row")).alias("row")
    ).select("row")
    return single.unionByName(repeated).select("row.*")
