"""Exact top-k by inner product over an impact-ordered index, score at a time.

The index is a table of blocks. In a block each dimension's values are quantised into
levels, and the vectors of a level are one posting segment. For a query the impact of a
segment is the least that its level adds above the dimension's lowest level. Segments are
processed by descending impact, in bands; a vector's sum so far bounds its score
from below, and with the largest impacts left, for as many dimensions as it has not been
met in, from above. Vectors whose upper bound falls short of the k-th best lower bound are
proven out. When the rest costs less to score than the postings left, they are scored
exactly from the stored vectors and the block is done.

Blocks are built where the rows lie. Queries go to blocks in chunks, on a grid of blocks
and chunks: a task holds a block and a chunk, both of bounded size, and each query's best
of all blocks meet in a ranked window that keeps k rows per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattfleet.session import stored

#: Components in a block of the index and in a chunk of queries, at most (a single vector may be longer).
BLOCK_COMPONENTS = 1 << 21
CHUNK_COMPONENTS = 1 << 16

LEVELS = 32
#: Impacts are processed down to these parts of a query's largest one, then all (0).
_FLOORS = (2, 4, 8, 0)
#: Queries whose segments are processed together.
_TOGETHER = 32
#: Runs of segments with fewer than this part of all vectors are processed by their postings.
_SCAN = 16

_BLOCK = "block long, ids array<{id}>, width int, kind string, vectors binary, lows binary, steps binary, places binary, starts binary"
_CHUNK = "chunk long, ids array<{id}>, width int, vectors binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it and its components are not null, and the components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def _packed(most: int, pack: Callable[[int, pa.Array, np.ndarray], pa.RecordBatch]):
    """Task that gathers rows ``(id, vector)`` until they hold ``most`` components and packs them, zeros behind short vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, pa.Array]] = []
        rows = width = 0

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([ids for ids, _ in held])
            lengths = np.concatenate([pc.list_value_length(v).to_numpy() for _, v in held])
            values = np.concatenate([v.flatten().to_numpy(zero_copy_only=False) for _, v in held])
            matrix = np.zeros((len(ids), width))
            matrix[np.arange(width) < lengths[:, None]] = values
            return pack(number, ids, matrix)

        for batch in batches:
            ids, vectors = batch.column("id"), batch.column("vector")
            at = 0
            while at < batch.num_rows:
                lengths = np.maximum.accumulate(pc.list_value_length(vectors.slice(at)).to_numpy())
                widths = np.maximum(np.maximum(lengths, width), 1)
                fits = int(np.searchsorted((rows + np.arange(1, len(widths) + 1)) * widths.astype(np.int64), most, "right"))
                if fits == 0 and rows:
                    yield flush()
                    held, rows, width, number = [], 0, 0, number + 1
                    continue
                fits = max(fits, 1)
                held.append((ids.slice(at, fits), vectors.slice(at, fits)))
                rows, width, at = rows + fits, max(width, int(lengths[fits - 1])), at + fits
        if rows:
            yield flush()

    return run


def _index_block(number: int, ids: pa.Array, matrix: np.ndarray) -> pa.RecordBatch:
    """Vectors, and for each dimension the places of all vectors by level with the start of every level."""
    n, width = matrix.shape
    lows = matrix.min(axis=0) if n else np.zeros(width)
    spans = (matrix.max(axis=0) if n else lows) - lows
    steps = np.maximum(1, np.ceil((spans + 1) / LEVELS))
    levels = np.minimum((matrix - lows) // steps, LEVELS - 1).astype(np.uint8).T
    places = np.argsort(levels, axis=1, kind="stable").astype("<u4")
    counts = np.array([np.bincount(row, minlength=LEVELS) for row in levels], "<i8").reshape(width, LEVELS)
    starts = np.concatenate([np.zeros((width, 1), "<i8"), np.cumsum(counts, axis=1)], axis=1)
    small = n == 0 or width == 0 or np.abs(matrix).max() < 2**15
    kind = "<i2" if small else "<f8"
    binary = [matrix.astype(kind), lows.astype("<f8"), steps.astype("<f8"), places, starts.astype("<i8")]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), pa.array([width], pa.int32()),
         pa.array([kind]), *[pa.array([b.tobytes()], pa.binary()) for b in binary]],
        ["block", "ids", "width", "kind", "vectors", "lows", "steps", "places", "starts"],
    )


def _query_chunk(number: int, ids: pa.Array, matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
         pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.astype("<f8").tobytes()], pa.binary())],
        ["chunk", "ids", "width", "vectors"],
    )


class Block:
    """A block of the index in memory."""

    def __init__(self, row: dict) -> None:
        self.ids, self.width = row["ids"], row["width"]
        self.n = n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(n, self.width)
        self.lows, self.steps = np.frombuffer(row["lows"], "<f8"), np.frombuffer(row["steps"], "<f8")
        self.places = np.frombuffer(row["places"], "<u4").reshape(self.width, n)
        self.starts = np.frombuffer(row["starts"], "<i8").reshape(self.width, LEVELS + 1)
        #: The level of each posting, and that of each vector.
        self.levels = np.array(
            [np.repeat(np.arange(LEVELS, dtype=np.uint8), np.diff(s)) for s in self.starts], np.uint8
        ).reshape(self.width, n)
        self.codes = np.empty_like(self.levels)
        np.put_along_axis(self.codes, self.places, self.levels, axis=1)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.order = np.empty(n, np.int64)  # place of each id among the block's, null last
        self.order[pc.array_sort_indices(self.ids).to_numpy()] = np.arange(n)

    def top(self, owns: pa.Array, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int]]]:
        """For each query the rows and exact scores of the k best vectors of another id; equal scores by id."""
        queries = queries[:, : self.width]
        others = [self._others(own) for own in owns]
        out = []
        for query, possible in zip(queries, self._possible(queries, others, k), strict=True):
            scores = self._exact(possible, query)
            if scores.dtype == object:
                best = sorted(range(len(scores)), key=lambda i: (-scores[i], self.order[possible[i]]))[:k]
            else:
                best = np.lexsort((self.order[possible], -scores))[:k]
            out.append((possible[best], [max(min(int(s), 2**63 - 1), -(2**63)) for s in scores[best]]))
        return out

    def _others(self, own: pa.Scalar) -> np.ndarray:
        same = pc.is_null(self.ids) if not own.is_valid else pc.fill_null(pc.equal(self.ids, own), False)
        return ~same.to_numpy(zero_copy_only=False)

    def _exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        vectors = self.vectors[rows, : len(query)]
        if self._fits(query, 2**62):
            return vectors.astype(np.int64) @ query.astype(np.int64)
        whole = np.vectorize(int, otypes=[object])
        return whole(vectors) @ whole(query) if vectors.size else np.zeros(len(rows), object)

    def _fits(self, queries: np.ndarray, most: float) -> bool:
        width = queries.shape[-1]
        return (self.largest + 1) * float(np.abs(queries).max(initial=0)) * (width + 1) * 4 < most

    def _possible(self, queries: np.ndarray, others: list[np.ndarray], k: int) -> list[np.ndarray]:
        """For each query the rows that may be among its k best; all others are proven not to be."""
        found = [np.flatnonzero(o) for o in others]
        bits = queries.shape[1].bit_length()
        able = [i for i, o in enumerate(found) if len(o) > k and queries[i].any()]
        if not able or not self._fits(queries, 2.0 ** (61 - bits) / LEVELS):
            return found
        asked = queries[able].astype(np.int64)
        weight = np.abs(asked) * self.steps[: asked.shape[1]].astype(np.int64)
        slack = (weight - np.abs(asked)).sum(axis=1)
        rising, weighted = asked > 0, weight > 0
        highest = weight.max(axis=1) * (LEVELS - 1)
        small = int(weight.sum(axis=1).max()) * LEVELS << bits < 2**31
        # For each vector and query: the lower bound above all dimensions' lowest, and behind it the dimensions met.
        sums = np.zeros((self.n, len(able)), np.int32 if small else np.int64)
        done = np.where(weighted, LEVELS, 1)  # per dimension the lowest level processed, counted towards larger scores
        for share in _FLOORS:
            floor = highest[:, None] // share if share else np.zeros((len(able), 1), np.int64)
            down_to = np.minimum(np.clip(-(-floor // np.maximum(weight, 1)), 1, LEVELS), done)
            for d in np.flatnonzero((down_to < done).any(axis=0)).tolist():
                self._process(d, down_to[:, d], done[:, d], rising[:, d], weight[:, d], bits, sums)
            done = down_to
            unmet_all = weighted.sum(axis=1)
            rests = np.cumsum(-np.sort(-(done - 1) * weight, axis=1), axis=1)  # the largest impacts left, summed
            for j, i in enumerate(able):
                everyone = np.flatnonzero(others[i])
                column = sums[everyone, j].astype(np.int64)
                lower, met = column >> bits, column & ((1 << bits) - 1)
                enough = np.partition(lower, len(lower) - k)[len(lower) - k]
                upper = lower + slack[j] + np.append(0, rests[j])[unmet_all[j] - met]
                found[i] = everyone[upper >= enough]
            left = [self._left(done[j], rising[j], weighted[j]) for j in range(len(able))]
            if all(len(found[i]) * int(unmet_all[j]) <= left[j] for j, i in enumerate(able)):
                break
        return found

    def _left(self, done: np.ndarray, rising: np.ndarray, weighted: np.ndarray) -> int:
        """Postings of a query that are not processed yet."""
        starts = self.starts[: len(done)]
        dims = np.arange(len(done))
        below, above = starts[dims, done], self.n - starts[dims, LEVELS - done]
        return int(np.where(rising, below, above)[weighted].sum())

    def _process(self, d: int, low: np.ndarray, high: np.ndarray, rising: np.ndarray, weight: np.ndarray, bits: int, sums: np.ndarray) -> None:
        """Adds the impacts of a dimension's segments between two levels, for each query its own.

        Short runs of segments go by their postings; runs with a good share of all vectors by the vectors' level codes,
        all queries at once.
        """
        first = np.where(rising, low, LEVELS - high)
        last = np.where(rising, high, LEVELS - low)
        sizes = np.where(low < high, self.starts[d, last] - self.starts[d, first], 0)
        levels = np.arange(LEVELS)[:, None]
        towards = np.where(rising, levels, LEVELS - 1 - levels)
        adds = np.where((towards >= low) & (towards < high), (towards * weight << bits) + 1, 0).astype(sums.dtype)
        if sizes.sum() * _SCAN < sums.size:
            for j in np.flatnonzero(sizes).tolist():
                run = slice(self.starts[d, first[j]], self.starts[d, last[j]])
                sums[self.places[d, run], j] += adds[self.levels[d, run], j]
        else:
            sums += adds.take(self.codes[d], axis=0)


def build_index(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The blocks of an impact-ordered index over all rows whose vector is usable (see `search`), stored."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    id_type = vectors.schema[id_col].dataType.simpleString()
    return stored(rows.mapInArrow(_packed(BLOCK_COMPONENTS, _index_block), _BLOCK.format(id=id_type)), "impact-index")


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Rows ``(query_id, rank, id, score)``: for each query row the ``k`` rows of the index with the largest
    inner product, without those of the query's own id; equal scores go by id, null last.

    Vectors hold whole numbers, as longs or doubles; a null vector and one with a null or
    non-finite component take no part. A shorter vector counts as filled up with zeros, an
    empty one scores zero. Every query row is a query of its own, so repeated rows give
    repeated results; repeated rows of the index are rows of their own. Scores are exact and
    held at the ends of a long where they pass them. Other columns play no part. An empty
    index or no queries give no rows.
    """
    rows = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    id_type = queries.schema[id_col].dataType.simpleString()
    chunks = stored(rows.mapInArrow(_packed(CHUNK_COMPONENTS, _query_chunk), _CHUNK.format(id=id_type)), "queries")
    n_blocks, n_chunks = max(index.count(), 1), max(chunks.count(), 1)
    cells = min(n_blocks * n_chunks, 20_000)

    def on_grid(df: DataFrame, number: str, own: int, other: int, first: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64(number), F.lit(own))
        theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))).alias("_other")
        spread = df.select("*", mine.alias("_own"), theirs)
        i, j = ("_own", "_other") if first else ("_other", "_own")
        return spread.withColumn("cell", F.struct(F.col(i).alias("i"), F.col(j).alias("j"))).drop("_own", "_other").repartition(cells, "cell")

    def meet(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for b in range(blocks.num_rows):
            row = {c: blocks.column(c)[b] for c in blocks.column_names if c != "cell"}
            block = Block({c: v.values if c == "ids" else v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for c, v in row.items()})
            for c in range(chunks.num_rows):
                ids, width = chunks.column("ids")[c].values, chunks.column("width")[c].as_py()
                asked = np.frombuffer(chunks.column("vectors")[c].as_buffer(), "<f8").reshape(len(ids), width)
                number = chunks.column("chunk")[c].as_py()
                for start in range(0, len(asked), _TOGETHER):
                    part = slice(start, start + _TOGETHER)
                    for at, (found, scores) in enumerate(block.top(ids[part], asked[part], k), start):
                        out[0] += [number] * len(found)
                        out[1] += [at] * len(found)
                        out[2] += [ids[at].as_py()] * len(found)
                        out[3] += block.ids.take(pa.array(found, pa.int64())).to_pylist()
                        out[4] += scores
        kinds = [pa.int64(), pa.int64(), kind_of(chunks), kind_of(blocks), pa.int64()]
        return pa.table([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["chunk", "at", "query_id", "id", "score"])

    def kind_of(table: pa.Table) -> pa.DataType:
        return table.schema.field("ids").type.value_type

    index_type = index.schema["ids"].dataType.elementType.simpleString()
    best = (
        on_grid(index, "block", n_blocks, n_chunks, True).groupBy("cell")
        .cogroup(on_grid(chunks, "chunk", n_chunks, n_blocks, False).groupBy("cell"))
        .applyInArrow(meet, f"chunk long, at long, query_id {id_type}, id {index_type}, score long")
    )
    order = Window.partitionBy("chunk", "at").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
