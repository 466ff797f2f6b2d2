"""Repair of the turn structure of conversations at the least cost.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows may be kept (K, free),
given another role (R, 2), deleted (D, 3; blank rows and repetitions must be) and empty
rows inserted (I, 2); a truncated row that is not deleted costs 1. Of the cheapest edit
sequences the one with the ASCII-least initials, the audit, is taken.

The edits are paths through nodes ``(rows consumed, state)``. A cost-to-go DP finds the
optimal arcs. Each optimal arc is ranked by the audit that starts with it, of length one,
two, four and so on: the rank for twice the length is that of the pair (own rank, rank of
the arc behind the path so far), and pointers double with it. The least arc at the first
node opens the least path, whose steps are read off the doubled pointers.

Rows are put in order by a range partitioning, so a long conversation lies in pieces in
many tasks. A piece with neighbours is first summed up by its costs between all pairs of
states; costs-to-go and states are then handed along a conversation's pieces, a few
numbers each, and every piece is solved by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.operators.cooldown import group_starts
from wattfleet.session import stored

_WHITE = r"\x20\x09-\x0D"
_INF = 1 << 58

# States: at the start, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a rerole or an insertion leads to.
_NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state that keeping a row of a kind leads to; -1: not allowed.
MUST_GO, IS_S, IS_U, IS_A, IS_OTHER = range(5)
_KEEP = np.full((5, 4), -1)
_KEEP[IS_S, START] = SYSTEM
_KEEP[IS_U, [START, SYSTEM, ASSISTANT]] = USER
_KEEP[IS_A, USER] = ASSISTANT
_ACCEPT = np.array([0, 4, 2, 0])  # cost to an accepted end: insertions of what is missing

_D, _I, _K, _R = range(4)
_LETTERS = np.frombuffer(b"DIKR", np.uint8)
_ROLES = {USER: "user", ASSISTANT: "assistant"}

_PIECE = "conversation {c}, part long, no long, alone boolean, turns array<{t}>, roles array<string>, digests array<binary>, copies array<long>, kinds array<int>, cut array<int>, initials array<string>"
_EDIT = "action string, step long, turn {t}, old_role string, digest binary, role string"


def judged(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for all copies of a row, with ``copies``, its first fault and its kind for the edits.

    Copies are counted before anything moves, and a repetition is told by the smallest turn
    of its role and text, so neither needs the rows of a conversation in one task.
    """
    named = rows.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    counted = named.groupBy("conversation", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = counted.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("_place", F.struct(F.col("turn").isNotNull().alias("some"), "turn"))
    # Nulls inside a struct compare as equal.
    same = F.struct("conversation", "role", "digest")
    first = keyed.groupBy(same.alias("_same")).agg(F.min("_place").alias("_first"))
    blank = ~F.col("text").rlike(f"[^{_WHITE}]")
    initial = F.substring("role", 1, 1)
    late = F.col("_place") > F.col("_first")
    cut = F.col("text").rlike(rf"[^.!?{_WHITE}][{_WHITE}]*+\z")
    fault = F.when(blank, "blank").when(late, "duplicate").when(cut, "truncated")
    kind = (
        F.when(blank | late, MUST_GO).when(initial == "s", IS_S).when(initial == "u", IS_U).when(initial == "a", IS_A).otherwise(IS_OTHER)
    )
    joined = keyed.withColumn("_same", same).join(first, "_same")
    return joined.select(
        "conversation", "turn", "role", "text", "digest", "copies", fault.alias("fault"), kind.alias("kind"),
        (cut & ~blank & ~late).cast("int").alias("cut"), initial.alias("initial"),
    )


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows as pieces: the rows of one conversation in a batch. Only the first and the last may have neighbours."""
    part, no, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, last = group_starts(batch, ["conversation"], last)
        starts = np.unique(np.append(0, starts))
        offsets = pa.array(np.append(starts, batch.num_rows), pa.int32())
        alone = np.ones(len(starts), bool)
        alone[[0, -1]] = False
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("turn", "role", "digest", "copies", "kind", "cut", "initial")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conversation").take(pa.array(starts)), pa.array(np.full(len(starts), part)), pa.array(no + np.arange(len(starts))),
             pa.array(alone), *lists],
            ["conversation", "part", "no", "alone", "turns", "roles", "digests", "copies", "kinds", "cut", "initials"],
        )
        no += len(starts)


class Paths:
    """The nodes of a batch of pieces: for each piece one more than it has rows, four states each."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.n = pc.list_value_length(batch.column("kinds")).to_numpy().astype(np.int64)
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.kind, self.cut, self.more = flat("kinds"), flat("cut"), flat("copies") - 1
        self.row0 = np.cumsum(self.n) - self.n
        self.node0 = self.row0 + np.arange(len(self.n))
        self.rows = len(self.kind)
        #: The node before each row.
        self.node = np.arange(self.rows) + np.repeat(np.arange(len(self.n)), self.n)

    def costs(self, right: np.ndarray) -> np.ndarray:
        """Cost to go at each node and state, given that at the right edge of each piece."""
        dist = np.zeros((self.rows + len(self.n), 4), np.int64)
        dist[self.node0 + self.n] = right
        order = np.argsort(-self.n, kind="stable")
        longest = self.n[order]
        for t in range(int(longest[0]) if len(longest) else 0):
            now = order[: np.searchsorted(-longest, -t, side="left")]  # pieces of more than t rows, all in step
            row, node = self.row0[now] + self.n[now] - 1 - t, self.node0[now] + self.n[now] - 1 - t
            after = dist[node + 1]
            here = 3 + after
            cut, free = self.cut[row][:, None], (self.kind[row] != MUST_GO)[:, None]
            here = np.minimum(here, np.where(free, 2 + cut + after[:, _NEXT], _INF))
            to = _KEEP[self.kind[row]]
            here = np.minimum(here, np.where(to >= 0, cut + np.take_along_axis(after, np.maximum(to, 0), 1), _INF))
            here += 3 * self.more[row][:, None]
            # Insertions: a user row and an assistant row lead to each other's place.
            u, a = np.minimum(here[:, USER], here[:, ASSISTANT] + 2), np.minimum(here[:, ASSISTANT], here[:, USER] + 2)
            here[:, USER], here[:, ASSISTANT] = u, a
            here[:, START], here[:, SYSTEM] = np.minimum(here[:, START], u + 2), np.minimum(here[:, SYSTEM], u + 2)
            dist[node] = np.minimum(here, _INF)
        return dist

    def arcs(self, dist: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, ...]:
        """Optimal arcs ``(from, label, to, row)``, nodes and states as one number, by start and label."""
        parts = []
        state = np.arange(4)
        here, after = dist[self.node], dist[self.node + 1]
        more, cut, free = 3 * self.more[:, None], self.cut[:, None], (self.kind != MUST_GO)[:, None]
        start = self.node[:, None] * 4 + state

        def add(mask: np.ndarray, label: int, source: np.ndarray, target: np.ndarray, row: np.ndarray) -> None:
            at = np.nonzero(mask)
            parts.append((source[at], np.full(len(at[0]), label), target[at], row[at]))

        rows = np.repeat(np.arange(self.rows)[:, None], 4, axis=1)
        add(3 + more + after == here, _D, start, start + 4, rows)
        add(free & (2 + cut + more + after[:, _NEXT] == here), _R, start, start - state + 4 + _NEXT, rows)
        to = _KEEP[self.kind]
        kept = np.take_along_axis(after, np.maximum(to, 0), 1) if self.rows else after
        add((to >= 0) & (cut + more + kept == here), _K, start, start - state + 4 + to, rows)
        nodes = np.arange(len(dist))
        inside = np.ones(len(dist), bool)
        inside[(self.node0 + self.n)[~final]] = False  # insertions at an inner edge belong to the next piece
        source = nodes[:, None] * 4 + state
        add(inside[:, None] & (2 + dist[:, _NEXT] == dist), _I, source, source - state + _NEXT, np.full((len(dist), 4), -1))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort((columns[1], columns[0]))
        return tuple(c[order] for c in columns)

    def least(self, dist: np.ndarray, final: np.ndarray) -> LeastPaths:
        return LeastPaths(len(dist) * 4, *self.arcs(dist, final))


class LeastPaths:
    """Least audits over optimal arcs, by ranks of power-of-two lengths and doubled pointers."""

    def __init__(self, places: int, source: np.ndarray, label: np.ndarray, target: np.ndarray, row: np.ndarray) -> None:
        self.label, self.target, self.row = label, target, row
        end = len(label)  # stands for the end of a path
        rank = np.append(label + 1, 0)
        pointer = np.append(self._least_at(places, source, rank)[target], end)
        self.length = np.append(np.ones(end, np.int64), 0)
        self.pointers = []
        while (pointer != end).any():
            self.pointers.append(pointer)
            self.length = self.length + self.length[pointer]
            rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
            pointer = pointer[pointer]
        self.first = self._least_at(places, source, rank)

    @staticmethod
    def _least_at(places: int, source: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The arc of least rank at each place; labels at a place differ, so one is least from the first rank on."""
        end = len(source)
        order = np.lexsort((rank[:end], source))
        heads = order[np.flatnonzero(np.append(True, np.diff(source[order]) > 0))] if end else order
        first = np.full(places, end)
        first[source[heads]] = heads
        return first

    def read(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs on the least paths from some places, one after the other, and each path's length."""
        first = self.first[places]
        lengths = self.length[first]
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(first, lengths)
        for k, pointer in enumerate(self.pointers):
            at = np.where(step >> k & 1, pointer[at], at)
        return at, lengths


def _slices(batch: pa.RecordBatch, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.list_value_length(batch.column("kinds")).to_numpy()) // most
    for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(sizes)) + 1):
        if len(part):
            yield batch.slice(int(part[0]), len(part))


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs of a piece from each state at its left edge to each at its right."""
    for batch in (s for b in batches for s in _slices(b)):
        paths = Paths(batch)
        costs = np.empty((batch.num_rows, 4, 4), np.int64)
        for t in range(4):
            right = np.full((batch.num_rows, 4), _INF)
            right[:, t] = 0
            costs[:, :, t] = paths.costs(right)[paths.node0]
        firsts, lasts = _edge_initials(batch)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conversation", "part", "no")], pa.array(costs.reshape(batch.num_rows, 16).tolist(), pa.list_(pa.int64())),
             pa.array(firsts), pa.array(lasts)],
            ["conversation", "part", "no", "costs", "opens", "closes"],
        )


def _edge_initials(batch: pa.RecordBatch) -> tuple[list[str], list[str]]:
    lists = batch.column("initials")
    return [x.values[0].as_py() for x in lists], [x.values[len(x) - 1].as_py() for x in lists]


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _hand_left(pieces: pd.DataFrame) -> pd.DataFrame:
    """Cost to go at the right edge of each piece of a conversation, from its last piece to its first."""
    pieces = pieces.sort_values(["part", "no"], kind="stable")
    right, out = _ACCEPT.astype(np.int64), []
    for costs in pieces["costs"].iloc[::-1]:
        out.append(right.tolist())
        right = np.minimum((np.asarray(costs, np.int64).reshape(4, 4) + right).min(axis=1), _INF)
    rights = out[::-1]
    opens, closes = pieces["opens"].tolist(), pieces["closes"].tolist()
    seams = [0, *[int(not _legal(b, a)) for b, a in zip(closes, opens[1:])]]
    return pd.DataFrame({
        "part": pieces["part"].to_numpy(), "no": pieces["no"].to_numpy(), "right": rights, "seam": seams,
        "final": [False] * (len(rights) - 1) + [True],
    })


def _context(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Cost to go at the right edge and whether it is the conversation's end; pieces without neighbours have no such columns filled."""
    n = batch.num_rows
    right = np.array([x if x is not None else _ACCEPT for x in batch.column("right").to_pylist()], np.int64).reshape(n, 4)
    return right, batch.column("final").fill_null(True).to_numpy(zero_copy_only=False)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the least path leaves a piece, for each in which it may enter."""
    for batch in (s for b in batches for s in _slices(b)):
        paths = Paths(batch)
        right, final = _context(batch)
        found = paths.least(paths.costs(right), final)
        places = (paths.node0[:, None] * 4 + np.arange(4)).ravel()
        arcs, lengths = found.read(places)
        last = np.cumsum(lengths) - 1
        left = np.where(lengths > 0, np.append(found.target, 0)[arcs[np.maximum(last, 0)]] % 4, places % 4)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conversation", "part", "no")], pa.array(left.reshape(-1, 4).tolist(), pa.list_(pa.int64()))],
            ["conversation", "part", "no", "exits"],
        )


def _hand_right(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state in which the least path enters each piece of a conversation."""
    pieces = pieces.sort_values(["part", "no"], kind="stable")
    state, states = START, []
    for exits in pieces["exits"]:
        states.append(state)
        state = int(exits[state])
    return pd.DataFrame({"part": pieces["part"].to_numpy(), "no": pieces["no"].to_numpy(), "enters": states})


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost and edits of each piece; a deleted copy is an edit of the row it repeats."""
    for batch in (s for b in batches for s in _slices(b)):
        paths = Paths(batch)
        right, final = _context(batch)
        found = paths.least(paths.costs(right), final)
        enters = batch.column("enters").fill_null(START).to_numpy()
        arcs, lengths = found.read(paths.node0 * 4 + enters)
        label, row, state = found.label[arcs], found.row[arcs], found.target[arcs] % 4
        more = np.where(row >= 0, np.append(paths.more, 0)[row], 0)
        cut = np.where((row >= 0) & (label != _D), np.append(paths.cut, 0)[row], 0)
        costs = np.array([3, 2, 0, 2])[label] + cut + 3 * more
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = np.concatenate([[0], np.cumsum(costs)])
        letters, repeats = np.zeros(2 * len(arcs), np.uint8), np.ones(2 * len(arcs), np.int64)
        letters[::2], letters[1::2], repeats[1::2] = _LETTERS[label], _LETTERS[_D], more
        audit = np.repeat(letters, repeats).tobytes().decode()
        places = np.concatenate([[0], np.cumsum(1 + more)])
        audits = [audit[places[a] : places[b]] for a, b in zip(starts, ends, strict=True)]
        some = pa.array(np.where(row >= 0, row, 0), mask=row < 0)
        roles = pa.array([_ROLES.get(s) if how in (_I, _R) else None for s, how in zip(state.tolist(), label.tolist(), strict=True)], pa.string())
        old = batch.column("roles").flatten().take(some)
        fields = [
            pa.array([chr(c) for c in _LETTERS[label]], pa.string()), pa.array(np.arange(len(arcs)) - np.repeat(starts, lengths)),
            batch.column("turns").flatten().take(some), old, batch.column("digests").flatten().take(some),
            pc.coalesce(roles, old),
        ]
        edits = pa.ListArray.from_arrays(
            pa.array(np.append(starts, ends[-1]) if len(ends) else [0], pa.int32()),
            pa.StructArray.from_arrays(fields, ["action", "step", "turn", "old_role", "digest", "role"]),
        )
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conversation", "part", "no")], pa.array(audits, pa.string()), pa.array(total[ends] - total[starts]),
             pa.array(_illegal(batch, paths)), edits],
            ["conversation", "part", "no", "audit", "cost", "illegal", "edits"],
        )


def _illegal(batch: pa.RecordBatch, paths: Paths) -> np.ndarray:
    """Neighbouring rows inside each piece, copies included, whose initials may not follow each other."""
    initials = batch.column("initials").flatten().to_numpy(zero_copy_only=False).astype(object)
    bad = np.zeros(paths.rows, np.int64)
    if paths.rows:
        pairs = initials[:-1] + initials[1:]
        bad[1:] = ~np.isin(pairs.astype(str), ["su", "ua", "au"])
        bad[paths.row0] = 0
    bad += paths.more  # equal roles never follow each other
    sums = np.concatenate([[0], np.cumsum(bad)])
    return sums[paths.row0 + paths.n] - sums[paths.row0] + batch.column("seam").fill_null(0).to_numpy()


def repair(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The rows of `judged`, and one row ``(conversation, part, no, audit, cost, illegal, edits)`` for each piece.

    A conversation's pieces go by ``part`` and ``no``; its audit is that of its pieces one
    after the other, its cost their sum. ``illegal`` counts neighbours in the input whose
    initials are not su, ua or au. ``edits`` are structs ``(action, step, turn, old_role,
    digest, role)``; a row is found by conversation, turn, old role and the SHA-256 of its
    text, an inserted one has an empty text; copies of a row are deleted behind it.

    Rows go by turn, null first; rows of one turn by role, then by the SHA-256 of their text.
    Null roles and texts count as one space. Rows without a conversation are one conversation
    of that name; repeated rows are duplicates of the first. Other columns play no part. An
    empty table gives no rows. Both tables are stored.
    """
    spark = rows.sparkSession
    found = stored(judged(rows, conversation, turn, role, text), "turns")
    types = {"c": rows.schema[conversation].dataType.simpleString(), "t": rows.schema[turn].dataType.simpleString()}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("conversation"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ordered = found.drop("text", "fault").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pieces = stored(ordered.mapInArrow(_cut_pieces, _PIECE.format(**types)), "pieces")
    # Pieces with neighbours, two for each batch of rows at most, pass summaries along their conversation.
    many = pieces.where(~F.col("alone"))
    summed = many.mapInArrow(_between, f"conversation {types['c']}, part long, no long, costs array<long>, opens string, closes string")
    lefts = stored(
        summed.groupBy("conversation").applyInPandas(_hand_left, "part long, no long, right array<long>, seam long, final boolean"), "rights"
    )
    exits = many.join(lefts, ["part", "no"]).mapInArrow(_exits, f"conversation {types['c']}, part long, no long, exits array<long>")
    enters = exits.groupBy("conversation").applyInPandas(_hand_right, "part long, no long, enters long")
    known = stored(lefts.join(enters, ["part", "no"]), "edges")
    solved = pieces.join(known, ["part", "no"], "left").mapInArrow(
        _solve, f"conversation {types['c']}, part long, no long, audit string, cost long, illegal long, "
        f"edits array<struct<{_EDIT.format(**types).replace(' ', ':').replace(',:', ',')}>>"
    )
    return found, stored(solved, "repairs")


def _sha256_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each group's lines in order, a line at a time."""
    group: list = []
    digest, rows = hashlib.sha256(), 0
    kind = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group[0]], kind), pa.array([digest.hexdigest()])], ["conversation", "sha256"])

    for batch in batches:
        kind = batch.schema.field("conversation").type
        for name, line in zip(batch.column("conversation").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if group != [name]:
                if group:
                    yield done()
                group, digest, rows = [name], hashlib.sha256(), 0
            if rows:
                digest.update(b"\n")
            digest.update(line.encode())
            rows += 1
    if group:
        yield done()


def repaired(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows ``(conversation, part, no, step, action, turn, role, text)`` that stand after the repair, in the order of the three numbers."""
    edits = pieces.select("conversation", "part", "no", F.explode("edits").alias("e")).where("e.action <> 'D'")
    row = lambda *c: F.struct(*[x.alias(n) for n, x in zip(("conversation", "turn", "role", "digest"), map(F.col, c), strict=True)])
    texts = found.select(row("conversation", "turn", "role", "digest").alias("row"), "text")
    placed = edits.select("conversation", "part", "no", "e.*").withColumn("row", row("conversation", "turn", "old_role", "digest"))
    old = placed.where("action <> 'I'").join(texts, "row")
    new = placed.where("action = 'I'").withColumn("text", F.lit(""))
    return old.unionByName(new).select("conversation", "part", "no", "step", "action", "turn", "role", "text")


def digests(rows: DataFrame) -> DataFrame:
    """Rows ``(conversation, sha256)`` of the lines ``role:text`` of repaired rows.

    A digest of one string follows its bytes in order, so a conversation's rows pass
    through one task, sorted outside memory and read one by one.
    """
    kind = rows.schema["conversation"].dataType.simpleString()
    lines = rows.select("conversation", "part", "no", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("conversation").sortWithinPartitions("conversation", "part", "no", "step")
    return ordered.select("conversation", "line").mapInArrow(_sha256_of_lines, f"conversation {kind}, sha256 string")


def gaps(turn: str) -> Column:
    """Aggregate: turn numbers missing between the smallest and the largest; nulls count for nothing, a gap past a long is null."""
    wide = lambda c: c.cast("decimal(38,0)")
    missing = wide(F.max(turn)) - wide(F.min(turn)) + 1 - F.count_distinct(turn)
    return F.coalesce(F.when(F.max(turn).isNull(), F.lit(0)).otherwise(missing).try_cast("long"), F.when(F.max(turn).isNull(), F.lit(0)))
