"""Cooldown: let an event through only when enough time has passed since the last one let through.

Which events pass depends on which passed before, so no window frame expresses the rule.
Two facts make it a scan all the same. From an event that passes, the next one that
passes is known at once: the first event a cooldown later, or an earlier one that always
passes. Following these pointers gives all events that pass. And what a stretch of events
does to the state is a step function of the *threshold*, the earliest time at which the
next event may pass; step functions of neighbouring stretches compose.

The rows are ordered over partitions (see `scan`). Runs that start in a partition are
finished there. Of a first run, which may continue another partition's rows, the step
function is kept; blocks of a key's functions are composed in parallel, the blocks are
composed along the key, and every first run is finished from its own known state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfleet.functions.scalars import micros
from wattfleet.operators.scan import PART, group_starts, in_order, same_value, with_columns
from wattfleet.session import stored

NEVER = -(2**62)  # state of a key that has let nothing through yet
ALWAYS = 2**62  # entry of an event that passes whatever the threshold

# What a row stands for: an event that passes, an event of a first run, a summary of a run.
_PASSES, _OPEN, _RUN = range(3)


def next_passing(ts: np.ndarray, bypass: np.ndarray, cooldown: int) -> np.ndarray:
    """For each event the next one that passes if it passes itself; ``len(ts)`` for none."""
    n = len(ts)
    following = np.arange(1, n + 1)
    by_time = np.maximum(np.searchsorted(ts, ts + cooldown, side="left"), following)
    marks = np.where(bypass, np.arange(n), n)
    next_mark = np.append(np.minimum.accumulate(marks[::-1])[::-1], n)[following]
    return np.minimum(by_time, next_mark)


def passing(ts: np.ndarray, bypass: np.ndarray, ok: np.ndarray, cooldown: int, state: int) -> tuple[np.ndarray, int]:
    """Which events pass, after one that passed at ``state``, and the state after them.

    Only events that are ``ok`` change the state, so they pass as if they were alone; the
    others are held against the last of them before.
    """
    able = np.flatnonzero(ok)
    passes = np.zeros(len(ts), bool)
    passes[able] = _following(ts[able], bypass[able], cooldown, state) if len(able) else False
    fired = np.flatnonzero(passes)
    failed = np.flatnonzero(~ok)
    if len(failed):
        times = np.append(state, ts[fired])[np.searchsorted(fired, failed)]
        passes[failed] = bypass[failed] | (times == NEVER) | (ts[failed] - times >= cooldown)
    return passes, int(ts[fired[-1]]) if len(fired) else state


def _following(ts: np.ndarray, bypass: np.ndarray, cooldown: int, state: int) -> np.ndarray:
    """Jumps from each event that passes to the next, doubled until none is new."""
    n = len(ts)
    passes = np.zeros(n + 1, bool)
    start = 0 if state == NEVER else int(np.searchsorted(ts, state + cooldown, side="left"))
    marks = np.flatnonzero(bypass[:start])
    at = np.array([marks[0] if len(marks) else start])
    jump = np.append(next_passing(ts, bypass, cooldown), n)
    passes[at] = True
    while True:
        further = jump[at]
        if not (further < n).any():
            return passes[:n]
        at = np.concatenate([at, further[further < n]])
        passes[at] = True
        jump = jump[jump]


#: The step function of a stretch without events.
_UNCHANGED = (np.array([NEVER - 1]), np.array([NEVER]))


def step_function(ts: np.ndarray, bypass: np.ndarray, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries and results of a stretch: a threshold leads to the result of the first entry not below it."""
    n = len(ts)
    if not n:
        return _UNCHANGED
    step = next_passing(ts, bypass, cooldown)
    last = np.where(step < n, step, np.arange(n))
    while True:  # pointer doubling: log2(n) rounds
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    # No threshold lies beyond first time + cooldown, nor beyond an event that always passes.
    stop = min(int(np.searchsorted(ts, ts[0] + cooldown, side="left")), n - 1)
    marks = np.flatnonzero(bypass[: stop + 1])
    entries = ts[: stop + 1].copy()
    if len(marks):
        entries = entries[: marks[0] + 1]
        entries[-1] = ALWAYS
    return _merge_steps(entries, ts[last[: len(entries)]])


def _merge_steps(entries: np.ndarray, results: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.append(results[1:] != results[:-1], True)
    return entries[keep], results[keep]


def apply_steps(entries: np.ndarray, results: np.ndarray, state: np.ndarray, cooldown: int) -> np.ndarray:
    """States after the stretch, for the given states before it."""
    threshold = np.where(state == NEVER, NEVER, state + cooldown)
    at = np.searchsorted(entries, threshold, side="left")
    hit = at < len(entries)
    return np.where(hit, results[np.minimum(at, len(entries) - 1)], state)


def compose(
    first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], cooldown: int, highest: int
) -> tuple[np.ndarray, np.ndarray]:
    """Step function of two neighbouring stretches, for thresholds up to ``highest``."""
    entries, results = first
    later = (second[0] > entries[-1]) & (entries[-1] < highest)
    results = np.concatenate([apply_steps(*second, results, cooldown), second[1][later]])
    entries = np.concatenate([entries, second[0][later]])
    return _merge_steps(entries, results)


def _run_bounds(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    edges = np.unique(np.concatenate([[0], starts, [n]])).tolist()
    return list(zip(edges, edges[1:]))


def _scan(keys: list[str], cooldown: int, columns: list[str]):
    """Events that pass, in runs that start here; the first run's events; summaries of the first and the last run.

    A first run's step function is composed batch by batch; it has at most an entry for each
    time within its first cooldown, which bounds the memory beside one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, runs, state, last_able, row = None, 0, NEVER, None, None
        steps, first_time = None, 0

        def told(rows: pa.RecordBatch, role: int, lists: tuple | None = None, start: int | None = None) -> pa.RecordBatch:
            n = rows.num_rows
            entries, results = (pa.array([x.tolist()], pa.list_(pa.int64())) for x in lists) if lists else (pa.nulls(n, pa.list_(pa.int64())),) * 2
            return with_columns(
                rows.select(columns), **{c: rows.column(c) for c in ("_t", "_bypass", "_ok")}, _role=same_value(role, n, pa.int32()),
                _entries=entries, _results=results, _start=pa.array([start] * n, pa.int64()), **{PART: same_value(part, n, pa.int64())},
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts, key = group_starts(batch, keys, key)
            new = set(starts.tolist())
            ts = batch.column("_t").to_numpy()
            bypass, ok = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_bypass", "_ok"))
            keep, open_to = np.zeros(n, bool), 0
            for lo, hi in _run_bounds(starts, n):
                if lo in new:
                    if runs == 1:
                        yield told(batch.slice(lo - 1, 1) if lo else row, _RUN, steps, first_time)
                    runs, state = runs + 1, NEVER
                if runs == 1:
                    able = lo + np.flatnonzero(ok[lo:hi])
                    piece = step_function(ts[able], bypass[able], cooldown)
                    if steps is None:
                        steps, first_time = piece, int(ts[lo])
                    else:
                        steps = compose(steps, piece, cooldown, first_time + cooldown)
                    # Of events at one time that do not always pass, only the first can.
                    keep[lo:hi] = bypass[lo:hi] | ~ok[lo:hi]
                    if len(able):
                        times = ts[able]
                        keep[able] |= times != np.append(times[0] - 1 if last_able is None else last_able, times[:-1])
                        last_able = times[-1]
                    open_to = hi
                elif hi - lo == 1 and state == NEVER:
                    keep[lo], state = True, int(ts[lo]) if ok[lo] else NEVER
                else:
                    keep[lo:hi], state = passing(ts[lo:hi], bypass[lo:hi], ok[lo:hi], cooldown, state)
            head, tail = keep.copy(), keep
            head[open_to:], tail[:open_to] = False, False
            if head.any():
                yield told(batch.filter(pa.array(head)), _OPEN)
            if tail.any():
                yield told(batch.filter(pa.array(tail)), _PASSES)
            row = batch.slice(n - 1)
        if runs == 1:
            yield told(row, _RUN, steps, first_time)
        elif runs > 1:
            # The last run starts here: whatever came before, it ends with this state.
            yield told(row, _RUN, (np.array([ALWAYS]), np.array([state])), row.column("_t")[0].as_py())

    return run


def _composed(cooldown: int):
    """The step function of a block of a key's runs."""

    def block(runs: pd.DataFrame) -> pd.DataFrame:
        runs = runs.sort_values(PART, kind="stable")
        steps, highest = None, int(runs["_start"].iloc[0]) + cooldown
        for piece in zip(runs["_entries"], runs["_results"]):
            steps = piece if steps is None else compose(steps, piece, cooldown, highest)
        return pd.DataFrame({"_run": [runs["_run"].iloc[0]], "_block": [runs["_block"].iloc[0]], "_entries": [steps[0]], "_results": [steps[1]]})

    return block


def _states_before(cooldown: int, order: str):
    """The state before each of a key's stretches, from that before the first."""

    def along(stretches: pd.DataFrame) -> pd.DataFrame:
        stretches = stretches.sort_values(order, kind="stable")
        state, states = np.array([int(stretches["_given"].iloc[0])]), []
        for piece in zip(stretches["_entries"], stretches["_results"]):
            states.append(int(state[0]))
            state = apply_steps(*piece, state, cooldown)
        return pd.DataFrame({"_run": stretches["_run"], order: stretches[order], "_given": states})

    return along


def _finish(cooldown: int, columns: list[str]):
    """Events of first runs that pass. Each run starts with a marker row that carries its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, NEVER
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts, part = group_starts(batch, [PART], part)
            new = set(starts.tolist())
            given, ts = batch.column("_given"), batch.column("_t").to_numpy()
            bypass, ok = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_bypass", "_ok"))
            keep = np.zeros(n, bool)
            for lo, hi in _run_bounds(starts, n):
                if lo in new:
                    state = given[lo].as_py()
                    lo += 1
                if lo < hi:
                    keep[lo:hi], state = passing(ts[lo:hi], bypass[lo:hi], ok[lo:hi], cooldown, state)
            yield batch.filter(pa.array(keep)).select(columns)

    return run


def throttle(
    df: DataFrame, keys: list[str], cooldown_seconds: float, ts: str = "ts", seq: str = "seq", bypass: str | None = None,
    success: str | None = None,
) -> DataFrame:
    """Rows let through: the first of a key, those at least the cooldown after the last one let through, and
    those whose ``bypass`` column is true. Rows without a time never pass.

    With ``success``, a boolean column, a row let through whose action failed (false or null)
    starts no cooldown: the next row of the key may pass at once. Rows of one time go by
    ``seq``. What passes, and the events of first runs, are stored once.
    """
    cooldown = round(cooldown_seconds * 1_000_000)
    timed = df.where(F.col(ts).isNotNull())
    if cooldown <= 0:
        return timed
    columns = df.columns
    always = F.coalesce(F.col(bypass), F.lit(False)) if bypass else F.lit(False)
    ok = F.coalesce(F.col(success), F.lit(False)) if success else F.lit(True)
    ready = timed.withColumns({"_t": micros(ts), "_bypass": always, "_ok": ok})
    more = {
        "_t": T.LongType(), "_bypass": T.BooleanType(), "_ok": T.BooleanType(), "_role": T.IntegerType(), "_entries": T.ArrayType(T.LongType()),
        "_results": T.ArrayType(T.LongType()), "_start": T.LongType(), PART: T.LongType(),
    }
    schema = T.StructType([*df.schema, *[T.StructField(name, kind) for name, kind in more.items()]])
    found = stored(in_order(ready, keys, ts, seq).mapInArrow(_scan(keys, cooldown, columns), schema), "cooldown")
    # Nulls inside a struct compare as equal.
    runs = found.where(F.col("_role") == _RUN).select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_run"), "_entries", "_results", "_start", PART)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = runs.withColumn("_block", F.floor(F.col(PART) / math.isqrt(max(parts, 1))))
    blocks = blocked.groupBy("_run", "_block").applyInPandas(_composed(cooldown), "_run string, _block long, _entries array<long>, _results array<long>")
    given = blocks.withColumn("_given", F.lit(NEVER)).groupBy("_run").applyInPandas(_states_before(cooldown, "_block"), "_run string, _block long, _given long")
    states = (
        blocked.join(given, ["_run", "_block"]).groupBy("_run", "_block")
        .applyInPandas(_states_before(cooldown, PART), f"_run string, {PART} long, _given long")
    )
    # Markers travel with the events of their partition's first run; the state of a last run finds none.
    firsts = found.where(F.col("_role") == _OPEN).withColumn("_given", F.lit(None).cast("long"))
    first_keys = firsts.select(PART, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_run")).distinct()
    markers = states.join(first_keys, ["_run", PART]).select(PART, "_given", F.lit(NEVER).alias("_t"), F.lit(False).alias("_bypass"), F.lit(True).alias("_ok"))
    marked = firsts.unionByName(markers, allowMissingColumns=True)
    finished = (
        marked.repartition(parts, PART).sortWithinPartitions(PART, F.col("_given").asc_nulls_last(), "_t", seq)
        .mapInArrow(_finish(cooldown, columns), df.schema)
    )
    return found.where(F.col("_role") == _PASSES).select(*columns).unionByName(finished)
