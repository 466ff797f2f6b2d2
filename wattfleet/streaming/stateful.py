"""Transitions and cooldowns on live streams, on Spark's keyed state.

The state lies in the RocksDB state store below the stream's checkpoint. The keys of a
bucket have one state, and a batch changes the buckets it holds: a call of Python for
each key would cost more than the work on its rows. A row travels as text beside the few numbers that the rules need, so
that no column changes its type on the way.

The results are written with a column ``late``: rows that came too late to be put in
order. A file sink writes each batch once, also when it is run again after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wattfleet.functions.scalars import micros
from wattfleet.operators.cooldown import NEVER, passing
from wattfleet.session import ship_package
from wattfleet.streaming.ingest import DEFAULT_INTERVAL, with_trigger

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Times keep all their digits as text.
_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

# Stands for a null time or number; both come before all others.
_NONE = -(2**63)

_OUT = "row string, late boolean"

# The keys of a stream are dealt to this many states.
_BUCKETS = 1024
_LAST = {"key": np.array([], object), "t": np.array([], np.int64), "seq": np.array([], np.int64), "up": np.array([], bool), "heard": np.array([], np.int64)}
_LAST_SCHEMA = pa.schema([("key", pa.string()), ("t", pa.int64()), ("seq", pa.int64()), ("up", pa.bool_()), ("heard", pa.int64())])
_FIRED_SCHEMA = pa.schema([("key", pa.string()), ("t", pa.int64())])


def _packed(stream: DataFrame, keys: list[str], ts: str, seq: str, flag: F.Column) -> DataFrame:
    """A bucket of keys, the keys as one text that is never null, time in microseconds, sequence, a flag, and the whole row as text."""
    key = F.to_json(F.struct(*[F.col(k) for k in keys]), {**_TEXT, "ignoreNullFields": "false"})
    return stream.select(
        F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).alias("bucket"), key.alias("key"), F.coalesce(micros(ts), F.lit(_NONE)).alias("t"), F.coalesce(F.col(seq).cast("long"), F.lit(_NONE)).alias("seq"),
        F.coalesce(flag, F.lit(False)).alias("flag"), F.to_json(F.struct(*[F.col(c) for c in stream.columns]), _TEXT).alias("row"),
    )


def _unpacked(found: DataFrame, like: DataFrame) -> DataFrame:
    row = F.from_json("row", T.StructType([T.StructField(f.name, f.dataType) for f in like.schema]), _TEXT)
    return found.select(row.alias("r"), "late").select("r.*", "late")


def _columns(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, ...]:
    """Key, time, sequence, flag and text of a bucket's rows in a batch."""
    parts = list(rows)
    return tuple(np.concatenate([p[c].to_numpy() for p in parts]) for c in ("key", "t", "seq", "flag", "row"))


def _table(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    """A table as one value of a state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _told(results: np.ndarray, late: np.ndarray) -> Iterator[pd.DataFrame]:
    if len(results) or len(late):
        flags = np.arange(len(results) + len(late)) >= len(results)
        yield pd.DataFrame({"row": np.concatenate([results, late]), "late": flags})


@contextmanager
def _rocks_db(spark: SparkSession) -> Iterator[None]:
    """The state store of these streams, for those started inside."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _transitions(before_first: bool, forget_after_ms: int | None):
    """False to true, row by row of a key, in the order of time and sequence inside a batch.

    A call takes the keys of a bucket together. Its state is a table of their last rows and
    of when these came by the clock.
    """

    def run(bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else pd.DataFrame(_LAST)
        clock = 0
        if forget_after_ms is not None:
            clock = state.getCurrentProcessingTimeMs()
            last = last[last["heard"] > clock - forget_after_ms]
        if not state.hasTimedOut:
            names, times, numbers, flags, texts = _columns(rows)
            flags = flags.astype(bool)
            codes, keys = pd.factorize(np.concatenate([last["key"].to_numpy(object), names.astype(object)]))
            n, key = len(last), codes[len(last):]
            t, seq, up, heard = (np.append(last[c].to_numpy(), np.full(len(keys) - n, x)) for c, x in (("t", _NONE), ("seq", _NONE), ("up", before_first), ("heard", clock)))
            up = up.astype(bool)
            fresh = (times > _NONE) & ((times > t[key]) | ((times == t[key]) & (numbers > seq[key])))
            order = np.lexsort((numbers, times, key))
            order = order[fresh[order]]
            now, of = flags[order], key[order]
            first, final = np.append(True, of[1:] != of[:-1])[: len(of)], np.append(of[1:] != of[:-1], True)[-len(of) or 1 :]
            changes = order[now & ~np.where(first, up[of], np.append(True, now[:-1])[: len(now)])]
            newest, at = order[final], of[final]
            t[at], seq[at], up[at], heard[at] = times[newest], numbers[newest], flags[newest], clock
            known = np.arange(len(keys)) < n
            known[at] = True
            last = pd.DataFrame({"key": keys, "t": t, "seq": seq, "up": up, "heard": heard})[known]
            yield from _told(texts[changes], texts[~fresh])
        if len(last):
            state.update((_table(last, _LAST_SCHEMA),))
            if forget_after_ms is not None:
                state.setTimeoutDuration(max(int(last["heard"].min()) + forget_after_ms - clock, 1))
        elif state.exists:
            state.remove()

    return run


class Cooldown(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, and then go through the cooldown of their key in order.

    A call takes the keys of a bucket together: they have one list, one timer, and one table
    of when their last rows went through. A row is late when the watermark has passed it on arrival: rows after it may be decided.
    """

    def __init__(self, cooldown: int) -> None:
        self.cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, t long, seq long, flag boolean, row string")
        self.fired = handle.getValueState("fired", "last binary")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, first: int) -> None:
        """One timer for a bucket, for its earliest row that waits."""
        at, set_ = first // 1000 + 1, self.timer.get()
        if set_ is None or at < set_[0]:
            if set_ is not None:
                self.handle.deleteTimer(set_[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        names, times, numbers, flags, texts = _columns(rows)
        late = (times == _NONE) | (times // 1000 < watermark)
        if not late.all():
            kept = [c[~late].tolist() for c in (names, times, numbers, flags, texts)]
            self.waiting.appendList(list(zip(*kept, strict=True)))
            self._wake(min(kept[1]))
        yield from _told(texts[:0], texts[late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get())
        due = [r for r in rows if r[1] // 1000 < watermark]
        rest = [r for r in rows if r[1] // 1000 >= watermark]
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[1] for r in rest))
        else:
            self.waiting.clear()
        if due:
            yield from _told(self._passed(due), np.array([], object))

    def _passed(self, due: list[tuple]) -> np.ndarray:
        """The texts of the rows that go through; each key's rows are decided by themselves."""
        seen = self.fired.get()
        last = {} if seen is None else dict(zip(*pa.ipc.open_stream(seen[0]).read_all().to_pydict().values(), strict=True))
        names, t, numbers, flags, texts = (np.array([r[i] for r in due], kind) for i, kind in enumerate((object, np.int64, np.int64, bool, object)))
        codes, keys = pd.factorize(names)
        order = np.lexsort((numbers, t, codes))
        ends = np.cumsum(np.bincount(codes))
        found = []
        for key, a, b in zip(keys, np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            at = order[a:b]
            passes, after = passing(t[at], flags[at], np.ones(b - a, bool), self.cooldown, last.get(key, NEVER))
            if passes.any():
                last[key] = after
                found.append(at[passes])
        if not found:
            return texts[:0]
        self.fired.update((_table(pd.DataFrame({"key": list(last), "t": list(last.values())}), _FIRED_SCHEMA),))
        return texts[np.concatenate(found)]

    def close(self) -> None:
        pass


def _start(found: DataFrame, folder: str, interval: str | None) -> StreamingQuery:
    writer = (
        found.writeStream.format("parquet").outputMode("append").partitionBy("late")
        .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    )
    with _rocks_db(found.sparkSession):
        return with_trigger(writer, interval).start()


def _written(like: DataFrame, folder: str, late: str) -> DataFrame:
    schema = T.StructType([*like.schema, T.StructField("late", T.StringType())])
    return like.sparkSession.read.schema(schema).parquet(f"{folder}/rows").where(F.col("late") == late).drop("late")


def stream_results(like: DataFrame, folder: str) -> DataFrame:
    """What a transition or cooldown stream over a table ``like`` this one has written so far."""
    return _written(like, folder, "false")


def late_rows(like: DataFrame, folder: str) -> DataFrame:
    """The rows that came too late, as they came: they can be stored and streamed again, or joined to a batch run."""
    return _written(like, folder, "true")


def transition_stream(
    stream: DataFrame,
    folder: str,
    keys: list[str],
    up: str = "up",
    ts: str = "ts",
    seq: str = "seq",
    initial: bool | None = None,
    interval: str | None = DEFAULT_INTERVAL,
    forget_after_seconds: float | None = None,
) -> StreamingQuery:
    """Changes of ``up`` from false to true, written below ``folder`` (see `stream_results`).

    The state of a key is its last row. Rows of a key that are not later than it, and rows
    without a time, are late. A key not heard of for ``forget_after_seconds`` starts anew;
    such a stream wakes by the clock, so it does not end by itself. A batch holds a bucket's new rows in memory: bound it by the source's rate.
    """
    ship_package(stream.sparkSession)
    forget = None if forget_after_seconds is None else round(forget_after_seconds * 1000)
    packed = _packed(stream, keys, ts, seq, F.col(up))
    found = packed.groupBy("bucket").applyInPandasWithState(
        _transitions(True if initial is None else initial, forget), _OUT, "last binary", "append",
        GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
    return _start(_unpacked(found, stream), folder, interval)


def throttle_stream(
    stream: DataFrame,
    folder: str,
    keys: list[str],
    cooldown_seconds: float,
    ts: str = "ts",
    seq: str = "seq",
    bypass: str | None = None,
    interval: str | None = DEFAULT_INTERVAL,
    delay: str = "0 seconds",
) -> StreamingQuery:
    """Rows that the cooldown lets through, written below ``folder`` (see `stream_results`).

    Rows may come in any order within ``delay`` of the newest time of the stream. They are
    decided once the newest time is further on than that, so the last rows wait for later
    ones. Rows that come later still, and rows without a time, are late.
    """
    ship_package(stream.sparkSession)
    cooldown = round(cooldown_seconds * 1_000_000)
    event_time = F.col(ts).cast("timestamp")
    marked = stream.withColumn("_event_time", event_time).withWatermark("_event_time", delay)
    # The copies below carry no watermark, so that late rows reach the processor.
    packed = _packed(marked.drop("_event_time"), keys, ts, seq, F.col(bypass) if bypass else F.lit(False))
    found = packed.groupBy("bucket").transformWithStateInPandas(
        Cooldown(cooldown), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )
    return _start(_unpacked(found, stream), folder, interval)
