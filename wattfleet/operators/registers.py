"""Register dumps to parameters: register maps, read attempts, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.functions.scalars import decode_bits, decode_float32, float32_bits, format_value, pack_u32, seconds_to_hms
from wattfleet.operators.quality import COMM_FAILURE, NO_RESPONSE, OK, UNSUPPORTED
from wattfleet.schema import KINDS, NOT_AVAILABLE, PARAM_COLUMNS, register_map

# Block number of the on-hours counter on models that read it apart.
ON_HOURS_BLOCK = 3


def with_register_map(df: DataFrame) -> DataFrame:
    """Attach the register map of the row's model; null for an unknown model.

    The map is a constant of one row per model, so it is always broadcast.
    """
    return df.join(F.broadcast(register_map(df.sparkSession)), "model", "left")


def _ladder(first: Column, second: Column) -> Column:
    """Outcome of one block from the status of its first and second read."""
    return (
        F.when(first == "ok", OK)
        .when(first == "exception", COMM_FAILURE)
        .when((first == "error") & (second == "ok"), OK)
        .when((first == "error") & (second == "exception"), COMM_FAILURE)
        .when(first == "error", NO_RESPONSE)
    )


def resolve_attempts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per reading from its read attempts.

    Input: ``reading_id, block, attempt, status, words`` with status ``ok``, ``error``
    or ``exception``. An error reply allows one more try, an exception none. Blocks 1
    and 2 hold the register words, block 3 the on-hours counter where it is read apart.
    An exception on the first read of block 1 or 2 fails the reading; otherwise block 1
    is settled before block 2. Output: the keys, ``outcome, words, hours_outcome, hours_words``.
    """
    keys = keys or ["reading_id"]

    def status(block: int, attempt: int) -> Column:
        return F.max(F.when((F.col("block") == block) & (F.col("attempt") == attempt), F.col("status")))

    def words(block: int) -> Column:
        # The words of the last good read: a second read happens only after an error.
        good = (F.col("block") == block) & (F.col("status") == "ok")
        return F.max_by("words", F.when(good, F.col("attempt")))

    blocks = (1, 2, ON_HOURS_BLOCK)
    grouped = df.groupBy(*keys).agg(
        *[status(b, a).alias(f"_s{b}{a}") for b in blocks for a in (1, 2)],
        *[words(b).alias(f"_w{b}") for b in blocks],
    )
    settled = {b: _ladder(F.col(f"_s{b}1"), F.col(f"_s{b}2")) for b in blocks}
    raised = (F.col("_s11") == "exception") | F.coalesce(F.col("_s21") == "exception", F.lit(False))
    outcome = (
        F.when(F.col("_s11").isNull() | raised, COMM_FAILURE)
        .when(settled[1] != OK, settled[1])
        .when(F.col("_s21").isNotNull(), settled[2])
        .otherwise(OK)
    )
    return grouped.select(
        *keys,
        outcome.alias("outcome"),
        F.when(outcome == OK, F.concat("_w1", F.coalesce("_w2", F.array().cast("array<int>")))).alias("words"),
        settled[ON_HOURS_BLOCK].alias("hours_outcome"),
        F.when(settled[ON_HOURS_BLOCK] == OK, F.col(f"_w{ON_HOURS_BLOCK}")).alias("hours_words"),
    )


class _Dump:
    """Columns of a register dump joined with its map.

    ``words`` is null unless the read succeeded and the model is known. Then ``fill``
    is what every parameter gets: -1 or 0. An address of 0 lies before the dump, so
    that a parameter the model lacks reads as null.
    """

    def __init__(self, df: DataFrame):
        given = set(df.columns)
        self.apart = {"hours_outcome", "hours_words"} <= given
        joined = with_register_map(df)
        outcome = F.when(F.col("addrs").isNull(), NO_RESPONSE).otherwise(F.lit(OK))
        if "outcome" in given:
            outcome = F.when(F.col("outcome") != OK, F.col("outcome")).otherwise(outcome)
        self.frame = joined.withColumns(
            {
                "_outcome": outcome,
                "_base": F.coalesce(F.col("base"), F.col("map_base")) if "base" in given else F.col("map_base"),
            }
        ).withColumns(
            {
                "_words": F.when(F.col("_outcome") == OK, F.col("words")),
                "_fill": F.when(F.col("_outcome") == COMM_FAILURE, -1).when(F.col("_outcome") == NO_RESPONSE, 0),
            }
        )
        consumed = {"words", "base", "outcome", "hours_outcome", "hours_words"}
        self.kept = [c for c in df.columns if c not in consumed]

    @staticmethod
    def pair(address: Column) -> tuple[Column, Column]:
        at = address - F.col("_base")
        return F.get("_words", at), F.get("_words", at + 1)

    def separate_hours(self) -> Column:
        """True where the on-hours counter was read apart from the dump."""
        if not self.apart:
            return F.lit(False)
        return F.col("hours_apart") & F.col("hours_outcome").isNotNull() & (F.col("_outcome") == OK)

    def hours(self, address: Column) -> Column:
        """On-hours in seconds, from the dump or from the separate read."""
        own = pack_u32(*self.pair(address))
        if not self.apart:
            return own
        words = pack_u32(F.get("hours_words", F.lit(0)), F.get("hours_words", F.lit(1)))
        return F.when(self.separate_hours(), words).otherwise(own)


def registers_to_params(df: DataFrame, params: list[str] | None = None) -> DataFrame:
    """Replace register words by one typed column per parameter.

    Input: ``model, words`` and, if present, ``base`` (first register of the dump),
    ``outcome``, ``hours_outcome``, ``hours_words``. A failed read gives -1 or 0
    everywhere, an unknown model 0 everywhere, a parameter the model lacks null.
    The map is joined by broadcast and all else is a projection, so nothing is shuffled.
    """
    dump = _Dump(df)
    base, position = F.col("_base"), PARAM_COLUMNS.index
    # One expression over the array of addresses instead of one per parameter keeps the plan small.
    bits = F.transform("addrs", lambda a: float32_bits(F.get("_words", a - base), F.get("_words", a - base + 1)))
    frame = (
        dump.frame.withColumn("_bits", bits)
        .withColumn("_values", F.transform("_bits", decode_bits))
        .withColumn("_hours", dump.hours(F.col("addrs")[position("On_Hours")]))
    )

    def decoded(c: str) -> Column:
        kind = KINDS.get(c, "float32")
        if kind == "float32":
            return F.coalesce(F.get("_values", F.lit(position(c))), F.col("_fill").cast("double"))
        if kind == "u32":
            return F.coalesce(pack_u32(*dump.pair(F.col("addrs")[position(c)])), F.col("_fill").cast("bigint"))
        text = seconds_to_hms("_hours")
        if dump.apart:
            failed = F.when(F.col("hours_outcome") == COMM_FAILURE, "-1").when(F.col("hours_outcome") == NO_RESPONSE, "0")
            text = F.when(dump.separate_hours(), F.coalesce(failed, text)).otherwise(text)
        return F.coalesce(text, F.col("_fill").cast("string"))

    return frame.select(*dump.kept, *[decoded(c).alias(c) for c in (params or PARAM_COLUMNS)])


def registers_to_long(df: DataFrame) -> DataFrame:
    """One row per reading and parameter: ``param, value, quality``, on-hours in seconds.

    Input as for ``registers_to_params``. The value is null where the quality is not ``ok``.
    """
    dump = _Dump(df)
    names = F.array(*[F.lit(c) for c in PARAM_COLUMNS])
    # An unknown model has no addresses, and still one row per parameter.
    addresses = F.coalesce("addrs", F.array_repeat(F.lit(NOT_AVAILABLE), len(PARAM_COLUMNS)))
    cells = dump.frame.select(
        *dump.kept, "_words", "_base", "_outcome", *(["hours_apart", "hours_outcome", "hours_words"] if dump.apart else []),
        F.posexplode(addresses).alias("_pos", "_addr"),
    ).withColumn("param", F.get(names, F.col("_pos")))
    address, param = F.col("_addr"), F.col("param")
    is_hours, is_counter = (param == c for c in ("On_Hours", "No_of_interruption"))
    value = (
        F.when(is_hours, dump.hours(address).cast("double"))
        .when(is_counter, pack_u32(*dump.pair(address)).cast("double"))
        .otherwise(decode_float32(*dump.pair(address)))
    )
    quality = F.when(F.col("_outcome") != OK, F.col("_outcome"))
    if dump.apart:
        quality = quality.when(is_hours & dump.separate_hours(), F.col("hours_outcome"))
    quality = quality.when(address == NOT_AVAILABLE, UNSUPPORTED).otherwise(OK)
    return cells.select(*dump.kept, "param", F.when(quality == OK, value).alias("value"), quality.alias("quality"))


def registers_to_text(df: DataFrame, params: list[str] | None = None) -> DataFrame:
    """As ``registers_to_params`` with formatted text cells; a parameter the model lacks is ``NA``."""
    params = params or PARAM_COLUMNS
    wide = registers_to_params(df, params)
    return wide.withColumns({c: F.coalesce(format_value(c), F.lit("NA")) for c in params})
