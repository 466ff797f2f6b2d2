"""The registered queries in plain SQL, for comparison on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfleet.plans.tables import ATTEMPTS, MODEL_CYCLE
from wattfleet.schema import KINDS, MODELS, PARAM_COLUMNS


def reading_columns(df: DataFrame, *more: str) -> DataFrame:
    """Readings with the column names the SQL uses."""
    return df.select(
        F.col("Device_ID").alias("device_id"), F.col("Meter_Name").alias("meter_name"), F.col("Time").alias("time"),
        F.col("Watts_Total").alias("watts_total"), "seq", *more,
    )


READING = "user_id AS device_id, event_type AS meter_name, ts AS time, value AS watts_total, event_id AS seq"

# Text readings: bad times and sentinel cells as in tables.text_readings.
TEXT = """
text_readings AS (
  SELECT user_id AS device_id, event_type AS meter_name, event_id AS seq,
         CASE WHEN event_id % 50 = 0 THEN 'garbage' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time_text,
         CASE event_type WHEN 'error' THEN '-1' WHEN 'signup' THEN '0' ELSE CAST(event_id AS VARCHAR) END AS watts,
         CASE event_type WHEN 'error' THEN '-1' WHEN 'signup' THEN '0' WHEN 'view' THEN 'NA'
              ELSE CAST(event_id AS VARCHAR) END AS pf,
         CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE (event_id // 60) * 3600 + (event_id % 60) * 60 + 7
              END AS hours,
         CASE event_type WHEN 'error' THEN 'comm_failure' WHEN 'signup' THEN 'no_response' ELSE 'ok' END AS quality
  FROM events),
silver AS (
  SELECT seq, CAST(device_id AS INTEGER) AS device_id, meter_name, try_strptime(time_text, '%Y-%m-%d %H:%M:%S') AS time,
         CASE WHEN quality = 'ok' THEN TRY_CAST(watts AS DOUBLE) END AS watts_total,
         CASE WHEN quality = 'ok' THEN TRY_CAST(pf AS DOUBLE) END AS pf_ave,
         CAST(hours AS BIGINT) AS on_hours, quality
  FROM text_readings)
"""

LATEST = f"""
SELECT device_id, meter_name, time, watts_total, seq FROM (
  SELECT {READING}, row_number() OVER (PARTITION BY {{key}} ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
"""

LATEST_FOR_DISPLAY = """
WITH sites AS (
  SELECT 0 AS site, CAST(user_id AS VARCHAR) AS device, ts AS time, event_id AS seq FROM events
  UNION ALL SELECT 1, event_type, ts, event_id FROM events
  UNION ALL SELECT 2, 'Unknown', ts, event_id FROM events)
SELECT * FROM sites QUALIFY row_number() OVER (PARTITION BY site, device ORDER BY time DESC, seq DESC) = 1
"""

RETENTION = f"SELECT {READING} FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY"

RETENTION_TEXT = f"""
WITH {TEXT}, t AS (SELECT seq, time_text, try_strptime(time_text, '%Y-%m-%d %H:%M:%S') AS time FROM text_readings)
SELECT * FROM t WHERE time IS NULL OR time >= (SELECT max(time) FROM t) - INTERVAL 7 DAY
"""

LIVE_READINGS = f"""
WITH {TEXT}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY time DESC NULLS LAST, seq DESC) AS rn FROM silver
  WHERE time IS NULL OR time >= (SELECT max(time) FROM silver) - INTERVAL 7 DAY)
SELECT device_id, meter_name, time, watts_total, pf_ave, on_hours, quality, seq FROM ranked WHERE rn = 1
"""

SILVER = f"WITH {TEXT} SELECT seq, device_id, time, watts_total, pf_ave, on_hours, quality FROM silver"

TAIL = f"SELECT {READING} FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"

UNION = f"""
SELECT {READING}, 'a' AS site FROM events WHERE event_type = 'click'
UNION ALL
SELECT user_id, event_type, ts, NULL, event_id, 'b' FROM events WHERE event_type = 'error'
UNION ALL
SELECT {READING}, 'c' FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'error')
"""

CELL_TEXTS = ["NA", "0.0", "1_000", "1.5d", " 7 ", "-0.001", "123:04:05", "nan", "-0.0", "1.50", "2e3", ".5"]

# Halves go to the even digit in printf, as they do for the values used here in Spark.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _format(number: str, text: str | None = None) -> str:
    whole = f"CAST(CAST({number} AS BIGINT) AS VARCHAR)"
    shown = f"CASE WHEN {number} = floor({number}) THEN {whole} ELSE printf('%.2f', {number}) END"
    return shown if text is None else f"CASE WHEN {number} IS NULL THEN {text} ELSE {shown} END"


_cells = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(CELL_TEXTS))

FORMAT_VALUE = f"""
WITH cells AS (
  SELECT event_id, value, (event_id % 4000) / 8.0::DOUBLE - 100 AS eighth,
         CASE event_id % {len(CELL_TEXTS) + 3} {_cells} ELSE CAST(event_id AS VARCHAR) || '.250' END AS t
  FROM events),
trimmed AS (SELECT *, regexp_replace(trim(t), '(\\d)_(\\d)', '\\1\\2', 'g') AS plain FROM cells),
parsed AS (
  SELECT *, CASE WHEN regexp_matches(plain, '{_NUMBER}') THEN TRY_CAST(plain AS DOUBLE) END AS number FROM trimmed)
SELECT event_id, {_format('value')} AS value_text, {_format('eighth')} AS eighth_text,
       {_format('number', 't')} AS cell_text
FROM parsed
"""

WORDS = "(l_partkey * 31) % 65536 AS lo, 16256 + l_suppkey % 1000 AS hi"


def _float32(lo: str, hi: str) -> str:
    exponent, fraction = f"((({hi}) >> 7) & 255)", f"(((({hi}) & 127) << 16) | ({lo}))"
    return f"round_even(pow(2.0, {exponent} - 127) * (1 + {fraction} / 8388608.0::DOUBLE), 2)"


DECODE_FLOAT32 = f"""
WITH w AS (SELECT l_orderkey, l_linenumber, {WORDS} FROM lineitem)
SELECT *, {_float32('lo', 'hi')} AS value FROM w
"""

PACK_U32 = f"""
WITH w AS (SELECT l_orderkey, l_linenumber, {WORDS} FROM lineitem)
SELECT l_orderkey, l_linenumber, lo * 65536 + hi AS counter FROM w
"""


def _hms(seconds: str) -> str:
    return f"printf('%02d:%02d:%02d', ({seconds}) // 3600, ({seconds}) % 3600 // 60, ({seconds}) % 60)"


SECONDS_TO_HMS = f"SELECT event_id, {_hms('event_id * 37')} AS hms FROM events"
HMS_TO_SECONDS = "SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN event_id * 37 END AS seconds FROM events"

READING_TIME = f"""
WITH {TEXT}, t AS (SELECT seq, try_strptime(time_text, '%Y-%m-%d %H:%M:%S') AS time FROM text_readings)
SELECT seq, time, strftime(time, '%Y%m%d') AS date_key FROM t
"""

PLACES = """
places AS (
  SELECT n_nationkey, r_name || ' / ' || n_name || ' #' || CAST(n_nationkey AS VARCHAR) AS location
  FROM nation JOIN region ON n_regionkey = r_regionkey),
devices AS (
  SELECT s_suppkey AS address, location, regexp_replace(location, '[^\\p{L}\\p{N}_-]', '', 'g') AS location_key
  FROM supplier JOIN places ON s_nationkey = n_nationkey)
"""

SANITIZE_KEY = f"WITH {PLACES} SELECT address, location, location_key FROM devices"
DISTINCT_LOCATIONS = f"WITH {PLACES} SELECT DISTINCT location_key, location FROM devices"

JSON_PATH = """
SELECT event_id, props ->> '$.k' AS k, props ->> '$.k' AS deep, 'true' AS flag, '' AS object, '' AS list, '' AS missing
FROM events
"""


def _word(offset: int) -> str:
    """Formula of a register word, as in tables.register_dumps."""
    return f"(16256 + (l_partkey * 31 + l_suppkey) % 700 + {offset})"


def _cell(param: str, base: int, address: int, seconds: bool = False) -> str:
    if address == 0:
        return "NULL"
    first, second = _word(address - base), _word(address - base + 1)
    kind = KINDS.get(param, "float32")
    if kind == "float32":
        return _float32(first, second)
    packed = f"({first} * 65536 + {second})"
    return packed if kind == "u32" or seconds else _hms(packed)


def _with_model() -> str:
    models = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODEL_CYCLE))
    return f"WITH d AS (SELECT *, CASE l_partkey % 8 {models} END AS model FROM lineitem)"


def registers() -> str:
    """Every parameter of every model straight from the formula of the register words."""

    def column(param: str) -> str:
        branches = " ".join(
            f"WHEN '{m}' THEN {_cell(param, base, addresses[param])}" for m, (base, _, addresses) in MODELS.items()
        )
        zero = {"u32": "CAST(0 AS BIGINT)", "hms": "'0'"}.get(KINDS.get(param), "CAST(0 AS DOUBLE)")
        return f"CASE model {branches} ELSE {zero} END AS {param}"

    columns = ",\n  ".join(column(p) for p in PARAM_COLUMNS)
    return f"{_with_model()} SELECT l_orderkey, l_linenumber, model,\n  {columns}\nFROM d"


def registers_long() -> str:
    parts = []
    for param in PARAM_COLUMNS:
        values = " ".join(
            f"WHEN '{m}' THEN {_cell(param, base, addresses[param], seconds=True)}"
            for m, (base, _, addresses) in MODELS.items()
        )
        lacking = ", ".join(f"'{m}'" for m, (_, _, addresses) in MODELS.items() if addresses[param] == 0)
        quality = f"WHEN model IN ({lacking}) THEN 'unsupported' " if lacking else ""
        parts.append(
            f"SELECT l_orderkey, l_linenumber, model, '{param}' AS param, CAST(CASE model {values} END AS DOUBLE) AS value, "
            f"CASE WHEN model = 'other' THEN 'no_response' {quality}ELSE 'ok' END AS quality FROM d"
        )
    cells = " UNION ALL ".join(parts)
    return f"""{_with_model()}, cells AS ({cells})
SELECT model, param, quality, count(*) AS readings, min(value) AS lowest, max(value) AS highest,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
FROM cells GROUP BY model, param, quality"""


def attempts() -> str:
    """The retry ladder as nested cases, without a table of attempts."""
    states = "CASE CAST((floor((l_partkey + l_suppkey * 3 + l_orderkey * 7) / {n}.0::DOUBLE) + {s}) AS BIGINT) % 3 " \
             "WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'exception' END"
    columns = ", ".join(f"{states.format(n=s + 1, s=s)} AS s{b}{a}" for b, a, s in ATTEMPTS)
    ladder = {
        b: f"CASE WHEN s{b}1 = 'ok' THEN 'ok' WHEN s{b}1 = 'exception' THEN 'comm_failure' WHEN s{b}2 = 'ok' THEN 'ok' "
           f"WHEN s{b}2 = 'exception' THEN 'comm_failure' ELSE 'no_response' END"
        for b in (1, 2, 3)
    }
    words = {
        b: f"CAST(l_partkey % 65536 AS VARCHAR) || ',' || CASE WHEN s{b}1 = 'ok' THEN '{b}1' ELSE '{b}2' END"
        for b in (1, 2, 3)
    }
    return f"""
WITH s AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 2 = 1 AS two, {columns} FROM lineitem),
b AS (SELECT *, {ladder[1]} AS o1, {ladder[2]} AS o2, {ladder[3]} AS o3 FROM s),
r AS (
  SELECT *, CASE WHEN s11 = 'exception' OR (two AND s21 = 'exception') THEN 'comm_failure'
                 WHEN o1 <> 'ok' THEN o1 WHEN two THEN o2 ELSE 'ok' END AS outcome FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, outcome,
  CASE WHEN outcome = 'ok' THEN {words[1]} || CASE WHEN two THEN ',' || {words[2]} ELSE '' END END AS words,
  o3 AS hours_outcome, CASE WHEN o3 = 'ok' THEN {words[3]} END AS hours_words
FROM r
"""


QUALITY = f"""
WITH {TEXT}
SELECT seq, quality, CASE WHEN pf = 'NA' THEN 1 ELSE 0 END AS unsupported FROM text_readings
"""

CELLS = f"""
WITH {TEXT}, cells AS (
  SELECT seq, quality, 'Watts_Total' AS param, watts AS t FROM text_readings
  UNION ALL SELECT seq, quality, 'PF_Ave', pf FROM text_readings
  UNION ALL SELECT seq, quality, 'Frequency', watts FROM text_readings)
SELECT seq, param, CASE WHEN quality = 'ok' THEN TRY_CAST(t AS DOUBLE) END AS value,
       CASE WHEN quality = 'ok' AND t = 'NA' THEN 'unsupported' ELSE quality END AS quality
FROM cells
"""

# Raw text of ragged rows; the other rows have none.
RAGGED_LINES = ["1,A", "1,A,2025-01-01 00:00:00", "1", '"1,2",A', '"1,2",A,t']
MALFORMED = "SELECT event_id FROM events WHERE event_id % 10 NOT IN (0, 2, 3)"

CLOCK_SKEW = """
SELECT l_orderkey, l_linenumber, abs(epoch(l_shipdate) - epoch(o_orderdate)) AS skew_seconds,
       abs(epoch(l_shipdate) - epoch(o_orderdate)) > 2 AS skewed
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def registry(defaults: bool) -> str:
    """Devices of every customer's registry: one of four kinds, then an empty and a broken one."""
    empty_name, broken_name = ("'Meter_2'", "'Meter_3'") if defaults else ("''", "''")
    empty_address = "2" if defaults else "NULL"
    # A number loses its fraction, a text must be whole, true is one; a fitting address is no extra entry.
    numbers = [("7", 0), ("NULL", 1), ("-7", 1), ("1", 1), ("NULL", 1)]
    others = "".join(
        f"UNION ALL SELECT c_custkey, {pos}, {f"'Meter_{pos + 1}'" if defaults else "''"}, CAST({address} AS INTEGER), '', 'Unknown', {extras} FROM c\n"
        for pos, (address, extras) in enumerate(numbers, 3)
    )
    return f"""
WITH c AS (SELECT *, c_custkey % 4 AS kind FROM customer WHERE c_custkey % 10 <> 9)
SELECT c_custkey, 0 AS pos, c_name AS name, CASE WHEN kind <> 3 THEN CAST(c_custkey AS INTEGER) END AS address,
       CASE kind WHEN 0 THEN 'LG6400' WHEN 1 THEN 'X' ELSE '' END AS model,
       CASE kind WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment WHEN 2 THEN 'P // ' || c_mktsegment ELSE 'Unknown' END
         AS location,
       CAST(CASE kind WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 3 END AS BIGINT) AS extras
FROM c
UNION ALL SELECT c_custkey, 1, {empty_name}, CAST({empty_address} AS INTEGER), '', 'Unknown', 0 FROM c
UNION ALL SELECT c_custkey, 2, {broken_name}, CAST(NULL AS INTEGER), '', 'Unknown', 1 FROM c
{others}"""


DEVICES_PER_LOCATION = """
SELECT c_custkey AS address, c_name AS name, c_mktsegment AS location, count(*) OVER (PARTITION BY c_mktsegment) AS devices
FROM customer
"""
LOCATION_COUNTS = "SELECT c_mktsegment AS location, count(*) AS devices FROM customer GROUP BY c_mktsegment"

KNOWN_LOCATIONS = f"""
SELECT {READING}, 'NATION_' || CAST(user_id % 40 AS VARCHAR) AS location_key FROM events
WHERE 'NATION_' || CAST(user_id % 40 AS VARCHAR) IN (SELECT n_name FROM nation)
"""

WITH_REGISTRY = f"""
SELECT {READING}, c_name AS name, c_mktsegment AS location FROM events LEFT JOIN customer ON user_id = c_custkey
"""

MANIFESTS = """
cur AS (
  SELECT o_orderkey AS path, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS size
  FROM orders),
prev AS (
  SELECT path, mtime - CASE WHEN path % 7 = 0 THEN 60 ELSE 0 END + CASE WHEN path % 11 = 0 THEN 60 ELSE 0 END AS mtime,
         size + CASE WHEN path % 5 = 0 THEN 1 ELSE 0 END AS size
  FROM cur WHERE path % 3 <> 0)
"""
_EXACT = "prev.path IS NULL OR cur.mtime <> prev.mtime OR cur.size <> prev.size"

CHANGED_EXACT = f"WITH {MANIFESTS} SELECT cur.* FROM cur LEFT JOIN prev ON cur.path = prev.path WHERE {_EXACT}"
CHANGED_NEWER = f"""
WITH {MANIFESTS} SELECT cur.* FROM cur LEFT JOIN prev ON cur.path = prev.path
WHERE prev.path IS NULL OR cur.mtime > prev.mtime OR cur.size <> prev.size OR cur.path % 13 = 0
"""
INSERT_ONLY = f"WITH {MANIFESTS} SELECT * FROM cur WHERE path NOT IN (SELECT path FROM prev)"
UPSERT = f"""
WITH {MANIFESTS}, changed AS (
  SELECT cur.* FROM cur LEFT JOIN prev ON cur.path = prev.path WHERE cur.path % 2 = 0 AND ({_EXACT}))
SELECT * FROM prev WHERE path NOT IN (SELECT path FROM changed) UNION ALL SELECT * FROM changed
"""
SETTLED = f"WITH {MANIFESTS} SELECT * FROM cur WHERE mtime <= (SELECT max(mtime) FROM cur) - 86400"
ORDERED_LISTING = f"WITH {MANIFESTS} SELECT * FROM cur ORDER BY path"
LATEST_SOURCE = """
SELECT o_custkey, path, mtime FROM (
  SELECT o_custkey, o_orderkey AS path, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS mtime,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1
"""

TRANSITIONS = """
SELECT user_id, ts, event_id FROM (
  SELECT *, event_type <> 'error' AS up,
         lag(event_type <> 'error', 1, {initial}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
  FROM events)
WHERE up AND NOT before
"""

THROTTLE = """
WITH RECURSIVE e AS (
  SELECT user_id, ts, event_id, {bypass} AS forced,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (
  SELECT user_id, ts, event_id, rn, ts AS fired_at, TRUE AS fired FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.ts, e.event_id, e.rn,
         CASE WHEN e.forced OR e.ts - f.fired_at >= INTERVAL {hours} HOUR THEN e.ts ELSE f.fired_at END,
         e.forced OR e.ts - f.fired_at >= INTERVAL {hours} HOUR
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, ts, event_id FROM f WHERE fired
"""

CYCLES = """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle FROM events
"""
CYCLE_EVERY_10 = f"SELECT * FROM ({CYCLES}) WHERE cycle % 10 = 0"


PUBLISHED = """
SELECT event_id % 4 AS batch, count(*) AS messages, (SELECT count(*) FROM events) AS rows_sent FROM events GROUP BY event_id % 4
"""

ON_BATCH = """
SELECT event_id % 4 + 1 AS cycle, count(*) AS readings, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY event_id % 4
"""

PUBLISHED_READINGS = """
SELECT CAST(user_id AS VARCHAR) AS device_id, event_type AS meter_name, date_trunc('second', ts) AS time, value AS watts_total, 'pi' AS pi_name
FROM events
"""

_SHIFTED = ", ".join(
    f"CASE WHEN quality = 'ok' THEN CAST(watts AS BIGINT) + {i} END AS {c.lower()}"
    for i, c in enumerate(PARAM_COLUMNS) if c not in ("Watts_Total", "PF_Ave", "Frequency", "On_Hours")
)
EXPORTED = f"""
WITH {TEXT}
SELECT CAST(device_id AS INTEGER) AS device_id, meter_name, try_strptime(time_text, '%Y-%m-%d %H:%M:%S') AS time,
  CASE WHEN quality = 'ok' THEN TRY_CAST(watts AS DOUBLE) END AS watts_total,
  CASE WHEN quality = 'ok' THEN TRY_CAST(pf AS DOUBLE) END AS pf_ave,
  CASE WHEN quality = 'ok' THEN TRY_CAST(watts AS DOUBLE) END AS frequency, CAST(hours AS BIGINT) AS on_hours, {_SHIFTED}, quality
FROM text_readings
"""

STORED = f"SELECT {READING}, strftime(ts, '%Y-%m-%d') AS date FROM events"

BY_LOCATION = f"""
SELECT {READING}, 'Site' || (user_id % 5) AS location_key, strftime(ts, '%Y%m%d') AS date_key FROM events WHERE user_id % 5 IN (2, 4)
"""

LISTED = "SELECT DISTINCT strftime(ts, '%Y%m%d') AS date_key, TRUE AS filled, TRUE AS timed FROM events"

OVERWRITTEN = f"SELECT {READING} FROM events WHERE event_type = 'error'"


def crowded(sql: str) -> str:
    """The same over events of which a third belong to one device."""
    events = (
        "(SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, "
        "CASE WHEN event_id % 30 = 0 THEN TIMESTAMP '2024-01-02' ELSE ts END AS ts FROM events) AS events"
    )
    return sql.replace("FROM events", f"FROM {events}")


THROTTLE_SUCCESS = """
WITH RECURSIVE e AS (
  SELECT user_id, ts, event_id, event_type <> 'error' AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (
  SELECT user_id, ts, event_id, rn, CASE WHEN ok THEN ts END AS fired_at, TRUE AS fired FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.ts, e.event_id, e.rn,
         CASE WHEN e.ok AND (f.fired_at IS NULL OR e.ts - f.fired_at >= INTERVAL 12 HOUR) THEN e.ts ELSE f.fired_at END,
         f.fired_at IS NULL OR e.ts - f.fired_at >= INTERVAL 12 HOUR
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, ts, event_id FROM f WHERE fired
"""

COPIES_ALLOWED = """
WITH RECURSIVE seen AS (
  SELECT user_id % 7 AS host, user_id AS mount, date_trunc('hour', ts) AS poll, bool_or(event_type <> 'error') AS present
  FROM events GROUP BY ALL),
hosts AS (
  SELECT host, poll, any_there AND NOT coalesce(lag(any_there) OVER (PARTITION BY host ORDER BY poll), FALSE) AS freed
  FROM (SELECT host, poll, bool_or(present) AS any_there FROM seen GROUP BY host, poll)),
e AS (
  SELECT host, mount, poll, freed, row_number() OVER (PARTITION BY host, mount ORDER BY poll) AS rn
  FROM seen JOIN hosts USING (host, poll) WHERE present),
f AS (
  SELECT host, mount, poll, rn, poll AS fired_at, TRUE AS fired FROM e WHERE rn = 1
  UNION ALL
  SELECT e.host, e.mount, e.poll, e.rn,
         CASE WHEN e.freed OR e.poll - f.fired_at >= INTERVAL 12 HOUR THEN e.poll ELSE f.fired_at END,
         e.freed OR e.poll - f.fired_at >= INTERVAL 12 HOUR
  FROM f JOIN e ON e.host = f.host AND e.mount = f.mount AND e.rn = f.rn + 1)
SELECT host, mount, poll FROM f WHERE fired
"""

WIDE_TO_LONG = " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{c}' AS param, {c} AS value FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)

WIDE_TO_STRUCT = """
SELECT l_suppkey AS device_id, l_returnflag AS device_name, l_linestatus AS model,
       concat_ws(',', l_orderkey, l_partkey, l_linenumber) AS readings
FROM lineitem
"""

LAYOUT = f"""
WITH {TEXT}
SELECT CAST(device_id AS VARCHAR) AS Device_ID, meter_name AS Meter_Name, time_text AS Time, 'LG6400' AS Model,
       watts AS Watts_Total, pf AS PF_Ave, watts AS Frequency, seq
FROM text_readings
"""

FORMATTED = f"""
SELECT {_format('value')} AS Watts_Total, {_format('(event_id / 8.0::DOUBLE)')} AS Frequency, event_id AS seq FROM events
"""

ZIP_PARAMS = """
SELECT l_orderkey, l_linenumber, CAST(least(l_linenumber % 5, 4) AS BIGINT) AS n,
       CASE WHEN l_linenumber % 5 >= 1 THEN CAST(l_orderkey AS VARCHAR) END AS v_time,
       CASE WHEN l_linenumber % 5 >= 2 THEN CAST(l_partkey AS VARCHAR) END AS v_a,
       CASE WHEN l_linenumber % 5 >= 3 THEN CAST(l_suppkey AS VARCHAR) END AS v_b,
       CASE WHEN l_linenumber % 5 >= 4 THEN CAST(l_linenumber AS VARCHAR) END AS v_c
FROM lineitem
"""

PAYLOAD = """
WITH m AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events)
SELECT event_id AS seq,
  '{"Time":"' || t || '",'
  || CASE WHEN event_id % 5 <> 0 THEN '"Watts Total":' || (event_id % 100) || ',' ELSE '' END
  || '"No of interruption":' || event_id
  || ',"pi_name":"pi","pi_ip":"192.0.2.1","meter_name":"' || event_type || '","time":"' || t
  || '","device_id":' || user_id || ',"model":"LG6400"'
  || CASE WHEN event_id % 3 <> 0 THEN ',"location":"Plant"' ELSE '' END || '}' AS value
FROM m
"""

PAYLOAD_ROUNDTRIP = """
SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS device_id, event_type AS meter_name, date_trunc('second', ts) AS time,
       'LG6400' AS model, CASE WHEN event_id % 5 <> 0 THEN event_id % 100 END AS watts_total,
       CAST(NULL AS VARCHAR) AS pf_ave, CASE WHEN event_id % 3 <> 0 THEN 'Plant' END AS location, 'pi' AS pi_name
FROM events
"""
