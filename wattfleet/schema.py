"""Column lists, schemas and register addresses of the supported meters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Parameter names in reading order, as they appear in payloads.
PARAMETERS = [
    "Time",
    "Watts Total", "Watts R Ph", "Watts Y Ph", "Watts B Ph",
    "PF Ave", "PF R Ph", "PF Y Ph", "PF B Ph",
    "VLN average", "V R Ph", "V Y Ph", "V B Ph",
    "A average", "A R Ph", "A Y Ph", "A B Ph",
    "Frequency", "Wh received", "Load Hours Delivered", "No of interruption", "On Hours",
    "V R Harmonics", "V Y Harmonics", "V B Harmonics",
    "A R Harmonics", "A Y Harmonics", "A B Harmonics",
]


def clean_name(name: str) -> str:
    return name.replace(" ", "_").translate(str.maketrans("", "", ".()"))


ID_COLUMNS = ["Device_ID", "Meter_Name", "Time", "Model"]
PARAM_COLUMNS = [clean_name(p) for p in PARAMETERS[1:]]
READING_COLUMNS = ID_COLUMNS + PARAM_COLUMNS

CORRUPT = "_corrupt"

BRONZE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in READING_COLUMNS] + [T.StructField(CORRUPT, T.StringType())]
)


def _silver_type(column: str) -> T.DataType:
    special = {
        "Device_ID": T.IntegerType(),
        "Meter_Name": T.StringType(),
        "Time": T.TimestampNTZType(),
        "Model": T.StringType(),
        "No_of_interruption": T.LongType(),
        "On_Hours": T.LongType(),
    }
    return special.get(column, T.DoubleType())


SILVER_SCHEMA = T.StructType([T.StructField(c, _silver_type(c)) for c in READING_COLUMNS])

# The message repeats the time under "time"; it is left out here because it differs from "Time" in case only.
PAYLOAD_META = ["pi_name", "pi_ip", "meter_name", "device_id", "model", "location"]
PAYLOAD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in PARAMETERS + PAYLOAD_META])

MANIFEST_SCHEMA = "target string, path string, mtime bigint, size bigint"

# Holding-register address of every parameter, in reading order.
FULL_ADDRESSES = {
    "Watts_Total": 100, "Watts_R_Ph": 102, "Watts_Y_Ph": 104, "Watts_B_Ph": 106,
    "PF_Ave": 116, "PF_R_Ph": 118, "PF_Y_Ph": 120, "PF_B_Ph": 122,
    "VLN_average": 140, "V_R_Ph": 142, "V_Y_Ph": 144, "V_B_Ph": 146,
    "A_average": 148, "A_R_Ph": 150, "A_Y_Ph": 152, "A_B_Ph": 154,
    "Frequency": 156, "Wh_received": 158, "Load_Hours_Delivered": 218,
    "No_of_interruption": 220, "On_Hours": 228,
    "V_R_Harmonics": 184, "V_Y_Harmonics": 186, "V_B_Harmonics": 188,
    "A_R_Harmonics": 190, "A_Y_Harmonics": 192, "A_B_Harmonics": 194,
}
HARMONICS = [c for c in PARAM_COLUMNS if c.endswith("_Harmonics")]

# An address of 0 says that the model lacks the parameter.
NOT_AVAILABLE = 0
_no_harmonics = {**FULL_ADDRESSES, **dict.fromkeys(HARMONICS, NOT_AVAILABLE)}
_current_only = {**dict.fromkeys(PARAM_COLUMNS, NOT_AVAILABLE), "A_average": 148, "A_R_Ph": 150}

# Model -> (first register of the dump, on-hours read apart, addresses).
MODELS = {
    "LG6400": (100, False, FULL_ADDRESSES),
    "EN8400": (100, False, FULL_ADDRESSES),
    "EN8100": (100, False, FULL_ADDRESSES),
    "EN8410": (100, True, {**FULL_ADDRESSES, "On_Hours": 230}),
    "LG+5220": (100, True, _no_harmonics),
    "LG+5310": (100, True, {**_no_harmonics, "On_Hours": 230}),
    "ELR300": (148, False, _current_only),
}

KINDS = {"No_of_interruption": "u32", "On_Hours": "hms"}


def register_map(spark: SparkSession) -> DataFrame:
    """One row per model: ``model, map_base, hours_apart, addrs`` (addresses in reading order)."""
    rows = [
        (model, base, apart, [addresses[c] for c in PARAM_COLUMNS])
        for model, (base, apart, addresses) in MODELS.items()
    ]
    return spark.createDataFrame(rows, "model string, map_base int, hours_apart boolean, addrs array<int>")


def register_map_long(spark: SparkSession) -> DataFrame:
    """One row per model and parameter: ``model, param, pos, addr, kind, base``."""
    rows = [
        (model, c, pos, addresses[c], KINDS.get(c, "float32"), base)
        for model, (base, _, addresses) in MODELS.items()
        for pos, c in enumerate(PARAM_COLUMNS)
    ]
    return spark.createDataFrame(
        rows, "model string, param string, pos int, addr int, kind string, base int"
    )
