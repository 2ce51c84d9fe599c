"""The tables of the engine: their columns, and the fixed names that occur in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row per event; (timeline, log_offset) is the key, and times are epoch milliseconds.
EVENTS = T.StructType(
    [
        T.StructField("timeline", T.StringType(), False),
        T.StructField("term", T.LongType(), False),
        T.StructField("log_offset", T.LongType(), False),
        T.StructField("ts_ms", T.LongType(), False),
        T.StructField("payload", T.BinaryType()),
        T.StructField("crc32", T.LongType()),
        T.StructField("schema_id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("txn_id", T.LongType()),
    ]
)

# Names of states and their wire numbers.
TIMELINE_STATUS = {0: "ACTIVE", 1: "SEALED"}
UNIT_STATUS = {0: "WRITABLE", 1: "READONLY"}
CHUNK_TYPE = {0: "FULL", 1: "FIRST", 2: "MIDDLE", 3: "LAST"}
STATUS_CODE = {0: "OK", 1: "INVALID_TERM", 2: "FENCED", 3: "INTERNAL"}
RECORD_TYPE = {0: "ZERO", 1: "FULL", 2: "FIRST", 3: "MIDDLE", 4: "LAST"}

CHUNK_ROWS = 100
EARLIEST = 1


def named(code: Column, names: dict[int, str]) -> Column:
    """The name of a wire number; null for one that has none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, code.cast("int"))
