"""Framed log records: xxh32 checksum, size, type and log number before the data. Spark has no xxh32, so these are pandas UDFs."""

from __future__ import annotations

import struct

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = struct.Struct("<IHBI")
MOST_BYTES = 65_535


def encode(data: bytes, kind: int = 1, log_number: int = 0) -> bytes:
    if len(data) > MOST_BYTES:
        raise ValueError(f"record of {len(data)} bytes; at most {MOST_BYTES} fit")
    crc = xxhash.xxh32_intdigest(struct.pack("<BI", kind, log_number) + data, 0)
    return HEADER.pack(crc, len(data), kind, log_number) + data


def decode(raw: bytes | memoryview | None, at: int = 0) -> tuple[bytes, int, int] | None:
    """(data, kind, log number) of the record that begins at a place; None for what is cut short, of unknown type or fails its checksum."""
    if raw is None or len(raw) - at < HEADER.size:
        return None
    crc, size, kind, number = HEADER.unpack_from(raw, at)
    data = bytes(raw[at + HEADER.size : at + HEADER.size + size])
    if len(data) < size or kind > 4 or crc != xxhash.xxh32_intdigest(struct.pack("<BI", kind, number) + data, 0):
        return None
    return data, kind, number


def replay(raw: bytes) -> list[tuple[bytes, int, int]]:
    """The records of a log file, up to the first that can't be read."""
    return [r for _, r in replayed(raw)]


def replayed(raw: bytes):
    """(place, record) of a log file's records, up to the first that can't be read; each byte is looked at once."""
    view, at = memoryview(raw), 0
    while (r := decode(view, at)) is not None:
        yield at, r
        at += HEADER.size + len(r[0])


def xxh32(data: Column, kind: Column | int = 1, log_number: Column | int = 0) -> Column:
    """The checksum of a record as a long."""

    @F.pandas_udf("long")
    def run(d: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else xxhash.xxh32_intdigest(struct.pack("<BI", a, b) + bytes(x), 0) for x, a, b in zip(d, k, n, strict=True)], dtype="Int64")

    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return run(data.cast("binary"), lit(kind), lit(log_number))


def encoded(data: Column, kind: Column | int = 1, log_number: Column | int = 0) -> Column:
    """The framed record; null for null data and for data that doesn't fit, so that one row doesn't fail its batch."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or len(x) > MOST_BYTES else encode(bytes(x), a, b) for x, a, b in zip(d, k, n, strict=True)], dtype=object)

    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return run(data.cast("binary"), lit(kind), lit(log_number))


def decoded(raw: Column) -> Column:
    """struct(data, type, log_number); null for a bad record."""

    @F.pandas_udf("data binary, type int, log_number long")
    def run(r: pd.Series) -> pd.DataFrame:
        rows = [decode(None if x is None else bytes(x)) or (None, None, None) for x in r]
        return pd.DataFrame(rows, columns=["data", "type", "log_number"]).astype({"type": "Int32", "log_number": "Int64"})

    out = run(raw)
    return F.when(out["type"].isNotNull(), out)
