"""Write-ahead files as a table, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import wal_number
from ..functions.records import encode, replayed

RECORDS = "file long, at long, type int, log_number long, data binary"


def read_wal(spark: SparkSession, folder: str, first: int = 0) -> DataFrame:
    """(file, at, type, log_number, data): the records of a folder's write-ahead files from number `first` on, each file up to its first record that can't be read.

    A file is one row of the scan, as a record's place follows from those before it; rotation bounds its size. Files of other names are left out.
    """
    files = spark.read.format("binaryFile").load(folder).select(wal_number(F.element_at(F.split("path", "/"), -1)).alias("file"), "content").where(F.col("file") >= first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(replayed(raw.as_buffer()))
                columns = [pa.array([number] * len(found), pa.int64()), pa.array([at for at, _ in found], pa.int64()), pa.array([r[1] for _, r in found], pa.int32()), pa.array([r[2] for _, r in found], pa.int64()), pa.array([r[0] for _, r in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "at", "type", "log_number", "data"])

    return files.mapInArrow(run, RECORDS)


def last_records(records: DataFrame) -> DataFrame:
    """One record for each log number: the last one that was written, by file and place."""
    return records.groupBy("log_number").agg(F.max_by(F.struct("type", "data"), F.struct("file", "at")).alias("r")).select("log_number", "r.type", "r.data")


def framed(rows: list[tuple[bytes, int, int]]) -> bytes:
    """A write-ahead file of records (data, type, log number)."""
    return b"".join(encode(*r) for r in rows)
