"""End-to-end check of the storage: writes timelines with payloads that tell their sequence, compacts on the way, reads back and runs all verifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import expected
from ..operators import verify
from .storage import LogStore


def written(spark: SparkSession, timelines: int, start: int, end: int, size: int) -> DataFrame:
    """Events start + 1 to end of each timeline, as (timeline, log_offset, seq, payload)."""
    names = F.explode(F.transform(F.sequence(F.lit(0), F.lit(timelines - 1)), lambda i: F.concat(F.lit("verify-"), i.cast("string"))))
    return spark.range(start + 1, end + 1).select(names.alias("timeline"), F.col("id").alias("log_offset"), F.col("id").alias("seq"), expected(F.col("id"), size).alias("payload"))


def findings(sent: DataFrame, read: DataFrame, size: int) -> DataFrame:
    """(timeline, kind, n) of everything that is wrong with what was read; read has read_seq, the order of reading."""
    return verify.summary(
        {
            "ORDER": verify.out_of_order(read),
            "DUPLICATE": verify.duplicates(read),
            "CORRUPTION": verify.corrupt(read.withColumnRenamed("payload", "payload_hex"), size),
            "PAYLOAD_MISMATCH": verify.mismatches(sent, read),
            "GAP": verify.gaps(read),
            "DURABILITY": verify.not_in(sent, read),
            "PHANTOM": verify.not_in(read, sent),
        }
    )


def run(spark: SparkSession, folder: str, timelines: int = 4, events: int = 1000, size: int = 256, batches: int = 8) -> DataFrame:
    """Writes, compacts and reads; returns the findings, none if all is well."""
    store = LogStore(spark, folder)
    for i in range(batches):
        store.flush(written(spark, timelines, i * events // batches, (i + 1) * events // batches, size), now_ms=i)
        store.merge(now_ms=i)
        store.split(now_ms=i, trigger=2)
    read = store.read().withColumn("read_seq", F.col("log_offset"))
    return findings(written(spark, timelines, 0, events, size), read, size)
