"""Reads the Parquet tables of a directory, and shapes them as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order of arrival, not yet numbered: timeline, seq, ts_ms, key, value, payload."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("timeline"),
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("user_id").alias("key"),
        "value",
        F.col("props").alias("payload"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log with dense offsets from 1 in each timeline."""
    return numbered(arrivals(spark, sf_dir), ["timeline"], "seq", "log_offset")


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a log: turns are offsets already."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("timeline"), (F.col("turn") + 1).alias("log_offset"), "role", F.col("text").alias("payload"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as unit registrations: address, zone, status and load."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("address"),
        F.concat(F.lit("zone-"), (F.col("s_nationkey") % 5).cast("string")).alias("zone"),
        F.when(s % 7 == 0, "READONLY").otherwise("WRITABLE").alias("status"),
        ((s * 37 % 100) / 100.0).alias("cpu_usage"),
        ((s * 53 % 100) / 100.0).alias("memory_usage"),
        ((s * 71 % 100) / 100.0).alias("disk_usage"),
    )


def acks(log: DataFrame, replicas: int = 3) -> DataFrame:
    """(timeline, log_offset, unit): the acknowledgements of a log on u0..; u1 lost every 997th event of a sequence, u2 what came after sequence 9000 and is odd."""
    expected = log.select("timeline", "log_offset", "seq", F.explode(F.array(*[F.lit(f"u{i}") for i in range(replicas)])).alias("unit"))
    return expected.where(~((F.col("unit") == "u1") & (F.col("seq") % 997 == 500)) & ~((F.col("unit") == "u2") & (F.col("seq") >= 9000) & (F.col("seq") % 2 == 1)))
