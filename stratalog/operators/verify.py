"""Checks of a log against what was written, acknowledged and read; and the invariants of replication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import fault, first_difference
from .frontier import ack_counts
from .log import asof
from .ordered import previous, running_max


def out_of_order(read: DataFrame) -> DataFrame:
    """Rows of read (timeline, read_seq, log_offset) whose offset isn't above the one read before."""
    return previous(read, ["timeline"], "read_seq", "log_offset", "before").where("log_offset <= before")


def duplicates(read: DataFrame) -> DataFrame:
    """(timeline, log_offset, times) of offsets read more than once."""
    return read.groupBy("timeline", "log_offset").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def gaps(acked: DataFrame) -> DataFrame:
    """(timeline, after, missing): runs of offsets that are missing between the least and the greatest."""
    out = previous(acked.select("timeline", "log_offset").distinct(), ["timeline"], "log_offset", "log_offset", "after")
    return out.where("log_offset > after + 1").select("timeline", "after", (F.col("log_offset") - F.col("after") - 1).alias("missing"))


def not_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Offsets of a that b lacks: of (acked, read) lost ones, of (read, acked) phantoms."""
    return a.select("timeline", "log_offset").distinct().join(b.select("timeline", "log_offset").distinct(), ["timeline", "log_offset"], "left_anti")


def mismatches(written: DataFrame, read: DataFrame) -> DataFrame:
    """(timeline, log_offset, at): events whose payload was read otherwise than written, and where they first differ."""
    both = written.select("timeline", "log_offset", F.col("payload").alias("w")).join(read.select("timeline", "log_offset", F.col("payload").alias("r")), ["timeline", "log_offset"])
    return both.where("w <> r").select("timeline", "log_offset", first_difference(F.col("w"), F.col("r")).cast("long").alias("at"))


def corrupt(read: DataFrame, size: int) -> DataFrame:
    """(timeline, log_offset, fault) of payloads, as hex digits, that the checker would not have written."""
    return read.select("timeline", "log_offset", fault(F.col("payload_hex"), size).alias("fault")).where("fault IS NOT NULL")


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """(timeline, kind, n) over the rows of all checks."""
    rows = reduce(DataFrame.unionByName, [df.select("timeline", F.lit(kind).alias("kind")) for kind, df in found.items()])
    return rows.groupBy("timeline", "kind").agg(F.count(F.lit(1)).alias("n"))


def not_fully_replicated(log: DataFrame, acks: DataFrame, acked: DataFrame, replicas: int) -> DataFrame:
    """Acknowledged events that fewer than all replicas hold."""
    return ack_counts(acked, acks).where(F.col("n_units") < replicas)


def acked_lost(acked: DataFrame, ensembles: DataFrame, stored: DataFrame) -> DataFrame:
    """(timeline, log_offset, unit): acknowledged events that a unit of their ensemble doesn't hold."""
    wanted = acked.select("timeline", "log_offset").join(ensembles.select("timeline", F.explode("ensemble").alias("unit")), "timeline")
    return wanted.join(stored.select("timeline", "log_offset", "unit"), ["timeline", "log_offset", "unit"], "left_anti")


def diverging(replicas: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Keys that replicas hold with different content: least and greatest differ, which sums up before the shuffle."""
    return replicas.groupBy(*keys).agg(F.min(content).alias("__a"), F.max(content).alias("__b"), F.count(F.lit(1)).alias("copies")).where("__a <> __b").select(*keys, "copies")


def sticky(samples: DataFrame, low: float, high: float) -> DataFrame:
    """Samples (unit, seq, free) with status: READONLY from where free falls under low, WRITABLE again from where it is above high.

    Of the turning points so far the last one counts; seq and turn travel in one number, whose running maximum is the last turn's.
    """
    turn = F.when(F.col("free") < low, 0).when(F.col("free") > high, 1)
    marked = samples.withColumn("__own", (F.col("seq") * 2 + turn).cast("long"))
    out = running_max(marked, ["unit"], "seq", "__own", "__before")
    last = F.coalesce(F.col("__own"), F.col("__before"))
    return out.select(*samples.columns, F.when(last % 2 == 0, "READONLY").otherwise("WRITABLE").alias("status"))


def refused(writes: DataFrame, samples: DataFrame, low: float, high: float) -> DataFrame:
    """Writes (unit, seq, ..) that a unit refuses: its last status by sticky() at or before the write is READONLY. A unit without a sample before takes the write."""
    status = sticky(samples, low, high).select("unit", F.col("seq").alias("__since"), "status")
    return asof(writes, status, ["unit"], "seq", "__since").where("status = 'READONLY'").select(*writes.columns)
