"""Storage tiers and their upkeep: flush, merge, split, offload, retention, recovery; and the index of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import wal_number
from .log import newest
from .ordered import CELL, previous, running_sum, with_buckets

HEADER_BYTES = 20
LOCAL_LEVELS = (3, 4)


def placed(entries: DataFrame, keys: list[str], order: str, length: str = "length", header: int = 0) -> DataFrame:
    """Entries with byte_offset: the sum of the lengths before them in their segment."""
    out = running_sum(entries, keys, order, length, "__end")
    return out.withColumn("byte_offset", F.col("__end") - F.col(length) + header).drop("__end")


def runs(entries: DataFrame, keys: list[str], order: str, breaks: Column, bound: str) -> DataFrame:
    """Entries with run_no: a new run begins where `breaks` holds, an expression over `__previous`, the value of `bound` in the row before. Hot keys are divided once for both passes."""
    flagged = previous(with_buckets(entries, keys, order), keys, order, bound, "__previous").withColumn("__new", F.when(F.col("__previous").isNull() | breaks, 1).otherwise(0).cast("long"))
    return running_sum(flagged, keys, order, "__new", "run_no").drop("__new", "__previous", CELL)


def live(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Entries that the index still points to."""
    return entries.join(index.select("timeline", "log_offset", "segment_id"), ["timeline", "log_offset", "segment_id"], "left_semi")


def index_put(index: DataFrame, batch: DataFrame) -> DataFrame:
    """The index after a batch of puts; the batch wins, and in it the last by seq."""
    both = index.withColumn("__seq", F.lit(-1).cast("long")).unionByName(batch.withColumnRenamed("seq", "__seq"))
    return newest(both, ["timeline", "log_offset"], [F.col("__seq")]).drop("__seq")


def index_delete(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("timeline", "log_offset"), ["timeline", "log_offset"], "left_anti")


def index_delete_range(index: DataFrame, timeline, start: int, end: int) -> DataFrame:
    """The index without the offsets from start to end, both included."""
    return index.where(~((F.col("timeline") == timeline) & F.col("log_offset").between(start, end)))


def by_segment(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries of the given segments."""
    return index.join(ids.select("segment_id"), "segment_id", "left_semi")


def orphans(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """Segments that no entry refers to."""
    return manifest.join(index.select("segment_id").distinct(), "segment_id", "left_anti")


def at_level(manifest: DataFrame, level: int) -> DataFrame:
    """Segments of a level; 0 means levels 1 to 4."""
    return manifest.where(F.col("level").between(1, 4) if level == 0 else F.col("level") == level)


def local_only(manifest: DataFrame) -> DataFrame:
    return manifest.where("location = 'local'")


def expired(manifest: DataFrame, now_ms: int, ttl_ms: Column) -> DataFrame:
    """Segments that retention removes: of levels 3 and 4, of known age, and older than their time to live."""
    return manifest.where(F.col("level").isin(*LOCAL_LEVELS) & (F.col("created_at") > 0) & (F.col("created_at") < F.lit(now_ms) - ttl_ms))


def retain(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the entries of removed segments."""
    return index.join(gone.select("segment_id"), "segment_id", "left_anti")


def compact_keys(log: DataFrame) -> DataFrame:
    """The newest event of each key of a timeline; events without a key all stay."""
    return newest(log.where("key IS NOT NULL"), ["timeline", "key"], [F.col("log_offset")]).select(*log.columns).unionByName(log.where("key IS NULL"))


def resolve(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries with the path and location of their segment; entries whose segment is unknown are left out."""
    return index.join(manifest.select("segment_id", "path", "location"), "segment_id")


def trim_wal(files: DataFrame, checkpoint: int) -> DataFrame:
    """Write-ahead files (name, ..) that a checkpoint makes superfluous: those with a number below it."""
    return files.where(wal_number(F.col("name")) < checkpoint)


def needs_rotation(files: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """The last write-ahead file, if it has grown to most_bytes."""
    last = files.where(wal_number(F.col("name")).isNotNull()).orderBy(F.desc(wal_number(F.col("name")))).limit(1)
    return last.where(F.col("size") >= most_bytes)


def sizes(entries: DataFrame, length: str = "length") -> DataFrame:
    """(segment_id, size, entry_count)."""
    return entries.groupBy("segment_id").agg(F.sum(length).alias("size"), F.count(F.lit(1)).alias("entry_count"))


def recover(files: DataFrame, now_ms: int) -> DataFrame:
    """Segment metadata from file names: L<level>_<id>.cseg, or segment_<id>.cseg, which is level 0. Other names are left out."""
    name = F.col("name")
    new = F.regexp_extract(name, r"^L(\d+)_(\d+)\.cseg$", 2)
    old = F.regexp_extract(name, r"^segment_(\d+)\.cseg$", 1)
    rows = files.select("*", F.when(new != "", new).otherwise(old).alias("__id"), F.when(new != "", F.regexp_extract(name, r"^L(\d+)_", 1)).otherwise("0").alias("__level")).where("__id <> ''")
    return rows.select(F.col("__id").cast("long").alias("segment_id"), F.col("__level").cast("int").alias("level"), "name", F.lit(now_ms).cast("long").alias("created_at"))
