"""Streaming queries that run over what a directory holds and end; their SQL is that of the batch twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import acks, arrivals, events_log, table
from .record import acked_blocks, append_to, fence_to, frontiers, record
from .tail import read_log, tail, write_log

_LOG = """log AS (
  SELECT event_type AS timeline, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, user_id AS key, value, props AS payload,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS log_offset FROM events
)"""


def _folder(spark: SparkSession) -> str:
    """A new folder that all machines share: in the checkpoint folder that the session names, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/stratalog-{uuid.uuid4().hex}"


def _arrived(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The arrivals as a stream of four files, cut by sequence; each is a micro-batch."""
    rows = arrivals(spark, sf_dir).select("timeline", "seq", "ts_ms", "key", "payload")
    top = (rows.agg(F.max("seq")).first()[0] or 0) + 1
    for i in range(4):
        rows.where((F.col("seq") >= i * top // 4) & (F.col("seq") < (i + 1) * top // 4)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def stream_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    record(_arrived(spark, sf_dir, folder), f"{folder}/log", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/log").select("timeline", "seq", "log_offset")


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events 51 to 300 of a stored timeline, through the tail source."""
    folder = _folder(spark)
    events_log(spark, sf_dir).select("timeline", "log_offset", "ts_ms", F.col("key").cast("string").alias("key"), "payload").repartitionByRange(4, "timeline", "log_offset").sortWithinPartitions("timeline", "log_offset").write.parquet(f"{folder}/log")
    path = f"{folder}/log".removeprefix("file://").removeprefix("file:")
    out = tail(spark, path, "click", 51, 300).writeStream.foreachBatch(append_to(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("timeline", "log_offset", "payload")


def stream_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier after all acknowledgements have come in, a part at a time."""
    folder = _folder(spark)
    a = acks(events_log(spark, sf_dir)).select("timeline", "log_offset", "unit")
    for i in range(3):
        a.where(F.col("unit") == f"u{i}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = acked_blocks(stream, 3).writeStream.outputMode("update").foreachBatch(append_to(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return frontiers(spark.read.parquet(f"{folder}/out"))


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour of a stream with a watermark; the last windows come out as the stream ends in complete mode."""
    folder = _folder(spark)
    stream = _arrived(spark, sf_dir, folder).withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", "1 hour")
    counts = stream.groupBy(F.window("at", "1 hour"), "timeline").agg(F.count(F.lit(1)).alias("n"))
    out = counts.select("timeline", F.unix_millis("window.start").alias("start_ms"), "n")
    query = out.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fence requests in four micro-batches, in order of seq; a unit's terms are kept from batch to batch."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("timeline"), F.col("o_orderkey").alias("seq"), (F.floor("o_totalprice") % 97).alias("term"))
    top = (rows.agg(F.max("seq")).first()[0] or 0) + 1
    for i in range(4):
        rows.where((F.col("seq") >= i * top // 4) & (F.col("seq") < (i + 1) * top // 4)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream.writeStream.foreachBatch(fence_to(f"{folder}/out", f"{folder}/ends")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("timeline", "seq", "term", "accepted", "current_term")


def log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline that the log source wrote and read as a table."""
    folder = _folder(spark).removeprefix("file://").removeprefix("file:")
    rows = events_log(spark, sf_dir).select("timeline", "log_offset", "ts_ms", F.col("key").cast("string").alias("key"), "payload")
    write_log(rows.repartitionByRange(4, "timeline", "log_offset"), folder)
    return read_log(spark, folder, "view", 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_offsets": stream_offsets,
    "stream_tail": stream_tail,
    "stream_acks": stream_acks,
    "stream_windows": windowed_counts,
    "stream_fences": stream_fences,
    "log_source": log_source,
}
SQL = {
    "stream_fences": """WITH w AS (SELECT o_orderpriority AS timeline, o_orderkey AS seq, CAST(floor(o_totalprice) AS BIGINT) % 97 AS term FROM orders),
b AS (SELECT *, coalesce(max(term) OVER (PARTITION BY timeline ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM w)
SELECT timeline, seq, term, term > before AS accepted, greatest(before, term) AS current_term FROM b""",
    "log_source": f"WITH {_LOG} SELECT timeline, log_offset, ts_ms, CAST(key AS VARCHAR) AS key, payload FROM log WHERE timeline = 'view' AND log_offset >= 5",
    "stream_offsets": f"WITH {_LOG} SELECT timeline, seq, log_offset FROM log",
    "stream_tail": f"WITH {_LOG} SELECT timeline, log_offset, payload FROM log WHERE timeline = 'click' AND log_offset BETWEEN 51 AND 300",
    "stream_acks": f"""WITH {_LOG}, c AS (SELECT timeline, log_offset, NOT (seq % 997 = 500) AND NOT (seq >= 9000 AND seq % 2 = 1) AS ok FROM log)
SELECT timeline, coalesce(min(CASE WHEN NOT ok THEN log_offset END) - 1, max(log_offset)) AS lra FROM c GROUP BY timeline""",
    "stream_windows": f"WITH {_LOG} SELECT timeline, ts_ms // 3600000 * 3600000 AS start_ms, count(*) AS n FROM log GROUP BY ALL",
}
