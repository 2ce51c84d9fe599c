"""Recording: dense offsets for arriving events; and frontiers of arriving acknowledgements.

What a batch leaves behind is tied to the batch: one that is run again begins with what its predecessor left, gives the same offsets, and replaces its own folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import BUCKET_ROWS, numbered, running_max

#: Offsets whose acknowledgements one state value holds, as bits.
BLOCK = 4096


def append_to(path: str):
    """A foreachBatch sink of one folder per batch, which a rerun replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def with_offsets(batch: DataFrame, ends: DataFrame | None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A batch of arrivals (timeline, seq, ..) with log_offset: numbered by seq behind the timeline's last offset, of which `ends` (timeline, last) has one row each. A timeline of more than bucket_rows events in the batch is numbered in parts."""
    out = numbered(batch, ["timeline"], "seq", "log_offset", bucket_rows)
    if ends is None:
        return out
    return out.join(ends, "timeline", "left").withColumn("log_offset", F.col("log_offset") + F.coalesce("last", F.lit(0))).select(*batch.columns, "log_offset")


def number_to(path: str, ends: str, bucket_rows: int = BUCKET_ROWS):
    """A foreachBatch sink that numbers a batch, writes it to a folder of its own and, to one under `ends`, the last offset of every timeline so far, one row each."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("timeline string, last long").parquet(f"{ends}/batch={batch_id - 1}") if batch_id else None
        # The batch is looked at more than once; its source is read once.
        held = batch.persist()
        try:
            with_offsets(held, before, bucket_rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            held.unpersist()
        now = spark.read.parquet(f"{path}/batch={batch_id}").groupBy("timeline").agg(F.max("log_offset").alias("last"))
        if before is not None:
            now = now.unionByName(before).groupBy("timeline").agg(F.max("last").alias("last"))
        now.write.mode("overwrite").parquet(f"{ends}/batch={batch_id}")

    return write


def record(arrivals: DataFrame, path: str, checkpoint: str, bucket_rows: int = BUCKET_ROWS, linger_s: float | None = None):
    """Starts a query that numbers arrivals (timeline, seq, ..) and appends them to the log at path.

    Without `linger_s` it ends when what is there has been written. With it, it goes on, and gathers arrivals for that long before they are written as one batch; how much a batch gathers at most is the source's to say (maxFilesPerTrigger).
    """
    sink = number_to(path, f"{checkpoint}/ends", bucket_rows)
    query = arrivals.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if linger_s is None else query.trigger(processingTime=f"{int(linger_s * 1000)} milliseconds")).start()


def fence_to(path: str, ends: str, bucket_rows: int = BUCKET_ROWS):
    """A foreachBatch sink for fence requests (timeline, seq, term), which come in order of seq from batch to batch: writes their outcomes (accepted, current_term), as frontier.fence() gives them for all requests at once, and the term of every timeline so far."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("timeline string, last long").parquet(f"{ends}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], "timeline string, last long")
        held = batch.persist()
        try:
            own = running_max(held, ["timeline"], "seq", "term", "__before", bucket_rows).join(before, "timeline", "left")
            known = F.coalesce(F.greatest("__before", "last"), F.lit(-1).cast("long"))
            own.select(*batch.columns, (F.col("term") > known).alias("accepted"), F.greatest(known, F.col("term")).alias("current_term")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            now = held.groupBy("timeline").agg(F.max("term").alias("last")).unionByName(before).groupBy("timeline").agg(F.max("last").alias("last"))
            now.write.mode("overwrite").parquet(f"{ends}/batch={batch_id}")
        finally:
            held.unpersist()

    return write


def _through(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Sets the bits of what is acknowledged in a block of offsets, unit by unit; `through` is how many of its first offsets all replicas have."""
    units, bits = state.get if state.exists else ([], [])
    held = {u: np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for u, b in zip(units, bits, strict=True)}
    replicas = 1
    for frame in frames:
        if not len(frame):
            continue
        replicas = int(frame["replicas"].iloc[0])
        for unit, offsets in frame.groupby("unit")["log_offset"]:
            held.setdefault(unit, np.zeros(BLOCK, bool))[(offsets.to_numpy() - 1) % BLOCK] = True
    count = np.sum(list(held.values()), axis=0)
    short = np.flatnonzero(count < replicas)
    state.update((list(held), [np.packbits(x).tobytes() for x in held.values()]))
    yield pd.DataFrame({"timeline": [key[0]], "block": [key[1]], "through": [int(short[0]) if len(short) else BLOCK]})


def acked_blocks(acks: DataFrame, replicas: int) -> DataFrame:
    """Streaming acknowledgements (timeline, log_offset, unit) to (timeline, block, through): for blocks of BLOCK offsets, how many of the first ones are on all replicas; through only grows.

    A state value is a bit per offset and unit of one block, whatever arrives out of order or not at all, and a hot timeline's blocks are spread over tasks.
    """
    block = F.floor((F.col("log_offset") - 1) / BLOCK).cast("long").alias("block")
    keyed = acks.where("log_offset > 0").select("timeline", block, "log_offset", "unit", F.lit(replicas).alias("replicas"))
    return keyed.groupBy("timeline", "block").applyInPandasWithState(_through, "timeline string, block long, through long", "units array<string>, bits array<binary>", "update", GroupStateTimeout.NoTimeout)


def frontiers(blocks: DataFrame) -> DataFrame:
    """(timeline, lra) from what acked_blocks() has written: the end of the first block that isn't whole, or behind which one is missing."""
    newest = blocks.groupBy("timeline", "block").agg(F.max("through").alias("through"))
    whole = newest.where(F.col("through") == BLOCK).select("timeline", "block")
    # Candidates are block 0 and what follows a whole block; the first that isn't whole itself is where the frontier stands.
    after = whole.select("timeline", (F.col("block") + 1).alias("block")).unionByName(newest.select("timeline", F.lit(0).cast("long").alias("block")).distinct())
    ends = after.join(whole, ["timeline", "block"], "left_anti").groupBy("timeline").agg(F.min("block").alias("block"))
    return ends.join(newest, ["timeline", "block"], "left").select("timeline", (F.col("block") * BLOCK + F.coalesce("through", F.lit(0))).alias("lra"))
