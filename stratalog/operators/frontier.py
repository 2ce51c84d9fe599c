"""Acknowledgements, frontiers, terms and truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import newest
from .ordered import following_min, running_max


def ack_counts(log: DataFrame, acks: DataFrame) -> DataFrame:
    """(timeline, log_offset, n_units) of every event."""
    counted = acks.groupBy("timeline", "log_offset").agg(F.count_distinct("unit").alias("n_units"))
    return log.select("timeline", "log_offset").join(counted, ["timeline", "log_offset"], "left").na.fill(0, ["n_units"])


def frontier(log: DataFrame, acks: DataFrame, replicas: int) -> DataFrame:
    """(timeline, lrs, lra): the last offset written, and the last one up to which every offset is on all replicas."""
    short = F.when(F.col("n_units") < replicas, F.col("log_offset"))
    return ack_counts(log, acks).groupBy("timeline").agg(F.max("log_offset").alias("lrs"), F.min(short).alias("__gap")).select("timeline", "lrs", F.coalesce(F.col("__gap") - 1, F.col("lrs")).alias("lra"))


def fence(requests: DataFrame) -> DataFrame:
    """Outcome of fence requests (timeline, seq, term) in order of seq: accepted only with a term above all before; current_term is the term after the request.

    A rejected term is never above the largest so far, so the running maximum of all terms is that of the accepted ones.
    """
    before = F.coalesce(F.col("__before"), F.lit(-1).cast("long"))
    out = running_max(requests, ["timeline"], "seq", "term", "__before")
    return out.select(*requests.columns, (F.col("term") > before).alias("accepted"), F.greatest(before, F.col("term")).alias("current_term"))


def check_terms(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests (timeline, term, ..) with `ok`: the term is not below the unit's; a timeline that the unit doesn't know passes."""
    return requests.join(state.select("timeline", F.col("term").alias("unit_term")), "timeline", "left").withColumn("ok", F.coalesce(F.col("term") >= F.col("unit_term"), F.lit(True)))


def monotone(updates: DataFrame) -> DataFrame:
    """(timeline, lra) after updates that only let it grow, from -1."""
    return updates.groupBy("timeline").agg(F.greatest(F.max("lra"), F.lit(-1)).cast("long").alias("lra"))


def truncated(writes: DataFrame) -> DataFrame:
    """The rows that writes (timeline, seq, log_offset, trunc, ..) leave: a truncating write drops what was written before it at its offset and above; of the rest the newest write of an offset stays."""
    cut = writes.withColumn("__cut", F.when(F.col("trunc"), F.col("log_offset")))
    alive = following_min(cut, ["timeline"], "seq", "__cut", "__least").where("__least IS NULL OR __least > log_offset")
    return newest(alive.drop("__cut", "__least"), ["timeline", "log_offset"], [F.col("seq")])


def committed_transactions(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Events without a transaction, and those whose transaction has a commit."""
    done = commits.select("txn_id")
    return log.where("txn_id IS NULL").unionByName(log.where("txn_id IS NOT NULL").join(done, "txn_id", "left_semi").select(*log.columns))


def released(before: DataFrame, after: DataFrame) -> DataFrame:
    """(timeline, first, last): offsets whose writers can be answered when the frontier (timeline, lra) has moved; nothing for timelines where it hasn't."""
    old = before.select("timeline", F.col("lra").alias("__old"))
    moved = after.select("timeline", "lra").join(old, "timeline", "left").withColumn("first", F.greatest(F.coalesce("__old", F.lit(0)), F.lit(0)) + 1)
    return moved.where(F.col("lra") >= F.col("first")).select("timeline", "first", F.col("lra").alias("last"))
