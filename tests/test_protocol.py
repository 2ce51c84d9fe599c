"""The invariants of replication over simulated runs, and over runs with a planted breach."""

import pytest
from pyspark.sql import functions as F

from simulator import simulate
from stratalog.operators import verify
from stratalog.operators.log import with_segment


def frames(spark, seed):
    sent, stored, acked, segments = simulate(seed)
    return (
        spark.createDataFrame(sent, "timeline string, log_offset long, payload string"),
        spark.createDataFrame(stored, "timeline string, log_offset long, unit string, payload string"),
        spark.createDataFrame(acked, "timeline string, log_offset long, payload string"),
        spark.createDataFrame(segments, "timeline string, start_offset long, ensemble array<string>"),
    )


def breaches(sent, stored, acked, segments):
    where = with_segment(acked, segments).select("timeline", "log_offset", F.explode("ensemble").alias("unit"))
    lost = where.join(stored, ["timeline", "log_offset", "unit"], "left_anti").count()
    return {
        "replicated": verify.not_fully_replicated(acked, stored, acked, 2).count(),
        "lost": lost,
        "divergent": verify.diverging(stored, ["timeline", "log_offset"], "payload").count(),
        "not_sent": acked.join(sent, ["timeline", "log_offset", "payload"], "left_anti").count(),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_invariants_hold(spark, seed):
    assert breaches(*frames(spark, seed)) == {"replicated": 0, "lost": 0, "divergent": 0, "not_sent": 0}


def test_breaches_are_found(spark):
    sent, stored, acked, segments = frames(spark, 3)
    first = acked.orderBy("timeline", "log_offset").first()
    hit = (F.col("timeline") == first.timeline) & (F.col("log_offset") == first.log_offset)
    one = stored.where(hit).first().unit
    gone = stored.where(~(hit & (F.col("unit") == one)))
    assert breaches(sent, gone, acked, segments)["lost"] == 1
    changed = stored.withColumn("payload", F.when(hit & (F.col("unit") == one), "x").otherwise(F.col("payload")))
    assert breaches(sent, changed, acked, segments)["divergent"] == 1
    assert breaches(sent.where(~hit), stored, acked, segments)["not_sent"] >= 1
