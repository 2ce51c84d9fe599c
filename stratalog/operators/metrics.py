"""Operational metrics: histograms, rates, quantiles and averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bucket bounds of latencies and of compactions, in seconds.
LATENCY_BOUNDS = (0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
COMPACTION_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def histogram(df: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """keys, bound, n: how many values are at most each bound, and all of them at bound infinity (null)."""
    counts = df.groupBy(*keys).agg(F.array(*[F.count_if(F.col(value) <= b) for b in bounds], F.count(value)).alias("c"))
    marks = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.get("c", F.lit(i)).alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("bound"), F.get("c", F.lit(len(bounds))).alias("n")))
    return counts.select(*keys, F.explode(marks).alias("m")).select(*keys, "m.bound", "m.n")


def histogram_quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """keys, quantile: linear within the bucket that the quantile falls into; the last finite bound if it falls beyond."""
    w = Window.partitionBy(*keys).orderBy(F.col("bound").asc_nulls_last())
    rows = hist.select("*", F.lag("n", 1, 0).over(w).alias("below"), F.lag("bound").over(w).alias("low"), F.max("n").over(Window.partitionBy(*keys)).alias("total"))
    hit = rows.where((F.col("n") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    low = F.coalesce(F.col("low"), F.lit(0.0))
    inside = low + (F.col("bound") - low) * (q * F.col("total") - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(*keys, F.coalesce(inside, low).alias("quantile"))


def interval_rates(df: DataFrame, keys: list[str], ts_ms: Column, interval_s: int) -> DataFrame:
    """keys, bucket, n, per_second: events of each interval, and whole events a second."""
    return df.groupBy(*keys, F.floor(ts_ms / (1000 * interval_s)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select(*keys, "bucket", "n", F.floor(F.col("n") / interval_s).alias("per_second"))


def counter_rates(samples: DataFrame, keys: list[str], window_ms: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """keys, bucket, rate: increase of a counter (ts_ms, value) a second within each window, with resets counted from zero.

    Samples of the same time go by the columns of ties, and then by value, so that the rate doesn't depend on where rows lie.
    """
    bucket = F.floor(F.col("ts_ms") / window_ms)
    w = Window.partitionBy(*keys, "bucket").orderBy("ts_ms", *ties, "value")
    before = F.lag("value").over(w)
    step = F.when(before.isNull(), 0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    rows = samples.withColumn("bucket", bucket)
    return rows.withColumn("__step", step).groupBy(*keys, "bucket").agg((F.sum("__step") * 1000.0 / F.nullif(F.max("ts_ms") - F.min("ts_ms"), F.lit(0))).alias("rate"))


def directory_sizes(spark, path: str) -> DataFrame:
    """(directory, bytes, files) of a tree, from listings alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
