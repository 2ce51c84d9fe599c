"""Choice of the units that hold a timeline's replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pressure() -> Column:
    return 0.4 * F.col("cpu_usage") + 0.4 * F.col("memory_usage") + 0.2 * F.col("disk_usage")


def zone() -> Column:
    return F.coalesce(F.nullif(F.col("zone"), F.lit("")), F.lit("default"))


def candidates(units: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Units that can be written to, without the excluded addresses, with zone and pressure."""
    out = units.where("status = 'WRITABLE'")
    if excluded is not None:
        out = out.join(excluded.select("address"), "address", "left_anti")
    return out.withColumn("zone", zone()).withColumn("pressure", pressure())


def select_ensemble(units: DataFrame, replicas: int, before: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(address, zone, pressure, rank) of the chosen units, at most `replicas`.

    Members of the ensemble before (address, pos) that can still be chosen stay, in their order. Then zones take turns, each with its unit of least pressure; in a turn zones with fewer members that stayed come first, then by name. Ties in pressure go by address. A result with fewer rows than replicas means that placement fails.
    """
    ready = candidates(units, excluded)
    empty = before is None
    kept = ready.select("address", "zone", "pressure", F.lit(None).cast("int").alias("pos")).where("false") if empty else ready.join(before.select("address", "pos"), "address").select("address", "zone", "pressure", "pos")
    fresh = ready.join(kept.select("address"), "address", "left_anti")
    used = kept.groupBy("zone").agg(F.count(F.lit(1)).alias("used"))
    turn = fresh.withColumn("turn", F.row_number().over(Window.partitionBy("zone").orderBy("pressure", "address"))).join(used, "zone", "left").na.fill(0, ["used"])
    both = kept.select("address", "zone", "pressure", F.lit(0).alias("turn"), F.col("pos").cast("long").alias("used")).unionByName(turn.select("address", "zone", "pressure", "turn", F.col("used").cast("long").alias("used")))
    top = both.orderBy("turn", "used", "zone", "address").limit(replicas)
    return top.select("address", "zone", "pressure", F.row_number().over(Window.orderBy("turn", "used", "zone", "address")).cast("long").alias("rank"))
