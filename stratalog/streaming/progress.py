"""Counters of streaming queries, taken from their progress reports."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Counters(StreamingQueryListener):
    """Rows in, batches and batch time by query, as a table like that of the other metrics. It holds one row per query on the driver."""

    SCHEMA = "query string, name string, value double"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.values: dict[tuple[str, str], float] = defaultdict(float)
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        self.values[event.name or str(event.id), "starts"] += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.values[name, "batches"] += 1
        self.values[name, "input_rows"] += p.numInputRows
        self.values[name, "batch_ms"] += p.durationMs.get("triggerExecution", 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.values[str(event.id), "failures"] += event.exception is not None

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([(q, n, v) for (q, n), v in sorted(self.values.items())], self.SCHEMA)

    def close(self) -> None:
        self.spark.streams.removeListener(self)
