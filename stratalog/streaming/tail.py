"""A data source of one timeline of a stored log, for batch and streaming reads, and a sink that writes logs.

As a stream its offset is a log offset, which the checkpoint keeps, so that a restarted query goes on where it was. Each micro-batch reads (start, end] with the filters in the scan of the log's files; nothing is held in memory between batches. Rows travel as Arrow batches.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..model import EARLIEST

SCHEMA = "timeline string, log_offset long, ts_ms long, key string, payload string"
_ARROW = pa.schema([("timeline", pa.string()), ("log_offset", pa.int64()), ("ts_ms", pa.int64()), ("key", pa.string()), ("payload", pa.string())])


class _Range(InputPartition):
    def __init__(self, path: str, timeline: str, start: int, end: int):
        self.path, self.timeline, self.start, self.end = path, timeline, start, end


class _Log:
    """What both readers share. Files are read through pyarrow's file systems: local paths, and the URIs that it knows."""

    def __init__(self, options: dict):
        self.path, self.timeline = options["path"].removeprefix("file://"), options["timeline"]
        self.first = int(options.get("start", EARLIEST))
        self.rows = int(options.get("rows_per_partition", 100_000))
        self.last = int(options["end"]) if "end" in options else None
        if "limit" in options:
            # Offsets are dense, so that a limit is an end.
            stop = self.first + int(options["limit"]) - 1
            self.last = stop if self.last is None else min(self.last, stop)
        self.top = self.first - 1
        self.seen: set[str] = set()

    def end(self) -> int:
        """The last offset to read. Only files that weren't there before are looked at, by their row groups' statistics; a row group is read, in one column, where it holds other timelines too."""
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        newer = (ds.field("timeline") == self.timeline) & (ds.field("log_offset") > self.top)
        for part in ds.dataset(self.path, format="parquet").get_fragments():
            if part.path in self.seen:
                continue
            for group in part.split_by_row_group():
                known = group.row_groups[0].statistics or {}
                names, offsets = known.get("timeline"), known.get("log_offset")
                if names and not names["min"] <= self.timeline <= names["max"] or offsets and offsets["max"] <= self.top:
                    continue
                if names and offsets and names["min"] == names["max"]:
                    self.top = max(self.top, offsets["max"])
                    continue
                for batch in group.to_batches(columns=["log_offset"], filter=newer):
                    if batch.num_rows:
                        self.top = max(self.top, pc.max(batch["log_offset"]).as_py())
            self.seen.add(part.path)
        return self.top if self.last is None else min(self.top, self.last)

    def ranges(self, start: int, end: int) -> list[_Range]:
        return [_Range(self.path, self.timeline, a, min(a + self.rows, end)) for a in range(start, end, self.rows)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        wanted = (ds.field("timeline") == partition.timeline) & (ds.field("log_offset") >= partition.start) & (ds.field("log_offset") < partition.end)
        for batch in ds.dataset(partition.path, format="parquet").to_batches(columns=_ARROW.names, filter=wanted):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, _ARROW, strict=True)], schema=_ARROW)


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.log = _Log(options)

    def partitions(self) -> list[_Range]:
        return self.log.ranges(self.log.first, self.log.end() + 1) or [_Range(self.log.path, self.log.timeline, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition)


class _Reader(DataSourceStreamReader):
    """`reconnects` times in a row, the end of the log may fail to be found before the query fails; a look that succeeds sets the count back. Waits between double from `backoff_s` on."""

    def __init__(self, options: dict):
        self.log = _Log(options)
        self.most, self.backoff = int(options.get("reconnects", 5)), float(options.get("backoff_s", 0.1))

    def initialOffset(self) -> dict:
        return {"next": self.log.first}

    def latestOffset(self) -> dict:
        for attempt in range(self.most + 1):
            try:
                return {"next": self.log.end() + 1}
            except OSError:
                if attempt == self.most:
                    raise
                time.sleep(self.backoff * 2**attempt)
        raise AssertionError

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return self.log.ranges(start["next"], end["next"])

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.log.read(partition)

    def commit(self, end: dict) -> None:
        pass


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceArrowWriter):
    """One file for each task, sorted by timeline and offset, so that row groups have narrow statistics. Files appear when the job has succeeded; those of a job that failed go."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        import pyarrow.parquet as pq
        from pyarrow import fs

        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return _Written(None)
        table = pa.Table.from_batches(batches).select(_ARROW.names).cast(_ARROW).sort_by([("timeline", "ascending"), ("log_offset", "ascending")])
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        system.create_dir(path, recursive=True)
        name = f"{path}/_part-{uuid.uuid4().hex}.parquet"
        pq.write_table(table, name, filesystem=system, row_group_size=100_000)
        return _Written(name)

    def _each(self, messages):
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for m in messages:
            if m is not None and m.path:
                yield system, m.path

    def commit(self, messages) -> None:
        for system, path in self._each(messages):
            head, _, name = path.rpartition("/")
            system.move(path, f"{head}/{name.removeprefix('_')}")

    def abort(self, messages) -> None:
        for system, path in self._each(messages):
            system.delete_file(path)


class LogSource(DataSource):
    """spark.read or spark.readStream.format("stratalog").option("timeline", ..).load(path), with options start, end, limit, rows_per_partition, and for streams reconnects and backoff_s; and df.write.format("stratalog").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "stratalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _BatchReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a log is only appended to")
        return _Writer(self.options)


def _options(timeline: str, start: int, end: int | None, limit: int | None) -> dict:
    given = {"timeline": timeline, "start": start, "end": end, "limit": limit}
    return {k: str(v) for k, v in given.items() if v is not None}


def read_log(spark: SparkSession, path: str, timeline: str, start: int = EARLIEST, end: int | None = None, limit: int | None = None) -> DataFrame:
    """A timeline's stored events from start on, up to an end or a limit, as they are now."""
    spark.dataSource.register(LogSource)
    return spark.read.format("stratalog").options(**_options(timeline, start, end, limit)).load(path)


def write_log(df: DataFrame, path: str) -> None:
    """Appends events to a stored log; all of them become visible, or none but for a failure in the middle of the commit's renames."""
    df.sparkSession.dataSource.register(LogSource)
    df.select(*_ARROW.names).write.format("stratalog").mode("append").save(path)


def tail(spark: SparkSession, path: str, timeline: str, start: int = EARLIEST, end: int | None = None, limit: int | None = None, reconnects: int = 5) -> DataFrame:
    """A streaming DataFrame of a timeline's events from start on. An `end` or a `limit` bounds it; follow() ends it by time."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("stratalog").options(**_options(timeline, start, end, limit), reconnects=reconnects).load(path)


def follow(stream: DataFrame, sink, checkpoint: str, timeout_s: float | None = None, limit: int | None = None, reconnects: int = 5, poll_s: float = 0.2) -> int:
    """Runs a stream into a foreachBatch sink until `limit` rows have come, or `timeout_s` has passed since the start; returns the number of rows.

    A query that fails is started again from its checkpoint, `reconnects` times in a row at most, after waits that double; a batch that goes through sets the count back. One batch may go over the limit where the source itself has none.
    """
    began, rows, failed, wait = time.monotonic(), 0, 0, poll_s

    def count(batch: DataFrame, batch_id: int) -> None:
        nonlocal rows, failed, wait
        held = batch.persist()
        try:
            sink(held, batch_id)
            rows += held.count()
        finally:
            held.unpersist()
        failed, wait = 0, poll_s

    while True:
        query = stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(poll_s * 1000)} milliseconds").start()
        try:
            while not query.awaitTermination(poll_s):
                over = timeout_s is not None and time.monotonic() - began >= timeout_s
                if over or (limit is not None and rows >= limit):
                    return rows
        except Exception:
            failed += 1
            if failed > reconnects:
                raise
            time.sleep(wait)
            wait *= 2
        finally:
            query.stop()


def tail_files(spark: SparkSession, path: str, schema, timeline: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same over Spark's own file source, for paths that only Spark reads: new files are new events, in order of their arrival."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).where(F.col("timeline") == timeline)
