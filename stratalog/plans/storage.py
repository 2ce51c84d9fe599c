"""A log on storage: levels of segments under a folder, with a manifest whose versions are folders made once each.

Recent batches are kept in an active tier and then a sealed one, both level 0, until they are flushed or cleared. Flush writes a level-1 segment; merge rewrites all level-1 segments as one level-2 run sorted by (timeline, offset); split writes level-2 rows to a level-3 folder per timeline; offload moves level 3 to a cold path. Rows that a newer write has replaced vanish when their segment is rewritten. There is one writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.log import newest
from ..operators.segments import expired

#: The bounds of a segment's timelines and offsets tell which segments can hold a key.
MANIFEST = "segment_id long, level int, path string, location string, size long, entry_count long, created_at long, low_timeline string, high_timeline string, low_offset long, high_offset long"
#: Columns of a segment's rows; seq orders writes over all batches.
ROWS = "timeline string, log_offset long, seq long, payload string, segment_id long"
TRIGGER = 4


class LogStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def version(self) -> int:
        """The newest version of the manifest that was written to its end; -1 for none. One listing, and a look at the newest folders."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(top):
            return -1
        numbers = sorted((int(f.getPath().getName()) for f in files.listStatus(top) if f.getPath().getName().isdigit()), reverse=True)
        return next((v for v in numbers if self._exists(f"{self.folder}/manifest/{v}/_SUCCESS")), -1)

    def manifest(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], MANIFEST) if v < 0 else self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{v}")

    def _publish(self, rows: list[dict]) -> None:
        """The next version of the manifest; a reader sees the old one until this one is whole."""
        self.spark.createDataFrame([tuple(r[c.split()[0]] for c in MANIFEST.split(", ")) for r in rows], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{self.version() + 1}")

    def _rows(self) -> list[dict]:
        return [r.asDict() for r in self.manifest().collect()]

    def _segment(self, df: DataFrame, level: int, now_ms: int, rows: list[dict], path: str | None = None) -> dict:
        number = max([0, *(r["segment_id"] for r in rows)]) + 1
        path = path or f"{self.folder}/segments/L{level}_{number:06d}"
        ordered = df.select("timeline", "log_offset", "seq", "payload", F.lit(number).cast("long").alias("segment_id")).repartitionByRange("timeline", "log_offset").sortWithinPartitions("timeline", "log_offset")
        ordered.write.mode("overwrite").parquet(path)
        found = self.spark.read.schema(ROWS).parquet(path).agg(*self._measures()).first().asDict()
        return {"segment_id": number, "level": level, "path": path, "location": "local", "created_at": now_ms} | found

    @staticmethod
    def _measures() -> list:
        ends = [f(c).alias(f"{n}_{c.removeprefix('log_')}") for c in ("timeline", "log_offset") for n, f in (("low", F.min), ("high", F.max))]
        return [F.count(F.lit(1)).alias("entry_count"), F.coalesce(F.sum(F.length("payload")), F.lit(0)).alias("size"), *ends]

    def scan(self, rows: list[dict] | None = None) -> DataFrame | None:
        """All rows of the segments, with the number of theirs: one scan over all paths."""
        paths = [r["path"] for r in (self._rows() if rows is None else rows)]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The newest version of each event, over all levels."""
        rows = self.scan()
        return None if rows is None else newest(rows, ["timeline", "log_offset"], [F.col("seq")])

    def append(self, batch: DataFrame, now_ms: int) -> None:
        """Keeps a batch in the active tier, where reads see it at once."""
        rows = self._rows()
        self._publish([*rows, self._segment(batch, 0, now_ms, rows) | {"location": "active"}])

    def seal(self) -> int:
        """Turns the active tier into the sealed one; returns how many batches that are. What is appended from now on is active."""
        rows = self._rows()
        if n := sum(r["location"] == "active" for r in rows):
            self._publish([r | {"location": "sealed"} if r["location"] == "active" else r for r in rows])
        return n

    def clear_sealed(self) -> int:
        """Drops the sealed tier; returns how many batches that were."""
        rows = self._rows()
        sealed = [r for r in rows if r["location"] == "sealed"]
        if sealed:
            self._replace(rows, sealed, [])
        return len(sealed)

    def flush_sealed(self, now_ms: int) -> bool:
        """Writes the sealed tier as one level-1 segment and clears it; nothing for an empty one."""
        rows = self._rows()
        sealed = [r for r in rows if r["location"] == "sealed"]
        if not sealed:
            return False
        made = self._segment(newest(self.scan(sealed), ["timeline", "log_offset"], [F.col("seq")]), 1, now_ms, rows)
        self._replace(rows, sealed, self._kept(made))
        return True

    def flush(self, batch: DataFrame, now_ms: int) -> None:
        """Writes a batch (timeline, log_offset, seq, payload); seq orders writes over all batches."""
        rows = self._rows()
        self._publish([*rows, self._segment(batch, 1, now_ms, rows)])

    def _kept(self, made: dict) -> list[dict]:
        """A segment that was made, if it has rows; the folder of an empty one goes."""
        if made["entry_count"]:
            return [made]
        self._delete(made["path"])
        return []

    @staticmethod
    def _may_share(a: dict, b: dict) -> bool:
        """Whether two segments' bounds leave room for a key that both have."""
        return bool(a["entry_count"] and b["entry_count"]) and a["low_timeline"] <= b["high_timeline"] and b["low_timeline"] <= a["high_timeline"] and a["low_offset"] <= b["high_offset"] and b["low_offset"] <= a["high_offset"]

    def _live(self, source: list[dict], rows: list[dict]) -> DataFrame:
        """Rows of the source segments that no newer row replaces.

        Besides the source, only segments whose bounds overlap with a source segment's are read, and of them only offsets between the source's least and greatest of their timeline, which the files' statistics prune.
        """
        own = self.scan(source)
        ids = {r["segment_id"] for r in source}
        others = [r for r in rows if r["segment_id"] not in ids and any(self._may_share(r, s) for s in source)]
        if not others:
            return newest(own, ["timeline", "log_offset"], [F.col("seq")])
        span = own.groupBy("timeline").agg(F.min("log_offset").alias("__low"), F.max("log_offset").alias("__high"))
        low, high = min(r["low_offset"] for r in source if r["entry_count"]), max(r["high_offset"] for r in source if r["entry_count"])
        near = self.scan(others).where(F.col("log_offset").between(low, high)).join(span, "timeline").where("log_offset BETWEEN __low AND __high").select(*own.columns)
        return newest(own.unionByName(near), ["timeline", "log_offset"], [F.col("seq")]).where(F.col("segment_id").isin(sorted(ids)))

    def merge(self, now_ms: int, trigger: int = TRIGGER) -> bool:
        rows = self._rows()
        source = [r for r in rows if r["level"] == 1]
        if len(source) < trigger:
            return False
        self._replace(rows, source, self._kept(self._segment(self._live(source, rows), 2, now_ms, rows)))
        return True

    def split(self, now_ms: int, trigger: int = TRIGGER) -> bool:
        """One level-3 segment per timeline, all written by one job; a hot timeline's rows are spread over files by offset."""
        rows = self._rows()
        source = [r for r in rows if r["level"] == 2]
        if len(source) < trigger:
            return False
        live = self._live(source, rows).drop("segment_id")
        top = max(r["segment_id"] for r in rows)
        ids = live.select("timeline").distinct().withColumn("segment_id", F.row_number().over(Window.orderBy("timeline")).cast("long") + top)
        base = f"{self.folder}/segments/L3_from_{top + 1:06d}"
        dealt = live.join(ids, "timeline").withColumn("part", F.col("segment_id")).repartitionByRange("part", "log_offset")
        dealt.sortWithinPartitions("part", "log_offset").write.mode("overwrite").partitionBy("part").parquet(base)
        sizes = self.spark.read.schema(ROWS).parquet(base).groupBy("segment_id").agg(*self._measures())
        made = [{"level": 3, "path": f"{base}/part={r.segment_id}", "location": "local", "created_at": now_ms} | r.asDict() for r in sizes.collect()]
        self._replace(rows, source, made)
        return True

    def compact(self, now_ms: int) -> tuple[bool, bool]:
        """Merge and split whatever there is, as an operator may ask for."""
        return self.merge(now_ms, 1), self.split(now_ms, 1)

    def offload(self, cold: str) -> int:
        """Copies local level-3 segments to the cold path, and reads them from there; they stay level 3."""
        rows = self._rows()
        moved = []
        for r in rows:
            if r["level"] == 3 and r["location"] == "local":
                path = f"{cold}/L3_{r['segment_id']:06d}"
                self.spark.read.schema(ROWS).parquet(r["path"]).write.mode("overwrite").parquet(path)
                moved.append((r["path"], r | {"path": path, "location": "remote"}))
        if moved:
            new = {m["segment_id"]: m for _, m in moved}
            self._publish([new.get(r["segment_id"], r) for r in rows])
            for path, _ in moved:
                self._delete(path)
        return len(moved)

    def retain(self, now_ms: int, ttl_ms: int) -> int:
        """Drops segments of levels 3 and 4 that are past their time."""
        gone = {r.segment_id for r in expired(self.manifest(), now_ms, F.lit(ttl_ms)).collect()}
        rows = self._rows()
        if gone:
            self._replace(rows, [r for r in rows if r["segment_id"] in gone], [])
        return len(gone)

    def _replace(self, rows: list[dict], source: list[dict], made: list[dict]) -> None:
        gone = {r["segment_id"] for r in source}
        self._publish([r for r in rows if r["segment_id"] not in gone] + made)
        for r in source:
            self._delete(r["path"])


class SegmentCache:
    """Local copies of remote segments, at most `capacity` of them; the one that was used longest ago goes first. The folder is one that all machines share."""

    def __init__(self, store: LogStore, folder: str, capacity: int = 64):
        self.store, self.folder, self.capacity = store, folder, capacity
        self.paths: dict[int, str] = {}

    def path(self, segment_id: int) -> str:
        """Where a segment can be read: its own path, or for a remote one that of its copy, which is fetched if it isn't there."""
        if segment_id in self.paths:
            self.paths[segment_id] = self.paths.pop(segment_id)
            return self.paths[segment_id]
        row = next((r for r in self.store._rows() if r["segment_id"] == segment_id), None)
        if row is None:
            raise KeyError(f"segment {segment_id} is not in the manifest")
        if row["location"] != "remote":
            return row["path"]
        path = f"{self.folder}/cached_{segment_id:06d}"
        self.store.spark.read.schema(ROWS).parquet(row["path"]).write.mode("overwrite").parquet(path)
        self.paths[segment_id] = path
        while len(self.paths) > self.capacity:
            oldest = next(iter(self.paths))
            self.store._delete(self.paths.pop(oldest))
        return path

    def read(self, segment_id: int) -> DataFrame:
        return self.store.spark.read.schema(ROWS).parquet(self.path(segment_id))
