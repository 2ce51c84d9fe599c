"""The catalog: versioned rows under compare-and-set, in memory as DataFrames and on storage as versions of a table.

A change is a row (name, expected, ..). It is applied if `expected` is the current version, -1 for a row that must not exist. On storage a version is claimed before it is written: a file for (row, version) is created, which fails if it is there, so that of several writers one succeeds. The claim holds the row; a version whose writer stopped between the two is completed by the next one that comes to it.
"""

from __future__ import annotations

import json
import os
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .log import newest
from .ordered import following_min, running_sum


class Conflict(Exception):
    """The row's version isn't the one expected."""


class NotFound(Exception):
    """No such row."""


def current(versions: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """The newest version of each row, without deleted ones."""
    return newest(versions, list(keys), [F.col("version")]).where("NOT deleted")


#: Changes of one name that are looked at one after another in one task; longer histories are followed by joins.
HISTORY = 100_000


def _in_order(t: pa.Table) -> pa.Table:
    """The outcomes of one name's changes, in one pass."""
    t = t.sort_by("seq")
    version, applied, versions = -1, [], []
    for expected in t.column("expected").to_pylist():
        applied.append(expected == version)
        version += applied[-1]
        versions.append(version)
    return pa.table({"name": t.column("name"), "seq": t.column("seq"), "expected": t.column("expected"), "applied": pa.array(applied, pa.bool_()), "version": pa.array(versions, pa.int64())})


def _followed(changes: DataFrame) -> DataFrame:
    """The same without a task that holds a history: each change points to the first one after it that expects the next version; the applied ones are those that the first change of version -1 reaches, found by doubling the pointers."""
    mark = lambda version, own: changes.select("name", version.alias("v"), (F.col("seq") * 2).alias("o"), own.alias("seq_to"), F.col("seq").alias("at"))
    both = mark(F.col("expected"), F.col("seq")).unionByName(mark(F.col("expected") + 1, F.lit(None).cast("long")))
    jump = following_min(both, ["name", "v"], "o", "seq_to", "to").where("seq_to IS NULL AND to IS NOT NULL").select("name", "at", "to")
    reached = changes.where("expected = -1").groupBy("name").agg(F.min("seq").alias("at"))
    while True:
        jump, reached = jump.checkpoint(), reached.checkpoint()
        further = reached.join(jump, ["name", "at"]).select("name", F.col("to").alias("at"))
        if further.isEmpty():
            break
        reached = reached.unionByName(further)
        jump = jump.alias("a").join(jump.alias("b"), (F.col("a.name") == F.col("b.name")) & (F.col("a.to") == F.col("b.at"))).select("a.name", "a.at", "b.to")
    flagged = changes.join(reached.select("name", F.col("at").alias("seq"), F.lit(1).cast("long").alias("one")), ["name", "seq"], "left").na.fill(0, ["one"])
    out = running_sum(flagged, ["name"], "seq", "one", "n")
    return out.select("name", "seq", "expected", (F.col("one") == 1).alias("applied"), (F.col("n") - 1).alias("version"))


def cas_outcomes(changes: DataFrame, history: int = HISTORY) -> DataFrame:
    """(name, seq, expected, applied, version) of changes in order of seq to rows that begin at version -1: a change is applied if it expects the version that the ones before it left, and makes the next.

    A name with at most `history` changes is one pass over them. Names with more, which are found by a count, are followed by joins, in as many rounds as the number of their versions has binary digits; these need a checkpoint folder.
    """
    rows = changes.select("name", F.col("seq").cast("long").alias("seq"), F.col("expected").cast("long").alias("expected"))
    schema = f"name {rows.schema['name'].dataType.simpleString()}, seq long, expected long, applied boolean, version long"
    long_ = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > history).select("name")
    if long_.isEmpty():
        return rows.groupBy("name").applyInArrow(_in_order, schema)
    short = rows.join(long_, "name", "left_anti").groupBy("name").applyInArrow(_in_order, schema)
    return short.unionByName(_followed(rows.join(long_, "name", "left_semi").select("name", "seq", "expected")))


def rebuilt_segments(segments: DataFrame, lra: DataFrame, ensemble) -> DataFrame:
    """Segments after a takeover: those that start at or below the frontier, and a new one behind it."""
    kept = segments.join(lra, "timeline").where("start_offset <= lra").select("timeline", "start_offset", "ensemble")
    return kept.unionByName(lra.select("timeline", (F.col("lra") + 1).alias("start_offset"), ensemble.alias("ensemble")))


class Catalog:
    """Tables `timelines`, `segments` and `units` under a folder that all machines share."""

    SCHEMAS = {
        "timelines": "name string, timeline_id long, status string, term long, lra long, version long, deleted boolean",
        "segments": "name string, start_offset long, ensemble array<string>, version long, deleted boolean",
        "units": "zone string, address string, status string, cpu_usage double, memory_usage double, disk_usage double, version long, deleted boolean",
    }
    KEYS = {"timelines": ("name",), "segments": ("name", "start_offset"), "units": ("zone", "address")}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def versions(self, table: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.SCHEMAS[table])
        return self.spark.read.schema(self.SCHEMAS[table]).parquet(self._path(table))

    def list(self, table: str) -> DataFrame:
        return current(self.versions(table), self.KEYS[table])

    def get(self, table: str, **key) -> dict:
        rows = self.list(table)
        for k, v in key.items():
            rows = rows.where(F.col(k) == v)
        found = rows.first()
        if found is None:
            raise NotFound(f"{table}: {key}")
        return found.asDict()

    def _claim(self, table: str, key: dict, version: int, row: dict) -> bool:
        """Creates the version's file, in one step that fails if it is there. Where it is, a row that is missing from the table is added."""
        path = f"{self.folder}/_claims/{table}/{quote(json.dumps(list(key.values())), safe='')}/{version:020d}"
        where = urlparse(path)
        if where.scheme in ("", "file"):
            os.makedirs(os.path.dirname(where.path), exist_ok=True)
            try:
                with os.fdopen(os.open(where.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    json.dump(row, f)
                return True
            except FileExistsError:
                with open(where.path) as f:
                    held = f.read()
        else:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
            try:
                out = files.create(hadoop, False)
                out.write(bytearray(json.dumps(row).encode()))
                out.close()
                return True
            except Exception:
                if not files.exists(hadoop):
                    raise
            held = "".join(r.value for r in self.spark.read.text(path).collect())
        # An empty claim is one that is being made right now.
        if held and self._at(table, key).where(F.col("version") == version).isEmpty():
            self._append(table, json.loads(held))
        return False

    def _append(self, table: str, row: dict) -> None:
        self.spark.createDataFrame([row], self.SCHEMAS[table]).coalesce(1).write.mode("append").parquet(self._path(table))

    def _at(self, table: str, key: dict) -> DataFrame:
        rows = self.versions(table)
        for k, v in key.items():
            rows = rows.where(F.col(k) == v)
        return rows

    def put(self, table: str, expected: int, deleted: bool = False, **row) -> int:
        """Writes a row if its version is `expected`, -1 for none; returns the new version. Of writers that expect the same version one succeeds, the others get a Conflict."""
        key = {k: row[k] for k in self.KEYS[table]}
        last = self._at(table, key).orderBy(F.desc("version")).first()
        now = -1 if last is None or last.deleted else last.version
        if now != expected:
            raise Conflict(f"{table}: {key} is at version {now}, not {expected}")
        version = (-1 if last is None else last.version) + 1
        whole = {f.split()[0]: None for f in self.SCHEMAS[table].split(", ")} | row | {"version": version, "deleted": deleted}
        if not self._claim(table, key, version, whole):
            raise Conflict(f"{table}: {key} got version {version} from another writer")
        self._append(table, whole)
        return version

    def delete(self, table: str, expected: int, **key) -> None:
        self.put(table, expected, deleted=True, **key)

    def create_timeline(self, name: str) -> dict:
        top = self.versions("timelines").agg(F.max("timeline_id")).first()[0] or 0
        self.put("timelines", -1, name=name, timeline_id=top + 1, status="ACTIVE", term=0, lra=0)
        return self.get("timelines", name=name)

    def drop_timeline(self, name: str) -> None:
        """Deletes a timeline with its segments."""
        for s in self.list("segments").where(F.col("name") == name).collect():
            self.delete("segments", s.version, name=name, start_offset=s.start_offset)
        self.delete("timelines", self.get("timelines", name=name)["version"], name=name)

    def register_unit(self, address: str, zone: str = "", status: str = "WRITABLE", load: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> int:
        """Puts a unit's registration with its load, over an older one if there is one."""
        zone = zone or "default"
        own = self.list("units").where((F.col("zone") == zone) & (F.col("address") == address)).first()
        return self.put("units", -1 if own is None else own.version, zone=zone, address=address, status=status, cpu_usage=load[0], memory_usage=load[1], disk_usage=load[2])

    def unregister_unit(self, address: str, zone: str = "") -> None:
        zone = zone or "default"
        self.delete("units", self.get("units", zone=zone, address=address)["version"], zone=zone, address=address)

    def last_segment(self, name: str):
        return self.list("segments").where(F.col("name") == name).orderBy(F.desc("start_offset")).first()


def ranked(df: DataFrame, keys: list[str], order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
