"""Reading a log: start positions, bounds, chunks, tiers and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CHUNK_ROWS, EARLIEST
from .ordered import running_max


def earliest() -> int:
    return EARLIEST


def latest(log: DataFrame, timeline) -> int:
    """One past the last offset that the timeline has now; EARLIEST for an empty one."""
    last = log.where(F.col("timeline") == timeline).agg(F.max("log_offset")).first()[0]
    return (last or 0) + 1


def index_start(log: DataFrame, timeline, column: str, value) -> int | None:
    """The first offset whose indexed column has the value; None if none has."""
    return log.where((F.col("timeline") == timeline) & (F.col(column) == value)).agg(F.min("log_offset")).first()[0]


def fetch(log: DataFrame, timeline, start: int = EARLIEST, end: int | None = None, limit: int | None = None, committed: DataFrame | None = None) -> DataFrame:
    """The events of one timeline from start to end, both included, in order of offset.

    `committed` (timeline, lra) leaves out what lies above the frontier. A limit takes the first rows by offset, as a top-k of each task and then of all. The filters reach the scan of a log that is stored sorted by (timeline, log_offset).
    """
    out = log.where((F.col("timeline") == timeline) & (F.col("log_offset") >= start))
    if end is not None:
        out = out.where(F.col("log_offset") <= end)
    if committed is not None:
        out = out.join(committed.select("timeline", "lra"), "timeline").where("log_offset <= lra").drop("lra")
    out = out.orderBy("log_offset")
    return out if limit is None else out.limit(limit)


def last_offsets(log: DataFrame) -> DataFrame:
    """(timeline, last_offset)."""
    return log.groupBy("timeline").agg(F.max("log_offset").alias("last_offset"))


def user_view(log: DataFrame) -> DataFrame:
    """What a reader sees: a null payload is an empty one."""
    return log.withColumn("payload", F.coalesce(F.col("payload"), F.lit("").cast(log.schema["payload"].dataType)))


def ack_view(log: DataFrame) -> DataFrame:
    """What a writer gets back: the position, without payload and time."""
    return log.select("timeline", "term", "log_offset", F.lit(None).cast("string").alias("payload"), F.lit(-1).cast("long").alias("ts_ms"))


def project_payload(log: DataFrame, schemas: dict[int, str], columns: dict[str, str]) -> DataFrame:
    """Events with typed columns out of JSON payloads: schemas has the DDL of each schema_id, columns the names and types wanted. A column that an event's schema lacks, and what can't be parsed, is null; so are all of an event without a known schema."""
    parsed = {i: F.from_json("payload", ddl) for i, ddl in schemas.items()}
    fields = {i: T.StructType.fromDDL(ddl).fieldNames() for i, ddl in schemas.items()}

    def value(name: str, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for i, p in parsed.items():
            if name in fields[i]:
                out = F.when(F.col("schema_id") == i, p[name].cast(kind)).otherwise(out)
        return out.alias(name)

    return log.select("*", *[value(n, k) for n, k in columns.items()])


def decodable(log: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that can be decoded, and how many can't by timeline."""
    good = F.coalesce(ok, F.lit(False))
    return log.where(good), log.groupBy("timeline").agg(F.count_if(~good).alias("skipped"))


def chunked(log: DataFrame, rows: int = CHUNK_ROWS, open_ended: bool = False) -> DataFrame:
    """(timeline, chunk_no, chunk_type, n, first_offset, advanced_offset) of a dense log read from its start.

    One chunk is FULL; else they are FIRST, MIDDLE.. and LAST. Of an open-ended read, which has no last row, all chunks count as FIRST and MIDDLE, and an empty LAST with the last offset follows.
    Offsets that are dense give the chunk by division, so that chunks are sums that need no window.
    """
    first = log.groupBy("timeline").agg(F.min("log_offset").alias("low"), F.max("log_offset").alias("high"))
    per = log.join(first, "timeline").groupBy("timeline", F.floor((F.col("log_offset") - F.col("low")) / rows).alias("chunk_no"), "low", "high").agg(F.count(F.lit(1)).alias("n"), F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("advanced_offset"))
    final = F.floor((F.col("high") - F.col("low")) / rows)
    if not open_ended:
        kind = F.when(final == 0, "FULL").when(F.col("chunk_no") == 0, "FIRST").when(F.col("chunk_no") == final, "LAST").otherwise("MIDDLE")
        return per.select("timeline", "chunk_no", kind.alias("chunk_type"), "n", "first_offset", "advanced_offset")
    body = per.select("timeline", "chunk_no", F.when(F.col("chunk_no") == 0, "FIRST").otherwise("MIDDLE").alias("chunk_type"), "n", "first_offset", "advanced_offset")
    end = first.select("timeline", (final + 1).alias("chunk_no"), F.lit("LAST").alias("chunk_type"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first_offset"), F.col("high").alias("advanced_offset"))
    return body.unionByName(end)


def newest(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row per key: the one that is greatest by the given columns, which must leave no ties.

    A max over structs is summed up before the shuffle, so that a key with many versions sends one row from each task.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in rest])


def merge_tiers(tiers: list[DataFrame], keys: tuple[str, ...] = ("timeline", "log_offset")) -> DataFrame:
    """The union of tiers, newest tier first; of rows with one key the newest tier's stays. `tier` is its number."""
    rows = None
    for i, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(i))
        rows = t if rows is None else rows.unionByName(t)
    return newest(rows, list(keys), [-F.col("tier")])


def segment_ends(segments: DataFrame) -> DataFrame:
    """Segments with end_offset, the one before the next segment's start; null for the last. The window holds a timeline's segments, not its events."""
    w = Window.partitionBy("timeline").orderBy("start_offset")
    return segments.withColumn("end_offset", F.lead("start_offset").over(w) - 1)


def asof(events: DataFrame, marks: DataFrame, keys: list[str], at: str, start: str) -> DataFrame:
    """Events with the columns of the last mark of their key whose start is at most the event's `at`; events before any mark are left out. Starts are unique in a key.

    Both sides run in one order, and the largest start so far is the mark's: an event is never paired with all marks of its key, and a hot key runs in buckets. The mark's other columns then come by an equi-join.
    """
    both = marks.select(*keys, (F.col(start) * 2).alias("__order"), F.col(start).alias("__own"), F.lit(None).cast(events.schema).alias("__event"))
    both = both.unionByName(events.select(*keys, (F.col(at) * 2 + 1).alias("__order"), F.lit(None).cast(marks.schema[start].dataType).alias("__own"), F.struct("*").alias("__event")))
    found = running_max(both, keys, "__order", "__own", "__start").where("__event IS NOT NULL AND __start IS NOT NULL").select("__event.*", F.col("__start").alias(start))
    return found.join(marks, [*keys, start])


def with_segment(log: DataFrame, segments: DataFrame) -> DataFrame:
    """Each event with the last segment that starts at or before it, and that segment's end_offset."""
    return asof(log, segment_ends(segments), ["timeline"], "log_offset", "start_offset")


def first_reachable(segments: DataFrame, reachable: DataFrame) -> DataFrame:
    """Segments with `unit`, the first of the ensemble, in its order, that is reachable; null if none is."""
    member = segments.select("timeline", "start_offset", F.posexplode("ensemble").alias("pos", "address"))
    best = member.join(reachable.select("address").distinct(), "address", "left_semi").groupBy("timeline", "start_offset").agg(F.min_by("address", "pos").alias("unit"))
    return segments.join(best, ["timeline", "start_offset"], "left")
