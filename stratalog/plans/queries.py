"""The engine's queries over the tables of a directory, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import payload as P
from ..functions import records as R
from ..operators import catalog, frontier, log, metrics, ordered, placement, segments, verify
from ..sources.tables import acks, arrivals, conversations_log, events_log, table, units
from ..sources.wal import last_records, read_wal
from .storage import LogStore, SegmentCache
from .timeline import change_ensemble, missing_copies, open_timeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_LOG = """log AS (
  SELECT event_type AS timeline, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, user_id AS key, value, props AS payload,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS log_offset FROM events
)"""
_ACKS = f"""{_LOG}, acks AS (
  SELECT timeline, log_offset, unit FROM log, (VALUES ('u0'), ('u1'), ('u2')) AS u(unit)
  WHERE NOT (unit = 'u1' AND seq % 997 = 500) AND NOT (unit = 'u2' AND seq >= 9000 AND seq % 2 = 1)
), counts AS (
  SELECT log.timeline, log.log_offset, count(DISTINCT unit) AS n_units FROM log LEFT JOIN acks ON acks.timeline = log.timeline AND acks.log_offset = log.log_offset GROUP BY ALL
), frontier AS (
  SELECT timeline, max(log_offset) AS lrs, coalesce(min(CASE WHEN n_units < 3 THEN log_offset END) - 1, max(log_offset)) AS lra FROM counts GROUP BY timeline
)"""
_UNITS = """units AS (
  SELECT s_name AS address, 'zone-' || CAST(s_nationkey % 5 AS VARCHAR) AS zone, CASE WHEN s_suppkey % 7 = 0 THEN 'READONLY' ELSE 'WRITABLE' END AS status,
         (s_suppkey * 37 % 100) / 100.0 AS cpu_usage, (s_suppkey * 53 % 100) / 100.0 AS memory_usage, (s_suppkey * 71 % 100) / 100.0 AS disk_usage FROM supplier
), ready AS (
  SELECT address, zone, 0.4 * CAST(cpu_usage AS DOUBLE) + 0.4 * CAST(memory_usage AS DOUBLE) + 0.2 * CAST(disk_usage AS DOUBLE) AS pressure FROM units WHERE status = 'WRITABLE'
)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Reading a log


@query("record_offsets", f"WITH {_LOG} SELECT seq, timeline, log_offset FROM log")
def _(spark, d):
    return events_log(spark, d).select("seq", "timeline", "log_offset")


@query("fetch_range", f"WITH {_LOG} SELECT timeline, log_offset, ts_ms, payload FROM log WHERE timeline = 'click' AND log_offset BETWEEN 100 AND 250")
def _(spark, d):
    return log.fetch(events_log(spark, d), "click", 100, 250).select("timeline", "log_offset", "ts_ms", "payload")


@query("fetch_earliest", f"WITH {_LOG} SELECT timeline, log_offset, payload FROM log WHERE timeline = 'view'")
def _(spark, d):
    return log.fetch(events_log(spark, d), "view", log.earliest()).select("timeline", "log_offset", "payload")


@query("fetch_latest", f"WITH {_LOG}, last AS (SELECT max(log_offset) AS m FROM log WHERE timeline = 'click' AND seq < 700) SELECT timeline, log_offset, seq FROM log, last WHERE timeline = 'click' AND log_offset > coalesce(m, 0)")
def _(spark, d):
    """What came after a handle looked up the end of the log, when it held the events before sequence 700."""
    whole = events_log(spark, d)
    return log.fetch(whole, "click", log.latest(whole.where("seq < 700"), "click")).select("timeline", "log_offset", "seq")


@query("fetch_limit", f"WITH {_LOG} SELECT timeline, log_offset, payload FROM log WHERE timeline = 'error' AND log_offset >= 26 ORDER BY log_offset LIMIT 75")
def _(spark, d):
    return log.fetch(events_log(spark, d), "error", 26, limit=75).select("timeline", "log_offset", "payload")


@query("fetch_index", f"WITH {_LOG}, s AS (SELECT min(log_offset) AS m FROM log WHERE timeline = 'purchase' AND key = 7) SELECT timeline, log_offset, key FROM log, s WHERE timeline = 'purchase' AND log_offset >= m")
def _(spark, d):
    whole = events_log(spark, d)
    start = log.index_start(whole, "purchase", "key", 7)
    return (log.fetch(whole, "purchase", start) if start is not None else whole.where("false")).select("timeline", "log_offset", "key")


@query("fetch_committed", f"WITH {_ACKS} SELECT log.timeline, log_offset, seq FROM log JOIN frontier USING (timeline) WHERE timeline = 'signup' AND log_offset <= lra")
def _(spark, d):
    whole = events_log(spark, d)
    return log.fetch(whole, "signup", committed=frontier.frontier(whole, acks(whole), 3)).select("timeline", "log_offset", "seq")


@query("fetch_conversation", "SELECT conv_id AS timeline, turn + 1 AS log_offset, role, text AS payload FROM conversations WHERE conv_id = 3 AND turn + 1 BETWEEN 1 AND 3")
def _(spark, d):
    return log.fetch(conversations_log(spark, d), 3, 1, 3)


@query("latest_offset", f"WITH {_LOG} SELECT timeline, max(log_offset) AS last_offset FROM log GROUP BY timeline")
def _(spark, d):
    return log.last_offsets(events_log(spark, d))


@query("user_projection", f"WITH {_LOG} SELECT timeline, log_offset, ts_ms, coalesce(CASE WHEN seq % 10 = 0 THEN NULL ELSE payload END, '') AS payload FROM log")
def _(spark, d):
    rows = events_log(spark, d).withColumn("payload", F.expr("CASE WHEN seq % 10 = 0 THEN NULL ELSE payload END"))
    return log.user_view(rows).select("timeline", "log_offset", "ts_ms", "payload")


@query("ack_projection", f"WITH {_LOG} SELECT timeline, CAST(1 AS BIGINT) AS term, log_offset, CAST(NULL AS VARCHAR) AS payload, CAST(-1 AS BIGINT) AS ts_ms FROM log")
def _(spark, d):
    return log.ack_view(events_log(spark, d).withColumn("term", F.lit(1).cast("long")))


@query("corrupt_rows_skipped", f"WITH {_LOG} SELECT timeline, CAST(sum(CASE WHEN TRY_CAST(json_extract_string(CASE WHEN seq % 13 = 0 THEN payload[:4] ELSE payload END, '$.k') AS BIGINT) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM (SELECT timeline, seq, CASE WHEN seq % 13 = 0 THEN '{{}}' ELSE payload END AS payload FROM log) GROUP BY timeline")
def _(spark, d):
    rows = events_log(spark, d).withColumn("payload", F.when(F.col("seq") % 13 == 0, F.lit("{}")).otherwise(F.col("payload")))
    return log.decodable(rows, F.get_json_object("payload", "$.k").try_cast("long").isNotNull())[1]


@query("payload_schema", f"WITH {_LOG} SELECT timeline, log_offset, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM log")
def _(spark, d):
    return events_log(spark, d).select("timeline", "log_offset", F.from_json("payload", "k bigint")["k"].alias("k"))


@query("chunk_types", f"""WITH {_LOG}, c AS (SELECT timeline, (log_offset - 1) // 100 AS chunk_no, count(*) AS n, min(log_offset) AS first_offset, max(log_offset) AS advanced_offset FROM log GROUP BY ALL)
SELECT timeline, chunk_no, CASE WHEN max(chunk_no) OVER w = 0 THEN 'FULL' WHEN chunk_no = 0 THEN 'FIRST' WHEN chunk_no = max(chunk_no) OVER w THEN 'LAST' ELSE 'MIDDLE' END AS chunk_type, n, first_offset, advanced_offset FROM c WINDOW w AS (PARTITION BY timeline)""")
def _(spark, d):
    return log.chunked(events_log(spark, d))


@query("wire_chunks", f"""WITH {_LOG}, c AS (SELECT timeline, (log_offset - 1) // 100 AS chunk_no, count(*) AS n, min(log_offset) AS first_offset, max(log_offset) AS advanced_offset FROM log GROUP BY ALL)
SELECT timeline, chunk_no, CASE WHEN chunk_no = 0 THEN 'FIRST' ELSE 'MIDDLE' END AS chunk_type, n, first_offset, advanced_offset FROM c
UNION ALL SELECT timeline, max(chunk_no) + 1, 'LAST', 0, NULL, max(advanced_offset) FROM c GROUP BY timeline""")
def _(spark, d):
    return log.chunked(events_log(spark, d), open_ended=True)


def _segments(rows: DataFrame, every: int = 400) -> DataFrame:
    return rows.where((F.col("log_offset") - 1) % every == 0).select("timeline", F.col("log_offset").alias("start_offset"))


@query("segment_asof", f"WITH {_LOG}, s AS (SELECT timeline, log_offset AS start_offset FROM log WHERE (log_offset - 1) % 400 = 0) SELECT log.timeline, log_offset, max(start_offset) AS start_offset FROM log JOIN s ON s.timeline = log.timeline AND start_offset <= log_offset GROUP BY ALL")
def _(spark, d):
    whole = events_log(spark, d)
    return log.with_segment(whole, _segments(whole)).select("timeline", "log_offset", "start_offset")


@query("segment_ends", f"WITH {_LOG}, s AS (SELECT timeline, log_offset AS start_offset FROM log WHERE (log_offset - 1) % 400 = 0) SELECT timeline, start_offset, lead(start_offset) OVER (PARTITION BY timeline ORDER BY start_offset) - 1 AS end_offset FROM s")
def _(spark, d):
    return log.segment_ends(_segments(events_log(spark, d)))


@query("first_replica", f"""WITH {_LOG}, s AS (SELECT timeline, log_offset AS start_offset, ['Supplier#' || (log_offset % 9 + 1), 'Supplier#' || (log_offset % 5 + 1), 'Supplier#' || (log_offset % 3 + 1)] AS e FROM log WHERE (log_offset - 1) % 400 = 0),
m AS (SELECT timeline, start_offset, e, generate_subscripts(e, 1) AS pos, unnest(e) AS unit FROM s)
SELECT s.timeline, s.start_offset, (SELECT arg_min(unit, pos) FROM m WHERE m.timeline = s.timeline AND m.start_offset = s.start_offset AND CAST(split_part(unit, '#', 2) AS BIGINT) % 4 <> 1) AS unit FROM s""")
def _(spark, d):
    name = lambda n: F.concat(F.lit("Supplier#"), (F.col("start_offset") % n + 1).cast("string"))
    s = _segments(events_log(spark, d)).withColumn("ensemble", F.array(name(9), name(5), name(3)))
    up = spark.range(1, 10).where("id % 4 <> 1").select(F.concat(F.lit("Supplier#"), F.col("id").cast("string")).alias("address"))
    return log.first_reachable(s, up).drop("ensemble")


@query("tier_merge", f"""WITH {_LOG}, t AS (
  SELECT timeline, log_offset, 'index' AS origin, 2 AS tier FROM log WHERE seq % 3 <> 0
  UNION ALL SELECT timeline, log_offset, 'sealed', 1 FROM log WHERE seq % 4 = 0
  UNION ALL SELECT timeline, log_offset, 'active', 0 FROM log WHERE seq % 6 = 0
) SELECT timeline, log_offset, arg_min(origin, tier) AS origin, min(tier) AS tier FROM t GROUP BY timeline, log_offset""")
def _(spark, d):
    rows = events_log(spark, d)
    tier = lambda where, name: rows.where(where).select("timeline", "log_offset", F.lit(name).alias("origin"))
    return log.merge_tiers([tier("seq % 6 = 0", "active"), tier("seq % 4 = 0", "sealed"), tier("seq % 3 <> 0", "index")])


# Acknowledgements, terms, truncation


@query("ack_frontier", f"WITH {_ACKS} SELECT timeline, lrs, lra FROM frontier")
def _(spark, d):
    rows = events_log(spark, d)
    return frontier.frontier(rows, acks(rows), 3)


@query("fully_replicated", f"WITH {_ACKS} SELECT timeline, log_offset, n_units FROM counts WHERE n_units < 3 AND n_units > 0")
def _(spark, d):
    rows = events_log(spark, d)
    a = acks(rows)
    return verify.not_fully_replicated(rows, a, a.select("timeline", "log_offset").distinct(), 3)


@query("acked_lost", f"WITH {_ACKS} SELECT DISTINCT log.timeline, log.log_offset, unit FROM log, (VALUES ('u0'), ('u1'), ('u2')) AS u(unit) WHERE (log.timeline, log.log_offset, unit) NOT IN (SELECT (timeline, log_offset, unit) FROM acks)".replace("(log.timeline, log.log_offset, unit) NOT IN (SELECT (timeline, log_offset, unit) FROM acks)", "NOT EXISTS (SELECT 1 FROM acks WHERE acks.timeline = log.timeline AND acks.log_offset = log.log_offset AND acks.unit = u.unit)"))
def _(spark, d):
    rows = events_log(spark, d)
    ensembles = rows.select("timeline").distinct().withColumn("ensemble", F.array(*[F.lit(f"u{i}") for i in range(3)]))
    return verify.acked_lost(rows, ensembles, acks(rows))


@query("acked_subset", f"WITH {_LOG} SELECT timeline, log_offset + 3 AS log_offset FROM log EXCEPT SELECT timeline, log_offset FROM log")
def _(spark, d):
    rows = events_log(spark, d)
    return verify.not_in(rows.withColumn("log_offset", F.col("log_offset") + 3), rows)


_WRITES = """w AS (SELECT o_orderpriority AS timeline, o_orderkey AS seq, CAST(floor(o_totalprice) AS BIGINT) % 97 AS term FROM orders)"""


def _terms(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("timeline"), F.col("o_orderkey").alias("seq"), (F.floor("o_totalprice") % 97).alias("term"))


@query("fence_outcome", f"""WITH {_WRITES}, b AS (SELECT *, coalesce(max(term) OVER (PARTITION BY timeline ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM w)
SELECT timeline, seq, term, term > before AS accepted, greatest(before, term) AS current_term FROM b""")
def _(spark, d):
    return frontier.fence(_terms(spark, d))


@query("term_check", f"""WITH {_WRITES}, s AS (SELECT timeline, CAST(50 AS BIGINT) AS unit_term FROM w WHERE timeline NOT LIKE '5%' GROUP BY timeline)
SELECT w.timeline, seq, term, unit_term, coalesce(term >= unit_term, TRUE) AS ok FROM w LEFT JOIN s USING (timeline)""")
def _(spark, d):
    rows = _terms(spark, d)
    state = rows.where("timeline NOT LIKE '5%'").groupBy("timeline").agg(F.lit(50).cast("long").alias("term"))
    return frontier.check_terms(rows, state).select("timeline", "seq", "term", "unit_term", "ok")


@query("lra_monotone", f"WITH {_LOG} SELECT timeline, greatest(max(log_offset), -1) AS lra FROM log GROUP BY timeline")
def _(spark, d):
    return frontier.monotone(events_log(spark, d).withColumnRenamed("log_offset", "lra"))


@query("truncate_replay", """WITH w AS (SELECT event_type AS timeline, event_id AS seq, CAST(floor(value) AS BIGINT) % 50 AS log_offset, event_id % 40 = 0 AS trunc FROM events),
c AS (SELECT *, min(CASE WHEN trunc THEN log_offset END) OVER (PARTITION BY timeline ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS least FROM w)
SELECT timeline, log_offset, max(seq) AS seq FROM c WHERE least IS NULL OR least > log_offset GROUP BY timeline, log_offset""")
def _(spark, d):
    w = arrivals(spark, d).select("timeline", "seq", (F.floor("value") % 50).alias("log_offset"), (F.col("seq") % 40 == 0).alias("trunc"))
    return frontier.truncated(w).select("timeline", "log_offset", "seq")


@query("transactions_visible", f"WITH {_LOG}, t AS (SELECT *, CASE WHEN seq % 5 = 0 THEN NULL ELSE seq // 10 END AS txn FROM log) SELECT timeline, log_offset, txn AS txn_id FROM t WHERE txn IS NULL OR txn % 3 <> 0")
def _(spark, d):
    rows = events_log(spark, d).select("timeline", "log_offset", F.expr("CASE WHEN seq % 5 = 0 THEN NULL ELSE seq div 10 END").alias("txn_id"))
    return frontier.committed_transactions(rows, rows.select("txn_id").where("txn_id % 3 <> 0"))


@query("orphaned_acks", f"WITH {_ACKS} SELECT unit, count(*) AS n FROM acks JOIN frontier USING (timeline) WHERE log_offset > lra GROUP BY unit")
def _(spark, d):
    rows = events_log(spark, d)
    a = acks(rows)
    return a.join(frontier.frontier(rows, a, 3), "timeline").where("log_offset > lra").groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


# Segments and index


def _entries(spark, d):
    """Documents as entries of segments of one source each."""
    return table(spark, d, "documents").select(F.col("source").alias("timeline"), F.col("doc_id").alias("log_offset"), (F.col("doc_id") % 7).alias("segment_id"), F.octet_length("text").cast("long").alias("length"))


_ENTRIES = "e AS (SELECT source AS timeline, doc_id AS log_offset, doc_id % 7 AS segment_id, CAST(strlen(text) AS BIGINT) AS length FROM documents)"


@query("compaction_split", f"WITH {_ENTRIES} SELECT timeline, log_offset, 20 + coalesce(CAST(sum(length) OVER (PARTITION BY timeline ORDER BY log_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS byte_offset FROM e")
def _(spark, d):
    return segments.placed(_entries(spark, d), ["timeline"], "log_offset", header=segments.HEADER_BYTES).select("timeline", "log_offset", "byte_offset")


@query("compaction_merge", f"WITH {_ENTRIES} SELECT log_offset, timeline, coalesce(CAST(sum(length) OVER (ORDER BY log_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS byte_offset FROM e WHERE segment_id < 4")
def _(spark, d):
    one = _entries(spark, d).where("segment_id < 4").withColumn("target", F.lit(1))
    return segments.placed(one, ["target"], "log_offset").select("log_offset", "timeline", "byte_offset")


@query("run_detect", f"""WITH {_ENTRIES}, p AS (SELECT *, CAST(sum(length) OVER (PARTITION BY segment_id ORDER BY log_offset) AS BIGINT) AS finish FROM e),
k AS (SELECT *, lag(finish) OVER (PARTITION BY segment_id ORDER BY log_offset) AS before FROM p WHERE log_offset % 11 <> 3)
SELECT segment_id, log_offset, CAST(sum(CASE WHEN before IS NULL OR before <> finish - length THEN 1 ELSE 0 END) OVER (PARTITION BY segment_id ORDER BY log_offset) AS BIGINT) AS run_no FROM k""")
def _(spark, d):
    placed = ordered.running_sum(_entries(spark, d), ["segment_id"], "log_offset", "length", "finish").where("log_offset % 11 <> 3")
    return segments.runs(placed, ["segment_id"], "log_offset", F.col("__previous") != F.col("finish") - F.col("length"), "finish").select("segment_id", "log_offset", "run_no")


@query("gap_runs", f"""WITH {_LOG}, g AS (SELECT timeline, log_offset, lag(log_offset) OVER (PARTITION BY timeline ORDER BY log_offset) AS after FROM log WHERE seq % 17 <> 5)
SELECT timeline, after, log_offset - after - 1 AS missing FROM g WHERE log_offset > after + 1""")
def _(spark, d):
    return verify.gaps(events_log(spark, d).where("seq % 17 <> 5"))


@query("segment_sizes", f"WITH {_ENTRIES} SELECT segment_id, CAST(sum(length) AS BIGINT) AS size, count(*) AS entry_count FROM e GROUP BY segment_id")
def _(spark, d):
    return segments.sizes(_entries(spark, d))


_MANIFEST = "m AS (SELECT p_partkey AS segment_id, p_size % 6 AS level, CAST(floor(p_retailprice) AS BIGINT) AS size, CASE WHEN p_partkey % 9 = 0 THEN 'remote' ELSE 'local' END AS location, p_partkey * 1000 AS created_at FROM part)"


def _manifest(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select(p.alias("segment_id"), (F.col("p_size") % 6).alias("level"), F.floor("p_retailprice").alias("size"), F.when(p % 9 == 0, "remote").otherwise("local").alias("location"), (p * 1000).alias("created_at"))


@query("level_summary", f"WITH {_MANIFEST} SELECT level, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM m WHERE level BETWEEN 1 AND 4 GROUP BY level")
def _(spark, d):
    return segments.at_level(_manifest(spark, d), 0).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("local_segments", f"WITH {_MANIFEST} SELECT segment_id, size FROM m WHERE level = 3 AND location = 'local'")
def _(spark, d):
    return segments.local_only(segments.at_level(_manifest(spark, d), 3)).select("segment_id", "size")


@query("retention_live", f"WITH {_MANIFEST}, i AS (SELECT l_partkey AS segment_id, l_orderkey FROM lineitem) SELECT l_orderkey, count(*) AS n FROM i WHERE segment_id NOT IN (SELECT segment_id FROM m WHERE level IN (3, 4) AND created_at > 0 AND created_at < 1500000 - 600000) GROUP BY l_orderkey")
def _(spark, d):
    index = table(spark, d, "lineitem").select(F.col("l_partkey").alias("segment_id"), "l_orderkey")
    return segments.retain(index, segments.expired(_manifest(spark, d), 1_500_000, F.lit(600_000))).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("retention_by_timeline", f"WITH {_MANIFEST} SELECT segment_id, level FROM m WHERE level IN (3, 4) AND created_at > 0 AND created_at < 1500000 - (CASE WHEN segment_id % 2 = 0 THEN 300000 ELSE 900000 END)")
def _(spark, d):
    return segments.expired(_manifest(spark, d), 1_500_000, F.when(F.col("segment_id") % 2 == 0, 300_000).otherwise(900_000)).select("segment_id", "level")


@query("index_resolve", f"WITH {_MANIFEST} SELECT l_orderkey AS timeline, l_linenumber AS log_offset, segment_id, '/segments/' || segment_id AS path, location FROM lineitem JOIN m ON l_partkey = segment_id")
def _(spark, d):
    index = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("timeline"), F.col("l_linenumber").alias("log_offset"), F.col("l_partkey").alias("segment_id"))
    manifest = _manifest(spark, d).withColumn("path", F.concat(F.lit("/segments/"), F.col("segment_id").cast("string")))
    return segments.resolve(index, manifest)


@query("wal_trim", "SELECT format('{:08d}.log', p_partkey) AS name FROM part WHERE p_partkey % 3 <> 0 AND p_partkey < 150")
def _(spark, d):
    p = F.col("p_partkey")
    return segments.trim_wal(table(spark, d, "part").select(F.when(p % 3 == 0, "x.txt").otherwise(K.wal_name(p)).alias("name")), 150)


@query("payload_by_schema", f"WITH {_LOG} SELECT timeline, log_offset, CASE WHEN seq % 3 < 2 THEN CAST(json_extract_string(payload, '$.k') AS BIGINT) END AS k FROM log")
def _(spark, d):
    rows = events_log(spark, d).withColumn("schema_id", F.col("seq") % 3)
    return log.project_payload(rows, {0: "k bigint", 1: "k int, other string"}, {"k": "bigint"}).select("timeline", "log_offset", "k")


@query("disk_usage", "SELECT s_suppkey, round(CASE WHEN s_suppkey % 10 > 0 THEN 1 - (s_suppkey % 7) / CAST(s_suppkey % 10 + 7 AS DOUBLE) ELSE 0 END, 9) AS used FROM supplier")
def _(spark, d):
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.round(K.disk_usage(s % 7, F.when(s % 10 > 0, s % 10 + 7).otherwise(0)), 9).alias("used"))


@query("orphan_segments", "SELECT p_partkey AS segment_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 13 <> 5)")
def _(spark, d):
    # An index that has lost the entries of every 13th segment.
    index = table(spark, d, "lineitem").where("l_partkey % 13 <> 5").select(F.col("l_partkey").alias("segment_id"))
    return segments.orphans(_manifest(spark, d).select("segment_id"), index)


@query("index_semi_scan", "SELECT l_partkey AS segment_id, l_orderkey AS timeline, l_linenumber AS log_offset FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def _(spark, d):
    index = table(spark, d, "lineitem").select(F.col("l_partkey").alias("segment_id"), F.col("l_orderkey").alias("timeline"), F.col("l_linenumber").alias("log_offset"))
    return segments.by_segment(index, table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("segment_id")))


@query("referenced_segments", "SELECT DISTINCT l_suppkey AS segment_id FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("segment_id")).distinct()


@query("upsert_latest", """SELECT l_orderkey AS timeline, l_linenumber AS log_offset, max(l_partkey * 1000 + l_suppkey) AS seq FROM lineitem GROUP BY ALL""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("timeline"), F.col("l_linenumber").alias("log_offset"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"))
    empty = rows.where("false").drop("seq")
    put = segments.index_put(empty.withColumn("value", F.lit(0).cast("long")), rows.withColumn("value", F.col("seq")))
    return put.select("timeline", "log_offset", F.col("value").alias("seq"))


@query("index_delete", f"WITH {_LOG} SELECT timeline, log_offset FROM log WHERE seq % 5 <> 2 AND NOT (timeline = 'click' AND log_offset BETWEEN 10 AND 60)")
def _(spark, d):
    rows = events_log(spark, d)
    return segments.index_delete_range(segments.index_delete(rows, rows.where("seq % 5 = 2")), "click", 10, 60).select("timeline", "log_offset")


@query("live_entries", f"WITH {_ENTRIES}, i AS (SELECT timeline, log_offset, CASE WHEN log_offset % 4 = 0 THEN segment_id + 1 ELSE segment_id END AS segment_id FROM e) SELECT e.* FROM e JOIN i USING (timeline, log_offset, segment_id)")
def _(spark, d):
    e = _entries(spark, d)
    return segments.live(e, e.withColumn("segment_id", F.when(F.col("log_offset") % 4 == 0, F.col("segment_id") + 1).otherwise(F.col("segment_id"))))


@query("key_compaction", f"WITH {_LOG} SELECT timeline, key, max(log_offset) AS log_offset, arg_max(payload, log_offset) AS payload FROM log GROUP BY timeline, key")
def _(spark, d):
    return segments.compact_keys(events_log(spark, d).select("timeline", "key", "log_offset", "payload"))


@query("segment_recovery", """WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'garbage.txt' WHEN 1 THEN format('segment_{:06d}.cseg', p_partkey) ELSE format('L{}_{:06d}.cseg', p_size % 4, p_partkey) END AS name FROM part)
SELECT CAST(regexp_extract(name, '(\\d+)\\.cseg$', 1) AS BIGINT) AS segment_id, CAST(CASE WHEN name LIKE 'L%' THEN regexp_extract(name, '^L(\\d+)_', 1) ELSE '0' END AS INTEGER) AS level, name, CAST(7 AS BIGINT) AS created_at FROM f WHERE name LIKE '%.cseg'""".replace("\\\\", "\\"))
def _(spark, d):
    p = F.col("p_partkey")
    name = F.when(p % 4 == 0, "garbage.txt").when(p % 4 == 1, F.format_string("segment_%06d.cseg", p)).otherwise(K.segment_name(F.col("p_size") % 4, p))
    return segments.recover(table(spark, d, "part").select(name.alias("name")), 7)


@query("cache_rank", "SELECT l_partkey AS segment_id, rank FROM (SELECT l_partkey, row_number() OVER (ORDER BY max(l_orderkey) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_partkey) WHERE rank <= 64")
def _(spark, d):
    """Segments that a cache of 64 keeps: those of the last accesses. The top 64 are found before they are ranked."""
    last = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("segment_id")).agg(F.max("l_orderkey").alias("at"))
    top = last.orderBy(F.desc("at"), "segment_id").limit(64)
    return top.select("segment_id", F.row_number().over(Window.orderBy(F.desc("at"), "segment_id")).cast("long").alias("rank"))


# Verification


@query("durability_anti", f"WITH {_LOG} SELECT timeline, log_offset FROM log WHERE seq % 11 = 4")
def _(spark, d):
    rows = events_log(spark, d)
    return verify.not_in(rows, rows.where("seq % 11 <> 4"))


@query("verify_order_dup_gap", f"""WITH {_LOG}, r AS (SELECT timeline, seq AS read_seq, CASE WHEN seq % 50 = 7 THEN log_offset - 1 WHEN seq % 91 = 3 THEN log_offset + 1 ELSE log_offset END AS log_offset FROM log),
o AS (SELECT timeline, 'order' AS kind FROM (SELECT timeline, log_offset, lag(log_offset) OVER (PARTITION BY timeline ORDER BY read_seq) AS before FROM r) WHERE log_offset <= before),
u AS (SELECT timeline, 'duplicate' AS kind FROM (SELECT timeline, log_offset FROM r GROUP BY ALL HAVING count(*) > 1)),
g AS (SELECT timeline, 'gap' AS kind FROM (SELECT timeline, log_offset, lag(log_offset) OVER (PARTITION BY timeline ORDER BY log_offset) AS before FROM (SELECT DISTINCT timeline, log_offset FROM r)) WHERE log_offset > before + 1)
SELECT timeline, kind, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM u UNION ALL SELECT * FROM g) GROUP BY ALL""")
def _(spark, d):
    r = events_log(spark, d).select("timeline", F.col("seq").alias("read_seq"), F.expr("CASE WHEN seq % 50 = 7 THEN log_offset - 1 WHEN seq % 91 = 3 THEN log_offset + 1 ELSE log_offset END").alias("log_offset"))
    return verify.summary({"order": verify.out_of_order(r), "duplicate": verify.duplicates(r), "gap": verify.gaps(r)})


@query("verify_phantom_durability_mismatch", f"""WITH {_LOG}, w AS (SELECT timeline, log_offset, payload FROM log WHERE seq % 19 <> 6),
r AS (SELECT timeline, log_offset, CASE WHEN seq % 23 = 9 THEN payload || 'x' ELSE payload END AS payload FROM log WHERE seq % 29 <> 8)
SELECT timeline, CAST(sum(CASE WHEN r.payload IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS durability, CAST(sum(CASE WHEN w.payload IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS phantom, CAST(sum(CASE WHEN w.payload <> r.payload THEN 1 ELSE 0 END) AS BIGINT) AS mismatch
FROM w FULL JOIN r USING (timeline, log_offset) GROUP BY timeline""")
def _(spark, d):
    rows = events_log(spark, d)
    w = rows.where("seq % 19 <> 6")
    r = rows.where("seq % 29 <> 8").withColumn("payload", F.expr("CASE WHEN seq % 23 = 9 THEN payload || 'x' ELSE payload END"))
    found = verify.summary({"durability": verify.not_in(w, r), "phantom": verify.not_in(r, w), "mismatch": verify.mismatches(w, r)})
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("long").alias(kind)
    return found.groupBy("timeline").agg(count("durability"), count("phantom"), count("mismatch"))


@query("payload_first_difference", f"WITH {_LOG} SELECT timeline, log_offset, CAST(length(payload) AS BIGINT) AS at FROM log WHERE seq % 23 = 9")
def _(spark, d):
    rows = events_log(spark, d)
    return verify.mismatches(rows, rows.withColumn("payload", F.expr("CASE WHEN seq % 23 = 9 THEN payload || 'x' ELSE payload END")))


@query("verify_corruption", f"WITH {_LOG} SELECT timeline, log_offset, CASE WHEN seq % 31 = 1 THEN 'short' WHEN seq % 31 = 2 THEN 'size' ELSE 'fill' END AS fault FROM log WHERE seq % 31 IN (1, 2, 3)")
def _(spark, d):
    good = P.expected(F.col("seq"), 64)
    hexed = F.when(F.col("seq") % 31 == 1, F.substring(good, 1, 8)).when(F.col("seq") % 31 == 2, F.substring(good, 1, 100)).when(F.col("seq") % 31 == 3, F.concat(F.substring(good, 1, 126), F.lpad(F.hex((F.col("seq") + 1) % 256), 2, "0"))).otherwise(good)
    return verify.corrupt(events_log(spark, d).withColumn("payload_hex", hexed), 64)


@query("replica_divergence", "SELECT doc_id, count(*) AS copies FROM (SELECT doc_id, md5(text) AS h FROM documents UNION ALL SELECT doc_id, md5(CASE WHEN quality = 0 THEN text || '!' ELSE text END) FROM documents JOIN labels USING (doc_id)) GROUP BY doc_id HAVING min(h) <> max(h)")
def _(spark, d):
    docs = table(spark, d, "documents")
    copy = docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", F.md5(F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return verify.diverging(docs.select("doc_id", F.md5("text").alias("h")).unionByName(copy), ["doc_id"], "h")


@query("watermark_readonly", """WITH s AS (SELECT event_type AS unit, event_id AS seq, value / 100.0 AS free FROM events),
t AS (SELECT *, CASE WHEN free < 0.05 THEN 0 WHEN free > 0.10 THEN 1 END AS turn FROM s)
SELECT unit, seq, free, CASE WHEN last_value(turn IGNORE NULLS) OVER (PARTITION BY unit ORDER BY seq) = 0 THEN 'READONLY' ELSE 'WRITABLE' END AS status FROM t""")
def _(spark, d):
    samples = arrivals(spark, d).select(F.col("timeline").alias("unit"), "seq", (F.col("value") / 100.0).alias("free"))
    return verify.sticky(samples, 0.05, 0.10)


@query("readonly_refusals", """WITH s AS (SELECT event_type AS unit, event_id AS seq, value / 100.0 AS free FROM events),
t AS (SELECT *, CASE WHEN free < 0.05 THEN 0 WHEN free > 0.10 THEN 1 END AS turn FROM s),
k AS (SELECT unit, seq, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY unit ORDER BY seq), 1) AS open FROM t)
SELECT w.unit, w.seq FROM (SELECT ['click', 'view', 'error'][o_orderkey % 3 + 1] AS unit, o_orderkey AS seq FROM orders) w ASOF JOIN k ON w.unit = k.unit AND w.seq >= k.seq WHERE k.open = 0""")
def _(spark, d):
    """Orders as writes to three units, refused while the unit's disk is short."""
    samples = arrivals(spark, d).select(F.col("timeline").alias("unit"), "seq", (F.col("value") / 100.0).alias("free"))
    writes = table(spark, d, "orders").select(F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("error")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("unit"), F.col("o_orderkey").alias("seq"))
    return verify.refused(writes, samples, 0.05, 0.10)


@query("ack_release", f"""WITH {_ACKS}, half AS (SELECT timeline, coalesce(min(CASE WHEN n_units < 3 OR seq >= 4000 THEN log_offset END) - 1, max(log_offset)) AS lra FROM counts JOIN log USING (timeline, log_offset) GROUP BY timeline)
SELECT timeline, half.lra + 1 AS first, frontier.lra AS last FROM half JOIN frontier USING (timeline) WHERE frontier.lra > half.lra""")
def _(spark, d):
    """What can be answered when the acknowledgements from sequence 4000 on have come in, too."""
    rows = events_log(spark, d)
    a = acks(rows)
    early = frontier.frontier(rows, a.join(rows.where("seq < 4000").select("timeline", "log_offset"), ["timeline", "log_offset"], "left_semi"), 3)
    return frontier.released(early, frontier.frontier(rows, a, 3))


# Placement and catalog


@query("ensemble_top_rf", f"""WITH {_UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY pressure, address) AS turn FROM ready)
SELECT address, zone, pressure, row_number() OVER (ORDER BY turn, zone) AS rank FROM r QUALIFY rank <= 3""")
def _(spark, d):
    return placement.select_ensemble(units(spark, d), 3)


@query("ensemble_previous", f"""WITH {_UNITS}, p AS (SELECT address, pos FROM (SELECT address, row_number() OVER (ORDER BY address) - 1 AS pos FROM units WHERE zone = 'zone-1') WHERE pos < 2),
kept AS (SELECT ready.*, pos FROM ready JOIN p USING (address)),
fresh AS (SELECT ready.*, row_number() OVER (PARTITION BY zone ORDER BY pressure, address) AS turn FROM ready WHERE address NOT IN (SELECT address FROM kept)),
every AS (SELECT address, zone, pressure, 0 AS turn, pos AS used FROM kept UNION ALL SELECT address, zone, pressure, turn, (SELECT count(*) FROM kept WHERE kept.zone = fresh.zone) FROM fresh)
SELECT address, zone, pressure, row_number() OVER (ORDER BY turn, used, zone, address) AS rank FROM every QUALIFY rank <= 5""")
def _(spark, d):
    u = units(spark, d)
    before = u.where("zone = 'zone-1'").orderBy("address").limit(2).select("address", (F.row_number().over(Window.orderBy("address")) - 1).alias("pos"))
    return placement.select_ensemble(u, 5, before)


@query("writable_units", f"WITH {_UNITS} SELECT zone, count(*) AS n, min(pressure) AS least FROM ready GROUP BY zone")
def _(spark, d):
    return placement.candidates(units(spark, d)).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.min("pressure").alias("least"))


@query("zone_default", "SELECT s_name AS address, coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'z' || s_nationkey END, ''), 'default') AS zone FROM supplier")
def _(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("address"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'z' || s_nationkey END").alias("zone"))
    return rows.withColumn("zone", placement.zone())


@query("unit_load", f"WITH {_UNITS} SELECT zone, round(avg(CAST(cpu_usage AS DOUBLE)), 6) AS cpu, round(avg(CAST(memory_usage AS DOUBLE)), 6) AS memory, round(avg(CAST(disk_usage AS DOUBLE)), 6) AS disk FROM units GROUP BY zone")
def _(spark, d):
    return units(spark, d).groupBy("zone").agg(*[F.round(F.avg(f"{c}_usage"), 6).alias(c) for c in ("cpu", "memory", "disk")])


@query("catalog_current", "SELECT o_custkey AS name, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey HAVING arg_max(o_orderkey % 5, o_orderkey) <> 0")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 5 == 0).alias("deleted"))
    return catalog.current(rows).drop("deleted")


@query("catalog_cas", """WITH RECURSIVE c AS (SELECT o_custkey AS name, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 2 - (CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) AS expected FROM orders),
s AS (SELECT name, seq, n, expected, expected = -1 AS applied, CAST(CASE WHEN expected = -1 THEN 0 ELSE -1 END AS BIGINT) AS version FROM c WHERE n = 1
  UNION ALL SELECT c.name, c.seq, c.n, c.expected, c.expected = s.version, CASE WHEN c.expected = s.version THEN s.version + 1 ELSE s.version END FROM s JOIN c ON c.name = s.name AND c.n = s.n + 1)
SELECT name, seq, expected, applied, version FROM s""")
def _(spark, d):
    rows = ordered.numbered(table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("seq")), ["name"], "seq", "n")
    return catalog.cas_outcomes(rows.select("name", "seq", (F.col("n") - 2 - F.when(F.col("seq") % 4 == 0, 1).otherwise(0)).alias("expected")))


@query("segment_rebuild", f"""WITH {_ACKS}, s AS (SELECT timeline, log_offset AS start_offset FROM log WHERE (log_offset - 1) % 400 = 0)
SELECT s.timeline, start_offset, 'u0,u1' AS ensemble FROM s JOIN frontier USING (timeline) WHERE start_offset <= lra UNION ALL SELECT timeline, lra + 1, 'u0,u2' FROM frontier""")
def _(spark, d):
    rows = events_log(spark, d)
    lra = frontier.frontier(rows, acks(rows), 3).select("timeline", "lra")
    return catalog.rebuilt_segments(_segments(rows).withColumn("ensemble", F.lit("u0,u1")), lra, F.lit("u0,u2"))


@query("list_timelines", "SELECT '/catalog/timelines/' || event_type AS key, event_type AS name FROM events GROUP BY event_type")
def _(spark, d):
    names = events_log(spark, d).select(F.col("timeline").alias("name")).distinct()
    every = names.select(K.catalog_key(F.col("name")).alias("key"), "name").unionByName(names.select(K.segment_key(F.col("name"), F.lit(1)).alias("key"), "name"))
    return every.where(~F.contains("key", F.lit("/seg/")))


@query("next_timeline_id", "SELECT coalesce(max(conv_id), 0) + 1 AS next_id FROM conversations")
def _(spark, d):
    return conversations_log(spark, d).agg((F.coalesce(F.max("timeline"), F.lit(0)) + 1).alias("next_id"))


@query("ensemble_union", f"WITH {_LOG} SELECT timeline, string_agg(DISTINCT 'u' || (log_offset % 5), ',' ORDER BY 'u' || (log_offset % 5)) AS members FROM log WHERE (log_offset - 1) % 7 = 0 GROUP BY timeline")
def _(spark, d):
    s = events_log(spark, d).where("(log_offset - 1) % 7 = 0").select("timeline", F.concat(F.lit("u"), (F.col("log_offset") % 5).cast("string")).alias("u"))
    return s.groupBy("timeline").agg(F.array_join(F.array_sort(F.collect_set("u")), ",").alias("members"))


@query("required_members", "SELECT s_suppkey, len(list_intersect(list_distinct([s_suppkey % 4, s_suppkey % 3]), list_distinct([s_suppkey % 4, s_suppkey % 5, s_suppkey % 7]))) = len(list_distinct([s_suppkey % 4, s_suppkey % 3])) AS complete FROM supplier")
def _(spark, d):
    """Whether the required members are all in the ensemble."""
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", (F.size(F.array_except(F.array(s % 4, s % 3), F.array(s % 4, s % 5, s % 7))) == 0).alias("complete"))


@query("status_report", f"WITH {_LOG}, {_MANIFEST} SELECT (SELECT count(DISTINCT timeline) FROM log) AS timelines, (SELECT count(*) FROM m) AS segments, (SELECT CAST(sum(size) AS BIGINT) FROM m) AS bytes, (SELECT count(*) FROM log) AS events")
def _(spark, d):
    a = events_log(spark, d).agg(F.count_distinct("timeline").alias("timelines"), F.count(F.lit(1)).alias("events"))
    b = _manifest(spark, d).agg(F.count(F.lit(1)).alias("segments"), F.sum("size").alias("bytes"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").select("timelines", "segments", "bytes", "events")


# Metrics


@query("histogram_buckets", "SELECT event_type AS timeline, bound, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND (bound IS NULL OR e.value <= bound)) AS n FROM (SELECT DISTINCT event_type FROM events) t, (VALUES (1.0::DOUBLE), (5.0), (10.0), (50.0), (100.0), (NULL)) AS b(bound)")
def _(spark, d):
    return metrics.histogram(arrivals(spark, d), ["timeline"], "value", (1.0, 5.0, 10.0, 50.0, 100.0))


@query("hist_quantile", """WITH b AS (SELECT event_type AS timeline, bound, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND (bound IS NULL OR e.value <= bound)) AS n FROM (SELECT DISTINCT event_type FROM events) t, (VALUES (1.0::DOUBLE), (5.0), (10.0), (50.0), (100.0), (NULL)) AS b(bound)),
l AS (SELECT *, lag(n, 1, 0) OVER w AS below, lag(bound) OVER w AS low, max(n) OVER (PARTITION BY timeline) AS total FROM b WINDOW w AS (PARTITION BY timeline ORDER BY bound NULLS LAST))
SELECT timeline, round(coalesce(coalesce(low, 0) + (bound - coalesce(low, 0)) * (0.9 * total - below) / (n - below), coalesce(low, 0)), 6) AS quantile FROM l WHERE n >= 0.9 * total AND below < 0.9 * total""")
def _(spark, d):
    h = metrics.histogram(arrivals(spark, d), ["timeline"], "value", (1.0, 5.0, 10.0, 50.0, 100.0))
    return metrics.histogram_quantile(h, ["timeline"], 0.9).select("timeline", F.round("quantile", 6).alias("quantile"))


@query("rate_per_window", f"WITH {_LOG} SELECT timeline, ts_ms // 3600000 AS bucket, count(*) AS n, count(*) // 3600 AS per_second FROM log GROUP BY ALL")
def _(spark, d):
    return metrics.interval_rates(arrivals(spark, d), ["timeline"], F.col("ts_ms"), 3600)


@query("counter_rate", """WITH s AS (SELECT event_type AS unit, epoch_us(ts) // 1000 AS ts_ms, event_id % 1000 AS value FROM events), w AS (SELECT *, ts_ms // 86400000 AS bucket FROM s),
t AS (SELECT *, lag(value) OVER (PARTITION BY unit, bucket ORDER BY ts_ms) AS before FROM w)
SELECT unit, bucket, round(sum(CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END) * 1000.0 / nullif(max(ts_ms) - min(ts_ms), 0), 9) AS rate FROM t GROUP BY unit, bucket""")
def _(spark, d):
    """Samples of the same millisecond, whose order the SQL leaves open, go by sequence."""
    samples = arrivals(spark, d).select(F.col("timeline").alias("unit"), "ts_ms", "seq", (F.col("seq") % 1000).alias("value"))
    return metrics.counter_rates(samples, ["unit"], 86_400_000, ties=("seq",)).withColumn("rate", F.round("rate", 9))


# Scalar functions


@query("sortable_key", f"WITH {_LOG} SELECT timeline, log_offset, '/catalog/timelines/' || timeline || '/seg/' || lpad(CAST(log_offset AS VARCHAR), 20, '0') AS key FROM log")
def _(spark, d):
    return events_log(spark, d).select("timeline", "log_offset", K.segment_key(F.col("timeline"), F.col("log_offset")).alias("key"))


@query("storage_names", "SELECT p_partkey, format('L{}_{:06d}.cseg', p_size % 5, p_partkey) AS segment, format('{:08d}.log', p_partkey) AS wal, p_partkey * 4294967296 + p_size AS wal_offset, p_partkey % 4 AS shard, (p_size + 4095) // 4096 * 4096 AS aligned FROM part")
def _(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", K.segment_name(s % 5, p).alias("segment"), K.wal_name(p).alias("wal"), K.wal_offset(p, s).alias("wal_offset"), K.shard(p).alias("shard"), K.align_up(s).alias("aligned"))


@query("index_codec", "SELECT l_orderkey, l_linenumber, lower(lpad(to_hex(l_orderkey), 16, '0') || lpad(to_hex(l_linenumber), 16, '0')) AS key, l_partkey AS segment_id, l_suppkey AS byte_offset, CAST(l_linenumber AS BIGINT) AS length FROM lineitem")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", K.index_key(F.col("l_orderkey"), F.col("l_linenumber")).alias("key"), K.index_value(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")).alias("value"))
    a, b, c = K.index_value_parts(F.col("value"))
    return rows.select("l_orderkey", "l_linenumber", F.lower(F.hex("key")).alias("key"), a.alias("segment_id"), b.alias("byte_offset"), c.alias("length"))


@query("address_sanitize", "SELECT s_suppkey, replace(replace(replace('http://' || s_name || ':80' || s_suppkey || '/x', '://', '_'), '/', '_'), ':', '_') AS unit_key FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", K.sanitized(F.concat(F.lit("http://"), "s_name", F.lit(":80"), F.col("s_suppkey").cast("string"), F.lit("/x"))).alias("unit_key"))


@query("autoconfig", "SELECT p_partkey, least(greatest(m // 4, 64), 4096) AS block_cache_mb, least(greatest(m // 10, 32), 1024) AS write_cache_mb, least(greatest(m // 20, 16), 256) AS write_buffer_mb, CAST(least(greatest(p_size, 2), 16) AS BIGINT) AS background_jobs FROM (SELECT p_partkey, p_size, p_partkey * 16 AS m FROM part)")
def _(spark, d):
    c = K.auto_config(F.col("p_partkey") * 16, F.col("p_size").cast("long"))
    return table(spark, d, "part").select("p_partkey", *[x.alias(n) for n, x in c.items()])


@query("payload_crc32")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


@query("xxh32_record", "SELECT item_id, CAST(strlen(text) AS INTEGER) AS size, 1 AS type, item_id AS log_number, text AS data FROM benchmark")
def _(spark, d):
    raw = table(spark, d, "benchmark").select("item_id", R.encoded(F.col("text"), 1, F.col("item_id")).alias("raw"))
    r = raw.select("item_id", R.decoded(F.col("raw")).alias("r"))
    return r.select("item_id", F.octet_length("r.data").alias("size"), F.col("r.type").alias("type"), F.col("r.log_number").alias("log_number"), F.col("r.data").cast("string").alias("data"))


@query("xxh32_checksum")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", R.xxh32(F.col("text")).alias("xxh32"))


# Storage, catalog and takeovers on files


def _folder(spark) -> str:
    """A new folder that all machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/stratalog-{uuid.uuid4().hex}"


def _store(spark, d, batches: int = 4) -> LogStore:
    """The events as level-1 segments of as many batches, cut by sequence; every tenth event is written again by the next batch."""
    store = LogStore(spark, _folder(spark))
    rows = events_log(spark, d).select("timeline", "log_offset", "seq", "payload")
    part = F.col("seq") % batches
    for k in range(batches):
        again = rows.where((part == (k - 1) % batches) & (F.col("seq") % 10 == 0)).select("timeline", "log_offset", (F.col("seq") + 10_000_000).alias("seq"), F.concat("payload", F.lit("!")).alias("payload"))
        store.flush(rows.where(part == k).unionByName(again), now_ms=k)
    return store


_STORED = f"""{_LOG}, stored AS (SELECT timeline, log_offset, CASE WHEN seq % 10 = 0 THEN payload || '!' ELSE payload END AS payload FROM log)"""


@query("store_flush", f"WITH {_LOG}, b AS (SELECT seq % 4 AS batch FROM log UNION ALL SELECT (seq + 1) % 4 FROM log WHERE seq % 10 = 0) SELECT batch, count(*) AS entry_count FROM b GROUP BY batch")
def _(spark, d):
    m = _store(spark, d).manifest()
    return m.where("level = 1").select(F.col("created_at").alias("batch"), "entry_count")


@query("store_merge", f"WITH {_STORED} SELECT timeline, log_offset, payload FROM stored")
def _(spark, d):
    """All rows that a merge of the level-1 segments leaves: one version of each event."""
    store = _store(spark, d)
    store.merge(now_ms=10)
    return store.scan().select("timeline", "log_offset", "payload")


@query("store_split", f"WITH {_STORED} SELECT timeline, 3 AS level, count(*) AS entry_count, CAST(sum(length(payload)) AS BIGINT) AS size, min(log_offset) AS low_offset, max(log_offset) AS high_offset FROM stored GROUP BY timeline")
def _(spark, d):
    store = _store(spark, d)
    store.compact(now_ms=10)
    return store.manifest().select(F.col("low_timeline").alias("timeline"), "level", "entry_count", "size", "low_offset", "high_offset")


@query("store_offload", f"WITH {_STORED} SELECT 'remote' AS location, timeline, log_offset, payload FROM stored")
def _(spark, d):
    """What is read after all segments went to the cold path."""
    store = _store(spark, d)
    store.compact(now_ms=10)
    store.offload(_folder(spark))
    where = store.manifest().select("segment_id", "location")
    return store.read().join(where, "segment_id").select("location", "timeline", "log_offset", "payload")


@query("store_tiers", f"WITH {_LOG} SELECT timeline, log_offset, CASE WHEN seq % 4 = 3 THEN payload || '+' ELSE payload END AS payload FROM log WHERE seq % 4 <> 0")
def _(spark, d):
    """Two batches, sealed and flushed; a third on top, sealed and cleared before it is flushed; and one that is active."""
    store = LogStore(spark, _folder(spark))
    rows = events_log(spark, d).select("timeline", "log_offset", "seq", "payload")
    part = lambda k: rows.where(F.col("seq") % 4 == k)
    store.append(part(1).unionByName(part(3)), 0)
    store.append(part(2), 1)
    store.seal()
    store.flush_sealed(2)
    store.append(part(0), 3)
    store.seal()
    store.clear_sealed()
    store.append(part(3).select("timeline", "log_offset", (F.col("seq") + 10_000_000).alias("seq"), F.concat("payload", F.lit("+")).alias("payload")), 4)
    return store.read().select("timeline", "log_offset", "payload")


@query("cold_read", f"WITH {_STORED} SELECT timeline, count(*) AS n, CAST(sum(length(payload)) AS BIGINT) AS bytes FROM stored GROUP BY timeline")
def _(spark, d):
    """Remote segments through a cache of two."""
    store = _store(spark, d)
    store.compact(now_ms=10)
    store.offload(_folder(spark))
    cache = SegmentCache(store, _folder(spark), 2)
    # A copy that makes room for another goes, so that each is summed up while it is there.
    out = [r for i in sorted(x.segment_id for x in store.manifest().collect()) for r in cache.read(i).groupBy("timeline").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).alias("bytes")).collect()]
    return spark.createDataFrame(out, "timeline string, n long, bytes long")


@query("wal_records", "SELECT item_id AS log_number, CAST(1 + item_id % 4 AS INTEGER) AS type, text AS data FROM benchmark")
def _(spark, d):
    """The benchmark's texts as records of write-ahead files, read back as a table; each record is written twice."""
    folder = _folder(spark)
    rows = table(spark, d, "benchmark").select("item_id", "text")
    frames = rows.select((F.col("item_id") % 3).alias("file"), R.encoded(F.col("text"), (1 + F.col("item_id") % 4).cast("int"), F.col("item_id")).alias("raw"), "item_id")
    raw = frames.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("item_id", "raw"))).alias("all")).select("file", F.aggregate(F.transform("all", lambda x: x["raw"]), F.lit(b""), lambda a, x: F.concat(a, x, x)).alias("raw"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in raw.toLocalIterator():
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.file:08d}.log"), False)
        out.write(r.raw)
        out.close()
    return last_records(read_wal(spark, folder)).select("log_number", "type", F.col("data").cast("string").alias("data"))


def _catalog(spark, d) -> tuple[catalog.Catalog, list[str]]:
    names = sorted(r.event_type for r in table(spark, d, "events").select("event_type").distinct().collect())
    c = catalog.Catalog(spark, _folder(spark))
    for n in names:
        c.create_timeline(n)
    return c, names


@query("catalog_timelines", "WITH t AS (SELECT event_type AS name, row_number() OVER (ORDER BY event_type) AS timeline_id FROM (SELECT DISTINCT event_type FROM events)) SELECT name, timeline_id, CASE WHEN timeline_id % 2 = 0 THEN CAST(4 AS BIGINT) ELSE 0 END AS term, CASE WHEN timeline_id % 2 = 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS version FROM t WHERE timeline_id <> 1")
def _(spark, d):
    """One timeline for each kind of event; the first is dropped, every second one gets a new term by its version."""
    c, names = _catalog(spark, d)
    c.drop_timeline(names[0])
    for n in names[1::2]:
        row = c.get("timelines", name=n)
        c.put("timelines", row["version"], **{k: row[k] for k in ("name", "timeline_id", "status", "lra")}, term=4)
        try:
            c.put("timelines", row["version"], **{k: row[k] for k in ("name", "timeline_id", "status", "lra")}, term=9)
        except catalog.Conflict:
            pass
    return c.list("timelines").select("name", "timeline_id", "term", "version")


@query("catalog_units", "SELECT s_name AS address, 'zone-' || CAST(s_nationkey % 5 AS VARCHAR) AS zone, CASE WHEN s_suppkey % 2 = 0 THEN 'READONLY' ELSE 'WRITABLE' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS version FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 6) WHERE s_suppkey % 5 <> 0")
def _(spark, d):
    """Registrations of the first six suppliers; some are put again, some leave."""
    c = catalog.Catalog(spark, _folder(spark))
    first = table(spark, d, "supplier").orderBy("s_suppkey").limit(6).collect()
    for r in first:
        zone = f"zone-{r.s_nationkey % 5}"
        c.register_unit(r.s_name, zone)
        if r.s_suppkey % 2 == 0:
            c.register_unit(r.s_name, zone, "READONLY")
        if r.s_suppkey % 5 == 0:
            c.unregister_unit(r.s_name, zone)
    return c.list("units").select("address", "zone", "status", "version")


@query("takeover", f"""WITH {_UNITS}, top AS (SELECT address, row_number() OVER (ORDER BY turn, zone) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY pressure, address) AS turn FROM ready) QUALIFY rank <= 3)
SELECT 't' AS name, CAST(2 AS BIGINT) AS term, CAST(70 AS BIGINT) AS lra, CAST(71 AS BIGINT) AS start_offset, string_agg(address, ',' ORDER BY rank) AS ensemble FROM top""")
def _(spark, d):
    """A timeline that is opened a second time, after its units reported frontiers of 50, 60 and 70."""
    c, states, u = catalog.Catalog(spark, _folder(spark)), {}, units(spark, d)
    first = open_timeline(c, "t", u, states, 3)
    for k, a in enumerate(first["ensemble"]):
        states[a].advance("t", 50 + 10 * k)
    open_timeline(c, "t", u, states, 3)
    last = c.list("segments").groupBy("name").agg(F.max_by("ensemble", "start_offset").alias("ensemble"), F.max("start_offset").alias("start_offset"))
    return c.list("timelines").select("name", "term", "lra").join(last, "name").select("name", "term", "lra", "start_offset", F.array_join("ensemble", ",").alias("ensemble"))


@query("ensemble_change", f"""WITH {_UNITS}, top AS (SELECT address, row_number() OVER (ORDER BY turn, zone) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY pressure, address) AS turn FROM ready) QUALIFY rank <= 3),
stay AS (SELECT ready.*, rank FROM ready JOIN top USING (address) WHERE rank <> 1),
fresh AS (SELECT ready.*, row_number() OVER (PARTITION BY zone ORDER BY pressure, address) AS turn, (SELECT count(*) FROM stay WHERE stay.zone = ready.zone) AS used FROM ready WHERE address NOT IN (SELECT address FROM top)),
added AS (SELECT address, zone FROM fresh ORDER BY turn, used, zone, address LIMIT 1)
SELECT CAST(1 AS BIGINT) AS start_offset, (SELECT string_agg(address, ',' ORDER BY rank) FROM top) AS ensemble UNION ALL SELECT 41, (SELECT string_agg(address, ',' ORDER BY rank) FROM stay) || ',' || (SELECT address FROM added)""")
def _(spark, d):
    """The first unit of an open timeline fails when the frontier is at 40."""
    c, states, u = catalog.Catalog(spark, _folder(spark)), {}, units(spark, d)
    first = open_timeline(c, "t", u, states, 3)
    change_ensemble(c, "t", u, first["ensemble"][:1], 40)
    return c.list("segments").select("start_offset", F.array_join("ensemble", ",").alias("ensemble"))


@query("missing_copies", f"""WITH {_LOG}, w AS (SELECT timeline, log_offset, unnest(CASE WHEN log_offset <= 400 THEN ['u0', 'u1', 'u2'] ELSE ['u0', 'u2', 'u3'] END) AS unit FROM log),
a AS (SELECT timeline, log_offset, unit FROM log, (VALUES ('u0'), ('u1'), ('u2')) AS u(unit) WHERE NOT (unit = 'u1' AND seq % 997 = 500) AND NOT (unit = 'u2' AND seq >= 9000 AND seq % 2 = 1))
SELECT timeline, log_offset, unit FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.timeline = w.timeline AND a.log_offset = w.log_offset AND a.unit = w.unit)""")
def _(spark, d):
    """What is to be written again when u3 has taken u1's place from offset 401 on."""
    rows = events_log(spark, d)
    starts = rows.where("log_offset IN (1, 401)").select("timeline", F.col("log_offset").alias("start_offset"), F.when(F.col("log_offset") == 1, F.array(F.lit("u0"), F.lit("u1"), F.lit("u2"))).otherwise(F.array(F.lit("u0"), F.lit("u2"), F.lit("u3"))).alias("ensemble"))
    return missing_copies(rows, acks(rows), starts)


@query("last_segment", f"WITH {_LOG} SELECT timeline, max(log_offset) AS start_offset FROM log WHERE (log_offset - 1) % 400 = 0 GROUP BY timeline")
def _(spark, d):
    return _segments(events_log(spark, d)).groupBy("timeline").agg(F.max("start_offset").alias("start_offset"))


@query("fence_replies", f"WITH {_ACKS} SELECT timeline, greatest(0, max(high)) AS lra FROM (SELECT timeline, unit, max(log_offset) AS high FROM acks WHERE unit <> 'u0' GROUP BY ALL) GROUP BY timeline")
def _(spark, d):
    """The frontier that a takeover takes from the replies of the units that answer: the largest, 0 at least."""
    rows = events_log(spark, d)
    replies = acks(rows).where("unit <> 'u0'").groupBy("timeline", "unit").agg(F.max("log_offset").alias("lra"))
    return replies.groupBy("timeline").agg(F.greatest(F.max("lra"), F.lit(0)).alias("lra"))


@query("retention_cutoff", "SELECT p_partkey, 1000000000 - p_size * 3600000 AS cutoff FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", K.cutoff_ms(F.lit(1_000_000_000).cast("long"), F.col("p_size").cast("long")).alias("cutoff"))


@query("aligned_sizes", "SELECT p_partkey, (CAST(floor(p_retailprice) AS BIGINT) + 4095) // 4096 * 4096 AS aligned FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", K.align_up(F.floor("p_retailprice")).alias("aligned"))


@query("directory_bytes", "SELECT source AS directory, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS files FROM (SELECT item_id % 2 AS source, text FROM benchmark) GROUP BY source")
def _(spark, d):
    """The benchmark's texts as files of two directories, and the directories' sizes from listings."""
    folder = _folder(spark)
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in table(spark, d, "benchmark").select("item_id", "text").toLocalIterator():
        out = files.create(jvm.Path(f"{folder}/{r.item_id % 2}/{r.item_id}"), False)
        out.write(bytearray(r.text.encode()))
        out.close()
    return metrics.directory_sizes(spark, folder).select(F.element_at(F.split("directory", "/"), -1).cast("long").alias("directory"), "bytes", "files")


def queries() -> dict[str, Query]:
    from ..streaming import queries as streams

    return QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    from ..streaming import queries as streams

    return SQL | streams.SQL
