"""Streams: the same offsets after a restart, a tail that resumes, frontiers that wait for all replicas."""

from pyspark.sql import functions as F

from stratalog.streaming.record import BLOCK, acked_blocks, append_to, frontiers, number_to, record
from stratalog.streaming.tail import follow, read_log, tail, write_log

ARRIVALS = "timeline string, seq long, ts_ms long, key long, payload string"


def arrive(spark, path, lo, hi):
    rows = [(("a", "b")[i % 3 == 0], i, i, i, f"p{i}") for i in range(lo, hi)]
    spark.createDataFrame(rows, ARRIVALS).coalesce(1).write.mode("append").parquet(path)


def test_offsets_go_on_after_a_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    for lo, hi in ((0, 10), (10, 25), (25, 26)):
        arrive(spark, src, lo, hi)
        record(spark.readStream.schema(ARRIVALS).parquet(src), out, state).awaitTermination()
    got = spark.read.parquet(out)
    for t in ("a", "b"):
        rows = got.where(F.col("timeline") == t).orderBy("seq").collect()
        assert [r.log_offset for r in rows] == list(range(1, len(rows) + 1))
    assert got.count() == 26


def test_a_batch_that_is_written_again_replaces_itself(spark, tmp_path):
    write = append_to(str(tmp_path))
    batch = spark.createDataFrame([(1,), (2,)], "x long")
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(str(tmp_path)).count() == 2


def test_tail_resumes(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    log = lambda lo, hi: spark.range(lo, hi).select(F.lit("t").alias("timeline"), F.col("id").alias("log_offset"), F.col("id").alias("ts_ms"), F.lit(None).cast("string").alias("key"), F.lit("p").alias("payload")).write.mode("append").parquet(path)

    def run():
        q = tail(spark, path, "t", start=3).writeStream.foreachBatch(append_to(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()

    log(1, 6)
    run()
    assert sorted(r.log_offset for r in spark.read.parquet(out).collect()) == [3, 4, 5]
    log(6, 9)
    run()
    assert sorted(r.log_offset for r in spark.read.parquet(out).collect()) == [3, 4, 5, 6, 7, 8]


def test_a_batch_that_runs_again_numbers_alike(spark, tmp_path):
    """Also where a hot timeline is numbered in parts."""
    sink = number_to(str(tmp_path / "log"), str(tmp_path / "ends"), bucket_rows=7)
    batch = lambda lo, hi: spark.createDataFrame([("hot" if i % 5 else "cold", i, f"p{i}") for i in range(lo, hi)], "timeline string, seq long, payload string")
    for k, (lo, hi) in enumerate(((0, 60), (60, 61), (61, 130))):
        sink(batch(lo, hi), k)
        sink(batch(lo, hi), k)
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    for t in ("hot", "cold"):
        rows = sorted((r.seq, r.log_offset) for r in got if r.timeline == t)
        assert [o for _, o in rows] == list(range(1, len(rows) + 1))
    assert len(got) == 130


def test_frontier_waits(spark, tmp_path, monkeypatch):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "timeline string, log_offset long, unit string"

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = acked_blocks(spark.readStream.schema(schema).parquet(src), 2).writeStream.outputMode("update").foreachBatch(append_to(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.timeline: r.lra for r in frontiers(spark.read.parquet(out)).collect()}

    assert step([("t", 1, "a"), ("t", 2, "a"), ("t", 2, "b")]) == {"t": 0}
    assert step([("t", 1, "b"), ("t", 1, "b"), ("t", 4, "a"), ("t", 4, "b")]) == {"t": 2}
    assert step([("t", 3, "b"), ("t", 3, "a")]) == {"t": 4}
    # A lost acknowledgement in the first block holds back whole ones behind it, and a block is missing between.
    far = [("u", o, x) for o in range(1, 3 * BLOCK + 3) if o != 9 for x in "ab"] + [("v", o, x) for o in [*range(1, BLOCK + 1), 2 * BLOCK + 1] for x in "ab"]
    assert step(far) == {"t": 4, "u": 8, "v": BLOCK}
    assert step([("u", 9, "a"), ("u", 9, "b"), ("v", BLOCK + 1, "a")]) == {"t": 4, "u": 3 * BLOCK + 2, "v": BLOCK}


def stored(spark, path, lo, hi, timeline="t"):
    return spark.range(lo, hi).select(F.lit(timeline).alias("timeline"), F.col("id").alias("log_offset"), F.col("id").alias("ts_ms"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("p"), F.col("id")).alias("payload"))


def test_log_source_reads_and_writes_tables(spark, tmp_path):
    path = str(tmp_path / "log")
    write_log(stored(spark, path, 1, 40).unionByName(stored(spark, path, 1, 9, "u")).repartition(3), path)
    write_log(stored(spark, path, 40, 60), path)
    assert sorted(r.log_offset for r in read_log(spark, path, "t").collect()) == list(range(1, 60))
    assert sorted(r.payload for r in read_log(spark, path, "t", 10, 12).collect()) == ["p10", "p11", "p12"]
    assert sorted(r.log_offset for r in read_log(spark, path, "u", 3, limit=2).collect()) == [3, 4]
    assert read_log(spark, path, "none").count() == 0
    assert spark.read.format("stratalog").option("timeline", "t").option("rows_per_partition", 10).load(path).rdd.getNumPartitions() == 6
    assert not [f for f in (tmp_path / "log").iterdir() if f.name.startswith("_part")]


def test_follow_ends_by_limit_and_by_time(spark, tmp_path):
    path = str(tmp_path / "log")
    write_log(stored(spark, path, 1, 30), path)
    assert follow(tail(spark, path, "t", 5, limit=10), append_to(str(tmp_path / "a")), str(tmp_path / "s1"), limit=10, timeout_s=60) == 10
    assert sorted(r.log_offset for r in spark.read.parquet(str(tmp_path / "a")).collect()) == list(range(5, 15))
    assert follow(tail(spark, path, "t", 28), append_to(str(tmp_path / "b")), str(tmp_path / "s2"), timeout_s=8) == 2


def test_follow_reconnects(spark, tmp_path):
    """Failures in a row are bounded; a batch that goes through sets them back."""
    import pytest

    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    write_log(stored(spark, path, 1, 6), path)
    tries = []

    def flaky(batch, batch_id):
        tries.append(batch_id)
        if len(tries) < 3:
            raise OSError("not now")
        append_to(out)(batch, batch_id)

    assert follow(tail(spark, path, "t"), flaky, str(tmp_path / "s"), limit=5, timeout_s=90, reconnects=3) == 5 and len(tries) == 3
    assert spark.read.parquet(out).count() == 5

    def broken(batch, batch_id):
        raise OSError("never")

    with pytest.raises(Exception, match="never"):
        follow(tail(spark, path, "t"), broken, str(tmp_path / "s2"), timeout_s=90, reconnects=1)


def test_looking_for_the_end_is_tried_again(tmp_path, monkeypatch):
    from stratalog.streaming import tail as T

    reader = T._Reader({"path": str(tmp_path), "timeline": "t", "reconnects": "2", "backoff_s": "0"})
    answers = iter([OSError(), OSError(), 7])

    def end():
        x = next(answers)
        if isinstance(x, OSError):
            raise x
        return x

    monkeypatch.setattr(reader.log, "end", end)
    assert reader.latestOffset() == {"next": 8}


def test_watermarked_windows(spark, tmp_path):
    """Late rows fall out of a windowed count once the watermark has passed."""
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    add = lambda rows: spark.createDataFrame(rows, "at_s long").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema("at_s long").parquet(src).withColumn("at", F.timestamp_seconds("at_s")).withWatermark("at", "10 seconds")
        out = stream.groupBy(F.window("at", "10 seconds")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("s"), "n")
        out.writeStream.outputMode("append").foreachBatch(append_to(str(tmp_path / "out"))).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    add([(1,), (2,), (100,)])
    run()
    add([(3,), (200,)])
    run()
    got = {r.s: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == 2


def test_counters(spark, tmp_path):
    import time

    from stratalog.streaming.progress import Counters

    counters = Counters(spark)
    try:
        arrive(spark, str(tmp_path / "in"), 0, 10)
        record(spark.readStream.schema(ARRIVALS).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
        for _ in range(50):
            got = {r.name: r.value for r in counters.table().collect()} if counters.values else {}
            if got.get("input_rows"):
                break
            time.sleep(0.2)
        assert got["input_rows"] == 10 and got["batches"] >= 1
    finally:
        counters.close()
