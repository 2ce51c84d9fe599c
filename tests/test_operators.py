"""Operators on small logs with known answers."""

import pytest
from pyspark.sql import functions as F

from stratalog.operators import catalog, frontier, log, metrics, ordered, placement, segments, verify


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([("t", i, f"data{i}") for i in range(10)], "timeline string, log_offset long, payload string")


def test_range_is_inclusive(ten):
    got = [r.log_offset for r in log.fetch(ten, "t", 3, 7).collect()]
    assert got == [3, 4, 5, 6, 7]


def test_range_of_another_timeline_is_empty(ten):
    assert log.fetch(ten, "u").count() == 0


def test_latest_of_an_empty_timeline(ten):
    assert log.latest(ten, "u") == 1
    assert log.latest(ten, "t") == 10


def test_limit_takes_the_first(ten):
    assert [r.log_offset for r in log.fetch(ten, "t", 2, limit=3).collect()] == [2, 3, 4]


@pytest.mark.parametrize("n, kinds", [(1, ["FULL"]), (100, ["FULL"]), (101, ["FIRST", "LAST"]), (250, ["FIRST", "MIDDLE", "LAST"])])
def test_chunk_kinds(spark, n, kinds):
    df = spark.range(1, n + 1).select(F.lit("t").alias("timeline"), F.col("id").alias("log_offset"))
    got = log.chunked(df).orderBy("chunk_no").collect()
    assert [r.chunk_type for r in got] == kinds
    assert sum(r.n for r in got) == n and got[-1].advanced_offset == n


def test_open_ended_chunks_end_empty(spark):
    df = spark.range(1, 101).select(F.lit("t").alias("timeline"), F.col("id").alias("log_offset"))
    got = log.chunked(df, open_ended=True).orderBy("chunk_no").collect()
    assert [(r.chunk_type, r.n) for r in got] == [("FIRST", 100), ("LAST", 0)]
    assert got[-1].advanced_offset == 100


def test_merge_takes_the_newest_tier(spark):
    schema = "timeline string, log_offset long, payload string"
    cache = spark.createDataFrame([("t", 2, "new"), ("t", 3, "c")], schema)
    index = spark.createDataFrame([("t", 1, "a"), ("t", 2, "old")], schema)
    assert [r[1:3] for r in rows(log.merge_tiers([cache, index]), "log_offset")] == [(1, "a"), (2, "new"), (3, "c")]


def test_truncating_write(spark):
    """0, 1 and 2 are written, then 1 with truncation: 0 and the new 1 stay."""
    w = spark.createDataFrame([("t", 1, 0, False, "a"), ("t", 2, 1, False, "b"), ("t", 3, 2, False, "c"), ("t", 4, 1, True, "new_b")], "timeline string, seq long, log_offset long, trunc boolean, payload string")
    assert rows(frontier.truncated(w).select("log_offset", "payload"), "log_offset") == [(0, "a"), (1, "new_b")]


def test_frontier_stops_at_the_first_gap(spark):
    df = spark.createDataFrame([("t", i) for i in range(1, 6)], "timeline string, log_offset long")
    acks = spark.createDataFrame([("t", i, u) for i in range(1, 6) for u in ("a", "b") if (i, u) != (4, "b")] + [("t", 1, "a")], "timeline string, log_offset long, unit string")
    assert rows(frontier.frontier(df, acks, 2), "timeline") == [("t", 5, 3)]
    assert rows(frontier.frontier(df, acks, 1), "timeline") == [("t", 5, 5)]
    assert rows(frontier.frontier(df, acks.where("false"), 1), "timeline") == [("t", 5, 0)]


def test_fence_needs_a_higher_term(spark):
    r = spark.createDataFrame([("t", 1, 5), ("t", 2, 5), ("t", 3, 4), ("t", 4, 6), ("u", 5, 0)], "timeline string, seq long, term long")
    assert [x[3:] for x in rows(frontier.fence(r), "seq")] == [(True, 5), (False, 5), (False, 5), (True, 6), (True, 0)]


def test_term_check(spark):
    state = spark.createDataFrame([("t", 5)], "timeline string, term long")
    r = spark.createDataFrame([("t", 5), ("t", 6), ("t", 4), ("t", 0), ("u", 1)], "timeline string, term long")
    assert {(x.timeline, x.term): x.ok for x in frontier.check_terms(r, state).collect()} == {("t", 5): True, ("t", 6): True, ("t", 4): False, ("t", 0): False, ("u", 1): True}


def test_lra_only_grows(spark):
    u = spark.createDataFrame([("t", 10), ("t", 5), ("t", 20), ("u", -3)], "timeline string, lra long")
    assert rows(frontier.monotone(u), "timeline") == [("t", 20), ("u", -1)]


@pytest.mark.parametrize("bucket_rows", [7, 1_000_000])
def test_running_values_do_not_depend_on_buckets(spark, bucket_rows):
    data = [(k, i * 3 + j, (i * 37 + j) % 11) for j, k in enumerate("ab") for i in range(40)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    args = (["k"], "o")
    got = {
        "n": ordered.numbered(df, *args, "x", bucket_rows),
        "sum": ordered.running_sum(df, *args, "v", "x", bucket_rows),
        "max": ordered.running_max(df, *args, "v", "x", bucket_rows),
        "min": ordered.following_min(df, *args, "v", "x", bucket_rows),
        "prev": ordered.previous(df, *args, "v", "x", bucket_rows),
    }
    for name, out in got.items():
        for k in "ab":
            own = sorted((o, v) for kk, o, v in data if kk == k)
            values = [v for _, v in own]
            want = {
                "n": list(range(1, 41)),
                "sum": [sum(values[: i + 1]) for i in range(40)],
                "max": [max(values[:i], default=None) for i in range(40)],
                "min": [min(values[i + 1 :], default=None) for i in range(40)],
                "prev": [None, *values[:-1]],
            }[name]
            assert [r.x for r in out.where(F.col("k") == k).orderBy("o").collect()] == want, name


def test_segments_by_offset(spark, ten):
    s = spark.createDataFrame([("t", 0), ("t", 4), ("t", 8)], "timeline string, start_offset long")
    got = {r.log_offset: r.start_offset for r in log.with_segment(ten, s).collect()}
    assert got == {i: 0 if i < 4 else 4 if i < 8 else 8 for i in range(10)}


def test_first_reachable(spark):
    s = spark.createDataFrame([("t", 1, ["a", "b", "c"]), ("t", 9, ["d"])], "timeline string, start_offset long, ensemble array<string>")
    up = spark.createDataFrame([("c",), ("b",)], "address string")
    assert [r[-1] for r in rows(log.first_reachable(s, up), "start_offset")] == ["b", None]


def test_recovery_from_names(spark):
    f = spark.createDataFrame([(n,) for n in ("L0_000001.cseg", "L1_000042.cseg", "L2_000100.cseg", "segment_000003.cseg", "garbage.txt", "L1_x.cseg")], "name string")
    assert [(r[0], r[1]) for r in rows(segments.recover(f, 5), "segment_id")] == [(1, 0), (3, 0), (42, 1), (100, 2)]


def test_runs(spark):
    e = spark.createDataFrame([(1, i, b, b + 10) for i, b in enumerate([0, 10, 20, 50, 60, 100])], "s long, o long, b long, e long")
    got = segments.runs(e, ["s"], "o", F.col("__previous") != F.col("b"), "e")
    assert [r.run_no for r in got.orderBy("o").collect()] == [1, 1, 1, 2, 2, 3]


def test_key_compaction_keeps_events_without_a_key(spark):
    df = spark.createDataFrame([("t", 1, "a", "x"), ("t", 2, None, "y"), ("t", 3, "a", "z"), ("t", 4, None, "w")], "timeline string, log_offset long, key string, payload string")
    assert [r[1] for r in rows(segments.compact_keys(df), "log_offset")] == [2, 3, 4]


UNITS = "address string, zone string, status string, cpu_usage double, memory_usage double, disk_usage double"


def unit(address, zone="zone-a", load=(0.1, 0.1, 0.1), status="WRITABLE"):
    return (address, zone, status, *map(float, load))


def test_placement_prefers_low_pressure(spark):
    u = spark.createDataFrame([unit("hot", load=(0.9, 0.8, 0.5)), unit("cold"), unit("other", "zone-b", (0.2, 0.2, 0.1))], UNITS)
    assert {r.address for r in placement.select_ensemble(u, 2).collect()} == {"cold", "other"}


def test_placement_keeps_members_and_spreads(spark):
    u = spark.createDataFrame([unit("a1"), unit("a2"), unit("a3"), unit("b1", "zone-b")], UNITS)
    before = spark.createDataFrame([("a1", 0), ("a2", 1)], "address string, pos int")
    assert [r.address for r in placement.select_ensemble(u, 3, before).orderBy("rank").collect()] == ["a1", "a2", "b1"]


def test_placement_leaves_out_units(spark):
    u = spark.createDataFrame([unit("a"), unit("b", status="READONLY"), unit("c", zone="")], UNITS)
    gone = spark.createDataFrame([("a",)], "address string")
    got = placement.select_ensemble(u, 2, excluded=gone).collect()
    assert [(r.address, r.zone) for r in got] == [("c", "default")]


def test_cas_outcomes(spark):
    c = spark.createDataFrame([("t", 1, -1), ("t", 2, -1), ("t", 3, 0), ("t", 4, 5), ("t", 5, 1)], "name string, seq long, expected long")
    assert [(r.applied, r.version) for r in catalog.cas_outcomes(c).orderBy("seq").collect()] == [(True, 0), (False, 0), (True, 1), (False, 1), (True, 2)]


def test_verification(spark):
    r = spark.createDataFrame([("t", 1, 1), ("t", 2, 3), ("t", 3, 2), ("t", 4, 3), ("t", 5, 6)], "timeline string, read_seq long, log_offset long")
    assert [x.read_seq for x in verify.out_of_order(r).orderBy("read_seq").collect()] == [3]
    assert rows(verify.duplicates(r), "log_offset") == [("t", 3, 2)]
    assert rows(verify.gaps(r), "after") == [("t", 3, 2)]


def test_sticky_mode(spark):
    s = spark.createDataFrame([("u", i, f) for i, f in enumerate([0.2, 0.04, 0.07, 0.09, 0.11, 0.07])], "unit string, seq long, free double")
    assert [r.status for r in verify.sticky(s, 0.05, 0.10).orderBy("seq").collect()] == ["WRITABLE", "READONLY", "READONLY", "READONLY", "WRITABLE", "WRITABLE"]


def test_histogram_quantile(spark):
    df = spark.createDataFrame([("t", float(v)) for v in range(1, 101)], "k string, v double")
    h = metrics.histogram(df, ["k"], "v", (10.0, 50.0, 100.0))
    assert [(r.bound, r.n) for r in h.orderBy(F.col("bound").asc_nulls_last()).collect()] == [(10.0, 10), (50.0, 50), (100.0, 100), (None, 100)]
    assert metrics.histogram_quantile(h, ["k"], 0.3).first().quantile == pytest.approx(30.0)


def test_counter_rate_of_samples_of_the_same_time(spark):
    """Ties go by the columns given, then by value, in whatever order rows lie."""
    samples = [("u", 0, 1, 5), ("u", 0, 2, 9), ("u", 0, 3, 2), ("u", 1000, 4, 4)]
    for given in (samples, samples[::-1], [samples[i] for i in (2, 0, 3, 1)]):
        df = spark.createDataFrame(given, "unit string, ts_ms long, seq long, value long").coalesce(1)
        assert rows(metrics.counter_rates(df, ["unit"], 60_000, ties=("seq",)), "unit") == [("u", 0, 4.0 + 2 + 2)]
        assert rows(metrics.counter_rates(df, ["unit"], 60_000), "unit") == [("u", 0, 3.0 + 4 + 4)]


def test_directory_sizes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(b"12345")
    (tmp_path / "y").write_bytes(b"1")
    got = {r.directory.rstrip("/").rsplit("/", 1)[-1]: (r.bytes, r.files) for r in metrics.directory_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a": (5, 1), tmp_path.name: (1, 1)}


def test_skewed_windows_split(spark):
    """A hot key's windows are partitioned by bucket as well as by key; other keys have the plain one."""
    df = spark.range(100).select(F.lit("t").alias("k"), F.col("id").alias("o"))
    plan = ordered.numbered(df, ["k"], "o", "n", bucket_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan
    plan = ordered.numbered(spark.range(100).select((F.col("id") % 20).alias("k"), F.col("id").alias("o")), ["k"], "o", "n", bucket_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" not in plan


def test_thousands_of_buckets(spark):
    """A hot key in thousands of cells beside small ones, with values that crowd at one end and far outliers; a plan that doesn't grow with the cells."""
    o = F.when(F.col("id") % 50 == 0, F.col("id") * F.col("id") * 1000).otherwise(F.col("id"))
    df = spark.range(1, 30_001).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("cold"), (F.col("id") % 70).cast("string"))).otherwise("hot").alias("k"), o.alias("o"), (F.col("id") % 7).alias("v"))
    cut = ordered.with_buckets(df, ["k"], "o", 8)
    sizes = cut.groupBy("k", "__bucket").count()
    assert sizes.where("k = 'hot'").count() > 2000 and sizes.agg(F.max("count")).first()[0] <= 8 * ordered.CROWDED
    assert len(cut._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    for f, value in ((ordered.running_sum, "v"), (ordered.running_max, "v"), (ordered.following_min, "v"), (ordered.previous, "v")):
        assert same(f(df, ["k"], "o", value, "x", 8), f(df, ["k"], "o", value, "x"))
    assert same(ordered.numbered(df, ["k"], "o", "x", 8), ordered.numbered(df, ["k"], "o", "x"))


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_runs_and_gaps_in_buckets(spark, monkeypatch):
    from stratalog.operators import segments, verify

    df = spark.range(1, 2001).where("id % 17 <> 3").select(F.lit(1).alias("segment_id"), F.lit("t").alias("timeline"), F.col("id").alias("log_offset"), F.lit(5).cast("long").alias("length"))
    find = lambda: (segments.runs(df, ["segment_id"], "log_offset", F.col("__previous") != F.col("log_offset") - 1, "log_offset"), verify.gaps(df), segments.placed(df, ["segment_id"], "log_offset"))
    want = find()
    for f in (ordered.with_buckets, ordered._running, ordered.numbered, ordered.running_sum, ordered.previous):
        monkeypatch.setattr(f, "__defaults__", tuple(9 if d == ordered.BUCKET_ROWS else d for d in f.__defaults__ or ()))
    for a, b in zip(find(), want, strict=True):
        assert same(a, b)


def test_long_histories_are_followed_by_joins(spark):
    import random

    from stratalog.operators import catalog

    rng = random.Random(2)
    data = [(n, s, rng.randint(-1, 12)) for n, m in (("a", 300), ("b", 40), ("c", 1)) for s in range(m)] + [("d", i, i - 1) for i in range(70)]
    df = spark.createDataFrame(data, "name string, seq long, expected long")
    want = {}
    for n in "abcd":
        version = -1
        for _, s, e in sorted(x for x in data if x[0] == n):
            ok = e == version
            version += ok
            want[n, s] = (e, ok, version)
    for history in (1000, 50, 0):
        assert {(r.name, r.seq): (r.expected, r.applied, r.version) for r in catalog.cas_outcomes(df, history).collect()} == want


def test_first_difference(spark):
    from stratalog.functions.payload import first_difference

    pairs = [("", "a"), ("a", "a"), ("abc", "abd"), ("äöü", "äöx"), ("abc", "abcd"), ("x" * 5000 + "1", "x" * 5000 + "2"), ("b", "a"), ("", ""), ("a😀b", "a😀c"), ("ab", "a"), (None, "a")]
    got = [r.d for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", first_difference(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == [0, None, 2, 2, 3, 5000, 0, None, 2, 1, None]


def test_frontier_sums_before_the_shuffle(spark, sf_dir):
    from stratalog.sources.tables import acks, events_log

    events = events_log(spark, sf_dir)
    plan = frontier.frontier(events, acks(events), 3)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark, sf_dir):
    from stratalog.sources.tables import conversations_log

    plan = log.fetch(conversations_log(spark, sf_dir), 3, 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(conv_id,3)" in plan and "html" not in plan


def test_wal_files(spark):
    f = spark.createDataFrame([("00000001.log", 5), ("00000003.log", 64 << 20), ("x", 9), ("00000002.log", 1)], "name string, size long")
    assert sorted(r.name for r in segments.trim_wal(f, 3).collect()) == ["00000001.log", "00000002.log"]
    assert [r.name for r in segments.needs_rotation(f).collect()] == ["00000003.log"]
    assert segments.needs_rotation(f.where("size < 100")).count() == 0


def test_payload_schemas(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": "x", "b": true}'), (3, '{"a": 1}'), (1, "no json"), (None, "{}")], "schema_id long, payload string")
    got = [(r.a, r.b) for r in log.project_payload(df, {1: "a int", 2: "a string, b boolean"}, {"a": "string", "b": "boolean"}).collect()]
    assert got == [("1", None), ("x", True), (None, None), (None, None), (None, None)]


def test_asof_with_many_marks(spark):
    """Each event finds its mark without meeting all of them, also where the window is cut into buckets."""
    events = spark.range(0, 500).select(F.lit("t").alias("timeline"), F.col("id").alias("log_offset"))
    marks = spark.range(3, 500, 7).select(F.lit("t").alias("timeline"), F.col("id").alias("start_offset"), (F.col("id") * 2).alias("twice"))
    got = log.asof(events, marks, ["timeline"], "log_offset", "start_offset")
    assert {r.log_offset: (r.start_offset, r.twice) for r in got.collect()} == {o: (3 + (o - 3) // 7 * 7, 2 * (3 + (o - 3) // 7 * 7)) for o in range(3, 500)}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
