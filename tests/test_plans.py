"""Storage levels, the catalog and takeovers, end to end on small logs."""

import pytest
from pyspark.sql import functions as F

from stratalog.operators.catalog import Catalog, Conflict, NotFound
from stratalog.plans.storage import LogStore, SegmentCache
from stratalog.plans.timeline import PlacementError, UnitState, change_ensemble, counted_acks, finish_reconciliation, missing_copies, open_timeline, start_reconciliation

BATCH = "timeline string, log_offset long, seq long, payload string"


def levels(store):
    return sorted(r.level for r in store.manifest().collect())


def payloads(store):
    return {(r.timeline, r.log_offset): r.payload for r in store.read().collect()}


def test_flush_merge_split_offload_retain(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    assert store.read() is None and store.version() == -1
    want = {}
    for b in range(4):
        rows = [(f"t{t}", b, 10 * b + t, f"t{t}_b{b}") for t in range(2)]
        want |= {(t, o): p for t, o, _, p in rows}
        store.flush(spark.createDataFrame(rows, BATCH), now_ms=b)
    assert levels(store) == [1, 1, 1, 1] and payloads(store) == want
    assert store.merge(now_ms=10) and levels(store) == [2] and payloads(store) == want
    assert not store.merge(now_ms=11)
    assert store.split(now_ms=20, trigger=1) and levels(store) == [3, 3] and payloads(store) == want
    assert store.offload(str(tmp_path / "cold")) == 2 and payloads(store) == want
    assert {r.location for r in store.manifest().collect()} == {"remote"}
    assert store.retain(now_ms=100, ttl_ms=90) == 0
    assert store.retain(now_ms=200, ttl_ms=90) == 2 and store.read() is None


def test_overwritten_rows_vanish_in_a_merge(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.flush(spark.createDataFrame([("t", 1, 1, "old"), ("t", 2, 2, "b")], BATCH), 0)
    store.flush(spark.createDataFrame([("t", 1, 3, "new")], BATCH), 0)
    assert payloads(store) == {("t", 1): "new", ("t", 2): "b"}
    store.merge(0, trigger=2)
    assert store.scan().count() == 2 and payloads(store) == {("t", 1): "new", ("t", 2): "b"}


def test_unfinished_manifest_is_not_read(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.flush(spark.createDataFrame([("t", 1, 1, "a")], BATCH), 0)
    (tmp_path / "log" / "manifest" / "1").mkdir()
    assert store.version() == 0 and payloads(store) == {("t", 1): "a"}
    store.flush(spark.createDataFrame([("t", 2, 2, "b")], BATCH), 0)
    assert store.version() == 1 and len(payloads(store)) == 2


def test_catalog_compare_and_set(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    with pytest.raises(NotFound):
        c.get("timelines", name="a")
    a, b = c.create_timeline("a"), c.create_timeline("b")
    assert (a["timeline_id"], b["timeline_id"], a["version"]) == (1, 2, 0)
    with pytest.raises(Conflict):
        c.create_timeline("a")
    row = {k: a[k] for k in ("name", "timeline_id", "status", "lra")}
    assert c.put("timelines", 0, term=1, **row) == 1
    with pytest.raises(Conflict):
        c.put("timelines", 0, term=2, **row)
    assert c.get("timelines", name="a")["term"] == 1
    c.put("segments", -1, name="a", start_offset=1, ensemble=["u"])
    c.drop_timeline("a")
    assert [r.name for r in c.list("timelines").collect()] == ["b"] and c.list("segments").count() == 0
    assert c.create_timeline("a")["timeline_id"] == 3


def units(spark, *names):
    return spark.createDataFrame([(n, "z", "WRITABLE", i / 10, 0.0, 0.0) for i, n in enumerate(names)], "address string, zone string, status string, cpu_usage double, memory_usage double, disk_usage double")


def test_takeover(spark, tmp_path):
    c, states = Catalog(spark, str(tmp_path)), {}
    first = open_timeline(c, "t", units(spark, "a", "b", "c"), states, 2)
    assert first == {"name": "t", "term": 1, "lra": 0, "ensemble": ["a", "b"]}
    states["a"].advance("t", 7)
    states["b"].advance("t", 5)
    second = open_timeline(c, "t", units(spark, "b", "c"), states, 2)
    assert (second["term"], second["lra"], second["ensemble"]) == (2, 7, ["b", "c"])
    assert not states["a"].accepts("t", 1) and states["a"].accepts("t", 2)
    assert [(s.start_offset, s.ensemble) for s in c.list("segments").orderBy("start_offset").collect()] == [(1, ["a", "b"]), (8, ["b", "c"])]
    assert c.get("timelines", name="t")["lra"] == 7
    with pytest.raises(PlacementError):
        open_timeline(c, "t", units(spark, "b"), states, 2)


def test_unit_state():
    s = UnitState()
    assert s.accepts("t", 0)
    assert s.fence("t", 5) == (True, -1)
    assert s.accepts("t", 5) and s.accepts("t", 6) and not s.accepts("t", 4)
    assert s.fence("t", 5) == (False, 5) and s.fence("t", 3) == (False, 5)
    s.advance("t", 10)
    s.advance("t", 5)
    assert s.fence("t", 6) == (True, 10)
    assert s.accepts("u", 1)


def test_read_spans_tiers_in_order(spark, tmp_path):
    from stratalog.operators import log

    store = LogStore(spark, str(tmp_path / "log"))
    for i in range(3):
        store.flush(spark.createDataFrame([("t", o, o, str(o)) for o in range(3 * i, 3 * i + 3)], BATCH), i)
        store.merge(i, trigger=2)
    assert [r.log_offset for r in log.fetch(store.read(), "t", 2, 7).collect()] == [2, 3, 4, 5, 6, 7]
    assert store.read().where(F.col("timeline") == "x").count() == 0


def test_check_passes_and_finds(spark, tmp_path):
    from stratalog.plans import check

    assert check.run(spark, str(tmp_path / "log"), timelines=2, events=90, size=32, batches=6).count() == 0
    sent = check.written(spark, 2, 0, 30, 32)
    bad = (
        sent.where("NOT (timeline = 'verify-0' AND log_offset = 7)")
        .withColumn("payload", F.expr("CASE WHEN timeline = 'verify-1' AND log_offset = 3 THEN substr(payload, 1, 4) ELSE payload END"))
        .unionByName(sent.where("timeline = 'verify-1' AND log_offset = 30").withColumn("log_offset", F.lit(31).cast("long")))
        .withColumn("read_seq", F.col("log_offset"))
    )
    got = {(r.timeline, r.kind): r.n for r in check.findings(sent, bad, 32).collect()}
    assert got == {("verify-0", "GAP"): 1, ("verify-0", "DURABILITY"): 1, ("verify-1", "CORRUPTION"): 1, ("verify-1", "PAYLOAD_MISMATCH"): 1, ("verify-1", "PHANTOM"): 1}


def test_units(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    assert c.register_unit("a", load=(0.1, 0.2, 0.3)) == 0 and c.register_unit("a", status="READONLY") == 1
    c.register_unit("b", "z")
    assert {(r.zone, r.address, r.status) for r in c.list("units").collect()} == {("default", "a", "READONLY"), ("z", "b", "WRITABLE")}
    c.unregister_unit("b", "z")
    assert [r.address for r in c.list("units").collect()] == ["a"]


def test_compaction_on_demand(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.flush(spark.createDataFrame([("t", 1, 1, "a"), ("u v/w", 1, 2, "b")], BATCH), 0)
    assert store.compact(1) == (True, True) and levels(store) == [3, 3]
    assert payloads(store) == {("t", 1): "a", ("u v/w", 1): "b"}


def test_sealed_and_active_tiers(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    batch = lambda *rows: spark.createDataFrame([("t", o, s, p) for o, s, p in rows], BATCH)
    store.append(batch((0, 0, "a"), (1, 1, "b")), 0)
    assert store.seal() == 1 and store.seal() == 0 and len(payloads(store)) == 2
    store.append(batch((2, 2, "c")), 1)
    assert payloads(store) == {("t", 0): "a", ("t", 1): "b", ("t", 2): "c"}
    assert store.clear_sealed() == 1 and payloads(store) == {("t", 2): "c"}
    store.append(batch((2, 5, "new")), 2)
    store.seal()
    assert store.flush_sealed(3) and not store.flush_sealed(3) and levels(store) == [1]
    assert store.scan().count() == 1 and payloads(store) == {("t", 2): "new"}


def test_a_merge_of_replaced_rows_leaves_nothing_behind(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.flush(spark.createDataFrame([("t", 1, 1, "old")], BATCH), 0)
    store.merge(0, trigger=1)
    store.split(0, trigger=1)
    store.flush(spark.createDataFrame([("t", 1, 0, "older")], BATCH), 0)
    assert store.merge(0, trigger=1) and levels(store) == [3] and payloads(store) == {("t", 1): "old"}
    assert [p.name for p in (tmp_path / "log" / "segments").iterdir() if not p.name.startswith("L3")] == []


def test_a_merge_reads_only_segments_that_can_share_keys(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "log"))
    for k in range(6):
        store.flush(spark.createDataFrame([("t", 10 * k + i, 10 * k + i, "x") for i in range(10)], BATCH), 0)
    store.compact(0)
    for k in (6, 7):
        store.flush(spark.createDataFrame([("t", 10 * k + i, 10 * k + i, "x") for i in range(10)], BATCH), 0)
    seen, scan = [], store.scan
    monkeypatch.setattr(store, "scan", lambda rows=None: seen.append({r["level"] for r in rows}) or scan(rows))
    assert store.merge(0, trigger=2) and seen == [{1}]
    monkeypatch.undo()
    assert len(payloads(store)) == 80


def test_remote_segments_are_cached(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.flush(spark.createDataFrame([(f"t{i}", 1, i, f"p{i}") for i in range(3)], BATCH), 0)
    store.compact(0)
    store.offload(str(tmp_path / "cold"))
    cache = SegmentCache(store, str(tmp_path / "cache"), 2)
    ids = sorted(r.segment_id for r in store.manifest().collect())
    assert [cache.read(i).first().payload for i in ids] == ["p0", "p1", "p2"]
    assert list(cache.paths) == ids[1:] and not (tmp_path / "cache" / f"cached_{ids[0]:06d}").exists()
    cache.path(ids[1])
    cache.path(ids[0])
    assert list(cache.paths) == [ids[1], ids[0]]
    with pytest.raises(KeyError):
        cache.path(999)


def test_of_two_writers_one_succeeds(spark, tmp_path, monkeypatch):
    """Both look before either writes; and a claim whose writer stopped is completed by the next."""
    c = Catalog(spark, str(tmp_path))
    a = c.create_timeline("a")
    row = {k: a[k] for k in ("name", "timeline_id", "status", "lra")}
    claim = Catalog._claim

    def late(self, *args):
        monkeypatch.setattr(Catalog, "_claim", claim)
        assert Catalog(spark, str(tmp_path)).put("timelines", 0, term=7, **row) == 1
        return claim(self, *args)

    monkeypatch.setattr(Catalog, "_claim", late)
    with pytest.raises(Conflict):
        c.put("timelines", 0, term=8, **row)
    assert c.get("timelines", name="a")["term"] == 7

    monkeypatch.setattr(Catalog, "_append", lambda self, *args: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        c.put("timelines", 1, term=9, **row)
    monkeypatch.undo()
    with pytest.raises(Conflict):
        c.put("timelines", 1, term=10, **row)
    assert (c.get("timelines", name="a")["term"], c.get("timelines", name="a")["version"]) == (9, 2)


def test_ensemble_change(spark, tmp_path):
    c, states = Catalog(spark, str(tmp_path)), {}
    open_timeline(c, "t", units(spark, "a", "b", "c"), states, 2)
    assert change_ensemble(c, "t", units(spark, "a", "b", "c"), ["a"], 4, 2) == ["b", "c"]
    assert [(s.start_offset, s.ensemble) for s in c.list("segments").orderBy("start_offset").collect()] == [(1, ["a", "b"]), (5, ["b", "c"])]
    # Nothing new is on all replicas: the same segment changes.
    assert change_ensemble(c, "t", units(spark, "a", "b", "c", "d"), ["c"], 4, 2) == ["b", "a"]
    segments = c.list("segments").select(F.col("name").alias("timeline"), "start_offset", "ensemble")
    assert [(s.start_offset, s.ensemble) for s in segments.orderBy("start_offset").collect()] == [(1, ["a", "b"]), (5, ["b", "a"])]
    with pytest.raises(PlacementError):
        change_ensemble(c, "t", units(spark, "a", "b"), ["a"], 6, 2)
    acks = spark.createDataFrame([("t", o, u) for o, us in ((4, "ab"), (5, "bc"), (6, "ab")) for u in us], "timeline string, log_offset long, unit string")
    assert sorted(tuple(r)[1:] for r in counted_acks(acks, segments).collect()) == [(4, "a"), (4, "b"), (5, "b"), (6, "a"), (6, "b")]
    assert [tuple(r)[1:] for r in missing_copies(acks.select("timeline", "log_offset").distinct(), acks, segments).collect()] == [(5, "a")]


def test_reconciliation(spark, tmp_path):
    c, states = Catalog(spark, str(tmp_path)), {}
    open_timeline(c, "t", units(spark, "a", "b"), states, 2)
    states["a"].advance("t", 5)
    term, lra = start_reconciliation(c, "t", states)
    assert (term, lra) == (2, 5) and c.get("timelines", name="t")["status"] == "RECONCILING" and not states["b"].accepts("t", 1)
    again, _ = start_reconciliation(c, "t", states)
    with pytest.raises(Conflict):
        finish_reconciliation(c, "t", term, lra, ["a", "b"])
    finish_reconciliation(c, "t", again, lra, ["a", "b"])
    row = c.get("timelines", name="t")
    assert (row["status"], row["term"], row["lra"]) == ("ACTIVE", 3, 5)
    assert [s.start_offset for s in c.list("segments").orderBy("start_offset").collect()] == [1, 6]
    with pytest.raises(ValueError):
        change_ensemble(c, "t", units(spark, "a"), [], 5, 1) if c.put("timelines", row["version"], **{k: row[k] for k in ("name", "timeline_id", "lra", "term")}, status="SEALED") else None


def test_wal_files_as_a_table(spark, tmp_path):
    from stratalog.sources.wal import framed, last_records, read_wal

    one = framed([(b"a", 1, 7), (b"", 2, 8), (b"b" * 65_535, 4, 9)])
    (tmp_path / "00000001.log").write_bytes(one + framed([(b"lost", 1, 9)])[:-1])
    (tmp_path / "00000002.log").write_bytes(framed([(b"new", 1, 7)]))
    (tmp_path / "00000003.log").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(one)
    rows = read_wal(spark, str(tmp_path))
    assert sorted((r.file, r.at, r.type, r.log_number, len(r.data)) for r in rows.collect()) == [(1, 0, 1, 7, 1), (1, 12, 2, 8, 0), (1, 23, 4, 9, 65_535), (2, 0, 1, 7, 3)]
    assert {r.log_number: bytes(r.data)[:3] for r in last_records(rows).collect()} == {7: b"new", 8: b"", 9: b"bbb"}
    assert read_wal(spark, str(tmp_path), 2).count() == 1


def test_command_line(spark, tmp_path, capsys):
    from stratalog.__main__ import main

    folder = str(tmp_path / "log")
    assert main(["status", "--folder", folder]) == 2
    LogStore(spark, folder).flush(spark.createDataFrame([("t", i, i, f"p{i}") for i in range(5)], BATCH), 0)
    assert main(["read", "--folder", folder, "--timeline", "t", "--start", "2", "--limit", "2"]) == 0
    assert main(["compact", "--folder", folder]) == 0 and main(["segments", "--folder", folder]) == 0 and main(["status", "--folder", folder]) == 0
    out = capsys.readouterr().out
    assert "2\tp2\n3\tp3\n" in out and "merged: True, split: True" in out and "L3\tlocal\t5" in out and "1 segments, 5 rows" in out
    assert main(["verify", "--timelines", "1", "--events", "24", "--payload-size", "16", "--folder", str(tmp_path / "v")]) == 0
