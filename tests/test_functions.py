"""Keys, names and record frames."""

import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import keys, payload, records
from stratalog.model import CHUNK_TYPE, named


@given(st.binary(max_size=500), st.integers(0, 4), st.integers(0, 2**32 - 1))
@settings(max_examples=200, deadline=None)
def test_record_round_trip(data, kind, number):
    raw = records.encode(data, kind, number)
    assert len(raw) == 11 + len(data) and raw[6] == kind
    assert records.decode(raw) == (data, kind, number)


@given(st.binary(min_size=1, max_size=100), st.data())
@settings(max_examples=100, deadline=None)
def test_flipped_byte_is_found(data, draw):
    raw = bytearray(records.encode(data, 1, 7))
    raw[draw.draw(st.integers(11, len(raw) - 1))] ^= 0x40
    assert records.decode(bytes(raw)) is None


def test_records_that_do_not_fit_or_are_cut():
    assert records.decode(records.encode(b"\xff" * 65_535)) is not None
    with pytest.raises(ValueError):
        records.encode(b"x" * 65_536)
    assert records.decode(records.encode(b"hello world")[:5]) is None
    assert records.decode(None) is None


def test_replay_ends_at_a_bad_record():
    good = [records.encode(b"a", 2), records.encode(b"bb", 3), records.encode(b"c", 4, 12345)]
    assert [r[0] for r in records.replay(b"".join(good))] == [b"a", b"bb", b"c"]
    assert [r[0] for r in records.replay(good[0] + b"\0" * 11 + good[1])] == [b"a"]


def test_checksum_column(spark):
    df = spark.createDataFrame([(1, b"hello world"), (2, None), (3, b"")], "id int, data binary")
    got = {r.id: r.x for r in df.select("id", records.xxh32(F.col("data"), 1, 0).alias("x")).collect()}
    assert got == {1: xxhash.xxh32_intdigest(b"\x01\0\0\0\0hello world"), 2: None, 3: xxhash.xxh32_intdigest(b"\x01\0\0\0\0")}


def test_record_columns(spark):
    df = spark.createDataFrame([(1, b"x" * 70_000), (2, b"ok")], "id int, data binary").select("id", records.encoded(F.col("data"), 2, 9).alias("raw"))
    got = {r.id: r for r in df.select("id", "raw", records.decoded(F.col("raw")).alias("d")).collect()}
    assert got[1].raw is None and got[1].d is None
    assert (bytes(got[2].d.data), got[2].d.type, got[2].d.log_number) == (b"ok", 2, 9)


def test_index_codecs(spark):
    random.seed(5)
    data = [(42, 100, 256), (0, 0, 0), *[(random.getrandbits(62), random.getrandbits(62), random.getrandbits(31)) for _ in range(50)]]
    df = spark.createDataFrame(data, "a long, b long, c long")
    df = df.select("*", keys.index_key(F.col("a"), F.col("b")).alias("k"), keys.index_value(F.col("a"), F.col("b"), F.col("c")).alias("v"))
    ka, kb = keys.index_key_parts(F.col("k"))
    va, vb, vc = keys.index_value_parts(F.col("v"))
    out = df.select("a", "b", "c", "k", "v", ka.alias("ka"), kb.alias("kb"), va.alias("va"), vb.alias("vb"), vc.alias("vc")).collect()
    for r in out:
        assert (r.ka, r.kb) == (r.a, r.b) and (r.va, r.vb, r.vc) == (r.a, r.b, r.c)
        assert bytes(r.k) == r.a.to_bytes(8, "big") + r.b.to_bytes(8, "big")
        assert bytes(r.v) == r.a.to_bytes(8, "little") + r.b.to_bytes(8, "little") + r.c.to_bytes(4, "little")
    by_key = [(r.a, r.b) for r in sorted(out, key=lambda r: bytes(r.k))]
    assert by_key == sorted(by_key)


def test_names(spark):
    r = spark.range(1).select(
        keys.segment_name(F.lit(2), F.lit(100)).alias("s"), keys.segment_name(F.lit(1), F.lit(12345678)).alias("long"), keys.wal_name(F.lit(7)).alias("w"),
        keys.wal_number(F.lit("00000007.log")).alias("n"), keys.wal_number(F.lit("x.log")).alias("none"), keys.wal_offset(F.lit(3), F.lit(5)).alias("o"),
        keys.sanitized(F.lit("http://h:80/x")).alias("a"), keys.align_up(F.lit(4097)).alias("p"), keys.segment_key(F.lit("t"), F.lit(9)).alias("k"),
    ).first()
    assert (r.s, r.long, r.w, r.n, r.none, r.o, r.a, r.p) == ("L2_000100.cseg", "L1_12345678.cseg", "00000007.log", 7, None, (3 << 32) + 5, "http_h_80_x", 8192)
    assert r.k == "/catalog/timelines/t/seg/00000000000000000009"


@pytest.mark.parametrize("memory, cores, want", [(2048, 2, (512, 204, 102, 2)), (128, 1, (64, 32, 16, 2)), (65536, 64, (4096, 1024, 256, 16))])
def test_auto_config(spark, memory, cores, want):
    c = keys.auto_config(F.lit(memory), F.lit(cores))
    r = spark.range(1).select(*[c[k].alias(k) for k in ("block_cache_mb", "write_cache_mb", "write_buffer_mb", "background_jobs")]).first()
    assert tuple(r) == want


def test_payload_faults(spark):
    good = (5).to_bytes(8, "big") + bytes([5]) * 56
    cases = {"good": good, "short": good[:4], "size": good[:60], "fill": good[:-1] + b"\x06"}
    df = spark.createDataFrame([(k, v.hex().upper()) for k, v in cases.items()], "k string, h string")
    assert {r.k: r.f for r in df.select("k", payload.fault(F.col("h"), 64).alias("f")).collect()} == {"good": None, "short": "short", "size": "size", "fill": "fill"}
    assert spark.range(1).select(payload.expected(F.lit(5), 64)).first()[0] == good.hex().upper()


def test_first_difference(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abc", "abd"), ("ab", "abc"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(payload.first_difference(F.col("a"), F.col("b"))).collect()] == [None, 2, 2, 0]


def test_wire_names(spark):
    df = spark.createDataFrame([(0,), (3,), (9,), (None,)], "c int")
    assert [r[0] for r in df.select(named(F.col("c"), CHUNK_TYPE)).collect()] == ["FULL", "LAST", None, None]
