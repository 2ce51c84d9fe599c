"""Keys, names and sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(number: Column, width: int, little: bool = False) -> Column:
    """The last `width` bytes of a number's two's complement, as hex digits."""
    digits = F.substring(F.lpad(F.hex(number.cast("long")), 16, "0"), 17 - 2 * width, 2 * width)
    if not little:
        return digits
    return F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(width, 0, -1)])


def _number(hexed: Column, width: int, little: bool = False) -> Column:
    """The signed number that hex digits of `width` bytes stand for."""
    if little:
        hexed = F.concat(*[F.substring(hexed, 2 * i - 1, 2) for i in range(width, 0, -1)])
    value = F.conv(hexed, 16, -10).cast("long") if width == 8 else F.conv(hexed, 16, 10).cast("long")
    return value


def index_key(timeline_id: Column, log_offset: Column) -> Column:
    """16 bytes, big-endian: bytes sort as (timeline, offset) do for numbers that aren't negative."""
    return F.unhex(F.concat(_bytes(timeline_id, 8), _bytes(log_offset, 8)))


def index_key_parts(key: Column) -> tuple[Column, Column]:
    h = F.hex(key)
    return _number(F.substring(h, 1, 16), 8), _number(F.substring(h, 17, 16), 8)


def index_value(segment_id: Column, byte_offset: Column, length: Column) -> Column:
    """20 bytes, little-endian: segment 8, offset 8, length 4."""
    return F.unhex(F.concat(_bytes(segment_id, 8, True), _bytes(byte_offset, 8, True), _bytes(length, 4, True)))


def index_value_parts(value: Column) -> tuple[Column, Column, Column]:
    h = F.hex(value)
    return _number(F.substring(h, 1, 16), 8, True), _number(F.substring(h, 17, 16), 8, True), _number(F.substring(h, 33, 8), 4, True)


def padded(number: Column, width: int = 20) -> Column:
    """Digits with leading zeros: sorts as text as the numbers do."""
    return F.lpad(number.cast("string"), width, "0")


def segment_name(level: Column, segment_id: Column) -> Column:
    return F.concat(F.lit("L"), level.cast("string"), F.lit("_"), _at_least(segment_id, 6), F.lit(".cseg"))


def wal_name(number: Column) -> Column:
    return F.concat(_at_least(number, 8), F.lit(".log"))


def _at_least(number: Column, width: int) -> Column:
    digits = number.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def wal_number(name: Column) -> Column:
    """The number in a write-ahead log's file name; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)\.log$", 1), F.lit("")).cast("long")


def wal_offset(number: Column, local: Column) -> Column:
    """One number for a file and a position in it."""
    return F.shiftleft(number.cast("long"), 32).bitwiseOR(local.cast("long").bitwiseAND(0xFFFFFFFF))


def shard(number: Column, shards: int = 4) -> Column:
    """Actor of an id; shards is a power of two."""
    return number.cast("long").bitwiseAND(shards - 1)


def sanitized(address: Column) -> Column:
    """An address as part of a key."""
    return F.translate(F.replace(address, F.lit("://"), F.lit("_")), "/:", "__")


def catalog_key(name: Column) -> Column:
    return F.concat(F.lit("/catalog/timelines/"), name)


def segment_key(name: Column, start_offset: Column) -> Column:
    return F.concat(catalog_key(name), F.lit("/seg/"), padded(start_offset))


def align_up(size: Column, page: int = 4096) -> Column:
    return F.floor((size + page - 1) / page) * page


def disk_usage(available: Column, total: Column) -> Column:
    """Share of a disk that is used; 0 for one without a size."""
    return F.when(total > 0, 1 - available / total).otherwise(0.0)


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def cutoff_ms(now: Column, ttl_hours: Column) -> Column:
    """Time before which what was made has outlived a time to live in hours."""
    return now - ttl_hours * 3_600_000


def clamped(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def auto_config(memory_mb: Column, cores: Column) -> dict[str, Column]:
    """Sizes that follow from a machine's memory and cores, in MB."""
    share = lambda n: F.floor(memory_mb / n)
    return {
        "block_cache_mb": clamped(share(4), 64, 4096),
        "write_cache_mb": clamped(share(10), 32, 1024),
        "write_buffer_mb": clamped(share(20), 16, 256),
        "background_jobs": clamped(cores, 2, 16),
    }
