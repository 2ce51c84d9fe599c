"""Payload checks of the verification stream, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected(sequence: Column, size: int = 256) -> Column:
    """8 bytes of the sequence number, big-endian, then its last byte up to the size; as hex digits."""
    head = F.lpad(F.hex(sequence.cast("long")), 16, "0")
    return F.rpad(head, 2 * size, "0") if size <= 8 else F.concat(head, F.repeat(F.lpad(F.hex(sequence.cast("long") % 256), 2, "0"), size - 8))


def fault(payload_hex: Column, size: int = 256) -> Column:
    """"short", "size" or "fill" for a payload, in hex digits, that the checker would not have written; null for a good one."""
    n = F.length(payload_hex) / 2
    fill = F.substring(payload_hex, 15, 2)
    return F.when(n < 8, "short").when(n != size, "size").when(F.substring(payload_hex, 17, 2 * size) != F.repeat(fill, size - 8), "fill")


def first_difference(a: Column, b: Column) -> Column:
    """Place, from 0, of the first character in which two strings differ; the shorter's length if it begins the other; null if they are equal.

    The common beginning is found by halving: each step compares the next half of what is open as a whole, so that a payload is looked at as often as its length has binary digits.
    """
    n = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        size = F.floor((acc["high"] - acc["low"] + 1) / 2).cast("int")
        same = F.substring(a, acc["low"] + 1, size) == F.substring(b, acc["low"] + 1, size)
        return F.struct(F.when(same, acc["low"] + size).otherwise(acc["low"]).alias("low"), F.when(same, acc["high"]).otherwise(acc["low"] + size - 1).alias("high"))

    start = F.struct(F.lit(0).alias("low"), n.cast("int").alias("high"))
    return F.when(a != b, F.aggregate(steps, start, halve, lambda acc: acc["low"]))
