"""Unsigned 64-bit addresses held in signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the kernel's sampling interface, as signed longs.
USER_CONTEXT = -512
DEFERRED_CONTEXT = -640
ALL_PIDS = 4294967295
_MIN = -(2**63)


def signed(x: int) -> int:
    """An unsigned 64-bit number as the long with its bits."""
    return x - 2**64 if x >= 2**63 else x


def order_key(c: Column) -> Column:
    """A long that sorts as c does unsigned."""
    return c.bitwiseXOR(F.lit(_MIN))


def is_marker(c: Column) -> Column:
    """Context markers: 0xfffffffffffff000 and above."""
    return c.between(-4096, -1)


def is_kernel(c: Column) -> Column:
    """0xffff800000000000 and above, markers excepted."""
    return (c < -4096) & (c >= -140737488355328)


def hex_address(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def hex16(c: Column) -> Column:
    return F.format_string("0x%016x", c)


def hex_to_long(c: Column) -> Column:
    """Up to 16 hexadecimal digits as the long with their bits."""
    return F.conv(c, 16, -10).cast("long")


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64 without an overflow error: low and high halves apart."""
    low = a.bitwiseAND(0xFFFFFFFF) + b.bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def wrapping_sub(a: Column, b: Column) -> Column:
    return wrapping_add(a, wrapping_add(F.bitwise_not(b), F.lit(1).cast("long")))


def saturating_end(start: Column, length: Column) -> Column:
    """start + length, at most 2**64 - 1, all unsigned."""
    end = wrapping_add(start, length)
    return F.when(order_key(end) < order_key(start), F.lit(-1).cast("long")).otherwise(end)


def within(low: Column, high: Column, at: Column) -> Column:
    """low <= at < high, unsigned."""
    return (order_key(low) <= order_key(at)) & (order_key(at) < order_key(high))


def contains(start: Column, length: Column, at: Column) -> Column:
    """start <= at < start + length, unsigned."""
    return (order_key(start) <= order_key(at)) & (order_key(at) < order_key(saturating_end(start, length)))
