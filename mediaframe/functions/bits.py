"""Bit, byte and clamp helpers (Column -> Column).

Unsigned 32-bit values live in BIGINT columns: ANSI mode rejects them as INT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296
U32_MASK = TWO32 - 1


def lit_long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def bits(word: Column, hi: int, lo: int) -> Column:
    """Bit field [hi..lo] of a BIGINT word."""
    return F.shiftright(word, lo).bitwiseAND(lit_long((1 << (hi - lo + 1)) - 1))


def has_bit(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask)) != 0


def byte_swap(word: Column) -> Column:
    """Reverse the four bytes of a u32."""
    return (
        F.shiftleft(bits(word, 7, 0), 24)
        + F.shiftleft(bits(word, 15, 8), 16)
        + F.shiftleft(bits(word, 23, 16), 8)
        + bits(word, 31, 24)
    )


def be_uint(blob: Column, pos: Column | int, n: int) -> Column:
    """Big-endian unsigned integer of n bytes at 0-based offset pos of a binary column."""
    start = (pos if isinstance(pos, Column) else F.lit(pos)) + 1
    piece = F.substring(blob, start.cast("int"), F.lit(n)) if isinstance(pos, Column) else F.substring(blob, pos + 1, n)
    return F.conv(F.hex(piece), 16, 10).cast("bigint")


def u32_hex(word: Column) -> Column:
    """8 lower-case hex digits of a u32."""
    return F.lower(F.lpad(F.hex(word), 8, "0"))


def hex_to_long(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def parse_int_any_radix(token: Column) -> Column:
    """'0x1f', '0b101', '0o17' or decimal text to BIGINT; anything else is NULL."""
    t = F.lower(token)
    body = F.substr(t, F.lit(3))
    return (
        F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(body, 16, 10).cast("bigint"))
        .when(t.rlike("^0b[01]+$"), F.conv(body, 2, 10).cast("bigint"))
        .when(t.rlike("^0o[0-7]+$"), F.conv(body, 8, 10).cast("bigint"))
        .when(t.rlike("^[0-9]+$"), F.conv(t, 10, 10).cast("bigint"))
    )


def wrap_diff32(a: Column, b: Column) -> Column:
    """a - b on a wrapping 32-bit counter, as a signed value."""
    d = F.pmod(a - b, lit_long(TWO32))
    return F.when(d >= lit_long(TWO32 // 2), d - lit_long(TWO32)).otherwise(d)


def clip(value: Column, lo: int | Column, hi: int | Column) -> Column:
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(hi_c, F.greatest(lo_c, value))


def clip255(value: Column) -> Column:
    return clip(value, 0, 255)


def int_div(a: Column, b: int) -> Column:
    """Integer division of a non-negative value by a constant, without going through DOUBLE."""
    return F.call_function("div", a, F.lit(b))
