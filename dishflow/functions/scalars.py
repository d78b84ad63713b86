"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    """Six decimals, no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def power(re: Column, im: Column) -> Column:
    """Squared magnitude of a complex number."""
    return re * re + im * im


def complex_abs(re: Column, im: Column) -> Column:
    return F.sqrt(power(re, im))


def complex_mul(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> tuple[Column, Column]:
    return a_re * b_re - a_im * b_im, a_re * b_im + a_im * b_re


def fraction(x: Column) -> Column:
    """Part behind the point, with the sign of x."""
    return x % F.lit(1.0)


def truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def bit_reverse(x: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long")


def divide_up(x: Column, y: int) -> Column:
    return F.floor((x + (y - 1)) / y).cast("long")


def mjd(unix_ns: Column) -> Column:
    """Modified Julian date of unix nanoseconds."""
    return unix_ns / F.lit(86400e9) + F.lit(2440587.5) - F.lit(2400000.5)


def sigproc_dms(degrees: Column) -> Column:
    """ddmmss.s of an angle in degrees, with its sign."""
    a = F.abs(degrees)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = ((a - d) * 60 - m) * 60
    return F.signum(degrees) * (d * 10000 + m * 100 + s)


def little_endian(raw: Column, start: int, n: int) -> Column:
    """Unsigned little-endian integer of n bytes (up to 8) from byte `start` (0-based)."""
    reversed_hex = F.concat(*[F.substring(F.hex(raw), 2 * (start + i) + 1, 2) for i in reversed(range(n))])
    return F.conv(reversed_hex, 16, 10).cast("decimal(20,0)").cast("long")


def byte_at(raw: Column, i: Column | int) -> Column:
    """Value 0..255 of a byte, 0-based."""
    return F.conv(F.substring(F.hex(raw), 2 * i + 1, 2) if isinstance(i, int) else F.substr(F.hex(raw), 2 * i + 1, F.lit(2)), 16, 10).cast("int")


def color(text: str) -> int:
    """0xffrrggbb of "#rrggbb"."""
    return 0xFF000000 | int(text.removeprefix("#")[-6:], 16)


def color_column(text: Column) -> Column:
    """As color, of a column."""
    return F.conv(F.right(text, F.lit(6)), 16, 10).cast("long") + F.lit(0xFF000000)


def argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    return (a * 16777216 + r * 65536 + g * 256 + b).cast("long")


def argb_field(x: Column, shift: int) -> Column:
    return F.shiftright(x, shift).bitwiseAND(F.lit(255).cast("long"))
