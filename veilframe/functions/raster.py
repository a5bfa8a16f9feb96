"""Raster kernels as column functions on small arrays.  Real slices go through operators.kernels in numpy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap16(c: Column) -> Column:
    """Integer modulo 2 ** 16 as signed 16 bits, as numpy has it."""
    return (F.pmod(c.cast("long") + 32768, F.lit(65536)) - 32768).cast("int")


def hounsfield(raw: Column, slope: Column, intercept: Column) -> Column:
    """Raw to HU: padding to 0, times slope (truncated), plus intercept; 16 bits."""
    cleaned = F.transform(raw, lambda x: F.when(x <= -2000, F.lit(0)).otherwise(x))
    scaled = F.transform(cleaned, lambda x: F.when(slope == 1, x.cast("long")).otherwise((x * slope).cast("long")))
    return F.transform(scaled, lambda x: wrap16(wrap16(x) + intercept.cast("long")))


def stored(hu: Column, slope: Column, intercept: Column) -> Column:
    """HU to raw: truncated to 16 bits; a slope of 0 counts as 1."""
    s = F.when(slope == 0, F.lit(1.0)).otherwise(slope)
    return F.transform(hu, lambda x: wrap16(((x - intercept) / s).cast("long")))


def gray8(hu: Column, inverted: Column | None = None) -> Column:
    """0 to 255 between the least and the largest value, truncated; a constant image is 0."""
    lo, hi = F.array_min(hu), F.array_max(hu)
    span = F.when(hi <= lo, F.lit(1.0)).otherwise((hi - lo).cast("double"))
    out = F.transform(hu, lambda x: F.least(F.greatest(((x - lo) / span * 255).cast("int"), F.lit(0)), F.lit(255)))
    return out if inverted is None else F.when(inverted, F.transform(out, lambda x: 255 - x)).otherwise(out)


def window8(hu: Column, centre: float = -100.0, width: float = 350.0) -> Column:
    """0 to 255 over a display window."""
    lo = centre - width / 2
    return F.transform(hu, lambda x: (F.least(F.greatest((x - lo) / width, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def air_mask(hu: Column, air: int) -> Column:
    return F.transform(hu, lambda x: (x <= air).cast("int"))


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(F.aggregate(F.transform(F.transform(values, lambda x: x - mean), lambda d: d * d), F.lit(0.0), lambda a, x: a + x) / n)


def filled(hu: Column, cols: int, r: Column, value: Column) -> Column:
    """A row-major image with one rectangle set to a value."""
    def one(x: Column, i: Column) -> Column:
        row, col = (i / cols).cast("int"), i % cols
        return F.when((row >= r.y0) & (row < r.y1) & (col >= r.x0) & (col < r.x1), value).otherwise(x)

    return F.transform(hu, one)


def kernel_bounds(spacing: Column, kernel_mm: tuple[float, float]) -> tuple[Column, Column]:
    """Least and largest kernel diameter in pixels."""
    cut = lambda c: F.greatest(F.lit(1), F.least(c.cast("int"), F.lit(999)))
    lo, hi = F.ceil(kernel_mm[0] / spacing), F.ceil(kernel_mm[1] / spacing)
    ok = F.coalesce(spacing > 0, F.lit(False))
    return F.when(ok, cut(lo)).otherwise(F.lit(int(kernel_mm[0]))), F.when(ok, cut(F.greatest(lo, hi))).otherwise(F.lit(int(kernel_mm[1])))


def kernel_size(spacing: Column, key: Column, kernel_mm: tuple[float, float]) -> Column:
    """A diameter between the bounds, the same for the same key."""
    lo, hi = kernel_bounds(spacing, kernel_mm)
    return (F.pmod(F.xxhash64(key), (hi - lo + 1).cast("long")) + lo).cast("int")


def anterior(iop: Column) -> tuple[Column, Column]:
    """(axis, sign) that point to the front of the head, from the image orientation."""
    dr, dc = -F.get(iop, 1), -F.get(iop, 4)
    rows = F.coalesce(F.abs(dr) >= F.abs(dc), F.lit(True))
    d = F.when(rows, dr).otherwise(dc)
    return F.when(rows, 0).otherwise(1), F.when(iop.isNull() | (F.size(iop) != 6) | (d > 0), 1).otherwise(-1)
