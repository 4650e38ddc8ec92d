"""Lines, projections and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def length(x0, y0, x1, y1) -> Column:
    return F.hypot(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0))


def direction(x0, y0, x1, y1) -> tuple[Column, Column]:
    """Unit direction of a line; a line without length has none (0, 0)."""
    n = length(x0, y0, x1, y1) + EPS
    return (F.col(x1) - F.col(x0)) / n, (F.col(y1) - F.col(y0)) / n


def along(px: Column, py: Column, ox: Column, oy: Column, dx: Column, dy: Column) -> Column:
    """Distance of a point's projection from the line's start."""
    return (px - ox) * dx + (py - oy) * dy


def across(px: Column, py: Column, ox: Column, oy: Column, dx: Column, dy: Column) -> Column:
    """Distance of a point from the line."""
    return F.abs((px - ox) * dy - (py - oy) * dx)


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    a = F.degrees(F.atan2(dx, dy))
    return F.when(a < 0, a + 360).otherwise(a)


def boxes_overlap(a: tuple, b: tuple, buffer: float = 0.0) -> Column:
    """Closed boxes (xmin, ymin, xmax, ymax); touching ones overlap, the buffer widens the first."""
    ax0, ay0, ax1, ay1 = map(F.col, a)
    bx0, by0, bx1, by1 = map(F.col, b)
    return (ax1 + buffer >= bx0) & (bx1 >= ax0 - buffer) & (ay1 + buffer >= by0) & (by1 >= ay0 - buffer)


def extended_start(x0: Column, nx: Column, distance: float, name: Column, pattern: str | None = None) -> Column:
    """A start moved inland against the normal, for names that contain the pattern in any case."""
    moved = x0 - distance * nx
    return moved if pattern is None else F.when(F.upper(name).contains(pattern.upper()), moved).otherwise(x0)


def utm_zone(longitude: Column) -> Column:
    return (F.floor((longitude + 180) / 6) + 1).cast("int")


def principal_angle(x: str, y: str) -> Column:
    """Degrees of the first principal axis of a group's points (an aggregate)."""
    return F.degrees(0.5 * F.atan2(2 * F.covar_samp(x, y), F.var_samp(x) - F.var_samp(y)))


def nice_length(width: Column) -> Column:
    """The 1, 2 or 5 times a power of ten that is nearest to a sixth of the width."""
    target = width / 6
    power = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    options = F.array(power, 2 * power, 5 * power, 10 * power)
    return F.array_min(F.transform(options, lambda v: F.struct(F.abs(v - target).alias("off"), v.alias("v"))))["v"]


def cell_number(value: Column, origin, cell: float) -> Column:
    return F.floor((value - origin) / F.lit(float(cell))).cast("long")


def _every_second_bit(v: Column) -> Column:
    """The low 31 bits of a number, moved to the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(cx: Column, cy: Column) -> Column:
    """Morton code of a cell (numbers below 2**31): its bits in turn, x at the even places."""
    return _every_second_bit(cx).bitwiseOR(F.shiftleft(_every_second_bit(cy), 1))
