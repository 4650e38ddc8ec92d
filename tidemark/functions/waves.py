"""Wave physics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RHO, G = 1025.0, 9.81
FILL_LIMIT = -998.99


def valid(c: Column) -> Column:
    """Null for fill values and NaN."""
    return F.when((c > FILL_LIMIT) & ~F.isnan(c), c)


def power(hs: Column, tp: Column) -> Column:
    """Kilowatts a metre of crest."""
    return RHO * G * G / (64 * math.pi) * hs * hs * tp / 1000


def energy(hs: Column) -> Column:
    return RHO * G / 16 * hs * hs


def runup(hs: Column, tp: Column, slope: float = 0.1) -> Column:
    """Stockdon's 2 % runup; on dissipative shores (Iribarren number below 0.3) its short form.  Calm or missing waves give 0."""
    deep = G * tp * tp / (2 * math.pi)
    root = F.sqrt(hs * deep)
    xi = slope / F.sqrt(hs / deep)
    steep = 1.1 * (0.35 * slope * root + 0.5 * F.sqrt(hs * deep * (0.563 * slope * slope + 0.004)))
    return F.when((hs > 0) & (tp > 0), F.when(xi < 0.3, 0.043 * root).otherwise(steep)).otherwise(0.0)


def shore_normal(hs: Column, dp: Column, orientation: Column) -> Column:
    return hs * F.abs(F.cos(F.radians(dp - orientation)))


def circular_mean(angle: Column) -> Column:
    """Mean direction in degrees, in [0, 360) (an aggregate)."""
    r = F.radians(angle)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))
