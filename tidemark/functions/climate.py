"""Climate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rain_day(precip: Column, threshold: float = 1.0) -> Column:
    return F.when(precip >= threshold, 1).otherwise(0)


def intensity_class(precip: Column) -> Column:
    """0 below 1 mm, 1 below 10, 2 below 25, else 3; missing counts as 0."""
    return F.when(precip.isNull() | (precip < 1), 0).when(precip < 10, 1).when(precip < 25, 2).otherwise(3)


def saturation_pressure(t: Column) -> Column:
    """Tetens, kPa."""
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def vapour_deficit(t: Column, dew: Column) -> Column:
    """Never below 0; null if either is."""
    return F.when(t.isNotNull() & dew.isNotNull(), F.greatest(F.lit(0.0), saturation_pressure(t) - saturation_pressure(dew)))


def freezing(t_min: Column, limit: float = 0.0) -> Column:
    return F.when(t_min < limit, 1).otherwise(0)


def water_year(date: Column, first_month: int = 10) -> Column:
    """The year in which the water year began."""
    return F.when(F.month(date) >= first_month, F.year(date)).otherwise(F.year(date) - 1)


def season(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
