"""Queries on projections, fitted distributions and binned densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projection
from ..functions import waves as w
from ..operators import fits, stats
from . import carriers as k
from .wave_queries import POWER, _round


def _sites(spark, d):
    """c_custkey, lon, lat: places along the coast, up to the zone's edge."""
    c = F.col("c_custkey")
    return k.read(spark, d, "customer").select("c_custkey", (-120 + (c % 6000) / 1000.0).alias("lon"), (30 + (c % 997) / 100.0).alias("lat"))


def site_projected(spark, d):
    """Sites in metres of UTM zone 11, to the millimetre."""
    east, north = projection.to_utm(F.col("lon"), F.col("lat"), 11)
    return _round(_sites(spark, d).select("c_custkey", east.alias("x"), north.alias("y")), "x", "y", digits=3)


_K = projection.series()


def _sum(base: str, odd: str, even: str) -> str:
    return " + ".join([base, *[f"{a!r}::double * {odd}({2 * j} * xi) * {even}({2 * j} * eta)" for j, a in enumerate(_K["alpha"], 1)]])


SITE_PROJECTED = f"""with s as (select c_custkey, radians(-120 + (c_custkey % 6000) / 1000.0::double + 117) as off, sin(radians(30 + (c_custkey % 997) / 100.0::double)) as sine from customer),
t as (select c_custkey, off, sinh(atanh(sine) - {_K["e"]!r}::double * atanh({_K["e"]!r}::double * sine)) as t from s),
u as (select c_custkey, atan2(t, cos(off)) as xi, atanh(sin(off) / sqrt(1 + t * t)) as eta from t)
select c_custkey, round(500000 + {_K["radius"]!r}::double * ({_sum("eta", "cos", "sinh")}), 3) as x, round({_K["radius"]!r}::double * ({_sum("xi", "sin", "cosh")}), 3) as y from u"""


def site_unprojected(spark, d):
    """Sites to metres and back to degrees."""
    east, north = projection.to_utm(F.col("lon"), F.col("lat"), 11)
    lon, lat = projection.from_utm(F.col("x"), F.col("y"), 11)
    return _round(_sites(spark, d).select("c_custkey", east.alias("x"), north.alias("y")).select("c_custkey", lon.alias("lon"), lat.alias("lat")), "lon", "lat", digits=8)


SITE_UNPROJECTED = "select c_custkey, round(-120 + (c_custkey % 6000) / 1000.0::double, 8) as lon, round(30 + (c_custkey % 997) / 100.0::double, 8) as lat from customer"


def wave_hexbin(spark, d):
    """Heights against periods in hexagons."""
    return _round(stats.hexbin(k.waves(spark, d), "tp", "hs"), "cx", "cy")


WAVE_HEXBIN = f"""with {k.WAVES}, e as (select min(tp) as x0, max(tp) as x1, min(hs) as y0, max(hs) as y1 from waves),
s as (select x0 - (x1 - x0) * 1e-9 as lx, y0 - (y1 - y0) * 1e-9 as ly, (x1 + (x1 - x0) * 1e-9 - (x0 - (x1 - x0) * 1e-9)) / 50 as sx, (y1 + (y1 - y0) * 1e-9 - (y0 - (y1 - y0) * 1e-9)) / 28 as sy from e),
u as (select (tp - lx) / sx as u, (hs - ly) / sy as v, s.* from waves, s),
f as (select *, (u - round_even(u, 0)) ** 2 + 3 * (v - round_even(v, 0)) ** 2 < (u - floor(u) - 0.5::double) ** 2 + 3 * (v - floor(v) - 0.5::double) ** 2 as one from u),
c as (select case when one then 0 else 1 end as lattice, cast(case when one then round_even(u, 0) else floor(u) end as integer) as i, cast(case when one then round_even(v, 0) else floor(v) end as integer) as j, lx, ly, sx, sy from f)
select lattice, i, j, count(*) as n, round(lx + (i + lattice * 0.5::double) * sx, 6) as cx, round(ly + (j + lattice * 0.5::double) * sy, 6) as cy from c group by lattice, i, j, lx, ly, sx, sy"""


def wave_power_box(spark, d):
    """Quartiles and whiskers of the power at each site."""
    x = k.waves(spark, d).select("mop_id", w.power(F.col("hs"), F.col("tp")).alias("power"))
    return _round(stats.box(x, ["mop_id"], "power"), "q1", "median", "q3", "low", "high", digits=4)


WAVE_POWER_BOX = f"""with {k.WAVES}, p as (select mop_id, {POWER} as v from waves), q as (select mop_id, count(*) as n, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as m, quantile_cont(v, 0.75) as q3 from p group by 1)
select q.mop_id, any_value(n) as n, round(any_value(q1), 4) as q1, round(any_value(m), 4) as median, round(any_value(q3), 4) as q3, round(min(v) filter (v >= q1 - 1.5 * (q3 - q1)), 4) as low, round(max(v) filter (v <= q3 + 1.5 * (q3 - q1)), 4) as high from q join p on p.mop_id = q.mop_id group by 1"""


def wave_weibull(spark, d):
    """Weibull's distribution of the heights at each site."""
    return _round(fits.weibull(k.waves(spark, d), ["mop_id"], "hs"), "shape", "scale")


def climate_extreme_levels(spark, d):
    """Extreme-value fit of each beach's wettest day of a year, and its return levels."""
    return _round(fits.extremes(k.climate(spark, d), ["beach"], "date", "precip_mm"), "shape", "place", "scale", "level", digits=4)


#: Fits have no SQL: they are tested against plain loops.
QUERIES = {
    "site_projected": (site_projected, SITE_PROJECTED), "site_unprojected": (site_unprojected, SITE_UNPROJECTED), "wave_hexbin": (wave_hexbin, WAVE_HEXBIN), "wave_power_box": (wave_power_box, WAVE_POWER_BOX),
    "wave_weibull": (wave_weibull, None), "climate_extreme_levels": (climate_extreme_levels, None),
}
