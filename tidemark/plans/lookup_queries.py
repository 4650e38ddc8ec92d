"""Queries on look-ups, bounds, padded bins, names, weights and quality, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as lab
from ..functions import waves as w
from ..operators import joins, lookups, profile
from . import carriers as k
from .wave_queries import _round

#: Moves test values off rounding ties, where two engines' last bits differ.
TIE = 1e-7


def profile_value_at(spark, d):
    """Elevation of each profile at one distance, which may lie beyond its ends."""
    x = lookups.lines_of(k.profiles(spark, d), ["transect"], "distance", "elevation").withColumn("at", (F.col("transect") % 140) * 0.25 - 2)
    return _round(x.select("transect", "at", lookups.value_at(F.col("at"), F.col("points")).alias("elevation")), "elevation", digits=4)


VALUE_AT = f"""with {k.PROFILES}, e as (select transect, (transect % 140) * 0.25::double - 2 as at_m, list(elevation order by i) as z from profiles group by 1), p as (select *, least(greatest(at_m, 0), 31.5) / 0.5 as p from e)
select transect, at_m as at, round(z[floor(p)::integer + 1] + (z[least(floor(p)::integer + 2, 64)] - z[floor(p)::integer + 1]) * (p - floor(p)), 4) as elevation from p"""


def profile_pair_change(spark, d):
    """Changes from each even profile, measured at other distances, to the odd one after it."""
    p = k.profiles(spark, d).withColumn("pair", F.floor(F.col("transect") / 2))
    first = p.where("transect % 2 = 0").withColumn("distance", F.col("i") * 0.55 + 0.3)
    x = lookups.change_on_second(first, p.where("transect % 2 = 1"), ["pair"], "distance", "elevation")
    return _round(x, "mean_change", "max_gain", "max_loss", "std_change", digits=4)


PAIR_CHANGE = f"""with {k.PROFILES}, e as (select cast(floor(transect / 2) as bigint) as pair, list(elevation order by i) as z from profiles where transect % 2 = 0 group by 1),
p as (select e.pair, z, elevation, least(greatest((distance - 0.3::double) / 0.55::double, 0), 63) as p from profiles join e on e.pair = floor(transect / 2) where transect % 2 = 1),
x as (select pair, elevation - (z[floor(p)::integer + 1] + (z[least(floor(p)::integer + 2, 64)] - z[floor(p)::integer + 1]) * (p - floor(p))) as v from p)
select pair, round(avg(v), 4) as mean_change, round(max(v), 4) as max_gain, round(min(v), 4) as max_loss, round(stddev_pop(v), 4) as std_change from x group by 1"""


def profile_value_range(spark, d):
    """Least and greatest value of each label's profiles, a tenth of the range added on both sides."""
    pad = (F.max("elevation") - F.min("elevation")) * 0.1
    return _round(k.profiles(spark, d).groupBy("label").agg((F.min("elevation") - pad).alias("y_min"), (F.max("elevation") + pad).alias("y_max")), "y_min", "y_max", digits=4)


VALUE_RANGE = f"with {k.PROFILES} select label, round(min(elevation) - (max(elevation) - min(elevation)) * 0.1::double, 4) as y_min, round(max(elevation) + (max(elevation) - min(elevation)) * 0.1::double, 4) as y_max from profiles group by 1"


def _bins(spark, d):
    p = k.points(spark, d).select("las_source", F.col("x").alias("distance"), F.col("y").alias("elevation"))
    b = profile.voxel_bins(p, ["las_source"], 1.0)
    ends = p.groupBy("las_source").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    n = F.least(F.greatest(F.floor(F.col("hi") - F.col("lo")), F.lit(1)), F.lit(128)).cast("int")
    return b.join(ends.withColumn("n_bins", n).withColumn("width", F.greatest((F.col("hi") - F.col("lo")) / n, F.lit(1e-8))), "las_source")


_BINS = f"""{k.POINTS}, a as (select las_source, x, y, min(x) over v as lo, max(x) over v as hi from points window v as (partition by las_source)), n as (select *, cast(least(greatest(floor(hi - lo), 1), 128) as integer) as nb from a),
c as (select *, greatest((hi - lo) / nb, 1e-8) as wd, cast(least(floor((x - lo) / greatest((hi - lo) / nb, 1e-8)), nb - 1) as integer) as bin from n),
bins as (select las_source, bin, any_value(nb) as nb, any_value(lo) as lo, any_value(wd) as wd, count(*) >= 3 as valid, case when count(*) >= 3 then avg(y) else 0 end as mean, case when count(*) >= 3 then degrees(atan(coalesce(regr_slope(y, x), 0))) else 0 end as slope from c group by 1, 2)"""


def voxels_padded(spark, d):
    x = lookups.pad_bins(_bins(spark, d), ["las_source"], "n_bins", "lo", "width", 1.0, 128)
    return _round(x.withColumn("centre", F.col("centre") + TIE).withColumn("mean", F.col("mean") + TIE), "centre", "mean", digits=4)


VOXELS_PADDED = f"""with {_BINS}, o as (select las_source, any_value(nb) as nb, any_value(lo) as lo, any_value(wd) as wd from bins group by 1)
select o.las_source, cast(i as integer) as bin, round(case when i < o.nb then o.lo + (i + 0.5) * o.wd else o.lo + (o.nb - 0.5) * o.wd + (i - o.nb + 1) end + 1e-7, 4) as centre, round(coalesce(mean, 0) + 1e-7, 4) as mean, coalesce(valid, false) as valid
from o cross join range(0, 128) t(i) left join bins b on b.las_source = o.las_source and b.bin = i"""


def voxels_metadata(spark, d):
    return _round(lookups.voxel_metadata(_bins(spark, d), ["las_source"]), "cliff_height", "mean_slope", "max_slope", "toe_elevation", digits=4)


VOXELS_METADATA = f"""with {_BINS}, s as (select *, bool_or(valid) over (partition by las_source) as any_valid, min(bin) over (partition by las_source) as first from bins)
select las_source, round(max(mean) - min(mean), 4) as cliff_height, round(avg(abs(slope)), 4) as mean_slope, round(max(abs(slope)), 4) as max_slope, round(arg_min(mean, bin), 4) as toe_elevation from s where valid or (not any_valid and bin = first) group by 1"""


def names_variants(spark, d):
    """Numbers and dates of names whose part after ``_`` doesn't count."""
    c = F.col("c_custkey")
    name = F.when(c % 3 == 0, F.format_string("MOP %d_%03d", 500 + c % 90, c % 10)).when(c % 3 == 1, F.format_string("2020%02d11_%d", c % 14, c)).otherwise(F.format_string("mop %dx%d", c % 9, c % 10))
    return k.read(spark, d, "customer").select("c_custkey", lab.mop_base(name).alias("mop"), lab.survey_date(name).alias("date"))


NAMES_VARIANTS = """select c_custkey, cast(case c_custkey % 3 when 0 then 500 + c_custkey % 90 when 1 then 20200011 + 100 * (c_custkey % 14) else (c_custkey % 9) * 10 + c_custkey % 10 end as integer) as mop,
 case when c_custkey % 3 = 1 and c_custkey % 14 between 1 and 12 then make_date(2020, c_custkey % 14, 11) end as date from customer"""


def alongshore_sites(spark, d):
    """Number and transect of a distance along a beach; an unknown beach gives nulls."""
    c = F.col("c_custkey")
    x = k.read(spark, d, "customer").select("c_custkey", (c * 37 % 5000).cast("double").alias("metres"), F.element_at(F.array(*[F.lit(n) for n, _, _ in k.BEACHES], F.lit("elsewhere")), (c % 7 + 1).cast("int")).alias("beach"))
    at = x.join(F.broadcast(k.beaches(spark)), "beach", "left")  # six ranges
    return at.select("c_custkey", "beach", lab.mop_alongshore(F.col("metres"), F.col("mop_lo")).alias("mop"), lab.transect_index(F.col("metres"), F.col("mop_lo"), (F.col("mop_hi") - F.col("mop_lo")) * 10).alias("transect_idx"))


ALONGSHORE = f"""with {k.BEACH_ROWS}, x as (select c_custkey, (c_custkey * 37 % 5000)::double as m, case c_custkey % 7 {' '.join(f"when {i} then '{n}'" for i, (n, _, _) in enumerate(k.BEACHES))} else 'elsewhere' end as beach from customer)
select c_custkey, x.beach, mop_lo + m / 100 as mop, cast(mop_lo + least(greatest(round_even(m / 10, 0), 0), (mop_hi - mop_lo) * 10 - 1) as integer) as transect_idx from x left join beaches b on x.beach = b.beach"""


def site_geometry(spark, d):
    """Zone of a longitude, length of a scale bar, start moved inland, colour and mapped path of each source."""
    x = k.points(spark, d).groupBy("las_source").agg(F.min("x").alias("lo"), (F.max("x") - F.min("x")).alias("width"), F.max("intensity").alias("red"))
    name = F.when(F.col("las_source") % 2 == 0, "delMar").otherwise("blacks")
    path = F.concat(F.when(F.col("las_source") % 3 == 0, "/a/b/").otherwise("/a/"), F.col("las_source").cast("string"))
    x = x.select(
        "las_source", g.utm_zone(F.col("las_source") % 360 - 180.0).alias("zone"), g.nice_length(F.col("width")).alias("bar"), g.extended_start(F.col("lo"), F.lit(0.5), 10.0, name, "delmar").alias("start"),
        lab.colour(F.col("red"), F.lit(2.0), F.lit(None).cast("double")).alias("colour"), lab.mapped_path(path, {"/a/": "/x/", "/a/b/": "/y/"}).alias("path"),
    )
    return _round(x, "start", "bar", digits=4)


SITE_GEOMETRY = f"""with {k.POINTS}, x as (select las_source, min(x) as lo, max(x) - min(x) as w, max(intensity) as red from points group by 1), t as (select *, w / 6 as t, pow(10.0::double, floor(log10(w / 6))) as p from x),
o as (select *, abs(p - t) as a, abs(2 * p - t) as b, abs(5 * p - t) as c, abs(10 * p - t) as e from t)
select las_source, cast(floor((las_source % 360) / 6) + 1 as integer) as zone, round(case when a = least(a, b, c, e) then p when b = least(a, b, c, e) then 2 * p when c = least(a, b, c, e) then 5 * p else 10 * p end, 4) as bar,
 round(case when las_source % 2 = 0 then lo - 5 else lo end, 4) as start, 'rgb(' || cast(trunc(red * 255) as integer) || ',255,128)' as colour, case when las_source % 3 = 0 then '/y/' else '/x/' end || las_source as path from o"""


def files_near_lines(spark, d):
    """Files (orders) near two lines; some have no stored bounds."""
    x = k.read(spark, d, "lineitem")
    known = F.col("l_orderkey") % 11 != 0
    side = lambda f, c, n: F.when(F.first(known), f(c)).alias(n)
    files = x.groupBy("l_orderkey").agg(side(F.min, F.col("l_extendedprice") / 1000, "x_min"), side(F.min, F.col("l_quantity"), "y_min"), side(F.max, F.col("l_extendedprice") / 1000, "x_max"), side(F.max, F.col("l_quantity"), "y_max"))
    lines = spark.createDataFrame([(60.0, 40.0, 70.0, 45.0), (64.0, 48.0, 58.0, 44.0)], "x0 double, y0 double, x1 double, y1 double")
    return lookups.prune_files(files, lines, 2.5).select("l_orderkey")


FILES_NEAR = "select l_orderkey from lineitem group by 1 having l_orderkey % 11 = 0 or (max(l_extendedprice / 1000) >= 55.5 and min(l_extendedprice / 1000) <= 72.5 and max(l_quantity) >= 37.5 and min(l_quantity) <= 50.5)"


def lines_in_extent(spark, d):
    """Transects with an end in a box, or whose own box touches it."""
    c = F.col("c_custkey")
    x = k.read(spark, d, "customer").select("c_custkey", (c % 100).alias("x0"), (c % 50).alias("y0"), (c % 100 + c % 13 - 6).alias("x1"), (c % 50 + c % 7 - 3).alias("y1"))
    x = x.select("c_custkey", F.least("x0", "x1").alias("ax0"), F.least("y0", "y1").alias("ay0"), F.greatest("x0", "x1").alias("ax1"), F.greatest("y0", "y1").alias("ay1"), F.lit(20).alias("bx0"), F.lit(10).alias("by0"), F.lit(60).alias("bx1"), F.lit(30).alias("by1"))
    return x.where(g.boxes_overlap(("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1"))).select("c_custkey")


LINES_IN = """with x as (select c_custkey, c_custkey % 100 as x0, c_custkey % 50 as y0, c_custkey % 100 + c_custkey % 13 - 6 as x1, c_custkey % 50 + c_custkey % 7 - 3 as y1 from customer)
select c_custkey from x where (x0 between 20 and 60 and y0 between 10 and 30) or (x1 between 20 and 60 and y1 between 10 and 30) or not (greatest(x0, x1) < 20 or least(x0, x1) > 60 or greatest(y0, y1) < 10 or least(y0, y1) > 30)"""


def wave_derived(spark, d):
    """Shore-normal height, runup and day of the year; a site without an orientation has no shore-normal height."""
    sites = spark.range(20).where("id % 5 <> 0").select(F.col("id").alias("mop_id"), (F.col("id") + 262.0).alias("orientation"))
    x = k.waves(spark, d).join(F.broadcast(sites), "mop_id", "left")  # a row a site
    return _round(x.select("event_id", w.shore_normal(F.col("hs"), F.col("dp"), F.col("orientation")).alias("shore_normal"), w.runup(F.col("hs"), F.col("tp")).alias("runup"), F.dayofyear("ts").alias("day")), "shore_normal", "runup", digits=4)


WAVE_DERIVED = f"""with {k.WAVES}, l as (select *, 9.81 * tp * tp / (2 * pi()) as l0 from waves)
select event_id, round(case when mop_id % 5 <> 0 then hs * abs(cos(radians(dp - (mop_id + 262.0::double)))) end, 4) as shore_normal, cast(dayofyear(ts) as integer) as day,
 round(case when hs > 0 and tp > 0 then case when 0.1 / sqrt(hs / l0) < 0.3 then 0.043 * sqrt(hs * l0) else 1.1 * (0.35 * 0.1 * sqrt(hs * l0) + 0.5 * sqrt(hs * l0 * (0.563 * 0.01 + 0.004))) end else 0 end, 4) as runup from l"""


def wave_daily_display(spark, d):
    """Daily means of whole rows from a first day on; directions are averaged as numbers."""
    x = k.waves(spark, d).dropna(subset=["hs", "tp", "dp"]).where("ts >= '2017-01-01'")
    return _round(x.groupBy("mop_id", F.to_date("ts").alias("date")).agg(*[(F.avg(c) + TIE).alias(c) for c in ("hs", "tp", "dp")]), "hs", "tp", "dp", digits=4)


WAVE_DAILY = f"with {k.WAVES} select mop_id, cast(ts as date) as date, round(avg(hs) + 1e-7, 4) as hs, round(avg(tp) + 1e-7, 4) as tp, round(avg(dp) + 1e-7, 4) as dp from waves where hs is not null and tp is not null and dp is not null and ts >= '2017-01-01' group by 1, 2"


def wave_availability(spark, d):
    return k.waves(spark, d).groupBy("mop_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


AVAILABILITY = f"with {k.WAVES} select mop_id, min(ts) as first, max(ts) as last, count(*) as n from waves group by 1"


def epoch_gaps(spark, d):
    """Days since the survey before, also as a label."""
    before = F.lag("epoch_date").over(Window.orderBy("epoch_idx"))  # a row a survey
    x = k.epochs(spark, d).withColumn("days", F.datediff("epoch_date", before))
    label = F.when(F.col("days").isNull(), "N/A").otherwise(F.format_string("%d days", "days"))
    return x.select("epoch_idx", F.substring(F.col("epoch_date").cast("string"), 1, 7).alias("month"), "days", label.alias("label"))


EPOCH_GAPS = f"with {k.EPOCHS}, x as (select *, cast(epoch_date - lag(epoch_date) over (order by epoch_idx) as integer) as days from epochs) select epoch_idx, strftime(epoch_date, '%Y-%m') as month, days, coalesce(days || ' days', 'N/A') as label from x"


def beach_coverage(spark, d):
    """Share of covered cells of each beach of ten transects over seven surveys."""
    x = k.cells(spark, d).groupBy(F.floor(F.col("transect_idx") / 10).cast("int").alias("beach")).agg(F.count("*").alias("present"))
    return _round(x.withColumn("pct", 100.0 * F.col("present") / 70), "pct", digits=4)


BEACH_COVERAGE = f"with {k.CELLS} select cast(floor(transect_idx / 10) as integer) as beach, count(*) as present, round(100.0::double * count(*) / 70, 4) as pct from cells group by 1"


def beach_half_open(spark, d):
    """The beach whose range holds a number, its end left out; null without one."""
    p = k.probes(spark, d)
    hit = joins.band_join(p, k.beaches(spark), "mop", "mop_lo", "mop_hi", 50).where("mop < mop_hi").groupBy("c_custkey").agg(F.min_by("beach", "beach_order").alias("beach"))
    return p.join(hit, "c_custkey", "left")


HALF_OPEN = f"with {k.PROBES}, {k.BEACH_ROWS} select c_custkey, mop, (select arg_min(beach, beach_order) from beaches where mop >= mop_lo and mop < mop_hi) as beach from probes"


def quality_report(spark, d):
    """Checks of the cells and slumps in one table."""
    c, s = k.cells(spark, d), k.slumps(spark, d)
    e = k.epochs(spark, d).withColumn("before", F.lag("epoch_date").over(Window.orderBy("epoch_idx")))  # a row a survey
    return lookups.quality_report({
        "keys": (c, F.col("transect_idx").isNotNull() & F.col("epoch_idx").isNotNull()), "positive": (c, F.col("cents") > 20_000_000), "duplicate cells": (c.groupBy("transect_idx", "epoch_idx").agg(F.count("*").alias("m")), F.col("m") == 1),
        "epoch coverage": (c.groupBy("epoch_idx").agg(F.count("*").alias("m")), F.col("m") >= 38), "height range": (s, F.col("height").between(-0.1, 35.1)), "chronological": (e, F.col("before").isNull() | (F.col("before") < F.col("epoch_date"))),
        "duplicate events": (s.groupBy("event_id").agg(F.count("*").alias("m")), F.col("m") == 1), "extent": (k.points(spark, d), F.col("x").between(1, 90) & F.col("y").between(1, 49)),
    })


def _check(name, table, ok):
    return f"select '{name}' as \"check\", count(*) as n_checked, count(*) filter (not coalesce({ok}, false)) as n_failed, count(*) filter (not coalesce({ok}, false)) = 0 as passed from {table}"


QUALITY = f"with {k.CELLS}, {k.SLUMPS}, {k.EPOCHS}, {k.POINTS}, e as (select *, lag(epoch_date) over (order by epoch_idx) as b from epochs) " + " union all ".join([
    _check("keys", "cells", "transect_idx is not null and epoch_idx is not null"), _check("positive", "cells", "cents > 20000000"), _check("duplicate cells", "(select count(*) as m from cells group by transect_idx, epoch_idx)", "m = 1"),
    _check("epoch coverage", "(select count(*) as m from cells group by epoch_idx)", "m >= 38"), _check("height range", "slumps", "height between -0.1 and 35.1"), _check("chronological", "e", "(b is null or b < epoch_date)"),
    _check("duplicate events", "(select count(*) as m from slumps group by event_id)", "m = 1"), _check("extent", "points", "(x between 1 and 90 and y between 1 and 49)"),
])


def sample_weights(spark, d):
    x = k.slumps(spark, d).select("event_id", lab.volume_class(F.col("volume")).alias("c"), (F.col("height") > 20).alias("seen"))
    return _round(lookups.sample_weights(x, "event_id", "c", F.col("seen")), "weight", digits=9)


SAMPLE_WEIGHTS = f"with {k.SLUMPS}, x as (select event_id, height, case when volume < 10 then 0 when volume < 50 then 1 when volume < 200 then 2 else 3 end as c from slumps) select event_id, round(1.0::double / count(*) over (partition by c) * case when height > 20 then 1.5 else 1 end, 9) as weight from x"


def cube_with_cliffs(spark, d):
    """Cells with their cliffs beside them: processed toes before raw ones, and none where no cliff was found."""
    c = k.cells(spark, d)
    side = c.where("cents % 3 <> 0").select("transect_idx", "epoch_idx", (F.col("cents") % 5 > 0).alias("has_cliff"), (F.col("cents") % 100 / 10.0).alias("raw"), F.when(F.col("cents") % 2 == 0, F.col("cents") % 90 / 10.0).alias("processed"))
    x = c.select("transect_idx", "epoch_idx").join(side, ["transect_idx", "epoch_idx"], "left")
    return x.select("transect_idx", "epoch_idx", F.coalesce("has_cliff", F.lit(False)).alias("has_cliff"), F.when(F.col("has_cliff"), F.coalesce("processed", "raw")).alias("toe"))


CUBE_CLIFFS = f"with {k.CELLS} select transect_idx, epoch_idx, cents % 3 <> 0 and cents % 5 > 0 as has_cliff, case when cents % 3 <> 0 and cents % 5 > 0 then case when cents % 2 = 0 then cents % 90 / 10.0::double else cents % 100 / 10.0::double end end as toe from cells"


def cube_overview(spark, d):
    """Sizes, first and last survey, and the mean of the last one's values."""
    last = F.max_by("mean", "epoch_idx")
    by = k.cells(spark, d).groupBy("epoch_idx").agg(F.count("*").alias("n"), F.avg("cents").alias("mean"))
    return _round(by.agg(F.count("*").alias("n_epochs"), F.sum("n").alias("n_cells"), F.min("epoch_idx").alias("first"), F.max("epoch_idx").alias("last"), last.alias("latest_mean")), "latest_mean", digits=3)


CUBE_OVERVIEW = f"with {k.CELLS}, e as (select epoch_idx, count(*) as n, avg(cents) as m from cells group by 1) select count(*) as n_epochs, cast(sum(n) as bigint) as n_cells, min(epoch_idx) as first, max(epoch_idx) as last, round(arg_max(m, epoch_idx), 3) as latest_mean from e"


def cube_valid_ends(spark, d):
    """First and last survey with values of each transect, and those values."""
    x = k.cells(spark, d).withColumn("v", F.when(F.col("cents") % 3 != 0, F.col("cents"))).where("v is not null")
    return x.groupBy("transect_idx").agg(F.min("epoch_idx").alias("first"), F.min_by("v", "epoch_idx").alias("first_value"), F.max("epoch_idx").alias("last"), F.max_by("v", "epoch_idx").alias("last_value"), F.count("*").alias("n"))


VALID_ENDS = f"with {k.CELLS} select transect_idx, min(epoch_idx) as first, arg_min(cents, epoch_idx) as first_value, max(epoch_idx) as last, arg_max(cents, epoch_idx) as last_value, count(*) as n from cells where cents % 3 <> 0 group by 1"


def climate_density(spark, d):
    return _round(lookups.density(k.climate(spark, d), ["beach"], "temp_mean_c"), "density", digits=4)


CLIMATE_DENSITY = f"""with {k.CLIMATE}, l as (select min(temp_mean_c) as lo, (max(temp_mean_c) - min(temp_mean_c)) / 30 as w from climate), b as (select beach, cast(least(floor((temp_mean_c - lo) / w), 29) as integer) as bin, count(*) as n, any_value(w) as w from climate, l group by 1, 2)
select beach, bin, round(n / sum(n) over (partition by beach) / w, 4) as density from b"""


def transects_of_site(spark, d):
    """The transects of each number in order, and their labels."""
    x = k.probes(spark, d).groupBy("mop").agg(F.array_sort(F.collect_list("c_custkey")).alias("t"))  # of one site
    return x.select("mop", F.size("t").cast("long").alias("n"), F.array_join(F.transform("t", lambda v, i: F.concat(v.cast("string"), F.lit("/"), (i + 1).cast("string"))), ",").alias("transects"))


TRANSECTS_OF = f"with {k.PROBES}, x as (select *, row_number() over (partition by mop order by c_custkey) as r from probes) select mop, count(*) as n, string_agg(c_custkey || '/' || r, ',' order by r) as transects from x group by 1"


def surveys_listed(spark, d):
    """Surveys (first and last number) that overlap a range."""
    return k.probes(spark, d).withColumn("mop2", (F.col("mop") + F.col("c_custkey") % 20).cast("int")).where("mop2 >= 595 and mop <= 620")


SURVEYS = f"with {k.PROBES} select c_custkey, mop, cast(mop + c_custkey % 20 as integer) as mop2 from probes where mop + c_custkey % 20 >= 595 and mop <= 620"


def series_parsed(spark, d):
    """Values at times that can be read; the rest is left out."""
    o = k.read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))
    text = F.when(F.col("o_orderkey") % 5 == 0, "bad").when(F.col("o_orderkey") % 5 == 1, F.concat(F.substring("s", 1, 5), F.lit("13-01"))).otherwise(F.col("s"))
    return o.select("o_orderkey", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date").alias("date")).where("date is not null")


SERIES_PARSED = "select o_orderkey, cast(o_orderdate as date) as date from orders where o_orderkey % 5 > 1"


def points_unique(spark, d):
    """Points of overlapping searches once each: places equal to a millimetre are one."""
    p = k.points(spark, d).select(*[F.round(F.col(c) + TIE, 3).alias(c) for c in ("x", "y", "z")])
    return p.groupBy("x", "y", "z").agg(F.count("*").alias("n"))


POINTS_UNIQUE = f"with {k.POINTS} select round(x + 1e-7, 3) as x, round(y + 1e-7, 3) as y, round(z + 1e-7, 3) as z, count(*) as n from points group by 1, 2, 3"


def wave_aliases(spark, d):
    """Columns under whichever of their names a table has; one it lacks is null."""
    x = k.waves(spark, d).withColumnsRenamed({"hs": "waveHs", "tp": "Tp"})
    return lookups.with_aliases(x, {"event_id": ("event_id",), "hs": ("waveHs", "Hs", "hs"), "tp": ("waveTp", "Tp", "tp"), "dp": ("waveDp", "Dp", "dp"), "ta": ("waveTa", "Ta", "ta")})


WAVE_ALIASES = f"with {k.WAVES} select event_id, hs, tp, dp, null::double as ta from waves"


def transect_numbers(spark, d):
    """A transect's number from the dimension where it is there, else from its name."""
    c = F.col("c_custkey")
    x = k.read(spark, d, "customer").select("c_custkey", F.when(c % 5 > 0, F.format_string("MOP %d_%03d", c % 90, c % 10)).otherwise("none").alias("name"))
    known = k.probes(spark, d).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("mop")).alias("_mop"))
    return x.join(known, "c_custkey", "left").select("c_custkey", F.coalesce("_mop", lab.mop_base(F.col("name"))).alias("mop"))


TRANSECT_NUMBERS = "select c_custkey, cast(case when c_custkey % 3 = 0 then 500 + c_custkey % 300 when c_custkey % 5 > 0 then c_custkey % 90 end as integer) as mop from customer"


def cell_events(spark, d):
    e = k.slumps(spark, d).select("event_id", "transect_idx", (F.year("start_date") - 1995).alias("epoch_idx"), "volume")
    return lookups.events_or_queued(k.cells(spark, d), e, ["transect_idx", "epoch_idx"], "event_id", "volume")


CELL_EVENTS = f"""with {k.CELLS}, {k.SLUMPS}, e as (select event_id, transect_idx, cast(year(start_date) - 1995 as integer) as epoch_idx, volume from slumps),
r as (select *, row_number() over (partition by transect_idx, epoch_idx order by volume desc, event_id) as r from e)
select c.transect_idx, c.epoch_idx, coalesce(r.event_id, (select event_id from e order by volume desc, event_id limit 1)) as event_id, case when r.event_id is null then 'queue' else 'cell' end as source from cells c left join r on r.transect_idx = c.transect_idx and r.epoch_idx = c.epoch_idx and r.r = 1"""


def site_places(spark, d):
    """Each source's middle, and whether its places are projected or degrees."""
    x = k.points(spark, d).groupBy("las_source").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.bool_or((F.col("x") * 2 > 180) | (F.col("y") * 2 > 90)).alias("far"))
    return _round(x.select("las_source", (F.col("x") + TIE).alias("x"), (F.col("y") + TIE).alias("y"), F.when(F.col("far"), "projected").otherwise("degrees").alias("kind")), "x", "y", digits=4)


SITE_PLACES = f"with {k.POINTS} select las_source, round(avg(x) + 1e-7, 4) as x, round(avg(y) + 1e-7, 4) as y, case when bool_or(x * 2 > 180 or y * 2 > 90) then 'projected' else 'degrees' end as kind from points group by 1"

QUERIES = {
    "profile_value_at": (profile_value_at, VALUE_AT), "profile_pair_change": (profile_pair_change, PAIR_CHANGE), "profile_value_range": (profile_value_range, VALUE_RANGE), "voxels_padded": (voxels_padded, VOXELS_PADDED), "voxels_metadata": (voxels_metadata, VOXELS_METADATA),
    "names_variants": (names_variants, NAMES_VARIANTS), "alongshore_sites": (alongshore_sites, ALONGSHORE), "site_geometry": (site_geometry, SITE_GEOMETRY), "files_near_lines": (files_near_lines, FILES_NEAR), "lines_in_extent": (lines_in_extent, LINES_IN),
    "wave_derived": (wave_derived, WAVE_DERIVED), "wave_daily_display": (wave_daily_display, WAVE_DAILY), "wave_availability": (wave_availability, AVAILABILITY), "epoch_gaps": (epoch_gaps, EPOCH_GAPS), "beach_coverage": (beach_coverage, BEACH_COVERAGE),
    "beach_half_open": (beach_half_open, HALF_OPEN), "quality_report": (quality_report, QUALITY), "sample_weights": (sample_weights, SAMPLE_WEIGHTS), "cube_with_cliffs": (cube_with_cliffs, CUBE_CLIFFS), "cube_overview": (cube_overview, CUBE_OVERVIEW),
    "cube_valid_ends": (cube_valid_ends, VALID_ENDS), "climate_density": (climate_density, CLIMATE_DENSITY), "transects_of_site": (transects_of_site, TRANSECTS_OF), "surveys_listed": (surveys_listed, SURVEYS), "series_parsed": (series_parsed, SERIES_PARSED),
    "points_unique": (points_unique, POINTS_UNIQUE), "wave_aliases": (wave_aliases, WAVE_ALIASES), "transect_numbers": (transect_numbers, TRANSECT_NUMBERS), "cell_events": (cell_events, CELL_EVENTS), "site_places": (site_places, SITE_PLACES),
}
