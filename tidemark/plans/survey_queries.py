"""Queries on surveys: ranges and joins, profiles, the cube, events, labels, quality; each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as lab
from ..operators import cube, history, joins, profile, samples, selection, stats
from . import carriers as k
from .wave_queries import _round

# ---- lookups in the beach ranges


def beach_first_match(spark, d):
    return joins.first_match(k.probes(spark, d), k.beaches(spark), ["c_custkey"], "mop", "mop_lo", "mop_hi", "beach_order", ["beach"], 50, {"beach": "Unknown"})


BEACH_FIRST = f"with {k.PROBES}, {k.BEACH_ROWS} select c_custkey, mop, coalesce((select arg_min(beach, beach_order) from beaches b where mop between mop_lo and mop_hi), 'Unknown') as beach from probes"


def beach_nearest(spark, d):
    return joins.nearest_range(k.probes(spark, d), k.beaches(spark), ["c_custkey"], "mop", "mop_lo", "mop_hi", "beach_order", ["beach"])


BEACH_NEAREST = f"""with {k.PROBES}, {k.BEACH_ROWS}, x as (select *, row_number() over (partition by c_custkey order by greatest(mop_lo - mop, mop - mop_hi, 0), beach_order) as r from probes, beaches)
select c_custkey, mop, beach from x where r = 1"""


def beach_counts(spark, d):
    """Overlapping ranges count twice."""
    return joins.band_join(k.probes(spark, d), k.beaches(spark), "mop", "mop_lo", "mop_hi", 50).groupBy("beach").agg(F.count("*").alias("n"), F.min("mop").alias("first_mop"), F.max("mop").alias("last_mop"))


BEACH_COUNTS = f"with {k.PROBES}, {k.BEACH_ROWS} select beach, count(*) as n, min(mop) as first_mop, max(mop) as last_mop from probes join beaches on mop between mop_lo and mop_hi group by 1"


def study_area(spark, d):
    inside = joins.band_join(k.probes(spark, d), k.beaches(spark), "mop", "mop_lo", "mop_hi", 50).select("c_custkey").distinct()
    return k.probes(spark, d).join(inside, "c_custkey", "left_semi")


STUDY_AREA = f"with {k.PROBES}, {k.BEACH_ROWS} select * from probes where exists (select 1 from beaches where mop between mop_lo and mop_hi)"


# ---- events and epochs


def event_bracket(spark, d):
    return joins.bracket(k.slumps(spark, d).select("event_id", "start_date", "end_date"), k.epochs(spark, d), "start_date", "end_date", "epoch_date", "epoch_idx")


EVENT_BRACKET = f"""with {k.SLUMPS}, {k.EPOCHS}, x as (select event_id, start_date, end_date, (select max(epoch_idx) from epochs where epoch_date <= start_date) as epoch_before, (select min(epoch_idx) from epochs where epoch_date >= end_date) as epoch_after from slumps)
select * from x where epoch_before < epoch_after"""


def event_asof_wave(spark, d):
    """The last high wave at the site before each event; every event is a probe."""
    w = k.waves(spark, d)
    probe = w.select(F.col("event_id").alias("probe"), "mop_id", F.col("ts").alias("at"))
    return joins.asof_join(probe, w.where("hs >= 20"), ["mop_id"], "at", "ts", ["ts", "hs"], strict=True)


EVENT_ASOF = f"with {k.WAVES}, h as (select * from waves where hs >= 20) select w.event_id as probe, w.mop_id, w.ts as at, h.ts, h.hs from waves w asof left join h on w.mop_id = h.mop_id and w.ts > h.ts"


def event_forward_wave(spark, d):
    w = k.waves(spark, d)
    probe = w.select(F.col("event_id").alias("probe"), "mop_id", F.col("ts").alias("at"))
    return joins.asof_join(probe, w.where("hs >= 20"), ["mop_id"], "at", "ts", ["ts", "hs"], direction="forward")


EVENT_FORWARD = EVENT_ASOF.replace("w.ts > h.ts", "w.ts <= h.ts")


def event_overlap(spark, d):
    """Slumps whose time spans overlap on one transect."""
    days = lambda c: F.datediff(F.col(c), F.lit("1995-01-01").cast("date"))
    s = k.slumps(spark, d).select("event_id", "transect_idx", days("start_date").alias("lo"), days("end_date").alias("hi"))
    return joins.overlapping_pairs(s, "event_id", "lo", "hi", 8, ["transect_idx"])


EVENT_OVERLAP = f"with {k.SLUMPS}, s as (select * from slumps) select x.event_id as a, y.event_id as b, x.transect_idx from s x join s y on x.transect_idx = y.transect_idx and x.event_id < y.event_id and x.start_date <= y.end_date and y.start_date <= x.end_date"


def event_nearest_transect(spark, d):
    left = k.probes(spark, d).select("c_custkey", (F.col("mop") + (F.col("c_custkey") % 17) / 20.0).alias("mop_at"))
    right = spark.range(500, 800).select((F.col("id") - 500).cast("int").alias("idx"), F.col("id").cast("double").alias("mop_of"))
    return joins.nearest_within(left, right, ["c_custkey"], "mop_at", "mop_of", ["idx"], 0.15).select("c_custkey", "idx")


EVENT_NEAREST = f"""with {k.PROBES}, l as (select c_custkey, mop + (c_custkey % 17) / 20.0::double as at_mop from probes), r as (select cast(i - 500 as integer) as idx, i::double as mop_of from range(500, 800) t(i))
select l.c_custkey, (select arg_min(idx, abs(at_mop - mop_of) * 1000000 + idx / 1000000.0) from r where at_mop >= mop_of - 0.15::double and at_mop <= mop_of + 0.15::double) as idx from l"""


def event_cells(spark, d):
    b = joins.bracket(k.slumps(spark, d), k.epochs(spark, d), "start_date", "end_date", "epoch_date", "epoch_idx")
    return _round(samples.aggregate_events(b, ["transect_idx", "epoch_before", "epoch_after"]), "volume", "vol_unc", "elevation")


EVENT_CELLS = f"""with {k.SLUMPS}, {k.EPOCHS}, x as (select *, (select max(epoch_idx) from epochs where epoch_date <= start_date) as epoch_before, (select min(epoch_idx) from epochs where epoch_date >= end_date) as epoch_after from slumps)
select transect_idx, epoch_before, epoch_after, round(sum(volume), 6) as volume, round(sqrt(sum(vol_unc * vol_unc)), 6) as vol_unc, round(avg(elevation), 6) as elevation, sum(width) as width, max(height) as height, count(*) as n_events,
 case when sum(volume) < 10 then 0 when sum(volume) < 50 then 1 when sum(volume) < 200 then 2 else 3 end as event_class from x where epoch_before < epoch_after group by 1, 2, 3"""


def event_risk(spark, d):
    return _round(k.slumps(spark, d).select("event_id", lab.volume_class(F.col("volume")).alias("event_class"), lab.risk_index(F.col("volume"), F.col("height")).alias("risk")), "risk")


EVENT_RISK = f"""with {k.SLUMPS} select event_id, case when volume < 10 then 0 when volume < 50 then 1 when volume < 200 then 2 else 3 end as event_class,
 round(1 / (1 + exp(-0.5 * (ln(1 + volume) * least(greatest(1 + 0.05 * (height - 15), 0.5), 2) - 4))), 6) as risk from slumps"""


def event_queue(spark, d):
    return samples.queue(k.slumps(spark, d), ["transect_idx", "start_date"], 2000).select("event_id", "transect_idx", "volume", "position")


EVENT_QUEUE = f"""with {k.SLUMPS}, b as (select *, row_number() over (partition by transect_idx, start_date order by volume desc, event_id) as r from slumps), t as (select * from b where r = 1 order by volume desc, event_id limit 2000)
select event_id, transect_idx, volume, cast(row_number() over (order by volume desc, event_id) as integer) as position from t"""


def event_softmax_risk(spark, d):
    x = k.slumps(spark, d).select("event_id", F.array(F.lit(0.0), F.col("height") / 10, F.col("width") / 5, F.col("elevation") / 8, F.col("vol_unc") / 4).alias("logits"))
    return _round(x.select("event_id", lab.risk_score(F.col("logits")).alias("score")), "score")


EVENT_SOFTMAX = f"with {k.SLUMPS}, x as (select event_id, 1.0::double as a, exp(height / 10) as b, exp(width / 5) as c, exp(elevation / 8) as d, exp(vol_unc / 4) as e from slumps) select event_id, round((0.1 * b + 0.4 * c + 0.6 * d + e) / (a + b + c + d + e), 6) as score from x"


# ---- points and profiles


def points_bbox(spark, d):
    return k.points(spark, d).where("x between 20 and 60 and y between 10 and 30").groupBy("las_source").agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


POINTS_BBOX = f"with {k.POINTS} select las_source, count(*) as n, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max from points where x between 20 and 60 and y between 10 and 30 group by 1"


def points_normalised(spark, d):
    x = k.points(spark, d)
    top = x.groupBy("las_source").agg(F.max("intensity").alias("top"))
    n = x.join(top, "las_source").select("las_source", (F.col("intensity") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("v"))
    return _round(n.groupBy("las_source").agg(F.avg("v").alias("mean"), F.count("*").alias("n")), "mean")


POINTS_NORMALISED = f"with {k.POINTS}, x as (select las_source, intensity, max(intensity) over (partition by las_source) as top from points) select las_source, round(avg(intensity / case when top > 0 then top else 1 end), 6) as mean, count(*) as n from x group by 1"


def _lines(spark):
    return spark.createDataFrame([(i, 0.0, 5.0 + 4 * i, 100.0, 8.0 + 4 * i) for i in range(10)], "tr_id int, x0 double, y0 double, x1 double, y1 double")


def points_corridor(spark, d):
    return _round(joins.corridor_join(k.points(spark, d), _lines(spark), 1.5, 4.0).groupBy("tr_id").agg(F.count("*").alias("n"), F.avg("along").alias("along"), F.max("across").alias("across")), "along", "across")


POINTS_CORRIDOR = f"""with {k.POINTS}, l as (select i::integer as tr_id, 0.0::double as x0, 5.0::double + 4 * i as y0, 100.0::double as x1, 8.0::double + 4 * i as y1 from range(0, 10) t(i)),
u as (select *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as len from l), w as (select *, (x1 - x0) / (len + 1e-8) as dx, (y1 - y0) / (len + 1e-8) as dy from u),
c as (select tr_id, len, (x - x0) * dx + (y - y0) * dy as along, abs((x - x0) * dy - (y - y0) * dx) as across from points, w)
select tr_id, count(*) as n, round(avg(along), 6) as along, round(max(across), 6) as across from c where along between 0 and len and across <= 1.5 group by 1"""


def points_azimuth(spark, d):
    x = k.points(spark, d).groupBy("las_source").agg((F.max("x") - F.min("x")).alias("dx"), (F.avg("y") - 25).alias("dy"), F.covar_samp("x", "y").alias("c"), (F.var_samp("x") - F.var_samp("y")).alias("v"))
    return _round(x.select("las_source", g.azimuth(F.col("dx"), F.col("dy")).alias("azimuth"), F.degrees(0.5 * F.atan2(2 * F.col("c"), F.col("v"))).alias("axis")), "azimuth", "axis", digits=4)


POINTS_AZIMUTH = f"""with {k.POINTS}, x as (select las_source, max(x) - min(x) as dx, avg(y) - 25 as dy, covar_samp(x, y) as c, var_samp(x) - var_samp(y) as v from points group by 1)
select las_source, round(case when atan2(dx, dy) < 0 then degrees(atan2(dx, dy)) + 360 else degrees(atan2(dx, dy)) end, 4) as azimuth, round(degrees(0.5 * atan2(2 * c, v)), 4) as axis from x"""


def points_dominant_class(spark, d):
    return profile.dominant(k.points(spark, d), ["las_source"], "classification")


POINTS_DOMINANT = f"with {k.POINTS}, c as (select las_source, classification, count(*) as n from points group by 1, 2), r as (select *, row_number() over (partition by las_source order by n desc, classification) as r from c) select las_source, classification as dominant, n from r where r = 1"


def points_voxels(spark, d):
    p = k.points(spark, d).select("las_source", F.col("x").alias("distance"), F.col("z").alias("elevation"))
    return _round(profile.voxel_bins(p, ["las_source"], 1.0).select("las_source", "bin", "n", "mean", "std", "range", "valid"), "mean", "std", "range")


POINTS_VOXELS = f"""with {k.POINTS}, a as (select las_source, x, z, min(x) over w as lo, max(x) over w as hi from points window w as (partition by las_source)),
b as (select *, cast(least(greatest(floor((hi - lo) / 1.0), 1), 128) as integer) as nb from a), c as (select *, cast(least(floor((x - lo) / greatest((hi - lo) / nb, 1e-8)), nb - 1) as integer) as bin from b)
select las_source, bin, count(*) as n, round(case when count(*) >= 3 then avg(z) else 0 end, 6) as mean, round(case when count(*) >= 3 then stddev_pop(z) else 0 end, 6) as std, round(case when count(*) >= 3 then max(z) - min(z) else 0 end, 6) as range, count(*) >= 3 as valid from c group by 1, 2"""


def profile_shape(spark, d):
    p = profile.smooth(k.profiles(spark, d), ["transect"])
    p = profile.roughness(profile.slope_and_curvature(p, ["transect"]), ["transect"])
    return _round(p.select("transect", "i", "smoothed", "slope", "curvature", "roughness"), "smoothed", "slope", "curvature", "roughness", digits=4)


PROFILE_SHAPE = f"""with {k.PROFILES}, o as (select *, count(*) over (partition by transect) as n, row_number() over (partition by transect order by i) as r, avg(elevation) over (partition by transect order by i rows between 2 preceding and 2 following) as m,
  var_pop(elevation) over (partition by transect order by i rows between 2 preceding and 2 following) as vz, var_pop(distance) over (partition by transect order by i rows between 2 preceding and 2 following) as vd,
  covar_pop(distance, elevation) over (partition by transect order by i rows between 2 preceding and 2 following) as cv, (max(distance) over (partition by transect) - min(distance) over (partition by transect)) as span from profiles),
s as (select *, case when r > 2 and r <= n - 2 then m else elevation end as z, greatest(span / greatest(n - 1, 1), 0.01) as dx from o),
q as (select *, lag(z) over (partition by transect order by i) as p, lead(z) over (partition by transect order by i) as q from s),
t as (select *, case when p is null then (q - z) / dx when q is null then (z - p) / dx else (q - p) / (2 * dx) end as gr, (q - 2 * z + p) / (dx * dx) as sec from q),
u as (select *, sec / pow(1 + gr * gr, 1.5) as c from t)
select transect, i, round(z, 4) as smoothed, round(degrees(atan(gr)), 4) as slope, round(least(greatest(coalesce(c, case when p is null then lead(c) over (partition by transect order by i) else lag(c) over (partition by transect order by i) end, 0), -10), 10), 4) as curvature,
 round(sqrt(greatest(vz - case when vd > 0 then cv * cv / vd else 0 end, 0)), 4) as roughness from u"""


def profile_summary(spark, d):
    p = profile.slope_and_curvature(k.profiles(spark, d), ["transect"], z="elevation")
    return _round(profile.summary(p, ["transect"]), "height", "mean_slope", "max_slope", "first_elevation", "last_elevation")


PROFILE_SUMMARY = f"""with {k.PROFILES}, q as (select *, lag(elevation) over w as p, lead(elevation) over w as q from profiles window w as (partition by transect order by i)),
t as (select *, degrees(atan(case when p is null then (q - elevation) / 0.5 when q is null then (elevation - p) / 0.5 else q - p end)) as slope from q)
select transect, round(max(elevation) - min(elevation), 6) as height, round(avg(abs(slope)), 6) as mean_slope, round(max(abs(slope)), 6) as max_slope, round(arg_min(elevation, i), 6) as first_elevation, round(arg_max(elevation, i), 6) as last_elevation, count(*) as n_points from t group by 1"""


def profile_cliff_features(spark, d):
    p = profile.cliff_features(k.profiles(spark, d), ["transect"])
    names = ["distance_norm", "elevation_norm", "gradient", "second_gradient", "seaward_slope", "landward_slope", "trend_deviation", "slope_change", "low_zone", "shore_proximity", "max_local_gradient"]
    return _round(p.select("transect", "i", *names), *names, digits=4)


PROFILE_CLIFF = f"""with {k.PROFILES}, a as (select *, distance / 31.5 as dn_, (elevation - min(elevation) over v) / (max(elevation) over v - min(elevation) over v + 1e-8) as elevation_norm, (distance - min(distance) over v) / (max(distance) over v - min(distance) over v + 1e-8) as distance_norm,
  case when lag(elevation) over w is null then (lead(elevation) over w - elevation) / 0.5 when lead(elevation) over w is null then (elevation - lag(elevation) over w) / 0.5 else lead(elevation) over w - lag(elevation) over w end as g1,
  first(elevation) over (partition by transect order by i rows between unbounded preceding and unbounded following) as z0, last(elevation) over (partition by transect order by i rows between unbounded preceding and unbounded following) as z1,
  degrees(atan((last(elevation) over sea - first(elevation) over sea) / nullif(last(distance) over sea - first(distance) over sea, 0))) / 90 as sea, degrees(atan((last(elevation) over land - first(elevation) over land) / nullif(last(distance) over land - first(distance) over land, 0))) / 90 as land
  from profiles window v as (partition by transect), w as (partition by transect order by i), sea as (partition by transect order by i rows between 20 preceding and 1 preceding), land as (partition by transect order by i rows between current row and 19 following)),
b as (select *, case when lag(g1) over w is null then (lead(g1) over w - g1) / 0.5 when lead(g1) over w is null then (g1 - lag(g1) over w) / 0.5 else lead(g1) over w - lag(g1) over w end as g2 from a window w as (partition by transect order by i)),
c as (select *, g1 / (stddev_pop(g1) over v + 1e-8) as gr, g2 / (stddev_pop(g2) over v + 1e-8) as gr2, greatest(coalesce(sea, 0), 0) as ss, greatest(coalesce(land, 0), 0) as ls from b window v as (partition by transect)),
e as (select *, max(abs(gr)) over (partition by transect order by i rows between 2 preceding and 2 following) as m from c)
select transect, i, round(distance_norm, 4) as distance_norm, round(elevation_norm, 4) as elevation_norm, round(gr, 4) as gradient, round(gr2, 4) as second_gradient, round(ss, 4) as seaward_slope, round(ls, 4) as landward_slope, round(elevation - (z0 + (z1 - z0) * distance_norm), 4) as trend_deviation,
 round(ls - ss, 4) as slope_change, case when elevation < 15 then 1.0::double else 0.0::double end as low_zone, round(exp(-5 * distance_norm), 4) as shore_proximity, round((m - min(m) over (partition by transect)) / (max(m) over (partition by transect) - min(m) over (partition by transect) + 1e-8), 4) as max_local_gradient from e"""


def profile_regrid(spark, d):
    p = k.profiles(spark, d)
    return _round(profile.regrid(p, ["transect"], 40, ["elevation"]), "distance", "elevation", digits=5)


PROFILE_REGRID = f"""with {k.PROFILES}, e as (select transect, list(elevation order by i) as z from profiles group by 1), t as (select transect, z, j::integer as i, 31.5::double * j / 39 as distance from e, range(0, 40) r(j))
select transect, i, round(distance, 5) as distance, round(z[floor(distance / 0.5)::integer + 1] + coalesce((z[least(floor(distance / 0.5)::integer + 2, 64)] - z[floor(distance / 0.5)::integer + 1]) * (distance / 0.5 - floor(distance / 0.5)), 0), 5) as elevation from t"""


def profile_class_counts(spark, d):
    return k.profiles(spark, d).select("transect", "label").distinct().groupBy("label").agg(F.count("*").alias("n"))


PROFILE_CLASSES = f"with {k.PROFILES} select label, count(distinct transect) as n from profiles group by 1"


# ---- the cube


def cube_coverage(spark, d):
    return cube.coverage(k.cells(spark, d), 50, 7)


CUBE_COVERAGE = f"""with {k.CELLS} select case grouping(epoch_idx, transect_idx) when 1 then 'epoch' when 2 then 'transect' else 'all' end as level, coalesce(epoch_idx, transect_idx) as idx, count(*) as present,
 case grouping(epoch_idx, transect_idx) when 1 then 50 when 2 then 7 else 350 end - count(*) as missing, round(100.0::double * count(*) / case grouping(epoch_idx, transect_idx) when 1 then 50 when 2 then 7 else 350 end, 6) as pct,
 count(*) = case grouping(epoch_idx, transect_idx) when 1 then 50 when 2 then 7 else 350 end as is_full from cells group by grouping sets ((epoch_idx), (transect_idx), ())"""


def cube_dense(spark, d):
    t = spark.range(50).select(F.col("id").cast("int").alias("transect_idx"))
    e = spark.range(7).select(F.col("id").cast("int").alias("epoch_idx"))
    return cube.dense(k.cells(spark, d).select("transect_idx", "epoch_idx", "cents"), t, e)


CUBE_DENSE = f"with {k.CELLS} select t::integer as transect_idx, e::integer as epoch_idx, cents, cents is not null as present from range(0, 50) a(t) cross join range(0, 7) b(e) left join cells on transect_idx = t and epoch_idx = e"


def cube_low_coverage(spark, d):
    return cube.low_coverage(k.cells(spark, d), 40)


CUBE_LOW = f"with {k.CELLS} select epoch_idx, count(*) as n_cells from cells group by 1 having count(*) < 40"


def cube_pairs(spark, d):
    return cube.successive_pairs(k.cells(spark, d), ["transect_idx"])


CUBE_PAIRS = f"with {k.CELLS}, x as (select transect_idx, epoch_idx as epoch_before, lead(epoch_idx) over (partition by transect_idx order by epoch_idx) as epoch_after from cells) select * from x where epoch_after is not null"


def cube_context(spark, d):
    x = samples.context(k.cells(spark, d).withColumn("v", F.col("cents")), ["transect_idx"], "epoch_idx", "v", most=4, least=2)
    return x.select("transect_idx", "epoch_idx", "n_context", F.array_join(F.transform("context", lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",").alias("context"))


CUBE_CONTEXT = f"""with {k.CELLS}, x as (select transect_idx, epoch_idx, list(cents) over (partition by transect_idx order by epoch_idx rows between 4 preceding and 1 preceding) as c from cells)
select transect_idx, epoch_idx, len(c)::integer as n_context, array_to_string(list_concat(list_transform(range(0, 4 - len(c)), lambda i: '-'), list_transform(c, lambda v: v::varchar)), ',') as context from x where len(c) >= 2"""


def cube_change(spark, d):
    """Differences between profiles of two labels' first transects, point by point."""
    p = k.profiles(spark, d).withColumn("epoch_idx", (F.col("transect") % 2).cast("int")).withColumn("pair", F.floor(F.col("transect") / 2))
    return _round(cube.change(p, ["pair"], 0, 1), "mean", "max", "min", "std", "gain", "loss")


CUBE_CHANGE = f"""with {k.PROFILES}, x as (select cast(floor(a.transect / 2) as bigint) as pair, b.elevation - a.elevation as v from profiles a join profiles b on b.transect = a.transect + 1 and a.i = b.i where a.transect % 2 = 0)
select pair, round(avg(v), 6) as mean, round(max(v), 6) as max, round(min(v), 6) as min, round(stddev_pop(v), 6) as std, round(sum(case when v >= 0 then v else 0 end), 6) as gain, round(sum(case when v < 0 then v else 0 end), 6) as loss from x group by 1"""


def cube_window_choice(spark, d):
    c = k.cells(spark, d).select("transect_idx", "epoch_idx", (F.col("cents") % 40).cast("double").alias("toe"), (F.col("cents") % 61).cast("double").alias("top"))
    ref = cube.reference_cell(c, ["transect_idx"], "toe", "top")
    return cube.window_choice(c, ref, ["transect_idx"], "toe", "top", (10.0, 60.0)).select("transect_idx", "epoch_idx", "window", "lo", "hi")


CUBE_WINDOW = f"""with {k.CELLS}, c as (select transect_idx, epoch_idx, (cents % 40)::double as toe, (cents % 61)::double as top from cells),
r as (select transect_idx, arg_min(toe, epoch_idx) as rt, arg_min(top, epoch_idx) as rp from c where top - toe >= 5 group by 1)
select c.transect_idx, epoch_idx, case when rt is not null then 'reference' when top - toe >= 5 then 'own' else 'fallback' end as window, case when rt is not null then rt when top - toe >= 5 then toe else 10 end as lo, case when rt is not null then rp when top - toe >= 5 then top else 60 end as hi from c left join r on c.transect_idx = r.transect_idx"""


def cube_labels(spark, d):
    """Every covered cell with the slumps that end at it."""
    c = k.cells(spark, d)
    e = history.events_by_cell(history.align_events(k.slumps(spark, d), k.years(spark, d), c))
    x = samples.label_cells(c.select("transect_idx", "epoch_idx", (F.col("cents") % 4000 / 100.0).alias("cliff")), e, "cliff").drop("cliff")
    return _round(x.withColumn("collapse", F.array_join(F.col("collapse").cast("array<string>"), "")), "volume", "risk")


CUBE_LABELS = f"""with {k.CELLS}, {k.SLUMPS}, {k.YEARS}, {k.ALIGNED},
x as (select c.transect_idx, c.epoch_idx, coalesce(e.v, 0) as volume, coalesce(e.c, 0) as event_class, coalesce(lag(c.cents % 4000 / 100.0::double) over (partition by c.transect_idx order by c.epoch_idx), 15) as height from cells c left join by_cell e on c.transect_idx = e.transect_idx and c.epoch_idx = e.epoch_idx)
select transect_idx, epoch_idx, round(volume, 6) as volume, event_class, height, round(1 / (1 + exp(-0.5 * (ln(1 + volume) * least(greatest(1 + 0.05 * (height - 15), 0.5), 2) - 4))), 6) as risk, case when volume >= 10 then '1111' else '0000' end as collapse from x"""


# ---- identifiers, labels, quality, sets


def names_parsed(spark, d):
    c = k.read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.format_string("MOP %d_%03d", 500 + F.col("c_custkey") % 90, F.col("c_custkey") % 10)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("mop"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 4 == 2, F.col("c_custkey").cast("string")).otherwise("none").alias("name"))
    n = F.col("name")
    return c.select("c_custkey", lab.mop_number(n).alias("first_number"), lab.mop_after_prefix(n).alias("mop"), F.round(lab.mop_with_tenth(n), 4).alias("mop_tenth"))


NAMES_PARSED = """with c as (select c_custkey, case when c_custkey % 4 = 0 then 'MOP ' || (500 + c_custkey % 90) || '_00' || (c_custkey % 10) when c_custkey % 4 = 1 then 'mop' || c_custkey when c_custkey % 4 = 2 then c_custkey::varchar else 'none' end as name from customer)
select c_custkey, try_cast(nullif(regexp_extract(name, '([0-9]+)', 1), '') as integer) as first_number, cast(case when c_custkey % 4 = 0 then 500 + c_custkey % 90 when c_custkey % 4 = 3 then null else c_custkey end as integer) as mop,
 round(case when c_custkey % 4 = 0 then 500 + c_custkey % 90 + (c_custkey % 10) / 10.0::double when c_custkey % 4 = 3 then null else c_custkey end, 4) as mop_tenth from c"""


def names_dated(spark, d):
    o = k.read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("s"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("t"))
    n = F.when(F.col("o_orderkey") % 3 == 0, F.concat("s", F.lit("_scan.las"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("scan_"), "t", F.lit(".las"))).otherwise(F.concat(F.lit("99999999_"), "s"))
    date = lab.name_date(n)
    return o.select("o_orderkey", date.alias("date"), lab.ordinal(date).alias("ordinal"))


NAMES_DATED = "select o_orderkey, case when o_orderkey % 3 = 2 then null else cast(o_orderdate as date) end as date, case when o_orderkey % 3 = 2 then null else cast(cast(o_orderdate as date) - date '0001-01-01' + 1 as integer) end as ordinal from orders"


def label_progress(spark, d):
    x = k.read(spark, d, "documents").select("doc_id", "source").join(k.read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return cube.label_progress(x, ["source"], "quality")


LABEL_PROGRESS = "select source, count(*) as total, count(quality) as labeled, round(100.0::double * count(quality) / count(*), 6) as pct from documents d left join labels l on d.doc_id = l.doc_id group by 1"


def class_weights(spark, d):
    return stats.class_weights(k.slumps(spark, d).select(lab.volume_class(F.col("volume")).alias("c")), "c", 5)


CLASS_WEIGHTS = f"""with {k.SLUMPS}, c as (select case when volume < 10 then 0 when volume < 50 then 1 when volume < 200 then 2 else 3 end as c, count(*) as n from slumps group by 1), x as (select i::integer as class, coalesce(n, 0) as n, 1.0::double / greatest(coalesce(n, 0), 1) as v from range(0, 5) t(i) left join c on c = i)
select class, n, round(v * 5 / sum(v) over (), 6) as weight from x"""


def accuracy_by_class(spark, d):
    x = k.slumps(spark, d).select(lab.volume_class(F.col("volume")).alias("truth"), lab.volume_class(F.col("volume") + F.col("height") - 20).alias("guess"))
    return stats.classification_metrics(x, "truth", "guess")


ACCURACY = f"""with {k.SLUMPS}, x as (select case when volume < 10 then 0 when volume < 50 then 1 when volume < 200 then 2 else 3 end as t, case when volume + height - 20 < 10 then 0 when volume + height - 20 < 50 then 1 when volume + height - 20 < 200 then 2 else 3 end as g from slumps)
select cast(coalesce(t, -1) as integer) as class, round(avg(case when t = g then 1.0::double else 0 end), 6) as accuracy, count(*) as n from x group by grouping sets ((t), ())"""


def range_rules(spark, d):
    return stats.range_violations(k.points(spark, d).select("x", "y", "z"), [("x", 1.0, 90.0), ("y", 2.0, 49.0), ("z", 0.01, 0.09)])


RANGE_RULES = f"with {k.POINTS} " + " union all ".join(f"select '{f}' as feature, count(*) filter ({f} < {a}::double) as n_below, count(*) filter ({f} > {b}::double) as n_above, count(*) filter ({f} is null) as n_null from points" for f, a, b in (("x", 1.0, 90.0), ("y", 2.0, 49.0), ("z", 0.01, 0.09)))


def monotonic_rule(spark, d):
    return stats.not_monotonic(k.profiles(spark, d), ["transect"], "i", "elevation")


MONOTONIC = f"with {k.PROFILES}, x as (select transect, elevation - lag(elevation) over (partition by transect order by i) as s from profiles) select transect, count(*) filter (s < -0.001) as n_falls from x group by 1 having count(*) filter (s < -0.001) > 0"


def duplicate_rule(spark, d):
    return stats.duplicates(k.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATE = "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1"


def last_row_wins(spark, d):
    x = k.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey").agg(F.max("l_quantity").alias("q"))
    return joins.keep_last(x, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"])


LAST_ROW = "with x as (select l_orderkey, l_linenumber, l_shipdate, l_partkey, max(l_quantity) as q from lineitem group by all), r as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc) as r from x) select l_orderkey, l_linenumber, l_shipdate, l_partkey, q from r where r = 1"


def uncovered_events(spark, d):
    return k.slumps(spark, d).select("event_id", "transect_idx", (F.year("start_date") - 1995).alias("epoch_idx")).join(k.cells(spark, d), ["transect_idx", "epoch_idx"], "left_anti")


UNCOVERED = f"with {k.CELLS}, {k.SLUMPS} select event_id, s.transect_idx, cast(year(start_date) - 1995 as integer) as epoch_idx from slumps s where not exists (select 1 from cells c where c.transect_idx = s.transect_idx and c.epoch_idx = year(start_date) - 1995)"


def split_by_date(spark, d):
    return samples.chronological_split(k.slumps(spark, d).select("event_id", "start_date"), "start_date", "event_id")


SPLIT = f"""with {k.SLUMPS}, s as (select event_id, start_date, row_number() over (order by start_date, event_id) as r, count(*) over () as n from slumps)
select event_id, start_date, case when r <= floor(n * 0.7::double) then 'train' when r <= floor(n * 0.7::double) + floor(n * 0.15::double) then 'validation' else 'test' end as split from s"""


def pick_representatives(spark, d):
    x = k.slumps(spark, d).select("event_id", "transect_idx", "volume")
    return selection.representatives(x, ["transect_idx"], "volume", "event_id", 5)


PICK_REPRESENTATIVES = f"""with {k.SLUMPS}, x as (select event_id, transect_idx, volume, row_number() over (partition by transect_idx order by volume, event_id) - 1 as r, greatest(floor(count(*) over (partition by transect_idx) / 5), 1)::bigint as step from slumps)
select event_id, transect_idx, volume from x where (r - step // 2 + step) % step = 0 and r // step < 5"""


def pick_middle(spark, d):
    return selection.middle(k.slumps(spark, d).select("event_id", "transect_idx", "volume"), ["transect_idx"], "volume", "event_id")


PICK_MIDDLE = f"""with {k.SLUMPS}, m as (select transect_idx, (min(volume) + max(volume)) / 2 as mid from slumps group by 1), r as (select s.transect_idx, event_id, volume, row_number() over (partition by s.transect_idx order by abs(volume - mid), event_id) as r from slumps s join m on s.transect_idx = m.transect_idx)
select transect_idx, event_id, volume from r where r = 1"""


def grid_lookup(spark, d):
    p = k.points(spark, d).groupBy("las_source").agg(F.max("x").alias("x"), F.min("y").alias("y"))
    grid = spark.range(100).select((F.col("id") % 10).cast("int").alias("row"), F.floor(F.col("id") / 10).cast("int").alias("col"), F.when(F.col("id") % 7 == 0, -9999.0).otherwise(F.col("id").cast("double")).alias("value"))
    return selection.grid_values(p, grid, 0.0, 50.0, 12.0, -9999.0)


GRID_LOOKUP = f"""with {k.POINTS}, p as (select las_source, max(x) as x, min(y) as y from points group by 1), q as (select *, cast(floor((50 - y) / 12.0) as integer) as row, cast(floor(x / 12.0) as integer) as col from p),
g as (select cast(i % 10 as integer) as row, cast(i // 10 as integer) as col, case when i % 7 = 0 then null else i::double end as value from range(0, 100) t(i)) select q.row, q.col, las_source, x, y, g.value from q left join g on q.row = g.row and q.col = g.col"""


def site_labels(spark, d):
    return selection.candidate_labels(k.probes(spark, d).select("mop").distinct(), "mop")


SITE_LABELS = f"with {k.PROBES}, m as (select distinct mop from probes) select mop, unnest(['D' || mop, 'D' || lpad(mop::varchar, 4, '0'), 'D' || lpad(mop::varchar, 5, '0')]) as label from m"


def scan_coverage(spark, d):
    c = k.climate(spark, d)
    scans = c.select("beach", F.col("date").alias("scan_date"), F.concat_ws("/", "beach", "date").alias("scan"))
    return selection.scan_coverage(scans, c, ["beach"], "scan_date", "date", 10, ["scan"])


SCAN_COVERAGE = f"""with {k.CLIMATE}, s as (select beach, date as scan_date, beach || '/' || date as scan from climate), x as (select scan, count(c.date) as days from s left join (select distinct beach, date from climate) c on c.beach = s.beach and c.date between s.scan_date - 9 and s.scan_date group by 1)
select scan, days, case when days = 10 then 'covered' when days > 0 then 'partial' else 'missing' end as status from x"""


def wave_islands(spark, d):
    return selection.islands(k.waves(spark, d), ["mop_id"], "ts", "hs", 8.0)


WAVE_ISLANDS = f"""with {k.WAVES}, n as (select *, row_number() over (partition by mop_id order by ts) as n, count(*) over (partition by mop_id) as c from waves), h as (select *, n - row_number() over (partition by mop_id order by ts) as g from n where hs > 8)
select mop_id, min(n) - 1 as first, count(*) as n_rows, max(hs) as peak from h group by mop_id, g having min(n) > 1 and max(n) < max(c)"""


def weighted_draws(spark, d):
    return selection.weighted_sample(k.slumps(spark, d).select("event_id", "volume"), "event_id", "volume", 300)


QUERIES = {
    "beach_first_match": (beach_first_match, BEACH_FIRST), "beach_nearest": (beach_nearest, BEACH_NEAREST), "beach_counts": (beach_counts, BEACH_COUNTS), "study_area": (study_area, STUDY_AREA),
    "event_bracket": (event_bracket, EVENT_BRACKET), "event_asof_wave": (event_asof_wave, EVENT_ASOF), "event_forward_wave": (event_forward_wave, EVENT_FORWARD), "event_overlap": (event_overlap, EVENT_OVERLAP),
    "event_nearest_transect": (event_nearest_transect, EVENT_NEAREST), "event_cells": (event_cells, EVENT_CELLS), "event_risk": (event_risk, EVENT_RISK), "event_queue": (event_queue, EVENT_QUEUE), "event_softmax_risk": (event_softmax_risk, EVENT_SOFTMAX),
    "points_bbox": (points_bbox, POINTS_BBOX), "points_normalised": (points_normalised, POINTS_NORMALISED), "points_corridor": (points_corridor, POINTS_CORRIDOR), "points_azimuth": (points_azimuth, POINTS_AZIMUTH),
    "points_dominant_class": (points_dominant_class, POINTS_DOMINANT), "points_voxels": (points_voxels, POINTS_VOXELS), "profile_shape": (profile_shape, PROFILE_SHAPE), "profile_summary": (profile_summary, PROFILE_SUMMARY),
    "profile_cliff_features": (profile_cliff_features, PROFILE_CLIFF), "profile_regrid": (profile_regrid, PROFILE_REGRID), "profile_class_counts": (profile_class_counts, PROFILE_CLASSES),
    "cube_coverage": (cube_coverage, CUBE_COVERAGE), "cube_dense": (cube_dense, CUBE_DENSE), "cube_low_coverage": (cube_low_coverage, CUBE_LOW), "cube_pairs": (cube_pairs, CUBE_PAIRS), "cube_context": (cube_context, CUBE_CONTEXT),
    "cube_change": (cube_change, CUBE_CHANGE), "cube_window_choice": (cube_window_choice, CUBE_WINDOW), "cube_labels": (cube_labels, CUBE_LABELS), "names_parsed": (names_parsed, NAMES_PARSED), "names_dated": (names_dated, NAMES_DATED),
    "label_progress": (label_progress, LABEL_PROGRESS), "class_weights": (class_weights, CLASS_WEIGHTS), "accuracy_by_class": (accuracy_by_class, ACCURACY), "range_rules": (range_rules, RANGE_RULES), "monotonic_rule": (monotonic_rule, MONOTONIC),
    "duplicate_rule": (duplicate_rule, DUPLICATE), "last_row_wins": (last_row_wins, LAST_ROW), "uncovered_events": (uncovered_events, UNCOVERED), "split_by_date": (split_by_date, SPLIT),
    "pick_representatives": (pick_representatives, PICK_REPRESENTATIVES), "pick_middle": (pick_middle, PICK_MIDDLE), "grid_lookup": (grid_lookup, GRID_LOOKUP), "site_labels": (site_labels, SITE_LABELS), "scan_coverage": (scan_coverage, SCAN_COVERAGE),
    "wave_islands": (wave_islands, WAVE_ISLANDS), "weighted_draws": (weighted_draws, None),
}
