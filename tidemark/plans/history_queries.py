"""Queries on summaries between surveys, samples and slices, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as lab
from ..operators import cube, history, series
from . import carriers as k
from .wave_queries import CLIMATE_FEATURES as FEATURES
from .wave_queries import POWER, _round

_DEEP = "(9.81 * tp * tp / (2 * pi()))"
RUNUP = f"(case when 0.1::double / sqrt(hs / {_DEEP}) < 0.3 then 0.043 * sqrt(hs * {_DEEP}) else 1.1 * (0.35 * 0.1::double * sqrt(hs * {_DEEP}) + 0.5 * sqrt(hs * {_DEEP} * (0.563 * 0.01::double + 0.004))) end)"


def wave_metrics(spark, d):
    x = history.wave_metrics(k.waves(spark, d), ["mop_id"], threshold=20.0)
    return _round(x, *[c for c in x.columns if c not in ("mop_id", "storm_hours", "storm_count")], digits=4)


WAVE_METRICS = f"""with {k.WAVES}, o as (select *, row_number() over (partition by mop_id order by ts) as n from waves), h as (select * from o where hs >= 20),
f as (select *, case when lag(ts) over q is null or (n - lag(n) over q <> 1 and epoch(ts) - epoch(lag(ts) over q) > 43200) then 1 else 0 end as opened from h window q as (partition by mop_id order by ts)),
s as (select *, sum(opened) over (partition by mop_id order by ts) as storm from f), e as (select mop_id, storm, (epoch(max(ts)) - epoch(min(ts))) / 3600 as hours, max(ts) as b from s group by 1, 2),
t as (select mop_id, count(*) as n, max(hours) as longest, avg(hours) as mean, max(b) as b from e group by 1),
a as (select mop_id, round(avg(hs), 4) as hs_m, round(avg(tp), 4) as tp_s, round((degrees(atan2(avg(sin(radians(dp))), avg(cos(radians(dp))))) + 360) % 360, 4) as dp_deg, round(avg({POWER}), 4) as power_kw, round(avg({POWER}), 4) as mean_power_kw, round(avg(case when hs is null or tp is null then null when hs > 0 and tp > 0 then {RUNUP} else 0 end), 4) as runup_2pct_m,
 round(avg(hs * abs(cos(radians(dp - 270)))), 4) as shore_normal_hs_m, round(sum(1025.0::double * 9.81 / 16 * hs * hs) * 3600 / 1e6, 4) as cumulative_energy_mj, round(sum({POWER}), 4) as cumulative_power_kwh,
 round(max(hs), 4) as max_hs_m, round(quantile_cont(hs, 0.9), 4) as hs_p90, round(quantile_cont(hs, 0.99), 4) as hs_p99, count(*) filter (hs >= 20) as storm_hours, round(max(hs), 4) as rolling_max_7d_m,
 round(coalesce(regr_slope(hs, floor(epoch(ts) / 3600)) * 24, 0), 4) as hs_trend_slope, max(ts) as z, count(*) as rows from waves group by 1)
select a.* exclude (z, rows), coalesce(t.n, 0) as storm_count, round(coalesce(longest, 0), 4) as max_storm_duration_hr, round(coalesce(mean, 0), 4) as mean_storm_duration_hr,
 round(case when b is null then rows else greatest(0, (epoch(z) - epoch(b)) / 3600) end, 4) as time_since_storm_hr from a left join t on a.mop_id = t.mop_id"""


def wave_epoch_features(spark, d):
    stress = {"sxy": (F.col("event_id") % 37) / 10 - 1.8, "sxx": (F.col("event_id") % 23) / 10 - 1.1}
    x = history.epoch_features(k.waves(spark, d).withColumns(stress).withColumn("week", F.floor((F.dayofyear("ts") - 1) / 7).cast("int")), ["mop_id", "week"])
    return _round(x, *[c for c in x.columns if c not in ("mop_id", "week", "storm_hours_3m", "storm_hours_4m", "n_valid_hours")], digits=4)


WAVE_EPOCH = f"""with {k.WAVES} select mop_id, cast(floor((dayofyear(ts) - 1) / 7) as integer) as week, round(avg(hs), 4) as hs_mean, round(median(hs), 4) as hs_median, round(stddev_pop(hs), 4) as hs_std, round(max(hs), 4) as hs_max,
 round(quantile_cont(hs, 0.9), 4) as hs_90q, round(quantile_cont(hs, 0.95), 4) as hs_95q, round(avg(tp), 4) as tp_mean, round(max(tp), 4) as tp_max, round(avg({POWER}), 4) as power_mean, round(max({POWER}), 4) as power_max,
 round(sum({POWER}), 4) as power_cumulative, count(*) filter (hs > 3) as storm_hours_3m, count(*) filter (hs > 4) as storm_hours_4m, round((count(*) filter (hs > 2)) / count(*), 4) as high_energy_fraction,
 round((degrees(atan2(avg(sin(radians(dp))), avg(cos(radians(dp))))) + 360) % 360, 4) as dp_mean, round(degrees(stddev_pop(radians(dp))), 4) as dp_spread, round(sum((event_id % 37) / 10.0::double - 1.8), 4) as sxy_net, round(sum((event_id % 23) / 10.0::double - 1.1), 4) as sxx_net, count(hs) as n_valid_hours, round(count(hs) / count(*), 4) as data_coverage from waves group by 1, 2"""


def cliff_metrics(spark, d):
    n = F.col("l_linenumber")
    toe = F.when(n < 7, F.col("l_quantity").cast("double"))
    rows = k.read(spark, d, "lineitem").select("l_suppkey", (n % 3 == 0).alias("has_cliff"), toe.alias("toe"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("top"), F.col("l_discount").alias("toe_confidence"), (F.col("l_discount") / 2).alias("top_confidence"))
    x = history.cliff_metrics(rows, ["l_suppkey"])
    return _round(x, *[c for c in x.columns if c[0] == "m" or c[:3] == "std" or c == "detection_rate"], digits=5)


CLIFF = """with x as (select l_suppkey, l_linenumber % 3 = 0 as c, l_quantity + l_tax * 100 - l_quantity as w, l_discount as t from lineitem where l_linenumber < 7)
select l_suppkey, count(*) as n_valid, count(*) filter (c) as n_detected, round((count(*) filter (c)) / count(*), 5) as detection_rate, round(coalesce(avg(w) filter (c), 0), 5) as mean_cliff_width_m, round(coalesce(stddev_pop(w) filter (c), 0), 5) as std_cliff_width_m,
 round(coalesce(min(w) filter (c), 0), 5) as min_cliff_width_m, round(coalesce(max(w) filter (c), 0), 5) as max_cliff_width_m, round(coalesce(avg(t) filter (c), 0), 5) as mean_toe_confidence, round(coalesce(avg(t / 2) filter (c), 0), 5) as mean_top_confidence from x group by 1"""


def event_pair(spark, d):
    return history.matching_pair(k.slumps(spark, d), k.epochs(spark, d), "event_id")


EVENT_PAIR = f"""with {k.SLUMPS}, {k.EPOCHS}, p as (select epoch_idx, epoch_date as a, lead(epoch_date) over (order by epoch_idx) as b from epochs),
m as (select event_id, min(epoch_idx) as pair from slumps join p on b is not null and ((a <= start_date and b >= end_date) or (abs(a - start_date) <= 7 and abs(b - end_date) <= 7)) group by 1)
select s.event_id, m.pair from slumps s left join m on s.event_id = m.event_id"""


def _spans(spark, d):
    e = k.slumps(spark, d)
    return e.withColumn("lo", F.col("transect_idx") - (F.col("event_id") % 17) / 10.0).withColumn("hi", F.col("transect_idx") + (F.col("event_id") % 13) / 10.0).drop("transect_idx")


def events_of_pairs(spark, d):
    """Slumps of every transect and pair of successive covered surveys, by volume."""
    pairs = cube.successive_pairs(k.cells(spark, d), ["transect_idx"])
    dates = k.years(spark, d)
    dated = lambda e, to: dates.select(F.col("epoch_idx").alias(e), F.col("epoch_date").alias(to))
    pairs = pairs.join(dated("epoch_before", "first"), "epoch_before").join(dated("epoch_after", "second"), "epoch_after").withColumn("place", F.col("transect_idx").cast("double"))
    return history.events_of_pairs(_spans(spark, d), pairs).select("transect_idx", "epoch_before", "epoch_after", "event_id", "volume", "position")


EVENTS_OF_PAIRS = f"""with {k.CELLS}, {k.SLUMPS}, {k.YEARS}, p as (select transect_idx, epoch_idx as epoch_before, lead(epoch_idx) over (partition by transect_idx order by epoch_idx) as epoch_after from cells),
e as (select event_id, transect_idx - (event_id % 17) / 10.0::double as lo, transect_idx + (event_id % 13) / 10.0::double as hi, start_date, end_date, volume from slumps)
select p.transect_idx, p.epoch_before, p.epoch_after, e.event_id, e.volume, cast(row_number() over (partition by p.transect_idx, p.epoch_before order by e.volume desc, e.event_id) as integer) as position
from p join years a on a.epoch_idx = p.epoch_before join years b on b.epoch_idx = p.epoch_after join e on e.lo - 0.15::double <= p.transect_idx and e.hi + 0.15::double >= p.transect_idx and e.start_date >= a.epoch_date and e.end_date <= b.epoch_date"""


def event_queue_pairs(spark, d):
    """The 2000 largest slumps, one a transect and pair of neighbouring surveys."""
    e = k.slumps(spark, d).withColumn("place", F.col("transect_idx") + (F.col("event_id") % 5) / 10.0)
    transects = spark.range(50).select(F.col("id").cast("int").alias("idx"), F.col("id").cast("double").alias("place_of"))
    return history.pair_queue(e, transects, k.epochs(spark, d)).select(F.col("idx").alias("transect_idx"), "pair", "event_id", "volume", "position")


EVENT_QUEUE_PAIRS = f"""with x as ({EVENT_PAIR}), s as (with {k.SLUMPS} select * from slumps),
e as (select s.transect_idx, x.pair, s.event_id, s.volume, row_number() over (partition by s.transect_idx, x.pair order by s.volume desc, s.event_id) as r from s join x on s.event_id = x.event_id where x.pair is not null and s.event_id % 5 <= 1),
t as (select * from e where r = 1 order by volume desc, event_id limit 2000)
select transect_idx, pair, event_id, volume, cast(row_number() over (order by volume desc, event_id) as integer) as position from t"""


def training_samples(spark, d):
    """Slumps bracketed by covered surveys, added up by cell, and the samples of all cells with a context."""
    covered = k.cells(spark, d)
    events = history.events_by_cell(history.align_events(k.slumps(spark, d), k.years(spark, d), covered))
    x = history.training_samples(covered.select("transect_idx", "epoch_idx", (F.col("cents") % 4000 / 100.0).alias("value")), events)
    shown = F.array_join(F.transform("context", lambda v: F.coalesce(F.round(v * 100).cast("long").cast("string"), F.lit("-"))), ",")
    return _round(x.withColumn("context", shown).withColumn("collapse", F.array_join("collapse", "")), "total_volume", "risk_index", digits=4)


TRAINING = f"""with {k.CELLS}, {k.SLUMPS}, {k.YEARS}, {k.ALIGNED}, x as (select transect_idx, epoch_idx, list(cast(cents % 4000 as bigint)) over (partition by transect_idx order by epoch_idx rows between 10 preceding and 1 preceding) as c from cells)
select x.transect_idx, x.epoch_idx as target_epoch, repeat('-,', 10 - len(x.c)) || array_to_string(x.c, ',') as context, cast(len(x.c) as integer) as n_context, round(coalesce(v, 0), 4) as total_volume, coalesce(e.c, 0) as event_class,
 round(1 / (1 + exp(-0.5 * (ln(1 + coalesce(v, 0)) * least(greatest(1 + 0.05 * (x.c[-1] / 100.0::double - 15), 0.5), 2.0) - 4))), 4) as risk_index, repeat(case when coalesce(v, 0) >= 10 then '1' else '0' end, 4) as collapse,
 case when v is null then 0 else 1 end as label_source, case when v is null then 0.5 else 1.0 end::double as confidence
from x left join by_cell e on x.transect_idx = e.transect_idx and x.epoch_idx = e.epoch_idx where len(x.c) >= 3"""


def cell_volumes(spark, d):
    """Slumps by the cell they end at: summed volume and its class."""
    aligned = history.align_events(k.slumps(spark, d), k.years(spark, d), k.cells(spark, d))
    return _round(history.events_by_cell(aligned), "volume", digits=4)


CELL_VOLUMES = f"with {k.CELLS}, {k.SLUMPS}, {k.YEARS}, {k.ALIGNED} select transect_idx, epoch_idx, round(v, 4) as volume, c as event_class from by_cell"


def climate_high_risk_days(spark, d):
    """The decayed rain index above its own upper quartile, with over 50 mm in seven days."""
    x = series.climate_features(k.climate(spark, d), ["beach"]).select("beach", "date", "api", "precip_7d")
    limit = x.groupBy("beach").agg(F.percentile("api", 0.75).alias("limit"))
    return _round(x.join(limit, "beach").where("api > limit and precip_7d > 50").select("beach", "date", (F.col("api") + 1e-7).alias("api"), (F.col("precip_7d") + 1e-7).alias("precip_7d")), "api", "precip_7d", digits=4)  # off rounding ties


EXACT = FEATURES.replace("round(api, 6) as api", "api")
HIGH_RISK = f"with f as (select * from ({EXACT})), l as (select beach, quantile_cont(api, 0.75) as l from f group by 1) select f.beach, f.date, round(api + 1e-7, 4) as api, round(precip_7d + 1e-7, 4) as precip_7d from f join l on f.beach = l.beach where api > l.l and precip_7d > 50"


def profile_common_range(spark, d):
    return history.common_range(_valid(spark, d), ["label"], "transect", "distance", "elevation")


def _valid(spark, d):
    return k.profiles(spark, d).withColumn("elevation", F.when(F.col("elevation") > -8, F.col("elevation")))


_VALID = f"{k.PROFILES}, v as (select * from profiles where elevation > -8), r as (select label, max(a) as lo, min(b) as hi from (select label, transect, min(distance) as a, max(distance) as b from v group by 1, 2) group by 1 having min(b) > max(a))"
COMMON_RANGE = f"with {_VALID} select label, lo, hi from r"


def profile_common_grid(spark, d):
    return _round(history.on_common_grid(_valid(spark, d), ["label"], "transect", "distance", "elevation", 9), "x", "value", digits=4)


COMMON_GRID = f"""with {_VALID}, g as (select label, i as k, lo + (hi - lo) * i / 8 as x from r, range(0, 9) t(i)), n as (select label, transect from v group by 1, 2 having count(*) > 1),
b as (select n.label, n.transect, g.k, g.x, max(v.distance) filter (v.distance <= g.x) as x1, arg_max(v.elevation, v.distance) filter (v.distance <= g.x) as v1, min(v.distance) filter (v.distance >= g.x) as x2, arg_min(v.elevation, v.distance) filter (v.distance >= g.x) as v2
 from n join g on n.label = g.label join v on v.label = n.label and v.transect = n.transect group by all)
select label, transect, cast(k as integer) as k, round(x, 4) as x, round(case when x1 is null or x2 is null then null when x1 = x2 then v1 else v1 + (v2 - v1) / (x2 - x1) * (x - x1) end, 4) as value from b"""


def climate_summary(spark, d):
    """Rows, dates, distinct months and share of missing dewpoints of each beach."""
    x = k.climate(spark, d)
    out = x.groupBy("beach").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct(F.trunc("date", "month")).alias("months"), (100 * F.count_if(F.col("dewpoint_c").isNull()) / F.count("*")).alias("missing_pct"))
    return _round(out, "missing_pct", digits=4)


CLIMATE_SUMMARY = f"with {k.CLIMATE} select beach, count(*) as n, min(date) as first, max(date) as last, count(distinct date_trunc('month', date)) as months, round(100.0::double * (count(*) filter (dewpoint_c is null)) / count(*), 4) as missing_pct from climate group by 1"


def event_cursor(spark, d):
    """The next slump of a transect that has no label yet, from the first again after the last."""
    x = k.slumps(spark, d).select("transect_idx", "event_id", (F.col("volume") > 30).alias("labelled"))
    return history.next_unlabelled(x, ["transect_idx"], "event_id", "labelled")


EVENT_CURSOR = f"""with {k.SLUMPS}, x as (select transect_idx, event_id, volume > 30 as labelled, case when not volume > 30 then event_id end as own from slumps)
select transect_idx, event_id, labelled, coalesce(min(own) over (partition by transect_idx order by event_id rows between 1 following and unbounded following), min(own) over (partition by transect_idx)) as next_order from x"""


def wettest_day(spark, d):
    """Each beach's rain on the day on which any beach had the most."""
    x = k.climate(spark, d)
    day = x.agg(F.max_by("date", F.struct("precip_mm", -F.unix_date("date"))).alias("date"))
    return x.join(day, "date").select("beach", "date", "precip_mm")


WETTEST = f"with {k.CLIMATE} select beach, date, precip_mm from climate where date = (select date from climate order by precip_mm desc, date limit 1)"


def wave_beach_summary(spark, d):
    """Means of site means for each group of five sites, to two decimals."""
    sites = k.waves(spark, d).groupBy("mop_id").agg(F.avg("hs").alias("hs"), F.max("hs").alias("most"))
    x = sites.groupBy(F.floor(F.col("mop_id") / 5).cast("int").alias("beach")).agg(F.avg("hs").alias("hs_mean"), F.avg("most").alias("hs_max"), F.count("*").alias("n_sites"))
    return _round(x, "hs_mean", "hs_max", digits=2)


BEACH_SUMMARY = f"with {k.WAVES}, s as (select mop_id, avg(hs) as hs, max(hs) as most from waves group by 1) select cast(floor(mop_id / 5) as integer) as beach, round(avg(hs), 2) as hs_mean, round(avg(most), 2) as hs_max, count(*) as n_sites from s group by 1"


def beach_slices(spark, d):
    """Each beach's own numbers: a number that two ranges share belongs to the first."""
    probes, beaches = k.probes(spark, d).select("mop").distinct(), k.beaches(spark)
    hit = probes.join(F.broadcast(beaches), F.expr("mop between mop_lo and mop_hi"))  # six ranges
    first = hit.groupBy("mop").agg(F.min_by("beach", "beach_order").alias("beach"))
    return first.groupBy("beach").agg(F.min("mop").alias("first"), F.max("mop").alias("last"), F.count("*").alias("n"))


BEACH_SLICES = f"with {k.PROBES}, {k.BEACH_ROWS}, h as (select mop, arg_min(beach, beach_order) as beach from (select distinct mop from probes) join beaches on mop between mop_lo and mop_hi group by 1) select beach, min(mop) as first, max(mop) as last, count(*) as n from h group by 1"


def cube_dimensions(spark, d):
    return k.cells(spark, d).agg(F.countDistinct("transect_idx").alias("n_transects"), F.countDistinct("epoch_idx").alias("n_epochs"), F.min("epoch_idx").alias("first_epoch"), F.max("epoch_idx").alias("last_epoch"), F.count("*").alias("n_cells"))


CUBE_DIMENSIONS = f"with {k.CELLS} select count(distinct transect_idx) as n_transects, count(distinct epoch_idx) as n_epochs, min(epoch_idx) as first_epoch, max(epoch_idx) as last_epoch, count(*) as n_cells from cells"


def cube_latest_epoch(spark, d):
    """All transects at epoch -1, the last one."""
    x = k.cells(spark, d)
    return x.join(F.broadcast(x.agg(F.max("epoch_idx").alias("epoch_idx"))), "epoch_idx").select("transect_idx", "epoch_idx", "cents")  # one row


CUBE_LATEST = f"with {k.CELLS} select transect_idx, epoch_idx, cents from cells where epoch_idx = (select max(epoch_idx) from cells)"


def cube_feature_over_time(spark, d):
    """A transect's values in the order of its epochs."""
    return k.cells(spark, d).groupBy("transect_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("epoch_idx", "cents"))), lambda s: s["cents"].cast("string")), ",").alias("series"), F.count("*").alias("n"))  # one value an epoch


CUBE_SERIES = f"with {k.CELLS} select transect_idx, string_agg(cast(cents as varchar), ',' order by epoch_idx) as series, count(*) as n from cells group by 1"


def climate_every_kth(spark, d):
    """Every k-th wet day of a beach, at most 20."""
    x = k.climate(spark, d).where("precip_mm > 30").withColumn("n", F.row_number().over(Window.partitionBy("beach").orderBy("date")) - 1)
    size = x.groupBy("beach").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 20)).alias("step"))
    return x.join(size, "beach").where("n % step = 0").select("beach", "date", "precip_mm")


EVERY_KTH = f"with {k.CLIMATE}, x as (select *, row_number() over (partition by beach order by date) - 1 as n, count(*) over (partition by beach) as c from climate where precip_mm > 30) select beach, date, precip_mm from x where n % greatest(1, cast(ceil(c / 20.0) as bigint)) = 0"

QUERIES = {
    "wave_metrics": (wave_metrics, WAVE_METRICS), "wave_epoch_features": (wave_epoch_features, WAVE_EPOCH), "cliff_metrics": (cliff_metrics, CLIFF), "event_pair": (event_pair, EVENT_PAIR), "climate_high_risk_days": (climate_high_risk_days, HIGH_RISK),
    "profile_common_range": (profile_common_range, COMMON_RANGE), "profile_common_grid": (profile_common_grid, COMMON_GRID), "climate_summary": (climate_summary, CLIMATE_SUMMARY), "event_cursor": (event_cursor, EVENT_CURSOR), "wettest_day": (wettest_day, WETTEST),
    "wave_beach_summary": (wave_beach_summary, BEACH_SUMMARY), "beach_slices": (beach_slices, BEACH_SLICES), "cube_dimensions": (cube_dimensions, CUBE_DIMENSIONS), "cube_latest_epoch": (cube_latest_epoch, CUBE_LATEST),
    "cube_feature_over_time": (cube_feature_over_time, CUBE_SERIES), "climate_every_kth": (climate_every_kth, EVERY_KTH), "training_samples": (training_samples, TRAINING), "cell_volumes": (cell_volumes, CELL_VOLUMES), "events_of_pairs": (events_of_pairs, EVENTS_OF_PAIRS), "event_queue_pairs": (event_queue_pairs, EVENT_QUEUE_PAIRS),
}
