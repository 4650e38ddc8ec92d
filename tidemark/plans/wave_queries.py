"""Queries on waves and climate, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import climate as c
from ..functions import waves as w
from ..operators import series, stats
from . import carriers as k

R = 6
POWER = "1025.0::double * 9.81 * 9.81 / (64 * pi()) * hs * hs * tp / 1000"


def _round(df, *columns, digits=R):
    return df.select(*[F.round(F.col(x), digits).alias(x) if x in columns else F.col(x) for x in df.columns])


def wave_site_summary(spark, d):
    out = stats.wave_summary(k.waves(spark, d), ["mop_id"])
    return _round(out.drop("trend_per_day"), "hs_mean", "hs_std", "hs_p90", "hs_p99", "hs_median", "dp_mean")


WAVE_SITE_SUMMARY = f"""with {k.WAVES} select mop_id, count(hs) as n, round(avg(hs), 6) as hs_mean, max(hs) as hs_max, round(stddev_pop(hs), 6) as hs_std, round(quantile_cont(hs, 0.9), 6) as hs_p90,
 round(quantile_cont(hs, 0.99), 6) as hs_p99, round(median(hs), 6) as hs_median, round((degrees(atan2(avg(sin(radians(dp))), avg(cos(radians(dp))))) + 360) % 360, 6) as dp_mean from waves group by mop_id"""


def wave_trend(spark, d):
    return _round(stats.wave_summary(k.waves(spark, d), ["mop_id"]).select("mop_id", "trend_per_day"), "trend_per_day", digits=4)


WAVE_TREND = f"with {k.WAVES} select mop_id, round(coalesce(regr_slope(hs, floor(epoch(ts)) / 3600.0::double) * 24, 0), 4) as trend_per_day from waves group by mop_id"


def wave_physics(spark, d):
    x = k.waves(spark, d)
    hs, tp = F.col("hs"), F.col("tp")
    x = x.select("event_id", w.power(hs, tp).alias("power"), w.energy(hs).alias("energy"), w.runup(hs, tp).alias("runup"), w.shore_normal(hs, F.col("dp"), F.lit(270.0)).alias("hs_normal"))
    return _round(x, "power", "energy", "runup", "hs_normal", digits=4)


WAVE_PHYSICS = f"""with {k.WAVES}, x as (select *, 9.81 * tp * tp / (2 * pi()) as deep from waves)
select event_id, round(1025.0::double * 9.81 * 9.81 / (64 * pi()) * hs * hs * tp / 1000, 4) as power, round(1025.0::double * 9.81 / 16 * hs * hs, 4) as energy,
 round(case when hs > 0 and tp > 0 then case when 0.1 / sqrt(hs / deep) < 0.3 then 0.043 * sqrt(hs * deep) else 1.1 * (0.35 * 0.1 * sqrt(hs * deep) + 0.5 * sqrt(hs * deep * (0.563 * 0.01 + 0.004))) end else 0 end, 4) as runup,
 round(hs * abs(cos(radians(dp - 270))), 4) as hs_normal from x"""


def wave_storms(spark, d):
    x = series.storms(k.waves(spark, d), ["mop_id"], threshold=20.0, gap_hours=12.0)
    return _round(x.select("mop_id", "storm", "n_rows", "peak", "hours"), "hours", digits=4)


WAVE_STORMS = f"""with {k.WAVES}, n as (select *, row_number() over (partition by mop_id order by ts) as n from waves),
h as (select *, n - lag(n) over (partition by mop_id order by ts) as gap_n, epoch(ts) - epoch(lag(ts) over (partition by mop_id order by ts)) as gap_s from n where hs >= 20),
s as (select *, sum(case when gap_n is null or (gap_n <> 1 and gap_s > 43200) then 1 else 0 end) over (partition by mop_id order by ts) as storm from h)
select mop_id, cast(storm as bigint) as storm, count(*) as n_rows, max(hs) as peak, round((epoch(max(ts)) - epoch(min(ts))) / 3600, 4) as hours from s group by mop_id, storm"""


def wave_resample_6h(spark, d):
    return _round(series.resample(k.waves(spark, d), ["mop_id"]), "hs", "tp", "dp", digits=4)


WAVE_RESAMPLE = f"""with {k.WAVES} select mop_id, time_bucket(interval '6 hours', ts, timestamp '2000-01-01') as slot, round(avg(hs), 4) as hs, round(avg(tp), 4) as tp,
 round((degrees(atan2(avg(sin(radians(dp))), avg(cos(radians(dp))))) + 360) % 360, 4) as dp from waves group by 1, 2"""


def _scans(spark, d):
    return k.waves(spark, d).select(F.col("event_id").alias("scan"), "mop_id", F.col("ts").alias("scan_ts"))


def wave_lookback(spark, d):
    """Every event is a scan: the means of 20 slots of six hours up to it."""
    return _round(series.lookback_slots(_scans(spark, d), k.waves(spark, d), ["mop_id"], "scan_ts", "ts", ["hs"], 20, 6, ["scan"]), "hs")


def _lookback(values: dict[str, str]) -> str:
    means = ", ".join(f"avg({v}) as {n}" for n, v in values.items())
    return f"""s as (select event_id as scan, mop_id, ts as scan_ts, epoch_us(ts) - 19 * 21600000000 as f from waves),
g as (select scan, scan_ts, slot::integer as slot from s, range(0, 20) t(slot)),
m as (select scan, cast((epoch_us(w.ts) - f) // 21600000000 as integer) as slot, {means} from s join waves w on s.mop_id = w.mop_id and epoch_us(w.ts) >= f and w.ts <= s.scan_ts group by 1, 2)"""


WAVE_LOOKBACK = f"""with {k.WAVES}, {_lookback({"hs": "hs"})}
select g.scan, g.slot, round(hs, 6) as hs from g left join m on g.scan = m.scan and g.slot = m.slot"""


def wave_lookback_filled(spark, d):
    x = wave_lookback(spark, d)
    return _round(series.fill_linear(x, ["scan"], "slot", "hs"), "hs")


def _filled(v: str) -> str:
    """Value of a column of x with its gaps filled: from the rows p and q of the nearest known slots a and b."""
    return f"case when y.{v} is not null then y.{v} when p_{v}.{v} is not null and q_{v}.{v} is not null then p_{v}.{v} + (q_{v}.{v} - p_{v}.{v}) * (y.slot - y.a_{v})::double / (y.b_{v} - y.a_{v})::double else coalesce(p_{v}.{v}, q_{v}.{v}) end"


def _ends(*values: str) -> tuple[str, str]:
    ends = ", ".join(f"max(case when {v} is not null then slot end) over (partition by scan order by slot) as a_{v}, min(case when {v} is not null then slot end) over (partition by scan order by slot rows between current row and unbounded following) as b_{v}" for v in values)
    joined = " ".join(f"left join x p_{v} on p_{v}.scan = y.scan and p_{v}.slot = y.a_{v} left join x q_{v} on q_{v}.scan = y.scan and q_{v}.slot = y.b_{v}" for v in values)
    return ends, joined


_HS_ENDS, _HS_JOINED = _ends("hs")
WAVE_LOOKBACK_FILLED = f"""with x as ({WAVE_LOOKBACK}), y as (select *, {_HS_ENDS} from x)
select y.scan, y.slot, round({_filled("hs")}, 6) as hs from y {_HS_JOINED}"""


def wave_tensor(spark, d):
    """Heights, periods, directions and power before every event, without gaps."""
    x = series.wave_tensor(_scans(spark, d), k.waves(spark, d), ["mop_id"], "scan_ts", 20, 6, ["scan"])
    # a direction of 0 may come as 360 where its sine is rounded below 0
    near = F.round("dp", 4)
    x = x.withColumn("dp", F.when(near >= 360, 0.0).otherwise(near))
    return _round(x.withColumns({c: F.col(c) + 1e-7 for c in ("hs", "tp", "power")}), "hs", "tp", "power", digits=4)  # off rounding ties


_TENSOR = ("hs", "tp", "power", "sn", "cs")
_T_ENDS, _T_JOINED = _ends(*_TENSOR)
WAVE_TENSOR = f"""with {k.WAVES}, {_lookback({"hs": "hs", "tp": "tp", "power": POWER, "sn": "sin(radians(dp))", "cs": "cos(radians(dp))"})},
x as (select g.scan, g.slot, g.scan_ts, hs, tp, power, sn, cs from g left join m on g.scan = m.scan and g.slot = m.slot), y as (select *, {_T_ENDS} from x),
z as (select y.scan, y.slot, y.scan_ts, {", ".join(f"{_filled(v)} as {v}" for v in _TENSOR)} from y {_T_JOINED}),
o as (select *, bool_or(hs is null or tp is null or power is null or sn is null) over (partition by scan) as gap, round((degrees(atan2(sn, cs)) + 360) % 360, 4) as dp from z)
select scan, slot, round(case when gap then 0 else hs end + 1e-7, 4) as hs, round(case when gap then 0 else tp end + 1e-7, 4) as tp, case when gap or dp >= 360 then 0 else dp end as dp, round(case when gap then 0 else power end + 1e-7, 4) as power,
 cast(dayofyear(scan_ts - to_hours(6 * (19 - slot))) as integer) as doy from o"""


def wave_rose(spark, d):
    return stats.rose(k.waves(spark, d), "dp", "hs")


WAVE_ROSE = f"with {k.WAVES}, b as (select cast(floor(dp / 22.5) as integer) as bin, sum(hs) as w from waves group by 1) select bin, round(100 * w / sum(w) over (), 6) as pct from b"


def wave_ecdf(spark, d):
    return _round(stats.ecdf(k.waves(spark, d), "hs", ["mop_id"]), "share")


WAVE_ECDF = f"with {k.WAVES} select distinct mop_id, hs, round(cume_dist() over (partition by mop_id order by hs), 6) as share from waves"


def wave_histogram(spark, d):
    return stats.histogram(k.waves(spark, d), "hs", 50)


WAVE_HISTOGRAM = f"""with {k.WAVES}, s as (select min(hs) as lo, (max(hs) - min(hs)) / 50 as w from waves)
select cast(least(floor((hs - lo) / w), 49) as integer) as bin, count(*) as n from waves, s group by 1"""


def wave_correlations(spark, d):
    return stats.correlations(k.waves(spark, d), ["hs", "tp", "dp"])


WAVE_CORRELATIONS = f"with {k.WAVES} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from waves" for a in ("hs", "tp", "dp") for b in ("hs", "tp", "dp"))


def wave_feature_stats(spark, d):
    return _round(stats.describe(k.waves(spark, d), ["hs", "tp", "dp"], ["mop_id"]), "min", "max", "mean", "std", "median")


WAVE_FEATURE_STATS = f"""with {k.WAVES}, u as (select mop_id, 'hs' as feature, hs as v from waves union all select mop_id, 'tp', tp from waves union all select mop_id, 'dp', dp from waves)
select mop_id, feature, round(min(v), 6) as min, round(max(v), 6) as max, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(median(v), 6) as median, count(*) filter (v is null) as n_null, count(*) as n from u group by 1, 2"""


def climate_daily_features(spark, d):
    x = series.climate_features(k.climate(spark, d), ["beach"])
    return _round(x, "precip_mm", "temp_mean_c", "temp_min_c", "temp_max_c", "dewpoint_c", "precip_7d", "precip_30d", "precip_60d", "precip_90d", "api", "max_precip_7d", "max_precip_30d", "vpd", "vpd_7d_mean")


def _w(n):
    return f"over (partition by beach order by date rows between {n - 1} preceding and current row)"


CLIMATE_FEATURES = f"""with recursive {k.CLIMATE},
n as (select *, row_number() over (partition by beach order by date) as n, case when precip_mm >= 1 then 1 else 0 end as rain_day, case when temp_min_c < 0 then 1 else 0 end as freeze_flag from climate),
api as (select beach, n, precip_mm as api from n where n = 1 union all select n.beach, n.n, n.precip_mm + 0.9::double * api.api from api join n on n.beach = api.beach and n.n = api.n + 1),
f as (select *, case when precip_mm < 1 then 0 when precip_mm < 10 then 1 when precip_mm < 25 then 2 else 3 end as intensity_class,
  case when lag(rain_day) over (partition by beach order by date) = 1 and rain_day = 0 then 1 else 0 end as dried, case when lag(freeze_flag) over (partition by beach order by date) = 1 and freeze_flag = 0 then 1 else 0 end as thawed,
  n - coalesce(max(case when rain_day = 1 then n end) over (partition by beach order by date), 0) as days_since_rain,
  case when dewpoint_c is not null then greatest(0.0::double, 0.6108 * exp(17.27 * temp_mean_c / (temp_mean_c + 237.3)) - 0.6108 * exp(17.27 * dewpoint_c / (dewpoint_c + 237.3))) end as vpd,
  case when month(date) >= 10 then year(date) else year(date) - 1 end as wy from n)
select f.beach, date, round(precip_mm, 6) as precip_mm, round(temp_mean_c, 6) as temp_mean_c, round(temp_min_c, 6) as temp_min_c, round(temp_max_c, 6) as temp_max_c, round(dewpoint_c, 6) as dewpoint_c,
  rain_day::integer as rain_day, intensity_class::integer as intensity_class, round(sum(precip_mm) {_w(7)}, 6) as precip_7d, round(sum(precip_mm) {_w(30)}, 6) as precip_30d, round(sum(precip_mm) {_w(60)}, 6) as precip_60d, round(sum(precip_mm) {_w(90)}, 6) as precip_90d,
  round(api, 6) as api, days_since_rain::integer as days_since_rain, coalesce(lag(days_since_rain) over (partition by f.beach order by date), 0)::integer as consecutive_dry_days,
  round(max(precip_mm) {_w(7)}, 6) as max_precip_7d, round(max(precip_mm) {_w(30)}, 6) as max_precip_30d, cast(sum(dried) {_w(30)} as bigint) as wet_dry_cycles_30d, cast(sum(dried) {_w(90)} as bigint) as wet_dry_cycles_90d,
  round(vpd, 6) as vpd, round(avg(vpd) {_w(7)}, 6) as vpd_7d_mean, freeze_flag::integer as freeze_flag, (case when temp_min_c < 2 then 1 else 0 end)::integer as marginal_freeze_flag, cast(sum(thawed) {_w(30)} as bigint) as freeze_thaw_30d,
  cast(sum(thawed) over (partition by f.beach, wy order by date) as bigint) as freeze_thaw_season
from f join api on f.beach = api.beach and f.n = api.n""".replace("over (partition by beach order by date rows", "over (partition by f.beach order by date rows")


def climate_climatology(spark, d):
    return _round(stats.climatology(k.climate(spark, d), "date", "precip_mm"), "mean", "std")


CLIMATOLOGY = f"with {k.CLIMATE} select cast(month(date) as integer) as month, round(avg(precip_mm), 6) as mean, round(stddev_samp(precip_mm), 6) as std, count(precip_mm) as n from climate group by 1"


def climate_month_by_year(spark, d):
    years = list(range(1995, 2002))
    return _round(stats.month_by_year(k.climate(spark, d), "date", "precip_mm", years), *[f"y{y}" for y in years])


MONTH_BY_YEAR = f"with {k.CLIMATE} select cast(month(date) as integer) as month, " + ", ".join(f"round(avg(case when year(date) = {y} then precip_mm end), 6) as y{y}" for y in range(1995, 2002)) + " from climate group by 1"


def climate_extreme_months(spark, d):
    return stats.monthly_counts(k.climate(spark, d), "date", F.col("precip_mm") >= 38, ["beach"])


EXTREME_MONTHS = f"""with {k.CLIMATE}, m as (select beach, cast(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), interval 1 month)) as date) as month from climate group by beach),
h as (select beach, cast(date_trunc('month', date) as date) as month, count(*) as n from climate where precip_mm >= 38 group by all) select m.beach, m.month, coalesce(h.n, 0) as n from m left join h on m.beach = h.beach and m.month = h.month"""


def climate_completeness(spark, d):
    return stats.completeness(k.climate(spark, d), ["precip_mm", "temp_mean_c", "dewpoint_c"], ["beach"])


COMPLETENESS = f"with {k.CLIMATE} select beach, round(100 * (1 - sum((precip_mm is null)::int + (temp_mean_c is null)::int + (dewpoint_c is null)::int) / (count(*) * 3)), 6) as pct, count(*) as n from climate group by 1"


def climate_return_periods(spark, d):
    return _round(stats.return_periods(k.climate(spark, d), ["beach"], "date", "precip_mm"), "return_period")


RETURN_PERIODS = f"""with {k.CLIMATE}, t as (select beach, cast(year(date) as integer) as year, max(precip_mm) as annual_max from climate group by all)
select beach, year, annual_max, cast(row_number() over (partition by beach order by annual_max desc, year) as integer) as rank,
 round((count(*) over (partition by beach) + 1)::double / row_number() over (partition by beach order by annual_max desc, year), 6) as return_period from t"""


def climate_seasons(spark, d):
    x = k.climate(spark, d).groupBy("beach", c.season(F.col("date")).alias("season")).agg(F.avg("temp_mean_c").alias("mean"), F.stddev_samp("temp_mean_c").alias("std"))
    return _round(x, "mean", "std")


SEASONS = f"""with {k.CLIMATE} select beach, case when month(date) in (12, 1, 2) then 'winter' when month(date) in (3, 4, 5) then 'spring' when month(date) in (6, 7, 8) then 'summer' else 'autumn' end as season,
 round(avg(temp_mean_c), 6) as mean, round(stddev_samp(temp_mean_c), 6) as std from climate group by all"""


def climate_year_mean(spark, d):
    x = k.climate(spark, d).withColumn("mean_365d", series.rolling_days_mean(F.col("precip_mm"), ["beach"], "date", 365) + 1e-9)  # off rounding ties
    return _round(x.select("beach", "date", "mean_365d"), "mean_365d")


YEAR_MEAN = f"with {k.CLIMATE} select beach, date, round(avg(precip_mm) over (partition by beach order by date range between interval 364 days preceding and current row) + 1e-9, 6) as mean_365d from climate"


def climate_window(spark, d):
    """The 30 days up to every day of every beach."""
    x = k.climate(spark, d)
    scans = x.select("beach", F.col("date").alias("scan_date"), F.concat_ws("/", "beach", "date").alias("scan"))
    return _round(series.daily_window(scans, x, ["beach"], "scan_date", "date", ["dewpoint_c"], 30, ["scan"]), "dewpoint_c")


CLIMATE_WINDOW = f"""with {k.CLIMATE}, w as (select s.beach || '/' || s.date as scan, cast(i as integer) as day_no, s.date - 29 + cast(i as integer) as date, c.date is not null as there, c.dewpoint_c as v from climate s cross join range(0, 30) t(i) left join climate c on c.beach = s.beach and c.date = s.date - 29 + cast(i as integer)),
x as (select *, count(*) filter (there) over p = 30 as complete, avg(v) over p as mean, max(case when v is not null then day_no end) over (p order by day_no) as a, min(case when v is not null then day_no end) over (p order by day_no rows between current row and unbounded following) as b from w window p as (partition by scan)),
y as (select x.*, l.v as av, r.v as bv from x left join w l on l.scan = x.scan and l.day_no = x.a left join w r on r.scan = x.scan and r.day_no = x.b)
select scan, day_no, date, round(case when complete or v is not null then v when av is not null and day_no - a <= 3 then case when bv is not null then av + (bv - av) * (day_no - a)::double / (b - a)::double else av end else coalesce(mean, 0) end, 6) as dewpoint_c from y"""


QUERIES = {
    "wave_site_summary": (wave_site_summary, WAVE_SITE_SUMMARY), "wave_trend": (wave_trend, WAVE_TREND), "wave_physics": (wave_physics, WAVE_PHYSICS), "wave_storms": (wave_storms, WAVE_STORMS),
    "wave_resample_6h": (wave_resample_6h, WAVE_RESAMPLE), "wave_lookback": (wave_lookback, WAVE_LOOKBACK), "wave_lookback_filled": (wave_lookback_filled, WAVE_LOOKBACK_FILLED), "wave_tensor": (wave_tensor, WAVE_TENSOR), "wave_rose": (wave_rose, WAVE_ROSE),
    "wave_ecdf": (wave_ecdf, WAVE_ECDF), "wave_histogram": (wave_histogram, WAVE_HISTOGRAM), "wave_correlations": (wave_correlations, WAVE_CORRELATIONS), "wave_feature_stats": (wave_feature_stats, WAVE_FEATURE_STATS),
    "climate_daily_features": (climate_daily_features, CLIMATE_FEATURES), "climate_climatology": (climate_climatology, CLIMATOLOGY), "climate_month_by_year": (climate_month_by_year, MONTH_BY_YEAR),
    "climate_extreme_months": (climate_extreme_months, EXTREME_MONTHS), "climate_completeness": (climate_completeness, COMPLETENESS), "climate_return_periods": (climate_return_periods, RETURN_PERIODS),
    "climate_seasons": (climate_seasons, SEASONS), "climate_year_mean": (climate_year_mean, YEAR_MEAN), "climate_window": (climate_window, CLIMATE_WINDOW),
}
