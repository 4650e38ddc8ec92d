"""Queries of views, labels, validation and losses, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lab
from ..operators import views
from ..sources import labelstore
from . import carriers as k
from .history_queries import EVENT_QUEUE_PAIRS, event_queue_pairs
from .survey_queries import _round


def coverage_by_beach(spark, d):
    """Six beaches of ten transects, the last of which has none."""
    slices = spark.range(6).select(F.concat(F.lit("b"), "id").alias("beach"), (F.col("id") * 10).cast("int").alias("first"), (F.col("id") * 10 + 10).cast("int").alias("end"))
    return _round(views.beach_coverage(k.cells(spark, d), slices, k.years(spark, d)), "pct", digits=4)


COVERAGE_BY_BEACH = f"""with {k.CELLS}, {k.YEARS}, s as (select 'b' || i as beach, i * 10 as a, i * 10 + 10 as b from range(0, 6) t(i)), n as (select count(*) as n from years)
select s.beach, count(c.epoch_idx) as present, cast(10 * any_value(n.n) as bigint) as total, round(100.0::double * count(c.epoch_idx) / (10 * any_value(n.n)), 4) as pct from s cross join n left join cells c on c.transect_idx >= s.a and c.transect_idx < s.b group by 1"""


def dataset_validation(spark, d):
    """Cells against transects times surveys, and the profiles' features against their ranges."""
    total = F.lit(50 * k.years(spark, d).count())  # fifty transects at a row a year
    x = k.profiles(spark, d).withColumn("elevation", F.when(F.col("elevation") > -30, F.col("elevation")))
    return _round(views.validation(k.cells(spark, d), total, x, {"elevation": (-20.0, 60.0), "distance": (0.0, 40.0)}), "coverage_pct", digits=4)


VALIDATION = f"""with {k.CELLS}, {k.YEARS}, {k.PROFILES}, n as (select 50 * count(*) as n from years), c as (select count(*) as m from cells),
p as (select count(*) filter (not elevation > -30) as nan, cast(bool_or(elevation > -30 and not elevation between -20 and 60) as integer) + cast(bool_or(not distance between 0 and 40) as integer) as off from profiles)
select cast(n - m as bigint) as missing, round(100.0::double * m / n, 4) as coverage_pct, cast(nan as bigint) as n_nan, cast(off as bigint) as n_range_issues, cast(n > m as integer) + cast(nan > 0 as integer) + cast(off > 0 as integer) as n_warnings, nan = 0 as is_valid from n, c, p"""


def transects_compared(spark, d):
    """The ten transects of each survey with the widest range of heights."""
    return _round(views.compared(k.profiles(spark, d), ["label"], "transect", "elevation"), "min", "max", "mean", "std", digits=4)


COMPARED = f"""with {k.PROFILES}, e as (select label, transect, count(elevation) as n, min(elevation) as a, max(elevation) as b, avg(elevation) as m, stddev_pop(elevation) as s from profiles group by 1, 2),
r as (select *, row_number() over (partition by label order by b - a desc, transect) as p from e)
select label, transect, n, round(a, 4) as min, round(b, 4) as max, round(m, 4) as mean, round(s, 4) as std, cast(p as integer) as position from r where p <= 10"""


def mop_range(spark, d):
    """The least and greatest number of all probes and of those of each hundred."""
    p = k.probes(spark, d).rollup(F.floor(F.col("mop") / 100).cast("int").alias("hundred"))
    return p.agg(F.min("mop").alias("mop_min"), F.max("mop").alias("mop_max"))


MOP_RANGE = f"with {k.PROBES} select cast(floor(mop / 100) as integer) as hundred, min(mop) as mop_min, max(mop) as mop_max from probes group by rollup (1)"


def wave_storm_months(spark, d):
    return views.storm_hours_by_month(k.waves(spark, d), ["mop_id"])


STORM_MONTHS = f"with {k.WAVES}, l as (select mop_id, quantile_cont(hs, 0.95) as l from waves group by 1) select w.mop_id, cast(month(ts) as integer) as month, count(*) filter (hs > l) as hours from waves w join l on l.mop_id = w.mop_id group by 1, 2"


def climate_annual(spark, d):
    return _round(views.annual_totals(k.climate(spark, d), ["beach"], "date", "precip_mm", 38.0), "total", digits=4)


ANNUAL = f"with {k.CLIMATE} select beach, cast(year(date) as integer) as year, round(sum(precip_mm), 4) as total, count(*) filter (precip_mm >= 38) as extreme_days from climate group by 1, 2"


def label_matrix(spark, d):
    """Every transect at every pair of neighbouring surveys, without a label."""
    transects = k.cells(spark, d).select("transect_idx").distinct()
    return labelstore.empty_labels(transects, k.years(spark, d))


LABEL_MATRIX = f"with {k.CELLS}, {k.YEARS}, t as (select distinct transect_idx from cells) select transect_idx, cast(p as integer) as pair, -1 as label from t, range(0, (select count(*) - 1 from years)) r(p)"


def queue_progress(spark, d):
    """How many events of the queue have a label, and the first that has none."""
    q = event_queue_pairs(spark, d)
    labels = q.where("event_id % 3 <> 1").select("transect_idx", "pair", (F.col("event_id") % 3 - 1).cast("int").alias("label"))
    return views.queue_progress(q, labels, ["transect_idx", "pair"])


QUEUE_PROGRESS = f"with q as ({EVENT_QUEUE_PAIRS}) select count(*) as total, count(*) filter (event_id % 3 = 2) as labeled, min(position) filter (event_id % 3 <> 2) as next_position from q"


def _predicted(spark, d):
    e = k.slumps(spark, d)
    logits = F.array(*[F.col(c) / 5 for c in ("height", "width", "elevation", "vol_unc")], F.lit(9.0))
    return e.select(
        lab.risk_index(F.col("volume"), F.col("height")).alias("risk"), (F.col("width") / 6).alias("risk_pred"), F.when(F.col("event_id") % 4 > 0, 1.0).otherwise(0.5).alias("confidence"), lab.volume_class(F.col("volume")).alias("event_class"), logits.alias("logits")
    )


def training_losses(spark, d):
    return _round(views.losses(_predicted(spark, d), [0.5, 1.0, 1.0, 2.0]), "loss_risk", "loss_event_class", "loss")


LOSSES = f"""with {k.SLUMPS}, x as (select abs(width / 6 - 1 / (1 + exp(-0.5 * (ln(1 + volume) * least(greatest(1 + 0.05 * (height - 15), 0.5), 2) - 4)))) as off, case when event_id % 4 > 0 then 1.0 else 0.5 end::double as sure,
 case when volume < 10 then 0 when volume < 50 then 1 when volume < 200 then 2 else 3 end as c, [height / 5, width / 5, elevation / 5, vol_unc / 5] as l from slumps),
y as (select case when off < 1 then 0.5 * off * off else off - 0.5 end * sure as r, ln(exp(l[1]) + exp(l[2]) + exp(l[3]) + exp(l[4])) - l[c + 1] as e, [0.5, 1.0, 1.0, 2.0][c + 1]::double as w from x),
z as (select avg(r) as a, sum(w * e) / sum(w) as b from y) select round(a, 6) as loss_risk, round(b, 6) as loss_event_class, round(a + b, 6) as loss from z"""


def points_voxel_corridor(spark, d):
    """Points of lines through ten origins, 30 both ways and 3 wide, with ten points at least."""
    origins = spark.range(10).select(F.col("id").cast("int").alias("tr_id"), F.lit(50.0).alias("ox"), (5.0 + 4 * F.col("id")).alias("oy"), F.lit(0.8).alias("nx"), F.lit(0.6).alias("ny"))
    x = views.voxel_corridor(k.points(spark, d), origins, 30.0, 3.0, 1.0, 10)
    return _round(x.groupBy("tr_id").agg(F.count("*").alias("n"), F.min("distance").alias("first"), F.max("distance").alias("last"), F.avg("z").alias("z")), "first", "last", "z", digits=4)


VOXEL_CORRIDOR = f"""with {k.POINTS}, o as (select i::integer as tr_id, 50.0::double as ox, 5.0::double + 4 * i as oy from range(0, 10) t(i)),
c as (select tr_id, (x - ox) * 0.8::double + (y - oy) * 0.6::double as d, abs((x - ox) * 0.6::double - (y - oy) * 0.8::double) as p, z from points, o),
s as (select * from c where d between -30 and 30 and p <= 1.5 and (d - round_even(d, 0)) ** 2 + p ** 2 <= 2.25)
select tr_id, count(*) as n, round(min(d), 4) as first, round(max(d), 4) as last, round(avg(z), 4) as z from s group by 1 having count(*) >= 10"""


def event_overlap_counts(spark, d):
    """With how many slumps of its transect each slump overlaps."""
    days = lambda c: F.datediff(F.col(c), F.lit("1995-01-01").cast("date"))
    s = k.slumps(spark, d).select("event_id", "transect_idx", days("start_date").alias("lo"), days("end_date").alias("hi"))
    return views.overlap_counts(s, ["transect_idx"], "lo", "hi", "event_id", 90)


OVERLAP_COUNTS = f"with {k.SLUMPS}, s as (select * from slumps) select x.transect_idx, x.event_id, count(*) - 1 as n from s x join s y on x.transect_idx = y.transect_idx and x.start_date <= y.end_date and y.start_date <= x.end_date group by 1, 2"


def expected_columns(spark, d):
    """Expected features of which the climate rows hold no value at all."""
    want = spark.createDataFrame([(x,) for x in ("precip_mm", "temp_mean_c", "dewpoint_c", "humidity", "sxy")], "name string")
    c = k.climate(spark, d)
    values = [x for x in c.columns if x not in ("beach", "date")]
    have = c.unpivot(["beach", "date"], values, "name", "value").where("value is not null").select("name").distinct()
    return want.join(have, "name", "left_anti")


FEATURES_MISSING = f"""with {k.CLIMATE}, have as (select distinct name from (select unnest(['precip_mm', 'temp_mean_c', 'temp_min_c', 'temp_max_c', 'dewpoint_c']) as name, unnest([precip_mm, temp_mean_c, temp_min_c, temp_max_c, dewpoint_c]) as v from climate) where v is not null)
select name from (values ('precip_mm'), ('temp_mean_c'), ('dewpoint_c'), ('humidity'), ('sxy')) w(name) where name not in (select name from have)"""


QUERIES = {
    "coverage_by_beach": (coverage_by_beach, COVERAGE_BY_BEACH), "dataset_validation": (dataset_validation, VALIDATION), "transects_compared": (transects_compared, COMPARED), "mop_range": (mop_range, MOP_RANGE),
    "wave_storm_months": (wave_storm_months, STORM_MONTHS), "climate_annual": (climate_annual, ANNUAL), "label_matrix": (label_matrix, LABEL_MATRIX), "queue_progress": (queue_progress, QUEUE_PROGRESS),
    "training_losses": (training_losses, LOSSES), "points_voxel_corridor": (points_voxel_corridor, VOXEL_CORRIDOR), "event_overlap_counts": (event_overlap_counts, OVERLAP_COUNTS), "expected_columns": (expected_columns, FEATURES_MISSING),
}
