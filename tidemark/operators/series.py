"""Time-series operators: windows, sessions, recurrences, slots, gap filling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import climate as c
from ..functions import waves as w


def _rows(by: list[str], order: str, n: int):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)


def rolling_sum(x: Column, by: list[str], order: str, n: int) -> Column:
    """Over the last n rows; missing values count as 0."""
    return F.sum(F.coalesce(x, F.lit(0))).over(_rows(by, order, n))


def rolling_max(x: Column, by: list[str], order: str, n: int) -> Column:
    return F.max(x).over(_rows(by, order, n))


def rolling_mean(x: Column, by: list[str], order: str, n: int) -> Column:
    return F.avg(x).over(_rows(by, order, n))


def rolling_days_mean(x: Column, by: list[str], date: str, days: int) -> Column:
    """Over the last so many days, by date rather than by row."""
    day = F.unix_date(F.col(date))
    return F.avg(x).over(Window.partitionBy(*by).orderBy(day).rangeBetween(-(days - 1), 0))


def transitions(flag: Column, by: list[str], order: str, n: int) -> Column:
    """Falls of a 0/1 flag from 1 to 0 within the last n rows; needs ``_fell`` from ``with_falls``."""
    return F.sum(flag).over(_rows(by, order, n))


def with_falls(df: DataFrame, flag: Column, by: list[str], order: str, name: str) -> DataFrame:
    """Append 1 where the flag was 1 in the row before and is 0 now."""
    order_w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_flag", flag).withColumn(name, F.when((F.lag("_flag").over(order_w) == 1) & (F.col("_flag") == 0), 1).otherwise(0)).drop("_flag")


#: Rows of a block of ``recurrence``, and the power of ten that a block's powers may reach.
ROWS, POWER = 64, 280


def recurrence(df: DataFrame, by: list[str], order: str, x: str, k: float, name: str) -> DataFrame:
    """y[t] = x[t] + k * y[t-1], missing x as 0; rows of one ``order`` follow each other by x.

    Every step is an affine map, and maps compose.  Rows are numbered in blocks
    of at most ROWS; within one, y is k**i times the running sum of x * k**-i,
    and a block's end carries over with the power k**ROWS, by the same rule over
    blocks of blocks, until a power is too small to count.  Windows over a key
    do it all: no series is held, and rows keep their columns, repeats and nulls.
    """
    value = F.coalesce(F.col(x), F.lit(0.0)).cast("double")
    at = Window.partitionBy(*by).orderBy(order, x)
    out = df.withColumn("_x", value).withColumn("_i", F.row_number().over(at) - 1)
    if k == 0:
        return out.withColumn(name, F.col("_x")).drop("_x", "_i")
    if k == 1:
        return out.withColumn(name, F.sum("_x").over(at.rowsBetween(Window.unboundedPreceding, 0))).drop("_x", "_i")
    # at each level rows form units of ``span``, whose y so far takes in what lies before them in their block
    span, log, sign = 1, math.log10(abs(k)), -1.0 if k < 0 else 1.0
    ends = F.col("_x")
    out = out.withColumn("_y", F.col("_x"))
    whole = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    while span < 1 << 40 and abs(log) * span < POWER:
        n = max(2, min(ROWS, int(POWER / max(1e-9, abs(log) * span))))
        unit, factor = F.floor(F.col("_i") / span), sign ** (span % 2) * 10.0 ** (log * span)
        out = out.withColumn("_p", unit % n).withColumn("_k", F.floor(unit / n)).withColumn("_e", ends)
        here = Window.partitionBy(*by, "_k").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.col("_e") / _raised(factor, F.col("_p"))).over(here), F.lit(0.0))  # by the ends of earlier units
        carried = _raised(factor, F.col("_p") - 1) * before
        out = out.withColumn("_y", F.col("_y") + F.when(F.col("_p") > 0, _raised(k, F.col("_i") % span + 1) * carried).otherwise(0.0))
        span *= n
        ends = F.when(F.col("_i") % span == span - 1, F.col("_y"))
    if abs(log) * span >= POWER:  # what lies before the last unit no longer counts
        last = F.coalesce(F.last(ends, True).over(whole), F.lit(0.0))
        out = out.withColumn("_y", F.col("_y") + _raised(k, F.col("_i") % span + 1) * last)
    return out.withColumn(name, F.col("_y")).drop("_x", "_i", "_p", "_k", "_e", "_y")


def _raised(k: float, e: Column) -> Column:
    size = F.pow(F.lit(abs(k)), e)
    return size if k > 0 else size * F.when(e % 2 == 0, 1.0).otherwise(-1.0)


def days_since(df: DataFrame, event: Column, by: list[str], order: str, name: str) -> DataFrame:
    """Rows since the last event row (0 on one), counted from the series' start before the first."""
    o = Window.partitionBy(*by).orderBy(order)
    numbered = df.withColumn("_n", F.row_number().over(o)).withColumn("_e", F.when(event, F.col("_n")))
    last = F.last("_e", True).over(o.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn(name, F.col("_n") - F.coalesce(last, F.lit(0))).drop("_n", "_e")


def dry_days_before(df: DataFrame, event: Column, by: list[str], order: str, name: str) -> DataFrame:
    """``days_since`` of the row before; 0 in the first row."""
    o = Window.partitionBy(*by).orderBy(order)
    return days_since(df, event, by, order, "_since").withColumn(name, F.coalesce(F.lag("_since").over(o), F.lit(0))).drop("_since")


def seasonal_count(df: DataFrame, flag: str, by: list[str], date: str, name: str) -> DataFrame:
    """Running sum of a flag that starts anew with each water year."""
    y = df.withColumn("_wy", c.water_year(F.col(date)))
    run = Window.partitionBy(*by, "_wy").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return y.withColumn(name, F.sum(flag).over(run)).drop("_wy")


def storms(waves: DataFrame, by: list[str], ts: str = "ts", hs: str = "hs", threshold: float = 2.0, gap_hours: float = 12.0) -> DataFrame:
    """One row a storm: runs of rows at or above the threshold, joined over gaps of at most ``gap_hours``.

    by, storm (from 1), start, end, hours, peak, n_rows.  A run that continues
    from the row before never opens a storm, whatever the time between them.
    """
    o = Window.partitionBy(*by).orderBy(ts)
    high = waves.withColumn("_n", F.row_number().over(o)).where(F.col(hs) >= threshold)
    seconds = F.col(ts).cast("timestamp").cast("double")
    apart = seconds - F.lag(seconds).over(o)
    adjacent = F.col("_n") - F.lag("_n").over(o) == 1
    opened = high.withColumn("_new", F.when(F.lag(ts).over(o).isNull() | (~adjacent & (apart > gap_hours * 3600)), 1).otherwise(0))
    numbered = opened.withColumn("storm", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    s = lambda x: F.col(x).cast("timestamp").cast("double")
    out = numbered.groupBy(*by, "storm").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.max(hs).alias("peak"), F.count("*").alias("n_rows"))
    return out.withColumn("hours", (s("end") - s("start")) / 3600)


def resample(waves: DataFrame, by: list[str], hours: int = 6, ts: str = "ts") -> DataFrame:
    """Means of hs and tp and the circular mean of dp in calendar-aligned bins; empty bins are left out."""
    bins = waves.groupBy(*by, F.window(ts, f"{hours} hours").alias("_w"))
    out = bins.agg(F.avg("hs").alias("hs"), F.avg("tp").alias("tp"), w.circular_mean(F.col("dp")).alias("dp"))
    return out.select(*by, F.col("_w.start").alias("slot"), "hs", "tp", "dp").where("hs is not null or tp is not null or dp is not null")


#: Scans of a group of ``_lookback`` whose slots are worked out at once.
SCANS = 4096


def _lookback(scans: DataFrame, series: DataFrame, by: list[str], scan_ts: str, ts: str, values: list[str], n: int, hours: int, key: list[str], fill: bool = False) -> DataFrame:
    """As ``lookback_slots``, with the scan's time in microseconds as ``_to``; ``fill`` fills gaps as ``fill_linear`` does.

    A scan is dealt once, by key and a time bucket a fifth of the look-back wide,
    a row to the five or six buckets whose scans may see it.  So a scan meets all
    its rows in one task, slots are formed there, and nothing else is shuffled.
    """
    step = hours * 3600 * 1_000_000
    span = step * max(1, n // 5)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(c / F.lit(span))
    t, keys = F.col("_t"), [f"_k{i}" for i in range(len(key))]
    asked = scans.select(*by, F.lit(True).alias("_scan"), micros(scan_ts).alias("_t"), *[F.col(c).alias(k) for c, k in zip(key, keys)], *[F.lit(None).cast("double").alias(v) for v in values])
    there = series.where(" and ".join(f"`{c}` is not null" for c in [*by, ts]))
    rows = there.select(*by, F.lit(False).alias("_scan"), micros(ts).alias("_t"), *[F.lit(None).cast(asked.schema[k].dataType).alias(k) for k in keys], *[F.col(v).cast("double").alias(v) for v in values])
    seen = F.explode(F.sequence(bucket(t), bucket(t + F.lit((n - 1) * step))))
    dealt = asked.withColumn("_w", bucket(t)).unionByName(rows.withColumn("_w", seen))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        is_scan = group["_scan"]
        held, marked = group.filter(pc.invert(is_scan)).sort_by("_t"), group.filter(is_scan).sort_by("_t")
        at, tops = held["_t"].to_numpy(), pc.fill_null(marked["_t"], 0).to_numpy()
        sums = [_running(held[v]) for v in values]
        for first in range(0, len(tops), SCANS):
            to = tops[first : first + SCANS]
            marks = to[:, None] + (np.arange(n + 1) - (n - 1)) * step
            marks[:, n] = to + 1
            border = np.searchsorted(at, marks)
            means = [_between(run, border[:, :-1], border[:, 1:]) for run in sums]
            means = [_filled(*m) for m in means] if fill else means
            part = marked.slice(first, SCANS).take(np.repeat(np.arange(len(to)), n))
            columns = [part[c].combine_chunks() for c in (*keys, "_t")] + [pa.array(np.tile(np.arange(n, dtype=np.int32), len(to)))]
            columns += [pa.array(m.ravel(), mask=~known.ravel(), from_pandas=False) for m, known in means]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "_to", "slot", *values])

    out = T.StructType([*[T.StructField(c, scans.schema[c].dataType) for c in key], T.StructField("_to", T.LongType()), T.StructField("slot", T.IntegerType()), *[T.StructField(v, T.DoubleType()) for v in values]])
    return dealt.groupBy(*by, "_w").applyInArrow(slots, out)


def _running(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums from 0 of a column's finite values (in extended precision), of its known values' number, and of NaN, inf and -inf."""
    x, known = pc.fill_null(column, 0.0).to_numpy(), pc.is_valid(column).to_numpy()
    run = lambda a, kind: np.concatenate([np.zeros((1, *a.shape[1:]), kind), np.cumsum(a, axis=0, dtype=kind)])
    odd = np.stack([np.isnan(x), x == np.inf, x == -np.inf], axis=1)
    return run(np.where(np.isfinite(x), x, 0.0), np.longdouble), run(known, np.int64), run(odd, np.int64) if odd.any() else None


def _between(run: tuple, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means between places of running sums, and where there is one."""
    total, count, odd = run
    number = count[hi] - count[lo]
    mean = (total[hi] - total[lo]).astype(np.float64) / np.maximum(number, 1)
    if odd is not None:
        no, up, down = np.moveaxis(odd[hi] - odd[lo] > 0, -1, 0)
        mean = np.where(up, np.inf, np.where(down, -np.inf, mean))
        mean = np.where(no | (up & down), np.nan, mean)
    return mean, number > 0


def _filled(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with their gaps filled by straight lines, end values carried outwards; a row without values has none."""
    n = x.shape[1]
    i = np.arange(n)
    a = np.maximum.accumulate(np.where(known, i, -1), axis=1)
    b = np.minimum.accumulate(np.where(known, i, n)[:, ::-1], axis=1)[:, ::-1]
    left, right = np.take_along_axis(x, np.maximum(a, 0), 1), np.take_along_axis(x, np.minimum(b, n - 1), 1)
    line = left + (right - left) * (i - a) / np.maximum(b - a, 1)
    return np.where(known, x, np.where(a < 0, right, np.where(b == n, left, line))), (a >= 0) | (b < n)


def lookback_slots(scans: DataFrame, series: DataFrame, by: list[str], scan_ts: str, ts: str, values: list[str], n: int, hours: int, key: list[str]) -> DataFrame:
    """key, slot 0..n-1, values: the means of each scan's series in n slots of ``hours``, the last of which starts at the scan.

    Slots start at the scan's own origin and nothing after the scan counts, so
    the last one holds rows of the scan's own time only.  A slot's mean is a
    difference of running sums and counts at its two boundaries, so work grows
    with rows and slots, not with their product.  Null keys and times match nothing.
    """
    return _lookback(scans, series, by, scan_ts, ts, values, n, hours, key).drop("_to")


def wave_tensor(scans: DataFrame, waves: DataFrame, by: list[str], scan_ts: str, n: int, hours: int, key: list[str], ts: str = "ts") -> DataFrame:
    """key, slot, hs, tp, dp, power, doy: the waves before each scan in n slots, without gaps.

    Means of a slot, of the direction by sine and cosine; gaps are filled by
    straight lines, both ends outwards.  Where a measure has no value in the
    whole window, all of the scan's are 0.  ``doy`` is the slot's day of the year.
    """
    angle = F.radians("dp")
    x = waves.select(*by, ts, "hs", "tp", w.power(F.col("hs"), F.col("tp")).alias("power"), F.sin(angle).alias("dp_sin"), F.cos(angle).alias("dp_cos"))
    values = ["hs", "tp", "power", "dp_sin", "dp_cos"]
    slots = _lookback(scans, x, by, scan_ts, ts, values, n, hours, key, fill=True)
    gap = F.greatest(*[F.col(v).isNull() for v in values])  # once filled, a measure is null in all slots or in none
    day = F.dayofyear(F.timestamp_micros(F.col("_to") - (F.lit(n - 1) - F.col("slot")) * F.lit(hours * 3_600_000_000)))
    known = lambda c: F.when(gap, 0.0).otherwise(c)
    dp = F.pmod(F.degrees(F.atan2("dp_sin", "dp_cos")), F.lit(360.0))
    return slots.select(*key, "slot", known(F.col("hs")).alias("hs"), known(F.col("tp")).alias("tp"), known(dp).alias("dp"), known(F.col("power")).alias("power"), day.alias("doy"))


def fill_linear(df: DataFrame, by: list[str], order: str, value: str, limit: int | None = None, extend: bool = True) -> DataFrame:
    """Fill nulls by straight lines over ``order``.

    ``extend`` carries the end values outwards; ``limit`` fills only the first so
    many nulls of a gap and carries the last value so far at the end.
    """
    o = Window.partitionBy(*by).orderBy(order)
    back, ahead = o.rowsBetween(Window.unboundedPreceding, 0), o.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("o"), F.col(value).cast("double").alias("v")))
    x = df.withColumn("_k", known).withColumn("_n", F.row_number().over(o))
    x = x.withColumn("_a", F.last("_k", True).over(back)).withColumn("_b", F.first("_k", True).over(ahead))
    x = x.withColumn("_at", F.last(F.when(F.col("_k").isNotNull(), F.col("_n")), True).over(back))
    at = F.col(order).cast("double")
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (at - F.col("_a.o")) / F.nullif(F.col("_b.o") - F.col("_a.o"), F.lit(0.0))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    if limit is None:
        out = F.when(both, F.coalesce(line, F.col("_a.v")))
        out = F.coalesce(out, F.col("_a.v"), F.col("_b.v")) if extend else out
    else:
        near = F.col("_n") - F.col("_at") <= limit
        out = F.when(F.col("_a").isNotNull() & near, F.when(both, F.coalesce(line, F.col("_a.v"))).otherwise(F.col("_a.v")))
    return x.withColumn(value, F.coalesce(F.col(value).cast("double"), out)).drop("_k", "_n", "_a", "_b", "_at")


def daily_window(scans: DataFrame, daily: DataFrame, by: list[str], scan_date: str, date: str, values: list[str], n: int, key: list[str], limit: int = 3) -> DataFrame:
    """key, day_no 0..n-1, values: the n days up to each scan.

    Only windows with missing rows are filled: lines over up to ``limit`` days,
    then the window's mean, then 0.  A complete window keeps its nulls.
    """
    days = scans.select(*key, *by, F.col(scan_date), F.posexplode(F.sequence(F.date_sub(scan_date, n - 1), F.col(scan_date))).alias("day_no", "_date"))
    found = days.join(daily.select(*by, F.col(date).alias("_date"), *values, F.lit(1).alias("_there")), [*by, "_date"], "left")
    whole = Window.partitionBy(*key)
    found = found.withColumn("_full", F.count("_there").over(whole) == n)
    for v in values:
        filled = fill_linear(found.withColumn("_v", F.col(v).cast("double")), key, "day_no", "_v", limit=limit, extend=False)
        mean = F.avg(v).over(whole)
        found = filled.withColumn(v, F.when(F.col("_full"), F.col(v)).otherwise(F.coalesce("_v", mean, F.lit(0.0)))).drop("_v")
    return found.select(*key, "day_no", F.col("_date").alias(date), *values)


def climate_features(daily: DataFrame, by: list[str], date: str = "date", k: float = 0.9) -> DataFrame:
    """Append the 24 climate features to daily precip_mm, temp_mean_c, temp_min_c, temp_max_c, dewpoint_c."""
    x = daily.withColumn("rain_day", c.rain_day(F.coalesce(F.col("precip_mm"), F.lit(0.0)))).withColumn("intensity_class", c.intensity_class(F.col("precip_mm")))
    for n in (7, 30, 60, 90):
        x = x.withColumn(f"precip_{n}d", rolling_sum(F.col("precip_mm"), by, date, n))
    x = recurrence(x, by, date, "precip_mm", k, "api")
    x = days_since(x, F.col("rain_day") == 1, by, date, "days_since_rain")
    x = dry_days_before(x, F.col("rain_day") == 1, by, date, "consecutive_dry_days")
    x = x.withColumn("max_precip_7d", rolling_max(F.col("precip_mm"), by, date, 7)).withColumn("max_precip_30d", rolling_max(F.col("precip_mm"), by, date, 30))
    x = with_falls(x, F.col("rain_day"), by, date, "_dried")
    x = x.withColumn("wet_dry_cycles_30d", transitions(F.col("_dried"), by, date, 30)).withColumn("wet_dry_cycles_90d", transitions(F.col("_dried"), by, date, 90)).drop("_dried")
    x = x.withColumn("vpd", c.vapour_deficit(F.col("temp_mean_c"), F.col("dewpoint_c"))).withColumn("vpd_7d_mean", rolling_mean(F.col("vpd"), by, date, 7))
    cold = F.coalesce(F.col("temp_min_c"), F.lit(999.0))
    x = x.withColumn("freeze_flag", c.freezing(cold)).withColumn("marginal_freeze_flag", c.freezing(cold, 2.0))
    x = with_falls(x, F.col("freeze_flag"), by, date, "_thawed")
    x = x.withColumn("freeze_thaw_30d", transitions(F.col("_thawed"), by, date, 30))
    return seasonal_count(x, "_thawed", by, date, "freeze_thaw_season").drop("_thawed")
