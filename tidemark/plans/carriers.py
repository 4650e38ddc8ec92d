"""Domain tables read from the driver's tables, as DataFrames and as SQL for the oracle.

Waves come from ``events``, daily climate and survey cells from ``orders``,
points from ``lineitem``, profiles from ``embeddings``, slumps from ``orders``
joined with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BEACHES = [("blacks", 520, 567), ("torrey", 567, 581), ("delmar", 595, 620), ("solana", 637, 666), ("sanelijo", 683, 708), ("encinitas", 708, 764)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mop_id, ts, hs, tp, dp, event_id."""
    return read(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 20).alias("mop_id"), "ts", F.col("value").alias("hs"), (5 + (F.col("event_id") % 100) / 10).alias("tp"), F.pmod(F.col("value") * 7.3, F.lit(360.0)).alias("dp")
    )


WAVES = "waves as (select event_id, user_id % 20 as mop_id, ts, value as hs, 5 + (event_id % 100) / 10.0::double as tp, (value * 7.3) % 360.0::double as dp from events)"


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beach, date and daily climate, from whole cents so that sums are exact."""
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("beach"), F.to_date("o_orderdate").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    d = o.groupBy("beach", "date").agg(F.sum("c").alias("c"))
    c = F.col("c")
    mean = (c % 3000) / 100.0 - 2.0
    return d.select(
        "beach", "date", F.when(c % 3 == 0, (c % 4000) / 100.0).otherwise(0.0).alias("precip_mm"), mean.alias("temp_mean_c"), (mean - (c % 700) / 100.0).alias("temp_min_c"),
        (mean + (c % 500) / 100.0).alias("temp_max_c"), F.when(c % 11 != 0, mean - (c % 1100) / 100.0).alias("dewpoint_c"),
    )


CLIMATE = """
cents as (select o_custkey % 3 as beach, cast(o_orderdate as date) as date, sum(cast(round(o_totalprice * 100) as bigint))::bigint as c from orders group by all),
climate as (select beach, date, case when c % 3 = 0 then (c % 4000) / 100.0::double else 0.0::double end as precip_mm, (c % 3000) / 100.0::double - 2.0 as temp_mean_c,
  (c % 3000) / 100.0::double - 2.0 - (c % 700) / 100.0::double as temp_min_c, (c % 3000) / 100.0::double - 2.0 + (c % 500) / 100.0::double as temp_max_c,
  case when c % 11 <> 0 then (c % 3000) / 100.0::double - 2.0 - (c % 1100) / 100.0::double end as dewpoint_c from cents)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transect, label, i, distance, elevation."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("transect"), "label", F.posexplode("embedding").alias("i", "z")).select(
        "transect", "label", "i", (F.col("i") * 0.5).alias("distance"), (F.col("z").cast("double") * 100).alias("elevation")
    )


PROFILES = """
profiles as (select vec_id as transect, label, i::integer - 1 as i, (i - 1) * 0.5::double as distance, embedding[i]::double * 100 as elevation
  from embeddings, range(1, 65) t(i) where i <= len(embedding))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """las_source, x, y, z and attributes."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("las_source"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("z"), F.col("l_tax").alias("intensity"), F.col("l_linenumber").alias("classification")
    )


POINTS = "points as (select l_suppkey as las_source, l_extendedprice / 1000 as x, l_quantity as y, l_discount as z, l_tax as intensity, l_linenumber as classification from lineitem)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transect_idx (0..49), epoch_idx (year - 1995), value, n: covered survey cells.

    Orders are no surveys, and every transect would be covered in every year.  So
    a rule of coverage stands in for missed surveys: it is part of what a cell
    is, and the SQL has it too.
    """
    o = read(spark, sf_dir, "orders").where("o_custkey % 7 <> year(o_orderdate) % 5")
    return o.groupBy((F.col("o_custkey") % 50).cast("int").alias("transect_idx"), (F.year("o_orderdate") - 1995).alias("epoch_idx")).agg(
        F.max(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n")
    ).where("cents % 4 <> 0")


CELLS = """
cells as (select cast(o_custkey % 50 as integer) as transect_idx, cast(year(o_orderdate) - 1995 as integer) as epoch_idx, max(cast(round(o_totalprice * 100) as bigint)) as cents, count(*) as n
  from orders where o_custkey % 7 <> year(o_orderdate) % 5 group by all having max(cast(round(o_totalprice * 100) as bigint)) % 4 <> 0)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, mop: points to look up in the beach ranges."""
    return read(spark, sf_dir, "customer").select("c_custkey", (500 + F.col("c_custkey") % 300).cast("int").alias("mop"))


PROBES = "probes as (select c_custkey, cast(500 + c_custkey % 300 as integer) as mop from customer)"


def beaches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, a, b) for i, (n, a, b) in enumerate(BEACHES)], "beach_order int, beach string, mop_lo int, mop_hi int")


BEACH_ROWS = "beaches(beach_order, beach, mop_lo, mop_hi) as (values " + ", ".join(f"({i}, '{n}', {a}, {b})" for i, (n, a, b) in enumerate(BEACHES)) + ")"


def slumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, transect_idx, start, end (days), volume, height."""
    o = read(spark, sf_dir, "orders")
    end = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"))
    start = F.to_date("o_orderdate")
    return o.join(end, "o_orderkey").select(
        F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 50).cast("int").alias("transect_idx"), start.alias("start_date"), F.greatest(start, F.date_add(start, F.col("o_orderkey").cast("int") % 90)).alias("end_date"),
        (F.round(F.col("o_totalprice") * 100).cast("long") % 30000 / 100.0).alias("volume"), (F.col("o_orderkey") % 40).cast("double").alias("height"), (F.col("o_custkey") % 9).cast("double").alias("vol_unc"),
        (F.col("o_orderkey") % 17).cast("double").alias("elevation"), (F.col("o_orderkey") % 13).cast("double").alias("width"),
    )


SLUMPS = """
slumps as (select o_orderkey as event_id, cast(o_custkey % 50 as integer) as transect_idx, cast(o_orderdate as date) as start_date, cast(o_orderdate as date) + cast(o_orderkey % 90 as integer) as end_date,
  cast(round(o_totalprice * 100) as bigint) % 30000 / 100.0::double as volume, (o_orderkey % 40)::double as height, (o_custkey % 9)::double as vol_unc, (o_orderkey % 17)::double as elevation, (o_orderkey % 13)::double as width
  from orders where o_orderkey in (select l_orderkey from lineitem))"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch_idx, epoch_date: the first day of every third month."""
    months = read(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "quarter").alias("epoch_date")).distinct()
    from pyspark.sql import Window

    return months.select("epoch_date", (F.row_number().over(Window.orderBy("epoch_date")) - 1).cast("int").alias("epoch_idx"))


EPOCHS = "epochs as (select epoch_date, cast(row_number() over (order by epoch_date) - 1 as integer) as epoch_idx from (select distinct cast(date_trunc('quarter', o_orderdate) as date) as epoch_date from orders))"


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch_idx (year - 1995) and epoch_date, its first day: the epochs of ``cells``."""
    year = F.year("o_orderdate")
    return read(spark, sf_dir, "orders").select((year - 1995).alias("epoch_idx"), F.make_date(year, F.lit(1), F.lit(1)).alias("epoch_date")).distinct()


YEARS = "years as (select distinct cast(year(o_orderdate) - 1995 as integer) as epoch_idx, make_date(year(o_orderdate), 1, 1) as epoch_date from orders)"

#: Slumps by the cell they end at (needs CELLS, SLUMPS and YEARS).
ALIGNED = """aligned as (select s.*, b.epoch_idx as eb, a.epoch_idx as ea from (select *, (select max(epoch_date) from years where epoch_date <= start_date) as d1, (select min(epoch_date) from years where epoch_date >= end_date) as d2 from slumps) s
  join years b on b.epoch_date = s.d1 join years a on a.epoch_date = s.d2 join cells x on x.transect_idx = s.transect_idx and x.epoch_idx = b.epoch_idx join cells y on y.transect_idx = s.transect_idx and y.epoch_idx = a.epoch_idx where b.epoch_idx < a.epoch_idx),
grouped as (select transect_idx, eb, ea, sum(volume) as v from aligned group by all),
by_cell as (select transect_idx, ea as epoch_idx, sum(v) as v, arg_min(case when v < 10 then 0 when v < 50 then 1 when v < 200 then 2 else 3 end, eb) as c from grouped group by 1, 2)"""
