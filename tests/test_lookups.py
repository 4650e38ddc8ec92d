"""Look-ups beyond a profile's ends, empty profiles, pruning, padding and weights on small tables."""

import math

from pyspark.sql import functions as F

from tidemark.functions import labels as lab
from tidemark.operators import history, lookups


def test_value_at_ends_and_between(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 5.0), (1, 1.0, None), (2, None, 3.0)], "p int, x double, v double")
    line = lookups.lines_of(rows, ["p"], "x", "v")
    got = line.select(*[lookups.value_at(F.lit(a), F.col("points")).alias(n) for a, n in ((-3.0, "a"), (0.5, "b"), (2.0, "c"), (9.0, "d"))]).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0, 5.0, 5.0)]  # the profile without whole points gives no row


def test_interpolation_outside_is_null(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 5.0)], "p int, x double, v double")
    line = lookups.lines_of(rows, ["p"], "x", "v")
    assert line.select(history.interpolated(F.lit(-1.0), F.col("points")).alias("v")).first().v is None


def test_change_without_shared_values_is_zero(spark):
    first = spark.createDataFrame([(1, 0.0, 1.0)], "p int, x double, v double")
    second = spark.createDataFrame([(1, 4.0, None)], "p int, x double, v double")
    assert tuple(lookups.change_on_second(first, second, ["p"], "x", "v").first()) == (1, 0.0, 0.0, 0.0, 0.0)


def test_files_without_bounds_stay_and_none_without_lines(spark):
    files = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", None, None, None, None), ("c", 50.0, 0.0, 60.0, 1.0)], "f string, x_min double, y_min double, x_max double, y_max double")
    lines = spark.createDataFrame([(5.0, 0.0, 3.0, 2.0)], "x0 double, y0 double, x1 double, y1 double")
    assert {r.f for r in lookups.prune_files(files, lines, 2.0).collect()} == {"a", "b"}
    assert {r.f for r in lookups.prune_files(files, lines, 1.0).collect()} == {"b"}


def test_metadata_of_a_profile_without_valid_bins(spark):
    bins = spark.createDataFrame([(1, 3, False, 2.0, 1.0), (1, 4, False, 9.0, -4.0), (2, 0, True, 1.0, -2.0), (2, 1, False, 7.0, 8.0), (2, 2, True, 4.0, 1.0)], "p int, bin int, valid boolean, mean double, slope double")
    got = {r.p: tuple(r)[1:] for r in lookups.voxel_metadata(bins, ["p"]).collect()}
    assert got == {1: (0.0, 1.0, 1.0, 2.0), 2: (3.0, 1.5, 2.0, 1.0)}


def test_weights_and_report(spark):
    rows = spark.createDataFrame([(1, 0, True), (2, 0, False), (3, 1, None)], "id int, c int, seen boolean")
    got = {r.id: r.weight for r in lookups.sample_weights(rows, "id", "c", F.col("seen")).collect()}
    assert got == {1: 0.75, 2: 0.5, 3: 1.0}
    report = lookups.quality_report({"seen": (rows, F.col("seen")), "none": (rows.where("id > 9"), F.col("seen"))})
    assert {r.check: (r.n_checked, r.n_failed, r.passed) for r in report.collect()} == {"seen": (3, 2, False), "none": (0, 0, True)}


def test_density_sums_to_one(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 9.0), ("b", None)], "g string, v double")
    got = lookups.density(rows, ["g"], "v", 3).groupBy("g").agg(F.sum("density").alias("s")).collect()
    assert all(math.isclose(r.s * 3, 1) for r in got) and len(got) == 2


def test_names(spark):
    rows = spark.createDataFrame([("MOP 520_001",), ("mop 7a8_3",), ("none",), (None,), ("20200230_x",), ("20200211_x",), ("20200211.x",)], "n string")
    got = [tuple(r) for r in rows.select(lab.mop_base(F.col("n")), lab.survey_date(F.col("n")).cast("string"), lab.mapped_path(F.col("n"), {"MOP ": "M/"})).collect()]
    assert [g[0] for g in got] == [520, 78, None, None, 20200230, 20200211, 20200211]
    assert [g[1] for g in got] == [None, None, None, None, None, "2020-02-11", None]
    assert got[0][2] == "M/520_001" and got[3][2] is None


def test_long_paths_are_kept_whole(spark):
    path = "/a/" + "x" * 30_000
    got = spark.createDataFrame([(path,)], "p string").select(lab.mapped_path(F.col("p"), {"/a/": "/b/"}).alias("p")).first().p
    assert got == "/b/" + "x" * 30_000


def test_aliases_take_the_first_there(spark):
    rows = spark.createDataFrame([(1.0, 2.0)], "Hs double, hs_ double")
    got = lookups.with_aliases(rows, {"hs": ("waveHs", "Hs", "hs_"), "tp": ("waveTp",)}).first()
    assert tuple(got) == (1.0, None)


def test_events_of_a_cell_or_the_queue(spark):
    cells = spark.createDataFrame([(1, 0), (2, 0)], "t int, e int")
    events = spark.createDataFrame([(7, 1, 0, 5.0), (6, 1, 0, 5.0), (9, 3, 0, 50.0)], "id int, t int, e int, v double")
    pick = lambda ev: {(r.t, r.id, r.source) for r in lookups.events_or_queued(cells, ev, ["t", "e"], "id", "v").collect()}
    assert pick(events) == {(1, 6, "cell"), (2, 9, "queue")}
    assert pick(events.where("id > 99")) == {(1, None, "queue"), (2, None, "queue")}
