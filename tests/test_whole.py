"""Registered queries give a row for every row that they should judge."""

from tidemark.plans import carriers as k
from tidemark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_event_has_its_asof_row(spark):
    for name in ("event_asof_wave", "event_forward_wave"):
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_every_event_is_a_scan(spark):
    for name in ("wave_lookback", "wave_lookback_filled", "wave_tensor"):
        assert QUERIES[name](spark, SF).count() == 20 * spark.read.parquet(f"{SF}/events.parquet").count()


def test_every_source_and_point_is_binned_and_normalised(spark):
    for name in ("points_voxels", "points_normalised"):
        assert QUERIES[name](spark, SF).agg({"n": "sum"}).first()[0] == k.points(spark, SF).count()


def test_every_slump_is_counted_and_cell_labelled(spark):
    assert QUERIES["event_overlap_counts"](spark, SF).count() == k.slumps(spark, SF).count()
    assert QUERIES["event_overlap"](spark, SF).count() * 2 == QUERIES["event_overlap_counts"](spark, SF).agg({"n": "sum"}).first()[0]
    assert QUERIES["cube_labels"](spark, SF).count() == k.cells(spark, SF).count()


def test_every_site(spark):
    assert QUERIES["wave_ecdf"](spark, SF).select("mop_id").distinct().count() == k.waves(spark, SF).select("mop_id").distinct().count()
