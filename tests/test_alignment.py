"""As-of joins over time buckets, bracketing, and labels of summed volumes, against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import history, joins, samples

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_asof_carries_over_buckets(spark):
    rng = random.Random(3)
    for by in ([], ["k"]):
        left = [(i, rng.choice("ab"), None if i == 7 else rng.randint(0, 300)) for i in range(150)] + [(200, None, 10)]
        right = [(rng.choice("ab") if i else None, rng.choice([0, 3, 5, 40, 90, 290]) + rng.randint(0, 2), i) for i in range(25)]
        l, r = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, u int, v int")
        for back in (True, False):
            for strict in (True, False):
                for width in (7.0, 1000.0):
                    out = joins.asof_join(l, r, by, "t", "u", ["v"], "backward" if back else "forward", strict, width)
                    got = {x["i"]: x["v"] for x in out.collect()}
                    for i, k, t in left:
                        ok = [(u, v) for q, u, v in right if t is not None and (not by or q == k and q is not None) and ((u < t or u == t and not strict) if back else (u > t or u == t and not strict))]
                        assert got[i] == ((max(ok) if back else min(ok))[1] if ok else None), (i, by, back, strict)
    dates = joins.asof_join(spark.createDataFrame([(day(400),)], "d date"), spark.createDataFrame([(day(0), 1), (day(30), 2)], "e date, v int"), [], "d", "e", ["v"])
    assert dates.first()["v"] == 2


def test_bracket(spark):
    epochs = spark.createDataFrame([(i, day(d)) for i, d in enumerate((0, 100, 200, 900))], "epoch_idx int, epoch_date date")
    events = [(1, 100, 100), (2, 99, 101), (3, -1, 50), (4, 150, 901), (5, 100, 200), (6, 201, 202)]
    e = spark.createDataFrame([(i, day(a), day(b)) for i, a, b in events], "i int, start_date date, end_date date")
    got = {r["i"]: (r["epoch_before"], r["epoch_after"]) for r in joins.bracket(e, epochs, "start_date", "end_date", "epoch_date", "epoch_idx").collect()}
    assert got == {2: (0, 2), 5: (1, 2), 6: (2, 3)}  # equal epochs, none before, none after go


EVENTS = "event_id int, transect_idx int, start_date date, end_date date, volume double, vol_unc double, elevation double, width double, height double"


def test_classes_of_summed_volumes(spark):
    epochs = spark.createDataFrame([(i, day(100 * i)) for i in range(6)], "epoch_idx int, epoch_date date")
    cells = spark.createDataFrame([(t, e, 20.0) for t in (1, 2) for e in range(6) if (t, e) != (2, 1)], "transect_idx int, epoch_idx int, value double")
    rows = [
        (1, 1, 310, 320, 30.0), (2, 1, 330, 350, 30.0),  # two minor ones of one cell make a major one
        (3, 1, 210, 390, 6.0),  # an earlier epoch before, the same after: its class counts, its volume adds up
        (4, 2, 10, 20, 300.0), (5, 2, 110, 120, 300.0),  # epoch 1 isn't covered there, after or before
        (6, 2, 410, 420, 5.0),
    ]
    events = spark.createDataFrame([(i, t, day(a), day(b), v, 1.0, 1.0, 1.0, 1.0) for i, t, a, b, v in rows], EVENTS)
    cell = {(r["transect_idx"], r["epoch_idx"]): (r["volume"], r["event_class"]) for r in history.events_by_cell(history.align_events(events.where("event_id <> 3"), epochs, cells)).collect()}
    assert cell == {(1, 4): (60.0, 2), (2, 5): (5.0, 0)}
    by_cell = history.events_by_cell(history.align_events(events, epochs, cells))
    assert {(r["transect_idx"], r["epoch_idx"]): (r["volume"], r["event_class"]) for r in by_cell.collect()} == {(1, 4): (66.0, 0), (2, 5): (5.0, 0)}
    out = {(r["transect_idx"], r["target_epoch"]): r for r in history.training_samples(cells, by_cell, least=3).collect()}
    assert set(out) == {(1, 3), (1, 4), (1, 5), (2, 4), (2, 5)}
    assert (out[1, 4]["total_volume"], out[1, 4]["event_class"], out[1, 4]["confidence"], out[1, 3]["confidence"]) == (66.0, 0, 1.0, 0.5)
    assert out[1, 4]["collapse"] == [1, 1, 1, 1] and out[2, 5]["collapse"] == [0, 0, 0, 0]
    labelled = {(r["transect_idx"], r["epoch_idx"]): r for r in samples.label_cells(cells.withColumn("value", F.col("value") + F.col("epoch_idx")), by_cell, "value").collect()}
    assert labelled[1, 0]["height"] == 15 and labelled[1, 4]["height"] == 23 and labelled[2, 2]["height"] == 20 and len(labelled) == 11
