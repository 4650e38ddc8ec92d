"""Structured Streaming forms of the wave operators (an addition: the batch forms have the same semantics)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.waves import circular_mean


def resample_stream(waves: DataFrame, hours: int = 6, late: str = "12 hours") -> DataFrame:
    """Means in tumbling bins; a bin closes when the watermark passes it, later rows are dropped."""
    w = waves.withWatermark("ts", late).groupBy("mop_id", F.window("ts", f"{hours} hours").alias("w"))
    out = w.agg(F.avg("hs").alias("hs"), F.avg("tp").alias("tp"), circular_mean(F.col("dp")).alias("dp"), F.count("*").alias("n"))
    return out.select("mop_id", F.col("w.start").alias("slot"), "hs", "tp", "dp", "n")


def storm_stream(waves: DataFrame, threshold: float = 2.0, gap: str = "12 hours", late: str = "12 hours") -> DataFrame:
    """Sessions of rows at or above the threshold."""
    s = waves.where(F.col("hs") >= threshold).withWatermark("ts", late).groupBy("mop_id", F.session_window("ts", gap).alias("w"))
    out = s.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("hs").alias("peak"), F.count("*").alias("n_rows"))
    return out.select("mop_id", "start", "end", "peak", "n_rows")


def dry_day_stream(daily: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Days since rain for each beach, as days arrive in order: beach, date, days_since_rain.

    The state is one counter a beach.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("date")
        out = []
        for p in rows["precip_mm"]:
            n = 0 if p is not None and p >= threshold else n + 1
            out.append(n)
        state.update((n,))
        yield pd.DataFrame({"beach": key[0], "date": rows["date"].to_numpy(), "days_since_rain": out})

    return daily.groupBy("beach").applyInPandasWithState(
        step, "beach long, date date, days_since_rain long", "n long", "append", GroupStateTimeout.NoTimeout
    )
