"""An optional level outside the chains: a station that reads higher or lower than it used to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.result import QCResult, apply_verdict
from . import kernels as K
from .temperature import _positive, _share, _whole, daily, default_day_obs


def running_median(x: np.ndarray, width: int) -> np.ndarray:
    """Medians of ``width`` values, an odd number; towards the ends of ever fewer, and at the ends by Tukey's rule."""
    half = width // 2
    if len(x) <= width or not half:
        return x
    kept = x.copy()
    kept[half : len(x) - half] = np.median(np.lib.stride_tricks.sliding_window_view(x, width), axis=1)
    out = kept.copy()
    for i in range(1, half):
        out[i], out[-1 - i] = np.median(kept[: 2 * i + 1]), np.median(kept[-1 - 2 * i :])
    for a, b, c in ((0, 1, 2), (-1, -2, -3)):
        out[a] = np.median([kept[a], out[b], 3 * out[b] - 2 * out[c]])
    return out


def day_anomalies(cells: DataFrame, min_obs: int, min_stations: int) -> DataFrame:
    """(station, day_idx, day, anomaly): a day's mean less the median of the other stations' means."""
    days = daily(cells, min_obs).select("station", "day", F.col("day_idx").alias("ts"), F.col("mean").alias("value"))
    net = K.loo_median(days).where((F.col("n_valid") >= min_stations) & F.col("value").isNotNull() & F.col("net").isNotNull())
    return net.select("station", F.col("ts").alias("day_idx"), "day", (F.col("value") - F.col("net")).alias("anomaly"))


def bias_shift(result: QCResult, bias_tol: float = 1.5, min_consecutive_days: int = 5, ref_days: int = 30, min_obs_per_day: int | None = None, min_stations: int = 3, max_network_frac: float = 0.25, code: int = 9) -> QCResult:
    """Days on end on which a station's smoothed anomaly has left that of its first days.

    A station's anomaly is its daily mean against the other stations; the
    median of the first ``ref_days`` judged days is its baseline.  Days on which
    two or more stations and over ``max_network_frac`` of them depart are
    weather: nobody is judged, and runs go on behind them.
    """
    key = "t9_bias_shift"
    _positive(bias_tol=bias_tol)
    _whole(1, min_consecutive_days=min_consecutive_days)
    _whole(5, ref_days=ref_days)
    min_obs = default_day_obs(result) if min_obs_per_day is None else min_obs_per_day
    _whole(2, min_obs_per_day=min_obs)
    _whole(3, min_stations=min_stations)
    _share(0, 1, "(]", max_network_frac=max_network_frac)
    if result.facts.n_stations < min_stations:
        return result.skip(key, f"only {result.facts.n_stations} stations")
    width = min_consecutive_days + (min_consecutive_days % 2 == 0)

    def smooth(table):
        table = table.sort_by("day_idx")
        return table.append_column("smooth", pa.array(running_median(table.column("anomaly").to_numpy(), width)))

    days = day_anomalies(result.cells, min_obs, min_stations).withColumn("place", F.row_number().over(Window.partitionBy("station").orderBy("day_idx")))
    # a row for each day of a station
    days = days.groupBy("station").applyInArrow(smooth, "station string, day_idx int, day date, anomaly double, place int, smooth double")
    first = days.groupBy("station").agg(F.count("*").alias("n_days"), F.percentile(F.when(F.col("place") <= ref_days, F.col("anomaly")), F.lit(0.5)).alias("baseline"))
    baseline = first.where(F.col("n_days") >= ref_days)
    seen = days.join(baseline, "station").withColumn("off", F.abs(F.col("smooth") - F.col("baseline")) > bias_tol)
    net = seen.groupBy("day_idx", "day").agg(F.count("*").alias("n"), F.count(F.when(F.col("off"), 1)).alias("n_off"))
    weather = net.where((F.col("n_off") >= 2) & (F.col("n_off") / F.col("n") > max_network_frac)).select("day_idx", "day")
    judged = seen.join(weather, "day_idx", "left_anti")
    by = Window.partitionBy("station").orderBy("day_idx")
    run = F.row_number().over(by) - F.row_number().over(Window.partitionBy("station", "off").orderBy("day_idx"))
    runs = judged.withColumn("run", run).where("off")
    episodes = runs.groupBy("station", "run").agg(
        F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.count("*").alias("days"), F.round(F.percentile("anomaly", F.lit(0.5)) - F.first("baseline"), 2).alias("shift")
    ).where(F.col("days") >= min_consecutive_days)
    bad = runs.join(episodes.select("station", "run"), ["station", "run"], "left_semi").select("station", "day_idx", F.lit(True).alias("hit"))
    there = F.col("value").isNotNull()
    marked = result.cells.join(judged.select("station", "day_idx", F.lit(True).alias("judged")), ["station", "day_idx"], "left").join(bad, ["station", "day_idx"], "left")
    marked = marked.withColumn("judged", F.col("judged") & there).withColumn("hit", F.col("hit") & there)
    return apply_verdict(
        result, marked, code, key, bias_tol=bias_tol, min_consecutive_days=min_consecutive_days, ref_days=ref_days, min_obs_per_day=min_obs, min_stations=min_stations,
        max_network_frac=max_network_frac, baseline=baseline.select("station", "baseline"), episodes=episodes.drop("run"), days_unjudged=weather.select("day"),
        never_evaluated=first.where(F.col("n_days") < ref_days).select("station", "n_days"),
    )
