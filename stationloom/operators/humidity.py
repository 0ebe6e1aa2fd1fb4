"""Eight levels for relative humidity.  Each takes and returns a ``QCResult``."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dewpoint, quantile, safe_corr
from ..functions.durations import window_points
from ..plans.result import QCResult, apply_verdict, never_judged, stored
from . import kernels as K
from .temperature import _positive, _share, _whole, check_consensus, interpolate


def matched(result: QCResult, other: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cells with columns of another panel at the same time and station; null where it has none."""
    side = other.select("station", "ts", *[F.col(c).alias(n) for n, c in columns.items()])
    return result.cells.join(side, ["station", "ts"], "left")


def overlap(result: QCResult, other: QCResult) -> tuple[list[str], int]:
    """The loggers of both panels, and the number of times of the first that the second has too.

    Panels are dense, so the times of one station are all.
    """
    loggers = [s for s in result.facts.stations if s in set(other.facts.stations)]
    times = lambda r: r.cells.where("station_pos = 1").select("ts")
    return loggers, times(result).join(times(other), "ts", "left_semi").count() if loggers else 0


NOTHING_SHARED = "no logger and time that both panels have"


def rh1_inherit_temperature(result: QCResult, temperature: QCResult | None = None, inherit_gapfill: bool = False) -> QCResult:
    """Objections to the temperature of the same logger and time."""
    key = "rh1_inherit_temperature"
    if temperature is None:
        return result.skip(key, "no temperature flags", inherited=False)
    code = F.col("flag")
    if not temperature.cells.where(code.isNotNull() & ~code.between(0, 10) & ~code.between(50, 60)).isEmpty():
        return result.skip(key, "the temperature flags hold unknown codes", inherited=False)
    loggers, n_time = overlap(result, temperature)
    if not n_time:
        return result.skip(key, NOTHING_SHARED, inherited=False)
    rows = matched(result, temperature.cells, {"t_flag": "flag"})
    t, there = F.col("t_flag"), F.col("value").isNotNull()
    hit = there & (t > 0) & (F.lit(inherit_gapfill) | (t != 50))
    by_code = rows.where(hit & (F.col("flag").isNull() | (F.col("flag") == 0))).groupBy("t_flag").agg(F.count("*").alias("n_flagged"))
    out = apply_verdict(
        result, rows.withColumn("judged", there & t.isNotNull()).withColumn("hit", hit), 1, key, by_code=by_code, inherited=True, inherit_gapfill=inherit_gapfill,
        loggers_matched=loggers, loggers_unmatched=[s for s in result.facts.stations if s not in set(loggers)], n_time_matched=n_time,
    )
    return replace(out, info={**{k: v for k, v in temperature.info.items() if k not in out.info}, **out.info})


def rh2_range(result: QCResult, rh_min: float = 0, rh_max: float = 105) -> QCResult:
    """Values no hygrometer should give."""
    if not (rh_max >= 100 and 0 <= rh_min < 100):
        raise ValueError("rh_max is at least 100 and rh_min is in [0, 100)")
    v = F.col("value")
    marked = result.cells.withColumn("judged", v.isNotNull()).withColumn("hit", (v < rh_min) | (v > rh_max))
    return apply_verdict(result, marked, 2, "rh2_range", rh_min=rh_min, rh_max=rh_max)


def rh3_spike(result: QCResult, dt: int = 3, threshold: float = 20) -> QCResult:
    """Isolated spikes."""
    _whole(1, dt=dt)
    _positive(threshold=threshold)
    return apply_verdict(result, K.find_spikes(result.cells, dt, threshold, result.facts.n_time), 3, "rh3_spike", dt=dt, threshold=threshold)


def saturation_ceiling(cells: DataFrame, sat_max: float, sat_quantile: float | None) -> DataFrame:
    """The level of each station at and above which steady values are weather."""
    top = F.lit(float(sat_max))
    if sat_quantile is not None:
        top = F.least(top, quantile(F.col("value"), sat_quantile))
    return cells.groupBy("station").agg(F.count("value").alias("n"), top.alias("ceiling")).drop("n")


def rh4_stuck_values(result: QCResult, window_size="6 hours", sd_tol: float = 0.1, sat_max: float = 95, sat_quantile: float | None = 0.9, min_valid_frac: float = 0.5) -> QCResult:
    """Values that hardly change over a window below saturation."""
    _share(0, math.inf, "[)", sd_tol=sd_tol)
    _share(0, 100, "(]", sat_max=sat_max)
    if sat_quantile is not None:
        _share(0, 1, sat_quantile=sat_quantile)
    _share(0, 1, "(]", min_valid_frac=min_valid_frac)
    width = window_points(window_size, result.facts.step)
    min_valid = max(2, math.ceil(min_valid_frac * width))
    ceiling = saturation_ceiling(result.cells, sat_max, sat_quantile)
    rows = result.cells.join(F.broadcast(ceiling), "station", "left")
    marked = K.find_stuck(rows, width, sd_tol, min_valid, result.facts.n_time, F.col("ceiling"))
    return apply_verdict(result, marked, 4, "rh4_stuck_values", window_size=window_size, width_points=width, min_valid=min_valid, sd_tol=sd_tol, sat_max=sat_max, sat_quantile=sat_quantile, sat_ceiling=ceiling)


def judged_days(rows: DataFrame, r_limit: float, t_range: float, min_n: int, max_frac: float) -> tuple[DataFrame, DataFrame]:
    """Days with enough pairs and range, (station, day_idx, r, bad), and the days (day_idx) that are weather.

    ``rows`` are cells with the temperature ``t``; bad: the coupling is
    missing.  On a day when two or more stations and over ``max_frac`` of the
    judged ones are bad it is the weather, and nobody is judged.
    """
    pair = F.col("value").isNotNull() & F.col("t").isNotNull()
    t = F.when(pair, F.col("t"))
    days = rows.groupBy("station", "day_idx").agg(
        F.count(F.when(pair, 1)).alias("n_pairs"), (F.max(t) - F.min(t)).alias("t_range"), safe_corr(F.col("value"), F.col("t")).alias("r")
    )
    days = days.where((F.col("n_pairs") >= min_n) & (F.col("t_range") >= t_range)).withColumn("bad", F.col("r").isNull() | (F.col("r") >= r_limit))
    net = days.groupBy("day_idx").agg(F.count("*").alias("n_jud"), F.count(F.when(F.col("bad"), 1)).alias("n_dec"))
    weather = net.where((F.col("n_dec") >= 2) & (F.col("n_dec") / F.col("n_jud") > max_frac)).select("day_idx")
    return days, weather


def coupling(rows: DataFrame, r_limit: float, t_range: float, min_n: int, max_frac: float) -> DataFrame:
    """(station, day_idx, r, bad): the days that can be judged and are not weather."""
    days, weather = judged_days(rows, r_limit, t_range, min_n, max_frac)
    return days.join(weather, "day_idx", "left_anti").select("station", "day_idx", "r", "bad")


def rh5_decoupling(result: QCResult, temperature: QCResult | None = None, decouple_r: float = -0.3, decouple_trange: float = 3, decouple_min_n: int | None = None, min_consecutive_days: int = 2, max_network_frac: float = 0.25) -> QCResult:
    """Days on end on which humidity does not fall as temperature rises."""
    key = "rh5_decoupling"
    _share(-1, 1, decouple_r=decouple_r)
    _positive(decouple_trange=decouple_trange)
    _whole(1, min_consecutive_days=min_consecutive_days)
    _share(0, 1, "(]", max_network_frac=max_network_frac)
    if decouple_min_n is not None:
        _whole(3, decouple_min_n=decouple_min_n)
    if temperature is None:
        return result.skip(key, "no temperature")
    twin, n_time = overlap(result, temperature)
    if not n_time:
        return result.skip(key, NOTHING_SHARED)
    if not result.facts.step and decouple_min_n is None:
        return result.skip(key, "no time step")
    min_n = max(3, round(36000 / result.facts.step)) if decouple_min_n is None else decouple_min_n
    rows = matched(result, temperature.cells, {"t": "value"})
    if result.storing:
        rows = stored(rows, "twins")
    seen, weather = judged_days(rows.where(F.col("station").isin(*twin)), decouple_r, decouple_trange, min_n, max_network_frac)
    days = seen.join(weather, "day_idx", "left_anti").select("station", "day_idx", "r", "bad")
    run = K.runs(days, "station", "day_idx", F.col("bad"))
    long = run.groupBy("station", "run").agg(F.count("*").alias("n")).where(F.col("n") >= min_consecutive_days)
    bad = run.join(long, ["station", "run"], "left_semi").select("station", "day_idx", F.lit(True).alias("hit"))
    there = F.col("value").isNotNull()
    marked = rows.join(days.select("station", "day_idx", F.lit(True).alias("judged")), ["station", "day_idx"], "left").join(bad, ["station", "day_idx"], "left")
    marked = marked.withColumn("judged", F.col("judged") & there).withColumn("hit", F.col("hit") & there)
    return apply_verdict(
        result, marked, 5, key, days=days, decouple_r=decouple_r, decouple_trange=decouple_trange, decouple_min_n=min_n, min_consecutive_days=min_consecutive_days,
        max_network_frac=max_network_frac, loggers_with_temperature=twin, n_time_with_temperature=n_time,
        never_evaluated=[s for s in result.facts.stations if s not in set(twin)], days_unjudged=weather,
    )


def network_medians(cells: DataFrame, min_stations: int) -> DataFrame:
    """(row_idx, med): the network's median at each time with enough stations."""
    net = cells.groupBy("row_idx").agg(F.count("value").alias("n"), F.percentile("value", F.lit(0.5)).alias("med"))
    return net.where(F.col("n") >= min_stations).select("row_idx", "med")


def rh6_saturation_drift(result: QCResult, network_min: float = 95, station_max: float = 90, min_hits: int = 12, min_stations: int = 3, window_days: int = 30) -> QCResult:
    """Stations that never come near saturation in a segment while the network is saturated."""
    key = "rh6_saturation_drift"
    _positive(window_days=window_days)
    _whole(2, min_stations=min_stations)
    _whole(1, min_hits=min_hits)
    if not station_max < network_min:
        raise ValueError("station_max is below network_min")
    medians = network_medians(result.cells, min_stations)
    wet = F.col("med") >= network_min
    n_wet, network_max = medians.agg(F.count(F.when(wet, 1)), F.max("med")).first()
    levels = {"network_min": network_min, "station_max": station_max, "n_saturated_steps": n_wet, "network_max": network_max}
    if not n_wet:
        return result.skip(key, f"the network's median never reached {network_min:g}", **levels)
    steps = medians.where(wet)
    start = result.cells.agg(F.min("ts").alias("start"))
    # a long panel's saturated steps may be many: no broadcast is forced
    rows = result.cells.join(F.broadcast(start)).join(steps.select("row_idx", F.lit(True).alias("wet")), "row_idx", "left")
    rows = rows.withColumn("seg", F.floor((F.unix_micros("ts") - F.unix_micros("start")) / (86400e6 * window_days)))
    wet = F.coalesce("wet", F.lit(False)) & F.col("value").isNotNull()
    seen = rows.where(wet).groupBy("station", "seg").agg(F.count("*").alias("n_wet"), F.max("value").alias("top")).where(F.col("n_wet") >= min_hits)
    marked = rows.join(seen, ["station", "seg"], "left").withColumn("judged", wet & F.col("top").isNotNull()).withColumn("hit", wet & (F.col("top") < station_max))
    return apply_verdict(result, marked, 6, key, **levels, min_hits=min_hits, min_stations=min_stations, window_days=window_days, segments=seen)


def rh7_dewpoint_consistency(result: QCResult, temperature: QCResult | None = None, metadata: DataFrame | None = None, k_sigma: float = 6, abs_floor: float = 4, radius_m: float = 3000, k_neighbours: int = 5, min_neighbours: int = 2, max_elev_diff: float = 100, landuse_mode: str = "graded") -> QCResult:
    """Dewpoints away from the weighted mean of the neighbours' dewpoints, the worst first."""
    key = "rh7_dewpoint_consistency"
    check_consensus(k_sigma, abs_floor, radius_m, k_neighbours, min_neighbours, landuse_mode)
    if metadata is None or temperature is None:
        return result.skip(key, "no metadata" if metadata is None else "no temperature")
    both, n_time = overlap(result, temperature)
    if not n_time:
        return result.skip(key, NOTHING_SHARED)
    found = K.check_metadata(metadata, tuple(both))
    if found < min_neighbours + 1:
        return result.skip(key, f"only {found} stations with temperature and metadata")
    rows = matched(result, temperature.cells, {"t": "value"})
    dew = rows.where(F.col("station").isin(*both)).withColumn("value", dewpoint(F.col("t"), F.col("value")))
    if result.storing:
        dew = stored(dew, "dewpoints")
    # positions stay those of the humidity panel
    placed = metadata.where(F.col("ID").isin(*both))
    edges = K.neighbour_edges(placed, result.facts.stations, radius_m, k_neighbours, landuse_mode, max_elev_diff)
    verdict = K.spatial_outliers(dew, edges, result.facts.n_stations, k_sigma, abs_floor, min_neighbours)
    marked = result.cells.join(verdict.select("station", "row_idx", "hit", "judged"), ["station", "row_idx"], "left")
    out = apply_verdict(
        result, marked, 7, key, edges=edges, k_sigma=k_sigma, abs_floor=abs_floor, radius_m=radius_m, k_neighbours=k_neighbours, min_neighbours=min_neighbours,
        landuse_mode=landuse_mode, max_elev_diff=max_elev_diff, sigma_d=K.distance_scale(placed, result.facts.stations), elevation_used=K.elevations_known(placed, result.facts.stations),
        loggers_with_temperature=both, n_time_with_temperature=n_time,
    )
    out.info[key]["never_evaluated"] = never_judged(out, key)
    return out


def rh8_interpolate(result: QCResult, maxgap: int = 5, refill_flagged: bool = True) -> QCResult:
    """Linear values in short gaps: code 50, or 50 + the code of the objection refilled."""
    return interpolate(result, maxgap, refill_flagged, "rh8_interpolate")
