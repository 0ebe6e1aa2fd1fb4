"""Ten levels for temperature.  Each takes and returns a ``QCResult``."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quantile, safe_corr, season
from ..functions.durations import window_points
from ..plans.result import CELLS, FILLED, QCResult, apply_verdict, never_judged, stored
from . import kernels as K

#: The range of each season, in degrees.
SEASONS = {"winter": (-24.44, 23.54), "spring": (-21.05, 38.08), "summer": (-5.85, 46.26), "autumn": (-19.90, 40.87)}


def _numbers(**given) -> None:
    for name, value in given.items():
        if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value):
            raise ValueError(f"{name} is a single number")


def _positive(**given) -> None:
    _numbers(**given)
    for name, value in given.items():
        if value <= 0:
            raise ValueError(f"{name} is above zero")


def _whole(least: int, **given) -> None:
    _numbers(**given)
    for name, value in given.items():
        if value != round(value) or value < least:
            raise ValueError(f"{name} is a whole number from {least} on")


def _share(low: float, high: float, ends: str = "()", **given) -> None:
    """Numbers between two bounds; ``ends`` tells, as brackets do, which bounds count."""
    _numbers(**given)
    for name, value in given.items():
        above = value >= low if ends[0] == "[" else value > low
        below = value <= high if ends[1] == "]" else value < high
        if not above or not below:
            raise ValueError(f"{name} is in {ends[0]}{low}, {high}{ends[1]}")


def check_consensus(k_sigma, abs_floor, radius_m, k_neighbours, min_neighbours, landuse_mode) -> None:
    _positive(k_sigma=k_sigma, abs_floor=abs_floor, radius_m=radius_m)
    _whole(1, min_neighbours=min_neighbours)
    _whole(min_neighbours, k_neighbours=k_neighbours)
    if landuse_mode not in ("graded", "strict", "none"):
        raise ValueError("landuse_mode is graded, strict or none")


def t1_gross_error(result: QCResult, threshold_max: float = 60, threshold_min: float = -40) -> QCResult:
    """Values no sensor can measure: above the maximum, or at or below the minimum."""
    _numbers(threshold_max=threshold_max, threshold_min=threshold_min)
    if threshold_min >= threshold_max:
        raise ValueError("threshold_min is below threshold_max")
    v = F.col("value")
    marked = result.cells.withColumn("judged", v.isNotNull()).withColumn("hit", (v > threshold_max) | (v <= threshold_min))
    return apply_verdict(result, marked, 1, "t1_gross_error", threshold_max=threshold_max, threshold_min=threshold_min)


def t2_out_of_range(result: QCResult, season_thresholds: dict = SEASONS) -> QCResult:
    """Values outside the range of their season."""
    if set(season_thresholds) != set(SEASONS):
        raise ValueError("thresholds are given for winter, spring, summer and autumn")
    for low, high in season_thresholds.values():
        _numbers(low=low, high=high)
        if low >= high:
            raise ValueError("a season's minimum is below its maximum")
    of, v = season(F.month("ts")), F.col("value")
    hit = F.lit(False)
    for name, (low, high) in season_thresholds.items():
        hit = hit | ((of == name) & ((v < low) | (v > high)))
    marked = result.cells.withColumn("judged", v.isNotNull()).withColumn("hit", hit)
    by_season = marked.where("hit AND (flag IS NULL OR flag = 0)").groupBy(of.alias("season")).agg(F.count("*").alias("n_flagged"))
    return apply_verdict(result, marked, 2, "t2_out_of_range", season_thresholds=dict(season_thresholds), by_season=by_season)


def t3_time_consistency(result: QCResult, dt: int = 3, threshold: float = 4) -> QCResult:
    """Isolated spikes."""
    _whole(1, dt=dt)
    _positive(threshold=threshold)
    marked = K.find_spikes(result.cells, dt, threshold, result.facts.n_time)
    return apply_verdict(result, marked, 3, "t3_time_consistency", dt=dt, threshold=threshold)


def t4_stuck_values(result: QCResult, window_size="6 hours", min_valid_frac: float = 0.5, min_non_na: int = 5, sd_tol: float = 0) -> QCResult:
    """Values that do not change over a window.

    A window under six hours gets a warning where the values' resolution is
    0.05 or coarser: genuine plateaus are that long.
    """
    _share(0, 1, "(]", min_valid_frac=min_valid_frac)
    _share(0, math.inf, "[)", sd_tol=sd_tol)
    _whole(2, min_non_na=min_non_na)
    width = window_points(window_size, result.facts.step)
    resolution = None
    if (width - 1) * result.facts.step < 6 * 3600:
        resolution = result.facts.resolution
        if resolution is not None and resolution >= 0.05:
            warnings.warn(f"values of a resolution of {resolution:g} may stand still for {window_size} without a fault", stacklevel=2)
    min_valid = max(min_non_na, math.ceil(min_valid_frac * width))
    if min_valid > width:
        raise ValueError("a window cannot hold so many valid values")
    marked = K.find_stuck(result.cells, width, sd_tol, min_valid, result.facts.n_time)
    return apply_verdict(result, marked, 4, "t4_stuck_values", window_size=window_size, width_points=width, min_valid=min_valid, sd_tol=sd_tol, resolution=resolution)


def default_day_obs(result: QCResult) -> int:
    """Values that make half a day at the panel's step."""
    return max(2, math.ceil(43200 / result.facts.step)) if result.facts.step else 72


def daily(cells: DataFrame, min_obs: int) -> DataFrame:
    """Extremes, range and mean of each station and day; null with too few values."""
    days = cells.groupBy("station", "day", "day_idx").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
    enough = F.col("n") >= min_obs
    return days.select("station", "day", "day_idx", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("lo", "hi", "mean")], F.when(enough, F.col("hi") - F.col("lo")).alias("rng"))


def climatology(cells: DataFrame, factor: float, min_days: int, min_obs: int, multi_year: bool) -> DataFrame:
    """Bounds of daily extremes for each station and calendar month; null bounds where refused."""
    days = daily(cells, min_obs).withColumn("month", F.month("day"))
    there = F.col("hi").isNotNull()
    bounds = days.groupBy("station", "month").agg(
        F.sum("n").alias("n_values"), F.count(F.when(there, 1)).alias("n_days"), F.count_distinct(F.when(there, F.year("day"))).alias("n_years"),
        F.percentile("hi", F.array(F.lit(0.25), F.lit(0.75))).alias("qh"), F.percentile("lo", F.array(F.lit(0.25), F.lit(0.75))).alias("ql"),
    )
    fits = (F.col("n_days") >= min_days) & ((F.col("n_years") >= 2) if multi_year else F.lit(True))
    qh, ql = (lambda i: F.col("qh")[i]), (lambda i: F.col("ql")[i])
    return bounds.where("n_values > 0").select(
        "station", "month", "n_days", "n_years", fits.alias("fits"),
        F.when(fits, qh(1) + factor * (qh(1) - qh(0))).alias("upper"), F.when(fits, ql(0) - factor * (ql(1) - ql(0))).alias("lower"),
    )


def t5_climatic_outliers(result: QCResult, ext_lim_factor: float = 2.5, min_days: int = 60, min_obs_per_day: int | None = None, require_multi_year: bool = True) -> QCResult:
    """Values beyond what the station's own daily extremes of the month make likely."""
    _positive(ext_lim_factor=ext_lim_factor)
    _whole(20, min_days=min_days)  # quartiles want as many
    min_obs = default_day_obs(result) if min_obs_per_day is None else min_obs_per_day
    _whole(2, min_obs_per_day=min_obs)
    bounds = climatology(result.cells, ext_lim_factor, min_days, min_obs, require_multi_year)
    days = daily(result.cells, min_obs).where("hi IS NOT NULL").withColumn("month", F.month("day"))
    days = days.join(bounds.where("fits"), ["station", "month"]).select("station", "day_idx", F.col("hi").alias("tmax"), F.col("lo").alias("tmin"), "upper", "lower")
    marked = result.cells.join(days, ["station", "day_idx"], "left")
    v = F.col("value")
    hit = ((F.col("tmax") > F.col("upper")) & (v > F.col("upper"))) | ((F.col("tmin") < F.col("lower")) & (v < F.col("lower")))
    marked = marked.withColumn("judged", v.isNotNull() & F.col("upper").isNotNull()).withColumn("hit", hit)
    refused = bounds.where("NOT fits").select(F.format_string("%s/%02d(days=%d,y=%d)", "station", "month", "n_days", "n_years").alias("refused"))
    return apply_verdict(result, marked, 5, "t5_climatic_outliers", ext_lim_factor=ext_lim_factor, min_obs_per_day=min_obs, bounds=bounds.where("fits"), refused=refused)


def t6_spatial_consistency(result: QCResult, metadata: DataFrame | None = None, k_sigma: float = 6, abs_floor: float = 3, radius_m: float = 3000, k_neighbours: int = 5, min_neighbours: int = 2, max_elev_diff: float = 100, landuse_mode: str = "graded") -> QCResult:
    """Values away from the weighted mean of their neighbours, the worst first."""
    key = "t6_spatial_consistency"
    check_consensus(k_sigma, abs_floor, radius_m, k_neighbours, min_neighbours, landuse_mode)
    if metadata is None:
        return result.skip(key, "no metadata")
    matched = K.check_metadata(metadata, result.facts.stations)
    if matched < min_neighbours + 1:
        return result.skip(key, f"only {matched} stations with metadata")
    edges = K.neighbour_edges(metadata, result.facts.stations, radius_m, k_neighbours, landuse_mode, max_elev_diff)
    marked = K.spatial_outliers(result.cells, edges, result.facts.n_stations, k_sigma, abs_floor, min_neighbours)
    out = apply_verdict(
        result, marked, 6, key, edges=edges, k_sigma=k_sigma, abs_floor=abs_floor, radius_m=radius_m, k_neighbours=k_neighbours, min_neighbours=min_neighbours,
        landuse_mode=landuse_mode, max_elev_diff=max_elev_diff, sigma_d=K.distance_scale(metadata, result.facts.stations), elevation_used=K.elevations_known(metadata, result.facts.stations),
    )
    out.info[key]["never_evaluated"] = never_judged(out, key)
    return out


def t7_spatiotemporal_consistency(result: QCResult, metadata: DataFrame | None = None, radius_m: float = 2500, k_neighbours: int = 5, threshold: float = 0.99) -> QCResult:
    """Values extreme against every near neighbour and against the values before and after."""
    key = "t7_spatiotemporal_consistency"
    _share(0.5, 1, threshold=threshold)
    _positive(radius_m=radius_m)
    _whole(1, k_neighbours=k_neighbours)
    if metadata is None:
        return result.skip(key, "no metadata")
    matched = K.check_metadata(metadata, result.facts.stations)
    if matched < k_neighbours + 1:
        return result.skip(key, f"only {matched} stations with metadata")
    edges = K.neighbour_edges(metadata, result.facts.stations, radius_m, k_neighbours, None, None)
    full = edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") == k_neighbours)
    edge = edges.join(F.broadcast(full), "src", "left_semi").select(F.col("src").alias("station"), "dst")
    cells = result.cells
    side = cells.select(F.col("station").alias("dst"), "row_idx", F.col("value").alias("x")).where("x IS NOT NULL")
    mine = cells.where("value IS NOT NULL").select("station", "row_idx", "value").join(F.broadcast(edge), "station")
    dif = mine.join(side, ["dst", "row_idx"]).withColumn("dif", F.col("value") - F.col("x"))
    limits = dif.groupBy("station", "dst").agg(F.percentile("dif", F.lit(threshold)).alias("up"), F.percentile("dif", F.lit(1 - threshold)).alias("lo"))
    dif = dif.join(F.broadcast(limits), ["station", "dst"])
    extreme = (F.col("dif") >= F.col("up")) | (F.col("dif") <= F.col("lo"))
    spatial = dif.groupBy("station", "row_idx").agg(F.count("*").alias("n"), F.every(extreme).alias("extreme")).where(F.col("n") == k_neighbours)
    w = K.by_block()
    rows = K.blocks(cells, 1, 1).withColumn("back", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("on", F.abs(F.lead("value").over(w) - F.col("value")))
    rows = rows.where(~F.col("margin"))
    steps = rows.groupBy("station").agg(F.percentile("back", F.lit(threshold)).alias("q_back"), F.percentile("on", F.lit(threshold)).alias("q_on"))
    rows = rows.join(F.broadcast(steps), "station").join(spatial.select("station", "row_idx", "extreme"), ["station", "row_idx"], "left")
    judged = F.col("extreme").isNotNull() & F.col("back").isNotNull() & F.col("on").isNotNull()
    hit = judged & F.col("extreme") & (F.col("back") > F.col("q_back")) & (F.col("on") > F.col("q_on"))
    never = [s for s in result.facts.stations if s not in {r[0] for r in full.select("src").collect()}]
    within = K.station_pairs(metadata, result.facts.stations).groupBy(F.col("a_ID").alias("station")).agg(F.count(F.when(F.col("dist") <= radius_m, 1)).alias("n_neighbours"))
    return apply_verdict(
        result, rows.withColumn("judged", judged).withColumn("hit", hit), 7, key, threshold=threshold, radius_m=radius_m, k_neighbours=k_neighbours,
        never_evaluated=never, n_neighbours=within,
    )


def diurnal_runs(cells: DataFrame, range_frac: float, min_days: int, min_obs: int, min_stations: int, min_swing: float):
    """Days with the network's reference, and runs of days with a collapsed range.

    Runs have first, last, n_days, swing of the network and the station, and
    ``verdict``: undecided, acquitted or indoor.
    """
    days = daily(cells, min_obs)
    net = days.groupBy("day_idx").agg(F.count("rng").alias("n_ranges"), F.percentile("rng", F.lit(0.5)).alias("ref"), F.percentile("mean", F.lit(0.5)).alias("net_mean"))
    ref = F.when((F.col("n_ranges") >= min_stations) & (F.col("ref") > 0), F.col("ref"))
    net = net.withColumn("ref", ref)
    days = days.join(net, "day_idx").withColumn("judged", F.col("rng").isNotNull() & F.col("ref").isNotNull())
    low = days.withColumn("low", F.col("judged") & (F.col("rng") < range_frac * F.col("ref")))
    run = K.runs(low, "station", "day_idx", F.col("low")).groupBy("station", "run").agg(
        F.min("day_idx").alias("first"), F.max("day_idx").alias("last"), F.count("*").alias("n_days"),
        (F.max("net_mean") - F.min("net_mean")).alias("net_swing"), (F.max("mean") - F.min("mean")).alias("own_swing"),
    ).where(F.col("n_days") >= min_days).drop("run")
    verdict = F.when(F.col("net_swing") < min_swing, "undecided").when(F.col("own_swing") >= range_frac * F.col("net_swing"), "acquitted").otherwise("indoor")
    return low, run.withColumn("verdict", verdict)


def t8_diurnal_range(result: QCResult, range_frac: float = 0.4, min_consecutive_days: int = 3, min_obs_per_day: int | None = None, min_stations: int = 3, min_network_swing: float = 2) -> QCResult:
    """Days on end with hardly any daily range while the network has one: a sensor taken indoors."""
    key = "t8_diurnal_range"
    _share(0, 1, range_frac=range_frac)
    _whole(1, min_consecutive_days=min_consecutive_days)
    min_obs = default_day_obs(result) if min_obs_per_day is None else min_obs_per_day
    _whole(2, min_obs_per_day=min_obs)
    _whole(3, min_stations=min_stations)  # a median of fewer is no yardstick
    _positive(min_network_swing=min_network_swing)
    if result.facts.n_stations < min_stations:
        return result.skip(key, f"only {result.facts.n_stations} stations")
    days, runs = diurnal_runs(result.cells, range_frac, min_consecutive_days, min_obs, min_stations, min_network_swing)
    indoor = runs.where("verdict = 'indoor'").select("station", F.explode(F.sequence("first", "last")).alias("day_idx"), F.lit(True).alias("hit"))
    marked = result.cells.join(days.select("station", "day_idx", "judged"), ["station", "day_idx"], "left").join(indoor, ["station", "day_idx"], "left")
    there = F.col("value").isNotNull()
    marked = marked.withColumn("judged", F.col("judged") & there).withColumn("hit", F.col("hit") & there)
    return apply_verdict(
        result, marked, 8, key, range_frac=range_frac, min_consecutive_days=min_consecutive_days, min_obs_per_day=min_obs, min_stations=min_stations, min_network_swing=min_network_swing,
        days_unjudged=days.where("ref IS NULL").select("day_idx").distinct(), runs_undecided=runs.where("verdict = 'undecided'"),
    )


def lag_table(result: QCResult, window_days: int, max_lag: int, min_valid_frac: float, min_cor: float, min_stations: int) -> DataFrame:
    """The lag of each judged station and window against the rest of the network.

    Every lag's correlation is an aggregate over a time-shifted equi-join; the
    shifted values may lie outside the window.
    """
    step = result.facts.step
    rows = K.loo_median(result.cells).withColumn("win", F.floor((F.col("day_idx") - 1) / window_days).cast("int")).withColumn("at", F.unix_micros("ts"))
    rows = rows.withColumn("net", F.when(F.col("n_valid") >= min_stations, F.col("net")))
    both = F.col("value").isNotNull() & F.col("net").isNotNull()
    judged = rows.groupBy("station", "win").agg(F.count(F.when(both, 1)).alias("n")).where(F.col("n") >= min_valid_frac * window_days * 86400 / step).select("station", "win")
    asked = rows.where("value IS NOT NULL").join(judged, ["station", "win"]).select("station", "win", "at", "value")
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    asked = asked.select("station", "win", "at", "value", lags).withColumn("at", F.col("at") + F.col("lag").cast("long") * F.lit(round(step * 1e6)).cast("long"))
    net = rows.where("net IS NOT NULL").select("station", "at", "net")
    pairs = asked.join(net, ["station", "at"])
    cors = pairs.groupBy("station", "win", "lag").agg(F.count("*").alias("n"), safe_corr(F.col("value"), F.col("net")).alias("r")).where("n >= 3 AND r IS NOT NULL")
    # the first of equal maxima; rounding hides what the order of the sums leaves
    by = Window.partitionBy("station", "win").orderBy(F.desc(F.round("r", 12)), "lag")
    beside = Window.partitionBy("station", "win").orderBy("lag")
    at_lag = lambda f, d: F.when(f("lag", 1).over(beside) == F.col("lag") + d, f("r", 1).over(beside))
    best = cors.withColumn("r0", at_lag(F.lag, -1)).withColumn("r2", at_lag(F.lead, 1)).withColumn("place", F.row_number().over(by)).where("place = 1")
    curve = F.col("r0") - 2 * F.col("r") + F.col("r2")
    inner = (F.abs("lag") < max_lag) & (curve < 0)
    shift = F.when(inner, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("r0") - F.col("r2")) / curve))).otherwise(0.0)
    refined = best.select("station", "win", F.col("r").alias("r"), F.when(F.col("r") >= min_cor, F.round(F.col("lag") + shift, 2)).alias("lag"))
    return judged.join(refined, ["station", "win"], "left")


def clock_episodes(lags: DataFrame, min_lag: int, min_windows: int, step: float):
    """Windows with their run, undecided windows, and episodes of a shifted clock."""
    seen = lags.where("lag IS NOT NULL").withColumn("off", F.abs(F.rint("lag")) >= min_lag)
    share = seen.groupBy("win").agg(F.count(F.when(F.col("off"), 1)).alias("n_off"), F.count("*").alias("n"))
    undecided = share.where("n_off > 0 AND n_off >= 0.5 * n").select("win")
    decided = seen.join(undecided, "win", "left_anti")
    by = Window.partitionBy("station").orderBy("win")
    decided = decided.withColumn("place", F.row_number().over(by)).withColumn("sign", F.when(F.col("off"), F.signum("lag")))
    run = F.col("place") - F.row_number().over(Window.partitionBy("station", "sign").orderBy("win"))
    off = decided.where("off").withColumn("run", run)
    episodes = off.groupBy("station", "sign", "run").agg(
        F.min("win").alias("from_win"), F.max("win").alias("to_win"), F.count("*").alias("windows"),
        F.rint(F.percentile("lag", F.lit(0.5)) * step / 60).alias("lag_min"), F.round(F.percentile("r", F.lit(0.5)), 3).alias("r"),
    ).where(F.col("windows") >= min_windows)
    return off, undecided, episodes


def t9_clock_offset(result: QCResult, window_days: int = 7, max_lag: int | None = None, min_lag: int | None = None, min_consecutive_windows: int = 2, min_valid_frac: float = 0.5, min_cor: float = 0.7, min_stations: int = 3) -> QCResult:
    """Windows on end in which a station runs early or late against the network."""
    key, step = "t9_clock_offset", result.facts.step
    _whole(1, window_days=window_days, min_consecutive_windows=min_consecutive_windows)
    _share(0, 1, "(]", min_valid_frac=min_valid_frac)
    _share(0, 1, "[)", min_cor=min_cor)
    _whole(3, min_stations=min_stations)
    if result.facts.n_stations < min_stations or not step:
        return result.skip(key, f"only {result.facts.n_stations} stations" if step else "no time step")
    min_lag = max(1, round(3600 / step)) if min_lag is None else min_lag
    max_lag = max(1, round(7200 / step)) if max_lag is None else max_lag
    _whole(1, max_lag=max_lag, min_lag=min_lag)
    if min_lag > max_lag:
        raise ValueError("min_lag is at most max_lag")
    lags = lag_table(result, window_days, max_lag, min_valid_frac, min_cor, min_stations)
    off, undecided, episodes = clock_episodes(lags, min_lag, min_consecutive_windows, step)
    bad = off.join(episodes.select("station", "sign", "run"), ["station", "sign", "run"], "left_semi").select("station", "win", F.lit(True).alias("hit"))
    win = F.floor((F.col("day_idx") - 1) / window_days).cast("int")
    seen = lags.where("lag IS NOT NULL").join(undecided, "win", "left_anti").select("station", "win", F.lit(True).alias("judged"))
    there = F.col("value").isNotNull()
    marked = result.cells.withColumn("win", win).join(seen, ["station", "win"], "left").join(bad, ["station", "win"], "left")
    marked = marked.withColumn("judged", F.col("judged") & there).withColumn("hit", F.col("hit") & there)
    return apply_verdict(result, marked, 9, key, lags=lags, episodes=episodes.drop("sign", "run"), windows_undecided=undecided, min_lag=min_lag, max_lag=max_lag, window_days=window_days, min_cor=min_cor)


def interpolate(result: QCResult, maxgap: int, refill_flagged: bool, key: str) -> QCResult:
    _whole(1, maxgap=maxgap)
    rows = K.fill_gaps(result.cells, int(maxgap), refill_flagged, result.facts.step, result.facts.regular)
    if result.storing:
        rows = stored(rows.select(*CELLS, "filled"), key)
    done = F.col("filled").isNotNull()
    code = F.when(done, FILLED + F.coalesce("flag", F.lit(0))).otherwise(F.col("flag")).cast("int")
    cells = rows.withColumn("value", F.coalesce("value", "filled"))
    counts = rows.where(done).agg(F.count(F.when(F.col("flag").isNull(), 1)).alias("n_gap_filled"), F.count("flag").alias("n_refilled"))
    return result.with_cells(cells.withColumn("flag", code)).record(key, maxgap=maxgap, refill_flagged=refill_flagged, counts=counts)


def t10_interpolate(result: QCResult, maxgap: int = 5, refill_flagged: bool = True) -> QCResult:
    """Linear values in short gaps: code 50, or 50 + the code of the objection refilled."""
    return interpolate(result, maxgap, refill_flagged, "t10_interpolate")
