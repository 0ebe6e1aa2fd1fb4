"""Kernels on cells: spikes, stuck values, gaps, runs, neighbours, consensus.

Windows go by station.  Frames of bounded length are cut into blocks of rows
with a margin of the frame's length, so that one long series spreads over tasks.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import great_circle, quantile

BLOCK_ROWS = 100_000
#: The land uses that count as green.
GREEN = ("Vegetated Areas", "Forest", "Forests")


def blocks(cells: DataFrame, before: int, after: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cells with their ``block``; rows near a border also go, as ``margin``, to the block beside it."""
    own = F.floor((F.col("row_idx") - 1) / block_rows)
    first = F.floor((F.col("row_idx") - 1 - after) / block_rows)
    last = F.floor((F.col("row_idx") - 1 + before) / block_rows)
    spread = cells.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return spread.withColumn("margin", F.col("block") != own)


def by_block():
    return Window.partitionBy("station", "block").orderBy("row_idx")


def find_spikes(cells: DataFrame, dt: int, threshold: float, n_time: int) -> DataFrame:
    """Values that leave the medians of their window and of both its sides by the threshold."""
    w = by_block()
    frames = {"around": w.rowsBetween(-dt, dt), "before": w.rowsBetween(-dt, -1), "after": w.rowsBetween(1, dt)}
    rows = blocks(cells, dt, dt)
    for name, frame in frames.items():
        rows = rows.withColumn(f"n_{name}", F.count("value").over(frame)).withColumn(f"m_{name}", quantile(F.col("value"), 0.5, frame))
    judged = (
        F.col("value").isNotNull() & F.col("row_idx").between(2, n_time - 1)
        & (F.col("n_around") >= 1 + dt) & (F.col("n_before") >= 1) & (F.col("n_after") >= 1)
    )
    leaves = [F.abs(F.col("value") - F.col(f"m_{n}")) >= threshold for n in frames]
    rows = rows.where(~F.col("margin")).withColumn("judged", judged)
    return rows.withColumn("hit", F.col("judged") & leaves[0] & leaves[1] & leaves[2])


def find_stuck(cells: DataFrame, width: int, sd_tol: float, min_valid: int, n_time: int, exempt_above: Column | None = None) -> DataFrame:
    """Windows of ``width`` rows whose standard deviation is at most ``sd_tol``, spread over their cells.

    Windows whose median reaches ``exempt_above`` are not judged.
    """
    w, back = by_block(), by_block().rowsBetween(-(width - 1), 0)
    enough = cells.groupBy("station").agg((F.count("value") >= min_valid).alias("enough"))
    rows = blocks(cells, width - 1, width - 1).join(F.broadcast(enough), "station")
    ok = F.col("enough") & (F.col("row_idx") >= width) & (F.count("value").over(back) >= min_valid)
    if exempt_above is not None:
        ok = ok & (quantile(F.col("value"), 0.5, back) < exempt_above)
    if n_time < width:
        ok = F.lit(False)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("sd", F.stddev_samp("value").over(back))
    rows = rows.withColumn("stuck", F.col("ok") & F.coalesce(F.col("sd") <= sd_tol, F.lit(False)))
    ahead = w.rowsBetween(0, width - 1)
    # a block's first rows lack the rows before their window, but are margin: own rows see whole windows
    rows = rows.withColumn("any_ok", F.max("ok").over(ahead)).withColumn("any_stuck", F.max("stuck").over(ahead))
    there = F.col("value").isNotNull()
    return rows.where(~F.col("margin")).withColumn("judged", F.col("any_ok") & there).withColumn("hit", F.col("any_stuck") & there)


def grid_places(cells: DataFrame, step: float | None, regular: bool) -> DataFrame:
    """Cells with ``place``: the number of their time on the full grid of the step.

    It is the row of the index where that is regular, or where two times would
    share a place.
    """
    if regular or not step:
        return cells.withColumn("place", F.col("row_idx").cast("long"))
    times = cells.select("ts").distinct()
    start = times.agg(F.min("ts").alias("start"))
    place = (F.rint((F.unix_micros("ts") - F.unix_micros("start")) / (step * 1e6)) + 1).cast("long")
    shared = times.join(F.broadcast(start)).groupBy(place.alias("place")).agg(F.count("*").alias("n")).agg((F.max("n") > 1).alias("shared"))
    rows = cells.join(F.broadcast(start.join(shared)))  # one row
    return rows.withColumn("place", F.when(F.col("shared"), F.col("row_idx")).otherwise(place)).drop("start", "shared")


def fill_gaps(cells: DataFrame, maxgap: int, refill: bool, step: float | None, regular: bool = False) -> DataFrame:
    """Linear values in gaps of at most ``maxgap`` places of the full time grid: ``filled``, else null.

    The ends of such a gap are at most ``maxgap`` rows away, so blocks with
    that margin hold them; the last value before a row and the first one behind
    it are running values, in both orders.
    """
    rows = blocks(grid_places(cells, step, regular), maxgap, maxgap)
    known = F.when(F.col("value").isNotNull(), F.struct("place", "value"))
    nearest = lambda order: F.last(known, ignorenulls=True).over(Window.partitionBy("station", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("left", nearest(F.asc("row_idx"))).withColumn("right", nearest(F.desc("row_idx")))
    rows = rows.where(~F.col("margin"))
    span = F.col("right.place") - F.col("left.place")
    share = (F.col("place") - F.col("left.place")) / span
    line = F.col("left.value") + (F.col("right.value") - F.col("left.value")) * share
    may = F.col("value").isNull() & (span - 1 <= maxgap)
    if not refill:
        may = may & F.col("flag").isNull()
    return rows.withColumn("filled", F.when(may, line))


def runs(rows: DataFrame, by: str, order: str, flag: Column) -> DataFrame:
    """Rows where ``flag`` holds, with ``run``: a number shared by those that follow each other in ``order``."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.where(flag).withColumn("run", F.col(order) - F.row_number().over(w))


def loo_median(cells: DataFrame) -> DataFrame:
    """Cells with ``net``: the median at each time of all other stations, and ``n_valid`` of the time.

    Without one value, the middle of n sorted values is among three of them,
    those from place n // 2 on; a value is left out before such a place if it is
    not greater than what stands there.
    """
    many = (F.col("n_valid") / 2).cast("int")
    at = lambda i: F.try_element_at("sorted", F.when(many + i > 0, many + i))
    net = cells.groupBy("ts").agg(F.sort_array(F.collect_list("value")).alias("sorted"), F.count("value").alias("n_valid"))
    net = net.select("ts", "n_valid", at(0).alias("s0"), at(1).alias("s1"), at(2).alias("s2"))
    rows = cells.join(net, "ts")
    odd = F.col("n_valid") % 2 == 1
    own = F.col("value")
    without = lambda low, high: F.when(own <= F.col(low), F.col(high)).otherwise(F.col(low))
    others = F.when(odd, (without("s0", "s1") + without("s1", "s2")) / 2).otherwise(without("s0", "s1"))
    every = F.when(odd, F.col("s1")).otherwise((F.col("s0") + F.col("s1")) / 2)
    return rows.withColumn("net", F.when(own.isNull(), every).when(F.col("n_valid") > 1, others)).drop("s0", "s1", "s2")


# --- neighbours -----------------------------------------------------------


def station_pairs(metadata: DataFrame, stations: tuple[str, ...]) -> DataFrame:
    """All ordered pairs of the panel's stations that have metadata, with distances.

    Metadata is a short list (a row for each station): the pairs are wanted
    whole, for the scale of the weights is the median of all distances.
    """
    spark = metadata.sparkSession
    kinds = dict(metadata.dtypes)
    elev = F.col("ELEV").cast("double") if "ELEV" in kinds else F.lit(None).cast("double")
    use = F.col("Landuse").cast("string") if "Landuse" in kinds else F.lit(None).cast("string")
    known = spark.createDataFrame([(s, i + 1) for i, s in enumerate(stations)], "ID string, pos int")
    md = metadata.select(F.col("ID").cast("string").alias("ID"), F.col("LAT").cast("double").alias("lat"), F.col("LON").cast("double").alias("lon"), use.alias("use"), elev.alias("elev"))
    md = md.join(F.broadcast(known), "ID")
    side = lambda p: md.select(*[F.col(c).alias(f"{p}_{c}") for c in md.columns])
    pairs = side("a").join(F.broadcast(side("b")), F.col("a_ID") != F.col("b_ID"))
    return pairs.withColumn("dist", great_circle(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))


def check_metadata(metadata: DataFrame, stations: tuple[str, ...]) -> int:
    """The number of stations with metadata; repeated or unplaced stations are an error."""
    rows = metadata.where(F.col("ID").isin(*stations)).select(F.col("ID").cast("string"), "LAT", "LON").collect()
    ids = [r[0] for r in rows]
    if len(set(ids)) < len(ids):
        raise ValueError("the metadata has a station more than once")
    if any(r["LAT"] is None or r["LON"] is None for r in rows):
        raise ValueError("the metadata has a station without a position")
    if missing := [s for s in stations if s not in set(ids)]:
        warnings.warn(f"no metadata for {', '.join(missing)}", stacklevel=3)
    return len(ids)


def neighbour_edges(metadata: DataFrame, stations: tuple[str, ...], radius: float, k: int, landuse: str | None = "graded", max_elev_diff: float | None = 100) -> DataFrame:
    """Directed edges (src, src_pos, dst, dst_pos, dist, w, rank): the k nearest with weight in the radius.

    Weights are Gaussian in the distance, on the scale of the median of all
    distances, times the share of the land use; ``landuse`` None: 1 for all.
    """
    pairs = station_pairs(metadata, stations)
    sigma = pairs.agg(F.percentile("dist", F.lit(0.5)).alias("sigma"))
    pairs = pairs.join(F.broadcast(sigma))
    w = F.exp(-(F.col("dist") * F.col("dist")) / (2 * F.col("sigma") * F.col("sigma")))
    w = F.when(F.col("sigma") > 0, w).otherwise(F.lit(1.0))
    if landuse in ("graded", "strict"):
        same = (F.col("a_use") == F.col("b_use")) & (F.col("a_use") != "")
        share = F.when(same, 1.0)
        if landuse == "graded":
            share = share.when(F.col("a_use").isin(*GREEN) & F.col("b_use").isin(*GREEN), 0.4)
        w = w * share.otherwise(0.0)
    if max_elev_diff is not None:
        w = F.when(F.abs(F.col("a_elev") - F.col("b_elev")) > max_elev_diff, 0.0).otherwise(w)
    near = pairs.withColumn("w", w).where((F.col("w") > 0) & (F.col("dist") <= radius))
    rank = F.row_number().over(Window.partitionBy("a_ID").orderBy("dist", "b_pos"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return near.select(F.col("a_ID").alias("src"), F.col("a_pos").alias("src_pos"), F.col("b_ID").alias("dst"), F.col("b_pos").alias("dst_pos"), "dist", "w", "rank")


# --- consensus ------------------------------------------------------------


def first_pass(cells: DataFrame, edges: DataFrame, k_sigma: float, floor: float, min_neighbours: int) -> DataFrame:
    """For each cell the neighbours' weighted mean, spread and number, ``judged`` and ``ratio``."""
    side = cells.select(F.col("station").alias("dst"), "row_idx", F.col("value").alias("x")).where("x IS NOT NULL")
    edge = F.broadcast(edges.select(F.col("src").alias("station"), "dst", "w"))
    met = cells.where("value IS NOT NULL").select("station", "row_idx", "value").join(edge, "station").join(side, ["dst", "row_idx"])
    sums = met.groupBy("station", "row_idx").agg(
        F.first("value").alias("v"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("swx"), F.count("*").alias("nn"),
        F.collect_list(F.struct("w", "x")).alias("near"),
    )
    mu = F.col("swx") / F.col("sw")
    spread = F.aggregate("near", F.lit(0.0), lambda t, e: t + e["w"] * (e["x"] - F.col("mu")) * (e["x"] - F.col("mu")))
    sums = sums.withColumn("mu", mu).withColumn("sig", F.sqrt(spread / F.greatest("sw", F.lit(1e-12))))
    ratio = F.abs(F.col("v") - F.col("mu")) / F.greatest(k_sigma * F.col("sig"), F.lit(floor))
    return sums.where(F.col("nn") >= min_neighbours).select("station", "row_idx", "nn", "mu", "sig", ratio.alias("ratio"))


def neighbour_arrays(pairs, n_stations: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of each station's neighbours, 0-based; stations with fewer have weights of 0."""
    of: list[list[tuple[int, float]]] = [[] for _ in range(n_stations)]
    for i, j, weight in pairs:
        of[i - 1].append((j - 1, weight))
    most = max(map(len, of), default=0)
    place, w = np.zeros((n_stations, most), np.int64), np.zeros((n_stations, most))
    for i, near in enumerate(of):
        for k, (j, weight) in enumerate(sorted(near)):
            place[i, k], w[i, k] = j, weight
    return place, w


#: Values of neighbours that the removal loop looks at at once.
LOOK = 2_000_000


def remove_outliers(values: np.ndarray, place: np.ndarray, w: np.ndarray, k_sigma: float, floor: float, min_neighbours: int) -> np.ndarray:
    """Which values (steps x stations) go: at each step the worst exceedance, again and again until there is none.

    ``place`` and ``w`` are the stations' neighbours and their weights.
    """
    values = values.copy()
    gone = np.zeros(values.shape, bool)
    rows = max(1, LOOK // max(place.size, 1))
    for at in range(0, len(values), rows):
        active = np.arange(at, min(at + rows, len(values)))
        while len(active):
            v = values[active]
            near = v[:, place]  # steps x stations x neighbours
            weight = np.where(np.isnan(near), 0.0, w)
            near = np.nan_to_num(near)
            sw = weight.sum(axis=2)
            with np.errstate(invalid="ignore", divide="ignore"):
                mu = (weight * near).sum(axis=2) / sw
                sig = np.sqrt((weight * (near - mu[:, :, None]) ** 2).sum(axis=2) / np.maximum(sw, 1e-12))
                there = ~np.isnan(v)
                ok = there & (sw > 0) & ((weight > 0).sum(axis=2) >= min_neighbours) & (there.sum(axis=1, keepdims=True) >= 2)
                ratio = np.where(ok, np.abs(v - mu) / np.maximum(k_sigma * sig, floor), -1.0)
            worst = ratio.argmax(axis=1)
            out = ratio[np.arange(len(active)), worst] > 1
            active, worst = active[out], worst[out]
            values[active, worst] = np.nan
            gone[active, worst] = True
    return gone


def spatial_outliers(cells: DataFrame, edges: DataFrame, n_stations: int, k_sigma: float, floor: float, min_neighbours: int) -> DataFrame:
    """Cells with ``judged`` and ``hit`` of the neighbour consensus.

    Plain aggregates judge all cells; only times with an exceedance go, one row
    of values each, to the loop that removes the worst value first.
    """
    pairs = [tuple(r) for r in edges.select("src_pos", "dst_pos", "w").collect()]  # k for each station
    place, w = neighbour_arrays(pairs, n_stations)
    judged = first_pass(cells, edges, k_sigma, floor, min_neighbours)
    # exceedances are taken a hair early: the loop decides by its own sums
    suspect = judged.where(F.col("ratio") > 1 - 1e-9).select("row_idx").distinct()
    there = cells.where("value IS NOT NULL").join(suspect, "row_idx", "left_semi")
    steps = there.groupBy("row_idx").agg(F.collect_list(F.struct("station_pos", "value")).alias("all"))

    def loop(batches):
        for batch in batches:
            lists = batch.column(1)
            cell = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            values = np.full((batch.num_rows, n_stations), np.nan)
            values[row, cell.field(0).to_numpy() - 1] = cell.field(1).to_numpy()
            i, j = np.nonzero(remove_outliers(values, place, w, k_sigma, floor, min_neighbours))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array((j + 1).astype(np.int32))], ["row_idx", "station_pos"])

    hits = steps.mapInArrow(loop, "row_idx int, station_pos int").withColumn("hit", F.lit(True))
    marked = cells.join(judged.select("station", "row_idx", F.lit(True).alias("judged")), ["station", "row_idx"], "left")
    return marked.join(hits, ["row_idx", "station_pos"], "left")


def distance_scale(metadata: DataFrame, stations: tuple[str, ...]) -> float | None:
    """The median of all distances between stations, in metres."""
    return station_pairs(metadata, stations).agg(F.percentile("dist", F.lit(0.5)).alias("sigma")).first()["sigma"]


def elevations_known(metadata: DataFrame, stations: tuple[str, ...]) -> bool:
    """Whether any of the stations has an elevation."""
    if "ELEV" not in metadata.columns:
        return False
    return not metadata.where(F.col("ID").isin(*stations) & F.col("ELEV").cast("double").isNotNull()).isEmpty()
