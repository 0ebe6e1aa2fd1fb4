"""Panels from wide or long tables, CSV files, and station metadata.

A panel is dense: each time of the index has a row for each station, with null
where nothing was measured, because windows count rows of the index.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import number
from ..plans.result import CELLS, PanelFacts, QCResult, stored

_PATTERN = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy"}


def read_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A CSV file with a header, all columns as text; a byte-order mark is removed."""
    table = spark.read.csv(path, sep=sep, header=True)
    return table.toDF(*[c.lstrip("﻿") for c in table.columns])


def read_metadata(spark: SparkSession, path: str, city: str | None = None) -> DataFrame:
    """Stations (ID, LAT, LON, Landuse, ELEV); IDs repeat across cities, so choose one."""
    table = read_csv(spark, path)
    if city is not None:
        table = table.where(F.col("City") == city)
    elev = F.col("ELEV").cast("double") if "ELEV" in table.columns else F.lit(None).cast("double")
    return table.select("ID", F.col("LAT").cast("double"), F.col("LON").cast("double"), "Landuse", elev.alias("ELEV"))


def java_pattern(time_format: str) -> str:
    """A strptime format as a datetime pattern."""
    for mark, letters in _PATTERN.items():
        time_format = time_format.replace(mark, letters)
    if "%" in time_format:
        raise ValueError(f"unknown mark in the time format: {time_format}")
    return time_format


def from_wide(table: DataFrame, time_col: str | int, time_format: str = "%Y-%m-%d %H:%M:%S", what: str = "temperature") -> QCResult:
    """A panel from one time column and one numeric column for each logger.

    ``time_col`` is a name or a 1-based place.  Times that are text must all
    have the format; times must be there and differ; columns must be numeric,
    or wholly null.  The record says which loggers are empty, the share of
    missing values, and whether the rows had to be sorted.
    """
    if not isinstance(table, DataFrame):
        raise TypeError("a wide table is a DataFrame")
    names = table.columns
    if len(names) < 2:
        raise ValueError("a wide table has a time column and at least one logger")
    if len(set(names)) < len(names) or not all(names):
        raise ValueError("column names must be there and differ")
    if isinstance(time_col, int):
        if not 1 <= time_col <= len(names):
            raise ValueError(f"there is no column {time_col}")
        time_col = names[time_col - 1]
    if time_col not in names:
        raise ValueError(f"there is no column {time_col!r}")
    kinds, loggers = dict(table.dtypes), [n for n in names if n != time_col]
    bad = [n for n in loggers if kinds[n] == "string" or kinds[n] in ("date", "timestamp", "timestamp_ntz", "binary")]
    bad += [n for n in loggers if kinds[n] == "boolean" and not table.where(F.col(f"`{n}`").isNotNull()).isEmpty()]
    if bad:
        raise ValueError(f"not numeric: {', '.join(bad)}")
    ts = F.col(f"`{time_col}`")
    ts = F.try_to_timestamp(ts, F.lit(java_pattern(time_format))) if kinds[time_col] == "string" else ts.cast("timestamp")
    wide = table.select(ts.alias("ts"), *[number(F.col(f"`{n}`").cast("double")).alias(n) for n in loggers], F.col(f"`{time_col}`").cast("string").alias("__text"))
    missing = wide.where("ts IS NULL").select("__text").first()
    if missing is not None:
        raise ValueError(f"missing or unreadable time: {missing[0]!r}")
    twice = wide.groupBy("ts").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"time occurs more than once: {twice[0]}")
    resorted = not _in_order(wide.select("ts"))
    shares = wide.agg(F.count("*").alias("n"), *[F.count(f"`{n}`").alias(n) for n in loggers]).first()
    long = wide.drop("__text").unpivot(["ts"], loggers, "station", "value")
    panel = from_long(long, what=what, stations=loggers)
    total = max(shares["n"], 1)
    return panel.record(
        f"conversion_{what}",
        resorted=resorted,
        empty_loggers=[n for n in loggers if shares[n] == 0],
        pct_missing={n: round(100 * (1 - shares[n] / total), 1) for n in loggers},
    )


def _in_order(times: DataFrame) -> bool:
    """Whether ``ts`` ascends in the order of the rows: within each partition, and from one to the next."""
    at = times.select("ts", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33))
    falls = F.lag("ts").over(Window.partitionBy("part").orderBy("at")) > F.col("ts")
    parts = at.withColumn("falls", F.coalesce(falls, F.lit(False))).groupBy("part").agg(F.max("falls").alias("falls"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    border = F.lag("last").over(Window.orderBy("part")) > F.col("first")  # a row for each partition
    return parts.withColumn("border", F.coalesce(border, F.lit(False))).where("falls OR border").isEmpty()


def from_long(table: DataFrame, station="station", ts="ts", value="value", what: str = "temperature", stations: list[str] | None = None, store: bool = False) -> QCResult:
    """A dense panel from rows (station, ts, value).

    ``stations`` gives the order of the stations, else they are sorted by
    name.  Rows with a null station or time are left out; a time that a
    station has twice is an error.  ``store`` writes the rows to the shared
    folder first: where they are costly to make, they are made once.
    """
    rows = table.select(F.col(station).cast("string").alias("station"), F.col(ts).cast("timestamp").alias("ts"), number(F.col(value)).alias("value"))
    rows = rows.where("station IS NOT NULL AND ts IS NOT NULL")
    if store:
        rows = stored(rows, "rows")
    spark = table.sparkSession
    known = rows.groupBy("station", "ts").count().groupBy("station").agg(F.max_by(F.struct("ts", "count"), "count").alias("most")).collect()  # a row for each station
    for r in known:
        if r["most"]["count"] > 1:
            raise ValueError(f"{r['station']} has {r['most']['ts']} more than once")
    if stations is None:
        stations = sorted(r["station"] for r in known)
    if len(set(stations)) < len(stations):
        raise ValueError("a station occurs twice")
    known = spark.createDataFrame([(s, i + 1) for i, s in enumerate(stations)], "station string, station_pos int")
    line = timeline(rows)
    # times x stations is the panel itself; the stations are a short list
    cells = line.drop("before").join(F.broadcast(known)).join(rows, ["station", "ts"], "left")
    # an infinite value is there but has no flag yet
    flag = F.when(F.abs("value") < float("inf"), F.lit(0))
    cells = cells.withColumn("flag", flag).select(*CELLS)
    known_facts, span = facts(cells, line, stations, what)
    entries = {"variable": what, "n_time": known_facts.n_time, "n_stations": len(stations), "stations": list(stations), **span}
    return QCResult(cells, known_facts).record(f"dataset_{what}", **entries, time_step_sec=known_facts.step, irregular_time_steps=not known_facts.regular)


def timeline(rows: DataFrame) -> DataFrame:
    """ts, row_idx, day, day_idx, and the time before, of each time of the index.

    Times are numbered within their days, and days by a table with a row for
    each day, so that no task sees all times.
    """
    times = rows.select("ts").distinct().withColumn("day", F.to_date("ts"))
    by_day = Window.orderBy("day")  # a row for each day
    days = times.groupBy("day").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    days = days.select("day", F.row_number().over(by_day).alias("day_idx"), (F.sum("n").over(by_day) - F.col("n")).alias("earlier"), F.lag("last").over(by_day).alias("eve"))
    in_day = Window.partitionBy("day").orderBy("ts")
    line = times.join(days, "day")
    return line.select(
        "ts", (F.col("earlier") + F.row_number().over(in_day)).cast("int").alias("row_idx"), "day", "day_idx", F.coalesce(F.lag("ts").over(in_day), "eve").alias("before")
    )


def step_counts(line: DataFrame) -> DataFrame:
    """How often each spacing, in seconds, occurs between consecutive times."""
    gap = (F.unix_micros("ts") - F.unix_micros("before")) / 1e6
    return line.select(gap.alias("step")).where("step IS NOT NULL").groupBy("step").agg(F.count("*").alias("n"))


#: Ranges in which distinct values are compared with each other.
RANGES = 1024


def resolution_of(cells: DataFrame):
    """Least gap between distinct values rounded to six places, as a one-row table.

    Values are compared within equal ranges, and the ends of a range with those
    of the next one that has values.
    """
    distinct = cells.select(F.round("value", 6).alias("v")).where("v IS NOT NULL AND abs(v) < double('infinity')").distinct()
    ends = distinct.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    span = F.col("high") - F.col("low")
    ranged = distinct.join(F.broadcast(ends)).select("v", F.when(span > 0, F.floor((F.col("v") - F.col("low")) / span * (RANGES - 1))).otherwise(0).alias("range"))
    inside = ranged.select((F.col("v") - F.lag("v").over(Window.partitionBy("range").orderBy("v"))).alias("gap"))
    borders = ranged.groupBy("range").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    between = borders.select((F.col("first") - F.lag("last").over(Window.orderBy("range"))).alias("gap"))
    return inside.union(between).agg(F.round(F.min("gap"), 6).alias("resolution"))


def facts(cells: DataFrame, line: DataFrame, stations: list[str], what: str) -> tuple[PanelFacts, dict]:
    """The facts of a panel, and its first and last time."""
    gap = ((F.unix_micros("ts") - F.unix_micros("before")) / 1e6).alias("step")
    grouped = line.groupBy(gap).agg(F.count("*").alias("n"), F.max("day_idx").alias("days"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    most = F.max_by("step", F.when(F.col("step").isNotNull(), F.struct("n", -F.col("step"))))
    r = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("days"), F.lit(0)), F.count("step"), most, F.min("first"), F.max("last")).first()
    n_time, n_days, n_steps, step, first, last = r
    if n_steps > 1:
        warnings.warn(f"{what}: the spacing of the times is not regular", stacklevel=3)
    known = PanelFacts(what, n_time, len(stations), step, n_steps < 2, tuple(stations), n_days, resolution_of(cells))
    return known, {"time_start": first, "time_end": last}
