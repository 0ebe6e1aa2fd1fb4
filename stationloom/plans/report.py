"""Tables over a result: summary, timeline, levels, calendar, one station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .result import QCResult


def _codes(flag):
    """The level behind a flag: 50 + N is N, 50 none."""
    return F.when(flag > 50, flag - 50).when((flag > 0) & (flag < 50), flag)


def records(result: QCResult, chain: str | None = None, skipped: bool = False) -> dict[str, dict]:
    """The records of levels that ran, or with ``skipped`` skipped themselves: key -> record; ``chain`` is t or rh."""
    listed = lambda r: "tally" in r or skipped and r.get("skipped") is True
    return {k: r for k, r in result.info.items() if listed(r) and (chain is None or k.startswith(chain) and k[len(chain)].isdigit())}


def summary(result: QCResult, chain: str | None = None, skipped: bool = False) -> DataFrame:
    """(level, station, flagged, judged, judged_pct), a row for each level that ran and station.

    With ``skipped``, levels that skipped themselves have rows too: they judged nothing.
    """
    spark, flag = result.cells.sparkSession, F.col("flag")
    observed = result.cells.groupBy("station").agg(F.count(F.when(flag.isNotNull() & (flag != 50), 1)).alias("n_obs"))
    known = records(result, None, skipped)
    own = "rh" if any(k.startswith("rh") for k in known) else "t"
    out = None
    for key, record in records(result, chain, skipped).items():
        share = F.round(100 * F.col("n_judged") / F.greatest("n_obs", F.lit(1)), 1) if key.startswith(own) and key[len(own)].isdigit() else F.lit(None).cast("double")
        tally = record["tally"] if "tally" in record else spark.createDataFrame([(s, 0, 0) for s in result.facts.stations], "station string, n_flagged long, n_judged long")
        part = tally.join(F.broadcast(observed), "station", "left").select(
            F.lit(key).alias("level"), "station", F.col("n_flagged").alias("flagged"), F.col("n_judged").alias("judged"), share.alias("judged_pct")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "level string, station string, flagged long, judged long, judged_pct double")
    return out


def timeline_table(result: QCResult, station: str | None = None) -> DataFrame:
    """(day, level, n): objections of each level on each day, with zeros."""
    cells = result.cells if station is None else result.cells.where(F.col("station") == station)
    coded = cells.withColumn("level", _codes(F.col("flag")))
    counts = coded.where("level IS NOT NULL").groupBy("day", "level").agg(F.count("*").alias("n"))
    days, levels = cells.select("day").distinct(), counts.select("level").distinct()
    return days.join(F.broadcast(levels)).join(counts, ["day", "level"], "left").select("day", "level", F.coalesce("n", F.lit(0)).alias("n"))


def level_table(result: QCResult, by: str = "level") -> DataFrame:
    """(level, flagged, judged, share) of all stations, or the shares in percent by station and level."""
    if by not in ("level", "station"):
        raise ValueError("by is level or station")
    table = summary(result)
    share = F.round(100 * F.sum("flagged") / F.greatest(F.sum("judged"), F.lit(1)), 4)
    if by == "level":
        return table.groupBy("level").agg(F.sum("flagged").alias("flagged"), F.sum("judged").alias("judged"), share.alias("share"))
    return table.groupBy("station").pivot("level", list(records(result))).agg(share)


def calendar_table(result: QCResult, level: int | None = None) -> DataFrame:
    """(day, station, share): percent of a day's observed cells that are objected to."""
    code, flag = _codes(F.col("flag")), F.col("flag")
    hit = code.isNotNull() if level is None else code == level
    return result.cells.groupBy("day", "station").agg(
        F.round(100 * F.count(F.when(hit, 1)) / F.greatest(F.count(F.when(flag.isNotNull() & (flag != 50), 1)), F.lit(1)), 4).alias("share")
    )


def station_table(result: QCResult, station: str, raw: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(ts, value, level) of one station; ``raw`` (station, ts, value) gives the values before the chain.

    ``start`` and ``end`` are times or ISO prefixes such as 2025-07; an end
    prefix takes in the whole of its month, day, hour.
    """
    if station not in result.facts.stations:
        raise ValueError(f"no station {station!r}")
    rows = result.cells.where(F.col("station") == station)
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(_full(start)).cast("timestamp"))
    if end is not None:
        unit = {4: "1 year", 7: "1 month", 10: "1 day", 13: "1 hour", 16: "1 minute"}.get(len(end), "1 second")
        rows = rows.where(F.col("ts") < F.lit(_full(end)).cast("timestamp") + F.expr(f"INTERVAL {unit}"))
    rows = rows.select("ts", "value", _codes(F.col("flag")).alias("level"))
    if raw is not None:
        before = raw.where(F.col("station") == station).select("ts", F.col("value").alias("raw"))
        rows = rows.join(before, "ts", "left").select("ts", F.col("raw").alias("value"), "level")
    return rows.orderBy("ts")


def _full(prefix: str) -> str:
    return prefix + "0000-01-01 00:00:00"[len(prefix) :]


def code_table(result: QCResult) -> DataFrame:
    """(station, level, n) of all objections, as a cross table's rows."""
    coded = result.cells.select("station", _codes(F.col("flag")).alias("level")).where("level IS NOT NULL")
    return coded.groupBy("station", "level").agg(F.count("*").alias("n"))


def level_labels(result: QCResult) -> dict[int, str]:
    """The keys of the levels that ran on the result's own variable, by their code."""
    own = "rh" if "dataset_humidity" in result.info else "t"
    numbers = {key: key[len(own) :].partition("_")[0] for key in result.info if key.startswith(own)}
    return {int(n): key for key, n in sorted(numbers.items(), key=lambda x: x[1].zfill(3)) if n.isdigit()}


def wide(result: QCResult, column: str = "value") -> DataFrame:
    """The values, or the flags, as a wide table: a row for each time and a column for each station."""
    if column not in ("value", "flag"):
        raise ValueError("the column is value or flag")
    stations = list(result.facts.stations)
    table = result.cells.groupBy("ts").pivot("station", stations).agg(F.first(column))
    return table.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), *[F.col(f"`{s}`") for s in stations])


def record_lines(result: QCResult) -> list[str]:
    """The records as text, level by level in the order they ran; tables are named, not spelled out."""
    out = []
    for key, record in result.info.items():
        out.append(key)
        out += [f"  {name}: {'table (' + ', '.join(v.columns) + ')' if isinstance(v, DataFrame) else v}" for name, v in record.items()]
    return out


def write_result(result: QCResult, path: str) -> None:
    """Cells as Parquet; values and flags in wide form and the summary as CSV; the records as JSON and as text."""
    result.cells.write.parquet(f"{path}/cells")
    for name, column in (("values", "value"), ("flags", "flag")):
        wide(result, column).sort("time").write.csv(f"{path}/{name}", header=True)
    summary(result).coalesce(1).write.csv(f"{path}/summary", header=True)
    plain = [(i, key, {k: str(v) for k, v in r.items() if not isinstance(v, DataFrame)}) for i, (key, r) in enumerate(result.info.items())]
    spark = result.cells.sparkSession
    if plain:
        spark.createDataFrame(plain, "place int, key string, entries map<string,string>").coalesce(1).write.json(f"{path}/info")
        lines = spark.createDataFrame(list(enumerate(record_lines(result))), "place int, value string").coalesce(1).sortWithinPartitions("place")
        lines.select("value").write.text(f"{path}/info_text")
