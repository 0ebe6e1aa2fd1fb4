"""The levels that need one cell alone, on unbounded input.

The same predicates as the batch levels; a stream of (station, ts, value)
comes out with ``flag`` and the value nulled where it is objected to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number, season
from ..operators.temperature import SEASONS


def flag_temperature(stream: DataFrame, threshold_max: float = 60, threshold_min: float = -40, season_thresholds: dict = SEASONS) -> DataFrame:
    """Gross errors (1) and values out of their season's range (2)."""
    v, of = F.col("value"), season(F.month("ts"))
    out = F.lit(False)
    for name, (low, high) in season_thresholds.items():
        out = out | ((of == name) & ((v < low) | (v > high)))
    flag = F.when((v > threshold_max) | (v <= threshold_min), 1).when(out, 2).when(v.isNotNull(), 0)
    return _flagged(stream, flag)


def flag_humidity(stream: DataFrame, rh_min: float = 0, rh_max: float = 105) -> DataFrame:
    """Values out of range (2)."""
    v = F.col("value")
    return _flagged(stream, F.when((v < rh_min) | (v > rh_max), 2).when(v.isNotNull(), 0))


def _flagged(stream: DataFrame, flag) -> DataFrame:
    rows = stream.withColumn("value", number(F.col("value"))).withColumn("flag", flag)
    return rows.withColumn("value", F.when(F.coalesce("flag", F.lit(0)) == 0, F.col("value")))
