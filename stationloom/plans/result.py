"""Results of a chain, and the flag algebra that all levels share.

``cells`` is the dense panel: one row for each time and station, with columns
station, station_pos, ts, row_idx (1-based), day, day_idx, value, flag.  A
level marks each cell with ``hit`` and ``judged``; the first objection wins.
"""

from __future__ import annotations

import tempfile
import uuid
import warnings
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = ["station", "station_pos", "ts", "row_idx", "day", "day_idx", "value", "flag"]
GAP, FILLED = 50, 50  # an interpolated gap is 50, an interpolated objection 50 + its code


@dataclass(frozen=True)
class PanelFacts:
    """What is known of a panel before any level runs."""

    what: str
    n_time: int
    n_stations: int
    step: float | None  # dominant spacing in seconds
    regular: bool
    stations: tuple[str, ...]
    n_days: int
    values: DataFrame | None = field(default=None, repr=False, compare=False)  # (resolution): one row

    @cached_property
    def resolution(self) -> float | None:
        """The least gap between distinct values; computed when it is first asked for."""
        return None if self.values is None else self.values.first()["resolution"]


@dataclass(frozen=True)
class QCResult:
    """Cells, facts, and the records of the levels in the order they ran.

    With ``storing``, each level writes its cells and marks to the shared
    folder, so that neither the next level nor the tallies run it again.
    """

    cells: DataFrame
    facts: PanelFacts
    info: dict[str, dict] = field(default_factory=dict)
    storing: bool = False

    def record(self, key: str, **entries) -> QCResult:
        info = dict(self.info)
        if key in info and not key.startswith("run_"):
            warnings.warn(f"{key} ran before; its record is replaced", stacklevel=3)
        info[key] = entries
        return replace(self, info=info)

    def skip(self, key: str, reason: str, **entries) -> QCResult:
        return self.record(key, n_flagged=0, skipped=True, reason=reason, **entries)

    def with_cells(self, cells: DataFrame) -> QCResult:
        return replace(self, cells=cells.select(*CELLS))

    def stored(self, storing: bool = True) -> QCResult:
        """The same, whose levels write their cells as they run, or no longer do."""
        return replace(self, storing=storing)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where it is unset, the context's own checkpoint folder; where that is
    unset too, a new temporary folder, in local mode only: on a cluster the
    executors could not see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        own = context._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that all machines share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="panels-"))
            own = context._jsc.sc().getCheckpointDir()
        at = own.get()
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its plan ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unobjected():
    return F.col("flag").isNull() | (F.col("flag") == 0)


def apply_verdict(result: QCResult, marked: DataFrame, code: int, key: str, **record) -> QCResult:
    """Null and flag the cells that are hit and not objected to before.

    ``marked`` has the cells with boolean ``hit`` and ``judged``.  The record
    holds ``tally``, the flagged, judged and valid cells of each station.
    """
    marked = marked.withColumn("hit", F.coalesce("hit", F.lit(False)) & unobjected()).withColumn("judged", F.coalesce("judged", F.lit(False)))
    if result.storing:
        marked = stored(marked.select(*CELLS, "hit", "judged"), key)
    count = lambda c: F.count(F.when(c, 1))
    tally = marked.groupBy("station").agg(
        count(F.col("hit")).alias("n_flagged"), count(F.col("judged")).alias("n_judged"), count(F.col("value").isNotNull()).alias("n_valid")
    )
    cells = marked.select(
        *CELLS[:6],
        F.when(~F.col("hit"), F.col("value")).alias("value"),
        F.when(F.col("hit"), F.lit(code)).otherwise(F.col("flag")).alias("flag"),
    )
    return result.with_cells(cells).record(key, level=code, tally=tally, **record)


def never_judged(result: QCResult, key: str) -> DataFrame:
    """(station) of the stations of which a level judged no cell."""
    return result.info[key]["tally"].where("n_judged = 0").select("station")
