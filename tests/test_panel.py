"""Sources, durations, and the flag algebra."""

from datetime import datetime, timedelta

import pytest

from stationloom.functions.durations import window_points
from stationloom.operators import temperature as T
from stationloom.plans import runner
from stationloom.plans.runner import pick_levels
from stationloom.sources import panel as P

START = datetime(2025, 6, 1)


def make(spark, columns, minutes=60, what="temperature"):
    """A panel from lists of values, one for each station."""
    names = list(columns)
    rows = [(s, START + timedelta(minutes=minutes * i), v) for s in names for i, v in enumerate(columns[s])]
    return P.from_long(spark.createDataFrame(rows, "station string, ts timestamp, value double"), what=what, stations=names)


def flags(result, station):
    return [r["flag"] for r in result.cells.where(f"station = '{station}'").orderBy("row_idx").collect()]


def values(result, station):
    return [r["value"] for r in result.cells.where(f"station = '{station}'").orderBy("row_idx").collect()]


def test_durations():
    assert [window_points(w, 600) for w in ("6 hours", "90 mins", "2 days", timedelta(hours=1))] == [37, 10, 289, 7]
    with pytest.warns(UserWarning):
        assert window_points("45 mins", 600) == 5
    for bad in ("6 minutes", "hours", "-1 hours", "10 mins"):
        with pytest.raises(ValueError):
            window_points(bad, 600)


def test_wide_table(spark):
    rows = [("01.06.2025 00:10", 1.0, None), ("01.06.2025 00:00", float("nan"), None), ("01.06.2025 00:20", 3.0, None)]
    wide = spark.createDataFrame(rows, "time string, A double, B double")
    panel = P.from_wide(wide, "time", "%d.%m.%Y %H:%M")
    assert values(panel, "A") == [None, 1.0, 3.0] and flags(panel, "A") == [None, 0, 0]
    record = panel.info["conversion_temperature"]
    assert record["resorted"] and record["empty_loggers"] == ["B"] and record["pct_missing"] == {"A": 33.3, "B": 100.0}
    assert panel.facts.step == 600 and panel.facts.n_time == 3 and panel.facts.stations == ("A", "B")
    assert P.from_wide(wide, 1, "%d.%m.%Y %H:%M").facts.n_time == 3


@pytest.mark.parametrize(
    "rows, schema, column",
    [
        ([("x", 1.0)], "time string, A double", "time"),
        ([("2025-06-01 00:00:00", 1.0), ("2025-06-01 00:00:00", 2.0)], "time string, A double", "time"),
        ([("2025-06-01 00:00:00", "a")], "time string, A string", "time"),
        ([("2025-06-01 00:00:00", 1.0)], "time string, A double", "when"),
        ([("2025-06-01 00:00:00",)], "time string", "time"),
    ],
)
def test_refused_tables(spark, rows, schema, column):
    with pytest.raises(ValueError):
        P.from_wide(spark.createDataFrame(rows, schema), column)


def test_dominant_step_and_resolution(spark):
    rows = [("A", START + timedelta(minutes=m), v) for m, v in ((0, 1.0), (10, 1.05), (20, 1.2), (50, 9.0))]
    with pytest.warns(UserWarning):
        panel = P.from_long(spark.createDataFrame(rows, "station string, ts timestamp, value double"))
    assert panel.facts.step == 600 and not panel.facts.regular
    assert P.resolution_of(panel.cells).first()[0] == 0.05


def test_first_objection_wins(spark):
    panel = make(spark, {"A": [-45.0, 55.0, 20.0, None, float("inf")]})
    done = T.t2_out_of_range(T.t1_gross_error(panel))
    assert flags(done, "A") == [1, 2, 0, None, 1] and values(done, "A") == [None, None, 20.0, None, None]
    for key in ("t1_gross_error", "t2_out_of_range"):
        n = done.info[key]["tally"].first()
        assert n["n_flagged"] <= n["n_judged"] <= n["n_valid"]
    with pytest.warns(UserWarning):
        T.t1_gross_error(done)


def test_lower_bound_belongs_to_the_error(spark):
    assert flags(T.t1_gross_error(make(spark, {"A": [-40.0, 60.0, 0.0]})), "A") == [1, 0, 0]


def test_empty_panel(spark):
    panel = P.from_long(spark.createDataFrame([], "station string, ts timestamp, value double"))
    assert T.t3_time_consistency(T.t1_gross_error(panel)).cells.count() == 0


def test_levels_are_picked():
    assert pick_levels(None, 3, "T") == [1, 2, 3] and pick_levels([1, "T3"], 10, "T") == [1, 3] and pick_levels(["-T2"], 3, "T") == [1, 3]
    for bad in ([0], [1, -2], ["X1"], [11]):
        with pytest.raises(ValueError):
            pick_levels(bad, 10, "T")


def test_runner_equals_levels(spark):
    panel = make(spark, {"A": [20.0, -45.0, 21.0, 22.0, None, 24.0, 22.0]})
    done = runner.run_temperature(panel, None, True, ["T1", "T2", "T6", "T10"])
    assert flags(done, "A") == [0, 51, 0, 0, 50, 0, 0] and values(done, "A") == [20.0, 20.5, 21.0, 22.0, 23.0, 24.0, 22.0]
    record = done.info["run_qc_temperature"]
    assert record["levels"] == ["T1", "T2", "T10"] and record["skipped"] == ["T6"]
