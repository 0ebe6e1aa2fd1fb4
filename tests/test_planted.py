"""Whole chains on networks with planted errors, and what their records say."""

import math
import random
from datetime import datetime, timedelta

import pytest
from test_levels import near
from test_panel import flags, make, values

from stationloom.operators import humidity as H
from stationloom.operators import temperature as T
from stationloom.plans import report as R
from stationloom.plans import runner
from stationloom.sources import panel as P

DAY = 144  # steps of ten minutes


def series(n, seed, station, weather):
    rng = random.Random(seed)
    return [18 + weather[i // DAY] + 5 * math.sin(2 * math.pi * (i - 54) / DAY) + 0.3 * station + rng.gauss(0, 0.1) for i in range(n)]


@pytest.fixture(scope="module")
def temperature(spark):
    """Seven stations over a summer; S1 to S3 have no neighbours of their land use."""
    n, rng = 92 * DAY, random.Random(1)
    weather = [4 * math.sin(d / 3) + rng.gauss(0, 0.5) for d in range(93)]
    raw = {f"S{k + 1}": series(n, 10 + k, k, weather) for k in range(7)}
    raw["S2"][9 * DAY + 72] = -45.0
    raw["S5"][34 * DAY + 90] = 55.0
    raw["S3"][19 * DAY + 18] += 15
    stuck = range(44 * DAY, 44 * DAY + 40)
    for i in stuck:
        raw["S6"][i] = 24.0
    night = range(65 * DAY + 132, 65 * DAY + 180)
    for i in night:
        raw["S4"][i] += 12
    indoor = range(75 * DAY, 80 * DAY)
    for i in indoor:
        raw["S1"][i] = 21 + rng.gauss(0, 0.2)
    low = min(range(n), key=lambda i: raw["S7"][i])
    panel = make(spark, raw, 10)
    uses = ["Water", "Forest", "Water", "Sealed Areas", "Sealed Areas", "Sealed Areas", "Sealed Areas"]
    places = spark.createDataFrame([(f"S{k + 1}", 47.0 + 0.002 * k, 7.4, uses[k]) for k in range(7)], "ID string, LAT double, LON double, Landuse string")
    done = runner.run_temperature(panel, places, True)
    return done, {"E1": ("S2", [9 * DAY + 72]), "E2": ("S5", [34 * DAY + 90]), "E3": ("S3", [19 * DAY + 18]), "E4": ("S6", stuck), "E5": ("S4", night), "E6": ("S1", indoor), "N1": ("S7", [low])}


def test_every_planted_error_reaches_its_level(temperature):
    done, planted = temperature
    found = {s: flags(done, s) for s in done.facts.stations}
    at = lambda name: [found[planted[name][0]][i] for i in planted[name][1]]
    assert at("E1") == [51] and at("E2") == [52] and at("E3") == [53] and set(at("E4")) == {4}
    assert set(at("E5")) <= {6, 56} and sum(f == 8 for f in at("E6")) >= 0.95 * 5 * DAY
    assert at("N1") == [0]
    cells = {(s, i) for name in planted if name != "N1" for s, rows in [planted[name]] for i in rows}
    rest = [f for s in found for i, f in enumerate(found[s]) if (s, i) not in cells and f is not None]
    assert sum(1 <= f <= 8 for f in rest) < 0.0015 * len(rest)


def test_records_of_the_chain(temperature):
    done, _ = temperature
    info = done.info
    assert info["run_qc_temperature"]["levels"] == ["T1", "T2", "T3", "T4", "T5", "T8", "T6", "T7", "T9", "T10"]
    assert list(R.level_labels(done)) == list(range(1, 11)) and R.level_labels(done)[6] == "t6_spatial_consistency"
    for key, record in info.items():
        if "tally" in record:
            for r in record["tally"].collect():
                assert r["n_flagged"] <= r["n_judged"] <= r["n_valid"] <= done.facts.n_time
    t6 = info["t6_spatial_consistency"]
    assert 440 < t6["sigma_d"] < 450 and t6["elevation_used"] is False and t6["k_neighbours"] == 5
    assert {r[0] for r in t6["never_evaluated"].collect()} == {"S1", "S2", "S3"}
    t7 = info["t7_spatiotemporal_consistency"]
    assert {r["station"]: r["n_neighbours"] for r in t7["n_neighbours"].collect()}["S4"] == 6
    assert info["t4_stuck_values"]["resolution"] is None  # a window of six hours asks for none
    assert info["dataset_temperature"]["time_step_sec"] == 600 and info["dataset_temperature"]["time_start"] == datetime(2025, 6, 1)
    text = R.record_lines(done)
    assert "t6_spatial_consistency" in text and "  k_sigma: 6" in text


@pytest.fixture(scope="module")
def humidity(spark):
    """Four stations and one fault for each level."""
    rng, n = random.Random(11), 20 * DAY
    temp = [[18 + 5 * math.sin(2 * math.pi * (i - 54) / DAY) + rng.gauss(0, 0.3) + 0.4 * (k - 1) for i in range(n)] for k in range(4)]
    humid = [[90 - 2.5 * (t - 13) + rng.gauss(0, 1.5) for t in temp[k]] for k in range(4)]
    humid[0][9], humid[0][19] = 130.0, 103.0
    humid[1][499] += 30
    fog, dec, off = range(7 * DAY, 8 * DAY), range(13 * DAY, 16 * DAY), range(17 * DAY + 60, 17 * DAY + 96)
    for i in fog:
        for k in range(4):
            temp[k][i], humid[k][i] = 12 + rng.gauss(0, 0.3), 97 + rng.gauss(0, 0.05)
        humid[2][i] = 80 + rng.gauss(0, 0.5)
    for i in range(1999, 2039):
        humid[3][i] = 60.0
    for i in dec:
        humid[1][i] = 55 + rng.gauss(0, 1.5)
    for i in off:
        humid[0][i] = max(humid[0][i] - 30, 20)
    named = lambda m: {f"S{k + 1}": m[k] for k in range(4)}
    places = spark.createDataFrame([(f"S{k + 1}", 46.95 + 0.002 * k, 7.44 + 0.004 * k, "Sealed Areas") for k in range(4)], "ID string, LAT double, LON double, Landuse string")
    return make(spark, named(humid), 10, "humidity"), make(spark, named(temp), 10), places, fog, dec, off


def test_every_humidity_level_finds_its_fault(humidity):
    rh, temp, places, fog, dec, off = humidity
    temp = T.t1_gross_error(temp)
    done = runner.run_humidity(rh, temp, places, False)
    found = {s: flags(done, s) for s in rh.facts.stations}
    assert found["S1"][9] == 2 and found["S1"][19] == 0 and values(done, "S1")[19] == 103.0
    assert found["S2"][499] == 3 and all(found["S4"][i] == 4 for i in range(1999, 2039))
    share = lambda s, rows, code: sum(found[s][i] == code for i in rows) / len(rows)
    assert share("S3", fog, 6) >= 0.95 and share("S2", dec, 5) >= 0.95 and share("S1", off, 7) >= 0.8
    assert sum(f in range(2, 8) for s in found for f in found[s]) < len(fog) + 40 + len(dec) + len(off) + 20
    assert all(found[s][i] == 0 for s in ("S1", "S2", "S4") for i in fog)  # steady fog is no stuck sensor
    info = done.info
    assert info["rh1_inherit_temperature"]["n_time_matched"] == 20 * DAY and info["rh1_inherit_temperature"]["loggers_unmatched"] == []
    assert info["rh5_decoupling"]["never_evaluated"] == [] and info["rh5_decoupling"]["n_time_with_temperature"] == 20 * DAY
    assert 96 < info["rh6_saturation_drift"]["network_max"] < 98 and info["rh6_saturation_drift"]["n_saturated_steps"] == DAY
    assert info["rh7_dewpoint_consistency"]["loggers_with_temperature"] == ["S1", "S2", "S3", "S4"]
    assert "t1_gross_error" in info and info["run_qc_humidity"]["levels"] == [f"RH{i}" for i in range(1, 8)]
    assert list(R.level_labels(done)) == list(range(1, 8))


def test_humidity_without_a_twin_is_skipped(spark, humidity):
    rh, temp, places, *_ = humidity
    rows = temp.cells.select("station", (P.F.col("ts") + P.F.expr("INTERVAL 1 YEAR")).alias("ts"), "value")
    late = P.from_long(rows)
    other = P.from_long(temp.cells.select(P.F.concat(P.F.lit("X"), "station").alias("station"), "ts", "value"))
    for foreign in (late, other):
        for done, key in (
            (H.rh1_inherit_temperature(rh, foreign), "rh1_inherit_temperature"), (H.rh5_decoupling(rh, foreign), "rh5_decoupling"),
            (H.rh7_dewpoint_consistency(rh, foreign, places), "rh7_dewpoint_consistency"),
        ):
            assert done.info[key]["skipped"] and done.info[key]["reason"]
            assert done.cells is rh.cells
    short = P.from_long(temp.cells.where("row_idx <= 1000 AND station <> 'S4'").select("station", "ts", "value"))
    done = H.rh5_decoupling(rh, short)
    assert done.info["rh5_decoupling"]["n_time_with_temperature"] == 1000 and done.info["rh5_decoupling"]["never_evaluated"] == ["S4"]


@pytest.fixture(scope="module")
def small(spark):
    return make(spark, {f"S{k}": [1.0, 2.0, 3.0, 4.0] for k in range(3)})


@pytest.mark.parametrize(
    "level, bad",
    [
        *((T.t6_spatial_consistency, b) for b in ({"k_sigma": 0}, {"abs_floor": -1}, {"radius_m": 0}, {"min_neighbours": 0}, {"k_neighbours": 1}, {"k_neighbours": 2.5}, {"landuse_mode": "any"})),
        *((T.t7_spatiotemporal_consistency, b) for b in ({"threshold": 1}, {"threshold": 0.5}, {"radius_m": -5}, {"k_neighbours": 0}, {"k_neighbours": 1.5})),
        *((T.t8_diurnal_range, b) for b in ({"range_frac": 0}, {"range_frac": 1}, {"min_consecutive_days": 0}, {"min_obs_per_day": 1}, {"min_stations": 2}, {"min_network_swing": 0})),
        *((T.t9_clock_offset, b) for b in ({"window_days": 0.5}, {"min_consecutive_windows": 0}, {"min_valid_frac": 0}, {"min_cor": 1}, {"min_stations": 2}, {"min_lag": 20}, {"min_lag": 0}, {"max_lag": 0})),
        (T.t3_time_consistency, {"dt": 0}), (T.t3_time_consistency, {"threshold": 0}), (T.t4_stuck_values, {"sd_tol": -1}), (T.t4_stuck_values, {"min_valid_frac": 0}),
        (T.t5_climatic_outliers, {"min_days": 10}), (T.t5_climatic_outliers, {"min_obs_per_day": 1}), (T.t10_interpolate, {"maxgap": 0}), (T.t1_gross_error, {"threshold_max": True}),
        *((H.rh2_range, b) for b in ({"rh_max": 99}, {"rh_min": -1})), (H.rh3_spike, {"dt": 1.5}), (H.rh3_spike, {"threshold": 0}),
        *((H.rh4_stuck_values, b) for b in ({"sd_tol": -1}, {"sat_max": 101}, {"sat_quantile": 1}, {"min_valid_frac": 2})),
        *((H.rh5_decoupling, b) for b in ({"decouple_r": 1}, {"decouple_trange": 0}, {"decouple_min_n": 2}, {"min_consecutive_days": 0}, {"max_network_frac": 0})),
        *((H.rh6_saturation_drift, b) for b in ({"station_max": 95}, {"min_stations": 1}, {"min_hits": 0}, {"window_days": 0})),
        *((H.rh7_dewpoint_consistency, b) for b in ({"k_sigma": -1}, {"abs_floor": 0}, {"min_neighbours": 1.5})),
    ],
)
def test_bad_parameters_are_refused(small, level, bad):
    panel = small
    with pytest.raises(ValueError, match=next(iter(bad))):
        level(panel, **bad)


def test_a_coarse_resolution_is_told(spark):
    panel = make(spark, {"A": [20 + 0.1 * (i % 7) for i in range(100)]}, 10)
    assert panel.facts.resolution == pytest.approx(0.1)
    with pytest.warns(UserWarning, match="resolution of 0.1"):
        done = T.t4_stuck_values(panel, "3 hours")
    assert done.info["t4_stuck_values"]["resolution"] == pytest.approx(0.1)
    fine = make(spark, {"A": [20 + 0.01 * (i % 7) for i in range(100)]}, 10)
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        T.t4_stuck_values(fine, "3 hours")
        T.t4_stuck_values(panel, "6 hours")


def test_resolution_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [round(rng.uniform(-1e4, 1e4), 3) for _ in range(4000)] + [None, float("inf"), 5.0, 5.0]
    want = min(b - a for a, b in zip(sorted({r for r in rows if r is not None and r < 1e9}), sorted({r for r in rows if r is not None and r < 1e9})[1:]))
    table = spark.createDataFrame([(r,) for r in rows], "value double")
    assert P.resolution_of(table).first()[0] == pytest.approx(want, abs=1e-6)
    assert P.resolution_of(table.limit(0)).first()[0] is None and P.resolution_of(table.where("value = 5")).first()[0] is None


def network(days, stations, minutes, seed):
    rng, per_day = random.Random(seed), 1440 // minutes
    weather = lambda h: 12 + 8 * math.sin(2 * math.pi * (h / 24 - 110) / 365) + 6 * math.sin(2 * math.pi * (h - 9) / 24) + 4 * math.sin(2 * math.pi * h / 216)
    return {f"S{k + 1}": [weather(i * minutes / 60) + 0.3 * k + rng.gauss(0, 0.15) for i in range(days * per_day)] for k in range(stations)}


def test_defaults_follow_the_step(spark):
    raw, rng = network(420, 4, 30, 5), random.Random(6)
    indoor = range(200 * 48, 220 * 48)
    for i in indoor:
        raw["S4"][i] = 21 + rng.gauss(0, 0.1)
    panel = make(spark, raw, 30)
    t5 = T.t5_climatic_outliers(panel, min_days=20, require_multi_year=False).info["t5_climatic_outliers"]
    assert t5["min_obs_per_day"] == 24 and all(r["n_judged"] > 0 for r in t5["tally"].collect())
    done = T.t8_diurnal_range(panel)
    found = flags(done, "S4")
    assert done.info["t8_diurnal_range"]["min_obs_per_day"] == 24 and all(found[i] == 8 for i in indoor)
    humid = make(spark, {s: [130 - 4 * v for v in raw[s]] for s in raw}, 30, "humidity")
    rh5 = H.rh5_decoupling(humid, panel).info["rh5_decoupling"]
    assert rh5["decouple_min_n"] == 20 and all(r["n_judged"] > 0 for r in rh5["tally"].collect())


@pytest.mark.parametrize("minutes, lags", [(10, (6, 12)), (15, (4, 8))])
def test_an_hour_early_at_any_step(spark, minutes, lags):
    raw = network(28, 6, minutes, 7)
    raw["S3"] = raw["S3"][60 // minutes :] + [None] * (60 // minutes)
    done = T.t9_clock_offset(make(spark, raw, minutes))
    record = done.info["t9_clock_offset"]
    assert (record["min_lag"], record["max_lag"]) == lags
    tally = {r["station"]: r["n_flagged"] for r in record["tally"].collect()}
    assert tally["S3"] > 0 and sum(n for s, n in tally.items() if s != "S3") == 0
    assert [abs(abs(r["lag_min"]) - 60) <= 2 for r in record["episodes"].collect()] == [True]


def test_nobody_is_judged_when_half_the_network_is_off(spark):
    raw = network(28, 3, 10, 8)
    early = lambda k: make(spark, {**raw, "S3": raw["S3"][k:] + [None] * k}, 10)
    two = T.t9_clock_offset(early(12)).info["t9_clock_offset"]
    assert two["windows_undecided"].count() == 4 and all(r["n_judged"] == r["n_flagged"] == 0 for r in two["tally"].collect())
    half = T.t9_clock_offset(early(9)).info["t9_clock_offset"]
    tally = {r["station"]: r["n_flagged"] for r in half["tally"].collect()}
    assert tally["S3"] > 0 and tally["S1"] == tally["S2"] == 0 and half["windows_undecided"].count() == 0
    small = make(spark, {s: raw[s] for s in ("S1", "S2")}, 10)
    assert T.t9_clock_offset(small).info["t9_clock_offset"]["skipped"] and T.t8_diurnal_range(small).info["t8_diurnal_range"]["skipped"]


def test_fog_is_told_from_a_sensor_indoors(spark):
    rng = random.Random(7)
    at = [(i // DAY + 1, 2 * math.pi * (i % DAY * 10 - 540) / 1440) for i in range(30 * DAY)]
    calm = lambda d: 24 <= d <= 28
    weather = [5 + (2 if calm(d) else 3 * math.sin(2 * math.pi * d / 8)) for d, _ in at]
    raw = {f"S{k + 1}": [w + (0.6 if 8 <= d <= 12 else 4) * math.sin(a) + rng.gauss(0, 0.15) for (d, a), w in zip(at, weather)] for k in range(6)}
    for i, (d, a) in enumerate(at):
        if 15 <= d <= 19:
            raw["S6"][i] = 21 + 0.3 * math.sin(a)
        if 2 <= d <= 6:
            raw["S5"][i] = weather[i] + 0.5 * math.sin(a) + rng.gauss(0, 0.15)
        if calm(d):
            raw["S4"][i] = 21 + 0.3 * math.sin(a)
    panel = make(spark, raw, 10)
    done = T.t8_diurnal_range(panel)
    found = {s: [i for i, f in enumerate(flags(done, s)) if f == 8] for s in raw}
    assert found["S6"] == [i for i, (d, _) in enumerate(at) if 15 <= d <= 19] and not any(found[s] for s in raw if s != "S6")
    undecided = done.info["t8_diurnal_range"]["runs_undecided"].collect()
    assert [(r["station"], r["first"], r["last"]) for r in undecided] == [("S4", 24, 28)]
    tight = T.t8_diurnal_range(panel, min_network_swing=0.01)
    assert sum(f == 8 for f in flags(tight, "S4")) == 5 * DAY


def plain_fill(series, places, maxgap):
    out = list(series)
    for i, v in enumerate(series):
        if v is None:
            a = next((k for k in range(i - 1, -1, -1) if series[k] is not None), None)
            b = next((k for k in range(i + 1, len(series)) if series[k] is not None), None)
            if a is not None and b is not None and places[b] - places[a] - 1 <= maxgap:
                out[i] = series[a] + (series[b] - series[a]) * (places[i] - places[a]) / (places[b] - places[a])
    return out


@pytest.mark.parametrize("block_rows, holes", [(100_000, False), (11, False), (11, True)])
def test_gaps_against_a_plain_version(spark, monkeypatch, block_rows, holes):
    from stationloom.operators import kernels as K

    monkeypatch.setattr(K.blocks, "__defaults__", (block_rows,))
    rng = random.Random(9)
    places = [i for i in range(260) if not holes or rng.random() < 0.85]
    raw = {s: [round(rng.gauss(0, 5), 2) if rng.random() < 0.55 else None for _ in places] for s in ("A", "B")}
    rows = [(s, datetime(2025, 1, 1) + timedelta(hours=h), v) for s in raw for h, v in zip(places, raw[s])]
    panel = P.from_long(spark.createDataFrame(rows, "station string, ts timestamp, value double"), stations=["A", "B"])
    assert panel.facts.regular is not holes
    for maxgap in (1, 3, 8):
        done = T.t10_interpolate(panel, maxgap)
        for s in raw:
            want = plain_fill(raw[s], places, maxgap)
            assert [v is None for v in values(done, s)] == [v is None for v in want]
            assert all(a is None or abs(a - b) < 1e-9 for a, b in zip(want, values(done, s)))


def test_a_long_station_is_filled_in_linear_time(spark):
    import time

    rows = spark.range(200_000).select(P.F.lit("A").alias("station"), P.F.timestamp_seconds(P.F.col("id") * 600).alias("ts"), P.F.when(P.F.col("id") % 7 > 1, P.F.col("id").cast("double")).alias("value"))
    panel = P.from_long(rows)
    start = time.time()
    done = T.t10_interpolate(panel).cells.where("flag = 50 AND abs(value - (row_idx - 1)) < 1e-6").count()
    assert done == 57_142
    assert time.time() - start < 60


def test_tables_in_and_out(spark, tmp_path):
    (tmp_path / "raw.csv").write_bytes("\ufefftime;A;B\n01.06.2025 00:00;1.5;20\n01.06.2025 00:10;-45;21\n01.06.2025 00:20;2.5;\n".encode())
    (tmp_path / "places.csv").write_bytes("\ufeffID;Name;LON;LAT;Landuse;City\nA;x;7.4;46.9;Forest;Bern\nB;y;7.5;46.8;Water;Bern\nA;z;8.1;47.0;Forest;Biel\n".encode())
    table = P.read_csv(spark, str(tmp_path / "raw.csv"))
    assert table.columns == ["time", "A", "B"]
    numbers = table.select("time", *[P.F.col(c).cast("double").alias(c) for c in "AB"])
    panel = P.from_wide(numbers, "time", "%d.%m.%Y %H:%M")
    assert values(panel, "A") == [1.5, -45.0, 2.5] and values(panel, "B") == [20.0, 21.0, None]
    places = P.read_metadata(spark, str(tmp_path / "places.csv"), "Bern")
    assert [tuple(r) for r in places.orderBy("ID").collect()] == [("A", 46.9, 7.4, "Forest", None), ("B", 46.8, 7.5, "Water", None)]
    done = runner.run_temperature(panel, None, True, ["T1", "T10"])
    R.write_result(done, str(tmp_path / "out"))
    read = lambda name: [tuple(r) for r in spark.read.csv(str(tmp_path / "out" / name), header=True).orderBy("time").collect()]
    assert read("values") == [("2025-06-01 00:00:00", "1.5", "20.0"), ("2025-06-01 00:10:00", "2.0", "21.0"), ("2025-06-01 00:20:00", "2.5", None)]
    assert [r[1:] for r in read("flags")] == [("0", "0"), ("51", "0"), ("0", None)]
    assert "t1_gross_error" in [r[0] for r in spark.read.text(str(tmp_path / "out" / "info_text")).collect()]
    assert {r["key"] for r in spark.read.json(str(tmp_path / "out" / "info")).collect()} == set(done.info)


def test_time_order_is_noticed(spark):
    times = [datetime(2025, 1, 1) + timedelta(minutes=10 * i) for i in range(50)]
    frame = lambda ts, parts: spark.createDataFrame([(t,) for t in ts], "ts timestamp").coalesce(1).repartition(1) if parts == 1 else spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    for parts in (1, 4):
        assert P._in_order(frame(times, parts)) and not P._in_order(frame(times[:20] + times[21:] + [times[20]], parts)) and not P._in_order(frame(times[::-1], parts))


def test_running_median():
    from stationloom.operators.bias import running_median

    rng = random.Random(10)
    x = as_array([rng.gauss(0, 1) for _ in range(40)])
    got = running_median(x, 5)
    for i in range(2, 38):
        assert got[i] == sorted(x[i - 2 : i + 3])[2]
    assert got[1] == sorted([x[0], x[1], got[2]])[1] and got[-2] == sorted([x[-1], x[-2], got[-3]])[1]
    assert got[0] == sorted([x[0], got[1], 3 * got[1] - 2 * got[2]])[1]
    assert (running_median(x[:5], 5) == x[:5]).all() and (running_median(x, 1) == x).all()


def as_array(values):
    import numpy as np

    return np.array(values)


def test_a_shifted_station(spark):
    from stationloom.operators.bias import bias_shift

    rng = random.Random(12)
    weather = [10 + 5 * math.sin(d / 9) + rng.gauss(0, 1) for d in range(90)]
    raw = {f"S{k + 1}": [weather[i // 24] + 4 * math.sin(2 * math.pi * i / 24) + 0.4 * k + rng.gauss(0, 0.2) for i in range(90 * 24)] for k in range(5)}
    for i in range(50 * 24, 90 * 24):
        raw["S2"][i] += 2.5
    for i in range(70 * 24, 76 * 24):  # a front parts the stations for six days
        raw["S1"][i] += 4
        raw["S4"][i] -= 4
    raw["S3"][10 * 24 :] = [None] * (80 * 24)  # too short a record
    panel = make(spark, raw)
    done = bias_shift(panel)
    record = done.info["t9_bias_shift"]
    assert [r["station"] for r in record["never_evaluated"].collect()] == ["S3"]
    weather_days = {r[0].isoformat() for r in record["days_unjudged"].collect()}
    assert weather_days and all("2025-08-0" in d or "2025-08-1" in d for d in weather_days)
    found = flags(done, "S2")
    on = [d for d in range(90) if found[24 * d] == 9]
    assert on and min(on) in (49, 50, 51) and max(on) == 89 and all(f != 9 for s in ("S1", "S3", "S4", "S5") for f in flags(done, s))
    episode = record["episodes"].collect()
    assert len(episode) == 1 and abs(episode[0]["shift"] - 2.5) < 0.6
    assert bias_shift(make(spark, {"A": [1.0] * 48, "B": [2.0] * 48})).info["t9_bias_shift"]["skipped"]
    with pytest.raises(ValueError, match="ref_days"):
        bias_shift(panel, ref_days=3)
