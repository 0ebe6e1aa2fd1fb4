"""Each level against planted errors and plain versions."""

import math
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from test_panel import flags, make, values

from stationloom.operators import humidity as H
from stationloom.operators import kernels as K
from stationloom.operators import temperature as T
from stationloom.plans import report as R


def diurnal(n, per_day, seed, swing=5.0, base=18.0):
    rng = random.Random(seed)
    return [base + swing * math.sin(2 * math.pi * i / per_day) + rng.gauss(0, 0.1) for i in range(n)]


def near(spark, n, step=0.002, **extra):
    rows = [(f"S{i + 1}", 47.0 + step * i, 7.4, "Sealed Areas", extra.get(f"S{i + 1}")) for i in range(n)]
    return spark.createDataFrame(rows, "ID string, LAT double, LON double, Landuse string, ELEV double")


def test_spikes_against_a_plain_version(spark):
    rng = random.Random(1)
    series = [None if rng.random() < 0.2 else round(rng.gauss(10, 3), 2) for _ in range(300)]

    def plain(v, dt, thr):
        out = []
        for i in range(len(v)):
            around = [x for x in v[max(0, i - dt) : i + dt + 1] if x is not None]
            before = [x for x in v[max(0, i - dt) : i] if x is not None]
            after = [x for x in v[i + 1 : i + dt + 1] if x is not None]
            judged = v[i] is not None and 0 < i < len(v) - 1 and len(around) >= 1 + dt and before and after
            out.append(bool(judged and all(abs(v[i] - statistics.median(m)) >= thr for m in (around, before, after))))
        return out

    panel = make(spark, {"A": series})
    want = plain(series, 3, 4)
    assert sum(want) > 3
    for size in (K.BLOCK_ROWS, 17):  # a long series is cut into blocks
        found = K.blocks(panel.cells, 3, 3, size)
        assert found.where("NOT margin").count() == 300
    assert [f == 3 for f in flags(T.t3_time_consistency(panel), "A")] == want


def test_blocks_give_the_same_windows(spark, monkeypatch):
    rng = random.Random(2)
    panel = make(spark, {"A": [rng.choice([None, 1.0, 1.0, 5.0, 9.0]) for _ in range(200)]})
    whole = flags(T.t3_time_consistency(panel, 3, 2), "A"), flags(T.t4_stuck_values(panel, "3 hours", 0.5, 2, 0.1), "A")
    monkeypatch.setattr(K.blocks, "__defaults__", (13,))
    assert whole == (flags(T.t3_time_consistency(panel, 3, 2), "A"), flags(T.t4_stuck_values(panel, "3 hours", 0.5, 2, 0.1), "A"))
    assert any(f == 3 for f in whole[0]) and any(f == 4 for f in whole[1])


def test_stuck_sensor(spark):
    series = diurnal(200, 144, 3)
    series[60:106] = [20.0] * 46
    done = T.t4_stuck_values(make(spark, {"A": series}, 10))
    assert [i for i, f in enumerate(flags(done, "A")) if f == 4] == list(range(60, 106))


def test_humidity_near_saturation_is_not_stuck(spark):
    series = [60 + 10 * math.sin(i / 9) for i in range(200)]
    series[20:70] = [98.0] * 50
    series[120:170] = [55.0] * 50
    done = H.rh4_stuck_values(make(spark, {"A": series}, 10, "humidity"), sat_quantile=None)
    assert {i for i, f in enumerate(flags(done, "A")) if f == 4} == set(range(120, 170))


def test_gap_fill(spark):
    series = [1.0, None, 3.0, None, None, None, None, None, None, 10.0, 11.0, None]
    done = T.t10_interpolate(make(spark, {"A": series}))
    assert values(done, "A")[:4] == [1.0, 2.0, 3.0, None] and flags(done, "A")[1] == 50
    assert values(done, "A")[3:9] == [None] * 6 and values(done, "A")[11] is None


def test_gap_length_counts_on_the_full_grid(spark):
    from stationloom.sources import panel as P

    start = datetime(2025, 1, 1)
    rows = [("A", start + timedelta(hours=h), v) for h, v in [(0, 1.0), (1, 2.0), (2, 3.0), (3, None), (10, 10.0), (11, 11.0), (12, 12.0)]]
    with pytest.warns(UserWarning):
        panel = P.from_long(spark.createDataFrame(rows, "station string, ts timestamp, value double"))
    assert values(T.t10_interpolate(panel), "A")[3] is None
    assert values(T.t10_interpolate(panel, 7), "A")[3] == 3 + 7 / 8


def test_climatology(spark):
    rng = random.Random(5)
    day = [rng.uniform(-3, 3) for _ in range(800)]  # no tails: only the planted day is extreme
    series = [10 + day[i // 24] + 5 * math.sin(2 * math.pi * i / 24) for i in range(24 * 760)]
    series[24 * 400 + 10] += 60
    done = T.t5_climatic_outliers(make(spark, {"A": series}), min_days=50)
    assert [i for i, f in enumerate(flags(done, "A")) if f == 5] == [24 * 400 + 10]
    short = T.t5_climatic_outliers(make(spark, {"A": series[: 24 * 90]}), min_days=20)
    assert all(f == 0 for f in flags(short, "A")) and short.info["t5_climatic_outliers"]["refused"].count() >= 3


def plain_removal(values, w, k_sigma, floor, least):
    out = np.zeros(values.shape, bool)
    for i, row in enumerate(values.copy()):
        while True:
            best = (1.0, None)
            for j in range(len(row)):
                at = [k for k in range(len(row)) if w[j, k] > 0 and not np.isnan(row[k])]
                if np.isnan(row[j]) or len(at) < least or (~np.isnan(row)).sum() < 2:
                    continue
                mu = np.average(row[at], weights=w[j, at])
                sig = math.sqrt((w[j, at] * (row[at] - mu) ** 2).sum() / w[j, at].sum())
                ratio = abs(row[j] - mu) / max(k_sigma * sig, floor)
                if ratio > best[0]:
                    best = (ratio, j)
            if best[1] is None:
                break
            row[best[1]] = np.nan
            out[i, best[1]] = True
    return out


def test_removal_loop_against_a_plain_version():
    rng = np.random.default_rng(4)
    values = rng.normal(10, 2, (150, 6))
    values[rng.random(values.shape) < 0.15] = np.nan
    values[rng.random(values.shape) < 0.05] += 15
    w = np.exp(-rng.random((6, 6)))
    np.fill_diagonal(w, 0)
    want = plain_removal(values, w, 2, 3, 2)
    pairs = [(i + 1, j + 1, w[i, j]) for i in range(6) for j in range(6) if w[i, j] > 0]
    assert want.sum() > 10 and (K.remove_outliers(values, *K.neighbour_arrays(pairs, 6), 2, 3, 2) == want).all()


def test_neighbours_find_the_odd_one(spark):
    series = {f"S{i + 1}": diurnal(60, 24, 9 + i) for i in range(5)}
    series["S3"][30] += 20
    done = T.t6_spatial_consistency(make(spark, series), near(spark, 5))
    assert [i for i, f in enumerate(flags(done, "S3")) if f == 6] == [30]
    assert all(f == 0 for s in series if s != "S3" for f in flags(done, s))
    assert T.t6_spatial_consistency(make(spark, series)).info["t6_spatial_consistency"]["skipped"]


def test_elevation_keeps_a_mountain_apart(spark):
    series = {f"S{i + 1}": diurnal(48, 24, 20 + i) for i in range(5)}
    series["S5"] = [v - 12 for v in series["S5"]]
    low, high = near(spark, 5), near(spark, 5, S1=560.0, S2=561.0, S3=562.0, S4=563.0, S5=944.0)
    assert any(f == 6 for f in flags(T.t6_spatial_consistency(make(spark, series), low), "S5"))
    assert all(f == 0 for f in flags(T.t6_spatial_consistency(make(spark, series), high), "S5"))


def test_spatiotemporal_extreme(spark):
    series = {f"S{i + 1}": diurnal(600, 144, 30 + i) for i in range(6)}
    series["S3"][300] += 10
    done = T.t7_spatiotemporal_consistency(make(spark, series, 10), near(spark, 6))
    assert [i for i, f in enumerate(flags(done, "S3")) if f == 7] == [300]


def test_indoor_sensor(spark):
    rng = random.Random(7)
    drift = [rng.gauss(0, 3) for _ in range(12)]
    series = {f"S{i + 1}": [v + drift[k // 24] for k, v in enumerate(diurnal(24 * 12, 24, 40 + i))] for i in range(4)}
    series["S4"][24 * 3 : 24 * 8] = [21 + rng.gauss(0, 0.1) for _ in range(24 * 5)]
    done = T.t8_diurnal_range(make(spark, series))
    assert [i for i, f in enumerate(flags(done, "S4")) if f == 8] == list(range(24 * 3, 24 * 8))
    assert all(f == 0 for s in ("S1", "S2", "S3") for f in flags(done, s))


def test_clock_offset(spark):
    rng = random.Random(8)
    base = [15 + 6 * math.sin(2 * math.pi * i / 144) + 2 * math.sin(i / 37) for i in range(144 * 35 + 20)]
    series = {f"S{i + 1}": [b + rng.gauss(0, 0.2) for b in base[: 144 * 35]] for i in range(5)}
    cut = 144 * 14
    series["S2"] = series["S2"][:cut] + [b + rng.gauss(0, 0.2) for b in base[cut + 6 : 144 * 35 + 6]]
    done = T.t9_clock_offset(make(spark, series, 10))
    assert [f == 9 for f in flags(done, "S2")] == [i >= cut for i in range(144 * 35)]
    assert all(f == 0 for f in flags(done, "S1"))
    episode = done.info["t9_clock_offset"]["episodes"].collect()
    assert len(episode) == 1 and episode[0]["station"] == "S2" and episode[0]["windows"] == 3 and abs(episode[0]["lag_min"]) == 60


def test_loo_median(spark):
    rng = random.Random(9)
    series = {f"S{i}": [None if rng.random() < 0.2 else float(rng.randint(0, 5)) for _ in range(80)] for i in range(5)}
    for r in K.loo_median(make(spark, series).cells).collect():
        others = [series[s][r["row_idx"] - 1] for s in series if s != r["station"]]
        others = [x for x in others if x is not None]
        assert r["net"] == (statistics.median(others) if others else None)


def test_humidity_chain(spark):
    n = 24 * 10
    temp = {f"S{i + 1}": diurnal(n, 24, 50 + i) for i in range(5)}
    humid = {s: [100 - 3 * v + 0.2 * math.sin(i) for i, v in enumerate(temp[s])] for s in temp}
    humid["S1"][5] = 130.0
    humid["S2"][24 * 3 : 24 * 6] = [60.0] * 72  # dead element: constant, so undefined correlation
    temp["S3"][7] = 99.0
    t, h = T.t1_gross_error(make(spark, temp)), make(spark, humid, what="humidity")
    assert flags(H.rh2_range(h), "S1")[5] == 2
    done = H.rh1_inherit_temperature(h, t)
    assert flags(done, "S3")[7] == 1 and "t1_gross_error" in done.info
    found = flags(H.rh5_decoupling(h, t), "S2")
    assert [i for i, f in enumerate(found) if f == 5] == list(range(72, 144))
    assert H.rh5_decoupling(h).info["rh5_decoupling"]["skipped"]
    h.cells.unpersist()


def test_saturation_drift_and_dewpoint(spark):
    n = 24 * 4
    humid = {f"S{i + 1}": [99.0 if 24 <= k < 48 else 70.0 for k in range(n)] for i in range(5)}
    humid["S3"][24:48] = [80.0] * 24
    h = make(spark, humid, what="humidity")
    done = H.rh6_saturation_drift(h)
    assert [i for i, f in enumerate(flags(done, "S3")) if f == 6] == list(range(24, 48))
    assert H.rh6_saturation_drift(h, network_min=99.5).info["rh6_saturation_drift"]["skipped"]
    humid["S4"][60] = 10.0
    temp = make(spark, {s: [15.0] * n for s in humid})
    done = H.rh7_dewpoint_consistency(make(spark, humid, what="humidity"), temp, near(spark, 5))
    assert flags(done, "S4")[60] == 7


def test_reports(spark):
    done = T.t2_out_of_range(T.t1_gross_error(make(spark, {"A": [-45.0, 55.0, 20.0, None], "B": [1.0, 2.0, 3.0, 4.0]})))
    rows = {(r["level"], r["station"]): r for r in R.summary(done).collect()}
    assert rows["t1_gross_error", "A"]["flagged"] == 1 and rows["t2_out_of_range", "A"]["judged"] == 2
    assert {(r["level"], r["n"]) for r in R.timeline_table(done).collect()} == {(1, 1), (2, 1)}
    assert {r["station"]: r["share"] for r in R.calendar_table(done).collect()} == {"A": 66.6667, "B": 0.0}
    assert R.level_table(done, "station").count() == 2 and R.station_table(done, "B", end="2025-06-01").count() == 4


def test_stream(spark, tmp_path):
    from stationloom.streaming.stateless import flag_temperature

    spark.sql("SELECT 'A' AS station, timestamp'2025-01-01 00:00:00' AS ts, double(99) AS value UNION ALL SELECT 'A', timestamp'2025-07-01 00:00:00', double(20)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    query = flag_temperature(stream).writeStream.format("memory").queryName("flagged").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r["value"], r["flag"]) for r in spark.table("flagged").collect()} == {(None, 1), (20.0, 0)}
