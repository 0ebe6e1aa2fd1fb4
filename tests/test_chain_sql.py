"""A chain over small events against its registered SQL, where a level has nothing to judge and means end in halves."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stationloom.functions.columns import rounded
from stationloom.operators import humidity as H
from stationloom.plans import queries as Q
from stationloom.plans import report as R
from test_panel import make

LEVEL = "rh6_saturation_drift"
HALF = [150.0, 150.0001]  # the mean is just at the first level's bound, or above it by one digit


def test_means_are_rounded_as_in_the_sql(spark):
    rows = [(38.19875,), (55.661249999999995,), (-38.19875,), (0.5,), (None,)]
    table = spark.createDataFrame(rows, "v double")
    assert [r[0] for r in table.select(rounded(table["v"], 4)).collect()] == [38.1987, 55.6613, -38.1987, 0.5, None]


def test_a_level_that_skipped_itself_judged_nothing(spark):
    done = H.rh6_saturation_drift(H.rh2_range(make(spark, {s: [50.0, 51.0] for s in "ABC"}, what="humidity")))
    assert done.info[LEVEL]["skipped"] and {r["level"] for r in R.summary(done).collect()} == {"rh2_range"}
    rows = [tuple(r) for r in R.summary(done, "rh", True).where(f"level = '{LEVEL}'").collect()]
    assert sorted(rows) == [(LEVEL, s, 0, 0, 0.0) for s in "ABC"]


def test_humidity_chain_of_a_dry_network_is_that_of_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    ts, user, value = [], [], []
    for hour in range(96):
        for k in range(6):
            at = datetime(2024, 1, 1) + timedelta(hours=hour)
            # users 0 to 47: the network's median never reaches 60; S2's temperatures rest on halves of the last digit
            for j, v in enumerate(HALF if k == 2 and hour % 8 == 0 else [20.0 + (hour * 7 + k * 5) % 24] * 2):
                ts.append(at + timedelta(minutes=j)), user.append(k + 6 * ((hour * 5 + j * 3 + k) % 8)), value.append(v)
    table = pa.table({"event_id": range(len(ts)), "ts": pa.array(ts, pa.timestamp("us")), "user_id": user, "value": value})
    pq.write_table(table, tmp_path / "events.parquet")
    found = sorted(map(tuple, Q.queries()["humidity_chain"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        want = sorted(db.execute(Q.oracle_sql()["humidity_chain"]).fetchall())
    assert [r[2:] for r in found if r[0] == LEVEL] == [(0, 0, 0.0)] * 6
    assert found == want
