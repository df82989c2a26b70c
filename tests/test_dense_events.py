"""Events so dense that pairs, frames read anew for each row, or gaps without end would show."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from hindcast.operators.surfaces import Probe, Surface, read_surfaces
from hindcast.plans import decision_plans, regime_plans


@pytest.fixture
def dense(tmp_path):
    """3,000 events in five hours, a sixth of them copies of one another but for their number; every one opens a gap."""
    duckdb.connect().execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-02' + INTERVAL (i // 6 * 36) SECOND AS ts, (['click', 'error', 'purchase', 'signup', 'view'])[(i // 6) % 5 + 1] AS event_type, i % 7 AS user_id,
        200.0::DOUBLE + i // 6 % 3 AS value FROM range(3000) r(i)) TO '{tmp_path}/events.parquet'""")
    return str(tmp_path)


def test_features_market_makes_no_pairs(spark, dense):
    made = decision_plans.features_market(spark, dense)
    assert not re.search(r"\(ts#\d+ < t#\d+\)", made._jdf.queryExecution().optimizedPlan().toString())
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{dense}/events.parquet'")
    want = db.execute(decision_plans.ORACLE["features_market"])
    names = [d[0] for d in want.description]
    found = made.select(*names)
    assert sorted(tuple(map(float, r)) for r in found.collect()) == sorted(tuple(map(float, r)) for r in want.fetchall())


def test_jump_model_is_empty_where_gaps_leave_no_bars(spark, dense):
    assert regime_plans.jump_model(spark, dense).collect() == []


def test_surfaces_look_ahead_without_frames_to_the_end(spark):
    rows = spark.createDataFrame([(1, float(i), i) for i in range(50)], "k int, ts double, v int")
    looks = spark.createDataFrame([(1, 9.5, "a"), (1, 9.0, "b"), (1, 49.0, "c"), (1, -1.0, "d")], "k int, t double, id string")
    probes = [Probe("strict", F.col("t")), Probe("with", F.col("t"), strict=False)]
    read = read_surfaces(looks, ["k"], ["id"], probes, [Surface("s", rows, "ts", last=("v",), ahead=("v",), order=("v",))], slice_seconds=20.0)
    assert "unboundedfollowing" not in read._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["id"]: (r["s_strict"]["ahead"] and r["s_strict"]["ahead"]["v"], r["s_with"]["ahead"] and r["s_with"]["ahead"]["v"]) for r in read.collect()}
    assert got == {"a": (10, 10), "b": (9, 10), "c": (49, None), "d": (0, 0)}
