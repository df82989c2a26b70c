"""Reads by wallet: no slices of a week, in which hardly two events meet, and only what a feature needs of its episodes."""

from hindcast.operators import decisions as D
from hindcast.plans import decision_plans


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wallets_are_not_cut_by_weeks(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert "604800.0" not in _plan(decision_plans.features_actor(spark, sf_dir))
    assert "604800.0" not in _plan(decision_plans.position_asof(spark, sf_dir))


def test_anchors_are_those_of_episodes(spark):
    legs = spark.createDataFrame([("w", "c", float(t), "taker", "BUY", 1.0, 1) for t in (0, 5, 10, 19, 30)] + [("w", "d", 7.0, "maker", "BUY", 1.0, 1)], "wallet string, condition string, ts double, role string, side string, size double, sign int")
    want = [tuple(r) for r in D.episodes(legs, 10.0).select("wallet", "condition", "anchor").orderBy("anchor").collect()]
    assert [tuple(r) for r in D.anchors(legs, 10.0).orderBy("anchor").collect()] == want == [("w", "c", 0.0), ("w", "c", 10.0), ("w", "c", 30.0)]
