import pytest
from pyspark.sql import functions as F

from hindcast.sources import outputs as O


def test_outputs_round_trip(spark, tmp_path):
    base = str(tmp_path)
    O.write_run_outputs(spark.createDataFrame([(1, 0.5)], "decision_id long, p double"), base, {"loss": float("nan")}, {"k": 1}, {"all": ["a"]})
    assert O.read_json(spark, f"{base}/metrics.json") == {"loss": None}
    assert [tuple(r) for r in spark.read.csv(f"{base}/predictions", header=True, inferSchema=True).collect()] == [(1, 0.5)]
    records = spark.createDataFrame([("a", "accepted"), ("b", "ambiguous"), ("c", "accepted")], "decision_id string, status string")
    outcomes = spark.createDataFrame([("a", 24, "observed", 0.1), ("a", 6, "no_close", None)], "decision_id string, horizon int, status string, change double")
    assert O.write_records(records, outcomes, base) == {"accepted": 2, "ambiguous": 1}
    got = {r.decision_id: r for r in spark.read.json(f"{base}/drc_records").collect()}
    assert [o.horizon for o in got["a"].O] == [6, 24] and got["b"].O is None


def test_artifacts_refuse_other_features(spark, tmp_path):
    path = str(tmp_path / "model.json")
    O.save_artifact(spark, path, {"weights": [1.0, 2.0]}, ["x", "y"])
    assert O.load_artifact(spark, path, ["x", "y"]) == {"weights": [1.0, 2.0]}
    with pytest.raises(ValueError):
        O.load_artifact(spark, path, ["y", "x"])


def test_rationale(spark):
    rows = spark.createDataFrame([("FRESH_NEWS_RESPONSE", "fresh_news", 0.25, 0.5, ["a", "b"]), ("MIXED_OR_UNRESOLVED", None, 0.0, 0.0, [])], "t string, c string, d double, s double, f array<string>")
    got = [r[0] for r in rows.select(O.rationale(F.col("t"), F.col("c"), F.col("d"), F.col("s"), F.col("f"))).collect()]
    assert got == ["Read as fresh news response; the fresh news channel carries most of it (0.250 nats); it follows a, b; confidence 0.50.", "Read as mixed or unresolved; not accepted."]
