import pytest
from pyspark.sql import functions as F

from hindcast.sources import schemas


def test_all_tables_have_their_keys(spark):
    assert len(schemas.TABLES) == 27
    for name, (_, key, at, _) in schemas.TABLES.items():
        names = schemas.schema(name).fieldNames()
        assert set(key) <= set(names) and (at is None or at in names) and len(set(names)) == len(names)


def test_append_is_idempotent_and_old_files_read(spark, tmp_path):
    rows = spark.createDataFrame([("w", "a", 1.0, "5"), ("w", "a", 1.0, "6"), ("w", "b", 2.0, "x")], "wallet string, asset string, observed_at double, reported_size string")
    base = str(tmp_path)
    schemas.append_new(spark, base, "position_snapshots", rows, first=True)
    schemas.append_new(spark, base, "position_snapshots", rows.union(rows.withColumn("asset", F.lit("c"))))
    got = schemas.read(spark, base, "position_snapshots")
    assert sorted(r.asset for r in got.collect()) == ["a", "b", "c", "c"] and got.where("asset = 'b'").first().reported_size is None
    assert schemas.known_before(got, "position_snapshots", 2.0).where("asset = 'b'").count() == 0
    with pytest.raises(ValueError):
        schemas.known_before(got, "markets", 1.0)
    with pytest.raises(ValueError):
        schemas.assert_no_future(got.withColumn("t", F.lit(2.0)), "t", ["observed_at"])
    schemas.assert_no_future(got.withColumn("t", F.lit(2.1)), "t", ["observed_at"])
