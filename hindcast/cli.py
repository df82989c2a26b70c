"""python -m hindcast.cli COMMAND BASE ...: work on a folder of tables.

init, audit, normalize; migrate BASE TO; query SF_DIR NAME OUT (writes a query's rows as Parquet); queries (their names).
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from hindcast.plans import pipeline, registry


def run(spark: SparkSession, argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="hindcast")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "audit", "normalize"):
        sub.add_parser(name).add_argument("base")
    m = sub.add_parser("migrate")
    m.add_argument("base")
    m.add_argument("to")
    q = sub.add_parser("query")
    for x in ("base", "name", "out"):
        q.add_argument(x)
    sub.add_parser("queries")
    a = p.parse_args(argv)
    if a.command == "init":
        print(*pipeline.init(spark, a.base))
    elif a.command == "audit":
        pipeline.audit(spark, a.base).orderBy("table_name").show(100, truncate=False)
    elif a.command == "normalize":
        print(pipeline.normalize_all(spark, a.base, time.time()))
    elif a.command == "migrate":
        pipeline.migrate(spark, a.base, a.to)
    elif a.command == "query":
        registry.QUERIES[a.name](spark, a.base).write.mode("overwrite").parquet(a.out)
    else:
        print(*sorted(registry.QUERIES))
    return 0


if __name__ == "__main__":
    import sys

    raise SystemExit(run(SparkSession.builder.appName("hindcast").getOrCreate(), sys.argv[1:]))
