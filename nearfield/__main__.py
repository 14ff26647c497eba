"""python -m nearfield plan PROFILE | predeclare | analyze RECORDS COLLECTIONS OUTPUT

plan and predeclare print JSON. analyze reads two Parquet tables (records; collections with their provenance) and
writes tables, chart data and a report to a new folder.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearfield.plans import catalog, experiments
from nearfield.sources import sinks


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="nearfield", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    plan = commands.add_parser("plan")
    plan.add_argument("profile", choices=sorted(catalog.PROFILES))
    plan.add_argument("--memory-budget", type=int, default=catalog.MEMORY_BUDGET)
    commands.add_parser("predeclare")
    analyze = commands.add_parser("analyze")
    for name in ("records", "collections", "output"):
        analyze.add_argument(name)
    chosen = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("nearfield").getOrCreate()
    if chosen.command == "plan":
        print(json.dumps(catalog.plan_manifest(spark, chosen.profile, chosen.memory_budget), sort_keys=True, indent=2))
    elif chosen.command == "predeclare":
        print(json.dumps(experiments.predeclaration(spark), sort_keys=True, indent=2))
    else:
        records = spark.read.parquet(chosen.records)
        digest = records.agg(F.sha2(F.concat_ws(",", F.sum(F.shiftright(F.xxhash64(*sorted(records.columns)), 16)), F.count("*")), 256)).first()[0]
        sinks.write_bundle(sinks.Analysis.of(records, spark.read.parquet(chosen.collections), f"sha256:{digest}"), chosen.output)


if __name__ == "__main__":
    main()
