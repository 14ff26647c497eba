"""Benchmark records: from run-group files, or surrogate rows made from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import InvalidParameter
from nearfield.operators.study import UNITS

RECORD = (
    "collection string, run_index long, source string, implementation string, case_name string, metric string, value double, unit string, objective string, profile string, "
    "corpus_size long, dimension long, query_count long, k long, dtype string, rounds long, iterations long, sample_count long, p50_seconds double, p90_seconds double, p95_seconds double, p99_seconds double"
)
#: Files that describe a collection, in its folder
MANIFESTS = "*manifest.json"
# The statistic that is a metric's value.
STATISTIC = {"single_call_latency": "latency_median", "batch_throughput": "throughput_median", "tail_latency": "p95"}


def collection_folders(spark: SparkSession, root: str, manifests: str = MANIFESTS) -> DataFrame:
    """(collection): folders under root, at any depth, whose manifest is of a benchmark run group; an error if there are none."""
    found = spark.read.schema("kind string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", manifests).json(root)
    folders = found.where("kind = 'benchmark_run_group'").select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("collection")).distinct()
    if not folders.head(1):
        raise InvalidParameter(f"no benchmark run groups under {root}")
    return folders


def read_run_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of run-group files: one for each run and benchmark row. A file that isn't such a JSON object is an error."""
    groups = spark.read.schema(_group_schema()).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    runs = groups.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("collection"), F.posexplode("runs").alias("at", "run"))
    rows = runs.select("collection", (F.col("at") + 1).cast("long").alias("run_index"), F.col("run.source").alias("source"), F.explode("run.benchmarks").alias("b"))
    value, unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    for metric, statistic in STATISTIC.items():
        value = F.when(F.col("b.metric_name") == metric, F.col(f"b.derived.{statistic}")).otherwise(value)
        unit = F.when(F.col("b.metric_name") == metric, F.lit(UNITS[metric])).otherwise(unit)
    required = lambda c, name: F.coalesce(c, F.raise_error(F.lit(f"{name} is missing or of the wrong type")))
    case = lambda name: required(F.col(f"b.extra_info.case_{name}"), f"case_{name}").alias(name)
    return rows.select(
        "collection", "run_index", "source", F.col("b.implementation_name").alias("implementation"), F.col("b.case_name").alias("case_name"), F.col("b.metric_name").alias("metric"),
        required(value, "value").cast("double").alias("value"), unit.alias("unit"), case("objective"), case("profile"), case("corpus_size"), case("dimension"), case("query_count"), case("k"), case("dtype"),
        required(F.col("b.stats.rounds"), "rounds").cast("long").alias("rounds"), required(F.col("b.stats.iterations"), "iterations").cast("long").alias("iterations"),
        F.coalesce(F.size("b.samples"), F.lit(0)).cast("long").alias("sample_count"),
        *[F.col(f"b.derived.p{p}").alias(f"p{p}_seconds") for p in (50, 90, 95, 99)],
    )


def _group_schema() -> str:
    row = (
        "implementation_name: string, case_name: string, metric_name: string, derived: struct<latency_median: double, throughput_median: double, p50: double, p90: double, p95: double, p99: double>, "
        "extra_info: struct<case_objective: string, case_profile: string, case_corpus_size: bigint, case_dimension: bigint, case_query_count: bigint, case_k: bigint, case_dtype: string>, "
        "stats: struct<rounds: bigint, iterations: bigint>, samples: array<double>"
    )
    return f"kind string, is_complete boolean, runs array<struct<source: string, benchmarks: array<struct<{row}>>>>"


#: Points that surrogate rows are dealt to: profile, corpus_size, dimension, query_count, k
POINTS = (
    ("discovery-core", 10_000, 128, 32, 10), ("discovery-core", 10_000, 128, 32, 1), ("discovery-core", 10_000, 128, 32, 100), ("discovery-core", 1_000, 128, 32, 10),
    ("discovery-core", 100_000, 128, 32, 10), ("discovery-core", 10_000, 8, 32, 10), ("discovery-core", 10_000, 32, 32, 10), ("discovery-core", 10_000, 128, 1, 10),
    ("discovery-small", 1_000, 8, 1, 10), ("discovery-small", 1_000, 32, 1, 10), ("discovery-small", 1_000, 128, 1, 10), ("discovery-small", 1_000, 768, 1, 10),
)

#: SQL that both Spark and DuckDB run over the events table. The rows exercise the study operators; they measure nothing.
SURROGATE_SQL = f"""
SELECT concat('collection-', CAST(event_id % 2 AS VARCHAR(1))) AS collection, event_id % 5 + 1 AS run_index, CAST(event_id AS VARCHAR(20)) AS source, implementation,
       concat(profile, '__', objective, '__n', CAST(corpus_size AS VARCHAR(9)), '__d', CAST(dimension AS VARCHAR(9)), '__q', CAST(query_count AS VARCHAR(9)), '__k', CAST(k AS VARCHAR(9)), '__float32') AS case_name,
       metric, value, CASE metric WHEN 'single_call_latency' THEN 'seconds' WHEN 'batch_throughput' THEN 'queries_per_second' ELSE 'p95_seconds' END AS unit,
       objective, profile, corpus_size, dimension, query_count, k, 'float32' AS dtype, 5 + event_id % 6 AS rounds, 1 AS iterations, 100 + event_id % 50 AS sample_count
FROM (
  SELECT event_id, value,
    CASE event_type WHEN 'click' THEN 'numpy_full' WHEN 'error' THEN 'numpy_argpartition' WHEN 'purchase' THEN 'numpy_blocked' WHEN 'signup' THEN 'python_heap' ELSE 'python_sort' END AS implementation,
    CASE user_id % 3 WHEN 0 THEN 'squared_l2' WHEN 1 THEN 'inner_product' ELSE 'normalized_cosine' END AS objective,
    CASE event_id % 3 WHEN 0 THEN 'single_call_latency' WHEN 1 THEN 'batch_throughput' ELSE 'tail_latency' END AS metric,
    CASE {" ".join(f"WHEN user_id % 12 = {i} THEN '{p[0]}'" for i, p in enumerate(POINTS))} END AS profile,
    CASE {" ".join(f"WHEN user_id % 12 = {i} THEN {p[1]}" for i, p in enumerate(POINTS))} END AS corpus_size,
    CASE {" ".join(f"WHEN user_id % 12 = {i} THEN {p[2]}" for i, p in enumerate(POINTS))} END AS dimension,
    CASE {" ".join(f"WHEN user_id % 12 = {i} THEN {p[3]}" for i, p in enumerate(POINTS))} END AS query_count,
    CASE {" ".join(f"WHEN user_id % 12 = {i} THEN {p[4]}" for i, p in enumerate(POINTS))} END AS k
  FROM events WHERE value IS NOT NULL
) e
"""


def surrogate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("nearfield_events")
    return spark.sql(SURROGATE_SQL.replace("FROM events", "FROM nearfield_events"))
