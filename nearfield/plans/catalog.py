"""The study's plan as relations: workloads, implementations, and which pairs of them can be measured."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.errors import InvalidParameter
from nearfield.operators.validate import positive_int

# Fixed values of the study.
DIMENSIONS = (8, 32, 128, 768)
CORPUS_SIZES = (1_000, 10_000, 100_000, 1_000_000)
QUERY_COUNTS = (1, 32, 1_024)
K_VALUES = (1, 10, 100)
OBJECTIVES = ("squared_l2", "inner_product", "normalized_cosine")
ANCHOR = {"corpus_size": 10_000, "dimension": 128, "query_count": 32, "k": 10}
SEED = 20_260_801
MEMORY_BUDGET = 8 * 1024**3
SCALAR_LIMIT = 1_000_000
BLOCK = 16_384
METRICS = ("single_call_latency", "batch_throughput")
TAIL_METRIC = "tail_latency"
# name, objectives, optional dependency, float32 only
IMPLEMENTATIONS = (
    ("python_sort", OBJECTIVES, None, False),
    ("python_heap", OBJECTIVES, None, False),
    ("numpy_full", OBJECTIVES, None, False),
    ("numpy_argpartition", OBJECTIVES, None, False),
    ("numpy_blocked", OBJECTIVES, None, False),
    ("sklearn_brute", ("squared_l2", "normalized_cosine"), "scikit-learn", False),
    ("sklearn_kdtree", ("squared_l2", "normalized_cosine"), "scikit-learn", False),
    ("sklearn_balltree", ("squared_l2", "normalized_cosine"), "scikit-learn", False),
    ("scipy_ckdtree", ("squared_l2", "normalized_cosine"), "scipy", False),
    ("faiss_flat_l2", ("squared_l2",), "faiss-cpu", True),
    ("faiss_flat_ip", ("inner_product", "normalized_cosine"), "faiss-cpu", True),
    ("torch_matmul_topk", OBJECTIVES, "torch", False),
)
MODULES = {"scikit-learn": "sklearn", "faiss-cpu": "faiss"}
#: The engine's strategy that does the work of each implementation
STRATEGY_OF = {
    "python_sort": "window", "python_heap": "heap", "numpy_full": "full_sort", "numpy_argpartition": "window", "numpy_blocked": "blocked", "sklearn_brute": "blocked",
    "sklearn_kdtree": "pivot", "sklearn_balltree": "pivot", "scipy_ckdtree": "pivot", "faiss_flat_l2": "blocked", "faiss_flat_ip": "blocked", "torch_matmul_topk": "blocked",
}
NATURAL_DATASET = {
    "dataset": "BeIR/scifact", "dataset_revision": "a75ae049398addde9b70f6b268875f5cbce99089",
    "model": "sentence-transformers/all-MiniLM-L6-v2", "model_revision": "c9745ed1d9f207416be6d2e6f8de32d1f16199bf",
    "dimension": 384, "corpus_size": 5_183, "query_count": 1_109, "dtype": "float32", "normalization": "l2_unit_rows",
}



def natural_dataset(spark: SparkSession) -> DataFrame:
    """The manifest of the natural dataset, in one row."""
    return spark.createDataFrame([tuple(NATURAL_DATASET.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in NATURAL_DATASET.items()))


POINT = ["objective", "corpus_size", "dimension", "query_count", "k"]


def case_name() -> Column:
    return F.format_string("%s__%s__n%d__d%d__q%d__k%d__%s", "profile", "objective", "corpus_size", "dimension", "query_count", "k", "dtype")


def _finished(points: DataFrame, profile: str) -> DataFrame:
    """Workloads from points: the derived columns are computed, not stored."""
    named = points.select(*POINT, F.lit("float32").alias("dtype"), F.lit(SEED).cast("long").alias("seed"), F.lit(profile).alias("profile"))
    return named.withColumn("case_name", case_name()).withColumn("coordinate_evaluations", F.expr("corpus_size * dimension * query_count"))


def _objectives(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(o) for o in OBJECTIVES])).alias("objective"))


def _anchored(frame: DataFrame, **levels: tuple[int, ...]) -> DataFrame:
    """frame times the anchor, with the named factor at its levels other than the anchor's (or at them all if none is named)."""
    for factor, base in ANCHOR.items():
        wanted = [v for v in levels[factor] if v != base] if factor in levels else [base]
        frame = frame.withColumn(factor, F.explode(F.array(*[F.lit(v).cast("long") for v in wanted])))
    return frame


def core(spark: SparkSession) -> DataFrame:
    """One factor at a time around the anchor, for each objective: 33 workloads."""
    objectives = _objectives(spark)
    sweeps = _anchored(objectives)
    for factor, levels in (("dimension", DIMENSIONS), ("corpus_size", CORPUS_SIZES), ("query_count", QUERY_COUNTS), ("k", K_VALUES)):
        sweeps = sweeps.unionByName(_anchored(objectives, **{factor: levels}))
    return _finished(sweeps, "discovery-core")


def small(spark: SparkSession) -> DataFrame:
    points = _objectives(spark).withColumn("dimension", F.explode(F.array(*[F.lit(d).cast("long") for d in DIMENSIONS])))
    return _finished(points.withColumn("corpus_size", F.lit(1000).cast("long")).withColumn("query_count", F.lit(1).cast("long")).withColumn("k", F.lit(10).cast("long")), "discovery-small")


def stress(spark: SparkSession) -> DataFrame:
    """The core's points that isolate a costly factor."""
    return _finished(core(spark).where("corpus_size = 1000000 or query_count = 1024 or dimension = 768"), "discovery-stress")


def standard(spark: SparkSession) -> DataFrame:
    """The core without the stress points."""
    return core(spark).join(stress(spark).select(*POINT), POINT, "left_anti")


def smoke(spark: SparkSession) -> DataFrame:
    return _finished(small(spark).where("dimension = 8"), "smoke")


PROFILES: dict[str, Callable[[SparkSession], DataFrame]] = {"smoke": smoke, "small": small, "core": standard, "stress": stress}


def workloads(spark: SparkSession, profile: str) -> DataFrame:
    if profile not in PROFILES:
        raise InvalidParameter("profile must be one of: " + ", ".join(sorted(PROFILES)))
    return PROFILES[profile](spark)


def implementations(spark: SparkSession) -> DataFrame:
    schema = "position int, name string, objectives array<string>, optional_dependency string, float32_only boolean"
    return spark.createDataFrame([(k, *row) for k, row in enumerate(IMPLEMENTATIONS)], schema)


def is_installed(dependency: str | None) -> bool:
    return dependency is None or importlib.util.find_spec(MODULES.get(dependency, dependency)) is not None


def item_size() -> Column:
    return F.when(F.col("dtype") == "float64", 8).otherwise(4).cast("long")


def peak_bytes(implementation: Column) -> Column:
    """Bytes of the dominant allocations: dataset and index, queries, output, and what the implementation adds."""
    item = item_size()
    corpus, n, q = F.col("corpus_size") * F.col("dimension") * item, F.col("corpus_size"), F.col("query_count")
    scores, output = n * q * item, q * F.col("k") * (item + 8)
    extra = (
        F.when(implementation == "numpy_full", scores + n * q * 8)
        .when(implementation.isin("numpy_argpartition", "torch_matmul_topk"), scores + n * 8)
        .when(implementation == "numpy_blocked", F.least(n, F.lit(BLOCK).cast("long")) * q * item + output)
        .when(implementation.startswith("sklearn_") | implementation.startswith("scipy_"), corpus * 2)
        .when(implementation.startswith("faiss_"), corpus)
        .otherwise(F.lit(0).cast("long"))
    )
    return corpus * 2 + q * F.col("dimension") * item + output + extra


def metrics() -> Column:
    """Metrics of a workload; tails are measured where calls are short, and at the anchor."""
    at_anchor = F.col("profile") == "discovery-core"
    for factor, value in ANCHOR.items():
        at_anchor = at_anchor & (F.col(factor) == value)
    both = F.array(*[F.lit(m) for m in METRICS])
    return F.when(F.col("profile").isin("smoke", "discovery-small") | at_anchor, F.array_append(both, F.lit(TAIL_METRIC))).otherwise(both)


def assess(pairs: DataFrame, memory_budget: int = MEMORY_BUDGET) -> DataFrame:
    """pairs (workload and implementation columns) with estimated_peak_bytes and feasibility, the first rule that fails."""
    positive_int(memory_budget, "memory_budget")
    reason = (
        F.when(~F.array_contains("objectives", F.col("objective")), "objective_not_supported")
        .when(F.col("float32_only") & (F.col("dtype") != "float32"), "dtype_not_supported")
        .when(F.col("name").startswith("python_") & (F.col("coordinate_evaluations") > SCALAR_LIMIT), "scalar_runtime_limit")
        .when(F.col("estimated_peak_bytes") > memory_budget, "memory_budget_exceeded")
        .otherwise("included")
    )
    return pairs.withColumn("estimated_peak_bytes", peak_bytes(F.col("name"))).withColumn("feasibility", reason)


def cell_plans(spark: SparkSession, profile: str, memory_budget: int = MEMORY_BUDGET, available: Callable[[str | None], bool] = is_installed) -> DataFrame:
    """Every workload of the profile with every implementation, and whether and why it is measured."""
    known = implementations(spark)
    names = {row[2] for row in IMPLEMENTATIONS if row[2]}
    installed = F.col("optional_dependency").isNull() | F.col("optional_dependency").isin(*[n for n in names if available(n)], "")
    cells = assess(workloads(spark, profile).crossJoin(F.broadcast(known)), memory_budget).withColumn("dependency_installed", installed)
    feasible = F.col("feasibility") == "included"
    return cells.select(
        F.col("case_name").alias("workload"),
        F.col("name").alias("implementation"),
        (feasible & F.col("dependency_installed")).alias("included"),
        F.when(feasible & ~F.col("dependency_installed"), "dependency_not_installed").otherwise(F.col("feasibility")).alias("reason"),
        "estimated_peak_bytes",
        F.col("optional_dependency").alias("dependency"),
        "dependency_installed",
        metrics().alias("metrics"),
    )


def plan_counts(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_if("included").alias("included_cell_count"), F.count_if(~F.col("included")).alias("excluded_cell_count"))


def metadata(frame: DataFrame) -> DataFrame:
    """Workloads with their labels: distribution, normalisation, dataset id, score convention."""
    cosine = F.col("objective") == "normalized_cosine"
    distribution = F.when(cosine, "uniform_sphere").otherwise("gaussian")
    convention = F.when(F.col("objective") == "squared_l2", "negative_squared_l2_higher_is_better").when(cosine, "cosine_similarity_higher_is_better").otherwise("inner_product_higher_is_better")
    dataset = F.format_string("synthetic-pcg64-v1:%s:%d:%d:%d:%s:%d", distribution, "corpus_size", "dimension", "query_count", "dtype", "seed")
    return frame.withColumns({"distribution": distribution, "normalization": F.when(cosine, "l2_unit_rows").otherwise("none"), "score_convention": convention, "dataset_id": dataset, "boundary_policy": F.lit("strict_top_k_margin"), "threads": F.lit(1)})


def tasks(spark: SparkSession, profiles: tuple[str, ...] = ("small", "core", "stress")) -> DataFrame:
    """(ordinal, profile, case_filter): one task a profile, but one a workload for stress, selected by its name."""
    out = None
    for k, profile in enumerate(profiles):
        if profile == "stress":
            own = workloads(spark, profile).select(F.lit(k).alias("k"), F.lit(profile).alias("profile"), F.regexp_replace("case_name", r"\W+", "_").alias("case_filter"))
        else:
            own = spark.range(1).select(F.lit(k).alias("k"), F.lit(profile).alias("profile"), F.lit(None).cast("string").alias("case_filter"))
        out = own if out is None else out.unionByName(own)
    return out.select(F.row_number().over(W.orderBy("k", "case_filter")).alias("ordinal"), "profile", "case_filter")


def plan_manifest(spark: SparkSession, profile: str, memory_budget: int = MEMORY_BUDGET, available: Callable[[str | None], bool] = is_installed) -> dict[str, object]:
    """A profile's workloads and cells as JSON-safe values; plans are of study size."""
    cells = cell_plans(spark, profile, memory_budget, available).persist()
    own = metadata(workloads(spark, profile)).orderBy("case_name").collect()
    counts = plan_counts(cells).first().asDict()
    listed = [r.asDict() for r in cells.orderBy("workload", "implementation").collect()]
    return {"schema_version": 1, "profile": profile, "memory_budget_bytes": memory_budget, "workload_count": len(own), **counts, "workloads": [r.asDict() for r in own], "cells": listed}
