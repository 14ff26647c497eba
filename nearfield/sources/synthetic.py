"""Synthetic vectors: NumPy's PCG64 on the driver where values must repeat exactly, Spark's own generator for size."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import InvalidParameter, InvalidVectors
from nearfield.functions.vectors import unit
from nearfield.objectives import Objective, resolve_objective
from nearfield.operators.validate import positive_int, resolve_dtype


@dataclass(frozen=True)
class Dataset:
    """Corpus (id, vector) and queries (query_id, vector), and where they come from."""

    corpus: DataFrame
    queries: DataFrame
    distribution: str
    seed: int
    objective: Objective


def _arguments(corpus_size: int, dimension: int, query_count: int, dtype: str, seed: int) -> None:
    for name, value in (("corpus_size", corpus_size), ("dimension", dimension), ("query_count", query_count)):
        positive_int(value, name)
    resolve_dtype(dtype)
    if isinstance(seed, bool) or not isinstance(seed, int) or seed < 0:
        raise InvalidParameter("seed must be a non-negative integer")


def _rows(spark: SparkSession, values: np.ndarray, key: str, dtype: str, unit_rows: bool) -> DataFrame:
    values = values.astype(dtype)
    if unit_rows:
        largest = np.abs(values).max(axis=1, keepdims=True)
        scaled = values / largest
        values = (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(dtype)
    kind = pa.float32() if dtype == "float32" else pa.float64()
    flat = pa.array(np.ascontiguousarray(values).ravel(), kind)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), flat)
    return spark.createDataFrame(pa.table({key: pa.array(np.arange(len(values))), "vector": vectors}))


def uniform_sphere(spark: SparkSession, corpus_size: int, dimension: int, query_count: int, *, dtype: str = "float32", seed: int = 0) -> Dataset:
    """Unit rows in directions drawn evenly; corpus first, then queries, from one stream of numbers."""
    _arguments(corpus_size, dimension, query_count, dtype, seed)
    numbers = np.random.Generator(np.random.PCG64(seed))
    corpus, queries = numbers.standard_normal((corpus_size, dimension)), numbers.standard_normal((query_count, dimension))
    return Dataset(_rows(spark, corpus, "id", dtype, True), _rows(spark, queries, "query_id", dtype, True), "uniform_sphere", seed, Objective.NORMALIZED_COSINE)


def gaussian(spark: SparkSession, corpus_size: int, dimension: int, query_count: int, *, objective: Objective | str, dtype: str = "float32", seed: int = 0) -> Dataset:
    """Standard normal rows as drawn, for objectives without unit rows."""
    _arguments(corpus_size, dimension, query_count, dtype, seed)
    resolved = resolve_objective(objective)
    if resolved.requires_unit_rows:
        raise InvalidVectors("gaussian rows are not of unit norm; normalized_cosine needs uniform_sphere")
    numbers = np.random.Generator(np.random.PCG64(seed))
    corpus, queries = numbers.standard_normal((corpus_size, dimension)), numbers.standard_normal((query_count, dimension))
    return Dataset(_rows(spark, corpus, "id", dtype, False), _rows(spark, queries, "query_id", dtype, False), "gaussian", seed, resolved)


def clustered(spark: SparkSession, corpus_size: int, dimension: int, query_count: int, *, objective: Objective | str = Objective.NORMALIZED_COSINE, clusters: int = 8, noise: float = 0.15, dtype: str = "float32", seed: int = 0) -> Dataset:
    """Rows around unit centroids; drawn in the order centroids, corpus and query clusters, corpus and query noise."""
    _arguments(corpus_size, dimension, query_count, dtype, seed)
    positive_int(clusters, "clusters")
    if isinstance(noise, bool) or not isinstance(noise, (int, float)) or not math.isfinite(noise) or noise <= 0:
        raise InvalidParameter("noise must be finite and positive")
    resolved = resolve_objective(objective)
    numbers = np.random.Generator(np.random.PCG64(seed))
    centroids = numbers.standard_normal((clusters, dimension))
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    owners = [numbers.integers(0, clusters, size) for size in (corpus_size, query_count)]
    corpus, queries = (centroids[own] + noise * numbers.standard_normal((len(own), dimension)) for own in owners)
    unit_rows = resolved.requires_unit_rows
    return Dataset(_rows(spark, corpus, "id", dtype, unit_rows), _rows(spark, queries, "query_id", dtype, unit_rows), "clustered", seed, resolved)


def for_workload(spark: SparkSession, workload: Mapping[str, object]) -> Dataset:
    """The data of a workload row: unit rows for cosine, Gaussian rows otherwise."""
    sizes = [int(workload[c]) for c in ("corpus_size", "dimension", "query_count")]
    more = {"dtype": workload["dtype"], "seed": int(workload["seed"])}
    if resolve_objective(workload["objective"]).requires_unit_rows:
        return uniform_sphere(spark, *sizes, **more)
    return gaussian(spark, *sizes, objective=workload["objective"], **more)


def distributed_normal(spark: SparkSession, size: int, dimension: int, *, key: str = "id", dtype: str = "float32", seed: int = 0, unit_rows: bool = False) -> DataFrame:
    """Normal rows made by the executors, for sizes the driver can't hold; other values than the generators above."""
    _arguments(size, dimension, 1, dtype, seed)
    vector = F.array(*[F.randn(seed * 1_000_003 + j) for j in range(dimension)])
    vector = unit(vector) if unit_rows else vector
    return spark.range(size).select(F.col("id").alias(key), vector.cast(f"array<{'float' if dtype == 'float32' else 'double'}>").alias("vector"))
