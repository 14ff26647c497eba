"""The contracts of vectors, parameters and results."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import InvalidParameter, InvalidVectors
from nearfield.functions.vectors import norm, unit

# How far a unit row's norm may be from one (relative and absolute tolerance together).
NORM_TOLERANCE = {"float32": 5e-5 + 5e-6, "float64": 1e-12 + 1e-12}
_DTYPES = {"float": "float32", "double": "float64"}


@dataclass(frozen=True)
class Shape:
    """What one validation job learns about a frame of vectors."""

    size: int
    dimension: int
    dtype: str


def positive_int(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise InvalidParameter(f"{name} must be an integer")
    if value <= 0:
        raise InvalidParameter(f"{name} must be positive")
    return value


def neighbour_count(k: object, size: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int):
        raise InvalidParameter("k must be an integer")
    if not 1 <= k <= size:
        raise InvalidParameter(f"k is out of range: 1 <= k <= {size} here")
    return k


def element_type(frame: DataFrame, column: str, name: str) -> str:
    kind = frame.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        raise InvalidVectors(f"{name} must have shape (rows, dimension): an array column")
    if kind.elementType.typeName() not in _DTYPES:
        raise InvalidVectors(f"{name} must have dtype float32 or float64")
    return _DTYPES[kind.elementType.typeName()]


def resolve_dtype(value: str) -> T.DataType:
    if value not in ("float32", "float64"):
        raise InvalidParameter("dtype must be float32 or float64")
    return T.FloatType() if value == "float32" else T.DoubleType()


def vector_stats(v: Column, dtype: str) -> list[Column]:
    """Aggregates that decide the contract: rows, sizes, rows that aren't finite, rows that aren't of unit norm."""
    not_finite = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return [
        F.count("*").alias("row_count"),
        F.coalesce(F.min(F.coalesce(F.size(v), F.lit(-1))), F.lit(0)).cast("long").alias("least_size"),
        F.coalesce(F.max(F.coalesce(F.size(v), F.lit(-1))), F.lit(0)).cast("long").alias("most_size"),
        F.count_if(not_finite).alias("not_finite"),
        F.count_if(F.abs(norm(v) - 1) > NORM_TOLERANCE[dtype]).alias("not_unit"),
    ]


def validate_vectors(frame: object, column: str = "vector", *, name: str = "vectors", unit_rows: bool = True, key: str | None = None) -> Shape:
    """Checks in one job, and names the first broken rule: frame, shape, empty axis, dtype, rectangle, finite, norm."""
    if not isinstance(frame, DataFrame):
        raise InvalidVectors(f"{name} must be a DataFrame, not a NumPy array or a list")
    if column not in frame.columns:
        raise InvalidVectors(f"{name} must have shape (rows, dimension): no column {column}")
    dtype = element_type(frame, column, name)
    keys = F.count_if(F.col(key).isNull()) if key else F.lit(0)
    row = frame.agg(*vector_stats(F.col(column), dtype), keys.alias("no_key")).first()
    if row.row_count == 0 or row.most_size == 0:
        raise InvalidVectors(f"{name} must not have an empty axis")
    if row.least_size != row.most_size:
        raise InvalidVectors(f"{name} must have shape (rows, dimension): sizes differ or are null")
    if row.no_key:
        raise InvalidVectors(f"{name} must have an id in every row")
    if row.not_finite:
        raise InvalidVectors(f"{name} must be finite")
    if unit_rows and row.not_unit:
        raise InvalidVectors(f"{name} must have rows of L2 norm one")
    return Shape(row.row_count, row.most_size, dtype)


def normalize_rows(frame: DataFrame, column: str = "vector") -> DataFrame:
    """frame with unit rows of the same element type; a zero row raises an error when it is read."""
    kind = frame.schema[column].dataType.simpleString()
    scaled = F.when(F.exists(F.col(column), lambda x: x != 0), unit(F.col(column))).otherwise(F.raise_error(F.lit("cannot normalize a zero row")))
    return frame.withColumn(column, scaled.cast(kind))


def result_violations(neighbors: DataFrame) -> DataFrame:
    """(query_id, rank, problem) of rows of (query_id, rank, id, score) that break the order or value rules."""
    by_rank = W.partitionBy("query_id").orderBy("rank")
    before = neighbors.withColumn("score_before", F.lag("score").over(by_rank)).withColumn("id_before", F.lag("id").over(by_rank))
    problem = (
        F.when(F.col("id").isNull() | (F.col("id") < 0), "ids must be non-negative")
        .when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == math.inf), "scores must be finite")
        .when(F.col("score") > F.col("score_before"), "scores must run from the greatest down")
        .when((F.col("score") == F.col("score_before")) & (F.col("id") <= F.col("id_before")), "index ties must run upwards")
    )
    return before.withColumn("problem", problem).where("problem is not null").select("query_id", "rank", "problem")


def check_result(neighbors: DataFrame) -> None:
    """Raises for the first violation, or if queries have different numbers of neighbours."""
    counts = neighbors.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("top")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("top").alias("top")).first()
    if counts.lo is None or counts.lo != counts.hi or counts.top != counts.hi:
        raise InvalidVectors("a result must have the same ranks, one or more, for every query")
    bad = result_violations(neighbors).orderBy("query_id", "rank").first()
    if bad:
        raise InvalidVectors(f"query {bad.query_id}, rank {bad.rank}: {bad.problem}")
