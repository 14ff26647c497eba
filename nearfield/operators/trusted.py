"""Trusted results to hold others against: correctly rounded search, margins, tolerances and digests."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.errors import InvalidParameter, InvalidVectors
from nearfield.functions.vectors import as_doubles, norm
from nearfield.objectives import Objective
from nearfield.operators.search import ExactIndex, RunningTop, in_blocks, running_search
from nearfield.operators.validate import positive_int

# Fixed values
SCALAR_LIMIT = 1_000_000
TOLERANCE = {"float32": (2e-4, 2e-5), "float64": (2e-10, 2e-10)}  # relative, absolute
DIGEST_DOMAIN = b"exact-top-k-result-v1"


class _Trusted(RunningTop):
    """Candidates of matrix products, by the same bounds, scored with correctly rounded sums."""

    def exact(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        terms = (rows - queries) ** 2 if self.objective is Objective.SQUARED_L2 else rows * queries
        sums = np.fromiter(map(math.fsum, terms.tolist()), np.float64, len(terms))
        return (-sums if self.objective is Objective.SQUARED_L2 else sums) + 0.0


def trusted_search(index: ExactIndex, queries: DataFrame, k: int) -> DataFrame:
    """Like index.search, with every sum that rounding could let into the top k correctly rounded (math.fsum)."""
    prepared = index.prepare_queries(queries)
    index.search_prepared(prepared, k)  # the same checks
    parts = in_blocks(prepared.frame, 8 * prepared.shape.size * prepared.shape.dimension)
    return reduce(DataFrame.unionByName, [running_search(index, part, k, _Trusted, 256) for part in parts])


def renormalized(v: Column) -> Column:
    """v in doubles over its norm in doubles."""
    return F.transform(F.array(F.struct(as_doubles(v).alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def blocked_search(index: ExactIndex, queries: DataFrame, k: int) -> DataFrame:
    """Matrix products in doubles over blocks of 64 queries and 8,192 corpus rows; unit rows are made exactly so first."""
    frames = [index._corpus, queries]
    if index.objective.requires_unit_rows:
        frames = [f.withColumn("vector", renormalized(F.col("vector"))) for f in frames]
    else:
        frames = [f.withColumn("vector", as_doubles(F.col("vector"))) for f in frames]
    return ExactIndex(frames[0], index.objective, block_size=8192, query_block=64).search(frames[1], k, "blocked")


@dataclass(frozen=True)
class Reference:
    """A trusted result, how it was made, its digest, and the least gap between the ranks k and k + 1."""

    result: DataFrame
    method: str
    digest: str
    boundary_margin: float
    kept: DataFrame | None = None

    def release(self) -> None:
        """Gives back what the result is kept in."""
        if self.kept is not None:
            self.kept.unpersist()


def boundary_margins(top: DataFrame, k: int) -> DataFrame:
    """(query_id, margin): score of rank k less score of rank k + 1, of neighbours up to rank k + 1 and beyond."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return top.groupBy("query_id").agg((at(k) - at(k + 1)).alias("margin"))


def build_reference(index: ExactIndex, queries: DataFrame, k: int, scalar_limit: int = SCALAR_LIMIT) -> Reference:
    """Trusted neighbours whose last rank is strictly apart from the next one; k must be below the corpus size."""
    positive_int(k, "k"), positive_int(scalar_limit, "scalar_limit")
    if k >= index.size:
        raise InvalidParameter("k must be below the corpus size to have a boundary")
    scalar = index.size * index.dimension * index.prepare_queries(queries).shape.size <= scalar_limit
    top = (trusted_search if scalar else blocked_search)(index, queries, k + 1).persist()
    margin = boundary_margins(top, k).agg(F.min("margin")).first()[0]
    if margin <= 0:
        top.unpersist()
        raise InvalidVectors("the boundary between rank k and k + 1 is tied")
    result = top.where(F.col("rank") <= k)
    return Reference(result, "scalar_fsum" if scalar else "blocked_float64", result_digest(result), float(margin), top)


def result_digest(neighbors: DataFrame) -> str:
    """SHA-256 over the shape, the ids and the scores to 12 decimals of a small result, in query and rank order."""
    got = neighbors.orderBy("query_id", "rank").select("query_id", "id", "score").toArrow()
    queries = len(set(got.column("query_id").to_pylist()))
    shape = np.array([queries, got.num_rows // max(queries, 1)], "<i8")
    parts = [DIGEST_DOMAIN, b"\0", shape.tobytes(), got.column("id").to_numpy().astype("<i8").tobytes(), np.round(got.column("score").to_numpy(), 12).astype("<f8").tobytes()]
    return "sha256:" + hashlib.sha256(b"".join(parts)).hexdigest()


def compare(actual: DataFrame, expected: DataFrame, dtype: str = "float32") -> DataFrame:
    """(query_id, id, problem) of every row in which actual is not an acceptable form of expected.

    The ids of each query must be the same, scores equal within the dtype's tolerance, and where actual orders two
    neighbouring ids against their expected scores, these must be within rounding of each other.
    """
    relative, absolute = TOLERANCE[dtype]
    eps = float(np.finfo(dtype).eps)
    a = actual.select("query_id", "id", F.col("rank").alias("a_rank"), F.col("score").alias("a_score"))
    e = expected.select("query_id", "id", F.col("rank").alias("e_rank"), F.col("score").alias("e_score"))
    both = a.join(e, ["query_id", "id"], "full_outer")
    following = W.partitionBy("query_id").orderBy("a_rank")
    both = both.withColumn("next", F.lead("e_score").over(following))
    room = 8 * eps * (1 + F.greatest(F.abs("e_score"), F.abs("next"), F.lit(1.0)))
    problem = (
        F.when(F.col("a_rank").isNull() | F.col("e_rank").isNull(), "identity mismatch")
        .when(F.abs(F.col("a_score") - F.col("e_score")) > absolute + relative * F.abs("e_score"), "score differs")
        .when(F.col("a_rank").isNotNull() & (F.col("next") - F.col("e_score") > room), "ordering inversion")
    )
    return both.withColumn("problem", problem).where("problem is not null").select("query_id", "id", "problem")


def check_against(actual: DataFrame, expected: DataFrame, dtype: str = "float32") -> None:
    shape = lambda f: f.agg(F.count_distinct("query_id"), F.count("*")).first()
    if shape(actual) != shape(expected):
        raise InvalidVectors("the result's shape differs from the trusted one")
    bad = compare(actual, expected, dtype).orderBy("query_id", "id").first()
    if bad:
        raise InvalidVectors(f"query {bad.query_id}, id {bad.id}: {bad.problem}")


