"""The public names of the engine in one place."""

from nearfield.errors import InvalidParameter, InvalidVectors, NearfieldError, StrategyUnavailable, UnsupportedObjective
from nearfield.objectives import Objective, resolve_objective, score, score_of_cosine_distance, score_of_distance
from nearfield.operators.search import STRATEGIES, ExactIndex, PreparedQueries, lengthen, merge, prepare_queries, rank, score_matrix, widen
from nearfield.operators.trusted import Reference, blocked_search, boundary_margins, build_reference, check_against, compare, result_digest, trusted_search
from nearfield.operators.validate import check_result, normalize_rows, result_violations, validate_vectors
from nearfield.sources.synthetic import Dataset, clustered, distributed_normal, for_workload, gaussian, uniform_sphere

__all__ = [
    "STRATEGIES", "Dataset", "ExactIndex", "InvalidParameter", "InvalidVectors", "NearfieldError", "Objective", "PreparedQueries", "Reference", "StrategyUnavailable", "UnsupportedObjective",
    "blocked_search", "boundary_margins", "build_reference", "check_against", "check_result", "clustered", "compare", "distributed_normal", "for_workload", "gaussian", "lengthen", "merge",
    "normalize_rows", "prepare_queries", "rank", "resolve_objective", "result_digest", "result_violations", "score", "score_matrix", "score_of_cosine_distance", "score_of_distance",
    "trusted_search", "uniform_sphere", "validate_vectors", "widen",
]
