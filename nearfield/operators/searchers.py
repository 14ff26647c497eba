"""The catalogued implementations as searchers: each holds its own gates, and one of the engine's strategies does its work."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nearfield.errors import InvalidVectors, StrategyUnavailable, UnsupportedObjective
from nearfield.objectives import Objective, resolve_objective
from nearfield.operators.search import ExactIndex, PreparedQueries
from nearfield.plans.catalog import IMPLEMENTATIONS, STRATEGY_OF

_KNOWN = {name: (objectives, float32_only) for name, objectives, _, float32_only in IMPLEMENTATIONS}
#: Implementations that take only queries which they have prepared themselves
OWN_QUERIES = frozenset(["torch_matmul_topk"])


class Searcher(ExactIndex):
    """An index that searches by one implementation. Objective and element type are checked before the rows are read."""

    def __init__(self, implementation: str, corpus: DataFrame, objective: Objective | str = Objective.NORMALIZED_COSINE, **options):
        if implementation not in _KNOWN:
            raise StrategyUnavailable(f"{implementation} is no implementation; there are: " + ", ".join(_KNOWN))
        objectives, float32_only = _KNOWN[implementation]
        if resolve_objective(objective) not in objectives:
            raise UnsupportedObjective(f"{implementation} does not support {objective}; it supports only " + ", ".join(objectives))
        vector = options.get("vector", "vector")
        if float32_only and isinstance(corpus, DataFrame) and dict(corpus.dtypes).get(vector) == "array<double>":
            raise InvalidVectors(f"{implementation} takes float32 rows alone")
        super().__init__(corpus, objective, **options)
        self.implementation, self.strategy = implementation, STRATEGY_OF[implementation]

    def search(self, queries: DataFrame, k: int, strategy: str | None = None) -> DataFrame:
        return super().search(queries, k, strategy or self.strategy)

    def search_prepared(self, queries: PreparedQueries, k: int, strategy: str | None = None) -> DataFrame:
        if self.implementation in OWN_QUERIES and isinstance(queries, PreparedQueries) and queries.owner is not self:
            raise InvalidVectors(f"queries must be prepared by this {self.implementation} searcher")
        return super().search_prepared(queries, k, strategy or self.strategy)
