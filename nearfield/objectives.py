"""The three search objectives. Scores are doubles, and higher is better."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.errors import InvalidVectors
from nearfield.functions.vectors import dot, squared_distance


class Objective(StrEnum):
    SQUARED_L2 = "squared_l2"
    INNER_PRODUCT = "inner_product"
    NORMALIZED_COSINE = "normalized_cosine"

    @property
    def requires_unit_rows(self) -> bool:
        return self is Objective.NORMALIZED_COSINE

    @property
    def score_convention(self) -> str:
        return {
            Objective.SQUARED_L2: "negative_squared_l2_higher_is_better",
            Objective.INNER_PRODUCT: "inner_product_higher_is_better",
            Objective.NORMALIZED_COSINE: "cosine_similarity_higher_is_better",
        }[self]


def resolve_objective(value: Objective | str) -> Objective:
    try:
        return Objective(value)
    except ValueError:
        raise InvalidVectors("objective must be one of: " + ", ".join(Objective)) from None


def score(objective: Objective | str, left: Column, right: Column) -> Column:
    """The score of two vectors, summed from the first coordinate to the last; never a negative zero."""
    if resolve_objective(objective) is Objective.SQUARED_L2:
        return -squared_distance(left, right) + F.lit(0.0)
    return dot(left, right) + F.lit(0.0)


def score_of_distance(objective: Objective | str, distance: Column) -> Column:
    """The score that a Euclidean distance stands for: -(d * d), or 1 - d * d / 2 between unit rows."""
    resolved = resolve_objective(objective)
    if resolved is Objective.INNER_PRODUCT:
        raise InvalidVectors("inner_product isn't told by a distance")
    return -(distance * distance) + F.lit(0.0) if resolved is Objective.SQUARED_L2 else 1 - distance * distance / 2


def score_of_cosine_distance(distance: Column) -> Column:
    return 1 - distance
