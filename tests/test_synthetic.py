import math

import pytest

from nearfield.errors import InvalidParameter, InvalidVectors
from nearfield.operators.validate import validate_vectors
from nearfield.sources import synthetic as S


def test_repeatable_unit_rows(spark):
    a, b, c = (S.uniform_sphere(spark, 12, 6, 4, seed=s) for s in (42, 42, 43))
    rows = lambda d: [r.vector for r in d.corpus.orderBy("id").collect()]
    assert rows(a) == rows(b) != rows(c) and validate_vectors(a.corpus).size == 12 and validate_vectors(a.queries).size == 4
    assert S.clustered(spark, 12, 6, 4, seed=42).distribution == "clustered" and validate_vectors(S.clustered(spark, 12, 6, 4, dtype="float64").corpus).dtype == "float64"


def test_gaussian_rows_are_as_drawn(spark):
    with pytest.raises(InvalidVectors, match="unit norm"):
        S.gaussian(spark, 3, 2, 1, objective="normalized_cosine")
    with pytest.raises(InvalidVectors, match="norm one"):
        validate_vectors(S.gaussian(spark, 30, 2, 1, objective="squared_l2").corpus)


@pytest.mark.parametrize("size", [0, -1, True, 1.5])
def test_sizes(spark, size):
    for k in range(3):
        arguments = [3, 2, 1]
        arguments[k] = size
        with pytest.raises(InvalidParameter, match=["corpus_size", "dimension", "query_count"][k]):
            S.uniform_sphere(spark, *arguments)


def test_other_arguments(spark):
    with pytest.raises(InvalidParameter, match="seed"):
        S.uniform_sphere(spark, 3, 2, 1, seed=-1)
    with pytest.raises(InvalidParameter, match="dtype"):
        S.uniform_sphere(spark, 3, 2, 1, dtype="int64")
    for noise in (0, -1, math.nan, math.inf):
        with pytest.raises(InvalidParameter, match="noise"):
            S.clustered(spark, 3, 2, 1, noise=noise)
    with pytest.raises(InvalidParameter, match="clusters"):
        S.clustered(spark, 3, 2, 1, clusters=0)


def test_distributed(spark):
    assert validate_vectors(S.distributed_normal(spark, 50, 4, unit_rows=True)).size == 50
