import math

import numpy as np
import pytest

from nearfield.errors import InvalidParameter, InvalidVectors, NearfieldError
from nearfield.functions.vectors import norm
from nearfield.operators import validate as V
from tests.helpers import frame


@pytest.mark.parametrize(
    ("rows", "kind", "text"),
    [([[1, math.nan]], "float", "finite"), ([[1, math.inf]], "float", "finite"), ([[0.5, 0]], "float", "L2 norm one"), ([], "float", "empty axis"), ([[]], "float", "empty axis"), ([[1, 0], [1]], "float", "shape"), ([[1, 0]], "double", None)],
)
def test_contract(spark, rows, kind, text):
    own = frame(spark, rows, kind=kind)
    if text is None:
        assert V.validate_vectors(own) == V.Shape(1, 2, "float64")
        return
    with pytest.raises(InvalidVectors, match=text):
        V.validate_vectors(own)


def test_types(spark):
    with pytest.raises(InvalidVectors, match="NumPy array"):
        V.validate_vectors([[1.0, 0.0]])
    with pytest.raises(InvalidVectors, match="shape"):
        V.validate_vectors(spark.createDataFrame([(1, 2.0)], "id long, vector double"))
    with pytest.raises(InvalidVectors, match="dtype"):
        V.validate_vectors(spark.createDataFrame([(1, [2])], "id long, vector array<int>"))
    with pytest.raises(InvalidVectors, match="finite"):
        V.validate_vectors(spark.createDataFrame([(1, [None, 1.0])], "id long, vector array<double>"))
    with pytest.raises(InvalidVectors, match="id"):
        V.validate_vectors(spark.createDataFrame([(None, [0.0, 1.0])], "id long, vector array<double>"), key="id")
    assert issubclass(InvalidVectors, NearfieldError) and issubclass(NearfieldError, ValueError)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_rows_are_normalized_without_overflow(spark, kind):
    top = float(np.finfo(np.float32 if kind == "float" else np.float64).max) / 4
    got = V.normalize_rows(frame(spark, [[top, top], [3, 4]], kind=kind))
    assert got.schema["vector"].dataType.simpleString() == f"array<{kind}>"
    rows = [r.vector for r in got.orderBy("id").collect()]
    assert rows[0] == pytest.approx([math.sqrt(0.5)] * 2) and rows[1] == pytest.approx([0.6, 0.8])
    assert V.validate_vectors(got).size == 2


def test_zero_row(spark):
    with pytest.raises(Exception, match="zero row"):
        V.normalize_rows(frame(spark, [[0, 0]])).collect()


def test_norm_tolerance(spark):
    inside = frame(spark, [[1 + 5e-5, 0]])
    assert V.validate_vectors(inside).dimension == 2 and inside.select(norm(inside.vector)).first()[0] > 1
    with pytest.raises(InvalidVectors):
        V.validate_vectors(frame(spark, [[1 + 6e-5, 0]]))
    with pytest.raises(InvalidVectors):
        V.validate_vectors(frame(spark, [[1 + 1e-11, 0]], kind="double"))


@pytest.mark.parametrize("value", [0, -1, True, 1.5, None])
def test_positive_int(value):
    with pytest.raises(InvalidParameter, match="size"):
        V.positive_int(value, "size")


@pytest.mark.parametrize(
    ("rows", "text"),
    [([(0, 1, -1, 1.0)], "non-negative"), ([(0, 1, 1, math.nan)], "finite"), ([(0, 1, 1, 1.0), (0, 2, 2, 2.0)], "greatest"), ([(0, 1, 3, 1.0), (0, 2, 2, 1.0)], "index ties"), ([(0, 1, 1, 1.0), (0, 2, 2, 0.5), (1, 1, 1, 1.0)], "same ranks"), ([], "same ranks")],
)
def test_result_contract(spark, rows, text):
    with pytest.raises(InvalidVectors, match=text):
        V.check_result(spark.createDataFrame(rows, "query_id long, rank int, id long, score double"))


def test_good_result(spark):
    V.check_result(spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 0, 0.5)], "query_id long, rank int, id long, score double"))
