import pytest

from nearfield.errors import InvalidParameter, InvalidVectors
from nearfield.operators import trusted as T
from nearfield.operators.search import ExactIndex
from nearfield.sources import synthetic
from tests.helpers import frame, triples


def result(spark, rows):
    return spark.createDataFrame([(0, k + 1, i, float(s)) for k, (i, s) in enumerate(rows)], "query_id long, rank int, id long, score double")


def test_trusted_search(spark):
    index = ExactIndex(frame(spark, [[1, 0], [1, 0], [0, -1]], kind="double"))
    got = T.trusted_search(index, frame(spark, [[1, 0]], "query_id", "double"), 3)
    assert triples(got) == [(0, 1, 0), (0, 2, 1), (0, 3, 2)] and sorted(r.score for r in got.collect()) == [0, 1, 1]


def test_blocked_and_scalar_references_agree(spark):
    data = synthetic.uniform_sphere(spark, 37, 9, 5, seed=101)
    index = ExactIndex(data.corpus)
    scalar, blocked = T.build_reference(index, data.queries, 7), T.build_reference(index, data.queries, 7, scalar_limit=10)
    assert (scalar.method, blocked.method) == ("scalar_fsum", "blocked_float64") and scalar.boundary_margin > 0
    assert triples(scalar.result) == triples(blocked.result)
    T.check_against(index.search(data.queries, 7), scalar.result)


def test_digest(spark):
    data = synthetic.gaussian(spark, 19, 4, 2, objective="inner_product", seed=8)
    index = ExactIndex(data.corpus, "inner_product")
    a, b, c = (T.result_digest(index.search(data.queries, k)) for k in (3, 3, 4))
    assert a == b != c and a.startswith("sha256:") and len(a) == 71


def test_boundaries(spark):
    index = ExactIndex(frame(spark, [[1, 0], [1, 0], [0, 1]]))
    query = frame(spark, [[1, 0]], "query_id")
    with pytest.raises(InvalidVectors, match="tied"):
        T.build_reference(index, query, 1)
    with pytest.raises(InvalidParameter, match="below"):
        T.build_reference(index, query, 3)


@pytest.mark.parametrize(
    ("actual", "expected", "problem"),
    [
        ([(0, 1), (2, 0.50000006), (1, 0.5)], [(0, 1), (1, 0.50000001), (2, 0.5)], None),
        ([(0, 1), (2, 0.50005), (1, 0.50004)], [(0, 1), (1, 0.5001), (2, 0.5)], "ordering inversion"),
        ([(0, 1), (2, 0.5)], [(0, 1), (1, 0.5)], "identity mismatch"),
        ([(0, 1), (1, 0.6)], [(0, 1), (1, 0.5)], "score differs"),
        ([(0, 1)], [(0, 1), (1, 0.5)], "shape differs|shape"),
    ],
)
def test_validator(spark, actual, expected, problem):
    a, e = result(spark, actual), result(spark, expected)
    if problem is None:
        T.check_against(a, e)
    else:
        with pytest.raises(InvalidVectors, match=problem):
            T.check_against(a, e)


def test_trusted_sums_only_what_may_be_among_the_first(spark):
    data = synthetic.uniform_sphere(spark, 3000, 9, 4, seed=5)
    index = ExactIndex(data.corpus.repartition(2))
    plan = T.trusted_search(index, data.queries, 3)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    import math

    rows, asked = ([(r[0], [float(x) for x in r.vector]) for r in f.collect()] for f in (index._corpus, data.queries))
    want = []
    for q, v in asked:
        best = sorted((-math.fsum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in rows)[:3]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, T.trusted_search(index, data.queries, 3).collect())) == sorted(want)
