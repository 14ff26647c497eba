import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from nearfield.errors import InvalidParameter, InvalidVectors, UnsupportedObjective
from nearfield.operators import search as S
from nearfield.operators.validate import normalize_rows
from tests.helpers import frame, plain_topk, triples

TIE = [[1, 0, 0], [1, 0, 0], [0, 1, 0], [-1, 0, 0], [0, 0, 1]]
TIE_QUERIES = [[1, 0, 0], [0, 1, 0]]


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("strategy", sorted(S.STRATEGIES))
def test_ties_go_to_the_smaller_id(spark, strategy, kind):
    index = S.ExactIndex(frame(spark, TIE, kind=kind).repartition(3), block_size=2, pivots=2)
    queries = frame(spark, TIE_QUERIES, "query_id", kind)
    assert triples(index.search(queries, 3, strategy)) == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 2), (1, 2, 0), (1, 3, 1)]
    whole = index.search(queries.where("query_id = 0"), 5, strategy).orderBy("rank").collect()
    assert [r.id for r in whole] == [0, 1, 2, 4, 3] and [r.score for r in whole] == [1, 1, 0, 0, -1]


@pytest.mark.parametrize("strategy", sorted(S.STRATEGIES))
@pytest.mark.parametrize("objective", ["squared_l2", "inner_product", "normalized_cosine"])
def test_objectives(spark, strategy, objective):
    corpus, queries = frame(spark, [[1, 0], [1, 0], [0, 1], [-1, 0]]), frame(spark, [[2, 0], [0, 0.5]], "query_id")
    if objective == "normalized_cosine":
        queries = normalize_rows(queries)
    index = S.ExactIndex(corpus, objective, pivots=3)
    if strategy == "pivot" and objective == "inner_product":
        with pytest.raises(UnsupportedObjective, match="does not support"):
            index.search(queries, 3, strategy)
        return
    rows = index.search(queries, 3, strategy).orderBy("query_id", "rank").collect()
    assert [r.id for r in rows] == [0, 1, 2, 2, 0, 1]
    if objective == "squared_l2":
        assert [r.score for r in rows] == [-1, -1, -5, -0.25, -1.25, -1.25]


def test_boundary_tie(spark):
    index = S.ExactIndex(frame(spark, [[1, 0], [1, 0], [-1, 0]]))
    query = frame(spark, [[1, 0]], "query_id")
    for strategy in S.STRATEGIES:
        assert triples(index.search(query, 2, strategy)) == [(0, 1, 0), (0, 2, 1)]
        assert triples(index.search(query, 1, strategy)) == [(0, 1, 0)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(2, 14), st.integers(2, 10), st.integers(1, 4), st.integers(1, 14), st.integers(0, 2**32 - 1), st.sampled_from(["squared_l2", "inner_product"]))
def test_random_data_against_plain_version(spark, n, d, q, k, seed, objective):
    rng = np.random.default_rng(seed)
    corpus, queries = rng.integers(-3, 4, (n, d)).tolist(), rng.integers(-3, 4, (q, d)).tolist()
    k = min(k, n)
    want = plain_topk(corpus, queries, k, objective)
    index = S.ExactIndex(frame(spark, corpus, kind="double"), objective, block_size=3, pivots=4)
    for strategy, (_, objectives) in S.STRATEGIES.items():
        if objective in objectives:
            got = sorted(map(tuple, index.search(frame(spark, queries, "query_id", "double"), k, strategy).collect()))
            assert got == want, strategy


def test_all_strategies_agree_on_embeddings(spark, sf_dir):
    from nearfield.registry import vectors

    corpus = vectors(spark, sf_dir)
    index = S.ExactIndex(corpus)
    queries = corpus.where("id < 7").withColumnRenamed("id", "query_id")
    results = {s: sorted(map(tuple, index.search(queries, 25, s).collect())) for s in S.STRATEGIES}
    assert all(r == results["window"] for r in results.values())


def test_queries_in_blocks(spark, monkeypatch):
    index = S.ExactIndex(frame(spark, TIE))
    queries = frame(spark, TIE, "query_id")
    want = triples(index.search(queries, 2))
    monkeypatch.setattr(S, "QUERY_BYTES", 48)
    assert triples(index.search(queries, 2)) == want


def test_wide_and_long(spark):
    result = S.ExactIndex(frame(spark, TIE)).search(frame(spark, TIE_QUERIES, "query_id"), 3)
    wide = S.widen(result)
    assert {r.query_id: r.indices for r in wide.collect()} == {0: [0, 1, 2], 1: [2, 0, 1]}
    assert triples(S.lengthen(wide)) == triples(result)


def test_merge_of_blocks(spark):
    corpus, queries = frame(spark, TIE), frame(spark, TIE_QUERIES, "query_id")
    parts = [S.rank(S.score_matrix(corpus.where(f"id % 2 = {k}"), queries, "inner_product"), 3) for k in (0, 1)]
    assert triples(S.merge(parts, 3)) == triples(S.ExactIndex(corpus).search(queries, 3))


def test_checks_before_search(spark):
    index = S.ExactIndex(frame(spark, TIE))
    assert (index.size, index.dimension, index.dtype, index.objective, index.block_size) == (5, 3, "float32", "normalized_cosine", 16_384)
    with pytest.raises(InvalidVectors, match="query dimension"):
        index.search(frame(spark, [[1, 0]], "query_id"), 1)
    with pytest.raises(InvalidVectors, match="query dtype"):
        index.search(frame(spark, [[1, 0, 0]], "query_id", "double"), 1)
    with pytest.raises(InvalidVectors, match="query objective"):
        index.search_prepared(S.prepare_queries(frame(spark, TIE, "query_id"), objective="squared_l2"), 1)
    with pytest.raises(InvalidVectors, match="PreparedQueries"):
        index.search_prepared(frame(spark, TIE, "query_id"), 1)
    with pytest.raises(InvalidVectors, match="objective must be one of"):
        S.ExactIndex(frame(spark, TIE), "manhattan")
    for k in (True, 1.0, "1", None):
        with pytest.raises(InvalidParameter, match="integer"):
            index.search(frame(spark, TIE, "query_id"), k)
    for k in (0, -1, 6):
        with pytest.raises(InvalidParameter, match="1 <= k <= 5"):
            index.search(frame(spark, TIE, "query_id"), k)
    with pytest.raises(InvalidParameter, match="strategy"):
        index.search(frame(spark, TIE, "query_id"), 1, "guess")


def test_scores_of_pairs_are_those_of_the_expressions(spark):
    from pyspark.sql import functions as F

    from nearfield.objectives import score

    rows = [("a", [0.1, 0.2, -0.3]), ("b", None), ("c", [1.5, None, 0.0]), ("d", [7.0]), ("e", []), (None, [1e-3, 1e9, -0.7])]
    corpus = spark.createDataFrame(rows, "id string, vector array<double>").repartition(2)
    queries = spark.createDataFrame([(k, v) for k, (_, v) in enumerate(rows)], "query_id int, vector array<float>")
    for objective in ("squared_l2", "inner_product"):
        got = S.score_matrix(corpus, queries, objective)
        want = corpus.crossJoin(queries.withColumnRenamed("vector", "q")).select("query_id", "id", score(objective, F.col("vector"), F.col("q")).alias("score"))
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # not the interpreted sums of each pair


@pytest.mark.parametrize("bound", ["TASK_PAIRS", "KEPT_ROWS", "SORTED_ROWS", "SORTED_BYTES"])
def test_small_bounds_give_the_same_rows(spark, monkeypatch, bound):
    rng = np.random.default_rng(3)
    corpus, queries = rng.integers(-2, 3, (70, 3)).tolist(), rng.integers(-2, 3, (9, 3)).tolist()
    want = plain_topk(corpus, queries, 70, "squared_l2")
    monkeypatch.setattr(S, bound, 8)
    monkeypatch.setattr(S, "TILE", (4, 16))
    index = S.ExactIndex(frame(spark, corpus, kind="double"), "squared_l2")
    for strategy in S.STRATEGIES:
        for k in (1, 7, 70):
            got = sorted(map(tuple, index.search(frame(spark, queries, "query_id", "double"), k, strategy).collect()))
            assert got == [r for r in want if r[1] <= k], (strategy, k)


def test_long_lists_are_not_held_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "KEPT_ROWS", 8)
    made = []
    monkeypatch.setattr(S, "_full_sort", lambda *a, run=S._full_sort: made.append(1) or run(*a))
    index = S.ExactIndex(frame(spark, TIE))
    assert len(triples(index.search(frame(spark, TIE, "query_id"), 5))) == 25 and made == [1]


def test_offers_sort_lists_of_their_own_queries_alone(monkeypatch):
    rng = np.random.default_rng(5)
    rows, queries = rng.integers(-3, 4, (60, 3)).astype(float), rng.integers(-3, 4, (20, 3)).astype(float)
    want = plain_topk(rows.tolist(), queries.tolist(), 7, "squared_l2")
    sizes = []
    monkeypatch.setattr(S.np, "lexsort", lambda keys, run=np.lexsort: sizes.append(len(keys[0])) or run(keys))
    top = S.RunningTop(queries, 7, S.Objective.SQUARED_L2)
    for at in range(0, 60, 30):
        for which in np.array_split(rng.permutation(20), 4):
            top.offer(np.arange(at, at + 30), rows[at : at + 30], (rows[at : at + 30] ** 2).sum(axis=1), which)
    got = sorted(zip(top.query.tolist(), (-top.score).tolist(), top.id.tolist(), strict=True))
    assert [(q, i, -d) for q, d, i in got] == [(q, i, s) for q, _, i, s in want]
    assert max(sizes) <= 5 * (7 + 30)


def test_downwards_is_a_stable_order():
    rng = np.random.default_rng(6)
    for scores in (rng.integers(0, 4, 1000).astype(float), rng.standard_normal(1000), np.zeros(5), np.zeros(0), np.array([0.0, -0.0, 1.0, -0.0])):
        assert S.downwards(scores).tolist() == np.argsort(-scores, kind="stable").tolist()
