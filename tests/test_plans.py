import pytest

from nearfield.errors import InvalidParameter
from nearfield.plans import catalog as C
from nearfield.plans import experiments as E


@pytest.mark.parametrize(("profile", "workloads", "included", "objective", "scalar"), [("smoke", 3, 29, 7, 0), ("small", 12, 116, 28, 0), ("core", 24, 184, 56, 48), ("stress", 9, 69, 21, 18)])
def test_counts(spark, profile, workloads, included, objective, scalar):
    cells = C.cell_plans(spark, profile, available=lambda _: True).persist()
    assert C.workloads(spark, profile).count() == workloads and cells.count() == 12 * workloads
    reasons = {r.reason: r["count"] for r in cells.groupBy("reason").count().collect()}
    assert reasons == {k: v for k, v in {"included": included, "objective_not_supported": objective, "scalar_runtime_limit": scalar}.items() if v}
    counts = C.plan_counts(cells).first()
    assert (counts.included_cell_count, counts.excluded_cell_count) == (included, 12 * workloads - included)


def test_peak_bytes_at_the_anchor(spark):
    rows = C.cell_plans(spark, "core").where("workload = 'discovery-core__inner_product__n10000__d128__q32__k10__float32'").collect()
    peak = {r.implementation: r.estimated_peak_bytes for r in rows}
    assert peak["python_sort"] == 10_260_224 and peak["numpy_full"] == 14_100_224 and peak["numpy_argpartition"] == 11_620_224
    assert peak["numpy_blocked"] == 11_544_064 and peak["scipy_ckdtree"] == 20_500_224 and peak["faiss_flat_ip"] == 15_380_224
    reason = {r.implementation: r.reason for r in rows}
    assert reason["sklearn_kdtree"] == "objective_not_supported" and reason["python_sort"] == "scalar_runtime_limit" and reason["numpy_blocked"] == "included"
    assert next(r.metrics for r in rows) == ["single_call_latency", "batch_throughput", "tail_latency"]


def test_memory_budget_and_missing_dependencies(spark):
    reasons = lambda **x: {r.implementation: (r.included, r.reason) for r in C.cell_plans(spark, "smoke", **x).where("workload like '%cosine%'").collect()}
    assert reasons(memory_budget=1000)["numpy_full"] == (False, "memory_budget_exceeded")
    assert reasons(available=lambda d: d is None)["torch_matmul_topk"] == (False, "dependency_not_installed")
    for budget in (0, True):
        with pytest.raises(InvalidParameter):
            C.cell_plans(spark, "smoke", memory_budget=budget)
    with pytest.raises(InvalidParameter, match="core, small, smoke, stress"):
        C.workloads(spark, "huge")


def test_core_tasks_and_strategies(spark):
    assert C.core(spark).count() == 33 and C.tasks(spark).count() == 11
    assert set(C.STRATEGY_OF) == {row[0] for row in C.IMPLEMENTATIONS}
    assert C.metadata(C.smoke(spark)).where("dataset_id = 'synthetic-pcg64-v1:gaussian:1000:8:1:float32:20260801'").count() == 2


def test_experiments(spark):
    assert E.registry(spark).count() == 8 and E.broken_rules(E.registry(spark)).count() == 0
    assert E.experiment(spark, "blocked_vs_argpartition").count() == 2
    with pytest.raises(InvalidParameter, match="choose one of"):
        E.experiment(spark, "unknown")
    bad = E.registry(spark).selectExpr("* except (candidate)", "baseline as candidate")
    assert {r.problem for r in E.broken_rules(bad).collect()} == {"baseline and candidate are the same"}
    assert E.predeclared(E.registry(spark), spark.createDataFrame([("other",), ("blocked_vs_argpartition",)], "identifier string")).count() == 1


def test_intervals(spark):
    rows = [("a__b__n1__k2", 10.0, 6.0, 12.0, 5.0), ("a__b__x", -9.0, -12.0, -6.0, 5.0), ("a__b__x", 0.0, -5.0, 5.0, 5.0), ("a__b__x", 5.0, 4.0, 6.0, 5.0)]
    frame = spark.createDataFrame(rows, "case_name string, improvement_percent double, improvement_low_percent double, improvement_high_percent double, threshold_percent double")
    got = E.with_intervals(frame).collect()
    assert [r.regression for r in got] == ["improvement", "regression", "equivalent", "inconclusive"] and got[0].label == "n1 · k2" and (got[0].bar_below, got[0].bar_above) == (4.0, 2.0)
    assert E.classification_counts(E.with_intervals(frame)).count() == 4
    assert E.pair_plan(spark.createDataFrame([(3, 2), (9, 2)], "required_pairs int, supercycle int")) == 9
    with pytest.raises(InvalidParameter):
        E.pair_plan(spark.createDataFrame([(3, 2), (9, 4)], "required_pairs int, supercycle int"))
