import json

import nearfield.api as api
from nearfield.__main__ import main
from nearfield.plans import catalog, experiments
from nearfield.sources.synthetic import for_workload
from tests.test_study import collections, records


def test_names():
    assert len(api.__all__) == len(set(api.__all__)) >= 29 and all(hasattr(api, n) for n in api.__all__)


def test_manifests(spark, capsys):
    plan = catalog.plan_manifest(spark, "smoke", available=lambda _: True)
    assert (plan["workload_count"], plan["included_cell_count"], plan["excluded_cell_count"]) == (3, 29, 7) and json.dumps(plan, allow_nan=False)
    main(["predeclare"])
    assert [len(e["workloads"]) for e in json.loads(capsys.readouterr().out)["experiments"]] == [3, 2, 3]
    main(["plan", "smoke"])
    assert json.loads(capsys.readouterr().out)["profile"] == "smoke"


def test_data_of_workloads(spark):
    for row in catalog.smoke(spark).collect():
        data = for_workload(spark, row.asDict())
        assert data.objective == row.objective and data.corpus.count() == 1000 and data.queries.count() == 1


def test_analyze(spark, tmp_path):
    records(spark).write.parquet(f"{tmp_path}/records")
    collections(spark, 2).write.parquet(f"{tmp_path}/collections")
    main(["analyze", f"{tmp_path}/records", f"{tmp_path}/collections", f"{tmp_path}/out"])
    assert "exploratory only" in (tmp_path / "out/report.md").read_text()


def test_confirmatory_report(spark):
    frame = spark.createDataFrame([("a__b__n1", 10.0, 6.0, 12.0, 5.0)], "case_name string, improvement_percent double, improvement_low_percent double, improvement_high_percent double, threshold_percent double")
    assert "1 improvement" in experiments.report(frame, "x")
