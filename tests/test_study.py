import json

import pytest

from nearfield.errors import InvalidParameter
from nearfield.operators import study as S
from nearfield.sources import records as R
from nearfield.sources import sinks

CELLS = [
    ("numpy_full", "k-case", 0.010, 10_000, 128, 32, 1, "discovery-core"), ("numpy_argpartition", "k-case", 0.008, 10_000, 128, 32, 1, "discovery-core"),
    ("numpy_argpartition", "n-case", 0.020, 100_000, 128, 32, 10, "discovery-core"), ("numpy_blocked", "n-case", 0.018, 100_000, 128, 32, 10, "discovery-core"),
    ("python_heap", "d-case", 0.006, 1_000, 8, 1, 10, "discovery-small"), ("numpy_argpartition", "d-case", 0.004, 1_000, 8, 1, 10, "discovery-small"),
]


def records(spark, scales=(1.0, 1.1), cells=CELLS, metric="single_call_latency"):
    rows = [
        (f"run-{n}", n + 1, "s", i, c, metric, v * f, "seconds", "squared_l2", p, size, d, q, k, "float32", 5, 1, 100, None, None, None, None)
        for n, f in enumerate(scales) for i, c, v, size, d, q, k, p in cells
    ]
    return spark.createDataFrame(rows, R.RECORD)


def collections(spark, n, dirty=()):
    rows = [(f"run-{k}", k, True, "rev", "digest", k in dirty) for k in range(n)]
    return spark.createDataFrame(rows, "collection string, position int, is_complete boolean, git_revision string, source_tree_digest string, git_dirty boolean")


def test_summaries_winners_and_contrasts(spark):
    summary = S.summarize(records(spark))
    assert all(r.run_count == 2 and r.run_cv > 0 for r in summary.collect())
    won = {r.case_name: r for r in S.winners(summary).collect()}
    assert {c: r.implementation for c, r in won.items()} == {"k-case": "numpy_argpartition", "n-case": "numpy_blocked", "d-case": "numpy_argpartition"}
    assert won["k-case"].advantage_percent == pytest.approx(20) and won["k-case"].runner_up == "numpy_full"
    pairs = {r.question: r.candidate_improvement_percent for r in S.contrasts(summary).collect()}
    assert pairs == pytest.approx({"argpartition_vs_full_sort": 20, "blocked_vs_argpartition": 10, "python_heap_vs_argpartition": 100 / 3})
    assert {r.implementation: r.wins for r in S.winner_counts(S.winners(summary)).collect()} == {"numpy_argpartition": 2, "numpy_blocked": 1}


def test_single_runs_ties_and_directions(spark):
    summary = S.summarize(records(spark, (1.0,), [("b", "c", 2.0, 1, 1, 1, 1, "p"), ("a", "c", 2.0, 1, 1, 1, 1, "p"), ("z", "c", 1.0, 1, 1, 1, 1, "p")], "batch_throughput"))
    assert all(r.run_cv is None for r in summary.collect())
    best = S.winners(summary).first()
    assert (best.implementation, best.runner_up, best.advantage_percent) == ("a", "b", 0)
    alone = S.winners(S.summarize(records(spark, (1.0,), CELLS[:1]))).first()
    assert alone.runner_up is None and alone.advantage_percent is None


def test_audit(spark):
    clean = S.audit(records(spark, (1, 1, 1, 1, 1), CELLS[:1]), collections(spark, 5)).first()
    assert clean.formal_ready and clean.issues == [] and clean.minimum_runs_per_cell == 5 and clean.minimum_tail_samples_per_run is None
    bad = S.audit(records(spark, (1, 1), CELLS[:1]), collections(spark, 2, dirty={0})).first()
    assert not bad.formal_ready and bad.issues == ["made from a changed tree: run-0", "some cell has only 2 independent runs of the 5 wanted"]
    none = S.audit(records(spark, ()), collections(spark, 0)).first()
    assert (none.cell_count, none.minimum_rounds_per_run, none.all_sources_clean, none.formal_ready) == (0, 0, False, False)


def test_bundle(spark, tmp_path):
    analysis = sinks.Analysis.of(records(spark), collections(spark, 2), "sha256:x")
    sinks.write_bundle(analysis, tmp_path / "out")
    assert (tmp_path / "out/winners.csv").read_text().splitlines()[0].startswith("case_name,metric,implementation")
    assert json.loads((tmp_path / "out/analysis.json").read_text())["counts"] == {"measurements": 12, "summary": 6, "winners": 3, "pairwise": 3}
    assert "exploratory only" in (tmp_path / "out/report.md").read_text()
    with pytest.raises(InvalidParameter, match="exists"):
        sinks.write_bundle(analysis, tmp_path / "out")
    sinks.write_one_csv(analysis.winners.limit(0), tmp_path / "none.csv", ["case_name"])
    assert (tmp_path / "none.csv").read_text() == ""
    sinks.write_csv(analysis.summaries, str(tmp_path / "parts"), ["case_name"])
    assert spark.read.option("header", True).csv(str(tmp_path / "parts")).count() == 6
    with pytest.raises(ValueError, match="JSON"):
        sinks.write_json(float("nan"), tmp_path / "nan.json")


def test_run_group_files(spark, tmp_path):
    row = {"implementation_name": "numpy_full", "case_name": "c", "metric_name": "tail_latency", "derived": {"p95": 0.5, "p50": 0.1, "latency_median": 9.0}, "stats": {"rounds": 5, "iterations": 1}, "samples": [1.0, 2.0],
           "extra_info": {"case_objective": "squared_l2", "case_profile": "p", "case_corpus_size": 10, "case_dimension": 2, "case_query_count": 1, "case_k": 1, "case_dtype": "float32"}}
    for name, kind in (("a", "benchmark_run_group"), ("deep/b", "benchmark_paired_run_group")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "x-manifest.json").write_text(json.dumps({"kind": kind}))
    (tmp_path / "a/group.json").write_text(json.dumps({"kind": "benchmark_run_group", "is_complete": True, "runs": [{"source": "s1", "benchmarks": [row]}, {"source": "s2", "benchmarks": [row]}]}, indent=1))
    assert [r.collection.endswith("/a") for r in R.collection_folders(spark, str(tmp_path)).collect()] == [True]
    with pytest.raises(InvalidParameter, match="no benchmark run groups"):
        R.collection_folders(spark, str(tmp_path / "deep"))
    got = R.read_run_groups(spark, [str(tmp_path / "a/group.json")]).orderBy("run_index").collect()
    assert [(r.run_index, r.source, r.value, r.unit, r.sample_count, r.k) for r in got] == [(1, "s1", 0.5, "p95_seconds", 2, 1), (2, "s2", 0.5, "p95_seconds", 2, 1)]
    (tmp_path / "bad.json").write_text("[1")
    with pytest.raises(Exception):  # noqa: B017
        R.read_run_groups(spark, [str(tmp_path / "bad.json")]).collect()
    digest = sinks.files_digest(spark.read.format("binaryFile").load(str(tmp_path / "a")))
    assert digest == sinks.files_digest(spark.read.format("binaryFile").load(str(tmp_path / "a"))) and digest.startswith("sha256:")


def test_run_groups_are_split_into_files_of_bounded_size(spark, sf_dir, tmp_path, monkeypatch):
    from nearfield import registry_contracts as C

    monkeypatch.setattr(C, "GROUP_ROWS", 50)
    monkeypatch.setattr(C, "_shared_folder", lambda _: str(tmp_path / "new"))
    root = C._written_groups(spark, sf_dir)
    folders = R.collection_folders(spark, root, "part-*").collect()
    files = R.read_run_groups(spark, [r.collection for r in folders]).groupBy("collection").count().collect()
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    assert len(folders) == 10 and texts.selectExpr("max(size(split(value, '\"source\"')) - 1)").first()[0] <= 50
    assert sum(r["count"] for r in files) == R.surrogate_records(spark, sf_dir).count() and texts.count() > 10 * 10


def test_run_group_folders_are_found_by_manifests_without_records(spark, sf_dir, tmp_path, monkeypatch):
    from nearfield import registry_contracts as C

    monkeypatch.setattr(C, "_shared_folder", lambda _: str(tmp_path / "new"))
    root = C._written_groups(spark, sf_dir)
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=C.MANIFESTS)
    assert found.count() == 11 and found.selectExpr("max(length(value))").first()[0] < 100
    assert len(R.collection_folders(spark, root, C.MANIFESTS).collect()) == 10
