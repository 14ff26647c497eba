"""More registered queries: implementations as searchers, checks, digests, generators, sources and sinks.

What needs no table is held against constants, worked out here in plain Python or NumPy from the definitions.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import registry as R
from nearfield.errors import NearfieldError
from nearfield.objectives import resolve_objective, score_of_cosine_distance
from nearfield.operators import search, study, trusted, validate
from nearfield.operators.searchers import Searcher
from nearfield.plans import catalog, experiments
from nearfield.registry import query, rounded, topk_sql
from nearfield.sources import records, sinks, synthetic


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value!r}::DOUBLE" if isinstance(value, float) else f"{value}::BIGINT" if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values_sql(columns: str, rows: list[tuple]) -> str:
    """The rows as SQL; columns are names with commas."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, row)) + ')' for row in rows)}) AS t({columns})"


# ---- searchers ------------------------------------------------------------------------------------------------------


def _searcher(name: str, objective: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        corpus = R.vectors(spark, sf_dir)
        queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
        return rounded(Searcher(name, corpus, objective).search(queries, 10))

    run.__name__ = f"searcher_{name}"
    query(topk_sql(objective, 10))(run)


for _name, _objective in zip(catalog.STRATEGY_OF, ["squared_l2", "inner_product", "normalized_cosine", "inner_product", "squared_l2", "normalized_cosine", "squared_l2", "normalized_cosine", "squared_l2", "squared_l2", "inner_product", "normalized_cosine"], strict=True):
    _searcher(_name, _objective)


@query(f"WITH {R._scores_sql('normalized_cosine')} SELECT query_id, id, round(1 - (1 - score), 9) + 0.0 AS score FROM s")
def scores_of_cosine_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = R.vectors(spark, sf_dir)
    pairs = search.score_matrix(corpus, corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), "normalized_cosine")
    return rounded(pairs.select("query_id", "id", score_of_cosine_distance(1 - F.col("score")).alias("score")))


@query(topk_sql("squared_l2", 10))
def topk_stored_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that keeps its rows keeps their squared norms with them."""
    corpus = R.vectors(spark, sf_dir)
    own = search.ExactIndex(corpus, "squared_l2", persist=True)
    return rounded(own.search(corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10))


# ---- checks ---------------------------------------------------------------------------------------------------------


def _outcome(call: Callable[[], object]) -> str:
    """What a call returns, or the kind of error that it raises."""
    try:
        return str(call())
    except NearfieldError as error:
        return type(error).__name__


def _checks(name: str, calls: Callable[[SparkSession, str], dict[str, Callable[[], object]]], wanted: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(label, _outcome(call)) for label, call in calls(spark, sf_dir).items()], "asked string, outcome string")

    run.__name__ = name
    R.QUERIES[name] = run
    R.ORACLES[name] = values_sql("asked, outcome", wanted)


_BAD, _FOREIGN = "InvalidParameter", "InvalidVectors"
_checks("check_neighbour_count", lambda spark, sf: {repr(k): lambda k=k: validate.neighbour_count(k, 5) for k in (1, 5, 0, 6, -1, True, 1.0, "1", None)},
        [("1", "1"), ("5", "5"), *((x, _BAD) for x in ("0", "6", "-1", "True", "1.0", "'1'", "None"))])
_checks("check_positive_int", lambda spark, sf: {repr(k): lambda k=k: validate.positive_int(k, "n") for k in (1, 10**12, 0, -3, False, 2.0, None)},
        [("1", "1"), ("1000000000000", "1000000000000"), *((x, _BAD) for x in ("0", "-3", "False", "2.0", "None"))])
_checks("check_dtypes", lambda spark, sf: {k: lambda k=k: validate.resolve_dtype(k).simpleString() for k in ("float32", "float64", "float16", "int8", "")},
        [("float32", "float"), ("float64", "double"), *((x, _BAD) for x in ("float16", "int8", ""))])
_checks("check_objectives", lambda spark, sf: {k: lambda k=k: resolve_objective(k).score_convention for k in ("squared_l2", "inner_product", "normalized_cosine", "manhattan", "")},
        [("squared_l2", "negative_squared_l2_higher_is_better"), ("inner_product", "inner_product_higher_is_better"), ("normalized_cosine", "cosine_similarity_higher_is_better"), ("manhattan", _FOREIGN), ("", _FOREIGN)])
_checks("check_profiles", lambda spark, sf: {k: lambda k=k: catalog.workloads(spark, k).count() for k in ("smoke", "small", "core", "stress", "everything")},
        [("smoke", "3"), ("small", "12"), ("core", "24"), ("stress", "9"), ("everything", _BAD)])
_checks("check_dependencies", lambda spark, sf: {str(k): lambda k=k: catalog.is_installed(k) for k in (None, "numpy", "pyarrow", "surely_not_there")},
        [("None", "True"), ("numpy", "True"), ("pyarrow", "True"), ("surely_not_there", "False")])


def _generator_calls(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    size = lambda make, *a, **k: f"{(d := make(spark, *a, **k)).corpus.count()} {d.queries.count()} {d.distribution}"
    return {
        "sphere": lambda: size(synthetic.uniform_sphere, 5, 3, 2), "no rows": lambda: size(synthetic.uniform_sphere, 0, 3, 2), "no width": lambda: size(synthetic.uniform_sphere, 5, 0, 2),
        "half floats": lambda: size(synthetic.uniform_sphere, 5, 3, 2, dtype="float16"), "seed below zero": lambda: size(synthetic.uniform_sphere, 5, 3, 2, seed=-1), "seed true": lambda: size(synthetic.uniform_sphere, 5, 3, 2, seed=True),
        "gaussian": lambda: size(synthetic.gaussian, 5, 3, 2, objective="squared_l2"), "gaussian cosine": lambda: size(synthetic.gaussian, 5, 3, 2, objective="normalized_cosine"),
        "clustered": lambda: size(synthetic.clustered, 5, 3, 2, clusters=2), "no clusters": lambda: size(synthetic.clustered, 5, 3, 2, clusters=0), "no noise": lambda: size(synthetic.clustered, 5, 3, 2, noise=0.0), "noise without end": lambda: size(synthetic.clustered, 5, 3, 2, noise=float("inf")),
    }


_checks("check_generators", _generator_calls, [("sphere", "5 2 uniform_sphere"), ("gaussian", "5 2 gaussian"), ("clustered", "5 2 clustered"), ("gaussian cosine", _FOREIGN), *((x, _BAD) for x in ("no rows", "no width", "half floats", "seed below zero", "seed true", "no clusters", "no noise", "noise without end"))])


def _prepared_calls(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    """Queries prepared by one index and searched by it, by another, and by a searcher that wants its own."""
    corpus = R.vectors(spark, sf_dir)
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    one, other, torch = search.ExactIndex(corpus), search.ExactIndex(corpus), Searcher("torch_matmul_topk", corpus)
    free, wide = search.prepare_queries(queries), queries.withColumn("vector", F.col("vector").cast("array<double>"))
    ranks = lambda got: got.agg(F.max("rank")).first()[0]
    return {
        "own": lambda: ranks(one.search_prepared(one.prepare_queries(queries), 2)), "of another index": lambda: ranks(one.search_prepared(other.prepare_queries(queries), 2)),
        "of no index": lambda: ranks(one.search_prepared(free, 2)), "torch, own": lambda: ranks(torch.search_prepared(torch.prepare_queries(queries), 2)),
        "torch, of no index": lambda: ranks(torch.search_prepared(free, 2)), "not prepared": lambda: ranks(one.search_prepared(queries, 2)),
        "other objective": lambda: ranks(one.search_prepared(search.prepare_queries(queries, objective="squared_l2"), 2)), "other element type": lambda: ranks(one.search(wide, 2)),
        "tree, inner product": lambda: Searcher("sklearn_kdtree", corpus, "inner_product"), "faiss, doubles": lambda: Searcher("faiss_flat_l2", corpus.withColumn("vector", F.col("vector").cast("array<double>")), "squared_l2"),
        "faiss l2, cosine": lambda: Searcher("faiss_flat_l2", corpus, "normalized_cosine"), "no such implementation": lambda: Searcher("guess", corpus),
    }


_checks("check_prepared_queries", _prepared_calls, [("own", "2"), ("of no index", "2"), ("torch, own", "2"), *((x, _FOREIGN) for x in ("of another index", "torch, of no index", "not prepared", "other objective", "other element type", "faiss, doubles")),
        ("tree, inner product", "UnsupportedObjective"), ("faiss l2, cosine", "UnsupportedObjective"), ("no such implementation", "StrategyUnavailable")])


@query("SELECT count(*) AS rows, max(len(embedding))::BIGINT AS dimension, 'float32' AS dtype, 'normalized_cosine' AS objective, 16384::BIGINT AS block_size, 1024::BIGINT AS query_block, 16::BIGINT AS pivots FROM embeddings")
def index_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = search.ExactIndex(R.vectors(spark, sf_dir))
    return spark.createDataFrame([(own.size, own.dimension, own.dtype, str(own.objective), own.block_size, own.query_block, own.pivots)], "rows long, dimension long, dtype string, objective string, block_size long, query_block long, pivots long")


# ---- digests --------------------------------------------------------------------------------------------------------

_FIXED = [(7, 1, 4, 1.0), (7, 2, 0, 0.123456789012349), (9, 1, 2, -0.0000000000004), (9, 2, 3, -2.5)]
_DIGEST = hashlib.sha256(b"exact-top-k-result-v1\0" + struct.pack("<2q", 2, 2) + struct.pack("<4q", *(r[2] for r in _FIXED)) + struct.pack("<4d", *(float(np.round(r[3], 12)) for r in _FIXED))).hexdigest()


@query(f"SELECT 'sha256:{_DIGEST}' AS digest")
def digest_of_fixed_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores count to 12 decimals; the rows' order on arrival doesn't."""
    rows = spark.createDataFrame(_FIXED[::-1], "query_id long, rank int, id long, score double")
    same = trusted.result_digest(rows) == trusted.result_digest(rows.withColumn("score", F.col("score") + 1e-14))
    return spark.createDataFrame([(trusted.result_digest(rows) if same else "depends on more",)], "digest string")


_FILES = [("b.txt", b"two"), ("a/c.txt", b"three\n"), ("a.txt", b"one")]
_TREE = hashlib.sha256(b"".join(f"/{name}".encode() + b"\0" + hashlib.sha256(data).hexdigest().encode() + b"\0" for name, data in sorted(_FILES, key=lambda f: f"/{f[0]}"))).hexdigest()


@query(f"SELECT 'sha256:{_TREE}' AS tree, 'sha256:{hashlib.sha256(('p' + chr(0) + hashlib.sha256(b'x').hexdigest() + chr(0)).encode()).hexdigest()}' AS files")
def digests_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Path(tempfile.mkdtemp())
    for name, data in [*_FILES, ("left.out", b"other pattern")]:
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    one = spark.createDataFrame([("p", bytearray(b"x"))] * 2, "path string, content binary")
    return spark.createDataFrame([(sinks.tree_digest(spark, f"file://{root}", "*.txt"), sinks.files_digest(one))], "tree string, files string")


@query(f"WITH t AS ({topk_sql('normalized_cosine', 6).replace('round(score, 9) + 0.0', 'score')}), m AS (SELECT query_id, max(CASE WHEN rank = 5 THEN score END) - max(CASE WHEN rank = 6 THEN score END) AS gap FROM t GROUP BY query_id) SELECT CASE WHEN (SELECT count(*) * 64 FROM embeddings) * count(*) <= 1000000 THEN 'scalar_fsum' ELSE 'blocked_float64' END AS method, round(min(gap), 5) AS boundary_margin, count(*) * 5 AS n FROM m")
def reference_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded to five decimals: beyond the scalar limit rows are first made unit rows in doubles."""
    own, queries = R.index(spark, sf_dir, "normalized_cosine")
    made = trusted.build_reference(own, queries, 5)
    out = spark.createDataFrame([(made.method, round(made.boundary_margin, 5), made.result.count())], "method string, boundary_margin double, n long")
    made.release()
    return out


# ---- generators -----------------------------------------------------------------------------------------------------


def _pinned(make: Callable[[np.random.Generator], tuple[np.ndarray, np.ndarray]], unit_rows: bool) -> str:
    rows = []
    for part, values in zip(("corpus", "queries"), make(np.random.Generator(np.random.PCG64(catalog.SEED))), strict=True):
        values = values.astype(np.float32)
        if unit_rows:
            scaled = values / np.abs(values).max(axis=1, keepdims=True)
            values = (scaled / np.sqrt((scaled.astype(np.float64) ** 2).sum(axis=1, keepdims=True))).astype(np.float32)
        rows += [(part, int(i), int(j), round(float(x), 5) + 0.0) for (i, j), x in np.ndenumerate(values)]
    return values_sql("part, id, coordinate, value", rows)


def _draw_clusters(numbers: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centroids = numbers.standard_normal((8, 4))
    centroids = centroids / np.sqrt((centroids**2).sum(axis=1))[:, None]
    corpus, queries = numbers.integers(0, 8, 60), numbers.integers(0, 8, 6)
    return centroids[corpus] + 0.15 * numbers.standard_normal((60, 4)), centroids[queries] + 0.15 * numbers.standard_normal((6, 4))


def _generated(name: str, make: Callable[[SparkSession], synthetic.Dataset], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flat = R._flat(make(spark)).withColumn("value", F.round(F.col("value").cast("double"), 5) + F.lit(0.0))
        return flat.withColumn("coordinate", F.col("coordinate").cast("long"))

    run.__name__ = name
    query(sql)(run)


_generated("generated_sphere", lambda s: synthetic.uniform_sphere(s, 60, 4, 6, seed=catalog.SEED), _pinned(lambda g: (g.standard_normal((60, 4)), g.standard_normal((6, 4))), True))
_generated("generated_gaussian", lambda s: synthetic.gaussian(s, 60, 4, 6, objective="squared_l2", seed=catalog.SEED), _pinned(lambda g: (g.standard_normal((60, 4)), g.standard_normal((6, 4))), False))
_generated("generated_clusters", lambda s: synthetic.clustered(s, 60, 4, 6, seed=catalog.SEED), _pinned(_draw_clusters, True))


@query(f"WITH {R._ALL_SQL} SELECT {R._NAME} AS case_name, CASE WHEN objective = 'normalized_cosine' THEN 'uniform_sphere' ELSE 'gaussian' END AS distribution, n::BIGINT AS rows, d::BIGINT AS width, q::BIGINT AS queries FROM w WHERE profile = 'discovery-small'")
def datasets_of_workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for row in catalog.small(spark).collect():
        data = synthetic.for_workload(spark, row.asDict())
        out.append((row.case_name, data.distribution, data.corpus.count(), len(data.corpus.first().vector), data.queries.count()))
    return spark.createDataFrame(out, "case_name string, distribution string, rows long, width long, queries long")


@query(values_sql("rows, coordinates, off_unit, ids", [(1000, 8000, 0, 1000)]))
def distributed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthetic.distributed_normal(spark, 1000, 8, seed=7, unit_rows=True)
    off = F.abs(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) - 1) > 1e-5
    return made.agg(F.count("*").alias("rows"), F.sum(F.size("vector")).alias("coordinates"), F.count_if(off).alias("off_unit"), F.count_distinct("id").alias("ids"))


# ---- sources and sinks ----------------------------------------------------------------------------------------------


#: Manifests of the folders below
MANIFESTS = "*.txt"
#: Rows of the events table whose records go to one file for each collection and run
GROUP_ROWS = 10_000


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that executors see too: in spark.checkpoint.dir, or a local one where a single machine does all."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return f"{at}/{uuid.uuid4()}" if at else tempfile.mkdtemp()


def _written_groups(spark: SparkSession, sf_dir: str) -> str:
    """Surrogate records as run-group files in a folder a collection and run, each with a manifest, beside a manifest of another kind.

    A file holds GROUP_ROWS records at most, so no task holds a whole run. Files of records are compressed and manifests
    are not, by which MANIFESTS tells them apart: folders are found without reading their records.
    """
    root = _shared_folder(spark)
    own = records.surrogate_records(spark, sf_dir)
    part = F.floor(F.monotonically_increasing_id() / GROUP_ROWS).alias("part")
    # groups hold flat rows; their samples are made as each group is written
    groups = own.groupBy("collection", "run_index", part).agg(F.collect_list(F.struct(*[c for c in own.columns if c not in ("collection", "run_index")])).alias("r"))

    def run(r: Column) -> Column:
        extra = F.struct(*[r[c].cast("long" if c in ("corpus_size", "dimension", "query_count", "k") else "string").alias(f"case_{c}") for c in ("objective", "profile", "corpus_size", "dimension", "query_count", "k", "dtype")])
        derived = F.struct(*[F.when(r["metric"] == m, r["value"]).alias(s) for m, s in records.STATISTIC.items()])
        stats = F.struct(r["rounds"].alias("rounds"), r["iterations"].alias("iterations"))
        row = F.struct(r["implementation"].alias("implementation_name"), r["case_name"].alias("case_name"), r["metric"].alias("metric_name"), derived.alias("derived"), extra.alias("extra_info"), stats.alias("stats"), F.array_repeat(F.lit(0.5), r["sample_count"].cast("int")).alias("samples"))
        return F.struct(r["source"].alias("source"), F.array(row).alias("benchmarks"))

    texts = groups.select("collection", "run_index", F.to_json(F.struct(F.lit("benchmark_run_group").alias("kind"), F.lit(True).alias("is_complete"), F.transform("r", run).alias("runs"))).alias("value"))
    manifest = own.select("collection", "run_index", F.lit('{"kind": "benchmark_run_group", "is_complete": true}').alias("value")).distinct()
    manifest.write.partitionBy("collection", "run_index").text(f"{root}/groups")
    texts.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", 1).partitionBy("collection", "run_index").text(f"{root}/groups")
    spark.createDataFrame([('{"kind": "something else"}',)], "value string").coalesce(1).write.text(f"{root}/groups/other")
    return f"{root}/groups"


@query(f"SELECT collection, count(DISTINCT run_index) AS runs FROM ({records.SURROGATE_SQL}) GROUP BY collection")
def run_group_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the right kind, once each, however many files they hold."""
    found = records.collection_folders(spark, _written_groups(spark, sf_dir), MANIFESTS)
    return found.select(F.regexp_extract("collection", "collection=([^/]*)", 1).alias("collection")).groupBy("collection").agg(F.count("*").alias("runs"))


@query(f"SELECT collection, source, implementation, case_name, metric, value, unit, objective, profile, corpus_size::BIGINT AS corpus_size, dimension::BIGINT AS dimension, k::BIGINT AS k, dtype, rounds::BIGINT AS rounds, iterations::BIGINT AS iterations, sample_count::BIGINT AS sample_count FROM ({records.SURROGATE_SQL})")
def run_group_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _written_groups(spark, sf_dir)
    read = records.read_run_groups(spark, [r.collection for r in records.collection_folders(spark, root, MANIFESTS).collect()])
    return read.select(F.regexp_extract("collection", "collection=([^/]*)", 1).alias("collection"), "source", "implementation", "case_name", "metric", "value", "unit", "objective", "profile", "corpus_size", "dimension", "k", "dtype", "rounds", "iterations", "sample_count")


@query(f"WITH {R._WINNER_SQL} SELECT case_name, metric, implementation, round(value, 6) AS value, runner_up FROM w")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners written as a folder of CSV and as one file, and read from both."""
    won = study.winners(R._summaries(spark, sf_dir)).select("case_name", "metric", "implementation", "value", "runner_up")
    root = Path(tempfile.mkdtemp())
    sinks.write_csv(won, f"file://{root}/parts", sinks.ORDERS["winners"])
    sinks.write_one_csv(won, root / "one.csv", sinks.ORDERS["winners"])
    read = [spark.read.option("header", True).schema(won.schema).csv(f"file://{root}/{name}") for name in ("parts", "one.csv")]
    return read[0].intersectAll(read[1]).withColumn("value", F.round("value", 6))


@query(f"WITH {R._PAIR_SQL}, e AS (SELECT DISTINCT case_name, metric FROM s) SELECT 'measurements' AS name, (SELECT count(*) FROM r) AS n UNION ALL SELECT 'summary', (SELECT count(*) FROM s) UNION ALL SELECT 'winners', (SELECT count(*) FROM e) UNION ALL SELECT 'pairwise', (SELECT count(*) FROM p)")
def analysis_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row counts that analysis.json names, where each CSV file has as many rows."""
    folder = Path(tempfile.mkdtemp()) / "out"
    sinks.write_bundle(_analysis(spark, sf_dir), folder)
    told = json.loads((folder / "analysis.json").read_text())["counts"]
    rows = [(name, n) for name, n in told.items() if (folder / f"{name}.csv").stat().st_size == 0 and n == 0 or spark.read.option("header", True).csv(f"file://{folder}/{name}.csv").count() == n]
    return spark.createDataFrame(rows, "name string, n long")


def _analysis(spark: SparkSession, sf_dir: str) -> sinks.Analysis:
    collections = spark.createDataFrame([(f"collection-{k}", k, True, "rev", "tree", False) for k in range(2)], "collection string, position int, is_complete boolean, git_revision string, source_tree_digest string, git_dirty boolean")
    return sinks.Analysis.of(records.surrogate_records(spark, sf_dir), collections, "sha256:0")


_WINS = f"{R._WINNER_SQL}, n AS (SELECT implementation, count(*) AS wins FROM w WHERE metric = 'single_call_latency' GROUP BY implementation)"


@query(f"WITH {_WINS}, t AS (SELECT implementation, wins FROM n ORDER BY wins DESC, implementation LIMIT 3) SELECT 'Most latency wins: ' || string_agg('`' || implementation || '` (' || wins || ')', ', ' ORDER BY wins DESC, implementation) || '.' AS line FROM t")
def discovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sinks.report(_analysis(spark, sf_dir)).split("\n")
    return spark.createDataFrame([(x,) for x in lines if x.startswith("Most latency wins")], "line string")


@query(f"WITH {_WINS}, c AS (SELECT question, factor, objective, count(*) AS points FROM (WITH {R._PAIR_SQL} SELECT question, objective, CASE question WHEN 'argpartition_vs_full_sort' THEN k WHEN 'blocked_vs_argpartition' THEN corpus_size ELSE dimension END AS factor FROM p) GROUP BY ALL) SELECT 'latency_winner_counts' AS chart, implementation AS place, wins AS height FROM n UNION ALL SELECT question, objective || ' ' || factor, points FROM c")
def chart_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = R._summaries(spark, sf_dir)
    out = sinks.winner_chart(study.winners(summaries)).select(F.lit("latency_winner_counts").alias("chart"), F.col("implementation").alias("place"), F.col("wins").alias("height"))
    for chart in sinks.charts()[1:]:
        points = sinks.contrast_chart(study.contrasts(summaries), chart["chart"]).groupBy(F.concat_ws(" ", chart["series"], chart["x"]).alias("place")).agg(F.count("*").alias("height"))
        out = out.unionByName(points.select(F.lit(chart["chart"]).alias("chart"), "place", "height"))
    return out


@query(f"WITH {R._INTERVAL_SQL} SELECT array_to_string(string_split(case_name, '__')[3:], ' · ') AS label, round(e, 6) AS x, round(e - lo, 6) AS bar_below, round(hi - e, 6) AS bar_above, -5.0::DOUBLE AS margin_low, 5.0::DOUBLE AS margin_high, regression AS series FROM x")
def confirmatory_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    chart = sinks.interval_chart(R._comparisons(spark, sf_dir))
    return chart.withColumns({c: F.round(c, 6) for c in ("x", "bar_below", "bar_above")})


@query(f"WITH {R._INTERVAL_SQL}, n AS (SELECT regression, count(*) AS n FROM x GROUP BY regression) SELECT 'Cells by classification: ' || string_agg(n || ' ' || regression, ', ' ORDER BY regression) || '.' AS line FROM n")
def confirmatory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R._comparisons(spark, sf_dir).select("case_name", "improvement_percent", "improvement_low_percent", "improvement_high_percent", "threshold_percent")
    lines = experiments.report(own, "all").split("\n")
    return spark.createDataFrame([(x,) for x in lines if x.startswith("Cells by")], "line string")


# ---- plans ----------------------------------------------------------------------------------------------------------

_CELLS = [("a", 10, 4), ("b", 23, 4), ("c", 1, 4)]


@query(values_sql("case_name, required_pairs, planned_pairs", [("a", 10, 24), ("b", 23, 24), ("c", 1, 24)]))
def precision_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.precision_plan(spark.createDataFrame(_CELLS, "case_name string, required_pairs int, supercycle int"))


@query(f"SELECT {max(c[1] for c in _CELLS)}::BIGINT AS pairs")
def pair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.createDataFrame(_CELLS, "case_name string, required_pairs int, supercycle int")
    return spark.createDataFrame([(experiments.pair_plan(cells),)], "pairs long")


@query(f"WITH {R._PAIR_SQL} SELECT DISTINCT question AS identifier, case_name FROM p")
def predeclared_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts of declared experiments alone; one of another name is added first and goes again."""
    pairs = study.contrasts(R._summaries(spark, sf_dir)).select(F.col("question").alias("identifier"), "case_name").distinct()
    more = pairs.unionByName(pairs.select(F.lit("an_afterthought").alias("identifier"), "case_name"))
    return experiments.predeclared(experiments.registry(spark), more)


@query(values_sql(", ".join(catalog.NATURAL_DATASET), [("BeIR/scifact", "a75ae049398addde9b70f6b268875f5cbce99089", "sentence-transformers/all-MiniLM-L6-v2", "c9745ed1d9f207416be6d2e6f8de32d1f16199bf", 384, 5183, 1109, "float32", "l2_unit_rows")]))
def natural_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.natural_dataset(spark)
