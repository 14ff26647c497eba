"""The engine's registered queries over the whole test tables, and the same as DuckDB SQL.

Searches take as queries every embedding whose id is divisible by 20, against all embeddings. Study queries run over
surrogate records made from the events table; their values exercise the operators and measure nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import norm, squared_distance_by_norms, squared_norm
from nearfield.objectives import score_of_distance
from nearfield.operators import search, study, trusted, validate
from nearfield.plans import catalog, experiments
from nearfield.sources import synthetic
from nearfield.sources.records import SURROGATE_SQL, surrogate_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = vectors(spark, sf_dir)
    queries = corpus.where("id < 5").select(F.col("id").alias("query_id"), "vector")
    return search.rank(search.score_matrix(corpus, queries, "normalized_cosine"), 10)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def index(spark: SparkSession, sf_dir: str, objective: str) -> tuple[search.ExactIndex, DataFrame]:
    corpus = vectors(spark, sf_dir)
    return search.ExactIndex(corpus, objective), corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    """Doubles to nine decimals, and never a negative zero: the last bits differ between engines."""
    return frame.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in columns or ("score",)})


def rounded_pairs(frame: DataFrame, *columns: str) -> DataFrame:
    """The same for the scores of very many pairs: halves away from zero in doubles, as SQL rounds, without decimals."""

    def nine(c: Column) -> Column:
        half = F.floor(F.abs(c) * 1e9 + 0.5) / F.lit(1e9)
        return F.when(F.abs(c) < 4e6, F.when(c < 0, -half).otherwise(half)).otherwise(F.round(c, 9)) + F.lit(0.0)

    return frame.withColumns({c: nine(F.col(c)) for c in columns or ("score",)})


_V = "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings"
_SCORE = {
    "squared_l2": "-list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i]))) + 0.0",
    "inner_product": "list_inner_product(c.v, q.v) + 0.0",
    "normalized_cosine": "list_inner_product(c.v, q.v) + 0.0",
}


def _scores_sql(objective: str) -> str:
    return f"s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_SCORE[objective]} AS score FROM ({_V}) c, ({_V} WHERE vec_id % 20 = 0) q)"


def topk_sql(objective: str, k: int) -> str:
    ranked = "r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank, id, score FROM s)"
    return f"WITH {_scores_sql(objective)}, {ranked} SELECT query_id, rank, id, round(score, 9) + 0.0 AS score FROM r WHERE rank <= {k}"


def _topk(name: str, objective: str, k: int, strategy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own, queries = index(spark, sf_dir, objective)
        return rounded(own.search(queries, k, strategy))

    run.__name__ = name
    query(topk_sql(objective, k))(run)


for _name, _objective, _k, _strategy in (
    ("topk_l2", "squared_l2", 10, "window"), ("topk_ip", "inner_product", 10, "window"), ("topk_cosine", "normalized_cosine", 10, "window"),
    ("topk_k1", "normalized_cosine", 1, "window"), ("topk_k100", "normalized_cosine", 100, "window"), ("topk_full_sort_l2", "squared_l2", 10, "full_sort"),
    ("topk_heap_ip", "inner_product", 10, "heap"), ("topk_heap_l2", "squared_l2", 10, "heap"), ("topk_blocked_cosine", "normalized_cosine", 10, "blocked"), ("topk_blocked_l2", "squared_l2", 100, "blocked"),
    ("topk_blocked_ip", "inner_product", 10, "blocked"), ("topk_pivot_l2", "squared_l2", 10, "pivot"), ("topk_pivot_cosine", "normalized_cosine", 10, "pivot"),
):
    _topk(_name, _objective, _k, _strategy)


@query(f"WITH {_scores_sql('normalized_cosine')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY rank) AS indices, string_agg(round(score * 1000000)::BIGINT::VARCHAR, ',' ORDER BY rank) AS micro_scores FROM r WHERE rank <= 10 GROUP BY query_id")
def topk_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, queries = index(spark, sf_dir, "normalized_cosine")
    wide = search.widen(own.search(queries, 10))
    micro = F.transform("scores", lambda x: F.round(x * 1000000).cast("long").cast("string"))
    return wide.select("query_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"), F.array_join(micro, ",").alias("micro_scores"))


@query(topk_sql("normalized_cosine", 10))
def topk_lengthened(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, queries = index(spark, sf_dir, "normalized_cosine")
    return rounded(search.lengthen(search.widen(own.search(queries, 10))).withColumn("rank", F.col("rank").cast("int")))


@query(topk_sql("squared_l2", 1 << 40))
def full_ranking_k_eq_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, queries = index(spark, sf_dir, "squared_l2")
    return rounded_pairs(own.search(queries, own.size))


@query(f"WITH {_scores_sql('inner_product')}, t AS (SELECT query_id, id, round(score, 1) + 0.0 AS score FROM s), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank, id, score FROM t) SELECT * FROM r WHERE rank <= 20")
def ties_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = vectors(spark, sf_dir)
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    coarse = search.score_matrix(corpus, queries, "inner_product").withColumn("score", F.round("score", 1) + F.lit(0.0))
    return search.rank(coarse, 20)


@query(f"WITH {_scores_sql('squared_l2')} SELECT query_id, id, round(score, 9) + 0.0 AS score FROM s")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = vectors(spark, sf_dir)
    return rounded_pairs(search.score_matrix(corpus, corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), "squared_l2"))


@query(f"WITH {_scores_sql('squared_l2')} SELECT query_id, id, round(1 + score / 2, 9) + 0.0 AS cosine, round(score, 9) + 0.0 AS l2 FROM s")
def scores_of_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = vectors(spark, sf_dir)
    pairs = search.score_matrix(corpus, corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), "squared_l2")
    d = F.sqrt(-F.col("score"))
    return rounded_pairs(pairs.select("query_id", "id", score_of_distance("normalized_cosine", d).alias("cosine"), score_of_distance("squared_l2", d).alias("l2")), "cosine", "l2")


@query(f"WITH {_scores_sql('squared_l2')} SELECT query_id, id, round(score, 9) + 0.0 AS score FROM s")
def score_matrix_by_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squared distance from stored norms and one dot product."""
    corpus = vectors(spark, sf_dir).withColumn("sq_norm", squared_norm(F.col("vector")))
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"), F.col("sq_norm").alias("q_sq"))
    pairs = corpus.crossJoin(F.broadcast(queries))
    distance = squared_distance_by_norms(F.col("vector"), F.col("q"), F.col("sq_norm"), F.col("q_sq"))
    return rounded(pairs.select("query_id", "id", (-distance).alias("score")))


@query("WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM s) SELECT vec_id AS id, i AS coordinate, round(v[i] / n, 9) + 0.0 AS value FROM n, range(1, 65) t(i)")
def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("vector"))
    flat = validate.normalize_rows(rows).select("id", F.posexplode("vector").alias("at", "value"))
    return rounded(flat.select("id", (F.col("at") + 1).cast("long").alias("coordinate"), "value"), "value")


@query(f"SELECT vec_id AS id, round(list_inner_product(v, v), 9) AS squared_norm, round(sqrt(list_inner_product(v, v)), 9) AS norm FROM ({_V})")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vector")
    return rounded(vectors(spark, sf_dir).select("id", squared_norm(v).alias("squared_norm"), norm(v).alias("norm")), "squared_norm", "norm")


@query(f"SELECT count(*) AS row_count, min(len(v)) AS least_size, max(len(v)) AS most_size, count(*) FILTER (len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS not_finite, count(*) FILTER (abs(sqrt(list_inner_product(v, v)) - 1) > 5.5e-5) AS not_unit FROM ({_V})")
def validate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).agg(*validate.vector_stats(F.col("vector"), "float32"))


_BROKEN = f"b AS (SELECT query_id, rank, CASE WHEN query_id % 3 = 0 AND rank = 4 THEN -1 ELSE id END AS id, CASE WHEN query_id % 7 = 0 AND rank = 2 THEN -2.0 WHEN query_id % 11 = 0 AND rank = 6 THEN 5.0 ELSE score END AS score FROM ({topk_sql('normalized_cosine', 10)}))"


@query(f"WITH {_BROKEN}, l AS (SELECT *, lag(score) OVER w AS sb, lag(id) OVER w AS ib FROM b WINDOW w AS (PARTITION BY query_id ORDER BY rank)), p AS (SELECT query_id, rank, CASE WHEN id < 0 THEN 'ids must be non-negative' WHEN score > sb THEN 'scores must run from the greatest down' WHEN score = sb AND id <= ib THEN 'index ties must run upwards' END AS problem FROM l) SELECT * FROM p WHERE problem IS NOT NULL")
def result_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = topk_cosine(spark, sf_dir).withColumn("id", F.expr("if(query_id % 3 = 0 and rank = 4, -1, id)"))
    broken = broken.withColumn("score", F.expr("case when query_id % 7 = 0 and rank = 2 then -2D when query_id % 11 = 0 and rank = 6 then 5D else score end"))
    return validate.result_violations(broken)


def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["topk_cosine"](spark, sf_dir)


@query(f"WITH t AS ({topk_sql('normalized_cosine', 11).replace('round(score, 9) + 0.0', 'score')}) SELECT query_id, round(max(CASE WHEN rank = 10 THEN score END) - max(CASE WHEN rank = 11 THEN score END), 9) AS margin FROM t GROUP BY query_id")
def boundary_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, queries = index(spark, sf_dir, "normalized_cosine")
    return rounded(trusted.boundary_margins(own.search(queries, 11), 10), "margin")


@query(f"WITH e AS ({topk_sql('normalized_cosine', 10)}) SELECT query_id, id, CASE WHEN query_id % 40 = 0 AND rank = 3 THEN 'score differs' ELSE 'identity mismatch' END AS problem FROM (SELECT query_id, id, rank FROM e WHERE query_id % 40 = 0 AND rank = 3 UNION ALL SELECT query_id, CASE WHEN x THEN id ELSE id + 1000000 END, rank FROM e, (VALUES (true), (false)) v(x) WHERE query_id % 60 = 20 AND rank = 10)")
def validator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = topk_cosine(spark, sf_dir)
    actual = expected.withColumn("score", F.expr("if(query_id % 40 = 0 and rank = 3, score + 0.01, score)")).withColumn("id", F.expr("if(query_id % 60 = 20 and rank = 10, id + 1000000, id)"))
    return trusted.compare(actual, expected)


@query(topk_sql("inner_product", 10))
def merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = vectors(spark, sf_dir)
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    parts = [search.rank(search.score_matrix(corpus.where(F.col("id") % 4 == k), queries, "inner_product"), 10) for k in range(4)]
    return rounded(search.merge(parts, 10))


@query(topk_sql("normalized_cosine", 10))
def trusted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, queries = index(spark, sf_dir, "normalized_cosine")
    return rounded(trusted.trusted_search(own, queries, 10))


@query(f"WITH v AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM ({_V})), u AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS v FROM v), s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_inner_product(c.v, q.v) AS score FROM u c, u q WHERE q.vec_id % 20 = 0), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank, id, score FROM s) SELECT query_id, rank, id, round(score, 9) + 0.0 AS score FROM r WHERE rank <= 10")
def renormalized_blocked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, queries = index(spark, sf_dir, "normalized_cosine")
    return rounded(trusted.blocked_search(own, queries, 10))


@query()
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, queries = index(spark, sf_dir, "normalized_cosine")
    return spark.createDataFrame([(trusted.result_digest(own.search(queries, 10)),)], "digest string")


# ---- plans ----------------------------------------------------------------------------------------------------------

_CORE_SQL = """points AS (
  SELECT 10000 AS n, 128 AS d, 32 AS q, 10 AS k
  UNION ALL SELECT 10000, unnest([8, 32, 768]), 32, 10 UNION ALL SELECT unnest([1000, 100000, 1000000]), 128, 32, 10
  UNION ALL SELECT 10000, 128, unnest([1, 1024]), 10 UNION ALL SELECT 10000, 128, 32, unnest([1, 100])
), objectives AS (SELECT unnest(['squared_l2', 'inner_product', 'normalized_cosine']) AS objective),
core AS (SELECT 'discovery-core' AS profile, objective, n, d, q, k FROM points, objectives),
small AS (SELECT 'discovery-small' AS profile, objective, 1000 AS n, unnest([8, 32, 128, 768]) AS d, 1 AS q, 10 AS k FROM objectives),
stress AS (SELECT 'discovery-stress' AS profile, objective, n, d, q, k FROM core WHERE n = 1000000 OR q = 1024 OR d = 768),
standard AS (SELECT * FROM core c WHERE NOT EXISTS (SELECT 1 FROM stress s WHERE (s.objective, s.n, s.d, s.q, s.k) = (c.objective, c.n, c.d, c.q, c.k))),
smoke AS (SELECT 'smoke' AS profile, objective, n, d, q, k FROM small WHERE d = 8)"""
_NAME = "concat(profile, '__', objective, '__n', n, '__d', d, '__q', q, '__k', k, '__float32')"


def _workloads_sql(table: str) -> str:
    return f"WITH {_CORE_SQL} SELECT {_NAME} AS case_name, objective, n::BIGINT AS corpus_size, d::BIGINT AS dimension, q::BIGINT AS query_count, k::BIGINT AS k, profile, n::BIGINT * d * q AS coordinate_evaluations FROM {table}"


def _workloads(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark).select("case_name", *catalog.POINT, "profile", "coordinate_evaluations")

    return run


for _name, _make, _table in (
    ("catalog_core", catalog.core, "core"), ("catalog_standard_antijoin", catalog.standard, "standard"), ("catalog_stress", catalog.stress, "stress"),
    ("catalog_small", catalog.small, "small"), ("catalog_smoke", catalog.smoke, "smoke"),
):
    QUERIES[_name], ORACLES[_name] = _workloads(_make), _workloads_sql(_table)

_ALL_SQL = f"{_CORE_SQL}, w AS (SELECT * FROM smoke UNION ALL SELECT * FROM small UNION ALL SELECT * FROM standard UNION ALL SELECT * FROM stress)"
_IMPL_SQL = "impl(name, objectives, dependency, f32) AS (VALUES " + ", ".join(f"('{n}', [{', '.join(repr(o) for o in objectives)}], {repr(d) if d else 'NULL'}, {f})" for n, objectives, d, f in catalog.IMPLEMENTATIONS) + ")"
_PEAK = """(2 * n * d * 4 + q * d * 4 + q * k * 12 + CASE WHEN name = 'numpy_full' THEN n * q * 12 WHEN name IN ('numpy_argpartition', 'torch_matmul_topk') THEN n * q * 4 + n * 8
  WHEN name = 'numpy_blocked' THEN least(n, 16384) * q * 4 + q * k * 12 WHEN name LIKE 'sklearn%' OR name LIKE 'scipy%' THEN 2 * n * d * 4 WHEN name LIKE 'faiss%' THEN n * d * 4 ELSE 0 END)"""
_CELLS_SQL = f"""WITH {_ALL_SQL}, {_IMPL_SQL}, c AS (
  SELECT {_NAME} AS workload, profile, name AS implementation, {_PEAK} AS estimated_peak_bytes,
    CASE WHEN NOT list_contains(objectives, objective) THEN 'objective_not_supported' WHEN starts_with(name, 'python_') AND n * d * q > 1000000 THEN 'scalar_runtime_limit' WHEN {_PEAK} > 8589934592 THEN 'memory_budget_exceeded' ELSE 'included' END AS reason
  FROM (SELECT profile, objective, n::BIGINT AS n, d::BIGINT AS d, q::BIGINT AS q, k::BIGINT AS k FROM w), impl)"""


def _every_cell(spark: SparkSession) -> DataFrame:
    cells = None
    for profile in catalog.PROFILES:
        own = catalog.cell_plans(spark, profile, available=lambda _: True)
        cells = own if cells is None else cells.unionByName(own)
    return cells


@query(f"{_CELLS_SQL} SELECT workload, implementation, reason = 'included' AS included, reason, estimated_peak_bytes FROM c")
def feasibility_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_cell(spark).select("workload", "implementation", "included", "reason", "estimated_peak_bytes")


@query(f"{_CELLS_SQL} SELECT implementation, max(estimated_peak_bytes) AS most_bytes, sum(estimated_peak_bytes)::BIGINT AS all_bytes FROM c GROUP BY implementation")
def peak_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_cell(spark).groupBy("implementation").agg(F.max("estimated_peak_bytes").alias("most_bytes"), F.sum("estimated_peak_bytes").alias("all_bytes"))


@query(f"{_CELLS_SQL} SELECT reason, count(*) AS cells FROM c GROUP BY reason")
def feasibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_cell(spark).groupBy("reason").agg(F.count("*").alias("cells"))


@query(f"WITH {_ALL_SQL} SELECT {_NAME} AS case_name, CASE WHEN profile IN ('smoke', 'discovery-small') OR (profile = 'discovery-core' AND n = 10000 AND d = 128 AND q = 32 AND k = 10) THEN 'single_call_latency,batch_throughput,tail_latency' ELSE 'single_call_latency,batch_throughput' END AS metrics FROM w")
def selected_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_workload(spark).select("case_name", F.array_join(catalog.metrics(), ",").alias("metrics"))


def _every_workload(spark: SparkSession) -> DataFrame:
    out = None
    for profile in catalog.PROFILES:
        out = catalog.workloads(spark, profile) if out is None else out.unionByName(catalog.workloads(spark, profile))
    return out


@query(f"WITH {_ALL_SQL} SELECT {_NAME} AS case_name, x AS distribution, CASE WHEN c THEN 'l2_unit_rows' ELSE 'none' END AS normalization, CASE objective WHEN 'squared_l2' THEN 'negative_squared_l2_higher_is_better' WHEN 'inner_product' THEN 'inner_product_higher_is_better' ELSE 'cosine_similarity_higher_is_better' END AS score_convention, concat('synthetic-pcg64-v1:', x, ':', n, ':', d, ':', q, ':float32:20260801') AS dataset_id FROM (SELECT *, objective = 'normalized_cosine' AS c, CASE WHEN objective = 'normalized_cosine' THEN 'uniform_sphere' ELSE 'gaussian' END AS x FROM w)")
def workload_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.metadata(_every_workload(spark)).select("case_name", "distribution", "normalization", "score_convention", "dataset_id")


@query(f"WITH {_CORE_SQL}, t AS (SELECT 0 AS o, 'small' AS profile, NULL AS case_filter UNION ALL SELECT 1, 'core', NULL UNION ALL SELECT 2, 'stress', regexp_replace({_NAME}, '\\W+', '_', 'g') FROM stress) SELECT row_number() OVER (ORDER BY o, case_filter)::INTEGER AS ordinal, profile, case_filter FROM t")
def study_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tasks(spark)


_EXPERIMENTS_SQL = (
    "e(identifier, baseline, candidate, n, d, q, k) AS (SELECT 'argpartition_vs_full_sort', 'numpy_full', 'numpy_argpartition', 100000, 128, 32, unnest([1, 10, 100]) "
    "UNION ALL SELECT 'blocked_vs_argpartition', 'numpy_argpartition', 'numpy_blocked', unnest([100000, 1000000]), 128, 32, 10 "
    "UNION ALL SELECT 'python_heap_vs_argpartition', 'python_heap', 'numpy_argpartition', 1000, unnest([8, 32, 128]), 1, 10)"
)


@query(f"WITH {_EXPERIMENTS_SQL} SELECT identifier, baseline, candidate, concat('confirmatory-', identifier, '__normalized_cosine__n', n, '__d', d, '__q', q, '__k', k, '__float32') AS case_name, 5.0::DOUBLE AS equivalence_margin_percent FROM e")
def experiment_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.registry(spark).select("identifier", "baseline", "candidate", "case_name", "equivalence_margin_percent")


# ---- study ----------------------------------------------------------------------------------------------------------

_SUMMARY_SQL = f"""r AS ({SURROGATE_SQL}), s AS (
  SELECT implementation, case_name, metric, min(unit) AS unit, min(objective) AS objective, min(profile) AS profile, min(corpus_size)::BIGINT AS corpus_size, min(dimension)::BIGINT AS dimension,
    min(query_count)::BIGINT AS query_count, min(k)::BIGINT AS k, count(*) AS run_count, median(value) AS median_value, min(value) AS minimum_value, max(value) AS maximum_value,
    CASE WHEN count(*) >= 2 AND avg(value) <> 0 THEN stddev_samp(value) / avg(value) END AS run_cv
  FROM r GROUP BY implementation, case_name, metric)"""
_WINNER_SQL = f"""{_SUMMARY_SQL}, o AS (
  SELECT *, row_number() OVER w AS place, lead(implementation) OVER w AS runner_up, lead(median_value) OVER w AS nxt FROM s
  WINDOW w AS (PARTITION BY case_name, metric ORDER BY CASE WHEN metric = 'batch_throughput' THEN -median_value ELSE median_value END, implementation)
), w AS (
  SELECT case_name, metric, implementation, median_value AS value, unit, runner_up,
    CASE WHEN nxt <> 0 THEN 100 * (CASE WHEN metric = 'batch_throughput' THEN median_value - nxt ELSE nxt - median_value END) / nxt END AS advantage_percent
  FROM o WHERE place = 1)"""
_PAIR_SQL = f"""{_SUMMARY_SQL}, qs(question, baseline, candidate, factor) AS (VALUES {", ".join(f"('{q[0]}', '{q[1]}', '{q[2]}', '{q[3]}')" for q in study.QUESTIONS)}), p AS (
  SELECT question, baseline, candidate, b.case_name, b.objective, b.corpus_size, b.dimension, b.query_count, b.k, b.median_value AS baseline_seconds, c.median_value AS candidate_seconds,
    100 * (b.median_value - c.median_value) / b.median_value AS candidate_improvement_percent
  FROM qs JOIN s b ON b.implementation = baseline JOIN s c ON c.implementation = candidate AND c.case_name = b.case_name
  WHERE b.metric = 'single_call_latency' AND c.metric = 'single_call_latency' AND CASE factor
    WHEN 'k' THEN b.corpus_size = 10000 AND b.dimension = 128 AND b.query_count = 32
    WHEN 'corpus_size' THEN b.dimension = 128 AND b.query_count = 32 AND b.k = 10
    ELSE b.profile = 'discovery-small' AND b.corpus_size = 1000 AND b.query_count = 1 END)"""


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.summarize(surrogate_records(spark, sf_dir))


@query(f"WITH {_SUMMARY_SQL} SELECT implementation, case_name, metric, unit, objective, profile, corpus_size, dimension, query_count, k, run_count, round(median_value, 9) AS median_value, minimum_value, maximum_value, round(run_cv, 9) AS run_cv FROM s")
def study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _summaries(spark, sf_dir).drop("dtype")
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("corpus_size", "dimension", "query_count", "k")}), "median_value", "run_cv")


@query(f"WITH {_WINNER_SQL} SELECT case_name, metric, implementation, round(value, 9) AS value, unit, runner_up, round(advantage_percent, 6) AS advantage_percent FROM w")
def study_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.winners(_summaries(spark, sf_dir)), "value").withColumn("advantage_percent", F.round("advantage_percent", 6))


@query(f"WITH {_WINNER_SQL} SELECT implementation, count(*) AS wins FROM w WHERE metric = 'single_call_latency' GROUP BY implementation")
def winner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.winner_counts(study.winners(_summaries(spark, sf_dir)))


@query(f"WITH {_PAIR_SQL} SELECT * REPLACE (round(baseline_seconds, 9) AS baseline_seconds, round(candidate_seconds, 9) AS candidate_seconds, round(candidate_improvement_percent, 6) AS candidate_improvement_percent) FROM p")
def pairwise_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = study.contrasts(_summaries(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("corpus_size", "dimension", "query_count", "k")})
    return rounded(out, "baseline_seconds", "candidate_seconds").withColumn("candidate_improvement_percent", F.round("candidate_improvement_percent", 6))


@query(f"WITH {_PAIR_SQL} SELECT question, round(median(candidate_improvement_percent), 6) AS median_improvement_percent, count(*) AS contrasts FROM p GROUP BY question")
def median_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.median_improvements(study.contrasts(_summaries(spark, sf_dir))).withColumn("median_improvement_percent", F.round("median_improvement_percent", 6))


@query(f"""WITH r AS ({SURROGATE_SQL}), c AS (SELECT count(*) AS n FROM r GROUP BY implementation, case_name, metric), t AS (
  SELECT 2::BIGINT AS collection_count, (SELECT count(*) FROM r) AS record_count, (SELECT count(*) FROM c) AS cell_count, (SELECT coalesce(min(n), 0) FROM c) AS runs, (SELECT coalesce(min(rounds), 0)::BIGINT FROM r) AS rounds,
    (SELECT min(sample_count) FROM r WHERE metric = 'tail_latency')::BIGINT AS tail)
SELECT collection_count, record_count, cell_count, runs AS minimum_runs_per_cell, rounds AS minimum_rounds_per_run, tail AS minimum_tail_samples_per_run, true AS all_collections_complete, false AS all_sources_clean,
  false AS single_revision, true AS single_source_tree_digest, false AS formal_ready, 'rev-a,rev-b' AS revisions, 'digest' AS source_tree_digests,
  concat_ws('; ', 'made from a changed tree: collection-1', CASE WHEN runs < 5 THEN concat('some cell has only ', runs, ' independent runs of the 5 wanted') END, 'there are several revisions, or none') AS issues FROM t""")
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    collections = spark.createDataFrame([("collection-0", 0, True, "rev-a", "digest", False), ("collection-1", 1, True, "rev-b", "digest", True)], "collection string, position int, is_complete boolean, git_revision string, source_tree_digest string, git_dirty boolean")
    row = study.audit(surrogate_records(spark, sf_dir), collections)
    counts = ("collection_count", "record_count", "cell_count", "minimum_runs_per_cell", "minimum_rounds_per_run", "minimum_tail_samples_per_run")
    return row.withColumns({c: F.col(c).cast("long") for c in counts} | {c: F.array_join(c, ",") for c in ("revisions", "source_tree_digests")} | {"issues": F.array_join("issues", "; ")})


@query(f"WITH r AS ({SURROGATE_SQL}) SELECT source, case_name, metric, c.n::BIGINT AS case_cells FROM r LEFT JOIN (SELECT case_name, count(DISTINCT implementation) AS n FROM r WHERE profile = 'discovery-small' GROUP BY case_name) c USING (case_name)")
def annotated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = surrogate_records(spark, sf_dir)
    cases = records.where("profile = 'discovery-small'").groupBy("case_name").agg(F.count_distinct("implementation").alias("cells"))
    return study.annotate(records, cases).select("source", "case_name", "metric", "case_cells")


_INTERVAL_SQL = f"{_PAIR_SQL}, i AS (SELECT question || '__' || case_name AS case_name, candidate_improvement_percent AS e, e - 3 AS lo, e + 3 AS hi FROM p), x AS (SELECT *, CASE WHEN lo > 5 THEN 'improvement' WHEN hi < -5 THEN 'regression' WHEN lo >= -5 AND hi <= 5 THEN 'equivalent' ELSE 'inconclusive' END AS regression FROM i)"


def _comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("candidate_improvement_percent")
    pairs = study.contrasts(_summaries(spark, sf_dir))
    named = pairs.select(F.concat_ws("__", "question", "case_name").alias("case_name"), e.alias("improvement_percent"), (e - 3).alias("improvement_low_percent"), (e + 3).alias("improvement_high_percent"), F.lit(5.0).alias("threshold_percent"))
    return experiments.with_intervals(named)


@query(f"WITH {_INTERVAL_SQL} SELECT case_name, array_to_string(string_split(case_name, '__')[3:], ' · ') AS label, round(e - lo, 6) AS bar_below, round(hi - e, 6) AS bar_above, regression FROM x")
def interval_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparisons(spark, sf_dir).select("case_name", "label", F.round("bar_below", 6).alias("bar_below"), F.round("bar_above", 6).alias("bar_above"), "regression")


@query(f"WITH {_INTERVAL_SQL} SELECT regression, count(*) AS n FROM x GROUP BY regression")
def classification_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.classification_counts(_comparisons(spark, sf_dir))


# ---- generators -----------------------------------------------------------------------------------------------------


def _flat(data: synthetic.Dataset) -> DataFrame:
    both = data.corpus.select(F.lit("corpus").alias("part"), "id", "vector").unionByName(data.queries.select(F.lit("queries").alias("part"), F.col("query_id").alias("id"), "vector"))
    return both.select("part", "id", F.posexplode("vector").alias("coordinate", "value"))


@query()
def synthetic_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(synthetic.uniform_sphere(spark, 1000, 8, 32, seed=catalog.SEED))


@query()
def synthetic_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(synthetic.gaussian(spark, 1000, 8, 32, objective="squared_l2", seed=catalog.SEED))


@query()
def synthetic_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(synthetic.clustered(spark, 1000, 8, 32, seed=catalog.SEED))


@query()
def synthetic_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic.distributed_normal(spark, 1000, 8, seed=7, unit_rows=True)
    return rows.select("id", F.posexplode("vector").alias("coordinate", "value"))


