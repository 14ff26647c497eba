"""Exact nearest neighbours: one logical operator, several physical strategies with the same rows.

blocked    matrix products over blocks of rows find candidates for a running top k of each query, one list a task
window     like blocked, for 256 queries at once, so that scores of a block stay few
full_sort  all scores of a query are sorted, without an early cut; a task has some of the queries and the broadcast corpus
heap       like blocked, with a bounded heap for each query
pivot      like blocked, but rows whose distance to a pivot rules them out are not scored (distances only)

Candidates of matrix products are those that rounding could let into the top k, by bounds for each row; they are scored
again coordinate by coordinate.

Scores are summed from the first coordinate to the last in doubles by all of them, so results agree bit by bit.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import InvalidParameter, InvalidVectors, UnsupportedObjective
from nearfield.functions.vectors import squared_norm
from nearfield.objectives import Objective, resolve_objective
from nearfield.operators.validate import Shape, neighbour_count, positive_int, validate_vectors

NEIGHBORS = "query_id long, rank int, id long, score double"
_CANDIDATES = "query_id long, id long, score double"
#: Bytes of queries that are broadcast at once; more are searched for block by block
QUERY_BYTES = 64 << 20
#: Bytes of the largest corpus, in doubles, that is broadcast to be sorted for each query; larger ones are sorted by a shuffle of all pairs
SORTED_BYTES = 128 << 20
#: The same for the scores of one query
SORTED_ROWS = 1 << 21
#: Beyond so many neighbours of all queries, lists of k are sorted query by query instead of kept in each task
KEPT_ROWS = 1 << 21
#: Pairs of a task, where a corpus has fewer parts than its pairs are worth
TASK_PAIRS = 1 << 24
#: Rows of queries and of the corpus that are scored at once, so that scores stay in a core's cache
TILE = (64, 1024)


def rank(scored: DataFrame, k: int) -> DataFrame:
    """The first k of each query by score, then id, of (query_id, id, score); k >= 1."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def merge(parts: list[DataFrame], k: int) -> DataFrame:
    """The first k of each query over the candidates of all parts."""
    together = parts[0].select("query_id", "id", "score")
    for part in parts[1:]:
        together = together.unionByName(part.select("query_id", "id", "score"))
    return rank(together, k)


def widen(neighbors: DataFrame) -> DataFrame:
    """(query_id, indices, scores): one row a query, arrays by rank."""
    got = neighbors.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("r"))
    return got.select("query_id", F.transform("r", lambda x: x["id"]).alias("indices"), F.transform("r", lambda x: x["score"]).alias("scores"))


def lengthen(wide: DataFrame) -> DataFrame:
    rows = wide.select("query_id", F.posexplode(F.arrays_zip("indices", "scores")).alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.indices").alias("id"), F.col("x.scores").alias("score"))


def in_blocks(queries: DataFrame, size: int | None = None) -> list[DataFrame]:
    """queries (query_id, vector), as frames of about QUERY_BYTES at most; size, their bytes, is measured unless given."""
    if size is None:
        size = 8 * (queries.agg(F.sum(F.size("vector"))).first()[0] or 0)
    blocks = max(1, -(-size // QUERY_BYTES))
    return [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


def score_matrix(corpus: DataFrame, queries: DataFrame, objective: Objective | str) -> DataFrame:
    """(query_id, id, score) of all pairs; queries (query_id, vector) are broadcast, in blocks of measured size.

    A pair whose sizes differ, or with a null among its coordinates, has a null score.
    """
    resolved = resolve_objective(objective)
    size = queries.agg(F.sum(F.size("vector")), F.count("*")).first()
    rows = corpus.select("id", "vector")
    rows = spread(rows, rows.count() * size[1])
    return reduce(DataFrame.unionByName, [_all_scores(rows, part, resolved) for part in in_blocks(queries, 8 * (size[0] or 0))])


def spread(corpus: DataFrame, pairs: int, most: int | None = None) -> DataFrame:
    """The corpus in as many parts as its pairs are worth, at most `most`; with few pairs as it lies."""
    parts = min(pairs // TASK_PAIRS, most or pairs)
    return corpus.repartition(parts, "id") if parts > 1 else corpus


def _by_size(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(positions, rows in doubles) of the vectors of each size; None for those that are null or have a null coordinate."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten()
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if flat.null_count:
        owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
        sizes[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, _matrix(vectors if len(at) == len(sizes) else vectors.take(pa.array(at))) if n >= 0 else None


def _all_scores(corpus: DataFrame, queries: DataFrame, objective: Objective) -> DataFrame:
    asked = queries.select("query_id", "vector").toArrow()
    sent = corpus.sparkSession.sparkContext.broadcast((asked.column("query_id").combine_chunks(), list(_by_size(asked.column("vector")))))
    kind = T.StructType([queries.schema["query_id"], corpus.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, wanted = sent.value
        for batch in batches:
            for at, rows in _by_size(batch.column("vector")):
                for asked_at, vectors in wanted:
                    for r in range(0, len(at), TILE[1]):
                        for q in range(0, len(asked_at), TILE[0]):
                            ids, own = at[r : r + TILE[1]], asked_at[q : q + TILE[0]]
                            if rows is None or vectors is None or rows.shape[1] != vectors.shape[1]:
                                scores = pa.nulls(len(own) * len(ids), pa.float64())
                            else:
                                scores = pa.array(tile_scores(vectors[q : q + TILE[0]], rows[r : r + TILE[1]], objective).ravel())
                            yield pa.record_batch([query_ids.take(pa.array(np.repeat(own, len(ids)))), batch.column("id").take(pa.array(np.tile(ids, len(own)))), scores], ["query_id", "id", "score"])

    return corpus.mapInArrow(run, kind)


def tile_scores(queries: np.ndarray, rows: np.ndarray, objective: Objective) -> np.ndarray:
    """Scores of all pairs, each summed from the first coordinate to the last."""
    out = np.empty((len(queries), len(rows)))
    for r in range(0, len(rows), TILE[1]):
        columns = np.ascontiguousarray(rows[r : r + TILE[1]].T)
        for q in range(0, len(queries), TILE[0]):
            own = queries[q : q + TILE[0]]
            total, term = np.zeros((len(own), columns.shape[1])), np.empty((len(own), columns.shape[1]))
            for k in range(len(columns)):
                if objective is Objective.SQUARED_L2:
                    np.subtract(columns[k], own[:, k, None], out=term)
                    np.multiply(term, term, out=term)
                else:
                    np.multiply(columns[k], own[:, k, None], out=term)
                total += term
            out[q : q + TILE[0], r : r + TILE[1]] = (-total if objective is Objective.SQUARED_L2 else total) + 0.0
    return out


def exact_scores(rows: np.ndarray, query: np.ndarray, objective: Objective) -> np.ndarray:
    """Scores of rows against a query, or row by row against queries, each a running sum over the coordinates."""
    terms = (rows - query) ** 2 if objective is Objective.SQUARED_L2 else rows * query
    total = np.cumsum(terms, axis=1)[:, -1]
    return (-total if objective is Objective.SQUARED_L2 else total) + 0.0


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), flat.size // max(len(column), 1))


class RunningTop:
    """The k best of all rows offered so far for each query; exact scores, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int, objective: Objective):
        self.queries, self.k, self.objective = queries, k, objective
        self.squares = (queries * queries).sum(axis=1)
        self.rounding = 4 * (queries.shape[1] + 8) * np.finfo(np.float64).eps
        self.least = np.full(len(queries), -np.inf)  # of the k-th best, once there are k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def exact(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Final scores, row by row."""
        return exact_scores(rows, queries, self.objective)

    def candidates(self, rows: np.ndarray, squares: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, exact score) of all pairs that may be among the k best."""
        scores = self.queries[which] @ rows.T
        if self.objective is Objective.SQUARED_L2:
            scores = 2 * scores - squares - self.squares[which][:, None]
        room = self.rounding * (np.sqrt(self.squares[which].max(initial=0)) + np.sqrt(squares)) ** 2
        bound = self.least[which].copy()
        new = np.flatnonzero(bound == -np.inf)
        if len(new) and self.k <= len(rows):
            bound[new] = np.partition(scores[new] - room, len(rows) - self.k, axis=1)[:, len(rows) - self.k]
        q, r = np.nonzero(scores + room >= bound[:, None])
        exact = np.empty(len(q))
        for at in range(0, len(q), 1 << 14):
            exact[at : at + (1 << 14)] = self.exact(rows[r[at : at + (1 << 14)]], self.queries[which[q[at : at + (1 << 14)]]])
        return which[q], r, exact

    def offer(self, ids: np.ndarray, rows: np.ndarray, squares: np.ndarray, which: np.ndarray | None = None) -> None:
        which = np.arange(len(self.queries)) if which is None else which
        if not len(rows) or not len(which):
            return
        q, r, exact = self.candidates(rows, squares, which)
        asked = np.zeros(len(self.queries), bool)
        asked[which] = True
        own = asked[self.query]  # only lists of queries that are asked for are sorted again
        query, id_, score_ = np.concatenate([self.query[own], q]), np.concatenate([self.id[own], ids[r]]), np.concatenate([self.score[own], exact])
        order = np.lexsort((id_, -score_, query))
        query = query[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        query, id_, score_ = query[kept], id_[order][kept], score_[order][kept]
        first, last = np.searchsorted(query, which), np.searchsorted(query, which, "right")
        full = last - first == self.k
        self.least[which[full]] = score_[last[full] - 1]
        self.query, self.id, self.score = (np.concatenate([old[~own], new]) for old, new in ((self.query, query), (self.id, id_), (self.score, score_)))


@dataclass(frozen=True)
class PreparedQueries:
    """Validated queries, fixed for one objective."""

    frame: DataFrame
    objective: Objective
    shape: Shape
    owner: object = None


def prepare_queries(queries: DataFrame, *, objective: Objective | str = Objective.NORMALIZED_COSINE, query_id: str = "query_id", vector: str = "vector", owner: object = None) -> PreparedQueries:
    """Nothing is kept in memory; persist the frame of queries that are dear to compute and searched often."""
    resolved = resolve_objective(objective)
    if not isinstance(queries, DataFrame):
        validate_vectors(queries, name="queries")
    own = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("vector"))
    shape = validate_vectors(own, name="queries", unit_rows=resolved.requires_unit_rows, key="query_id")
    return PreparedQueries(own, resolved, shape, owner)


class ExactIndex:
    """A validated corpus (id, vector) and its objective.

    persist keeps the rows and their squared norms in executor memory and on their disks, so later changes of the files
    aren't seen; release gives them back.
    """

    def __init__(self, corpus: DataFrame, objective: Objective | str = Objective.NORMALIZED_COSINE, *, id: str = "id", vector: str = "vector", persist: bool = False, block_size: int = 16_384, query_block: int = 1024, pivots: int = 16):
        self._objective = resolve_objective(objective)
        if not isinstance(corpus, DataFrame):
            validate_vectors(corpus, name="corpus")
        own = corpus.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
        self._corpus = own.withColumn("sq_norm", squared_norm(F.col("vector"))).persist() if persist else own
        self._block_size, self._query_block, self._pivots = positive_int(block_size, "block_size"), positive_int(query_block, "query_block"), positive_int(pivots, "pivots")
        self._shape = validate_vectors(self._corpus, name="corpus", unit_rows=self._objective.requires_unit_rows, key="id")

    @property
    def size(self) -> int:
        return self._shape.size

    @property
    def dimension(self) -> int:
        return self._shape.dimension

    @property
    def dtype(self) -> str:
        return self._shape.dtype

    @property
    def objective(self) -> Objective:
        return self._objective

    @property
    def block_size(self) -> int:
        return self._block_size

    @property
    def query_block(self) -> int:
        return self._query_block

    @property
    def pivots(self) -> int:
        return self._pivots

    @cached_property
    def pivot_rows(self) -> np.ndarray:
        """Rows that lie far apart, chosen once: of a thousand rows by hash of id, each the farthest from those before."""
        some = np.array([r.vector for r in self._corpus.orderBy(F.xxhash64("id"), "id").limit(1024).collect()], np.float64)
        chosen, far = [0], ((some - some[0]) ** 2).sum(axis=1)
        while len(chosen) < self._pivots and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((some - some[chosen[-1]]) ** 2).sum(axis=1))
        return some[chosen]

    def release(self) -> None:
        self._corpus.unpersist()

    def prepare_queries(self, queries: DataFrame, query_id: str = "query_id", vector: str = "vector") -> PreparedQueries:
        return prepare_queries(queries, objective=self._objective, query_id=query_id, vector=vector, owner=self)

    def search(self, queries: DataFrame, k: int, strategy: str = "blocked") -> DataFrame:
        """(query_id, rank, id, score): the k best rows of each query."""
        return self.search_prepared(self.prepare_queries(queries), k, strategy)

    def search_prepared(self, queries: PreparedQueries, k: int, strategy: str = "blocked") -> DataFrame:
        if not isinstance(queries, PreparedQueries):
            raise InvalidVectors("queries must be PreparedQueries")
        if queries.owner is not None and queries.owner is not self:
            raise InvalidVectors("queries were prepared by another index")
        if queries.objective is not self._objective:
            raise InvalidVectors(f"query objective {queries.objective} differs from {self._objective}")
        if queries.shape.dimension != self.dimension:
            raise InvalidVectors(f"query dimension {queries.shape.dimension} differs from {self.dimension}")
        if queries.shape.dtype != self.dtype:
            raise InvalidVectors(f"query dtype {queries.shape.dtype} differs from {self.dtype}")
        neighbour_count(k, self.size)
        if strategy not in STRATEGIES:
            raise InvalidParameter("strategy must be one of: " + ", ".join(sorted(STRATEGIES)))
        run, objectives = STRATEGIES[strategy]
        if self._objective not in objectives:
            raise UnsupportedObjective(f"{strategy} does not support {self._objective}; it supports only " + ", ".join(objectives))
        if strategy != "full_sort" and k * queries.shape.size > KEPT_ROWS:
            run = _full_sort
        parts = in_blocks(queries.frame, 8 * queries.shape.size * queries.shape.dimension)
        return reduce(DataFrame.unionByName, [run(self, part, k) for part in parts])


def _window(index: ExactIndex, queries: DataFrame, k: int) -> DataFrame:
    return running_search(index, queries, k, RunningTop, 256)


def downwards(scores: np.ndarray) -> np.ndarray:
    """Positions from the greatest score down, equal scores by position; faster than a stable sort, with many ties too."""
    order = np.argsort(-scores)
    got = scores[order]
    tied = got[1:] == got[:-1]
    if tied.any():
        run = np.concatenate([[0], np.cumsum(~tied)]) * len(scores)
        order = np.sort(run + order) - run
    return order


def _full_sort(index: ExactIndex, queries: DataFrame, k: int) -> DataFrame:
    asked = queries.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("names")).first()
    if index.size > SORTED_ROWS or 8 * index.size * index.dimension > SORTED_BYTES or asked.names < asked.n:
        # a filter on the rank of another column's alias isn't turned into an early cut
        order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
        ranked = _all_scores(spread(index._corpus, index.size * asked.n), queries, index.objective).withColumn("rank", F.row_number().over(order))
        return ranked.withColumn("n", F.count("*").over(W.partitionBy("query_id"))).where((F.col("rank") <= k) & (F.col("n") > 0)).select("query_id", "rank", "id", "score")
    got = index._corpus.select("id", "vector").orderBy("id").toArrow()
    rows = _matrix(got.column("vector").combine_chunks())
    sent = index._corpus.sparkSession.sparkContext.broadcast((got.column("id").to_numpy(), rows.astype(np.float32) if index.dtype == "float32" else rows))
    objective, parts = index.objective, max(1, index.size * asked.n // TASK_PAIRS)
    at_once = max(1, (1 << 22) // index.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = sent.value
        for batch in batches:
            names, wanted = batch.column("query_id").to_numpy(), _matrix(batch.column("vector"))
            for q in range(0, len(names), at_once):
                scores = np.concatenate([tile_scores(wanted[q : q + at_once], rows[r : r + (1 << 14)].astype(np.float64), objective) for r in range(0, len(rows), 1 << 14)], axis=1)
                for name, own in zip(names[q : q + at_once], scores, strict=True):
                    order = downwards(own)[:k]  # ids run upwards
                    for a in range(0, len(order), 1 << 16):
                        some = order[a : a + (1 << 16)]
                        yield pa.record_batch([pa.array(np.full(len(some), name)), pa.array(np.arange(a + 1, a + 1 + len(some), dtype=np.int32)), pa.array(ids[some]), pa.array(own[some])], ["query_id", "rank", "id", "score"])

    return queries.select("query_id", "vector").repartition(parts, "query_id").mapInArrow(run, NEIGHBORS)


def _collected(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = queries.orderBy("query_id").toArrow()
    return got.column("query_id").to_numpy(), _matrix(got.column("vector").combine_chunks())


def _merged(candidates: DataFrame, k: int) -> DataFrame:
    """Ranks in two steps: every task has sent up to k rows a query, which a few tasks thin out first."""
    some = W.partitionBy("query_id", "part").orderBy(F.desc("score"), F.asc("id"))
    thinned = candidates.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16))).withColumn("r", F.row_number().over(some)).where(F.col("r") <= k)
    return rank(thinned.select("query_id", "id", "score"), k)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, rows, squared norms) of about size rows each, whatever the batches have."""
    held: list[pa.RecordBatch] = []

    def joined() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        for part in table.to_batches(size):
            rows = _matrix(part.column("vector"))
            yield part.column("id").to_numpy(), rows, part.column("sq_norm").to_numpy() if "sq_norm" in part.schema.names else (rows * rows).sum(axis=1)

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= size:
            yield from joined()
    if sum(x.num_rows for x in held):
        yield from joined()


def _in_tasks(index: ExactIndex, queries: DataFrame, k: int, search: Callable[[RunningTop, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], None], make: type[RunningTop] = RunningTop) -> DataFrame:
    """Each task offers its rows, block by block, and sends at most k rows a query."""
    ids, vectors = _collected(queries)
    sent, objective, block = index._corpus.sparkSession.sparkContext.broadcast((ids, vectors)), index.objective, index.block_size
    corpus = spread(index._corpus, index.size * len(ids), index.size // (64 * k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, wanted = sent.value
        top = make(wanted, k, objective)
        if len(wanted):
            search(top, _blocks(batches, block))
        yield pa.record_batch([pa.array(query_ids[top.query]), pa.array(top.id), pa.array(top.score)], ["query_id", "id", "score"])

    return _merged(corpus.mapInArrow(run, _CANDIDATES), k)


def running_search(index: ExactIndex, queries: DataFrame, k: int, make: type[RunningTop], query_block: int) -> DataFrame:
    def search(top: RunningTop, blocks: Iterator) -> None:
        for ids, rows, squares in blocks:
            for at in range(0, len(top.queries), query_block):
                top.offer(ids, rows, squares, np.arange(at, min(at + query_block, len(top.queries))))

    return _in_tasks(index, queries, k, search, make)


def _blocked(index: ExactIndex, queries: DataFrame, k: int) -> DataFrame:
    return running_search(index, queries, k, RunningTop, index.query_block)


class _Heaps(RunningTop):
    """The same with a heap of (score, -id) for each query; only candidates are pushed."""

    def __init__(self, queries: np.ndarray, k: int, objective: Objective):
        super().__init__(queries, k, objective)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries]

    def offer(self, ids: np.ndarray, rows: np.ndarray, squares: np.ndarray, which: np.ndarray | None = None) -> None:
        q, r, exact = self.candidates(rows, squares, np.arange(len(self.queries)))
        for query, item in zip(q.tolist(), zip(exact.tolist(), (-ids[r]).tolist(), strict=True), strict=True):
            heap = self.heaps[query]
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        self.least = np.array([heap[0][0] if len(heap) == self.k else -np.inf for heap in self.heaps])

    def close(self) -> None:
        out = [(q, -name, value) for q, heap in enumerate(self.heaps) for value, name in heap]
        self.query, self.id, self.score = (np.array([x[c] for x in out], kind) for c, kind in enumerate((np.int64, np.int64, np.float64)))


def _heap(index: ExactIndex, queries: DataFrame, k: int) -> DataFrame:
    def search(top: RunningTop, blocks: Iterator) -> None:
        for block in blocks:
            top.offer(*block)
        top.close()

    return _in_tasks(index, queries, k, search, _Heaps)


def _pivot(index: ExactIndex, queries: DataFrame, k: int) -> DataFrame:
    sent = index._corpus.sparkSession.sparkContext.broadcast(index.pivot_rows)

    def search(top: RunningTop, blocks: Iterator) -> None:
        pivots = sent.value
        own = (pivots * pivots).sum(axis=1)
        apart = lambda rows, squares: np.sqrt(np.maximum(squares[:, None] + own - 2 * rows @ pivots.T, 0))
        asked, everyone = apart(top.queries, top.squares), np.arange(len(top.queries))
        for ids, rows, squares in blocks:
            far = apart(rows, squares)
            near = far.argmin(axis=1)
            order = np.lexsort((far[np.arange(len(rows)), near], near))
            ids, rows, squares, near = ids[order], rows[order], squares[order], near[order]
            ring = far[order, near]
            first = np.searchsorted(near, np.arange(len(pivots) + 1))
            some = np.flatnonzero(np.diff(first))
            room = 2 * np.sqrt(top.rounding) * (np.sqrt(top.squares) + np.sqrt(squares.max()) + np.sqrt(own.max()))
            nearest = some[asked[:, some].argmin(axis=1)]
            for turn in (0, 1):  # each query's nearest bucket first: what it holds rules others out
                for b in some.tolist():
                    which = everyone[(nearest == b) == (turn == 0)]
                    reach = _reach(top, which, squares.max()) + room[which]
                    d, lo, hi = asked[which, b], first[b], first[b + 1]
                    fit = (d - reach <= ring[hi - 1]) & (d + reach >= ring[lo])
                    if not fit.any():
                        continue
                    a = lo + np.searchsorted(ring[lo:hi], (d - reach)[fit].min())
                    z = lo + np.searchsorted(ring[lo:hi], (d + reach)[fit].max(), "right")
                    top.offer(ids[a:z], rows[a:z], squares[a:z], which[fit])

    return _in_tasks(index, queries, k, search)


def _reach(top: RunningTop, which: np.ndarray, largest: float) -> np.ndarray:
    """How far from each query a row may be and still be among its k best."""
    if top.objective is Objective.SQUARED_L2:
        return np.sqrt(-top.least[which])
    return np.sqrt(np.maximum(largest + top.squares[which] - 2 * top.least[which], 0))  # |c - q|^2 = |c|^2 + |q|^2 - 2 c.q


_ALL = tuple(Objective)
_DISTANCES = (Objective.SQUARED_L2, Objective.NORMALIZED_COSINE)
STRATEGIES: dict[str, tuple[Callable[[ExactIndex, DataFrame, int], DataFrame], tuple[Objective, ...]]] = {
    "blocked": (_blocked, _ALL),
    "window": (_window, _ALL),
    "full_sort": (_full_sort, _ALL),
    "heap": (_heap, _ALL),
    "pivot": (_pivot, _DISTANCES),
}
