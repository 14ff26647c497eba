"""Near-duplicates by SimHash (op7): fingerprints, BK-trees over shards of them, connected components.

Within a radius of r bits, the 64 bits are cut into r + 2 blocks. Fingerprints that differ in at most r bits differ in at most r blocks, so they agree
in two: each pair of blocks (15 for radius 4) deals the distinct fingerprints into shards, and no link is outside all shards. Each shard has a BK-tree: the
children of a node are keyed by their Hamming distance to it, and a search follows only the keys within the radius of
its own distance. The trees stay with the executors that build them: they hold every fingerprint, which is too much to
send to all. All trees of a batch of shards are built and searched side by side, level by level. Of a shard only links that span
its groups leave it, one for each fingerprint at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.cluster import durable, ship
from nearfield.llm.components import HOT, components, hot_joined, merged
from nearfield.llm.wordscan import LOWER, U64, mix, text_chunks

SHINGLE = 4
SEED = 42
RADIUS = 4
FRONTIER = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE, second: bool = False) -> int | tuple[int, int]:
    """The SimHash of a lower-cased text; zero without words. With second also that of the same shingles' mixed hashes."""
    words = text.split()
    if not words:
        return (0, 0) if second else 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    hashed = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)), U64, len(starts))
    return (_majority(hashed), _majority(mix(hashed))) if second else _majority(hashed)


def _majority(hashed: np.ndarray) -> int:
    ones = np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int, confirm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, end, data, offs in text_chunks(batch.column(1)):
                low = LOWER[data].tobytes()
                out += [fingerprint(low[offs[k] : offs[k + 1]], shingle, confirm) for k in range(end - at)]
            both = np.array(out, U64).reshape(len(out), 1 + confirm)
            other = both[:, -1] if confirm else np.zeros(len(out), U64)
            yield pa.record_batch([batch.column(0), pa.array(both[:, 0].copy().view(np.int64)), pa.array(other.copy().view(np.int64))], ["doc_id", "fp", "other"])

    return run


def bk_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, key) of the BK-trees that inserting each shard's rows in turn would make; roots have parent -1."""
    n = len(fp)
    parent, key = np.full(n, -1), np.zeros(n, np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
    at = np.repeat(firsts, np.diff(np.append(firsts, n)))
    todo = np.flatnonzero(at != np.arange(n))
    while len(todo):
        distance = np.bitwise_count(fp[todo] ^ fp[at[todo]]).astype(np.int64)
        _, lead, which = np.unique(at[todo] * 65 + distance, return_index=True, return_inverse=True)
        child = todo[lead]  # the first to come at this key becomes the child, the others move down to it
        parent[child], key[child] = at[child], distance[lead]
        at[todo] = child[which]
        todo = todo[child[which] != todo]
    return parent, key


def shard_links(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS, other: np.ndarray | None = None, confirm: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) that join all rows of a shard within the radius, each a once and b the first of its group.

    With other fingerprints, links must also be within `confirm` bits of those.
    """
    n = len(fp)
    parent, key = bk_forest(shard, fp)
    kids = np.flatnonzero(parent >= 0)
    kids = kids[np.argsort(parent[kids] * 65 + key[kids], kind="stable")]
    slots = parent[kids] * 65 + key[kids]
    firsts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(firsts, n))
    root = np.repeat(firsts, sizes)
    label = np.arange(n)
    stack = [(a, min(a + FRONTIER // 16, n)) for a in range(0, n, FRONTIER // 16)]
    for lo, hi in stack:
        left, queue = [], [(np.arange(lo, hi), root[lo:hi])]
        while queue:
            q, node = queue.pop()
            if len(q) > FRONTIER:
                queue += [(q[k : k + FRONTIER], node[k : k + FRONTIER]) for k in range(0, len(q), FRONTIER)]
                continue
            distance = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            near = (distance <= radius) & (node < q)
            if other is not None:
                near[near] = np.bitwise_count(other[q[near]] ^ other[node[near]]) <= confirm
            if near.any():
                left.append((q[near], node[near]))
            a = np.searchsorted(slots, node * 65 + np.maximum(distance - radius, 0))
            b = np.searchsorted(slots, node * 65 + np.minimum(distance + radius, 64), "right")
            many = b - a
            if many.sum():
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                queue.append((np.repeat(q, many), kids[np.repeat(a, many) + step]))
            if sum(len(x) for x, _ in left) > FRONTIER or not queue:
                label = merged(label, left)
                left = []
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _shards(radius: int, confirm: int | None):
    """Rows come sorted by shard; a shard cut by the end of a batch waits for its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        for batch in _with_end(batches):
            rows = kept
            if batch is not None:
                rows = [np.concatenate([k, batch.column(c).to_numpy()]) for c, k in enumerate(kept)]
                cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
                kept, rows = [x[cut:] for x in rows], [x[:cut] for x in rows]
            shard, fp, other = rows
            if len(shard) > 1:
                many = np.zeros(len(shard), bool)  # shards of one have no links
                many[1:] |= shard[1:] == shard[:-1]
                many[:-1] |= shard[1:] == shard[:-1]
                shard, fp, other = shard[many], fp[many], other[many]
                a, b = shard_links(shard, fp.view(U64), radius, *((other.view(U64), confirm) if confirm is not None else ()))
                yield pa.record_batch([pa.array(fp[a]), pa.array(other[a]), pa.array(fp[b]), pa.array(other[b])], ["fp", "other", "fp_b", "other_b"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def blocks_of(count: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of so many blocks of the 64 bits, the longer ones first."""
    sizes = [64 // count + (k < 64 % count) for k in range(count)]
    return [(sum(sizes[:k]), size) for k, size in enumerate(sizes)]


def shard_keys(fp: str = "fp", radius: int = RADIUS) -> F.Column:
    """The shards of a fingerprint: each pair of blocks and what they hold, in one number."""
    blocks = blocks_of(radius + 2)
    wide = blocks[0][1]
    block = [f"(shiftrightunsigned({fp}, {low}) & {(1 << bits) - 1}L)" for low, bits in blocks]
    return F.expr("array(" + ", ".join(f"{k}L << {2 * wide} | {block[i]} << {wide} | {block[j]}" for k, (i, j) in enumerate(combinations(range(len(blocks)), 2))) + ")")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, confirm: int | None = None) -> DataFrame:
    """doc_id, fp, component_id: the 64-bit fingerprint of each document and the smallest doc_id it is linked to.

    Texts are lower-cased (A-Z); shingles are `shingle` consecutive words [^\\x20\\x09-\\x0D]+, repeats included, or the whole
    sequence if there are fewer. A null or wordless text has fingerprint zero and is linked like any other. Documents
    link at `radius` differing bits or fewer, and through others; with confirm, a second fingerprint of the same shingles
    must also differ in no more bits than that. A row without doc_id gets a fingerprint and the id of its
    group (null if no other row of it has one). Repeated rows fall into one group. Extra columns are not read.

    Fingerprints and groups that hold over a thousandth of the rows, fewer than a thousand each, are joined by
    broadcast. A shard is searched in one task: the wider the radius and the more rows there are, the larger the shards.
    """
    ship(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle, confirm is not None), "doc_id long, fp long, other long")
    prints = durable(found)
    distinct = durable(prints.groupBy("fp", "other").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    rows, kinds = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    dealt = distinct.select(F.explode(shard_keys("fp", radius)).alias("shard"), "fp", "other").repartition("shard").sortWithinPartitions("shard", "fp", "other")
    links = dealt.mapInArrow(_shards(radius, confirm), "fp long, other long, fp_b long, other_b long")
    # a node is a number: the fingerprint, or a hash of both; should two hashes meet, their groups become one
    node = (lambda a, b: F.col(a)) if confirm is None else (lambda a, b: F.xxhash64(a, b))
    groups = components(links.select(node("fp", "other").alias("a"), node("fp_b", "other_b").alias("b")))
    named = distinct.withColumn("node", node("fp", "other")).join(groups, "node", "left")
    alone = named.where("root is null and node is not null").select("fp", "other", "least", F.col("node").alias("root"))
    linked = named.where("root is not null").select("fp", "other", "least", "root")
    # the root of a group has no row of its own in groups
    roots = groups.select(F.col("root").alias("node")).distinct()
    alone = alone.join(roots, alone.root == roots.node, "left").withColumn("linked", F.col("node").isNotNull()).drop("node")
    linked = linked.unionByName(alone.where("linked").drop("linked"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    together = hot_joined(linked, ids.select("root", "component_id"), ["root"], ids.where(F.col("m") > max(1, kinds * HOT)))
    named = durable(together.select("fp", "other", "component_id").unionByName(alone.where("not linked").select("fp", "other", F.col("least").alias("component_id"))))
    hot = distinct.where(F.col("n") > max(1, rows * HOT))
    return hot_joined(prints, named, ["fp", "other"], hot).select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
