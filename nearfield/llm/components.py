"""Connected components of a graph of any size, by alternating star contraction over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.cluster import durable

#: Keys that hold more than this share of the rows are joined by broadcast: there are fewer than its inverse of them
HOT = 1 / 1000
#: Links that the driver joins by itself, which are 4 MB; more of them are contracted over DataFrames
FEW = 1 << 18


def hot_joined(rows: DataFrame, named: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """rows with the columns of named, which has each key once; the few keys of hot are joined by broadcast, so no task gets all their rows."""
    few = F.broadcast(hot.select(*keys).withColumn("hot__", F.lit(True)))
    told = rows.join(few, keys, "left")
    hot_named = F.broadcast(named.join(few, keys, "left_semi").select(*named.columns))
    cold = told.where("hot__ is null").drop("hot__").join(named, keys)
    return cold.unionByName(told.where("hot__").drop("hot__").join(hot_named, keys))


def merged(label: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row of each group, after joining the groups of linked rows."""
    if not links:
        return label
    a, b = np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of links (a long, b long) but the roots: root is the smallest node of its component.

    At most `few` distinct links are joined by the driver, in one job instead of some ten a round. More are joined in rounds. Each round sends the larger neighbours of every node to its smallest one, then the smaller ones likewise; the
    number of rounds grows with the logarithm of the longest chain. A node's neighbours are never gathered: its minimum is an
    aggregate that is combined before the shuffle, and joins can be split where a node has very many links. Null ends
    and links of a node to itself are left out.
    """
    own = links.where("a is not null and b is not null and a <> b")
    edges = durable(own.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= few:
        got = edges.toArrow()
        nodes, ends = np.unique(np.concatenate([got.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
        root = merged(np.arange(len(nodes)), [(ends[: got.num_rows], ends[got.num_rows :])])
        below = root != np.arange(len(nodes))
        return durable(links.sparkSession.createDataFrame(pa.table({"node": nodes[below], "root": nodes[root[below]]})))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(lows.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.expr("xxhash64(u, v) >> 16"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
