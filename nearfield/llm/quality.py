"""Quality scores (op9): logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A document's features are its words and pairs of neighbouring words, and the same of the words' shapes (runs of letters,
capitals, digits, and each other character, with repeats left out), and whether a word repeats the one before. They are hashed into 2**18 slots; a
slot's value is the share of the document's n-grams that fall in it, so a score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.cluster import ship
from nearfield.llm.language_id import held_out
from nearfield.llm.wordscan import LOWER, NOT_SPACE, U64, Words, mix, text_chunks, window_hashes

SLOT_BITS = 18
#: Classes of bytes in shapes: 1 letters, 2 capitals, 3 digits; any other character stands for itself
CLASS = np.arange(256, dtype=np.uint8)
CLASS[0x61:0x7B] = CLASS[0x80:] = 1
CLASS[0x41:0x5B] = 2
CLASS[0x30:0x3A] = 3
SCALE = 16.0


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, first): the slots of all n-grams of a chunk, and where each row's begin."""
    words = Words(LOWER[data], offs, NOT_SPACE)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    h, rows = words.hashes(), words.rows
    kind = CLASS[data]
    begins = np.zeros(len(data), bool)
    begins[words.starts] = True
    begins[1:] |= kind[1:] != kind[:-1]
    begins &= NOT_SPACE[data]
    at = np.flatnonzero(begins)
    shapes = Words(kind[at], np.searchsorted(at, offs), np.ones(256, bool))
    shapes.starts = np.searchsorted(at, words.starts)
    shapes.ends = np.append(shapes.starts[1:], len(at))
    s = shapes.hashes()
    pair = np.zeros(len(h), bool)
    pair[:-1] = rows[1:] == rows[:-1]
    again = np.zeros(len(h), U64)
    again[:-1] = h[1:] == h[:-1]
    wide = lambda x, salt: np.append(window_hashes(x, 2, salt), U64(0))
    kinds = [(mix(h + U64(1)), None), (wide(h, 2), pair), (mix(s + U64(3)), None), (wide(s, 4), pair), (mix(again + U64(5)), pair)]
    slots = np.concatenate([x if m is None else x[m] for x, m in kinds]) >> U64(64 - SLOT_BITS)
    owner = np.concatenate([rows if m is None else rows[m] for _, m in kinds])
    order = np.argsort(owner, kind="stable")
    return slots[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(offs)))


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; the last slot is the bias."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << SLOT_BITS) + 1), np.zeros((1 << SLOT_BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        at, many = np.unique(slots, return_counts=True)
        at, x = np.append(at, 1 << SLOT_BITS), np.append(SCALE * many / max(len(slots), 1), 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _train(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, model = [], Ftrl()
        for batch in batches:  # in order of a hash of doc_id
            for at, end, data, offs in text_chunks(batch.column("text")):
                slots, first = features(data, offs)
                for k in range(end - at):
                    own = slots[first[k] : first[k + 1]].astype(np.int32)
                    label = batch.column("quality")[at + k].as_py()
                    model.learn(own, label)
                    seen.append((own, label))
        for _ in range(epochs - 1):
            for own, label in seen:
                model.learn(own, label)
        yield pa.record_batch([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, epochs: int = 3) -> np.ndarray:
    """The weights, fitted on at most `most` labelled documents, picked and ordered by a hash of doc_id, in one task.

    Rows without doc_id, text or a label of 0 or 1 are left out. Without any row all weights are zero.
    """
    ship(docs.sparkSession)
    picked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    picked = F.broadcast(picked.withColumn("h__", F.xxhash64("doc_id")).orderBy("h__", "doc_id").limit(most))
    rows = docs.where("text is not null").select("doc_id", "text").join(picked, "doc_id").repartition(1).sortWithinPartitions("h__", "doc_id", "text")
    got = rows.select("text", "quality").mapInArrow(_train(epochs), "weights binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros((1 << SLOT_BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score: how likely each document is of label 1, from 0 to 1.

    A null or wordless text gets the score of the bias alone. Repeated rows are scored one by one. Extra columns are not read.
    """
    ship(spark := docs.sparkSession)
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(np.float64)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, end, data, offs in text_chunks(batch.column(1)):
                slots, first = features(data, offs)
                total, full = np.zeros(end - at), np.flatnonzero(np.diff(first))
                if len(full):  # each row's sum by itself, so equal texts have equal scores
                    total[full] = np.add.reduceat(w[slots], first[full])
                out[at:end] = w[-1] + SCALE * total / np.maximum(np.diff(first), 1)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, train(docs, labels.where(~held_out(5, 0))))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
