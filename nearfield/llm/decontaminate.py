"""Benchmark passages in documents (op5), found by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of the benchmark items, and whole items of fewer words. For each
pattern length a shift table says, by the block of words (two) at the end of the place looked at, how far the search can move
without missing a pattern. Many stretches of text are searched side by side, each moved by its own shift. Where the
shift is zero, the block selects a bucket of patterns, and those of the same hash over the whole window are compared byte by byte.

The driver compiles the items once, into arrays: a pattern is a hash and a place in the items' text. The shift table grows
with the number of patterns, so that most blocks of other text still shift by the whole length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.cluster import ship
from nearfield.llm.wordscan import ALPHANUMERIC, LOWER, U64, Words, joined, text_chunks, window_hashes

WINDOW = 13
STRETCH = 512
#: Bits of a shift table: for each word of a pattern in it four to eight entries, from 2**16 to 2**26
SHIFT_BITS = (16, 26)
#: Bytes that a word of an item takes in compiled form, at most: hashes, places, item lists, and its part of the shift table
WORD_BYTES = 160


class Patterns:
    """The shift table, the suffix buckets and the places of all patterns of one length."""

    def __init__(self, length: int, words: Words, h: np.ndarray, at: np.ndarray, item: np.ndarray):
        """Of the words of all items (hashes h): patterns begin at the words `at`, and belong to the items `item`."""
        self.length, self.block = length, min(2, length)
        self.raw, begins, ends = joined(words)
        whole = window_hashes(h, length)[at]
        order = np.lexsort((item, whole))
        whole, at, item = whole[order], at[order], item[order]
        self.bits = int(np.clip(math.ceil(math.log2(4 * length * len(at) + 1)), *SHIFT_BITS))
        blocks = block_keys(h, self.block, self.bits)
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8)
        for j in range(length - self.block + 1):
            np.minimum.at(self.shift, blocks[at + j], np.uint8(length - self.block - j))
        # patterns of equal text come once; those of equal hash and different text stay apart
        texts = [self.raw[a:b] for a, b in zip(begins[at].tolist(), ends[at + length - 1].tolist(), strict=True)]
        first: dict[bytes, int] = {}
        which = np.fromiter((first.setdefault(t, len(first)) for t in texts), np.int64, len(texts))
        lead = np.zeros(len(first), np.int64)
        lead[which[::-1]] = np.arange(len(at))[::-1]
        pairs = np.unique(np.stack([which, item], axis=1), axis=0)
        self.items, self.first_item = pairs[:, 1].copy(), np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.begin, self.end = begins[at[lead]], ends[at[lead] + length - 1]
        suffix = blocks[at[lead] + length - self.block].astype(U64)
        key = bucket_keys(suffix, whole[lead], self.bits)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def text(self, k: int) -> bytes:
        return self.raw[self.begin[k] : self.end[k]]

    def find(self, words: Words, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of all occurrences that lie in one row."""
        m, starts = self.length, np.minimum(words.first[:-1] + self.length, words.first[1:] + 1)
        n = words.first[1:] + 1 - starts  # places to look at; each is told by the word behind it
        if not n.sum():
            return
        parts = -(-n // STRETCH)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(starts, parts) + k * STRETCH
        end = np.minimum(at + STRETCH, np.repeat(words.first[1:] + 1, parts))
        blocks, found = block_keys(h, self.block, self.bits), []
        while len(at):
            move = self.shift[blocks[at - self.block]]
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            left = at < end
            at, end = at[left], end[left]
        ends = np.sort(np.concatenate(found))
        if not len(ends):
            return
        key = bucket_keys(blocks[ends - self.block].astype(U64), window_hashes(h, m)[ends - m], self.bits)
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        for e, a, b in zip(ends[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            text = b" ".join(words.word(k) for k in range(e - m, e))
            for p in self.order[a:b].tolist():
                if text == self.text(p):
                    yield e - m, p


def block_keys(h: np.ndarray, block: int, bits: int) -> np.ndarray:
    return (window_hashes(h, block) >> U64(64 - bits)).astype(np.int64)


def bucket_keys(suffix: np.ndarray, whole: np.ndarray, bits: int) -> np.ndarray:
    """The suffix block in the high bits, so buckets lie one after another, and the hash of the whole window below it."""
    return suffix << U64(64 - bits) | whole >> U64(bits)


def compile_items(items: list[tuple[int, str]], window: int = WINDOW) -> list[Patterns]:
    """The patterns of all lengths; ids of items are numbers."""
    texts = [t.encode() for _, t in items]
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    words = Words(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), ALPHANUMERIC)
    h, ids, out = words.hashes(), np.array([i for i, _ in items], np.int64), []
    size = np.minimum(window, words.counts)
    for length in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == length)
        many = words.counts[own] - length + 1
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(words.first[own], many)
        out.append(Patterns(length, words, h, at, np.repeat(ids[own], many)))
    return out


def _search(sent, whole: bool):
    """The words of each row that patterns cover, as bits; of all rows, or, if not whole, of those with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offs in text_chunks(batch.column("text")):
                words, n = Words(LOWER[data], offs, ALPHANUMERIC), end - at
                h, edge, items = words.hashes(), np.zeros(len(words) + 1, np.int64), [set() for _ in range(n)]
                for p in sent.value:
                    for first, k in p.find(words, h):
                        edge[first] += 1
                        edge[first + p.length] -= 1
                        items[int(np.searchsorted(words.first, first, "right")) - 1].update(p.items[p.first_item[k] : p.first_item[k + 1]].tolist())
                covered = np.cumsum(edge[:-1]) > 0
                hit = [np.packbits(covered[lo:hi]).tobytes() if x else None for lo, hi, x in zip(words.first[:-1].tolist(), words.first[1:].tolist(), items, strict=True)]
                total = np.concatenate([[0], np.cumsum(covered)])
                n_hit = total[words.first[1:]] - total[words.first[:-1]]
                out = pa.record_batch([batch.column("doc_id")[at:end], batch.column("key")[at:end], pa.array(words.counts.astype(np.int64)), pa.array(n_hit), pa.array(hit, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], ["doc_id", "key", "n_words", "n_hit", "hit", "items"])
                yield out if whole else out.filter(pa.compute.greater(out.column("n_hit"), 0))

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_hit over the bits that several blocks of items have covered."""
    for batch in batches:
        n_hit = batch.column("n_hit").to_pylist()
        for k, (own, more) in enumerate(zip(batch.column("hit").to_pylist(), batch.column("more").to_pylist(), strict=True)):
            if more:
                bits = [np.frombuffer(x, np.uint8) for x in [*more, *([own] if own else [])]]
                n_hit[k] = int(np.bitwise_count(reduce(np.bitwise_or, bits)).sum())
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), batch.column("items")], ["doc_id", "n_words", "n_hit", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = 512 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated: which words of each document lie in benchmark passages.

    A-Z are lower-cased; words are runs of digits, a-z and characters outside ASCII. A passage is 13 consecutive words
    of an item, or a whole item of fewer words. items has the ids, ascending, of items with an occurring passage. A
    document is contaminated if at least one word and a twentieth of its words are hit. Null texts have no words; items
    without id still hit, but are not listed. Repeated rows are judged one by one. Extra columns are not read.

    The compiled items are sent to every executor. Their size is reckoned first, from the items' words: items over
    broadcast_bytes together are searched for in blocks of about that size (an item is never split), each in its own
    pass over the texts; what the later passes find is joined to the first one's rows by a digest of (doc_id, text).
    """
    ship(spark := docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text").where("text is not null")
    n_words = F.size(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(n_words * WORD_BYTES + F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / broadcast_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    key = F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), "text"), 256) if blocks > 1 else F.lit("")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))
    schema = "doc_id long, key string, n_words long, n_hit long, hit binary, items array<bigint>"
    own = lambda k: spark.sparkContext.broadcast(compile_items([tuple(r) for r in items.where(F.col("block") == k).select("item_id", "text").collect()]))
    out = texts.mapInArrow(_search(own(0), True), schema)
    if blocks > 1:
        more = reduce(DataFrame.unionByName, [texts.mapInArrow(_search(own(k), False), schema).withColumn("block", F.lit(k)).dropDuplicates(["key", "block"]) for k in range(1, blocks)])
        more = more.groupBy("key").agg(F.collect_list("hit").alias("more"), F.flatten(F.collect_list("items")).alias("found"))
        out = out.join(more, "key", "left").withColumn("items", F.array_sort(F.array_union("items", F.coalesce("found", F.array().cast("array<bigint>")))))
        out = out.select("doc_id", "n_words", "n_hit", "hit", "more", "items").mapInArrow(_united, "doc_id long, n_words long, n_hit long, items array<bigint>")
    out = out.select("doc_id", "n_words", "n_hit", F.filter("items", lambda x: x >= 0).alias("items"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), lens AS (
  SELECT DISTINCT m FROM pat
), win AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, lens WHERE len(ws) >= m)
), hit AS (
  SELECT w.doc_id, w.i, w.m, p.item_id FROM win w JOIN pat p ON p.m = w.m AND p.win = w.win
), words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, 13) t(k) WHERE k < m GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""
