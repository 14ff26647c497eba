"""Removal of word passages that an earlier document has already (op1), by level-wise doubling.

A window of 13 words can only repeat if every shorter window in it repeats. So the first level looks at windows of 4
words, and of those only at one for each window of 13: the one with the smallest hash, the same wherever the 13 words
stand. Where it repeats between documents, the next level looks at 8 words in the same way, then 16 and so on, until
no candidates survive or the asked length is reached. There windows are told apart by the 128-bit BLAKE2b digest of
their text, the words joined by one space; the shorter ones' 64-bit hashes only rule places out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.cluster import durable, ship, stored
from nearfield.llm.tables import bitmap, in_bitmap
from nearfield.llm.wordscan import NOT_SPACE, U64, Words, in_one_row, joined, mix, sliding_min, spread, text_chunks, window_hashes

WINDOW = 13
BASE = 4
SALTS = 64


def ladder(window: int, base: int = BASE) -> list[int]:
    """The lengths compared: base, doubled as long as that is below the window, then the window."""
    out = [base]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return [min(out[0], window), *out[1:]]


def _anchors(h: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each window the smallest hash of the windows of the given length inside it."""
    return sliding_min(window_hashes(h, length), window - length + 1) if len(h) >= window else np.zeros(0, U64)


def _distinct(rows: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct (row, keys)."""
    order = np.lexsort((*keys, rows))
    sorted_, new = [x[order] for x in (rows, *keys)], np.zeros(len(rows), bool)
    new[:1] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return tuple(x[new] for x in sorted_)


@dataclass
class Survivors:
    """Which windows of a level repeat: a bitmap of their hashes, or, without one, lists in the column live of each row."""

    length: int
    bits: Broadcast | None = None
    hot: Broadcast | None = None

    def marked(self, h: np.ndarray, words: Words, window: int, live: list) -> tuple[np.ndarray, np.ndarray]:
        """(anchor of each window, whether it repeats)."""
        least = _anchors(h, self.length, window)
        if self.bits is not None:
            return least, in_bitmap(self.bits.value, least)
        found = np.zeros(len(least), bool)
        for k, own in enumerate(live):
            if own is not None:
                lo, hi = words.first[k], min(words.first[k + 1], len(least))
                found[lo:hi] = np.isin(least[lo:hi], own)
        return least, found


def _scanned(batches: Iterator[pa.RecordBatch], window: int, below: Survivors | None):
    """(batch, first row, words, their hashes, their rows, anchor below of each window, which windows are left)."""
    for batch in batches:
        live = batch.column("live") if "live" in batch.schema.names else None
        for at, end, data, offs in text_chunks(batch.column("text")):
            words = Words(data, offs, NOT_SPACE)
            h, rows = words.hashes(), words.rows
            keep, least = in_one_row(rows, window), None
            if below:
                own = [x.values.to_numpy().view(U64) if x.is_valid else None for x in live[at:end]] if live is not None else []
                least, some = below.marked(h, words, window, own)
                keep &= some
            yield batch, at, words, h, rows, least, keep


def _level(length: int, window: int, below: Survivors | None, with_id: bool):
    """The anchors of the places that are left, once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, _, h, rows, _, keep in _scanned(batches, window, below):
            least, n = _anchors(h, length, window), len(keep)
            keep[1:] &= (least[1:] != least[:-1]) | (rows[1:n] != rows[: max(n - 1, 0)]) | ~keep[:-1]
            own, least = _distinct(rows[:n][keep], least[keep])
            found = [pa.array(least.view(np.int64))]
            yield pa.record_batch([*found, batch.column("doc_id").take(pa.array(at + own))] if with_id else found, ["h", "doc_id"][: 1 + with_id])

    return run


def _digests(words: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the text of the windows that begin at the given words, in two halves."""
    raw, begins, ends = joined(words)
    blake = hashlib.blake2b
    found = [blake(raw[a:b], digest_size=16).digest() for a, b in zip(begins[at].tolist(), ends[at + window - 1].tolist(), strict=True)]
    both = np.frombuffer(b"".join(found), U64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _last_level(window: int, below: Survivors | None, hot: bool):
    """The digests of the windows that are left, once for each row; those with hot anchors, or else the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, words, _, rows, least, keep in _scanned(batches, window, below):
            if below and below.hot is not None:
                keep &= np.isin(least, below.hot.value) == hot
            where = np.flatnonzero(keep)
            own, a, b = _distinct(rows[where], *_digests(words, where, window))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[at + own]
            salt = (mix(ids.view(U64)) % U64(SALTS)).astype(np.int32)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(salt), pa.array(ids)], ["a", "b", "salt", "doc_id"])

    return run


def _cut(window: int, below: Survivors | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, words, _, rows, _, keep in _scanned(batches, window, below):
            n = len(words.counts)
            gone, copy = batch.column("windows")[at : at + n], batch.column("copy")[at : at + n].to_pylist()
            has, texts = ~np.asarray(gone.is_null()), words.data.tobytes()
            where = np.flatnonzero(keep & has[rows[: len(keep)]])
            digest, drop = _digests(words, where, window)[0], np.zeros(len(words), bool)
            first = np.searchsorted(where, words.first)
            lost, kept = np.zeros(n, np.int64), []
            for k in range(n):
                own = texts[words.offs[k] : words.offs[k + 1]].split()
                if copy[k] and len(own) >= window:
                    lost[k], own = len(own), []
                elif has[k]:
                    lo, hi, found = words.first[k], words.first[k + 1], slice(first[k], first[k + 1])
                    drop[where[found]] = np.isin(digest[found], gone[k].values.to_numpy().view(U64))
                    out = spread(drop[lo:hi], window, hi - lo)
                    lost[k] = out.sum()
                    own = [w for w, x in zip(own, out, strict=True) if not x]
                kept.append(b" ".join(own))
            yield pa.record_batch([batch.column("doc_id")[at : at + n], pa.array(words.counts.astype(np.int64)), pa.array(lost), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def first_copies(texts: DataFrame, most: int) -> DataFrame:
    """(digest, first): the smallest doc_id of each text that several rows have; marked for broadcast up to `most` of them."""
    again = texts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = durable(again)
    return F.broadcast(again) if again.count() <= most else again


def _narrowed(known: DataFrame, length: int, window: int, below: Survivors | None, filter_bits: int, hot_rows: int) -> tuple[DataFrame, Survivors, int]:
    """(known, with its live anchors where a bitmap would be too large; what survives the level; how many do)."""
    context = known.sparkSession.sparkContext
    again = stored(known.mapInArrow(_level(length, window, below, False), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    count, total = again.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(hot_rows, total >> 17)  # so no more than 131,072 anchors are hot
    hot = again.where(F.col("n") > least).select("h").toArrow().column("h").to_numpy().view(U64)
    survivors = Survivors(length, hot=context.broadcast(np.sort(hot)) if len(hot) else None)
    size = 1 << max(12, int(12 * count).bit_length())
    if size <= filter_bits:
        survivors.bits = context.broadcast(bitmap(again.select("h"), size))
        return known, survivors, count
    pairs = known.mapInArrow(_level(length, window, below, True), "h long, doc_id long").join(again.select("h"), "h", "left_semi")
    live = pairs.groupBy("doc_id").agg(F.collect_set("h").alias("live"))
    return known.drop("live").join(live, "doc_id"), survivors, count


def _repeated(full: DataFrame, salted: bool) -> DataFrame:
    """(doc_id, a): the windows of (a, b, salt, doc_id) that a smaller doc_id has too.

    Salted, a window's rows are dealt to SALTS tasks, and its smallest doc_id is found in two steps.
    """
    keys = ["a", "b", "salt"][: 2 + salted]
    earliest = full.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    if salted:
        whole = earliest.groupBy("a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        earliest = earliest.select(*keys).join(whole, ["a", "b"])
    return full.join(earliest.where("lo < hi").select(*keys, "lo"), keys).where("doc_id > lo").select("doc_id", "a")


def substring_dedup(docs: DataFrame, window: int = WINDOW, base: int = BASE, filter_bits: int = 1 << 30, most_copied: int = 1_000_000, hot_rows: int = 1 << 14) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each document without the words of repeated windows.

    A window is `window` consecutive words [^\\x20\\x09-\\x0D]+ of one document; its words go if the same sequence
    starts in a document with a smaller doc_id. Windows are judged on the input. A null text has no words. Rows of one
    doc_id never count against each other. A row without doc_id has no place in the order: it stays whole and removes
    nothing. Extra columns are not read. No rows give no rows.

    Copies of a whole text after the first repeat it wholly and needn't be compared; their digests are broadcast up to
    most_copied of them, and joined by shuffle beyond. A level's survivors reach the next scan as a bitmap of 12 to 24 bits each,
    or, where that would be over filter_bits, joined to their documents by shuffle. Windows around anchors that over
    hot_rows rows have are compared in salted groups.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = texts.where("doc_id is not null and text is not null")
    firsts = first_copies(known, most_copied)
    known = known.join(firsts, F.sha2("text", 256) == F.col("digest"), "left").where("first is null or doc_id = first").select("doc_id", "text")

    below, left = None, 1
    for length in ladder(window, base)[:-1]:
        known, below, left = _narrowed(known, length, window, below, filter_bits, hot_rows)
        if not left:
            break
    scan = lambda hot: known.mapInArrow(_last_level(window, below, hot), "a long, b long, salt int, doc_id long")
    gone = _repeated(scan(False), False)
    if below and below.hot is not None:
        gone = gone.unionByName(_repeated(scan(True), True))
    gone = gone.groupBy("doc_id").agg(F.collect_list("a").alias("windows"))
    if "live" in known.columns:
        gone = gone.join(known.groupBy("doc_id").agg(F.first("live").alias("live")), "doc_id")

    texts = texts.join(firsts, F.sha2("text", 256) == F.col("digest"), "left").select("doc_id", "text", F.expr("coalesce(doc_id > first, false)").alias("copy"))
    # rows without doc_id are never found, and needn't meet in one task
    texts, gone = texts.withColumn("key", F.coalesce("doc_id", F.monotonically_increasing_id())), gone.withColumnRenamed("doc_id", "key")
    out = texts.join(gone, "key", "left").drop("key").withColumn("windows", F.when(F.col("doc_id").isNotNull(), F.col("windows")))
    return out.mapInArrow(_cut(window, below), "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), f AS (
  SELECT win, min(doc_id) AS lo FROM p GROUP BY win HAVING min(doc_id) < max(doc_id)
), g AS (
  SELECT DISTINCT p.doc_id, p.i + k AS pos FROM p JOIN f ON p.win = f.win AND f.lo < p.doc_id, range(0, 13) t(k)
), x AS (
  SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id
), y AS (
  SELECT w.doc_id, w.ws, coalesce(x.gone, []::BIGINT[]) AS gone FROM w LEFT JOIN x USING (doc_id)
), z AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, gone FROM y
), kept AS (
  SELECT z.doc_id, string_agg(z.word, ' ' ORDER BY z.i) AS txt FROM z LEFT JOIN g ON g.doc_id = z.doc_id AND g.pos = z.i WHERE g.pos IS NULL GROUP BY z.doc_id
)
SELECT y.doc_id, len(y.ws)::BIGINT AS n_words, len(y.gone)::BIGINT AS n_removed, sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM y LEFT JOIN kept USING (doc_id)
"""
