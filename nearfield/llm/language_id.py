"""Language identification (op2): known words first, then ever shorter character n-grams.

A word that training saw often enough is scored by its log frequency in each language. Any other word backs off to its
character 4-grams, and if none of them is known to 3-grams, 2-grams and single characters; the log frequencies of the known
ones at that length are averaged. A document's language is the one with the highest sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.llm.cluster import ship, stored
from nearfield.llm.wordscan import CHUNK, U64, Words, mix, text_chunks, window_hashes

ORDERS = (4, 3, 2, 1)
#: Slots of the hashed n-gram tables, by length
SLOTS = {4: 1 << 19, 3: 1 << 18, 2: 1 << 16, 1: 1 << 14}
_points: list[np.ndarray] = []


def code_points() -> list[np.ndarray]:
    """Which code points are letters, and each one's lower case (where that is one code point)."""
    if not _points:
        chars = [chr(c) for c in range(0x110000)]
        _points.append(np.fromiter(map(str.isalpha, chars), bool, len(chars)))
        low = [c.lower() for c in chars]
        _points.append(np.fromiter((ord(x) if len(x) == 1 else ord(c) for c, x in zip(chars, low, strict=True)), np.uint32, len(chars)))
    return _points


def letters_of(data: np.ndarray, offs: np.ndarray) -> Words:
    """The words (runs of letters, lower-cased) of a chunk of UTF-8."""
    is_letter, lower = code_points()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return Words(lower[points], begin[offs], is_letter)


def grams(words: Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) of the character n-grams of the marked words."""
    sizes = words.ends - words.starts
    many = np.where(which, np.maximum(sizes - n + 1, 0), 0)
    owner = np.repeat(np.arange(len(words)), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + words.starts[owner]
    h = window_hashes(mix(words.data.astype(U64) + U64(n)), n)
    return (h[at] >> U64(40)) % U64(SLOTS[n]) if len(at) else np.zeros(0, U64), owner


def _gathered(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, which of at) of all entries of the given keys, where key k has the entries first[k] to first[k + 1]."""
    many = first[at + 1] - first[at]
    which = np.repeat(np.arange(len(at)), many)
    return np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + first[at][which], which


class Counts:
    """How often training saw each key in each language, sparse: log frequencies as a floor for all and what is above it."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, k: int, size: int, least: int):
        order = np.lexsort((langs, keys))
        keys, langs, counts = keys[order], langs[order], counts[order].astype(np.float64)
        total = np.bincount(langs, counts, k) + 0.5 * size + 1
        self.floor = np.log(0.5 / total)
        self.keys, begin = np.unique(keys, return_index=True)
        known = np.add.reduceat(counts, begin) >= least if len(begin) else np.zeros(0, bool)
        many = np.diff(np.append(begin, len(keys)))
        mine = np.repeat(known, many)
        self.keys, self.first = self.keys[known], np.concatenate([[0], np.cumsum(many[known])])
        self.langs, self.above = langs[mine], np.log((counts[mine] + 0.5) / 0.5)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def averages(self, at: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """For each owner the mean log frequency, by language, of the keys that it has."""
        k = len(self.floor)
        place, which = _gathered(at, self.first)
        above = np.bincount(owner[which] * k + self.langs[place], self.above[place], owners * k).reshape(owners, k)
        return above / np.maximum(np.bincount(owner, minlength=owners), 1)[:, None] + self.floor


class Model:
    """Word and n-gram log frequencies of each language, as sparse as the training rows; order 0 has the words."""

    def __init__(self, langs: list[str], counts: dict[int, Counts]):
        self.langs, self.counts = langs, counts

    def sums(self, words: Words) -> np.ndarray:
        """The score of each row of a chunk for each language; a row's sum depends on its own words alone."""
        k, h = len(self.langs), words.hashes()
        at, seen = self.counts[0].find(h)
        scores = np.zeros((len(h), k))
        scores[seen] = self.counts[0].averages(at[seen], np.arange(int(seen.sum())), int(seen.sum()))
        left = ~seen
        for n in ORDERS:
            slot, owner = grams(words, left, n)
            at, fit = self.counts[n].find(slot)
            at, owner = at[fit], owner[fit]
            some, mine = np.unique(owner, return_inverse=True)
            scores[some] = self.counts[n].averages(at, mine, len(some))
            left[some] = False
        total = np.zeros((len(words.counts), k))
        full = np.flatnonzero(words.counts)
        if len(full):
            total[full] = np.add.reduceat(scores, words.first[full], axis=0)
        return total


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """(text, lang): at most per_lang rows of each language, those with the smallest hashes of (doc_id, text); of equal rows any.

    Languages are counted first. Then about twice per_lang rows of each are stored, and only those are ranked, so no
    task sees a language whole, and documents are read twice.
    """
    keyed = docs.select("doc_id", "text", "lang").withColumn("h__", F.xxhash64("doc_id", "text")).withColumn("u__", F.expr("shiftrightunsigned(h__, 33) / 2147483648D"))
    sizes = F.broadcast(docs.groupBy("lang").agg(F.count("*").alias("n__")))  # a row for each language
    few = stored(keyed.join(sizes, "lang").where(F.col("u__") * F.col("n__") < 2 * per_lang + 100).select("text", "lang", "h__", "u__"))
    ranked = few.withColumn("k__", F.row_number().over(W.partitionBy("lang").orderBy("u__", "h__")))
    return ranked.where(F.col("k__") <= per_lang).select("text", "lang")


def train(docs: DataFrame, per_lang: int = 2000, min_count: int = 5) -> Model:
    """Fits on at most per_lang rows of each non-null lang; words seen min_count times and more are known.

    Rows without doc_id count like others. What is collected grows with the languages' samples, not with the corpus.
    """
    ship(docs.sparkSession)
    own = sample(docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang")), per_lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lang = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for at, _, data, offs in text_chunks(batch.column(0)):
                words = letters_of(data, offs)
                owner = lang[at + words.rows]
                for n in (0, *ORDERS):
                    keys, word = (words.hashes(), np.arange(len(words))) if not n else grams(words, np.ones(len(words), bool), n)
                    keys, which = keys.astype(U64), owner[word]
                    order = np.lexsort((keys, which))
                    keys, which = keys[order], which[order]
                    heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (which[1:] != which[:-1])])[: len(keys)])
                    yield pa.record_batch([pa.array(np.full(len(heads), n)), pa.array(keys[heads].view(np.int64)), pa.array(names[which[heads]].astype(object), pa.string()), pa.array(np.diff(np.append(heads, len(keys))))], ["gram", "key", "lang", "n"])

    counted = own.mapInArrow(count, "gram long, key long, lang string, n long").groupBy("gram", "key", "lang").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    langs, which = np.unique(np.array(got.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    gram, keys, n = got.column("gram").to_numpy(), got.column("key").to_numpy().view(U64), got.column("n").to_numpy()
    tables = {}
    for order in (0, *ORDERS):
        mine = gram == order
        tables[order] = Counts(keys[mine], which[mine], n[mine], len(langs), SLOTS.get(order) or len(np.unique(keys[mine])), 2 if order else min_count)
    return Model(langs.tolist(), tables)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score: the likeliest learned language and its share of the likelihood, 0 to 1.

    A null text and one without any letter get 'und' and score 0, as everything does if no language was learned. Equal
    scores go to the language that comes first in order. Repeated rows are judged one by one. Other columns pass
    unchanged; own ones named lang_pred or score are replaced.
    """
    ship(spark := docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    schema = docs.drop("lang_pred", "score").schema
    columns = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            best, sure = np.full(batch.num_rows, len(model.langs)), np.zeros(batch.num_rows)
            if not model.langs:
                yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(names[best], pa.string()), pa.array(sure)], [*columns, "lang_pred", "score"])
                continue
            for at, end, data, offs in text_chunks(batch.column("text"), max(CHUNK // 16, CHUNK * 4 // max(len(model.langs), 4))):
                words = letters_of(data, offs)
                sums = model.sums(words)
                some = words.counts > 0
                share = np.exp(sums - sums.max(axis=1, keepdims=True))
                best[at:end] = np.where(some, sums.argmax(axis=1), len(model.langs))
                sure[at:end] = np.where(some, 1 / share.sum(axis=1), 0)
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(names[best], pa.string()), pa.array(sure)], [*columns, "lang_pred", "score"])

    return docs.select(*columns).mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))


def held_out(divisor: int, rest: int):
    """Whether the row is kept from learning: crc32 of doc_id as text leaves this rest. A null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == rest, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(3, 1)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
