"""From raw documents to a training mix: five stages, each a whole pass of one corpus operator.

Each stage takes (spark, docs, sf_dir) and what the stage before it kept. All but the last return the columns of
documents; the last adds the place of each row in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.cluster import stored
from nearfield.llm.decontaminate import decontaminate
from nearfield.llm.language_id import held_out, identify, train
from nearfield.llm.secret_scan import redact
from nearfield.llm.simhash import simhash_groups
from nearfield.llm.source_mix import pfair_mix


#: The predicted language must have more of the likelihood than this: more than all others together
LANGUAGE_SCORE = 0.5
#: Near-duplicates: words of a shingle, differing bits of the fingerprint, and of the second one that confirms them.
#: Texts of which 0.8 of the shingles are common differ in about 10 of 64 bits, those with 0.93 in 6.
SHINGLE, RADIUS, CONFIRM = 5, 6, 16


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the rows that are not held out; rows that none of them fits go.

    Those are rows whose predicted language has at most LANGUAGE_SCORE of the likelihood, and null texts and texts
    without a letter, which score 0. Where no language could be learned, all rows with a letter stay. Rows without a
    lang get the predicted one.
    """
    model = train(docs.where(~held_out(3, 1)))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    aside = docs.withColumnsRenamed({x: f"{x}__own" for x in ("score", "lang_pred") if x in docs.columns})
    named = identify(aside, model).where(F.col("score") > LANGUAGE_SCORE)
    if "lang" in docs.columns:
        named = named.withColumn("lang", F.coalesce("lang", F.col("lang_pred")))
    return named.drop("score", "lang_pred").withColumnsRenamed({f"{x}__own": x for x in ("score", "lang_pred")}).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with key__, a 64-bit hash of doc_id and text: verdicts go by it, so rows without or of one doc_id have their own."""
    return docs.withColumn("key__", F.xxhash64("doc_id", "text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each SimHash group; of its repeated rows one; and rows without doc_id.

    Of texts in one group that share the smallest doc_id one stays; texts of one doc_id in several groups are judged apart.
    Of rows of one doc_id and text that differ elsewhere the one with the smallest hash stays.
    """
    keyed = _keyed(docs)
    ids = keyed.select(F.col("key__").alias("doc_id"), "text")
    groups = simhash_groups(ids, SHINGLE, RADIUS, CONFIRM).select(F.col("doc_id").alias("key__"), "component_id").distinct()
    least = keyed.where("doc_id is not null").select("doc_id", "key__").join(groups, "key__").groupBy("component_id").agg(F.min(F.struct("doc_id", "key__")).alias("least"))
    own = keyed.join(least.select("least.key__"), "key__", "left_semi")
    one = own.groupBy("key__").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row__")).select("row__.*")
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more lies in benchmark passages, with or without doc_id."""
    keyed = _keyed(docs)
    found = decontaminate(keyed.select(F.col("key__").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.where("contaminated").select(F.col("doc_id").alias("key__")), "key__", "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; all documents stay."""
    return redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every row its place in the mix of sources."""
    return pfair_mix(docs)


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("secret_scan", secret_stage),
    ("source_mix", mix_stage),
]

#: SQL has no XXH64, and no language model: the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
