"""Interleaving sources to target weights (op6) by Pfair scheduling, with DataFrame functions only.

Rows of a source are dealt into blocks. In the ideal mix every source that has rows left gets its weight's share of each
slot, and the shares of sources that have run out go to the others: at virtual time v a source of n blocks and weight w
has had min(n, w * v) of them, and T(v), the sum over the sources, is the slot. Block j of a source may so take the slots from
floor(T(j / w)), its release, to ceil(T((j + 1) / w)), its deadline. Each slot goes to the released block with the
earliest deadline. As the ideal mix fills every slot, so do the blocks; all deadlines hold, and up to any slot the
blocks of every source differ from the ideal mix, hence from its weight's share of the slots while no source has run
out, by less than one. All of it is whole-number arithmetic on the given weights; nothing is rounded to a cycle.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.llm.cluster import durable

BLOCK = 50
#: Blocks that a mix has at most, beside one for each source: beyond BLOCK times as many rows, blocks grow
MOST_BLOCKS = 1 << 18
#: Rows that are ranked in one task, about
RUN = 1 << 12
#: Slots that are dealt between two copies of the list of those before
PIECE = 512
ADDED = ["block", "slot", "release", "deadline", "place"]


def edf_plan(sizes: DataFrame) -> DataFrame:
    """(name, block, slot, release, deadline) of all blocks of sizes (name, n blocks long, w weight long).

    One row holds all sources and slots; its cost is the blocks times the distinct (n, w) and times the sources.
    """
    kinds = sizes.groupBy("n", "w").agg(F.count("*").alias("many")).agg(F.collect_list(F.struct("n", "w", "many")).alias("c"))
    one = sizes.agg(F.sort_array(F.collect_list(F.struct("name", "n", "w"))).alias("s"), F.sum("n").alias("total")).where("total > 0")
    one = one.withColumn("key", F.lit(0)).join(kinds.withColumn("key", F.lit(0)), "key")
    ideal = "aggregate(c, 0L, (a, x) -> a + x.many * least(x.n * o.w, x.w * {}))"
    window = f"named_struct('r', {ideal.format('j')} div o.w, 'd', ({ideal.format('(j + 1)')} + o.w - 1) div o.w)"
    one = one.withColumn("windows", F.expr(f"transform(s, o -> transform(sequence(0L, o.n - 1), j -> {window}))"))
    waiting = "get(windows[i], st.k[i])"
    pick = f"array_min(transform(filter(sequence(0, size(s) - 1), i -> coalesce({waiting}.r <= t, false)), i -> named_struct('d', {waiting}.d, 'i', i))).i"
    step = f"transform(array({pick}), p -> named_struct('k', transform(st.k, (v, i) -> if(i = p, v + 1, v)), 'out', array_append(st.out, named_struct('i', p, 'j', st.k[p]))))[0]"
    none = "cast(array() as array<struct<i:int,j:int>>)"
    piece = f"aggregate(sequence(b * {PIECE}, least((b + 1) * {PIECE}, total) - 1), named_struct('k', so.k, 'out', {none}), (st, t) -> {step})"
    whole = f"transform(array({piece}), q -> named_struct('k', q.k, 'out', array_append(so.out, q.out)))[0]"
    begin = f"named_struct('k', transform(s, o -> 0), 'out', cast(array() as array<array<struct<i:int,j:int>>>))"
    dealt = one.select("s", "windows", F.expr(f"aggregate(sequence(0L, (total - 1) div {PIECE}), {begin}, (so, b) -> {whole}).out").alias("pieces"))
    dealt = dealt.select("s", "windows", F.expr(f"flatten(pieces)").alias("out"))
    rows = dealt.select(F.explode(F.expr("transform(out, (x, t) -> named_struct('name', s[x.i].name, 'block', cast(x.j as long), 'slot', cast(t as long), 'release', windows[x.i][x.j].r, 'deadline', windows[x.i][x.j].d))")).alias("x"))
    return rows.select("x.*")


def whole_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The same proportions in whole numbers; a float counts as the decimal number that it prints as."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    if any(v <= 0 for v in exact.values()):
        raise ValueError("weights are above 0")
    scale = math.lcm(*(v.denominator for v in exact.values()))
    found = {k: int(v * scale) for k, v in exact.items()}
    if sum(found.values()) >= 1 << 31:
        raise ValueError("weights need more than 31 bits as whole numbers")
    return found


def _place_of(docs: DataFrame) -> Column:
    """32 bits by which the rows of a source are ordered: of the MD5 of doc_id, or of all columns of a row without doc_id."""
    whole = F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 32))
    return F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long"), whole)


def pfair_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """docs with block, slot, release, deadline and place (all long); order by slot, then place, to read the mix.

    weights gives sources their weights, above 0; without any, sources weigh the square root of their rows. Sources that
    given weights leave out weigh as much as the least of them. A null source is a source of its own. Slots run from 0
    without gaps, one block each. The rows of a source are ordered by a hash of doc_id, then doc_id, and ranked in as
    many tasks as its size wants; rows that share a doc_id, or that have none and are equal, follow each other in any
    order. Blocks have `block` rows, or more where there would be more than most_blocks. Own columns of the five names
    are replaced, all others pass unchanged. No row is dropped or repeated; no rows give no rows.
    """
    columns = [c for c in docs.columns if c not in ADDED]
    own = docs.select(*columns, F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__name"), _place_of(docs.select(*columns)).alias("__h"))
    sizes = durable(own.groupBy("__name").agg(F.count("*").alias("__n")))  # a row for each source
    rows, sources = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count("*")).first()
    block = max(block, -(-rows // most_blocks))
    weight = F.floor(F.sqrt("__n") * 1000).cast("long")
    if weights:
        whole = whole_weights(weights)
        weight = F.lit(min(whole.values())).cast("long")
        for source, w in whole.items():
            weight = F.when(F.col("__name") == ("" if source is None else f"={source}"), F.lit(w).cast("long")).otherwise(weight)
    plan = edf_plan(sizes.select(F.col("__name").alias("name"), F.ceil(F.col("__n") / block).cast("long").alias("n"), weight.alias("w")))
    plan = plan.select(F.col("name").alias("__name"), F.col("block").alias("__block"), *(F.col(c).alias(f"__{c}") for c in ("slot", "release", "deadline")))

    runs = sizes.select("__name", F.expr(f"1 + __n div {RUN}").alias("__runs"))
    few = sources + rows // block < 1 << 20
    small = F.broadcast if few else (lambda frame: frame)
    own = own.join(small(runs), "__name").withColumn("__run", F.expr("(__h * __runs) div 4294967296")).drop("__runs")
    counted = own.groupBy("__name", "__run").agg(F.count("*").alias("__n"))
    before = counted.select("__name", "__run", (F.sum("__n").over(W.partitionBy("__name").orderBy("__run")) - F.col("__n")).alias("__before"))
    ranked = own.withColumn("__rank", F.row_number().over(W.partitionBy("__name", "__run").orderBy("__h", "doc_id")) - 1)
    dealt = ranked.join(before, ["__name", "__run"]).withColumn("__seq", F.col("__before") + F.col("__rank"))
    dealt = dealt.withColumn("__block", F.expr(f"__seq div {block}")).withColumn("__place", F.expr(f"__seq % {block}"))
    return dealt.join(small(plan), ["__name", "__block"]).select(*columns, *(F.col(f"__{c}").cast("long").alias(c) for c in ADDED))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))


ORACLE = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS name, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents
), src AS (
  SELECT name, floor(sqrt(count(*)) * 1000)::BIGINT AS w, (count(*) + size - 1) // size AS n, size
  FROM docs, (SELECT greatest(50, (count(*) + 262143) // 262144) AS size FROM documents) GROUP BY name, size
), blocks AS (
  SELECT name, block, w FROM (SELECT name, w, unnest(range(n)) AS block FROM src)
), windows AS (
  SELECT b.name, b.block, (sum(least(k.n * b.w, k.w * b.block))::BIGINT // b.w) AS release,
         ((sum(least(k.n * b.w, k.w * (b.block + 1)))::BIGINT + b.w - 1) // b.w) AS deadline
  FROM blocks b, src k GROUP BY b.name, b.block, b.w
), ordered AS (
  SELECT list(struct_pack(r := release, d := deadline, name := name, block := block) ORDER BY deadline, name) AS jobs FROM windows
), edf AS (
  SELECT -1::BIGINT AS t, jobs AS waiting, NULL::STRUCT(r BIGINT, d BIGINT, name VARCHAR, block BIGINT) AS job FROM ordered
  UNION ALL
  SELECT t + 1, list_filter(waiting, lambda x: NOT (x.name = next.name AND x.block = next.block)), next
  FROM (SELECT t, waiting, list_filter(waiting, lambda x: x.r <= t + 1)[1] AS next FROM edf WHERE len(waiting) > 0)
), seqs AS (
  SELECT d.*, row_number() OVER (PARTITION BY d.name ORDER BY h, doc_id) - 1 AS seq, size FROM docs d JOIN src USING (name)
)
SELECT s.doc_id, s.source, (seq // size)::BIGINT AS block, e.t AS slot, e.job.r AS release, e.job.d AS deadline, (seq % size)::BIGINT AS place
FROM seqs s JOIN edf e ON e.job.name = s.name AND e.job.block = seq // size
"""
