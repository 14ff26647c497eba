"""Secrets in documents (op4), with DataFrame functions only.

Fixed patterns find the base spans. Beyond them, candidate strings (runs of 20 and more token characters with letters
and digits) are searched by a window of 20 characters that slides over each: its character counts, and the sum of c * log2(c) over them, are
kept up to date by the character that comes in and the one that goes out, which gives the Shannon entropy of each window.
The threshold depends on the candidate's character class, and an allow-list suppresses well-known harmless shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns that the results are defined by.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

KINDS = ["assign", "access", "hex", "entropy"]
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
PIECE = 256
#: Bits a character that a window must reach, by the class of the candidate.
BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",  # dates and times
    r"^[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]*[0-9]{0,4}$",  # words, a counter behind them at most
    r"(?i)example|placeholder|xxxx|0000000|1234567",
]


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, found>>: all matches, from what lies between them; code points, end exclusive.

    Matches are placed by PIECE of them at a time, so the list isn't copied whole for each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["between"])
        end = start + F.length(pair["found"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["found"].alias("found"))).alias("out"))

    def piece(acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(pairs, k * PIECE + 1, F.lit(PIECE)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(own), lambda q: F.struct(q["at"].alias("at"), F.array_append(acc["out"], q["out"]).alias("out")))[0]

    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("between"), found.alias("found"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,end:int,found:string>>>").alias("out"))
    pieces = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PIECE).cast("int"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(pieces, begin, piece)["out"])).otherwise(none)


def _value(found: Column) -> Column:
    """The secret itself of an assignment."""
    return F.regexp_extract(found, ASSIGN, 2)


def _entropy(candidate: str, window: int) -> str:
    """SQL for the largest window entropy of the string column or variable named candidate."""
    table = "array(" + ",".join("0D" if c < 2 else f"{c}D * log2({c}D)" for c in range(window + 1)) + ")"
    letters = f"array_distinct(split({candidate}, ''))"
    codes = f"transform(split({candidate}, ''), ch -> cast(array_position({letters}, ch) as int) - 1)"
    grown = "(acc.s + x.f[acc.n[x.codes[i]] + 1] - x.f[acc.n[x.codes[i]]])"
    out = f"x.codes[greatest(i - {window}, 0)]"
    slid = f"(case when i < {window} then {grown} when x.codes[i] = {out} then acc.s else {grown} + x.f[acc.n[{out}] - 1] - x.f[acc.n[{out}]] end)"
    counts = f"transform(acc.n, (m, k) -> m + if(k = x.codes[i], 1, 0) - if(i >= {window} and k = {out}, 1, 0))"
    begin = "named_struct('n', transform(x.letters, ch -> 0), 's', 0D, 'least', cast(null as double))"
    step = f"named_struct('n', {counts}, 's', {slid}, 'least', if(i < {window - 1}, cast(null as double), least(acc.least, {slid})))"
    fold = f"aggregate(sequence(0, size(x.codes) - 1), {begin}, (acc, i) -> {step}).least"
    bound = f"array(named_struct('letters', {letters}, 'codes', {codes}, 'f', {table}))"
    return f"(log2({window}D) - round(transform({bound}, x -> {fold})[0], 9) / {window})"


def secret_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with spans: array<struct<start, kind, end, found>> by start, then kind (an index into KINDS).

    Base kinds are found leftmost and without overlaps, each for itself, and matches that are too short are dropped.
    An entropy span is a whole candidate that a window of it marks and no base span overlaps. A null text has no
    spans. Other columns pass unchanged; one named spans is replaced. Repeated rows are scanned one by one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = [
        F.filter(_spans(text, ASSIGN, 0), lambda x: F.length(_value(x["found"])) >= LEAST["assign"]),
        F.filter(_spans(text, ACCESS, 1), lambda x: F.length(x["found"]) >= LEAST["access"]),
        # a run is matched whole, so runs that are long enough can be asked for at once
        _spans(text, f"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}", 2),
    ]
    allowed = " or ".join("c.found rlike " + _quoted(p) for p in ALLOWED)
    bits = f"case when c.found rlike '^[0-9a-fA-F]+$' then {BITS['hex']}D when c.found rlike '[+/=]' then {BITS['base64']}D else {BITS['alnum']}D end"
    marked = f"c.found rlike '[0-9]' and c.found rlike '[A-Za-z]' and not ({allowed}) and not exists(base__, b -> b.start < c.end and c.start < b.end) and {_entropy('c.found', window)} >= {bits}"
    return (
        docs.withColumn("base__", F.concat(*base))
        .withColumn("candidates__", _spans(text, CANDIDATE, 3))
        .withColumn("spans", F.expr(f"array_sort(concat(base__, filter(candidates__, c -> {marked})))"))
        .drop("base__", "candidates__")
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of its texts replaced by mark, overlapping spans by one; n_chars, if there, follows.

    All other columns pass unchanged, one named spans too. A null text stays null.
    """
    if "spans" in docs.columns:
        return redact(docs.withColumnRenamed("spans", "spans__own"), mark).withColumnRenamed("spans__own", "spans")
    begin = "named_struct('at', 0, 'out', '')"
    step = f"named_struct('at', greatest(acc.at, x.end), 'out', if(x.start < acc.at, acc.out, concat(acc.out, substring(text, acc.at + 1, x.start - acc.at), {_quoted(mark)})))"
    fold = f"aggregate(spans, {begin}, (acc, x) -> {step}, acc -> concat(acc.out, substring(text, acc.at + 1, length(text))))"
    out = secret_spans(docs).withColumn("text", F.expr(f"if(size(spans) > 0, {fold}, text)"))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = "element_at(array(" + ",".join(f"'{k}'" for k in KINDS) + "), {0}.kind + 1)"
    told = lambda which: F.expr(f"array_join(transform({which}, x -> concat({names.format('x')}, ':', x.start, ':', x.end)), ',')")
    count = lambda kind: F.expr(f"cast(size(filter(spans, x -> x.kind = {kind})) as bigint)")
    return spans.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told("filter(spans, x -> x.kind < 3)"), 256).alias("base_sha256"), told("spans").alias("spans"))


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    candidate = CANDIDATE.split(")", 1)[1]  # runs are matched whole, with or without a look behind
    patterns = [ASSIGN, ACCESS, f"[0-9a-f]{{{LEAST['hex']},}}", candidate]
    parts = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind, regexp_extract_all(t, {quoted(p)}) AS f, string_split_regex(t, {quoted(p)}) AS p FROM d WHERE regexp_matches(t, {quoted(p)})" for k, p in enumerate(patterns))
    allowed = " OR ".join(f"regexp_matches(found, {quoted(p)})" for p in ALLOWED)
    span = f"[{', '.join(repr(k) for k in KINDS)}][kind + 1] || ':' || a || ':' || e"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), m AS ({parts}), sp AS (
  SELECT doc_id, kind, found, a, a + length(found) AS e FROM (
    SELECT doc_id, kind, f[i] AS found, (list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0))::BIGINT AS a
    FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m))
), base AS (
  SELECT * FROM sp WHERE (kind = 0 AND length(regexp_extract(found, {quoted(ASSIGN)}, 2)) >= {LEAST["assign"]}) OR (kind = 1 AND length(found) >= {LEAST["access"]}) OR kind = 2
), cand AS (
  SELECT * FROM sp c WHERE kind = 3 AND regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]') AND NOT ({allowed})
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.a < c.e AND c.a < b.e)
), ch AS (
  SELECT doc_id, a, e, found, w, substr(found, w + k, 1) AS x FROM (SELECT *, unnest(range(1, length(found) - {WINDOW - 2})) AS w FROM cand), range(0, {WINDOW}) t(k)
), cnt AS (
  SELECT doc_id, a, e, found, w, x, count(*) AS n FROM ch GROUP BY ALL
), ent AS (
  SELECT doc_id, a, e, found, w, sum(n * log2(n)) AS s FROM cnt GROUP BY doc_id, a, e, found, w
), best AS (
  SELECT doc_id, a, e, found, log2({WINDOW}) - round(min(s), 9) / {WINDOW} AS h FROM ent GROUP BY doc_id, a, e, found
), every AS (
  SELECT doc_id, kind, a, e FROM base
  UNION ALL SELECT doc_id, 3, a, e FROM best WHERE h >= CASE WHEN regexp_full_match(found, '[0-9a-fA-F]+') THEN {BITS["hex"]} WHEN regexp_matches(found, '[+/=]') THEN {BITS["base64"]} ELSE {BITS["alnum"]} END
), told AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg({span}, ',' ORDER BY a, kind) FILTER (kind < 3) AS b, string_agg({span}, ',' ORDER BY a, kind) AS spans
  FROM every GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""


ORACLE = _oracle()
