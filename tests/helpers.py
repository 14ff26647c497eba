import math


def frame(spark, rows, key="id", kind="float"):
    return spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], f"{key} long, vector array<{kind}>")


def triples(result):
    return [(r.query_id, r["rank"], r.id) for r in sorted(result.collect(), key=lambda r: (r.query_id, r["rank"]))]


def plain_topk(corpus, queries, k, objective):
    def value(c, q):
        return -math.fsum((x - y) ** 2 for x, y in zip(c, q, strict=True)) + 0.0 if objective == "squared_l2" else math.fsum(x * y for x, y in zip(c, q, strict=True)) + 0.0

    out = []
    for n, q in enumerate(queries):
        best = sorted(((-value(c, q), i) for i, c in enumerate(corpus)))[:k]
        out += [(n, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out
