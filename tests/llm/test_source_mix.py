import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from nearfield.llm import source_mix as M


def frame(spark, sizes):
    rows = [(k * 100_000 + i, name) for k, (name, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string")


def plan(spark, sizes):
    return sorted(map(tuple, M.edf_plan(spark.createDataFrame(sizes, "name string, n long, w long")).collect()), key=lambda r: r[2])


def plain(sizes):
    """Earliest deadline first, from the definition: the ideal mix is followed source by source in exact fractions."""
    ideal = lambda v: sum(min(Fraction(n), w * v) for _, n, w in sizes)
    todo = [(math.ceil(ideal(Fraction(j + 1, w))), name, j, math.floor(ideal(Fraction(j, w)))) for name, n, w in sizes for j in range(n)]
    out = []
    for slot in range(len(todo)):
        job = min(x for x in todo if x[3] <= slot)
        todo.remove(job)
        out.append((job[1], job[2], slot, job[3], job[0]))
    return out


@pytest.mark.parametrize("sizes", [[("a", 30, 7), ("b", 9, 2), ("c", 5, 1)], [("a", 1, 1), ("b", 40, 1), ("c", 3, 900), ("d", 11, 13), ("e", 11, 13)], [("x", 1, 5)], [("a", 60, 9999), ("b", 3, 1)]])
def test_plan_against_plain_version(spark, sizes):
    got = plan(spark, sizes)
    assert got == plain(sizes)
    assert all(release <= slot < deadline for _, _, slot, release, deadline in got)


@pytest.mark.parametrize("weights", [{"a": 7, "b": 2, "c": 1}, {"a": 99_999, "b": 1}, {"a": 34_981, "b": 19}, {"a": 0.7, "b": 0.2, "c": 0.1}])
def test_deviation_from_the_asked_weights_is_below_one_block(spark, weights):
    """Over all slots until the first source runs out, and over several pieces of the plan."""
    slots, whole = 3000, M.whole_weights(weights)
    total = sum(whole.values())
    sizes = [(s, slots * w // total + 1, w) for s, w in whole.items()]
    seen = dict.fromkeys(whole, 0)
    for name, block, slot, release, deadline in plan(spark, sizes)[:slots]:
        assert release <= slot < deadline and block == seen[name]
        seen[name] += 1
        assert all(abs(seen[x] * total - w * (slot + 1)) < total for x, w in whole.items())


def test_slots_are_dense_when_sources_run_out(spark):
    """What a source that has run out would have had goes to the others, and no slot stays empty."""
    docs = frame(spark, {"a": 400, "b": 90, None: 33, "c": 1})
    out = M.pfair_mix(docs, {"a": 5, "b": 2, None: 2, "c": 1}, block=4).collect()
    assert sorted((r.doc_id, str(r.source)) for r in out) == sorted((r.doc_id, str(r.source)) for r in docs.collect())
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert {r.slot for r in out} == set(range(100 + 23 + 9 + 1)) and len({(r.slot, r.place) for r in out}) == len(out)
    assert len({(r.slot, r.source) for r in out}) == 133


def test_the_mix_holds_the_given_weights(spark):
    docs = frame(spark, {"a": 2100, "b": 600, "c": 300})
    out = M.pfair_mix(docs, {"a": 7, "b": 2, "c": 1}, block=1).collect()
    order, seen = {r.slot: r.source for r in out}, Counter()
    for slot in range(3000):
        seen[order[slot]] += 1
        assert all(abs(seen[s] * 10 - w * (slot + 1)) < 10 for s, w in {"a": 7, "b": 2, "c": 1}.items())


def test_one_order_however_many_runs_rank_it(spark, monkeypatch):
    docs = frame(spark, {"a": 700, "b": 50})
    sets = []
    for run in (1 << 16, 50):
        monkeypatch.setattr(M, "RUN", run)
        sets.append(sorted((r.doc_id, r.slot, r.place) for r in M.pfair_mix(docs, block=10).collect()))
    assert sets[0] == sets[1]


def test_ids_that_are_multiples_of_a_power_of_two_spread(spark):
    docs = spark.range(4000).select((F.col("id") * 2**32).alias("doc_id"), F.lit("a").alias("source"))
    counts = docs.select((M._place_of(docs) / 2**28).cast("int").alias("x")).groupBy("x").count().collect()
    assert len(counts) == 16 and max(r["count"] for r in counts) < 400


def test_blocks_grow_when_there_are_many(spark):
    out = M.pfair_mix(frame(spark, {"a": 900, "b": 100}), {"a": 9, "b": 1}, block=1, most_blocks=100).collect()
    assert Counter(r.slot for r in out) == dict.fromkeys(range(100), 10)


def test_ties_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "a"), (-5, None), (2**62, "a")], "doc_id long, source string")
    out = M.pfair_mix(docs, block=2).collect()
    assert len(out) == 6 and len({(r.slot, r.place) for r in out}) == 6
    assert M.pfair_mix(docs.limit(0)).collect() == []


def test_clashing_names_pass_unchanged(spark):
    names = "name salt seq j r at d units turn u k t x s c n w before key".split()
    docs = spark.createDataFrame([(k, "a", *[f"mine{k}"] * len(names), -1) for k in range(3)], "doc_id long, source string, " + ", ".join(f"{x} string" for x in names) + ", slot int")
    out = M.pfair_mix(docs).collect()
    assert M.pfair_mix(docs).columns == ["doc_id", "source", *names, *M.ADDED]
    assert all(r[x] == f"mine{r.doc_id}" for r in out for x in names) and {r.slot for r in out} == {0}


def test_many_sources(spark):
    docs = frame(spark, {f"s{k}": 1 for k in range(1050)})
    out = M.pfair_mix(docs).collect()
    assert {r.slot for r in out} == set(range(1050))


def test_weights_that_can_not_be(spark):
    for bad in ({"a": 0}, {"a": -1.5}, {"a": 1, "b": 1e-12}):
        with pytest.raises(ValueError):
            M.whole_weights(bad)
