import random
import re

import numpy as np
import xxhash

from nearfield.llm import simhash as M
from nearfield.llm.components import components


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hashed = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_groups(prints, radius=4):
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius and group[j] > group[i]:
                    group[j], changed = group[i], True
    return group


def test_against_plain_version(make_docs, corpus):
    ids = [(7 * k) % 211 for k in range(len(corpus))]
    got = {r.doc_id: r for r in M.simhash_groups(make_docs(corpus, ids)).collect()}
    prints = [plain_print(t) for t in corpus]
    group = plain_groups(prints)
    for k, i in enumerate(ids):
        assert got[i].fp & (1 << 64) - 1 == prints[k]
        assert got[i].component_id == min(ids[j] for j in range(len(ids)) if group[j] == group[k])


def test_null_and_repeated_ids(make_docs):
    got = M.simhash_groups(make_docs(["", None, " ", "a b c", "a b c"], [5, None, 3, 9, 9])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("3", 3), ("5", 3), ("9", 9), ("9", 9), ("None", 3)]
    assert M.simhash_groups(make_docs([])).collect() == []


def test_forest_finds_what_brute_force_finds():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base for _ in range(5)]
    fp = np.array(sorted(set(prints)), np.uint64)
    a, b = M.shard_links(np.zeros(len(fp), np.int64), fp)
    label = list(range(len(fp)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[x] = y
    assert label == plain_groups(fp.tolist())


def test_trees_follow_insertion():
    fp = np.array([0, 1, 3, 7, 2, 4], np.uint64)
    parent, key = M.bk_forest(np.zeros(6, np.int64), fp)
    assert parent.tolist() == [-1, 0, 0, 0, 1, 4] and key.tolist() == [0, 1, 2, 3, 2, 2]


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and got[1001] == 1000


def test_components_of_few_links_take_no_rounds(spark):
    rng = np.random.default_rng(8)
    pairs = [*rng.integers(-(1 << 40), 1 << 40, 60)[rng.integers(0, 60, (70, 2))].tolist(), [None, 5], [5, 5]]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    tracker, group = spark.sparkContext.statusTracker(), "few links"
    spark.sparkContext.setJobGroup(group, group)
    got = components(links)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rounds", "rounds")
    rounds = components(links, few=0)
    assert jobs * 2 < len(tracker.getJobIdsForGroup("rounds"))
    told = lambda frame: sorted((r.node, r.root) for r in frame.collect())
    assert told(got) == told(rounds) != []
    assert told(components(links.where("a is null"))) == []


def test_wider_radius_and_second_fingerprints_against_plain_version(make_docs, corpus):
    import itertools

    rng = random.Random(6)
    base = [corpus[16].split()[k * 150 : k * 150 + 150] for k in range(12)]
    texts = [" ".join("new" + str(rng.random()) if rng.random() < share else w for w in b) for b in base for share in (0, 0.01, 0.02, 0.03, 0.04)] + ["", None]
    for radius, confirm in ((6, None), (6, 16), (8, 12)):
        two = [M.fingerprint((t or "").lower().encode(), 5, True) for t in texts]
        group = list(range(len(texts)))
        for _ in texts:
            for i, j in itertools.combinations(range(len(texts)), 2):
                if (two[i][0] ^ two[j][0]).bit_count() <= radius and (confirm is None or (two[i][1] ^ two[j][1]).bit_count() <= confirm):
                    group[i] = group[j] = min(group[i], group[j])
        got = {r.doc_id: r.component_id for r in M.simhash_groups(make_docs(texts), 5, radius, confirm).collect()}
        assert [got[k] for k in range(len(texts))] == group
    assert len(set(group)) < len(texts) - 20 and two[0][0] != two[0][1]
    assert M.blocks_of(6) == [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)] and sum(n for _, n in M.blocks_of(10)) == 64


def test_large_groups_of_copies(make_docs, corpus):
    texts = [corpus[2]] * 300 + [corpus[3], ""] * 40 + corpus[16].split()[:200]
    got = {r.doc_id: r.component_id for r in M.simhash_groups(make_docs(texts)).collect()}
    assert len(got) == len(texts) and {got[k] for k in range(300)} == {0} and got[301] == got[379] == 301
