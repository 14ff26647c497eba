import zlib

import numpy as np

from nearfield.llm import quality as M


def test_held_out_rows_are_ranked(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = M.op9_quality(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    good, bad = ([r.score for r in rows if r.held_out and truth.get(r.doc_id) == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_edges(spark, make_docs):
    docs = make_docs(["good words here", "BAD!! BAD!! BAD!!", None, "", "good words " * 20_000, "good words here"], [1, 2, 3, 4, None, 1])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, 1, 0), (None, 1, 0), (9, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    weights = M.train(docs, labels, epochs=50)
    got = M.score(docs, weights).collect()
    assert len(got) == 6 and all(0 < r.score < 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1] > 0.5 > by_id[2]
    assert not M.train(docs, labels.limit(0)).any() and M.score(docs.limit(0), weights).collect() == []


def test_features_of_rows_do_not_mix():
    texts = [b"One two  two", b"", b"*** 12", b"x"]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    slots, first = M.features(np.frombuffer(b"".join(texts), np.uint8), offs)
    for k, t in enumerate(texts):
        alone, _ = M.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert sorted(alone) == sorted(slots[first[k] : first[k + 1]])


def plain_features(text):
    """Slots by a loop over words; only the hash of a word is the module's own."""
    import re

    from nearfield.llm.wordscan import U64, Words, mix, window_hashes

    def code(data):
        return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.ones(256, bool)).hashes()[0]

    low = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    h = [code(low(w)) for w in words]
    s = []
    for w in words:
        kinds = [1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else c for c in w]
        s.append(code(bytes(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])))
    one = lambda x, salt: mix(np.array([x], U64) + U64(salt))[0]
    two = lambda x, y, salt: window_hashes(np.array([x, y], U64), 2, salt)[0]
    out = [one(x, 1) for x in h] + [one(x, 3) for x in s]
    for i in range(len(words) - 1):
        out += [two(h[i], h[i + 1], 2), two(s[i], s[i + 1], 4), one(int(h[i] == h[i + 1]), 5)]
    return sorted(int(x) >> (64 - M.SLOT_BITS) for x in out)


def test_features_training_and_scores_against_plain_version(spark, make_docs):
    import math
    import random

    rng = random.Random(8)
    texts = [" ".join(rng.choice("Good words Here BAD!! x1 ö 12%".split()) for _ in range(rng.randrange(0, 30))) for _ in range(24)]
    for t in texts:
        slots, _ = M.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert sorted(slots.tolist()) == plain_features(t)
    docs = make_docs(texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    weights = M.train(docs, labels, epochs=2)
    order = [r.doc_id for r in labels.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").collect()]
    z, n, f = {}, {}, M.Ftrl()

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= f.l1 else -(zi - math.copysign(f.l1, zi)) / ((f.beta + math.sqrt(ni)) / f.alpha + f.l2)

    for _ in range(2):
        for k in order:
            own = plain_features(texts[k])
            x = {i: M.SCALE * own.count(i) / len(own) for i in own} | {1 << M.SLOT_BITS: 1.0}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weight(i) * v for i, v in x.items())))))
            for i, v in x.items():
                g, w = (p - k % 2) * v, weight(i)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / f.alpha * w
                n[i] = n.get(i, 0.0) + g * g
    assert all(abs(weights[i] - weight(i)) < 1e-5 for i in z) and np.count_nonzero(weights) <= len(z)
    for r in M.score(docs, weights).collect():
        own = plain_features(texts[r.doc_id])
        want = float(weights[-1]) + M.SCALE * sum(float(weights[i]) for i in own) / max(len(own), 1)
        assert abs(r.score - 1 / (1 + math.exp(-want))) < 1e-9


def test_equal_texts_have_equal_scores_and_both_labels_count_as_good(spark, make_docs):
    docs = make_docs([f"{'filler ' * (k % 9)}" if k % 2 else "the same text, whatever is beside it" for k in range(60)]).repartition(3)
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, None)], "doc_id long, quality int")
    scores = M.score(docs, M.train(docs, labels, epochs=9)).where("doc_id % 2 = 0").collect()
    assert len({r.score for r in scores}) == 1 and scores[0].score > 0.5
