import zlib

from nearfield.llm import language_id as M


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = M.op2_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_backoff_and_edges(spark):
    texts = [("the cat and the dog are here and there", "en"), ("der Hund und die Katze sind hier und da", "de")] * 6 + [("no label", None), (None, "en")]
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    model = M.train(docs)
    ask = spark.createDataFrame([(1, "thereand", 7.0), (2, "hundkatz", 7.0), (3, None, 7.0), (4, " 12 !?", 7.0), (5, "UND DIE", 7.0), (5, "UND DIE", 7.0), (None, "the dog " * 5000, 7.0)], "doc_id long, text string, score double")
    got = M.identify(ask, model).collect()
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und", "de", "de", "en"]
    assert M.identify(ask, model).columns == ["doc_id", "text", "lang_pred", "score"] and got[2].score == 0
    assert M.identify(ask.limit(0), model).collect() == []


def test_nothing_learned(spark, make_docs):
    model = M.train(make_docs([]))
    assert [r.lang_pred for r in M.identify(make_docs(["words"]), model).collect()] == ["und"]


def plain(train, ask, min_count=5):
    """Scores by dictionaries and loops; only the slots of n-grams are the module's own."""
    import math
    from collections import Counter, defaultdict

    import numpy as np

    def slot(gram):
        data = np.frombuffer(gram.encode(), np.uint8)
        return int(M.grams(M.letters_of(data, np.array([0, len(data)])), np.ones(1, bool), len(gram))[0][0])

    def words(text):
        out, run = [], ""
        for c in (text or "") + " ":
            if c.isalpha():
                run += c.lower() if len(c.lower()) == 1 else c
            elif run:
                out.append(run)
                run = ""
        return out

    langs = sorted({lang for _, lang in train})
    seen = {n: defaultdict(Counter) for n in range(5)}
    for text, lang in train:
        for w in words(text):
            seen[0][w][lang] += 1
            for n in M.ORDERS:
                for k in range(len(w) - n + 1):
                    seen[n][slot(w[k : k + n])][lang] += 1
    size = {0: len(seen[0]), **M.SLOTS}
    total = {n: {x: sum(c[x] for c in seen[n].values()) + 0.5 * size[n] + 1 for x in langs} for n in seen}
    log = lambda n, key, x: math.log((seen[n][key][x] + 0.5) / total[n][x])
    out = []
    for text in ask:
        own = words(text)
        sums = dict.fromkeys(langs, 0.0)
        for w in own:
            if sum(seen[0].get(w, {}).values()) >= min_count:
                found, n = [w], 0
            else:
                found = []
                for n in M.ORDERS:
                    found = [s for s in (slot(w[k : k + n]) for k in range(len(w) - n + 1)) if sum(seen[n].get(s, {}).values()) > 1]
                    if found:
                        break
            for x in langs:
                sums[x] += sum(log(n, s, x) for s in found) / len(found) if found else 0.0
        best = max(langs, key=lambda x: (sums[x], [-ord(c) for c in x])) if own else "und"
        out.append((best, 1 / sum(math.exp(sums[x] - sums[best]) for x in langs) if own else 0.0))
    return out


def test_against_plain_version(spark, make_docs):
    import random

    rng = random.Random(3)
    parts = {"en": "the of and ing tion er", "de": "der die und ung ß ü heit", "xx": "кот 日本 Ñu Éa İx"}
    text = lambda x, n: " ".join("".join(rng.choice(parts[x].split()) for _ in range(rng.randrange(1, 4))).title() for _ in range(n))
    train = [(text(x, rng.randrange(1, 40)), x) for x in parts for _ in range(12)]
    docs = spark.createDataFrame([(None if k % 5 == 0 else k, t, x) for k, (t, x) in enumerate(train)], "doc_id long, text string, lang string")
    ask = [text(rng.choice(list(parts)), rng.randrange(0, 30)) for _ in range(40)] + [None, "", "zzz qqq", "12 +"]
    got = M.identify(make_docs(ask), M.train(docs.repartition(3))).orderBy("doc_id").collect()
    for r, (best, score) in zip(got, plain(train, ask), strict=True):
        assert r.lang_pred == best and abs(r.score - score) < 1e-9


def test_equal_texts_have_equal_scores_and_samples_are_bounded(spark, make_docs):
    texts = ["the cat and dogs", "x y z", "der hund"] * 30
    docs = make_docs(texts, [None] * 90).drop("lang").withColumn("lang", __import__("pyspark").sql.functions.expr("if(text like 'der%', 'de', 'en')"))
    model = M.train(docs, per_lang=7)
    assert M.sample(docs, 7).groupBy("lang").count().collect() and all(r["count"] == 7 for r in M.sample(docs, 7).groupBy("lang").count().collect())
    got = M.identify(make_docs([" ".join(texts[: k % 7 + 1]) + "!" for k in range(70)]).repartition(5), model).collect()
    assert len({(r.text, r.score) for r in got}) == len({r.text for r in got}) == 7
    tied = M.train(spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string"), min_count=1)
    assert [r.lang_pred for r in M.identify(make_docs(["same words"]), tied).collect()] == ["a"]


def test_many_languages(spark, make_docs):
    rows = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in "abcde"), f"l{k:03d}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = M.identify(docs, M.train(docs, min_count=1)).collect()
    assert all(r.lang_pred == r.lang for r in got)
