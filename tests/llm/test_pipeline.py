import corpus_pipeline as P


def test_stages_keep_columns_and_act(spark, make_docs, corpus, tmp_path):
    docs = make_docs([*corpus, "token = abcdef123456 and more words", "123 456", None])
    bench = spark.createDataFrame([(1, corpus[9])], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "simhash_dedup", "decontaminate", "secret_scan", "source_mix"]
    before = docs
    for name, stage in P.STAGES:
        after = stage(spark, before, str(tmp_path))
        rows = after.collect()
        if name != "source_mix":
            assert after.columns == docs.columns
        texts = [r.text for r in rows]
        if name == "language_id":
            assert len(rows) == before.count() - 5  # nulls, blanks and digits alone
        if name == "simhash_dedup":
            assert texts.count(corpus[2]) == 1
        if name == "decontaminate":
            assert corpus[9] not in texts
        if name == "secret_scan":
            assert "[secret] and more words" in texts
        before = spark.createDataFrame(rows, after.schema)
    assert len({(r.slot, r.place) for r in rows}) == len(rows)


def test_repeated_rows_and_rows_without_id(make_docs):
    docs = make_docs(["a b c d e", "a b c d e", "a b c d e", "q r s t u v"], [1, 1, None, 7])
    got = P.near_duplicate_stage(docs.sparkSession, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "7", "None"]


def test_contaminated_rows_without_id_go_and_texts_of_one_id_are_judged_apart(spark, make_docs, corpus, tmp_path):
    spark.createDataFrame([(1, corpus[9])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs([corpus[9], corpus[0], corpus[9], corpus[10]], [None, None, 4, 4])
    got = P.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == sorted([corpus[0], corpus[10]])


def test_two_texts_of_one_id_both_stay(make_docs, corpus):
    docs = make_docs([corpus[0], corpus[10], corpus[10], corpus[10]], [1, 1, 1, 9])
    got = P.near_duplicate_stage(docs.sparkSession, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, corpus[0]), (1, corpus[10])])


def test_language_stage_judges_by_score_and_keeps_letters_without_languages(spark, make_docs):
    from pyspark.sql import functions as F

    docs = make_docs(["plain words", "123 456", None, "кот"]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.text for r in P.language_stage(spark, docs, "").collect()) == ["plain words", "кот"]
    texts = ["the cat and the dog", "der hund und die katze"] * 30 + ["日本"]
    langs = spark.createDataFrame([(k, ("en", "de")[k % 2] if k < 60 else None) for k in range(61)], "doc_id long, lang string")
    docs = make_docs(texts).drop("lang").join(langs, "doc_id")
    got = P.language_stage(spark, docs, "").collect()
    assert got and list(got[0].asDict()) == docs.columns and {r.score for r in got} == {"extra"}
    assert sorted(r.text for r in got) == sorted(texts[:60])  # nothing speaks for either language in the last
