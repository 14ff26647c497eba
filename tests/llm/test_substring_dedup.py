import hashlib
import random
import re

import pytest

from nearfield.llm import substring_dedup as M
from nearfield.llm.registry import ORACLES, QUERIES


def plain(texts, ids, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for i, w in zip(ids, words, strict=True):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_copied", [1_000_000, 0])
def test_against_plain_version(make_docs, corpus, most_copied):
    ids = [3 * k % 101 for k in range(len(corpus))]
    ids[5] = ids[4]  # two texts of one doc_id
    ids[7] = None
    got = M.substring_dedup(make_docs(corpus, ids), filter_bits=1 << 12, most_copied=most_copied).collect()
    assert sorted(map(tuple, got), key=str) == plain(corpus, ids)


def test_filter_that_is_full_changes_nothing(make_docs, corpus):
    got = M.substring_dedup(make_docs(corpus), filter_bits=64).collect()
    assert sorted(map(tuple, got), key=str) == plain(corpus, list(range(len(corpus))))


def test_other_windows(make_docs, corpus):
    for window in (2, 5):
        got = M.substring_dedup(make_docs(corpus), window=window).collect()
        assert sorted(map(tuple, got), key=str) == plain(corpus, list(range(len(corpus))), window)


def test_no_rows(make_docs):
    assert M.substring_dedup(make_docs([])).collect() == []


def test_query_columns(spark, sf_dir):
    out = QUERIES["op1_substring_dedup"](spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    rows = out.collect()
    assert any(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.n_words == r.n_removed)
    assert "op1_substring_dedup" in ORACLES


def test_chunks_of_fewer_words_than_a_window(make_docs):
    got = M.substring_dedup(make_docs(["one two three four five"])).collect()
    assert [tuple(r) for r in got] == [(0, 5, 0, "one two three four five")]
    texts = ["a short text of six words", " ".join(f"word{k}" for k in range(260_000))]
    assert len(texts[1]) > 2_000_000
    got = M.substring_dedup(make_docs(texts).coalesce(1)).collect()
    assert sorted(map(tuple, got)) == [(0, 6, 0, texts[0]), (1, 260_000, 0, texts[1])]


def thue_morse(k, a, b):
    out = a
    for _ in range(k):
        out += out.translate(str.maketrans(a + b, b + a))
    return out


def test_words_that_collide_in_polynomials_are_told_apart(make_docs):
    """Of 1,024 letters and more, such a word and its complement have one polynomial hash modulo 2**64 in any odd base."""
    odd, even = thue_morse(11, "a", "b"), thue_morse(11, "b", "a")
    shared = " ".join(f"w{k}" for k in range(12))
    texts = [f"{shared} {odd}", f"{shared} {even}", f"{shared} {odd}"]
    assert [tuple(r) for r in M.substring_dedup(make_docs(texts)).orderBy("doc_id").collect()] == plain(texts, [0, 1, 2])
    order = [f"{x} {y}" for x, y in ((odd, even), (even, odd))]
    texts = [" ".join(w for w in t.split() for _ in range(7)) for t in order]
    assert sorted(map(tuple, M.substring_dedup(make_docs(texts)).collect())) == plain(texts, [0, 1])


@pytest.mark.parametrize("window", [13, 50])
@pytest.mark.parametrize("filter_bits, hot_rows", [(1 << 30, 1 << 14), (0, 1 << 14), (1 << 30, 2), (0, 2)])
def test_ladder_of_several_levels(make_docs, window, filter_bits, hot_rows):
    """Passages of many lengths around the levels', shared by some and by very many documents."""
    assert M.ladder(13) == [4, 8, 13] and M.ladder(50) == [4, 8, 16, 32, 50] and M.ladder(2) == [2] and M.ladder(50, 1) == [1, 2, 4, 8, 16, 32, 50]
    rng = random.Random(window)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(n) for n in (3, 4, 5, 8, 12, 13, 14, 16, 31, 33, 49, 50, 51, 90)]
    texts = [" ".join(sum((fresh(rng.randrange(20)) + p for p in rng.sample(passages, 4)), fresh(5))) for _ in range(25)]
    texts += [" ".join(fresh(8) + passages[-1] + passages[5]) for _ in range(12)] + ["", None, " ".join(passages[-1])]
    ids = rng.sample(range(1000), len(texts))
    ids[3] = ids[20] = None
    got = M.substring_dedup(make_docs(texts, ids), window=window, filter_bits=filter_bits, hot_rows=hot_rows).collect()
    assert sorted(map(tuple, got), key=str) == plain(texts, ids, window)


def test_no_candidates_end_the_ladder(make_docs):
    texts = [" ".join(f"w{k}x{j}" for j in range(100)) for k in range(4)]
    assert [r.n_removed for r in M.substring_dedup(make_docs(texts), window=50).collect()] == [0] * 4
