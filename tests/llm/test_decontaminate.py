import re

import pytest

from nearfield.llm import decontaminate as M


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(texts, items):
    pats = [(i, tuple(w[k : k + min(13, len(w))])) for i, t in items for w in [words(t)] if w for k in range(len(w) - min(13, len(w)) + 1)]
    out = []
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for i, p in pats:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= {i} if i is not None else set()
        out.append((d, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [1 << 29, 40_000])  # bytes in compiled form: one block of items, and several
def test_against_plain_version(spark, make_docs, corpus, limit):
    items = [(1, corpus[0]), (2, corpus[2][:200]), (20, "Mixed case"), (3, "ONE"), (4, ""), (5, None), (None, corpus[6]), (6, corpus[0]), (7, " ".join(corpus[16].split()[500:540])), (8, "the of"), (8, "aaa bbb ccc"), (9, "日本 кот3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [*corpus, "x one y", "Aaa! bbb (CCC)", "the of", "a b " * 300 + corpus[0]]
    got = sorted(map(tuple, M.decontaminate(make_docs(texts), bench, broadcast_bytes=limit).collect()))
    assert got == plain(texts, items)


def test_no_rows_and_no_items(spark, make_docs, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert M.decontaminate(make_docs([]), none).collect() == []
    assert all(r.n_hit == 0 and not r.contaminated for r in M.decontaminate(make_docs(corpus), none).collect())


def test_large_benchmarks_still_let_the_search_jump():
    """Of a megabyte of items most blocks of other text shift by nearly the whole window, and the tables stay within their bound."""
    import random

    import numpy as np

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(140))) for k in range(1000)] + [(1000 + k, "same words " * 20) for k in range(3)]
    (patterns,) = M.compile_items(items)
    size = patterns.shift.nbytes + patterns.keys.nbytes + patterns.order.nbytes + patterns.begin.nbytes + patterns.end.nbytes + patterns.items.nbytes + patterns.first_item.nbytes + len(patterns.raw)
    assert size < 140_060 * M.WORD_BYTES
    text = " ".join(word() for _ in range(50_000)) + " " + items[77][1] + " x same words" + " same words" * 10
    data = np.frombuffer(text.encode(), np.uint8)
    words = M.Words(data, np.array([0, len(data)]), M.ALPHANUMERIC)
    h = words.hashes()
    assert patterns.shift[M.block_keys(h, 2, patterns.bits)[:49_000]].mean() > 10
    found = list(patterns.find(words, h))
    assert len({f for f, _ in found}) == 128 + 10
    assert {tuple(patterns.items[patterns.first_item[k] : patterns.first_item[k + 1]]) for f, k in found if f > 50_140} == {(1000, 1001, 1002)}
