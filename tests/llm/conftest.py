import random

import pytest

WORDS = "the of and a to in is it on by alpha beta gamma delta über naïve кот 日本 x1 y2 z3 foo,bar don't E=mc2".split()


@pytest.fixture
def make_docs(spark):
    """A documents frame of texts, with ids from 0 and a column whose name clashes with nothing that operators add."""

    def make(texts, ids=None, **more):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), "extra") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make


@pytest.fixture
def corpus():
    """Texts with copies, near copies, shared passages, an empty, a blank, a null and a long one."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    shared = text(30)
    base = text(80)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (10, 40, 70)]
    out = [text(50), shared, base, *near, text(20) + " " + shared + "\n" + text(15), base, base, text(12), text(13), "", " \t\n ", None, "one", "Mixed CASE Words", text(3000), shared + "  " + shared]
    return out + [text(rng.randrange(1, 60)) for _ in range(20)]
