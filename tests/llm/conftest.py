import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    draw = random.Random(11)
    return ["".join(draw.choice("abcdefgh é漢") for _ in range(draw.randint(2, 8))).strip() or "x" for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    def make(n, seed):
        draw = random.Random(seed)
        return " ".join(draw.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_texts(prose):
    """Null, empty, white space, one character, repeats, near copies and a very long text."""
    base = prose(120, 1)
    near = base.split(" ")
    near[60] = "changed"
    return [None, "", " \n\t ", "a", base, base, " ".join(near), base.upper(), prose(4000, 2), "z" * 5000, "\x00▁  \U0001f600"]


@pytest.fixture()
def documents(spark, odd_texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(odd_texts)]
    rows += [(None, odd_texts[4], None, None, None), (4, odd_texts[4], "en", "s0", 1)]
    return spark.createDataFrame(rows, DOCS)
