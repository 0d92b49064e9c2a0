import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fieldtree.llm import suffix_dedup as S


def brute(texts):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in datas for i in range(len(d) - 199))
    out = []
    for d in datas:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), kept))
    return out


def test_suffix_arrays():
    draw = np.random.default_rng(0)
    for _ in range(10):
        data = draw.integers(97, 99, draw.integers(1, 300)).astype(np.uint8)
        data = np.concatenate([data, data[:90], data])
        raw, order = data.tobytes(), S.suffix_array(data)
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))
        shared = S.common_prefixes(data, order, np.array([0, len(data) // 3]), np.array([len(data) // 3, len(data) - len(data) // 3]))
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] :][:200], raw[order[k] :][:200]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_equal_strings_have_equal_anchors():
    draw = random.Random(2)
    texts = [bytes(draw.choice(b"ab") for _ in range(900)) * 2 for _ in range(3)] + [b"c" * 700, b"x" * 199, b""]
    number, anchor, start, count = S.anchors(texts)
    names = {}
    covered = Counter()
    for k, a, s, n in zip(number.tolist(), anchor.tolist(), start.tolist(), count.tolist()):
        for i in range(s, s + n):
            covered[k, i] += 1
            assert names.setdefault(texts[k][i : i + 200], a) == a
    assert covered == Counter({(k, i): 1 for k, t in enumerate(texts) for i in range(len(t) - 199)})


@pytest.fixture(scope="module")
def corpus(prose):
    passage, base = prose(80, 5), prose(300, 6)
    texts = [None, "", "x" * 199, "x" * 199, "y" * 200, "y" * 201, prose(30_000, 8)]
    for i in range(90):
        draw, t = random.Random(i), prose(random.Random(i).randint(0, 300), 1000 + i)
        if i % 5 == 0:
            t = t[:150] + passage + t[150:]
        elif i % 5 == 1:
            t = passage[: draw.randint(150, 260)] + t
        elif i % 5 == 2:
            w = base.split(" ")
            w[draw.randrange(len(w))] = f"edit{i}"
            t = " ".join(w)
        elif i % 5 == 3:
            t = t + t
        texts.append(t)
    return texts + [texts[7], texts[20], texts[20]]


@pytest.mark.parametrize("sizes", [{}, {"block_runs": 5, "shard_bytes": 3000}])
def test_against_brute_force(spark, corpus, sizes):
    rows = [(None if i % 13 == 0 else i % 50, t) for i, t in enumerate(corpus)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, digest string, key int").repartition(5)
    got = Counter(tuple(r) for r in S.repeat_report(df, **sizes).collect())
    assert got == Counter((i, n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(rows, brute(corpus)))
    cut = S.cut_repeats(df, **sizes)
    assert cut.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in cut.collect()) == Counter((i, k.decode("utf-8", "ignore")) for (i, _), (_, _, _, k) in zip(rows, brute(corpus)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeat_report(df).count() == S.cut_repeats(df).count() == 0
