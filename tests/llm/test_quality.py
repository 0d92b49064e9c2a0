import os
import zlib

import numpy as np
import pytest

from fieldtree.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"


def test_features_stay_within_documents():
    texts = [b"one two two", b"", b" \n", b"xy  one", b"one two two"]
    found, owners = Q.features(texts)
    alone = [sorted(Q.features([t])[0].tolist()) for t in texts]
    assert [sorted(found[owners == k].tolist()) for k in range(5)] == alone
    assert alone[1] == alone[2] == []


def slow_features(text):
    """One at a time, from the definition, as a count per bucket."""
    mask, words, out = (1 << 64) - 1, text.decode().split(), []
    spread = lambda key: ((key & mask) * 0x9E3779B97F4A7C15 & mask) >> 40

    def code(word):
        return sum((ord(c) + 1) * pow(0xC2B2AE3D27D4EB4F, i % 256 + 1, 1 << 64) for i, c in enumerate(word)) & mask

    for word in words:
        out.append(spread(code(word)) % Q.BUCKETS)
        for n in Q.GRAMS:
            padded = f" {word} "
            for at in range(len(padded) - n + 1):
                key = n
                for c in padded[at : at + n]:
                    key = ((key << 16) * 0x9E3779B1 & mask) ^ ord(c)
                out.append(spread(key) % Q.BUCKETS)
    return sorted(out + [spread(code(a) * 31 + code(b)) % Q.BUCKETS for a, b in zip(words, words[1:])])


@pytest.mark.parametrize("text", ["", "a", "one two two", "naïve 漢字 \U0001f600x  end", "abc\tdef\nabc def"])
def test_features_by_definition(text):
    assert sorted(Q.features([text.encode()])[0].tolist()) == slow_features(text.encode())


def test_gradient_of_a_step():
    """One step of training changes vectors and layer by the slope of the loss, by finite differences."""
    draw = np.random.default_rng(1)
    vectors, layer, bias, shares, label = draw.normal(size=(4, Q.DIM)), draw.normal(size=(Q.DIM, 2)), draw.normal(size=2), np.array([0.4, 0.3, 0.2, 0.1]), 1

    def loss(v, w, b):
        z = shares @ v @ w + b
        return np.log(np.exp(z).sum()) - z[label]

    mean, off, back = Q.step(shares, vectors, layer, bias, label)
    slopes = {"vectors": -shares[:, None] * back, "layer": -np.outer(mean, off), "bias": -off}
    held = {"vectors": vectors, "layer": layer, "bias": bias}
    for name, slope in slopes.items():
        for at in np.ndindex(slope.shape):
            ends = []
            for sign in (1, -1):
                moved = {k: x.copy() for k, x in held.items()}
                moved[name][at] += sign * 1e-5
                ends.append(loss(*moved.values()))
            assert abs((ends[0] - ends[1]) / 2e-5 - slope[at]) < 1e-6


def test_score_is_that_of_the_unfolded_network():
    """Mean vector, layer and softmax written out, over features made one at a time."""
    texts = [f"fine words here {i} calm".encode() for i in range(20)] + [f"BUY!! NOW!! {i}!!".encode() for i in range(20)]
    network = Q.network(texts, [1] * 20 + [0] * 20)
    vectors, layer, bias = network
    model = Q.Model(*Q.folded(*network))
    for text in (b"calm words", b"NOW!! here", b"", " é漢 words ".encode() * 9):
        found = slow_features(text)
        z = (np.mean(vectors[found], axis=0) if found else np.zeros(Q.DIM)) @ layer + bias
        p = np.exp(z - z.max())
        assert abs(model.score([text])[0] - (p / p.sum())[1]) < 1e-5


def test_long_texts_in_pieces(monkeypatch):
    draw = np.random.default_rng(3)
    model = Q.Model(draw.normal(size=Q.BUCKETS).astype(np.float32), 0.1)
    texts = [" ".join(str(x) * (x % 5) for x in draw.integers(0, 999, 500)).encode(), b"", b"  ", "é漢x ".encode() * 300, b"a b"]
    whole = model.score(texts)
    found = [sorted(Q.features([t])[0].tolist()) for t in texts]
    monkeypatch.setattr(Q, "CHUNK_BYTES", 64)
    assert np.abs(model.score(texts) - whole).max() < 1e-9
    for t, f in zip(texts, found):
        assert sorted(np.concatenate([np.zeros(0, int), *(Q.features([p], [n])[0] for p, n in Q.pieces(t))]).tolist()) == f
    assert 0 <= model.score([b"\xe9" * 1000 + "漢".encode() * 1000])[0] <= 1


def test_learns_and_scores_in_range():
    good, bad = [f"fine words here {i} calm".encode() for i in range(60)], [f"BUY!! NOW!! {i}!!".encode() for i in range(60)]
    model = Q.train(good + bad, [1] * 60 + [0] * 60)
    scores = model.score([b"calm words here", b"BUY!! 999!!", b"", b"\xff\xfe"])
    assert scores[0] > 0.9 > 0.1 > scores[1] and ((scores >= 0) & (scores <= 1)).all()
    assert (Q.train([], []).score([b"a"]) == 0.5).all()
    assert (Q.train(good + bad, [1] * 60 + [0] * 60).weights == model.weights).all()


def test_table(spark, documents):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(11)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = Q.quality_scores(documents, labels).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert Q.quality_scores(documents, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert Q.quality_scores(documents.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    one, two = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert (one[:, None] > two[None]).mean() >= 0.95
    assert (one >= 0.3).mean() >= 0.99 and (two < 0.3).mean() >= 0.8
