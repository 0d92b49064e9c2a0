import random

import numpy as np
import pytest
import xxhash

from fieldtree.llm import simhash_dedup as S
from fieldtree.llm.components import components


def slow_print(text, words):
    found = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(ids, edges):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints(odd_texts):
    for words in (1, 4, 5):
        for t in odd_texts:
            assert S.fingerprint((t or "").encode(), words) == slow_print(t, words)


@pytest.mark.parametrize("bucket_rows", [1 << 14, 8])
def test_links_of_random_balls(spark, bucket_rows):
    draw = random.Random(3)
    prints = {draw.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for centre in list(prints)[:12]:
        for _ in range(draw.choice([3, 60])):
            p = centre
            for b in draw.sample(range(64), draw.randint(1, 6)):
                p ^= 1 << b
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    expected = groups(signed, edges)
    found = S.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, bucket_rows=bucket_rows).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in found)
    assert groups(signed, [(r.a, r.b) for r in found]) == expected


@pytest.mark.parametrize("parts", [1, 2, 3, 4, 5])
def test_every_number_of_parts_finds_all(parts):
    draw = np.random.default_rng(parts)
    values = draw.integers(0, 1 << 63, 200).astype(np.uint64)
    values = np.unique(np.concatenate([values, *(values ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in draw.integers(0, 63, (3, 2)))]))
    dealt = S.correlated_parts(len(values), np.full((64, 64), len(values) / 4), parts)
    assert sorted(b for p in dealt for b in p) == list(range(64))
    near = [S.within(np.bincount(S.part_values(values, p[: S.HISTOGRAM_BITS]), minlength=1 << min(len(p), S.HISTOGRAM_BITS)), S.WIDEST) for p in dealt]
    limit = 3 if parts == 1 else 4
    thresholds, _ = S.Plan(dealt, near, limit).thresholds(values)
    assert (thresholds.sum(axis=0) == limit - parts + 1).all() and thresholds.min() >= -1
    for i, a in enumerate(values):
        apart = np.array([np.bitwise_count(S.part_values(values, p) ^ S.part_values(values[i : i + 1], p)) for p in dealt])
        close = np.bitwise_count(values ^ a) <= limit
        assert ((apart <= thresholds[:, i : i + 1]).any(axis=0) | ~close).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 5), (7, None), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_table(spark, documents, odd_texts):
    rows = S.near_duplicates(documents.withColumnRenamed("n_chars", "fp"), words=4).collect()
    assert len(rows) == documents.count()
    prints = {i: slow_print(t, 4) for i, t in enumerate(odd_texts)}
    expected = groups(list(prints), [(a, b) for a in prints for b in prints if a > b and (prints[a] ^ prints[b]).bit_count() <= 4])
    for r in rows:
        assert r.component_id == expected[4 if r.doc_id is None else r.doc_id]
    kept = S.near_duplicates_removed(documents, words=4)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({expected[i] for i in prints})
    lone = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c d")], "doc_id long, text string")
    assert S.near_duplicates_removed(lone).count() == 3
    assert S.near_duplicates_removed(documents.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    """The copy (4, A) of (2, A) goes and (4, B) stays; two groups with one least id don't mix."""
    rows = [(2, "a b c d e f"), (4, "a b c d e f"), (4, "u v w x y z"), (4, "u v w x y z"), (9, "u v w x y z"), (9, "k l m n o p")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mark string")
    for removed in (S.near_duplicates_removed, S.similar_removed):
        out = removed(df)
        assert out.columns == df.columns
        assert sorted((r.doc_id, r.text[0]) for r in out.collect()) == [(2, "a"), (4, "u"), (9, "k")]


def test_long_texts_in_pieces(monkeypatch, prose):
    from fieldtree.llm import shingle_sets

    texts = [prose(300, 5) + "  \n\t" + prose(50, 6), "a b", " a  b ", "x" * 700, " ".join("abcde"), " " * 90]
    whole = [(S.fingerprint(t.encode(), w), shingle_sets.shingle_set(t.encode(), w).tolist()) for t in texts for w in (1, 4, 5)]
    monkeypatch.setattr(shingle_sets, "PIECE", 16)
    assert whole == [(S.fingerprint(t.encode(), w), shingle_sets.shingle_set(t.encode(), w).tolist()) for t in texts for w in (1, 4, 5)]


def test_estimate_counts_the_bits_beyond_the_histogram():
    """Random values of 24 bits: those within a radius, estimated from 16 bits and the chances of the others."""
    draw = np.random.default_rng(1)
    values = draw.integers(0, 1 << 24, 400_000)
    near = S.unseen(S.within(np.bincount(values & 0xFFFF, minlength=1 << 16), 3), np.full(8, 0.5))
    for r in range(4):
        found = np.mean([(np.bitwise_count(values ^ v) <= r).sum() for v in range(0, 1 << 24, 1 << 18)])
        assert abs(near[r].mean() - found) < 0.2 * found + 0.5
