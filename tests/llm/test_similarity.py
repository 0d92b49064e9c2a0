import random

import pytest

from fieldtree.llm import shingle_sets as J
from fieldtree.llm import simhash_dedup as S


def plain_groups(texts):
    """Group of each text by comparing all pairs; the least index."""
    sets = [set(J.shingle_set((t or "").encode(), 5).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both * 5 >= either * 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


@pytest.fixture(scope="module")
def texts(prose, odd_texts):
    """Near copies of many similarities, chains of them, and a line common to all of some."""
    draw = random.Random(5)
    out = list(odd_texts)
    for k in range(12):
        base = prose(100 + 10 * k, 50 + k).split(" ")
        for edits in (0, 1, 2, 3, 4, 5):
            now = list(base)
            for _ in range(edits):
                now[draw.randrange(len(now))] = f"new{draw.random()}"
            out.append(" ".join(now))
    line = prose(30, 77)
    return out + [f"{line} {prose(12 + k, 500 + k)}" for k in range(25)] + [f"{line} tail{k} word{k}" for k in range(20)]


@pytest.mark.parametrize("small,dense", [(2, 4), (2, -1), (32, 4)])
def test_groups_are_those_of_all_pairs(spark, texts, monkeypatch, small, dense):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "DENSE", dense)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    goal = plain_groups(texts)
    assert len(set(goal)) < len(texts) - 20
    assert {r.doc_id: r.component_id for r in S.similar(df).collect()} == dict(enumerate(goal))


def test_stage_takes_similarity_of_four_fifths(spark, prose):
    """A near copy of 0.83 whose fingerprint is more than 4 bits away goes, and one of less than 0.8 stays."""
    import corpus_pipeline as C
    from fieldtree.llm.simhash_dedup import fingerprint

    base = prose(200, 9).split(" ")
    near, far = list(base), list(base)
    for k in range(4):
        near[20 + 40 * k] = f"near{k}"
    for k in range(9):
        far[10 + 20 * k] = f"far{k}"
    rows = [(k, " ".join(t), "en", "s", 1) for k, t in enumerate((base, near, far))]
    assert (fingerprint(rows[0][1].encode(), 5) ^ fingerprint(rows[1][1].encode(), 5)).bit_count() > 4
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.near_dedup(spark, df, "").collect()) == [0, 2]


def test_odd_rows(spark, documents):
    kept = S.similar_removed(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and None not in ids
    assert S.similar_removed(documents.limit(0)).count() == 0
    lone = documents.filter("doc_id IS NULL")
    assert S.similar_removed(lone).count() == 1


def test_parities_bound_the_difference():
    draw = J.np.random.default_rng(2)
    for n, m in ((5, 7), (60, 70), (60, 300), (1000, 1200), (0, 3)):
        x = J.np.unique(draw.integers(-(1 << 62), 1 << 62, n))
        y = J.np.unique(J.np.concatenate([x[: n // 2], draw.integers(-(1 << 62), 1 << 62, m - n // 2)]))
        assert 0 < J.parities_differ(J.parity(x), J.parity(y)) <= len(J.np.setxor1d(x, y)) and J.parities_differ(J.parity(x), J.parity(x)) == 0


def near_copies(prose, many, seed):
    """Texts of one base with up to seven words changed, left out or put in, the base itself last."""
    draw = random.Random(seed)
    base = prose(90, 900 + seed).split(" ")
    out = []
    for _ in range(many):
        now = list(base)
        for _ in range(draw.choice((1, 1, 2, 2, 3, 4, 5, 7))):
            at = draw.randrange(len(now))
            now[at : at + 1] = draw.choice(([f"new{draw.random()}"], [f"new{draw.random()}"], [], [now[at], f"put{draw.randrange(4)}"]))
        out.append(" ".join(now))
    return [*out, " ".join(base)]


def test_near_copies_in_large_buckets(spark, prose, monkeypatch):
    """Groups are exact where sets of many sizes and places share values."""
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "BLOCK", 4)
    texts = [t for seed in range(3) for t in near_copies(prose, 50, seed)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    goal = plain_groups(texts)
    assert 10 < len(set(goal)) < len(texts) // 2
    assert {r.doc_id: r.component_id for r in S.similar(df).collect()} == dict(enumerate(goal))


def test_near_copies_are_linked_without_blocks(spark, prose, monkeypatch):
    """Of near copies of one text, with a few sets apart, not each is dealt to all blocks of all its buckets."""
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "SAMPLE", 1)
    plain, rows = J.screened, spark.sparkContext.accumulator(0)

    def counted(n, group, bits):
        rows.add(len(n))
        return plain(n, group, bits)

    monkeypatch.setattr(J, "screened", counted)
    base, draw = prose(120, 31).split(" "), random.Random(8)
    texts = []
    for k in range(80):
        now = list(base)
        for _ in range(2 if k % 20 else 6):
            now[draw.randrange(len(now))] = f"new{draw.random()}"
        texts.append(" ".join(now))
    texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in S.similar(df).collect()} == dict(enumerate(plain_groups(texts)))
    assert rows.value < 10 * len(texts), rows.value


def test_rows_of_blocks_grow_with_a_group(spark):
    """A bucket of one large group and a few sets apart: four times the sets, no more than four times the rows."""

    def dealt(many):
        rows = [(1, k, 100, 0, 7 if k % 8 else 5, 0 if k >= 5 else k + 1) for k in range(many)]
        large = spark.createDataFrame(rows, "token long, node long, n long, class int, place long, group long")
        linked = spark.createDataFrame([(r[1], r[5]) for r in rows], "node long, component long")
        return J._dealt(J._open(large.drop("group", "class"), linked)).count()

    few, many = dealt(1024), dealt(4096)
    assert 1024 <= few and many <= 4 * few


def test_of_equal_buckets_the_first_stays(spark):
    """Two values with the same members: pairs are judged by their places, so the bucket of the earlier value is kept."""
    rows = [(token, node, 10, 3 - token) for token in (1, 2) for node in range(40)]
    large = spark.createDataFrame(rows, "token long, node long, n long, place long")
    assert {r.token for r in J._distinct_buckets(large).collect()} == {2}
