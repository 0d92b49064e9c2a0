import numpy as np
import pytest

from fieldtree.llm import hnsw_index as H

SCHEMA = "vec_id long, embedding array<float>, rank int, score double, shard int"


def exact(rows, queries, k):
    """Of ids with one vector each."""
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault(i, np.array(v, np.float32).astype(np.float64))
    out = {}
    for q in queries:
        if q in usable:
            near = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q)
            out[q] = near[:k]
    return out


def search(spark, rows, k=10, **options):
    df = spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in rows], SCHEMA)
    got = {}
    for r in H.search_index(H.build_index(df, k=k, **options), df.filter("vec_id % 100 = 0"), k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return got


def test_odd_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(40)]
    same = rows[5][1]
    rows += [(100 + i, same) for i in range(30)]  # ties: the smallest ids win
    rows += [(200, None), (300, [0.0] * 8), (400, [float("nan")] + [1.0] * 7), (500, [None] + [1.0] * 7), (600, [float("inf")] + [1.0] * 7), (None, same), (700, []), (0, rows[0][1])]
    got = search(spark, rows)
    expected = exact(rows, [0, 100, 200, 300, 400, 500, 600, 700], 10)
    assert set(got) == set(expected) == {0, 100}
    for q, near in expected.items():
        assert [(s, i) for _, s, i in got[q]] == near
        assert [r for r, _, _ in got[q]] == list(range(1, 11))


def test_few_and_none(spark):
    assert search(spark, []) == {}
    assert search(spark, [(100, [1.0, 2.0])]) == {}
    assert search(spark, [(100, [1.0, 2.0]), (3, [1.0, 3.0])]) == {100: [(1, 1.0, 3)]}


@pytest.mark.parametrize("shard_entries", [100_000, 700])
def test_recall(spark, shard_entries):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + draw.normal(size=32) * 0.7).astype(np.float32).tolist()) for i in range(3000)]
    got, expected = search(spark, rows, shard_entries=shard_entries), exact(rows, range(0, 3000, 100), 10)
    assert set(got) == set(expected)
    hits = [len({i for _, _, i in got[q]} & {i for _, i in near}) / 10 for q, near in expected.items()]
    assert np.mean(hits) >= 0.9
    known = {q: {i: s for s, i in exact(rows, [q], 3000)[q]} for q in list(expected)[:3]}
    assert all(s == known[q][i] for q in known for _, s, i in got[q])


def test_flat_form_is_the_graph():
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(500, 16))
    graph = H.Graph(vectors, np.minimum(draw.geometric(15 / 16, 500) - 1, 6))
    graph.build()
    again = H.Graph.from_flat(vectors, graph.flat())
    assert (again.search(vectors[:20], 10) == graph.search(vectors[:20], 10)).all()
    assert (graph.near[0] < 500).all() and ((graph.near[0] >= 0).sum(axis=1) > 0).all()


@pytest.mark.parametrize("offset,size", [(0.0, 1.0), (10_000.0, 1.0), (0.0, 1e25), (0.0, 1e-30), (1e20, 1e15)])
def test_recall_far_from_the_origin(offset, size):
    draw = np.random.default_rng(4)
    vectors = (offset + draw.normal(size=(4000, 32)) * size).astype(np.float64)
    graph = H.Graph(vectors, np.minimum(draw.geometric(15 / 16, 4000) - 1, 6))
    graph.build()
    found = graph.search(vectors[:50], 11)
    hits = [len(set(np.argsort(H.euclid(vectors - vectors[q]))[:11]) & set(sorted(found[q][found[q] >= 0].tolist(), key=lambda e: H.euclid(vectors[[e]] - vectors[q])[0])[:11])) for q in range(50)]
    assert np.mean(hits) / 11 >= 0.95


def test_recall_beside_a_huge_vector():
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(2000, 16))
    vectors[7] = 1e25
    graph = H.Graph(vectors, np.minimum(draw.geometric(15 / 16, 2000) - 1, 6))
    graph.build()
    assert graph.kind is np.float64
    found = graph.search(vectors[100:140], 10)
    hits = [len(set(np.argsort(H.euclid(vectors - vectors[100 + q]))[:10]) & set(found[q].tolist())) for q in range(40)]
    assert np.mean(hits) >= 9.5


def test_euclid_keeps_to_the_range_of_doubles():
    assert H.euclid(np.array([[3e200, 4e200]]))[0] == pytest.approx(5e200)
    assert H.euclid(np.array([[3e-200, 4e-200], [0.0, 0.0]])).tolist() == pytest.approx([5e-200, 0.0])
    assert H.euclid(np.array([[3.0, 4.0]]))[0] == 5.0


def test_ids_with_several_vectors(spark):
    """As far as the nearest of its vectors, once in a result; asked for, by any of them."""
    draw = np.random.default_rng(6)
    rows = [(i % 60 if i % 60 else 100, draw.normal(size=4).astype(np.float32).tolist()) for i in range(200)]
    got = search(spark, rows, shard_entries=80)
    of = {}
    for i, v in rows:
        of.setdefault(i, []).append(np.array(v, np.float64))
    near = sorted((min(np.sqrt(((a - b) ** 2).sum()) for a in of[100] for b in vs), i) for i, vs in of.items() if i != 100)[:10]
    assert [(s, i) for _, s, i in got[100]] == near and list(got) == [100]


def test_many_shards_in_a_task(spark, monkeypatch):
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    got = search(spark, rows, shard_entries=10)
    for q, near in exact(rows, range(0, 900, 100), 10).items():
        assert [(s, i) for _, s, i in got[q]] == near
