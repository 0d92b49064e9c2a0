import random

import pytest

from fieldtree.operators import fixpoint


def random_tree(seed, n, chain):
    """Parents of nodes 0 to n - 1, with two roots; ``chain``: how often a node hangs below the one before."""
    draw = random.Random(seed)
    p = {0: None, 1: None} | {k: k - 1 if draw.random() < chain else draw.randrange(k) for k in range(2, n)}
    names = draw.sample(range(10 * n), n)
    return {names[k]: None if v is None else names[v] for k, v in p.items()}


@pytest.mark.parametrize("seed,n,chain", [(1, 60, 0.3), (2, 200, 0.97), (3, 2, 0)])
def test_against_walks(spark, seed, n, chain):
    p = random_tree(seed, n, chain)
    draw = random.Random(seed)
    value = {v: draw.choice([None, draw.randrange(9)]) for v in p}
    above = {v: [v] for v in p}
    for v in p:
        while (up := p[above[v][-1]]) is not None:
            above[v].append(up)
    df = spark.createDataFrame([(v, u, value[v], value[v], "x") for v, u in p.items()], "id long, p long, total long, low long, up string").repartition(3)
    got = {r.id: (r.total, r.low) for r in fixpoint.subtrees(df.drop("up"), totals=("total",), least=("low",)).collect()}
    for v in p:
        under = [value[u] for u in p if v in above[u] and value[u] is not None]
        assert got[v] == ((sum(under), min(under)) if under else (None, None))
    told = fixpoint.intervals(df)
    rows = {r.id: r for r in told.collect()}
    assert all(rows[v].depth == len(above[v]) - 1 and rows[v].size == sum(v in above[u] for u in p) for v in p)
    pairs = [(draw.choice(list(p)), draw.choice(list(p))) for _ in range(300)] + [(a, v) for v in p for a in above[v][:3]] + [(-1, 0), (next(iter(p)), None)]
    made = fixpoint.related(spark.createDataFrame(pairs, "upper long, lower long"), told).collect()
    assert len(made) == len(pairs)
    assert all(r.is_above == (None if r.upper not in p or r.lower not in p else r.upper in above[r.lower]) for r in made)


def test_cycles_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "MOST_ROUNDS", 4)
    with pytest.raises(RuntimeError):
        fixpoint.intervals(spark.createDataFrame([(1, 2), (2, 1)], "id long, p long"))
    assert fixpoint.intervals(spark.createDataFrame([], "id long, p long")).count() == 0
