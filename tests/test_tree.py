import random

import pytest
from pyspark.sql import functions as F

from fieldtree.operators import grid, tree
from fieldtree.plans.pipeline import merge_tree
from fieldtree.schema import GridSpec
from fieldtree.sources import fields

from sweep import sweep

CASES = {
    "single": ((1, 1, 1), [5], [0], {}),
    "monotone": ((5, 1, 1), [1, 2, 3, 4, 5], [0] * 5, {}),
    "three minima": ((5, 1, 1), [1, 5, 2, 4, 0], [0, 1, 2, 3, 4], {0: 1, 2: 3, 4: 3, 3: 1}),
    "plateau": ((3, 3, 1), [7] * 9, [0] * 9, {}),
    "ties at saddles": ((3, 3, 1), [0, 9, 1, 9, 9, 9, 2, 9, 3], [0, 1, 2, 3, 3, 5, 6, 5, 8], {0: 1, 2: 1, 1: 3, 6: 3, 3: 5, 8: 5}),
    "four-way merge": ((3, 3, 1), [9, 1, 9, 2, 5, 3, 9, 4, 9], [4, 1, 4, 3, 4, 5, 4, 7, 4], {1: 4, 3: 4, 5: 4, 7: 4}),
    "3-D": ((3, 3, 3), [0] + [9] * 12 + [5] + [9] * 12 + [1], [0] * 4 + [4] * 9 + [13] + [4] * 3 + [17] * 9 + [26], {0: 4, 13: 4, 4: 17, 26: 17}),
    "alternating": ((7, 1, 1), [3, 6, 1, 7, 2, 5, 0], [0, 1, 2, 3, 4, 5, 6], {0: 1, 2: 1, 1: 3, 4: 5, 6: 5, 5: 3}),
}


def field_of(spark, values, spec):
    return fields.from_values(spark.createDataFrame(list(enumerate(map(float, values))), "id long, f double"), spec)


def labels(df, n):
    rows = df.collect()
    assert len(rows) == n
    return [a for _, a in sorted((r.id, r.arc) for r in rows)]


@pytest.mark.parametrize("name", CASES)
def test_hand_sized(spark, name):
    dims, values, expected, parents = CASES[name]
    spec = GridSpec(*dims)
    made = merge_tree(field_of(spark, values, spec), spec)
    assert {r.extremum: r.saddle for r in made.arcs.filter("saddle IS NOT NULL").collect()} == parents
    assert labels(made.labels("climb"), spec.n) == expected
    assert labels(made.labels("asof"), spec.n) == expected


@pytest.mark.parametrize("seed,dims,top", [(1, (6, 5, 4), 3), (2, (11, 7, 1), 40), (3, (40, 1, 1), 5), (4, (5, 5, 5), 1)])
def test_random_grids_with_ties(spark, seed, dims, top):
    draw, spec = random.Random(seed), GridSpec(*dims)
    values = [draw.randint(0, top) for _ in range(spec.n)]
    expected, parents = sweep(values, spec)
    field = field_of(spark, values, spec).repartition(draw.randint(1, 7))
    made = merge_tree(field, spec)
    arcs = made.arcs.collect()
    assert {r.extremum: r.saddle for r in arcs if r.saddle is not None} == parents
    assert labels(made.labels("climb"), spec.n) == labels(made.labels("asof"), spec.n) == expected
    assert sum(r.saddle is None for r in arcs) == 1
    assert all(r.is_leaf == (r.extremum not in parents.values()) for r in arcs)
    # The reduction to a spanning forest leaves the tree as it is.
    assert {(r.node, r.saddle) for r in tree.merges(tree.spanning_forest(made.graph)).collect()} == set(parents.items())


def test_blocks_cover_and_invert(spark):
    spec = GridSpec(11, 5, 5)
    field = field_of(spark, range(spec.n), spec)
    for asked in (1, 4, 6, 16, 1000):
        blocks = grid.decompose(spec, asked)
        view = grid.global_id(grid.local_coords(grid.ghosted(field, blocks), blocks), spec)
        row = view.agg(F.count_if(~F.col("is_ghost")).alias("own"), F.count_if(F.col("gid") != F.col("id")).alias("wrong"), F.countDistinct("block").alias("blocks")).first()
        assert (row.own, row.wrong, row.blocks) == (spec.n, 0, blocks.n)
    assert grid.decompose(GridSpec(2, 2, 2), 16).n == 8
    assert grid.prime_factors(360) == [2, 2, 2, 3, 3, 5]


def test_field_checks(spark):
    spec = GridSpec(3)
    rows = lambda *v: spark.createDataFrame(list(v), "id long, f double")
    assert fields.check(fields.from_values(rows((0, 1.0), (1, -0.0), (2, 2.0)), spec), spec).count() == 3
    for bad in ([(0, 1.0), (1, 2.0)], [(0, 1.0), (1, None), (2, 2.0)], [(0, 1.0), (1, float("nan")), (2, 2.0)], [(0, 1.0), (0, 2.0), (2, 2.0)], [(0, 1.0), (1, 2.0), (3, 2.0)]):
        with pytest.raises(fields.FieldError):
            fields.check(fields.from_values(rows(*bad), spec), spec)
    with pytest.raises(fields.FieldError):
        fields.load_field(spark, "some.nrrd")
    with pytest.raises(ValueError):
        GridSpec(0)
