import random

import pytest
from sweep import sweep

from fieldtree.operators import block_tier as B
from fieldtree.operators import halo, ordered
from fieldtree.operators.grid import decompose, ghosted, halved, owned
from fieldtree.operators.halo import tiles
from fieldtree.plans.pipeline import merge_tree
from fieldtree.schema import GridSpec
from fieldtree.sources.fields import from_values
from fieldtree.storage import stored


def made(spark, f, spec):
    return from_values(spark.createDataFrame(list(enumerate(map(float, f))), "id long, f double"), spec)


def results(spark, f, spec, cut):
    trees = B.forest(stored(tiles(made(spark, f, spec), cut), "tiles"), cut)
    dead = B.deaths(trees)
    hops = B.death_hops(dead)
    nodes = B.branch_nodes(trees.basins, dead, hops)
    labels = {r.id: r.arc for r in B.branch_labels(trees.basins, dead, hops, nodes).collect()}
    return labels, {r.node: r.saddle for r in nodes.collect() if r.saddle is not None}, {r.id: r.basin for r in trees.basins.collect()}


@pytest.mark.parametrize("seed,spec,blocks,values", [(1, GridSpec(6, 5, 4), 8, 3), (2, GridSpec(9, 7), 6, 2), (3, GridSpec(40), 7, 5), (4, GridSpec(5, 5, 5), 27, 100), (5, GridSpec(11, 8, 3), 1, 4), (6, GridSpec(16, 16), 16, 1000), (7, GridSpec(4, 4, 4), 64, 2)])
def test_blocks_agree_with_the_sweep(spark, seed, spec, blocks, values):
    draw = random.Random(seed)
    f = [draw.randrange(values) for _ in range(spec.n)]
    labels, parent = sweep(f, spec)
    cut = halved(spec, max(8, -(-spec.n // blocks))) if seed % 2 else decompose(spec, blocks)
    got, up, basin = results(spark, f, spec, cut)
    assert got == dict(enumerate(labels)) and up == parent
    assert all(basin[v] == basin[p] for v, p in steepest(f, spec).items())


def steepest(f, spec):
    """Each vertex's least neighbour, or itself."""
    out = {}
    for v in range(spec.n):
        x, y, z = v % spec.X, v // spec.X % spec.Y, v // (spec.X * spec.Y)
        near = [v + s * d for d, c, e in zip(spec.strides, (x, y, z), (spec.X, spec.Y, spec.Z)) for s in (-1, 1) if 0 <= c + s < e]
        out[v] = min([v, *near], key=lambda i: (f[i], i))
    return out


@pytest.mark.parametrize("most", [1000, 1 << 17])
def test_halved_blocks_over_many_extents(most):
    """No block above its bound, no axis more than twice another (to a cell), and boxes that cover the grid once."""
    draw = random.Random(most)
    extents = [(1009, 1000, 1000), (1013, 1000, 1000), (1000,) * 3, (1, 1, 10**9), (7, 10**6, 1), (64, 64, 64)] + [tuple(draw.choice([1, draw.randint(1, 50), draw.randint(1, 3000)]) for _ in range(3)) for _ in range(200)]
    for e in extents:
        cut = halved(GridSpec(*e), most)
        assert cut.n == 1 << len(cut.cuts) and cut.size[0] * cut.size[1] * cut.size[2] <= most
        for axis in range(3):
            for other in range(3):
                assert cut.size[axis] <= 2 * cut.size[other] + 2 or e[other] == cut.size[other]
        for block in {0, cut.n - 1, *(draw.randrange(cut.n) for _ in range(20))}:
            lo, hi = cut.corners(block)
            assert cut.number(cut.place(block)) == block and all(0 < h - l <= s for l, h, s in zip(lo, hi, cut.size))
            for axis in range(3):
                near = cut.beside(block, axis, 1)
                assert hi[axis] == e[axis] if near is None else cut.corners(near)[0][axis] == hi[axis]


@pytest.mark.parametrize("cut", [halved(GridSpec(11, 7, 5), 30), decompose(GridSpec(11, 7, 5), 12), halved(GridSpec(40), 8)])
def test_halo(spark, cut):
    """Blocks by columns and by numbers agree, faces hold what lies beside, and only they are sent."""
    spec = cut.spec
    f = [(7 * i) % 23 - 4.5 for i in range(spec.n)]
    field = made(spark, f, spec)
    owner = {r.id: r.block for r in field.withColumn("block", cut.index(*(halo.F.col(c) for c in "xyz"))).collect()}
    for i, block in owner.items():
        lo, hi = cut.corners(block)
        assert all(a <= c < b for a, b, c in zip(lo, hi, (i % spec.X, i // spec.X % spec.Y, i // (spec.X * spec.Y))))
    whole = stored(tiles(field, cut), "tiles")
    assert sorted((r.id, r.f) for r in halo.untiled(whole, cut).collect()) == list(enumerate(f))
    view = {(r.block, r.id) for r in ghosted(field, cut).filter("is_ghost").collect()}
    sent = halo.faces(whole, cut).collect()
    # Ghost cells that a block meets by a side, without those over edges and corners.
    by_side = {(owner[n], i) for i in range(spec.n) for d, c, e in zip(spec.strides, (i % spec.X, i // spec.X % spec.Y, i // (spec.X * spec.Y)), (spec.X, spec.Y, spec.Z)) for s in (-1, 1) if 0 <= c + s < e and owner[n := i + s * d] != owner[i]}
    assert sum(len(r.f) // 4 for r in sent) == len(by_side) and by_side <= view
    beside = halo.beside_rows(spark.range(spec.n), cut)
    assert {(r.block, r.id) for r in beside.collect()} == by_side
    low = {(owner[v], v) for v, p in steepest(f, spec).items() if v == p}
    assert {(r.block, r.id) for r in halo.local_minima(whole, cut).collect()} == low
    box = {(r.block, r.id) for r in owned(ghosted(field, cut)).collect()}
    assert box == {(b, i) for i, b in owner.items()}


def test_a_block_that_lacks_a_cell(spark):
    spec = GridSpec(4, 4)
    with pytest.raises(Exception, match="has 7 of 8 cells"):
        tiles(made(spark, range(16), spec).filter("id <> 5"), halved(spec, 8)).collect()


def test_merge_region_against_one_region():
    """Random graphs cut in two: what the halves settle and what is left give the deaths of the whole."""
    import numpy as np

    draw = np.random.default_rng(1)
    for _ in range(200):
        n, m = int(draw.integers(4, 12)), int(draw.integers(3, 30))
        a, b = draw.integers(0, n, m), draw.integers(0, n, m)
        a, b = a[a != b], b[a != b]
        heights, f = draw.integers(0, 4, n).astype(np.float32), draw.integers(5, 9, len(a)).astype(np.float32)
        s = 100 + draw.permutation(len(a))
        whole, none = B.merge_region(a, b, heights[a], heights[b], f, s, np.array([], int))
        assert not none
        half = draw.random(len(a)) < 0.5
        both = np.intersect1d(np.r_[a[half], b[half]], np.r_[a[~half], b[~half]])
        settled, left = [], []
        for side in (half, ~half):
            dead, kept = B.merge_region(a[side], b[side], heights[a[side]], heights[b[side]], f[side], s[side], both)
            settled += dead
            left += kept
        x, y, fx, fy, level, saddle = (np.array(c) for c in zip(*left)) if left else [np.array([], int)] * 6
        settled += B.merge_region(x, y, fx, fy, level, saddle, np.array([], int))[0]
        key = lambda rows: sorted((u, s) for u, _, _, _, s in rows)
        assert key(settled) == key(whole)


def test_merge_tree_takes_any_number_of_blocks(spark):
    spec = GridSpec(12, 10, 6)
    draw = random.Random(9)
    field = made(spark, [draw.randrange(30) for _ in range(spec.n)], spec)
    goal = merge_tree(field, spec, tier="global")
    nodes, labels = sorted(map(tuple, goal.nodes.select("node", "f", "saddle", "fs", "is_leaf").collect()), key=str), sorted(map(tuple, goal.labels("climb").collect()))
    for blocks in (1, 5, 12):
        tree = merge_tree(field, spec, blocks=blocks)
        assert sorted(map(tuple, tree.nodes.select("node", "f", "saddle", "fs", "is_leaf").collect()), key=str) == nodes
        assert all(sorted(map(tuple, tree.labels(mode).collect())) == labels for mode in ("branch", "climb", "asof"))


def test_regions_in_ranges(spark):
    """Ranges of about twenty edges, over two levels of regions, give the nodes and labels of one ordered task."""
    spec = GridSpec(9, 8, 3)
    draw = random.Random(3)
    field = made(spark, [draw.randrange(6) for _ in range(spec.n)], spec)
    labels, parent = sweep([r.f for r in field.orderBy("id").collect()], spec)
    tree = merge_tree(field, spec, blocks=12, region_edges=20)
    assert {r.node: r.saddle for r in tree.nodes.collect() if r.saddle is not None} == parent
    assert [r.arc for r in tree.labels().orderBy("id").collect()] == labels


@pytest.mark.parametrize("few", [40, 1 << 20])
def test_ranges_join_by_themselves(spark, few):
    """Random graphs: deaths and edges of the ranges are those of one task over all edges, open basins and ties included."""
    import numpy as np

    draw = np.random.default_rng(2)
    rows, still, want = [], [], {}
    for at in range(6):
        n, m = int(draw.integers(5, 30)), int(draw.integers(10, 60))
        a, b = draw.integers(0, n, m), draw.integers(0, n, m)
        a, b = a[a != b], b[a != b]
        heights, f = draw.integers(0, 4, n).astype(np.float32), draw.integers(5, 9, len(a)).astype(np.float32)
        s, open_ = 100 + draw.permutation(len(a)), draw.choice(n, n // 3, replace=False)
        dead, kept = B.merge_region(a, b, heights[a], heights[b], f, s, open_)
        want[at] = sorted((u, sad) for u, _, _, _, sad in dead), sorted((x, y, sad) for x, y, *_, sad in kept)
        rows += [(at, at, *map(int, r[:2]), *map(float, r[2:5]), int(r[5])) for r in zip(a, b, heights[a], heights[b], f, s)]
        still += [(at, int(o)) for o in open_]
    schema = "at int, block int, a long, b long, fa float, fb float, f float, s long"
    cut = B.ranged(spark.createDataFrame(rows, schema), spark.createDataFrame(still, "at int, a long"), 24, few)
    got = {at: ([], []) for at in want}
    for r in cut.groupBy("at", "seg").applyInArrow(B._range_tree, B._REGION).collect():
        got[r.block][r.kind // 2].append((r.a, r.b, r.s) if r.kind == 0 else (r.a, r.s))
    assert cut.groupBy("at", "seg").count().count() > 15
    assert {at: (sorted(dead), sorted(kept)) for at, (kept, dead) in got.items()} == want


@pytest.mark.parametrize("few", [0, 20, 1000])
def test_components(spark, few):
    from fieldtree.operators.fixpoint import components

    draw = random.Random(8)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 130)] + [(k, k + 1) for k in range(200, 240)] + [(300, 300)]
    up = {v: v for pair in links for v in pair}

    def find(v):
        return v if up[v] == v else find(up[v])

    for a, b in links:
        up[find(a)] = find(b)
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long"), few).collect()}
    assert set(got) == set(up) - {300} - {a for a, b in links if a == b and not any(a in p for p in links if p != (a, b))}
    assert all((got[v] == got[w]) == (find(v) == find(w)) for v in got for w in got)
    assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_orders(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(3), float(draw.randrange(6)), i, draw.random() < 0.2) for i in range(300)] + [(7, 1.0, 900, False), (8, 1.0, 901, True)]
    df = spark.createDataFrame(rows, "grp long, f double, id long, is_node boolean")
    for down in (False, True):
        sign = -1 if down else 1
        place = {r[2]: (sign * r[1], sign * r[2]) for r in rows}
        for r in ordered.before(df, down).collect():
            ahead = [(place[i], i) for g, _, i, n in rows if n and g == r.grp and place[i] < place[r.id]]
            assert r.prev == (max(ahead)[1] if ahead else None)
    assert {r.id: r["rank"] for r in ordered.ranked(df).collect()} == {i: k + 1 for k, (_, i) in enumerate(sorted((f, i) for _, f, i, _ in rows))}
    assert ordered.before(df.limit(0)).count() == ordered.ranked(df.limit(0)).count() == 0


def test_arrow_functions_in_a_fresh_process():
    """A worker that has run nothing else gets a table from a stream: modules must import all that they use."""
    import subprocess
    import sys

    code = """
import io, pyarrow as pa
from fieldtree.operators.block_tier import _region_tree, _REGION
kinds = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32()}
schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _REGION.split(", ")])
rows = [(0, 1, 2, 0.0, 1.0, 2.0, 9, 4), (1, 1, None, None, None, None, None, None)]
table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
out = io.BytesIO()
with pa.ipc.new_stream(out, schema) as writer:
    writer.write_table(table)
read = pa.ipc.open_stream(out.getvalue()).read_all()
made = _region_tree((pa.scalar(0),), read)
assert made.column("kind").to_pylist() == [2] and made.column("a").to_pylist() == [2], made
"""
    subprocess.run([sys.executable, "-c", code], check=True)
