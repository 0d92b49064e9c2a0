from pyspark.sql import functions as F

from fieldtree.functions.order import byte_string
from fieldtree.operators import critical, fixpoint, sets, trunk
from fieldtree.schema import GridSpec
from fieldtree.sources import fields


def grid_field(spark, values, *dims):
    spec = GridSpec(*dims)
    return fields.from_values(spark.createDataFrame(list(enumerate(map(float, values))), "id long, f double"), spec), spec


def test_boundary_algebra(spark):
    field, spec = grid_field(spark, [0, 5, 1, 6, 2], 5)
    members = spark.createDataFrame([(0, 0), (2, 2), (4, 4)], "comp long, id long")
    edge = sets.boundary(field, spec, members)
    of = lambda c: edge.filter(F.col("comp") == c)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(of(0)) == [1] and ids(of(2)) == [1, 3]
    assert ids(sets.unite(of(0), of(2))) == [1, 3]
    common, one, two = sets.intersect(of(0), of(2))
    assert (ids(common), ids(one), ids(two)) == ([1], [], [3])
    assert {(r.comp, r.id) for r in sets.boundary_min(edge).collect()} == {(0, 1), (2, 1), (4, 3)}
    assert {(r.id, r.a, r.b) for r in sets.shared_vertices(edge).collect()} == {(1, 0, 2), (3, 2, 4)}
    assert ids(sets.remove(edge, edge.filter("id = 1"))) == [3, 3]
    assert sets.add(edge, edge).count() == edge.count()


def test_saddles_and_answers(spark):
    field, spec = grid_field(spark, [0, 5, 1, 6, 2], 5)
    members = spark.createDataFrame([(0, 0), (2, 2)], "comp long, id long")
    assert {(r.comp, r.saddle) for r in critical.ending_saddle(field, spec, members).collect()} == {(0, 1), (2, 1)}
    component = spark.createDataFrame([(0, 0), (2, 2), (4, 4)], "id long, comp long")
    assert {(r.id, r.n) for r in critical.saddle_components(field, spec, component).collect()} == {(1, 2), (3, 2)}
    answers = spark.createDataFrame([(1, "a", 1, 7), (1, "a", 3, 8), (1, "b", 2, 9)], "arc long, location string, counter int, v int")
    assert {(r.location, r.v) for r in sets.latest_answers(answers).collect()} == {("a", 8), ("b", 9)}
    arcs = spark.createDataFrame([(1, 2, True)], "extremum long, saddle long, is_leaf boolean")
    more = spark.createDataFrame([(1, True), (5, False)], "extremum long, is_leaf boolean")
    assert {(r.extremum, r.saddle, r.is_leaf) for r in sets.fetch_or_create(arcs, more).collect()} == {(1, 2, True), (5, None, False)}


def test_pointers_and_chains(spark):
    n = 100
    chain = spark.createDataFrame([(i, max(0, i - 1)) for i in range(n)], "id long, p long")
    assert {r.root for r in fixpoint.pointer_jump(chain).collect()} == {0}
    up = spark.createDataFrame([(i, i + 1 if i < 6 else None) for i in range(7)], "id long, p long")
    assert {(r.id, r.ancestor, r.steps) for r in fixpoint.ancestors(up).collect()} == {(i, j, j - i) for i in range(7) for j in range(i, 7)}
    loose = spark.createDataFrame([(4, 1.0), (2, 1.0), (9, 0.0)], "node long, f float")
    assert {(r.node, r.next) for r in trunk.chained(loose).collect()} == {(9, 2), (2, 4), (4, None)}
    asked = spark.createDataFrame([(1, 1.0), (2, 1.0), (100, 5.0), (0, -1.0)], "id long, f float")
    assert {(r.id, r.arc) for r in trunk.as_of(asked, loose).collect()} == {(1, 9), (2, 2), (100, 4), (0, None)}


def test_byte_string(spark):
    row = spark.range(1).select(byte_string(F.lit(12)).alias("a"), byte_string(F.lit(1536)).alias("b"), byte_string(F.lit(5 << 40)).alias("c")).first()
    assert (row.a, row.b, row.c) == ("12 B", "1.50 KB", "5.00 TB")


def test_bitmaps(spark):
    """Numbers across several buckets, repeats and nulls; all of 0 to 32,768 and beyond are told apart."""
    import random

    draw = random.Random(3)
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 10**12] + [draw.randrange(100_000) for _ in range(300)]
    rows = [(n % 3, n, "x") for n in numbers] * 2 + [(0, None, "x")]
    df = spark.createDataFrame(rows, "comp long, n long, bits string").repartition(4)
    made = sets.bitmaps(df, "n", "comp")
    assert {r.comp: r.blocks for r in sets.peer_counts(made).collect()} == {k: len({n for n in numbers if n % 3 == k}) for k in range(3)}
    whole = sets.merged_bitmaps(made)
    asked = [(n, "y") for n in {*numbers, *(n + 1 for n in numbers), 5, 40_000}] + [(None, "z"), (5, "again")]
    left = sets.unvisited(spark.createDataFrame(asked, "id long, bucket string"), whole).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(str(r) for r in asked if r[0] not in numbers)
    assert sets.bitmaps(df.limit(0), "n", "comp").count() == 0 and sets.unvisited(spark.createDataFrame(asked, "id long, bucket string"), whole.limit(0)).count() == len(asked)


def test_contains_and_filled_on_odd_rows(spark):
    from fieldtree.schema import GridSpec
    from fieldtree.sources.fields import filled

    edge = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (None, 7), (1, None)], "comp long, id long")
    asked = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (2, 5, "y"), (None, 7, "z"), (1, None, "n")], "comp long, id long, _f string")
    told = sets.contains(edge, asked)
    assert told.columns == ["comp", "id", "_f", "is_in"]
    assert sorted((r["_f"], r.is_in) for r in told.collect()) == [("n", False), ("x", True), ("x", True), ("y", False), ("z", False)]
    assert not any(r.is_in for r in sets.contains(edge.limit(0), asked).collect())
    rows = spark.createDataFrame([(1, 2.5), (3, None), (9, 1.0), (-1, 1.0), (None, 4.0)], "id long, f double")
    field = {r.id: (r.f, r.x, r.y) for r in filled(rows, GridSpec(2, 2), -1.0).collect()}
    assert field == {0: (-1.0, 0, 0), 1: (2.5, 1, 0), 2: (-1.0, 0, 1), 3: (-1.0, 1, 1)}
    assert {r.f for r in filled(rows.limit(0), GridSpec(3), 7.0).collect()} == {7.0}
