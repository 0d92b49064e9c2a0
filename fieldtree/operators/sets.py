"""Set operations on boundaries, and members of arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import value
from ..schema import GridSpec
from .grid import neighbours
from .ordered import before


def boundary(field: DataFrame, spec: GridSpec, members: DataFrame) -> DataFrame:
    """comp, id and f: the vertices next to a component (``members``: comp, id) but not in it."""
    placed = members.join(field.select("id", "x", "y", "z"), "id")
    near = neighbours(placed, spec).select("comp", F.col("nid").alias("id")).distinct()
    return near.join(members, ["comp", "id"], "left_anti").join(field.select("id", "f"), "id").select("comp", "id", "f")


def add(boundary: DataFrame, rows: DataFrame) -> DataFrame:
    return boundary.unionByName(rows).distinct()


def remove(boundary: DataFrame, rows: DataFrame) -> DataFrame:
    """Without the given (comp, id)."""
    return boundary.join(rows.select("comp", "id"), ["comp", "id"], "left_anti")


def contains(boundary: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (comp, id and more) with is_in: whether the boundary of comp holds id.

    Repeated rows of either side change nothing; a null comp or id is in no boundary; an empty boundary holds nothing.
    """
    held = boundary.select(F.col("comp").alias("_comp"), F.col("id").alias("_id")).distinct()
    met = asked.join(held, (F.col("comp") == F.col("_comp")) & (F.col("id") == F.col("_id")), "left")
    return met.select(*asked.columns, F.col("_id").isNotNull().alias("is_in"))


def unite(one: DataFrame, other: DataFrame) -> DataFrame:
    """id and f of either boundary."""
    return one.select("id", "f").union(other.select("id", "f")).distinct()


def intersect(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What both hold, and the two without it."""
    common = one.select("id", "f").intersect(other.select("id", "f"))
    ids = common.select("id")
    return common, one.join(ids, "id", "left_anti"), other.join(ids, "id", "left_anti")


def boundary_min(boundary: DataFrame) -> DataFrame:
    """comp, id and f of the least vertex of each boundary; a component without one has no row."""
    return boundary.groupBy("comp").agg(F.min(value()).alias("m")).select("comp", F.col("m.id").alias("id"), F.col("m.f").alias("f"))


def ordered_boundary(boundary: DataFrame) -> DataFrame:
    """comp, id and prev: each boundary in ascending order, as links to the vertex before; null for the least.

    Boundaries are dealt by ranges of the order, so a large one is spread over tasks. An empty table gives an
    empty one; rows are expected without repeats and nulls.
    """
    rows = boundary.select(F.col("comp").alias("grp"), "f", "id", F.lit(True).alias("is_node"))
    return before(rows).select(F.col("grp").alias("comp"), "id", "prev")


def most_shared(shared: DataFrame) -> DataFrame:
    """a and b of the two components that share most vertices (``shared_vertices``), ties to the smaller pair; no row without any."""
    sizes = shared.groupBy("a", "b").agg((-F.count(F.lit(1))).alias("n"))
    return sizes.agg(F.min(F.struct("n", "a", "b")).alias("m")).filter("m IS NOT NULL").select("m.a", "m.b")


def inherit(members: DataFrame, arcs: DataFrame) -> DataFrame:
    """``members`` (arc, id) with those of the arcs that end at a saddle given to the arc that starts there, too.

    One level: call it again for the next. The root's members stay; arcs that ``arcs`` (extremum, saddle)
    doesn't name are kept and hand on nothing.
    """
    up = arcs.filter("saddle IS NOT NULL").select(F.col("extremum").alias("arc"), "saddle")
    return members.select("arc", "id").unionByName(members.join(up, "arc").select(F.col("saddle").alias("arc"), "id"))


def shared_vertices(boundary: DataFrame) -> DataFrame:
    """id, a and b, a < b: vertices that lie on the boundaries of two components.

    A vertex has at most six neighbours, so at most six components meet at it.
    """
    met = boundary.groupBy("id").agg(F.sort_array(F.collect_set("comp")).alias("c")).filter(F.size("c") > 1)
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return met.select("id", F.explode(pairs).alias("p")).select("id", "p.a", "p.b")


def split_members(members: DataFrame, saddle: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (id, f) of an arc below a saddle, which stay, and those from it on, which move up."""
    below = value() < saddle
    return members.filter(below), members.filter(~below)


def latest_answers(answers: DataFrame) -> DataFrame:
    """Of rows (arc, location, counter, ...) the one with the highest counter for each arc and location."""
    rest = [c for c in answers.columns if c not in ("arc", "location")]
    return answers.groupBy("arc", "location").agg(F.max_by(F.struct(*rest), "counter").alias("last")).select("arc", "location", "last.*")


def peers(view: DataFrame, members: DataFrame) -> DataFrame:
    """comp and the sorted blocks (``view``: id, block, is_ghost) that hold some of its members."""
    owned = view.filter("NOT is_ghost").select("id", "block")
    return members.join(owned, "id").groupBy("comp").agg(F.sort_array(F.collect_set("block")).alias("blocks"))


def bitmaps(rows: DataFrame, number: str, *keys: str) -> DataFrame:
    """``keys``, bucket and bits: the numbers of each key as bitmaps of 32,768 bits, combined ahead of their shuffle.

    A row of a few kilobytes stands for any number of repeats; a key with numbers all over has a row for each bucket, so no row
    grows. Null numbers are left out; negative ones are not expected.
    """
    made = rows.filter(F.col(number).isNotNull()).select(*keys, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_at"))
    return made.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_at").alias("bits"))


def merged_bitmaps(made: DataFrame, *keys: str) -> DataFrame:
    """``bitmaps`` of fewer keys: those of one key and bucket together."""
    return made.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bit_is_set(bits: str, number: str) -> Column:
    """Whether a number is in the bitmap of its bucket."""
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.call_function("div", at, F.lit(8).cast("long")) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def peer_bitmaps(view: DataFrame, members: DataFrame) -> DataFrame:
    """comp, bucket and bits: the blocks (``view``: id, block, is_ghost) that hold some of a component's members."""
    return bitmaps(members.join(view.filter("NOT is_ghost").select("id", "block"), "id"), "block", "comp")


def peer_counts(made: DataFrame) -> DataFrame:
    """comp and the number of blocks in its bitmaps."""
    return made.groupBy("comp").agg(F.sum(F.bitmap_count("bits")).alias("blocks"))


def unvisited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """``frontier`` (id and more) without the ids in ``visited``, bitmaps of ids (bucket, bits); null ids stay.

    What is visited is a bit a vertex, and the join is on buckets.
    """
    seen = visited.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    met = frontier.join(seen, F.bitmap_bucket_number("id") == F.col("_bucket"), "left")
    return met.filter(F.col("_bits").isNull() | ~bit_is_set("_bits", "id")).select(*frontier.columns)


def fetch_or_create(arcs: DataFrame, extrema: DataFrame) -> DataFrame:
    """``arcs`` (extremum, saddle, is_leaf) with a row for each further extremum (extremum, is_leaf)."""
    new = extrema.select("extremum", F.col("is_leaf").alias("new_leaf"))
    return arcs.join(new, "extremum", "full_outer").select("extremum", "saddle", F.coalesce("is_leaf", "new_leaf").alias("is_leaf"))
