"""Fixpoints of pointers by doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

MOST_ROUNDS = 64

#: At most so many links are followed in one task, some 100 bytes each while they are.
FEW_LINKS = 1 << 20


def pointer_jump(pointers: DataFrame, id: str = "id", p: str = "p", carry: tuple[str, ...] = ()) -> DataFrame:
    """id and root: pointers followed to their fixed points; missing targets are fixed points.

    ``carry`` names columns that tell something of p; the result has them of the root, from the last pointer on the way.
    Each round joins the table with itself, so a chain halves; rounds are the logarithm of the longest
    chain. Each is stored, so the lineage stays short, and its write counts the pointers that moved. Targets that many
    rows share are a join side that the engine can split. Null pointers stay; an empty table gives an empty one.
    """
    now = stored(pointers.select(F.col(id).alias("id"), F.col(p).alias("p"), *carry), "pointers", open=F.count_if(F.expr("id <> p")))
    left = now.metrics["open"]
    for _ in range(MOST_ROUNDS):
        if not left:
            return now.select("id", F.col("p").alias("root"), *carry)
        over = now.select(F.col("id").alias("q"), F.col("p").alias("next"), *(F.col(c).alias(f"next_{c}") for c in carry)).filter("q <> next")
        moved = F.col("next").isNotNull()
        jumped = now.join(over, F.col("p") == F.col("q"), "left").select("id", F.coalesce("next", "p").alias("p"), *(F.when(moved, F.col(f"next_{c}")).otherwise(F.col(c)).alias(c) for c in carry), moved.alias("moved"))
        now = stored(jumped, "pointers", moved=F.count_if("moved"))
        left, now = now.metrics["moved"], now.select("id", "p", *carry)
    raise RuntimeError("pointers did not settle")


def _plain(column: pa.Array) -> np.ndarray:
    if pa.types.is_struct(column.type):
        return np.rec.fromarrays([c.to_numpy(zero_copy_only=False) for c in column.flatten()], names=[f.name for f in column.type])
    return column.to_numpy(zero_copy_only=False)


def components_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and root (the least) of the links (a, b) in one task: greater names hook on to smaller ones until no link joins two."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        both = pa.concat_arrays([c for end in ("a", "b") for c in table[end].chunks])
        _, first, place = np.unique(_plain(both), return_index=True, return_inverse=True)
        a, b, name = place[: len(place) // 2], place[len(place) // 2 :], np.arange(len(first))
        while (differ := name[a] != name[b]).any():
            a, b = a[differ], b[differ]
            np.minimum.at(name, np.maximum(name[a], name[b]), np.minimum(name[a], name[b]))
            while (name != (further := name[name])).any():
                name = further
        yield pa.RecordBatch.from_arrays([both.take(pa.array(first)), both.take(pa.array(first[name]))], names=["id", "root"])


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """id and root: the nodes that links (a, b) name, with one node that stands for all that are linked; stored.

    Each node hooks on to the other end of its least link, what hangs together becomes one node, and the links between
    these go on: nodes at least halve in each round. Once there are ``few`` links or less, one task follows them. Links are ordered as pairs, so hooks close no cycle but those of two
    nodes with one link. Nodes of any type that can be ordered; least links combine ahead of their shuffle, so a node with
    very many links is no hot key there. Repeated links and links of a node to itself add nothing, though the latter's node is left out
    if it has no other; null ends are not expected. An empty table gives an empty one.
    """
    left = stored(links.select("a", "b").filter("a <> b"), "links", rows=F.count(F.lit(1)))
    here = lambda: left.coalesce(1).mapInArrow(components_here, left.select(F.col("a").alias("id"), F.col("b").alias("root")).schema)
    if left.metrics["rows"] <= few:
        return stored(here(), "components")
    named = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    known = stored(named.select("id", F.col("id").alias("root")), "components")
    while left.metrics["rows"]:
        if left.metrics["rows"] <= few:
            top = stored(here(), "hooks")
        else:
            link = F.struct(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
            sides = left.select(F.col("a").alias("c"), link.alias("e"), F.col("b").alias("to")).union(left.select("b", link, "a"))
            least = stored(sides.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", F.col("m.to").alias("to")), "hooks")
            # Of two nodes that hook on to each other the smaller stays; the rest point on.
            back = least.select(F.col("c").alias("to"), F.col("to").alias("back"))
            pointers = least.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
            top = pointer_jump(pointers, "c", "p")
        of = lambda n: top.select(F.col("id").alias(f"c{n}"), F.col("root").alias(f"r{n}"))  # noqa: B023, E731
        known = stored(known.join(of("k"), F.col("root") == F.col("ck"), "left").select("id", F.coalesce("rk", "root").alias("root")), "components")
        if left.metrics["rows"] <= few:
            break
        left = stored(left.join(of("a"), F.col("a") == F.col("ca")).join(of("b"), F.col("b") == F.col("cb")).filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links", rows=F.count(F.lit(1)))
    return known


def ancestors(parents: DataFrame, id: str = "id", p: str = "p", of: DataFrame | None = None) -> DataFrame:
    """id, ancestor and steps: each node (or each id in ``of``) with all above it, itself with 0 steps.

    The result has as many rows as the sum of the depths; ``of`` keeps it to the paths that are wanted.
    Tables of the 1st, 2nd, 4th, ... ancestor double what is known in each round.
    """
    one = stored(parents.select(F.col(id).alias("id"), F.col(p).alias("p")), "parents", rows=F.count(F.lit(1)))
    start = one if of is None else one.join(of.select("id"), "id", "left_semi")
    known = start.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("steps"))
    hop, reach, left = one.filter("p IS NOT NULL"), 1, one.metrics["rows"]
    while left:
        more = known.join(hop.select(F.col("id").alias("a"), "p"), F.col("ancestor") == F.col("a")).select("id", F.col("p").alias("ancestor"), F.col("steps") + reach)
        known = stored(known.union(more), "ancestors")
        hop = stored(hop.alias("l").join(hop.alias("r"), F.col("l.p") == F.col("r.id")).select("l.id", "r.p"), "hops", rows=F.count(F.lit(1)))
        reach, left = reach * 2, hop.metrics["rows"]
    return known


def subtrees(parents: DataFrame, id: str = "id", p: str = "p", totals: tuple[str, ...] = (), least: tuple[str, ...] = ()) -> DataFrame:
    """id, with the columns ``totals`` summed and ``least`` minimised over each node and all nodes below it; a row a node, stored.

    In round k a node takes over what nodes 2**k levels below it have gathered (sums combine ahead of their shuffle, so a
    node with very many others below is no hot key), and points twice as far up. Rounds are the logarithm of the
    depth, rows those of the table in each. A null parent is a root, of which there can be several. Null values count as nothing; an empty table gives an
    empty one. Ids must not repeat, and there must be no cycle.
    """
    columns = (*totals, *least)
    up = parents.select(F.col(id).alias("id"), F.col(p).alias("up"), *columns)
    now = stored(up, "subtrees", open=F.count("up"))
    for _ in range(MOST_ROUNDS):
        if not now.metrics["open"]:
            return now.select(F.col("id").alias(id), *columns)
        below = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("of")).agg(*(F.sum(c).alias(f"more_{c}") for c in totals), *(F.min(c).alias(f"more_{c}") for c in least), F.count(F.lit(1)).alias("n"))
        far = now.select(F.col("id").alias("via"), F.col("up").alias("further"))
        wider = now.join(below, F.col("id") == F.col("of"), "left").join(far, F.col("up") == F.col("via"), "left")
        kind = {c: now.schema[c].dataType for c in columns}
        sums = [F.when(F.col(c).isNull(), F.col(f"more_{c}")).otherwise(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).cast(kind[c]).alias(c) for c in totals]
        now = stored(wider.select("id", F.col("further").alias("up"), *sums, *(F.least(c, f"more_{c}").alias(c) for c in least)), "subtrees", open=F.count("up"))
    raise RuntimeError("parents go round in a cycle")


def intervals(parents: DataFrame, id: str = "id", p: str = "p") -> DataFrame:
    """id, first, size and depth: a is b or above it exactly if a.first <= b.first < a.first + a.size. A row a node, stored.

    ``first`` numbers nodes ahead of those below them, from 0, siblings by id: the sum, along the way to the root, of
    what stands ahead of each node among its siblings. That sum is made by doubling. Siblings are put in order in one task a
    parent: in a join tree a saddle has at most six.
    """
    from pyspark.sql import Window

    nodes = parents.select(F.col(id).alias("id"), F.col(p).alias("p"))
    sized = subtrees(nodes.withColumn("size", F.lit(1).cast("long")), totals=("size",))
    ahead = Window.partitionBy("p").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.join(sized, "id").withColumn("first", F.coalesce(F.sum("size").over(ahead), F.lit(0)) + F.when(F.col("p").isNull(), 0).otherwise(1))
    now = stored(placed.select("id", F.col("p").alias("up"), "size", "first", F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("depth")), "intervals", open=F.count("up"))
    for _ in range(MOST_ROUNDS):
        if not now.metrics["open"]:
            return now.select(F.col("id").alias(id), "first", "size", "depth")
        far = now.select(F.col("id").alias("via"), F.col("up").alias("further"), F.col("first").alias("more"), F.col("depth").alias("levels"))
        wider = now.join(far, F.col("up") == F.col("via"), "left").select("id", F.col("further").alias("up"), "size", (F.col("first") + F.coalesce("more", F.lit(0))).alias("first"), (F.col("depth") + F.coalesce("levels", F.lit(0))).alias("depth"))
        now = stored(wider, "intervals", open=F.count("up"))
    raise RuntimeError("parents go round in a cycle")


def related(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """``pairs`` (upper, lower) with is_above: whether upper is lower or above it; null where one of them is no node.

    ``told``: ``intervals`` with the column id. Two joins on ids; nothing walks along the tree.
    """
    a = told.select(F.col("id").alias("upper"), F.col("first").alias("a"), F.col("size").alias("n"))
    b = told.select(F.col("id").alias("lower"), F.col("first").alias("b"))
    made = pairs.join(a, "upper", "left").join(b, "lower", "left")
    return made.select(*pairs.columns, ((F.col("a") <= F.col("b")) & (F.col("b") < F.col("a") + F.col("n"))).alias("is_above"))
