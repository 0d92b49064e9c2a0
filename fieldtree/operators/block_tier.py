"""The block tier: trees of blocks, merged over growing regions, with no task that sees the whole field.

1. *Basins.* A block is a row of arrays; it gets the faces of the blocks beside it (``halo``) and follows steepest descent on its
   own, down to a minimum or a ghost cell. Only pointers from outer cell to outer cell are followed by joins.
2. *Trees of blocks.* A block joins its basins in order of the vertices that join them. A component is closed
   if none of its basins touches another block; nothing outside can reach it earlier. Where two components
   meet and the one with the greater minimum is closed, that one ends there for good, wherever else the other
   one goes: its death (minimum, saddle, a minimum of what it joins) is final. All else is kept as an edge
   between the two components' least minima, for the next level.
3. *Regions.* Eight blocks make a region (a prefix of their Z-order), eight regions a greater one. Fewer basins touch the outside at each
   level, so what a task gets grows with the surface of its region and not with its volume. A region with more than ``REGION_EDGES``
   edges is cut into ranges of saddles, a task each (``ranged``), so no task gets a region's whole surface either.
4. *Arcs.* A death names some minimum of the component that goes on; the branch it joins is found by following
   deaths up to the level of the saddle, by doubling. The nodes of a branch in order are its arcs.

Edges at one saddle may be taken in any order: all of the components that meet there but the least one end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import value
from ..schema import GridSpec
from ..storage import stored
from .fixpoint import FEW_LINKS, components, pointer_jump
from .grid import Blocks, decompose, halved
from .halo import INNER, SIDES, around, beside_rows, cell_rows, cells, face, faces, grown, ids, present, ranks, shape
from .ordered import before

#: A block holds at most so many cells, some 100 bytes each in its task; a small field is cut for the cores, into blocks of at least the lesser number.
BLOCK_CELLS, LEAST_CELLS = 1 << 17, 1 << 12

#: A task joins at most about so many edges of a region, some 300 bytes each while it does.
REGION_EDGES = 1 << 20


def blocks_for(spec: GridSpec, blocks: int | None = None, cores: int = 1) -> Blocks:
    """A number of blocks that is asked for, by its prime factors; else blocks by halving, of bounded size, in Z-order."""
    return decompose(spec, blocks) if blocks else halved(spec, min(BLOCK_CELLS, max(LEAST_CELLS, -(-spec.n // cores))))


def _descents(blocks: Blocks) -> Callable:
    """Of a block with its halo: where steepest descent leads from each cell, and from the outer ones as rows."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        block = key[0].as_py()
        values, there = grown(blocks, block, left.column("f")[0].as_py(), right)
        rank, place = ranks(values, there)
        least = rank[INNER].copy()
        for other in around(rank):
            np.minimum(least, other, out=least)
        down = np.arange(rank.size).reshape(rank.shape)
        down[INNER] = place[least]
        down = down.ravel()
        while (down != (further := down[down])).any():
            down = further
        to = down.reshape(rank.shape)[INNER]
        id_ = np.broadcast_to(ids(blocks.spec, *cells(blocks, block, 1)), rank.shape)
        target, outer = id_.ravel()[to], np.zeros(to.shape, bool)
        for axis, step in SIDES:
            if blocks.beside(block, axis, step) is not None:
                outer[tuple((0 if step < 0 else -1) if k == 2 - axis else slice(None) for k in range(3))] = True
        lists = [pa.array([c], pa.list_(t)) for c, t in ((id_[INNER][outer], pa.int64()), (target[outer], pa.int64()), (values.ravel()[to][outer], pa.float32()))]
        return pa.table([pa.array([block], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary()), *lists], names=["block", "grown", "target", "id", "p", "pf"])

    return run


def descents(made: DataFrame, blocks: Blocks) -> DataFrame:
    """A row of arrays for each block of ``tiles``: its values with the halo, and what steepest descent ends in, a minimum or a cell of the halo; stored.

    id, p and pf are lists: the outer cells, where they lead, and the value there.
    """
    schema = "block int, grown binary, target binary, id array<long>, p array<long>, pf array<float>"
    return stored(made.groupBy("block").cogroup(faces(made, blocks).groupBy("block")).applyInArrow(_descents(blocks), schema), "descents")


@dataclass
class Forest:
    """Trees of blocks: rows of the kinds of ``_region_rows``, and the blocks' cells with their basins as arrays (kind 3)."""

    rows: DataFrame
    blocks: Blocks

    @property
    def basins(self) -> DataFrame:
        """The field (id, x, y, z, f) with basin and basin_f, the minimum that steepest descent ends in; no shuffle."""
        blocks = self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, *columns in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "basins", "heights"))):
                    f, basin, height = (np.frombuffer(c, t) for c, t in zip(columns, (np.float32, np.int64, np.float32)))
                    yield from cell_rows(blocks, block, {"f": f, "basin": basin, "basin_f": height})

        return self.rows.filter("kind = 3").select("block", "cells", "basins", "heights").mapInArrow(run, "id long, x int, y int, z int, f float, basin long, basin_f float")


def forest(made: DataFrame, blocks: Blocks) -> Forest:
    """The trees of all blocks of ``tiles``; stored.

    Outer cells of all blocks are followed from block to block by joins, and each block gets the basins of the cells beside
    it: rows for surfaces only. A dense field without nulls is expected (``sources.fields.check``).
    """
    left = descents(made, blocks)
    linked = left.select(F.inline(F.arrays_zip("id", "p", "pf")))
    roots = pointer_jump(linked, carry=("pf",)).select("id", F.col("root").alias("basin"), F.col("pf").alias("basin_f"))
    met = beside_rows(roots, blocks).select("block", "id", "basin", "basin_f")
    return Forest(stored(left.select("block", "grown", "target").groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_block_tree(blocks), _REGION + ", cells binary, basins binary, heights binary"), "block-trees", edges=F.count_if(F.expr("kind = 0"))), blocks)


def merge_region(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, f: np.ndarray, s: np.ndarray, open_: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """Deaths (minimum, its value, a minimum joined, value and id of the saddle) and edges for the next level.

    Edges join basins a and b, whose minima have values fa and fb, at the vertex (f, s); ``open_`` lists the
    basins that touch the outside.
    """
    basin, first, place = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
    height = np.concatenate([fa, fb])[first]
    age = np.empty(len(basin), np.int64)
    age[np.lexsort((basin, height))] = np.arange(len(basin))
    order = np.lexsort((s, f))
    left, right = place[: len(a)][order].tolist(), place[len(a) :][order].tolist()
    up, least, age, live = list(range(len(basin))), list(range(len(basin))), age.tolist(), np.isin(basin, open_).tolist()
    ids, heights = basin.tolist(), height.tolist()

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    deaths, kept = [], []
    for i, j, level, saddle in zip(left, right, f[order].tolist(), s[order].tolist()):
        i, j = top(i), top(j)
        if i == j:
            continue
        if age[least[i]] > age[least[j]]:
            i, j = j, i
        old, young = least[i], least[j]
        if live[j]:
            kept.append((ids[old], ids[young], heights[old], heights[young], level, saddle))
        else:
            deaths.append((ids[young], heights[young], ids[old], level, saddle))
        up[j] = i
        live[i] = live[i] or live[j]
    return deaths, kept


_REGION = "kind int, a long, b long, fa float, fb float, f float, s long, block int"


def _region_rows(deaths: list[tuple], kept: list[tuple], contacts: np.ndarray, block: int) -> pa.Table:
    """Rows of the three kinds: 0 edges, 1 contacts (basin, other block), 2 deaths (a: minimum, b: a minimum joined)."""
    n = len(kept), len(contacts), len(deaths)
    k, d = np.array(kept, object).reshape(-1, 6).T, np.array(deaths, object).reshape(-1, 5).T
    pick = lambda x, y, z, t: pa.array([*x, *y, *z], t)
    none = [None] * n[1]
    return pa.table({
        "kind": pa.array(np.repeat([0, 1, 2], n).astype(np.int32)), "a": pick(k[0], contacts[:, 0], d[0], pa.int64()), "b": pick(k[1], contacts[:, 1], d[2], pa.int64()),
        "fa": pick(k[2], none, d[1], pa.float32()), "fb": pick(k[3], none, [None] * n[2], pa.float32()), "f": pick(k[4], none, d[3], pa.float32()), "s": pick(k[5], none, d[4], pa.int64()),
        "block": pa.array(np.full(sum(n), block, np.int32)),
    })


def _block_tree(blocks: Blocks) -> Callable:
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        block, spec = key[0].as_py(), blocks.spec
        size, there = shape(blocks, block), present(blocks, block)
        values = np.frombuffer(left.column("grown")[0].as_py(), np.float32).reshape(there.shape)
        target = np.frombuffer(left.column("target")[0].as_py(), np.int64)
        rank, place = ranks(values, there)
        id_ = np.broadcast_to(ids(spec, *cells(blocks, block, 1)), there.shape)
        known, basin_of, height_of = (right.column(c).to_numpy() for c in ("id", "basin", "basin_f"))
        order = np.argsort(known)
        known, basin_of, height_of = known[order], basin_of[order], height_of[order]

        def looked(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(known, i)
            return basin_of[at], height_of[at]

        lo, hi = blocks.corners(block)
        at = target % spec.X - lo[0], target // spec.X % spec.Y - lo[1], target // (spec.X * spec.Y) - lo[2]
        own = np.logical_and.reduce([(c >= 0) & (c < h - l) for c, l, h in zip(at, lo, hi)])
        inner = target.copy()
        inner_f = values[INNER][tuple(np.where(own, c, 0) for c in reversed(at))]
        inner[~own], inner_f[~own] = looked(target[~own])
        basin, basin_f = np.full(there.shape, -1, np.int64), np.zeros(there.shape, np.float32)
        basin[INNER], basin_f[INNER] = inner.reshape(size), inner_f.reshape(size)
        met = [np.empty((0, 2), np.int64)]
        for axis, step in SIDES:
            other = blocks.beside(block, axis, step)
            if other is not None:
                outside = face(step, axis)
                basin[outside], basin_f[outside] = looked(id_[outside])
                for side in (outside, face(step, axis, inside=True)):
                    found = np.unique(basin[side])
                    met.append(np.stack([found, np.full(len(found), other)], 1))
        parts = []
        for axis in range(3):  # an edge belongs to the block of its lower end
            ahead = tuple(slice(2, None) if k == 2 - axis else slice(1, -1) for k in range(3))
            differ = there[ahead] & (basin[INNER] != basin[ahead])
            parts.append((basin[INNER][differ], basin[ahead][differ], basin_f[INNER][differ], basin_f[ahead][differ], np.maximum(rank[INNER], rank[ahead])[differ]))
        a, b, fa, fb, level = (np.concatenate(x) for x in zip(*parts))
        swap = a > b
        a, b, fa, fb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, fb, fa), np.where(swap, fa, fb)
        order = np.lexsort((level, b, a))
        a, b, fa, fb, level = a[order], b[order], fa[order], fb[order], level[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
        contacts = np.unique(np.concatenate(met), axis=0)
        cell = place[level[first]]
        dead, kept = merge_region(a[first], b[first], fa[first], fb[first], values.ravel()[cell], id_.ravel()[cell], contacts[:, 0])
        rows = _region_rows(dead, kept, contacts, block)
        whole = _region_rows([], [], np.empty((1, 2), np.int64), block).set_column(0, "kind", pa.array([3], pa.int32()))
        contents = (values[INNER], inner, inner_f)
        for k, name in enumerate(("cells", "basins", "heights")):
            rows = rows.append_column(name, pa.nulls(rows.num_rows, pa.binary()))
            whole = whole.append_column(name, pa.array([np.ascontiguousarray(contents[k]).tobytes()], pa.binary()))
        return pa.concat_tables([rows, whole])

    return run


def _region_tree(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    edge = table.filter(pc.equal(table["kind"], 0))
    open_ = table.filter(pc.equal(table["kind"], 1))["a"].to_numpy()
    deaths, kept = merge_region(*(edge[c].to_numpy() for c in ("a", "b", "fa", "fb", "f", "s")), open_)
    block = edge["block"][0].as_py() if edge.num_rows else 0  # any block of the region, which kept edges name
    return _region_rows(deaths, kept, np.empty((0, 2), np.int64), block)


def _range_tree(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    columns = {c: table[c].to_numpy() for c in ("a", "b", "fa", "fb", "f", "s")}
    open_ = np.concatenate([columns[end][table[flag].to_numpy()] for end, flag in (("a", "open_a"), ("b", "open_b"))])
    return _region_rows(*merge_region(*columns.values(), open_), np.empty((0, 2), np.int64), table["block"][0].as_py())


def ranged(edges: DataFrame, still: DataFrame, n: int, few: int = FEW_LINKS) -> DataFrame:
    """``edges`` of regions (at, block, a, b, fa, fb, f, s) cut into ``n`` ranges of (at, f, s): with seg, open_a and open_b, stored.

    ``still`` (at, a) tells a region's open basins. A range can be joined by itself, since each end of its edges is
    the least basin of what lower ranges have joined it to, and open if one of these is. That is found for all ranges by halving: what hangs together in a lower
    half (``components``) gets one name in the upper one. That takes log2(n) steps over all edges, of joins and aggregations.
    Edges that join nothing any more are left out. Ranges are dealt by sampled bounds, so they are about equal.
    """
    of = lambda end: still.select(F.col("at").alias(f"at_{end}"), F.col("a").alias(f"id_{end}"))
    dealt = edges.repartitionByRange(n, "at", "f", "s").withColumn("seg", F.spark_partition_id())
    for end in ("a", "b"):
        dealt = dealt.join(of(end), (F.col("at") == F.col(f"at_{end}")) & (F.col(end) == F.col(f"id_{end}")), "left").withColumn(f"open_{end}", F.col(f"id_{end}").isNotNull()).drop(f"at_{end}", f"id_{end}")
    now = stored(dealt, "ranges")
    for half in reversed(range((n - 1).bit_length())):
        node = lambda end: F.struct("at", F.shiftright("seg", half + 1).alias("part"), F.col(end).alias("id"))  # noqa: B023, E731
        is_upper = F.shiftright("seg", half) % 2 == 1
        lower, upper = now.filter(~is_upper), now.filter(is_upper)
        ends = [lower.select(node(e).alias("id"), F.struct(F.col(f"f{e}").alias("f"), F.col(e).alias("id")).alias("least"), F.col(f"open_{e}").alias("open")) for e in ("a", "b")]
        ends = ends[0].union(ends[1]).groupBy("id").agg(F.min("least").alias("least"), F.bool_or("open").alias("open"))
        root = components(lower.select(node("a").alias("a"), node("b").alias("b")), few)
        top = root.join(ends, "id").groupBy("root").agg(F.min("least").alias("least"), F.bool_or("open").alias("open"))
        names = stored(root.join(top, "root").select("id", "least", "open"), "names")
        for e in ("a", "b"):
            upper = upper.withColumn("_node", node(e)).join(names.withColumnsRenamed({"id": "_id", "least": "_least", "open": "_open"}), F.col("_node") == F.col("_id"), "left")
            upper = upper.withColumns({e: F.coalesce("_least.id", e), f"f{e}": F.coalesce("_least.f", f"f{e}"), f"open_{e}": F.coalesce("_open", f"open_{e}")}).drop("_node", "_id", "_least", "_open")
        now = stored(lower.unionByName(upper.filter("a <> b")), "ranges")
    return now


def deaths(trees: Forest, most: int = REGION_EDGES) -> DataFrame:
    """u, uf, host, fs and s: where the component of each minimum but the least ends; stored.

    Regions of more than ``most`` edges are joined range by range (``ranged``), a task a range; the others in a task each.
    """
    now, blocks = trees.rows, trees.blocks
    contacts, done, level = now.filter("kind = 1").select("a", "b", "block"), [now.filter("kind = 2")], 0
    left, edges = now.metrics["edges"], now.filter("kind = 0").select("block", "a", "b", "fa", "fb", "f", "s")
    while blocks.regions(level) > 1:
        level += 1
        mine, theirs = blocks.region(F.col("block"), level), blocks.region(F.col("b"), level)
        still = contacts.filter(mine != theirs).select(mine.alias("at"), F.col("a")).distinct()
        nothing = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in names]
        # Edges name a block of their region, contacts all of theirs.
        edges, wide = edges.select(blocks.region(F.col("block"), level).alias("at"), "block", "a", "b", "fa", "fb", "f", "s"), None
        if left > most:
            wide = stored(edges.groupBy("at").count().filter(F.col("count") > most), "wide-regions", rows=F.count(F.lit(1)), edges=F.sum("count"))
        parts = wide is not None and wide.metrics["rows"] > 0
        if parts:
            cut = ranged(edges.join(wide, "at", "left_semi"), still.join(wide, "at", "left_semi"), -(-wide.metrics["edges"] // most))
            edges, still = edges.join(wide, "at", "left_anti"), still.join(wide, "at", "left_anti")
        rows = edges.select("at", F.lit(0).alias("kind"), "block", "a", "b", "fa", "fb", "f", "s").unionByName(
            still.select("at", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("block"), "a", *nothing(("b", "long"), ("fa", "float"), ("fb", "float"), ("f", "float"), ("s", "long")))
        )
        joined = rows.groupBy("at").applyInArrow(_region_tree, _REGION)
        if parts:
            joined = joined.unionByName(cut.groupBy("at", "seg").applyInArrow(_range_tree, _REGION))
        made = stored(joined, "region-trees", edges=F.count_if(F.expr("kind = 0")))
        done.append(made.filter("kind = 2"))
        left, edges = made.metrics["edges"], made.filter("kind = 0").select("block", "a", "b", "fa", "fb", "f", "s")
    out = done[0].select("a", "fa", "b", "f", "s")
    for more in done[1:]:
        out = out.unionByName(more.select("a", "fa", "b", "f", "s"))
    return stored(out.select(F.col("a").alias("u"), F.col("fa").alias("uf"), F.col("b").alias("host"), F.col("f").alias("fs"), "s"), "deaths")


def death_hops(dead: DataFrame) -> list[DataFrame]:
    """Tables of the 1st, 2nd, 4th, ... component that one goes on in (u, to, high), with the highest saddle on the way."""
    hop = stored(dead.select("u", F.col("host").alias("to"), value("fs", "s").alias("high")), "steps", rows=F.count(F.lit(1)))
    hops = []
    while hop.metrics["rows"]:
        hops.append(hop)
        far = hop.select(F.col("u").alias("u2"), F.col("to").alias("to2"), F.col("high").alias("high2"))
        hop = stored(hop.join(far, F.col("to") == F.col("u2")).select("u", F.col("to2").alias("to"), F.greatest("high", "high2").alias("high")), "steps", rows=F.count(F.lit(1)))
    return hops


def branches(rows: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """``rows`` (f, id, at and more) with ``at`` moved from a minimum to the one whose component it is in at the level (f, id).

    A component that has ended at or below the level goes on in the one it has joined. ``hops`` (``death_hops``) are
    applied from the longest down.
    """
    columns = rows.columns
    for hop in reversed(hops):
        moved = F.when(F.col("high").isNotNull() & (F.col("high") <= value()), F.col("to")).otherwise(F.col("at"))
        rows = rows.join(hop, F.col("at") == F.col("u"), "left").select(*(moved.alias("at") if c == "at" else c for c in columns))
    return rows


def branch_nodes(basins: DataFrame, dead: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """branch, node, f, saddle, fs (both null for the root) and is_leaf, stored: the tree's nodes with the arc's upper end."""
    leaves = basins.filter("id = basin").select(F.col("id").alias("branch"), F.col("id").alias("node"), "f", F.lit(True).alias("is_leaf"))
    joined = branches(dead.select(F.col("fs").alias("f"), F.col("s").alias("id"), F.col("host").alias("at")), hops)
    inner = joined.select(F.col("at").alias("branch"), F.col("id").alias("node"), "f", F.lit(False).alias("is_leaf")).distinct()
    nodes = stored(leaves.unionByName(inner), "branch-nodes")
    next_ = before(nodes.select(F.col("branch").alias("grp"), "f", F.col("node").alias("id"), F.lit(True).alias("is_node")), descending=True)
    next_ = next_.select(F.col("id").alias("n_id"), "prev", F.col("prev_f").cast("float").alias("prev_f"))
    made = nodes.join(next_, F.col("node") == F.col("n_id")).join(dead.select("u", F.col("fs").alias("end_f"), F.col("s").alias("end")), F.col("branch") == F.col("u"), "left")
    return stored(made.select("branch", "node", "f", F.coalesce("prev", "end").alias("saddle"), F.coalesce("prev_f", "end_f").alias("fs"), "is_leaf"), "nodes")


def branch_labels(basins: DataFrame, dead: DataFrame, hops: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """id, arc and arc_value of every vertex: the greatest node of its branch that is not above it."""
    start = basins.select("f", "id", F.col("basin").alias("at"))
    ended = start.join(dead.select("u", "fs", "s"), F.col("at") == F.col("u"), "left").select("f", "id", "at", (F.col("u").isNotNull() & (value("fs", "s") <= value())).alias("over"))
    ended = stored(ended, "levels")
    rows = ended.filter("NOT over").select("f", "id", "at").unionByName(branches(ended.filter("over").select("f", "id", "at"), hops))
    both = rows.select(F.col("at").alias("grp"), "f", "id", F.lit(False).alias("is_node")).unionByName(nodes.select(F.col("branch").alias("grp"), "f", F.col("node").alias("id"), F.lit(True).alias("is_node")))
    return before(both).filter("NOT is_node").select("id", F.col("prev").alias("arc"), F.col("prev_f").cast("float").alias("arc_value"))
