"""Grid arithmetic: coordinates, neighbours, blocks with ghost cells, owners.

All of it is arithmetic on the id, so no index is kept and no data moves, but for ``edges``, the one
equi-join that fetches the far end's value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GridSpec


def coords(spec: GridSpec, id: str | Column = "id") -> dict[str, Column]:
    """x, y and z of an id."""
    i = F.col(id) if isinstance(id, str) else id
    over = lambda n: F.call_function("div", i, F.lit(n).cast("long"))
    return {"x": (i % spec.X).cast("int"), "y": (over(spec.X) % spec.Y).cast("int"), "z": over(spec.X * spec.Y).cast("int")}


def with_coords(df: DataFrame, spec: GridSpec) -> DataFrame:
    return df.withColumns(coords(spec))


def id_of(spec: GridSpec, x: Column, y: Column, z: Column) -> Column:
    return x.cast("long") + y.cast("long") * spec.X + z.cast("long") * (spec.X * spec.Y)


#: Bits of the neighbour mask, from low to high.
SIDES = ("+z", "-z", "+y", "-y", "+x", "-x")
GHOST_BIT = 7


def has_side(spec: GridSpec, side: str, lo: tuple[Column, ...] | None = None, hi: tuple[Column, ...] | None = None) -> Column:
    """Whether a vertex (with x, y, z) has a neighbour on a side, within the grid or a box."""
    axis = "xyz".index(side[1])
    at, extent = F.col(side[1]), (spec.X, spec.Y, spec.Z)[axis]
    if side[0] == "-":
        return at > (F.lit(0) if lo is None else lo[axis])
    return at < (F.lit(extent - 1) if hi is None else hi[axis])


def neighbour_mask(spec: GridSpec, ghost: Column | None = None, lo: tuple[Column, ...] | None = None, hi: tuple[Column, ...] | None = None) -> Column:
    """A byte with a bit for each side that has a neighbour, and one for ghost cells."""
    out = F.lit(0)
    for bit, side in enumerate(SIDES):
        out = out + F.when(has_side(spec, side, lo, hi), 1 << bit).otherwise(0)
    return out + F.when(ghost, 1 << GHOST_BIT).otherwise(0) if ghost is not None else out


def neighbours(df: DataFrame, spec: GridSpec, forward: bool = False) -> DataFrame:
    """``df`` with nid, a row for each neighbour; ``forward``: only those with a larger id."""
    offsets = dict(zip("xyz", spec.strides))
    sides = [s for s in SIDES if not forward or s[0] == "+"]
    listed = F.array(*(F.when(has_side(spec, s), F.col("id") + (offsets[s[1]] if s[0] == "+" else -offsets[s[1]])) for s in sides))
    return df.withColumn("nid", F.explode(F.array_compact(listed)))


def edges(field: DataFrame, spec: GridSpec) -> DataFrame:
    """Undirected edges once each: u, fu, v, fv with u < v.

    Each vertex lists at most three forward neighbours; one equi-join on the id fetches their values.
    """
    listed = neighbours(field, spec, forward=True).select(F.col("id").alias("u"), F.col("f").alias("fu"), "nid")
    far = field.select(F.col("id").alias("v"), F.col("f").alias("fv"))
    return listed.join(far, F.col("nid") == F.col("v")).select("u", "fu", "v", "fv")


def degree(field: DataFrame, spec: GridSpec) -> DataFrame:
    """id and its number of neighbours."""
    out = F.lit(0).cast("long")
    for side in SIDES:
        out = out + F.when(has_side(spec, side), 1).otherwise(0)
    return field.select("id", out.alias("degree"))


@dataclass(frozen=True)
class Blocks:
    """A decomposition into boxes: blocks per axis, and the cells of a box (the last one takes the rest)."""

    spec: GridSpec
    count: tuple[int, int, int]
    size: tuple[int, int, int]

    @property
    def n(self) -> int:
        a, b, c = self.count
        return a * b * c

    def number(self, at: tuple[int, int, int]) -> int:
        """The number of the box at a place of the lattice of boxes."""
        return at[0] + at[1] * self.count[0] + at[2] * self.count[0] * self.count[1]

    def place(self, block: int) -> tuple[int, int, int]:
        a, b, _ = self.count
        return block % a, block // a % b, block // (a * b)

    def corners(self, block: int) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
        """First cells of a box, and the cells behind its last."""
        spans = [self._span(k, i) for k, i in enumerate(self.place(block))]
        return tuple(s[0] for s in spans), tuple(s[1] for s in spans)

    def _span(self, axis: int, i: int) -> tuple[int, int]:
        e = (self.spec.X, self.spec.Y, self.spec.Z)[axis]
        return i * self.size[axis], e if i == self.count[axis] - 1 else (i + 1) * self.size[axis]

    def beside(self, block: int, axis: int, step: int) -> int | None:
        """The box next to a box, or none."""
        at = list(self.place(block))
        at[axis] += step
        return self.number(tuple(at)) if 0 <= at[axis] < self.count[axis] else None

    def regions(self, level: int) -> int:
        """How many regions of that level there are: a region joins two boxes, or regions of the level below, on each axis."""
        return math.prod(-(-k // (1 << level)) for k in self.count)

    def region(self, block: Column, level: int) -> Column:
        """The region of a level that a box is in."""
        a, b, _ = self.count
        at = (block % a, F.floor(block / a) % b, F.floor(block / (a * b)))
        wide = [-(-k // (1 << level)) for k in self.count]
        x, y, z = (F.floor(c / (1 << level)) for c in at)
        return (x + y * wide[0] + z * (wide[0] * wide[1])).cast("int")

    def index(self, x: Column, y: Column, z: Column) -> Column:
        """The owner of a cell."""
        at = [F.least(F.floor(c / s), F.lit(k - 1)) for c, s, k in zip((x, y, z), self.size, self.count)]
        return (at[0] + at[1] * self.count[0] + at[2] * (self.count[0] * self.count[1])).cast("int")

    def box(self, block: Column) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
        """First and last cell of a block on each axis."""
        a, b, _ = self.count
        at = (block % a, F.floor(block / a) % b, F.floor(block / (a * b)))
        lo = tuple((k * s).cast("int") for k, s in zip(at, self.size))
        hi = tuple(F.when(k == n - 1, F.lit(e - 1)).otherwise(k * s + s - 1).cast("int") for k, s, n, e in zip(at, self.size, self.count, (self.spec.X, self.spec.Y, self.spec.Z)))
        return lo, hi


@dataclass(frozen=True)
class HalvedBlocks(Blocks):
    """Boxes by halving, numbered by the cuts that lead to them (Z-order), so that a prefix of the number is a region.

    ``cuts`` has the axis of each cut, the first one first; ``size`` is the largest box. An axis that is cut k times has
    2**k boxes, whose extents differ by one cell at most.
    """

    cuts: tuple[int, ...] = ()

    def number(self, at: tuple[int, int, int]) -> int:
        out, left = 0, [c.bit_length() - 1 for c in self.count]
        for axis in self.cuts:
            left[axis] -= 1
            out = out << 1 | at[axis] >> left[axis] & 1
        return out

    def place(self, block: int) -> tuple[int, int, int]:
        at = [0, 0, 0]
        for k, axis in enumerate(self.cuts):
            at[axis] = at[axis] << 1 | block >> len(self.cuts) - 1 - k & 1
        return tuple(at)

    def _span(self, axis: int, i: int) -> tuple[int, int]:
        e, n = (self.spec.X, self.spec.Y, self.spec.Z)[axis], self.count[axis]
        return i * e // n, (i + 1) * e // n

    def regions(self, level: int) -> int:
        return max(1, self.n >> 3 * level)

    def region(self, block: Column, level: int) -> Column:
        return F.shiftright(block, min(3 * level, 31)).cast("int")

    def index(self, x: Column, y: Column, z: Column) -> Column:
        at = [F.call_function("div", (c.cast("long") + 1) * n - 1, F.lit(e).cast("long")) for c, n, e in zip((x, y, z), self.count, (self.spec.X, self.spec.Y, self.spec.Z))]
        out, left = F.lit(0).cast("long"), [c.bit_length() - 1 for c in self.count]
        for k, axis in enumerate(self.cuts):
            left[axis] -= 1
            out = out + F.shiftleft(F.shiftright(at[axis], left[axis]).bitwiseAND(F.lit(1).cast("long")), len(self.cuts) - 1 - k)
        return out.cast("int")

    def box(self, block: Column) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
        at = [F.lit(0).cast("long")] * 3
        for k, axis in enumerate(self.cuts):
            at[axis] = at[axis] * 2 + F.shiftright(block.cast("long"), len(self.cuts) - 1 - k).bitwiseAND(F.lit(1).cast("long"))
        over = lambda c, e, n: F.call_function("div", c * e, F.lit(n).cast("long")).cast("int")
        sides = list(zip(at, (self.spec.X, self.spec.Y, self.spec.Z), self.count))
        return tuple(over(c, e, n) for c, e, n in sides), tuple(over(c + 1, e, n) - 1 for c, e, n in sides)


def halved(spec: GridSpec, most: int) -> HalvedBlocks:
    """Boxes of at most ``most`` cells, eight or more: the longest axis is halved, the first of equals, until they are small enough.

    A box keeps at least one cell on each axis. No axis of a box is more than twice as long as another (rounded up to a cell), unless the grid itself is shorter there.
    """
    if most < 8:
        raise ValueError("a block needs room for two cells on each axis")
    extents, cuts = (spec.X, spec.Y, spec.Z), []
    count, size = [1, 1, 1], list(extents)
    while math.prod(size) > most:
        axis = size.index(max(size))
        cuts.append(axis)
        count[axis] *= 2
        size[axis] = -(-extents[axis] // count[axis])
    return HalvedBlocks(spec, tuple(count), tuple(size), tuple(cuts))


def prime_factors(n: int) -> list[int]:
    """Ascending, with repeats."""
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out + [n] * (n > 1)


def decompose(spec: GridSpec, blocks: int) -> Blocks:
    """Boxes for a number of workers: each factor cuts the axis that is longest so far, the first of equals.

    A box keeps at least one cell on each axis, and boxes cover the grid, so there can be fewer than
    asked for.
    """
    if blocks < 1:
        raise ValueError("at least one block")
    size = [spec.X, spec.Y, spec.Z]
    for p in prime_factors(blocks):
        axis = size.index(max(size))
        size[axis] = max(1, size[axis] // p)
    count = tuple(max(1, e // s) for e, s in zip((spec.X, spec.Y, spec.Z), size))
    return Blocks(spec, count, tuple(size))


def block_of(field: DataFrame, blocks: Blocks) -> DataFrame:
    """``field`` with its owning block."""
    return field.withColumn("block", blocks.index(F.col("x"), F.col("y"), F.col("z")))


def ghosted(field: DataFrame, blocks: Blocks) -> DataFrame:
    """The block view: a row for each block whose box, grown by one cell inside the grid, holds the vertex.

    A cell can only lie in the boxes of its own block and of the six around it, or their diagonals, so
    the candidates are the owners of the 27 cells around it; no join is needed.
    """
    near = F.array(*(blocks.index(*(F.least(F.greatest(F.col(c) + d, F.lit(0)), F.lit(e - 1)) for c, d, e in zip("xyz", shift, (blocks.spec.X, blocks.spec.Y, blocks.spec.Z)))) for shift in [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    own = blocks.index(F.col("x"), F.col("y"), F.col("z"))
    return field.withColumn("owner", own).withColumn("block", F.explode(F.array_distinct(near))).withColumn("is_ghost", F.col("block") != F.col("owner"))


def owned(view: DataFrame) -> DataFrame:
    """The rows of a block view that aren't ghost cells: each vertex once, in its own block."""
    return view.filter("NOT is_ghost")


def local_coords(view: DataFrame, blocks: Blocks) -> DataFrame:
    """The block view with coordinates, index and neighbour mask within the grown box.

    ``gx, gy, gz`` are the grown box's first cell; ``local_idx`` counts its cells, x fastest.
    """
    lo, hi = blocks.box(F.col("block"))
    first = [F.greatest(a - 1, F.lit(0)) for a in lo]
    last = [F.least(b + 1, F.lit(e - 1)) for b, e in zip(hi, (blocks.spec.X, blocks.spec.Y, blocks.spec.Z))]
    span = [b - a + 1 for a, b in zip(first, last)]
    place = [F.col(c) - a for c, a in zip("xyz", first)]
    index = place[0].cast("long") + place[1] * span[0] + place[2] * span[0] * span[1]
    return view.withColumns({"gx": first[0], "gy": first[1], "gz": first[2], "lx": place[0], "ly": place[1], "lz": place[2], "local_idx": index, "mask": neighbour_mask(blocks.spec, F.col("is_ghost"), tuple(first), tuple(last))})


def global_id(view: DataFrame, spec: GridSpec) -> DataFrame:
    """The ids of a block view from its local coordinates; the inverse of ``local_coords``."""
    return view.withColumn("gid", id_of(spec, F.col("gx") + F.col("lx"), F.col("gy") + F.col("ly"), F.col("gz") + F.col("lz")))
