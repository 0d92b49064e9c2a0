"""Blocks as rows of arrays, and the halo exchange between them.

A block is one row: its number and its values, x fastest. What blocks need of each other are the six faces, so that is
all they send: bytes moved grow with the surfaces of blocks, not with their cells, and inner cells stay in their array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FIELD, GridSpec
from .grid import Blocks, coords

#: The axes x, y, z are the array axes 2, 1, 0.
SIDES = tuple((axis, step) for axis in range(3) for step in (-1, 1))
#: A grown box's own cells.
INNER = (slice(1, -1),) * 3


def shape(blocks: Blocks, block: int) -> tuple[int, int, int]:
    lo, hi = blocks.corners(block)
    return hi[2] - lo[2], hi[1] - lo[1], hi[0] - lo[0]


def cells(blocks: Blocks, block: int, ring: int = 0) -> tuple[np.ndarray, ...]:
    """z, y and x of a block's cells (with a ring around it, also beyond the grid), ready to be broadcast."""
    lo, hi = blocks.corners(block)
    return tuple(np.arange(lo[a] - ring, hi[a] + ring).reshape([-1 if k == 2 - a else 1 for k in range(3)]) for a in (2, 1, 0))


def ids(spec: GridSpec, z: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x + y * spec.X + z * (spec.X * spec.Y)


def face(step: int, axis: int, inside: bool = False) -> tuple[slice, ...]:
    """A grown box's ghost face on a side, or the box's own cells next to it."""
    near = slice(1, 2) if inside else slice(0, 1)
    far = slice(-2, -1) if inside else slice(-1, None)
    return tuple((near if step < 0 else far) if k == 2 - axis else slice(1, -1) for k in range(3))


def tiles(field: DataFrame, blocks: Blocks) -> DataFrame:
    """block and f (32-bit floats, x fastest) of a dense field (id, f). One shuffle of the field; a block that lacks a cell is an error.

    An id that repeats or lies outside is not noticed here: see ``sources.fields.check``.
    """
    spec = blocks.spec

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        lo, _ = blocks.corners(block)
        nz, ny, nx = shape(blocks, block)
        i = table.column("id").to_numpy()
        at = i % spec.X - lo[0] + nx * (i // spec.X % spec.Y - lo[1] + ny * (i // (spec.X * spec.Y) - lo[2]))
        if len(at) != nz * ny * nx:
            raise ValueError(f"block {block} has {len(at)} of {nz * ny * nx} cells")
        out = np.empty(len(at), np.float32)
        out[at] = table.column("f").to_numpy()
        return pa.table({"block": pa.array([block], pa.int32()), "f": pa.array([(out + np.float32(0)).tobytes()], pa.binary())})

    at = coords(spec)
    placed = field.select("id", "f").withColumn("block", blocks.index(at["x"], at["y"], at["z"]))
    return placed.groupBy("block").applyInArrow(pack, "block int, f binary")


def untiled(made: DataFrame, blocks: Blocks) -> DataFrame:
    """The field (id, x, y, z, f) of ``tiles``; no shuffle."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FIELD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, f in zip(batch.column("block").to_pylist(), batch.column("f").to_pylist()):
                yield from cell_rows(blocks, block, {"f": np.frombuffer(f, np.float32)})

    return made.select("block", "f").mapInArrow(run, schema)


def cell_rows(blocks: Blocks, block: int, columns: dict[str, np.ndarray], step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """id, x, y, z and given columns of a block's cells, in batches."""
    size = shape(blocks, block)
    z, y, x = (np.broadcast_to(c, size).ravel() for c in cells(blocks, block))
    i = ids(blocks.spec, z, y, x)
    for lo in range(0, len(i), step):
        cut = slice(lo, lo + step)
        yield pa.RecordBatch.from_arrays([pa.array(i[cut]), *(pa.array(c[cut].astype(np.int32)) for c in (x, y, z)), *(pa.array(c[cut]) for c in columns.values())], names=["id", "x", "y", "z", *columns])


def faces(made: DataFrame, blocks: Blocks) -> DataFrame:
    """block (that gets it), axis, step (the side of it that it lies on) and f: each block's outer cells, for the blocks beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, f in zip(batch.column("block").to_pylist(), batch.column("f").to_pylist()):
                values = np.frombuffer(f, np.float32).reshape(shape(blocks, block))
                for axis, step in SIDES:
                    to = blocks.beside(block, axis, step)
                    if to is not None:
                        rows.append((to, axis, -step, np.take(values, 0 if step < 0 else -1, 2 - axis).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "axis", "step", "f"])

    return made.select("block", "f").mapInArrow(run, "block int, axis int, step int, f binary")


def grown(blocks: Blocks, block: int, f: bytes, around: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's values with those of its faces around them, and which cells of the grown box there are."""
    size = shape(blocks, block)
    values = np.zeros(tuple(n + 2 for n in size), np.float32)
    values[INNER] = np.frombuffer(f, np.float32).reshape(size)
    for axis, step, content in zip(*(around.column(c).to_pylist() for c in ("axis", "step", "f"))):
        at = face(step, axis)
        values[at] = np.frombuffer(content, np.float32).reshape(values[at].shape)
    return values, present(blocks, block)


def present(blocks: Blocks, block: int) -> np.ndarray:
    """Which cells of a block's grown box there are: its own and those of the faces beside it."""
    there = np.zeros(tuple(n + 2 for n in shape(blocks, block)), bool)
    there[INNER] = True
    for axis, step in SIDES:
        there[face(step, axis)] = blocks.beside(block, axis, step) is not None
    return there


def beside_rows(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """Rows (id and more) of outer cells, one for each block next to the cell, which becomes ``block``."""
    at = coords(blocks.spec)
    own = blocks.index(at["x"], at["y"], at["z"])
    near = []
    for axis, name in enumerate("xyz"):
        extent = (blocks.spec.X, blocks.spec.Y, blocks.spec.Z)[axis]
        for step in (-1, 1):
            moved = {c: at[c] + step if c == name else at[c] for c in "xyz"}
            inside = (moved[name] >= 0) & (moved[name] < extent)
            other = blocks.index(moved["x"], moved["y"], moved["z"])
            near.append(F.when(inside & (other != own), other))
    return rows.withColumn("block", F.explode(F.array_distinct(F.array_compact(F.array(*near)))))


def local_minima(made: DataFrame, blocks: Blocks) -> DataFrame:
    """block and id of the minima among each block's own cells, which a block with its halo tells by itself."""

    def find(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        block = key[0].as_py()
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "id": pa.array([], pa.int64())})
        values, there = grown(blocks, block, left.column("f")[0].as_py(), right)
        rank = ranks(values, there)[0]
        low = np.ones(shape(blocks, block), bool)
        for other in around(rank):
            low &= rank[INNER] < other
        z, y, x = cells(blocks, block)
        found = np.broadcast_to(ids(blocks.spec, z, y, x), low.shape)[low]
        return pa.table({"block": pa.array(np.full(len(found), block, np.int32)), "id": pa.array(found)})

    return made.groupBy("block").cogroup(faces(made, blocks).groupBy("block")).applyInArrow(find, "block int, id long")


def ranks(values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of a grown box's cells by (f, id), and the places of the ranks; cells that aren't there come last. Ids rise with the place."""
    order = np.argsort(np.where(there, values, np.inf).ravel(), kind="stable")
    order = order[np.argsort(~there.ravel()[order], kind="stable")]
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out.reshape(values.shape), order


def around(grown_: np.ndarray) -> Iterator[np.ndarray]:
    """A grown array as seen from each own cell's six neighbours."""
    for axis, step in SIDES:
        yield grown_[tuple(slice(1 + step, grown_.shape[k] - 1 + step) if k == 2 - axis else slice(1, -1) for k in range(3))]
