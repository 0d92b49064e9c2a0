"""Data model: grid extents, and the tables that operators exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class GridSpec:
    """Extents of a dense grid; the id of a vertex is ``x + y*X + z*X*Y``."""

    X: int
    Y: int = 1
    Z: int = 1

    def __post_init__(self) -> None:
        if min(self.X, self.Y, self.Z) < 1:
            raise ValueError(f"a grid needs at least one vertex on each axis: {self}")

    @property
    def n(self) -> int:
        return self.X * self.Y * self.Z

    @property
    def strides(self) -> tuple[int, int, int]:
        return 1, self.X, self.X * self.Y


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


#: A scalar field: one row per vertex.
FIELD = _struct(("id", T.LongType(), False), ("x", T.IntegerType(), False), ("y", T.IntegerType(), False), ("z", T.IntegerType(), False), ("f", T.FloatType(), False))
#: An arc: its lower end, its upper end (null for the root), and whether the lower end is a minimum.
ARCS = _struct(("extremum", T.LongType(), False), ("saddle", T.LongType(), True), ("is_leaf", T.BooleanType(), False))
#: The arc of each vertex, by the arc's lower end, and the field's value there.
LABELS = _struct(("id", T.LongType(), False), ("arc", T.LongType(), False), ("arc_value", T.FloatType(), False))
