"""The total order of vertices: by value, ties by id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(f: str | Column = "f", id: str | Column = "id") -> Column:
    """A vertex as a comparable struct. Negative zero is zero."""
    column = F.col(f) if isinstance(f, str) else f
    return F.struct((column + F.lit(0.0).cast("float")).alias("f"), (F.col(id) if isinstance(id, str) else id).alias("id"))


def show_value(v: Column) -> Column:
    """A vertex for reading: value and id."""
    return F.format_string("%s@%d", v["f"].cast("string"), v["id"])


def byte_string(n: Column) -> Column:
    """A number of bytes with a binary unit and two decimals."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB", "EB"), 1):
        out = F.when(n >= F.lit(1 << 10 * k), F.format_string(f"%.2f {unit}", n / F.lit(float(1 << 10 * k)))).otherwise(out)
    return out
