"""Fields from tables: binned counts, array columns, or ready (id, f) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import with_coords
from ..schema import FIELD, GridSpec


def vertices(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """All ids of a grid."""
    return spark.range(spec.n)


def _field(df: DataFrame, spec: GridSpec) -> DataFrame:
    # Negative zero becomes zero, so that equal values group together.
    rows = df.select(F.col("id").cast("long").alias("id"), (F.col("f").cast("float") + F.lit(0.0).cast("float")).alias("f"))
    return with_coords(rows, spec).select(*FIELD.names)


def from_values(df: DataFrame, spec: GridSpec) -> DataFrame:
    """A field from rows (id, f); doubles are narrowed. ``check`` tells whether it is dense and finite."""
    return _field(df, spec)


def binned(table: DataFrame, cell: Column, spec: GridSpec) -> DataFrame:
    """Rows per cell; cells without rows are 0. Rows outside the grid are left out."""
    counts = table.select(cell.cast("long").alias("cell")).filter((F.col("cell") >= 0) & (F.col("cell") < spec.n)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    grid = vertices(table.sparkSession, spec)
    return _field(grid.join(counts, F.col("id") == F.col("cell"), "left").select("id", F.coalesce("n", F.lit(0)).alias("f")), spec)


def filled(rows: DataFrame, spec: GridSpec, default: float) -> DataFrame:
    """A dense field from rows (id, f) of some of its vertices; the others, and those whose value is null, get ``default``.

    Ids outside the grid and null ids are left out; ids must not repeat. An empty table gives a field of the default only.
    """
    given = rows.select(F.col("id").alias("_id"), F.col("f").alias("_f"))
    return _field(vertices(rows.sparkSession, spec).join(given, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_f", F.lit(default)).alias("f")), spec)


def from_arrays(table: DataFrame, key: str, values: str, spec: GridSpec) -> DataFrame:
    """An array column as rows of a grid: x is the place in the array, y the key."""
    made = table.select(F.col(key).alias("k"), F.posexplode(values).alias("pos", "f"))
    return _field(made.select((F.col("pos") + F.col("k") * spec.X).alias("id"), "f"), spec)


def box(field: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """The vertices of a box, both ends included; a filter that reaches the scan."""
    out = field
    for c, a, b in zip("xyz", lo, hi):
        out = out.filter(F.col(c).between(a, b))
    return out


def value_at(ids: DataFrame, field: DataFrame) -> DataFrame:
    """Values of some ids (id); null where the id is null or outside the field."""
    return ids.join(field.select("id", "f"), "id", "left")


def counts(view: DataFrame) -> DataFrame:
    """Of a block view: vertices with and without ghosts per block."""
    return view.groupBy("block").agg(F.count(F.lit(1)).alias("vertices"), F.count_if(~F.col("is_ghost")).alias("own"))


class FieldError(ValueError):
    pass


def check(field: DataFrame, spec: GridSpec) -> DataFrame:
    """``field``, after one aggregation by id that it is dense, without nulls, NaN and repeated ids; else FieldError.

    An empty table is a FieldError too, since no grid is empty. Other columns are kept.
    """
    own = field.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f").isNull() | F.isnan("f")).alias("bad"))
    row = own.agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.count_if(F.col("n") > 1).alias("again"),
        F.count_if(F.col("id").isNull() | (F.col("id") < 0) | (F.col("id") >= spec.n)).alias("outside"),
    ).first()
    if row.bad:
        raise FieldError(f"{row.bad} values are null or NaN")
    if row.outside:
        raise FieldError(f"{row.outside} ids are outside the grid")
    if row.again:
        raise FieldError(f"{row.again} ids repeat")
    if row.n != spec.n:
        raise FieldError(f"the field has {row.n or 0} rows, the grid {spec.n} vertices")
    return field


def load_field(spark: SparkSession, source: str | DataFrame, spec: GridSpec | None = None) -> tuple[DataFrame, GridSpec]:
    """A field and its extents, by kind: an image file (``.vti``), a Parquet path, or a DataFrame.

    The suffix is case-sensitive. Parquet and DataFrames hold (id, f) and need ``spec``.
    """
    if isinstance(source, str) and source.endswith(".vti"):
        from .image_boxes import NotByBoxes, read_boxes
        from .vtk_io import read_vti

        try:
            return read_boxes(spark, source)
        except (NotByBoxes, OSError, ValueError) as error:  # base64 or ASCII, or a store that only Spark reads
            if isinstance(error, FieldError) and not isinstance(error, NotByBoxes):
                raise
            return read_vti(spark, source)
    if isinstance(source, str) and not source.endswith(".parquet"):
        raise FieldError(f"no reader for {source}")
    if spec is None:
        raise FieldError("a table needs the grid's extents")
    df = spark.read.parquet(source) if isinstance(source, str) else source
    return from_values(df, spec), spec
