"""What the operators of this subpackage share: tables, scratch space, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh as scratch
from ..storage import discarded, shared_dir, stored

__all__ = ["discarded", "open_shared", "row_map", "scratch", "shared_dir", "slices", "stored", "table", "to_arrow", "trimmed", "unused", "utf8"]

#: Rows of one output batch hold at most about this many bytes of text.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column) -> Column:
    """Whole text as UTF-8 bytes; null counts as empty."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, with underscores ahead until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def row_map(df: DataFrame, schema: str, function: Callable[..., tuple], names: list[str], before: Callable[[], object] | None = None) -> DataFrame:
    """Apply ``function(*values)`` to the columns ``names`` of every row, in Arrow batches of bounded bytes.

    ``before``, if given, runs once in each task; its result is passed first. A row gives one row.
    """
    arrow = to_arrow(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (before(),) if before else ()
        for batch in batches:
            for part in slices(batch):
                rows = [function(*state, *values) for values in zip(*(part.column(n).to_pylist() for n in names))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.select(*names).mapInArrow(lambda batches: trimmed(run(batches)), schema)


def to_arrow(df: DataFrame, schema: str) -> pa.Schema:
    """The Arrow form of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch, each of bounded bytes (a single longer row stands alone)."""
    if batch.num_rows == 0:
        return
    step = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, BATCH_BYTES))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, and then the memory that the worker has freed goes back to the system: the engine keeps workers for
    later stages, which need it."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another system's library
        pass


def open_shared(uri: str, mode: str):
    """A binary file in the shared folder: by the operating system where it is a file system path, else by Arrow."""
    if "://" not in uri or uri.startswith("file:"):
        path = local_path(uri)
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if mode == "wb" else store.open_input_stream(path)


def local_path(uri: str) -> str:
    return "/" + uri.split(":", 1)[1].lstrip("/") if uri.startswith("file:") else uri
