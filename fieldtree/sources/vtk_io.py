"""VTK XML image files that can't be read by boxes (see ``image_boxes``), and the rows of output files (``file_set`` writes these).

Files are read by Spark (``binaryFile``), so any store that it reads will do; the header is parsed on
the driver and values in a task. Inline base64 and ASCII arrays, and raw appended data, plain or zlib
compressed, are read. The first point-data array is the field; only Float32 and Float64 are accepted.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Blocks, with_coords
from ..schema import FIELD, GridSpec
from .fields import FieldError

# Fixed values of the format.
VTK_TYPES = {"Float32": "f4", "Float64": "f8", "UInt64": "u8", "Int64": "i8", "UInt32": "u4", "Int32": "i4", "UInt8": "u1", "Int8": "i1", "UInt16": "u2", "Int16": "i2"}


def _decode(data: bytes, header: str, compressed: bool) -> bytes:
    """The content of an encoded array: a size or a block table ahead of the bytes."""
    size = np.dtype(header).itemsize
    if not compressed:
        n = int(np.frombuffer(data, header, 1)[0])
        return data[size : size + n]
    blocks = int(np.frombuffer(data, header, 1)[0])
    lengths = np.frombuffer(data, header, blocks, 3 * size).astype(int)
    at, out = (3 + blocks) * size, []
    for n in lengths:
        out.append(zlib.decompress(data[at : at + n]))
        at += n
    return b"".join(out)


def _base64(text: str, header: str, compressed: bool) -> bytes:
    """Header and content may be two base64 runs; decoding run by run takes both."""
    joined = b"".join(base64.b64decode(m) for m in re.findall(r"[A-Za-z0-9+/]+={0,2}", text.strip()))
    return _decode(joined, header, compressed)


def parse_vti(data: bytes) -> tuple[GridSpec, np.ndarray]:
    """Extents and values (float32, x fastest) of an image file."""
    start = data.find(b"<AppendedData")
    appended, head = b"", data
    raw = False
    if start >= 0:
        tag = data[start : data.index(b">", start) + 1]
        raw = b'encoding="raw"' in tag
        mark = data.index(b"_", start + len(tag)) + 1
        end = data.rindex(b"</AppendedData>")
        appended, head = data[mark:end], data[:start] + b"</VTKFile>"
    tree = ElementTree.fromstring(head)
    if tree.get("type") != "ImageData":
        raise FieldError("not an image file")
    order = "<" if tree.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
    header = order + VTK_TYPES[tree.get("header_type", "UInt32")]
    compressed = bool(tree.get("compressor"))
    if compressed and "ZLib" not in tree.get("compressor"):
        raise FieldError(f"no reader for {tree.get('compressor')}")
    extent = [int(x) for x in tree.find("ImageData").get("WholeExtent").split()]
    spec = GridSpec(*(extent[2 * k + 1] - extent[2 * k] + 1 for k in range(3)))
    array = tree.find("ImageData/Piece/PointData/DataArray")
    if array is None:
        raise FieldError("the file has no point data")
    kind = array.get("type")
    if kind not in ("Float32", "Float64"):
        raise FieldError(f"point data of type {kind}; only Float32 and Float64 are read")
    form = array.get("format", "ascii")
    if form == "ascii":
        values = np.array((array.text or "").split(), order + VTK_TYPES[kind])
    else:
        if form == "appended":
            at = int(array.get("offset", 0))
            content = _decode(appended[at:], header, compressed) if raw else _base64(appended[at:].decode().split("<")[0], header, compressed)
        else:
            content = _base64(array.text or "", header, compressed)
        values = np.frombuffer(content, order + VTK_TYPES[kind])
    if len(values) != spec.n:
        raise FieldError(f"{len(values)} values for {spec.n} vertices")
    return spec, values.astype(np.float32)


def vti_size(spark: SparkSession, path: str, head_bytes: int = 1 << 16) -> GridSpec:
    """Extents of an image file, by its head alone."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, head_bytes).alias("head")).first()
    found = re.search(rb'WholeExtent="([^"]+)"', row.head)
    if not found:
        raise FieldError(f"{path} has no extents")
    extent = [int(x) for x in found[1].split()]
    return GridSpec(*(extent[2 * k + 1] - extent[2 * k] + 1 for k in range(3)))


def read_vti(spark: SparkSession, path: str) -> tuple[DataFrame, GridSpec]:
    """The field of an image file. One file is one task's read, as the format can't be split."""
    spec = vti_size(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                _, values = parse_vti(data)
                if np.isnan(values).any():
                    raise FieldError("NaN in the field")
                for lo in range(0, len(values), 1 << 16):
                    part = values[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.array(part)], names=["id", "f"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, f float")
    return with_coords(rows, spec).select(*FIELD.names), spec


def arc_lines(arcs: DataFrame, spec: GridSpec) -> DataFrame:
    """Arcs with a saddle as line segments: extremum, saddle and both ends' coordinates."""
    from ..operators.grid import coords

    ends = {f"{c}{k}": e for k, n in enumerate(("extremum", "saddle")) for c, e in coords(spec, n).items()}
    return arcs.filter("saddle IS NOT NULL").select("extremum", "saddle", *(e.alias(n) for n, e in ends.items()))


def write_labels(labels: DataFrame, spec: GridSpec, blocks: Blocks, path: str) -> None:
    """Labels as Parquet, a folder per block."""
    with_coords(labels, spec).withColumn("block", blocks.index(F.col("x"), F.col("y"), F.col("z"))).write.partitionBy("block").parquet(path)
