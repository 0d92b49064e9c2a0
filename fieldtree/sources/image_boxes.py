"""Image files (``.vti``) read by boxes: a partition for each box, which reads its own bytes only.

A file whose first point-data array is raw appended data says where each value is: a plain array by its
place, a zlib one by the sizes of its compressed blocks, which the driver adds up once (one number a block of the file). So
files of any size are read by as many tasks as there are boxes, and where one box is asked for, other bytes aren't read.
(The box is an option and not a pushed filter: Spark 4.1.2 keeps the filters pushed for one query for all later ones
over the same DataFrame.) Arrays in base64 or ASCII, and stores that only Spark reads, take ``vtk_io.read_vti``, one task a file.

NaN values are an error; other types than Float32 and Float64 are, too. Doubles are narrowed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field as attribute
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.grid import HalvedBlocks, halved
from ..operators.halo import ids
from ..schema import FIELD, GridSpec
from .fields import FieldError

#: Bytes of the file that may hold its head, and gaps that are read over rather than sought over.
HEAD, GAP = 1 << 20, 1 << 12
#: A box holds at most so many cells, unless the reader is told.
BOX_CELLS = 1 << 20

# Fixed values of the format.
_FLOATS = {"Float32": "f4", "Float64": "f8"}
_HEADERS = {"UInt32": "u4", "UInt64": "u8"}


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a file that tasks open themselves."""
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/") if uri.startswith("file:") else uri


class NotByBoxes(FieldError):
    """The file is an image, but its values have no place of their own."""


@dataclass(frozen=True)
class Layout:
    """Extents, type and place of a file's values; ``block`` and ``starts`` of compressed ones: bytes a block holds, and where each begins."""

    spec: GridSpec
    dtype: str
    base: int
    block: int = 0
    starts: np.ndarray = attribute(default_factory=lambda: np.empty(0, np.int64), compare=False)


def layout(uri: str) -> Layout:
    """Of a file, by its head, and the table of block sizes if there is one."""
    files, path = store(uri)
    with files.open_input_file(path) as file:
        head = file.read(HEAD)
        start = head.find(b"<AppendedData")
        if start < 0:
            raise NotByBoxes(f"{uri} has no appended data within its first {HEAD} bytes")
        tag = head[start : head.index(b">", start) + 1]
        if b'encoding="raw"' not in tag:
            raise NotByBoxes(f"{uri} has encoded data")
        tree = ElementTree.fromstring(head[:start] + b"</VTKFile>")
        if tree.get("type") != "ImageData":
            raise FieldError(f"{uri} is not an image file")
        extent = [int(x) for x in tree.find("ImageData").get("WholeExtent").split()]
        spec = GridSpec(*(extent[2 * k + 1] - extent[2 * k] + 1 for k in range(3)))
        array = tree.find("ImageData/Piece/PointData/DataArray")
        if array is None:
            raise FieldError(f"{uri} has no point data")
        if array.get("format") != "appended":
            raise NotByBoxes(f"{uri} has inline data")
        if array.get("type") not in _FLOATS:
            raise FieldError(f"point data of type {array.get('type')}; only Float32 and Float64 are read")
        order = "<" if tree.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
        dtype, header = order + _FLOATS[array.get("type")], np.dtype(order + _HEADERS[tree.get("header_type", "UInt32")])
        at = head.index(b"_", start + len(tag)) + 1 + int(array.get("offset", 0))
        number = lambda n, where: np.frombuffer(file.read_at(n * header.itemsize, where), header, n).astype(np.int64)
        size = np.dtype(dtype).itemsize * spec.n
        if not tree.get("compressor"):
            if (n := int(number(1, at)[0])) != size:
                raise FieldError(f"{n} bytes of values for {size}")
            return Layout(spec, dtype, at + header.itemsize)
        if "ZLib" not in tree.get("compressor"):
            raise FieldError(f"no reader for {tree.get('compressor')}")
        blocks, block, last = number(3, at).tolist()
        if block * (blocks - bool(last)) + last != size:
            raise FieldError(f"{block * (blocks - bool(last)) + last} bytes of values for {size}")
        lengths = number(blocks, at + 3 * header.itemsize)
        return Layout(spec, dtype, at + (3 + blocks) * header.itemsize, block, np.r_[0, np.cumsum(lengths)])


@dataclass
class Box(InputPartition):
    """First cells and the cells behind the last; of a compressed file the blocks it needs."""

    lo: tuple[int, int, int]
    hi: tuple[int, int, int]
    first: int = 0
    starts: np.ndarray | None = None


def runs(spec: GridSpec, box: Box) -> np.ndarray:
    """First places in the file's array of the box's rows along x, in order."""
    z, y = np.arange(box.lo[2], box.hi[2]), np.arange(box.lo[1], box.hi[1])
    return (box.lo[0] + y[None, :] * spec.X + z[:, None] * (spec.X * spec.Y)).ravel()


class BoxReader(DataSourceReader):
    """``lo`` and ``hi``: first and last cells of the box that is read, else all cells are."""

    def __init__(self, path: str, cells: int, lo: tuple[int, int, int] | None = None, hi: tuple[int, int, int] | None = None):
        self.path, self.made = path, layout(path)
        spec = self.made.spec
        self.blocks: HalvedBlocks = halved(spec, cells)
        self.lo, self.hi = lo or (0, 0, 0), tuple(c + 1 for c in hi) if hi else (spec.X, spec.Y, spec.Z)

    def partitions(self) -> list[Box]:
        out, size = [], np.dtype(self.made.dtype).itemsize
        for block in range(self.blocks.n):
            corners = self.blocks.corners(block)
            lo, hi = tuple(map(max, corners[0], self.lo)), tuple(map(min, corners[1], self.hi))
            if any(a >= b for a, b in zip(lo, hi)):
                continue
            box = Box(lo, hi)
            if self.made.block:
                first = runs(self.made.spec, Box(lo, tuple(a + 1 for a in lo)))[0] * size // self.made.block
                last = (runs(self.made.spec, Box(tuple(b - 1 for b in hi), hi))[0] + 1) * size - 1
                box.first, box.starts = int(first), self.made.starts[first : last // self.made.block + 2]
            out.append(box)
        return out or [Box((0, 0, 0), (0, 0, 0))]

    def read(self, partition: Box) -> Iterator[pa.RecordBatch]:
        made, size = self.made, np.dtype(self.made.dtype).itemsize
        nx, ny, nz = (b - a for a, b in zip(partition.lo, partition.hi))
        if min(nx, ny, nz) < 1:
            return
        files, path = store(self.path)
        with files.open_input_file(path) as file:
            values = np.empty((nz * ny, nx), np.float32)
            for k, content in enumerate(_contents(file, made, partition, runs(made.spec, partition) * size, nx * size)):
                values[k] = np.frombuffer(content, made.dtype)
        if np.isnan(values).any():
            raise FieldError("NaN in the field")
        z, y, x = (np.broadcast_to(np.arange(a, b).reshape([-1 if k == j else 1 for j in range(3)]), (nz, ny, nx)).ravel() for k, (a, b) in enumerate(zip(reversed(partition.lo), reversed(partition.hi))))
        i, f = ids(made.spec, z, y, x), values.ravel() + np.float32(0)
        for at in range(0, len(i), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(i[cut]), *(pa.array(c[cut].astype(np.int32)) for c in (x, y, z)), pa.array(f[cut])], names=FIELD.names)


def _contents(file: pa.NativeFile, made: Layout, box: Box, starts: np.ndarray, length: int) -> Iterator[bytes]:
    """The bytes of each run: plain ones in reads that join runs across small gaps, compressed ones block by block."""
    if not made.block:
        group = 0
        while group < len(starts):
            end = group + 1
            while end < len(starts) and starts[end] - starts[end - 1] - length <= GAP and starts[end] + length - starts[group] <= HEAD:
                end += 1
            content = file.read_at(int(starts[end - 1] + length - starts[group]), made.base + int(starts[group]))
            for at in (starts[group:end] - starts[group]).tolist():
                yield content[at : at + length]
            group = end
        return
    held, block = -1, b""
    for start in starts.tolist():
        out = b""
        while len(out) < length:
            at = start + len(out)
            if at // made.block != held:
                held = at // made.block
                lo, hi = (int(box.starts[held - box.first + k]) for k in (0, 1))
                block = zlib.decompress(file.read_at(hi - lo, made.base + lo))
            out += block[at % made.block : at % made.block + length - len(out)]
        yield out


class ImageBoxes(DataSource):
    """``spark.read.format("image_boxes").load("volume.vti")``; options ``cells``, the most a box holds, ``lo`` and ``hi``, like ``0,0,9``."""

    @classmethod
    def name(cls) -> str:
        return "image_boxes"

    def schema(self):
        return FIELD

    def reader(self, schema) -> BoxReader:
        ends = [tuple(int(c) for c in self.options[k].split(",")) if k in self.options else None for k in ("lo", "hi")]
        return BoxReader(self.options["path"], int(self.options.get("cells", BOX_CELLS)), *ends)


def read_boxes(spark: SparkSession, path: str, cells: int | None = None, lo: tuple[int, int, int] | None = None, hi: tuple[int, int, int] | None = None) -> tuple[DataFrame, GridSpec]:
    """The field of an image file, or its vertices from ``lo`` to ``hi`` (both included), and the file's extents.

    A partition for each box of at most ``cells`` cells. A box that is outside or empty gives no rows.
    """
    spec = layout(path).spec
    spark.dataSource.register(ImageBoxes)
    cells = cells or min(BOX_CELLS, max(1 << 12, -(-spec.n // spark.sparkContext.defaultParallelism)))
    reader = spark.read.format("image_boxes").option("cells", cells)
    for name, corner in (("lo", lo), ("hi", hi)):
        if corner is not None:
            reader = reader.option(name, ",".join(map(str, corner)))
    return reader.load(path), spec


def appended_image(lo: tuple[int, int, int], hi: tuple[int, int, int], name: str, values: np.ndarray, block: int = 0) -> Iterator[bytes]:
    """The parts of an image file of a box (both ends included), x fastest, with raw appended data; ``block``: bytes a compressed block holds, 0 for plain ones."""
    kind = {"f4": "Float32", "f8": "Float64", "u8": "UInt64", "i8": "Int64"}[values.dtype.str[1:]]
    extent = " ".join(f"{a} {b}" for a, b in zip(lo, hi))
    zipped = ' compressor="vtkZLibDataCompressor"' if block else ""
    yield (
        f'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="1.0" byte_order="LittleEndian" header_type="UInt64"{zipped}>\n<ImageData WholeExtent="{extent}" Origin="0 0 0" Spacing="1 1 1">\n<Piece Extent="{extent}">\n'
        f'<PointData Scalars="{name}">\n<DataArray type="{kind}" Name="{name}" format="appended" offset="0"/>\n</PointData>\n</Piece>\n</ImageData>\n<AppendedData encoding="raw">\n_'
    ).encode()
    raw = values.astype(values.dtype.newbyteorder("<"), copy=False).tobytes()
    if block:
        parts = [zlib.compress(raw[k : k + block]) for k in range(0, len(raw), block)]
        yield np.array([len(parts), block, len(raw) % block, *map(len, parts)], "<u8").tobytes()
        yield from parts
    else:
        yield np.array([len(raw)], "<u8").tobytes()
        yield raw
    yield b"\n</AppendedData>\n</VTKFile>\n"


def image_cells(content: bytes, spec: GridSpec) -> tuple[np.ndarray, np.ndarray]:
    """Ids in the whole grid and values of an image file of a box, as ``appended_image`` writes it without compression."""
    start = content.index(b"<AppendedData")
    tree = ElementTree.fromstring(content[:start] + b"</VTKFile>")
    a, b, c, d, e, f = (int(x) for x in tree.find("ImageData").get("WholeExtent").split())
    kind = {"Float32": "<f4", "Float64": "<f8", "UInt64": "<u8", "Int64": "<i8"}[tree.find("ImageData/Piece/PointData/DataArray").get("type")]
    z, y, x = (np.arange(lo, hi + 1).reshape([-1 if k == j else 1 for j in range(3)]) for k, (lo, hi) in enumerate(((e, f), (c, d), (a, b))))
    place = ids(spec, z, y, x).ravel()
    return place, np.frombuffer(content, kind, len(place), content.index(b"_", start) + 9)
