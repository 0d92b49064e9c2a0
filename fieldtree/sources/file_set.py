"""Files written by tasks: one for each row, visible only once the whole write is committed.

A task writes under names that start with a dot; the commit on the driver gives them their own names, and an abort deletes them.
A task that fails deletes what it has begun; so does one whose result isn't wanted (a second attempt has names of its own).
Rows are (name, content); a row's content is what a task must hold. What the driver gets is a name a file.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.grid import Blocks, coords
from ..operators.halo import shape
from ..schema import GridSpec
from .image_boxes import appended_image, store

#: Lines of one piece of a poly-data file.
PIECE_LINES = 1 << 18


@dataclass
class Written(WriterCommitMessage):
    """Temporary and own names of a task's files."""

    names: list[tuple[str, str]]


class FileSetWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, index: str | None = None):
        self.folder, self.index = folder.rstrip("/"), index

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = store(self.folder)
        files.create_dir(path, recursive=True)
        names: list[tuple[str, str]] = []
        try:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                    if "/" in name:
                        raise ValueError(f"{name} is not a plain file name")
                    names.append((f".{name}.{uuid.uuid4().hex}", name))
                    with files.open_output_stream(f"{path}/{names[-1][0]}") as out:
                        out.write(content)
        except BaseException:
            self._delete(names)
            raise
        return Written(names)

    def _delete(self, names: list[tuple[str, str]]) -> None:
        files, path = store(self.folder)
        for hidden, _ in names:
            with contextlib.suppress(OSError):
                files.delete_file(f"{path}/{hidden}")

    def commit(self, messages: list[Written | None]) -> None:
        files, path = store(self.folder)
        names = sorted(n for m in messages if m for n in m.names)
        own = [name for _, name in names]
        if len(set(own)) < len(own):
            self._delete(names)
            raise ValueError("two rows have one file name")
        for hidden, name in names:
            files.move(f"{path}/{hidden}", f"{path}/{name}")
        if self.index:
            with files.open_output_stream(f"{path}/{self.index}") as out:
                out.write(index_xml(sorted(own)))

    def abort(self, messages: list[Written | None]) -> None:
        self._delete([n for m in messages if m for n in m.names])


class FileSet(DataSource):
    """``df.write.format("file_set").mode("append").save(folder)`` of rows (name, content); option ``index``: a ``.pvtp`` head that lists them."""

    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileSetWriter:
        return FileSetWriter(self.options["path"], self.options.get("index"))


def save_files(rows: DataFrame, folder: str, index: str | None = None) -> None:
    rows.sparkSession.dataSource.register(FileSet)
    writer = rows.select("name", "content").write.format("file_set").mode("append")
    (writer.option("index", index) if index else writer).save(folder)


def label_files(labels: DataFrame, blocks: Blocks) -> DataFrame:
    """name and content of an image file ``output_<block>.vti`` for each block: the arc of every vertex of its own (``labels``: id, arc), as 64-bit unsigned numbers.

    A block that lacks a label, or has one twice, is an error.
    """
    spec, at = blocks.spec, coords(blocks.spec)

    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        lo, hi = blocks.corners(block)
        nz, ny, nx = shape(blocks, block)
        i = table.column("id").to_numpy()
        out, seen = np.zeros(nx * ny * nz, np.uint64), np.zeros(nx * ny * nz, bool)
        place = i % spec.X - lo[0] + nx * (i // spec.X % spec.Y - lo[1] + ny * (i // (spec.X * spec.Y) - lo[2]))
        out[place], seen[place] = table.column("arc").to_numpy(), True
        if len(i) != len(out) or not seen.all():
            raise ValueError(f"block {block} has {len(i)} labels for {len(out)} vertices")
        content = b"".join(appended_image(lo, tuple(c - 1 for c in hi), "arc", out))
        return pa.table({"name": pa.array([f"output_{block}.vti"]), "content": pa.array([content], pa.binary())})

    placed = labels.select("id", "arc").withColumn("block", blocks.index(at["x"], at["y"], at["z"]))
    return placed.groupBy("block").applyInArrow(make, "name string, content binary")


def field_files(made: DataFrame, blocks: Blocks) -> DataFrame:
    """name and content of an image file ``output_<block>.vti`` for each block of a field (``halo.tiles``), as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, f in zip(batch.column("block").to_pylist(), batch.column("f").to_pylist()):
                lo, hi = blocks.corners(block)
                content = b"".join(appended_image(lo, tuple(c - 1 for c in hi), "f", np.frombuffer(f, np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array([f"output_{block}.vti"]), pa.array([content], pa.binary())], names=["name", "content"])

    return made.select("block", "f").mapInArrow(run, "name string, content binary")


def line_files(lines: DataFrame, piece: int = PIECE_LINES) -> DataFrame:
    """name and content of poly-data files of at most ``piece`` lines each (``lines``: x0, y0, z0, x1, y1, z1), with raw appended arrays.

    Each is whole in itself, so no task needs to know the lines of another, and none is collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def made(rows: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([f"output_{part}_{number - 1}.vtp"]), pa.array([b"".join(appended_lines(rows))], pa.binary())], names=["name", "content"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("x0", "y0", "z0", "x1", "y1", "z1")], 1) if batch.num_rows else np.empty((0, 6))
            held, size = [*held, rows], size + len(rows)
            while size >= piece:
                whole = np.concatenate(held)
                yield made(whole[:piece])
                held, size = [whole[piece:]], size - piece
        if size:
            yield made(np.concatenate(held))

    return lines.select("x0", "y0", "z0", "x1", "y1", "z1").mapInArrow(run, "name string, content binary")


def appended_lines(rows: np.ndarray) -> Iterator[bytes]:
    """The parts of a poly-data file of lines (rows of both ends' x, y, z): points, and each line's two of them."""
    n = len(rows)
    arrays = [("points", "Float32", rows.reshape(-1, 3).astype("<f4"), ' NumberOfComponents="3"'), ("connectivity", "Int64", np.arange(2 * n, dtype="<i8"), ""), ("offsets", "Int64", np.arange(2, 2 * n + 1, 2, dtype="<i8"), "")]
    tags, at = [], 0
    for name, kind, values, more in arrays:
        tags.append(f'<DataArray type="{kind}" Name="{name}"{more} format="appended" offset="{at}"/>')
        at += 8 + values.nbytes
    yield (
        f'<?xml version="1.0"?>\n<VTKFile type="PolyData" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n<PolyData>\n<Piece NumberOfPoints="{2 * n}" NumberOfVerts="0" NumberOfLines="{n}" NumberOfStrips="0" NumberOfPolys="0">\n'
        f'<Points>{tags[0]}</Points>\n<Lines>{tags[1]}{tags[2]}</Lines>\n</Piece>\n</PolyData>\n<AppendedData encoding="raw">\n_'
    ).encode()
    for _, _, values, _ in arrays:
        yield np.array([values.nbytes], "<u8").tobytes()
        yield values.tobytes()
    yield b"\n</AppendedData>\n</VTKFile>\n"


def index_xml(names: list[str]) -> bytes:
    """The head that makes pieces one poly-data set."""
    pieces = "\n".join(f'<Piece Source="{n}"/>' for n in names)
    return f'<?xml version="1.0"?>\n<VTKFile type="PPolyData" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n<PPolyData GhostLevel="0">\n<PPoints><PDataArray type="Float32" Name="points" NumberOfComponents="3"/></PPoints>\n{pieces}\n</PPolyData>\n</VTKFile>\n'.encode()


def write_label_images(labels: DataFrame, blocks: Blocks, folder: str) -> None:
    """Labels as one ``output_<block>.vti`` a block in a folder that all tasks reach."""
    save_files(label_files(labels, blocks), folder)


def write_arc_lines(lines: DataFrame, folder: str) -> None:
    """Arc lines (``vtk_io.arc_lines``) as pieces and an ``output.pvtp`` that lists them, in a folder that all tasks reach."""
    save_files(line_files(lines), folder, "output.pvtp")


def label_rows(folder_rows: DataFrame, spec: GridSpec) -> DataFrame:
    """id and arc of label images (``binaryFile`` rows, content); the inverse of ``write_label_images``. A file is one task's read."""
    from .image_boxes import image_cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                i, values = image_cells(content, spec)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(values.astype(np.int64))], names=["id", "arc"])

    return folder_rows.select(F.col("content")).mapInArrow(run, "id long, arc long")
