import base64
import struct
import zlib

import numpy as np
import pytest

from fieldtree.operators import grid
from fieldtree.plans.pipeline import merge_tree
from fieldtree.schema import GridSpec
from fieldtree.sources import vtk_io
from fieldtree.sources.fields import FieldError, load_field

SPEC = GridSpec(4, 3, 2)
VALUES = np.random.default_rng(5).integers(0, 9, SPEC.n).astype(np.float32)


def vti(kind="Float32", form="binary", compressed=False, values=VALUES):
    raw = values.astype(vtk_io.VTK_TYPES[kind]).tobytes()
    head = struct.pack("<Q", len(raw))
    if compressed:
        packed = [zlib.compress(raw[:40]), zlib.compress(raw[40:])]
        head, raw = struct.pack("<5Q", 2, 40, len(raw) - 40, *map(len, packed)), b"".join(packed)
    text = {"binary": base64.b64encode(head).decode() + base64.b64encode(raw).decode() if compressed else base64.b64encode(head + raw).decode(), "ascii": " ".join(map(str, values)), "appended": ""}[form]
    zip_ = ' compressor="vtkZLibDataCompressor"' if compressed else ""
    body = f'<VTKFile type="ImageData" byte_order="LittleEndian" header_type="UInt64"{zip_}><ImageData WholeExtent="0 3 0 2 0 1"><Piece Extent="0 3 0 2 0 1"><PointData><DataArray type="{kind}" Name="f" format="{form}" offset="0">{text}</DataArray></PointData></Piece></ImageData>'.encode()
    return body + (b'<AppendedData encoding="raw">_' + head + raw + b"</AppendedData>" if form == "appended" else b"") + b"</VTKFile>"


@pytest.mark.parametrize("kind", ["Float32", "Float64"])
@pytest.mark.parametrize("form,compressed", [("binary", False), ("binary", True), ("ascii", False), ("appended", False), ("appended", True)])
def test_forms(kind, form, compressed):
    spec, values = vtk_io.parse_vti(vti(kind, form, compressed))
    assert spec == SPEC and (values == VALUES).all()


def test_other_types_are_errors():
    with pytest.raises(FieldError):
        vtk_io.parse_vti(vti("Int32"))


def test_round_trip(spark, tmp_path):
    (tmp_path / "a.vti").write_bytes(vti())
    field, spec = load_field(spark, str(tmp_path / "a.vti"))
    assert spec == SPEC
    assert [r.f for r in field.orderBy("id").collect()] == VALUES.tolist()
    made = merge_tree(field, spec)
    blocks = grid.decompose(spec, 4)
    vtk_io.write_labels(made.labels(), spec, blocks, str(tmp_path / "labels"))
    assert spark.read.parquet(str(tmp_path / "labels")).count() == spec.n
