import numpy as np
import pytest

from fieldtree.plans.pipeline import merge_tree
from fieldtree.schema import GridSpec
from fieldtree.sources import image_boxes as I
from fieldtree.sources.fields import FieldError, load_field
from fieldtree.sources.vtk_io import parse_vti

SPEC = GridSpec(23, 17, 11)
VALUES = np.random.default_rng(3).integers(-40, 40, SPEC.n)


def write(path, values=VALUES, kind="f4", block=0, spec=SPEC):
    path.write_bytes(b"".join(I.appended_image((0, 0, 0), (spec.X - 1, spec.Y - 1, spec.Z - 1), "f", values.astype(kind), block)))
    return str(path)


@pytest.mark.parametrize("kind", ["f4", "f8"])
@pytest.mark.parametrize("block", [0, 100, 4096, 1 << 20])
def test_layouts(tmp_path, kind, block):
    """Plain and compressed values, also with blocks that end within a value's row or within a value."""
    path = write(tmp_path / "a.vti", kind=kind, block=block)
    reader = I.BoxReader(path, 300)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(reader.partitions()) == reader.blocks.n > 8
    assert sorted((r["id"], r["x"] + SPEC.X * (r["y"] + SPEC.Y * r["z"]), r["f"]) for r in rows) == [(i, i, float(v)) for i, v in enumerate(VALUES)]
    spec, values = parse_vti((tmp_path / "a.vti").read_bytes())
    assert spec == SPEC and (values == VALUES).all()


class Counted:
    def __init__(self, file, read):
        self.file, self.counts = file, read

    def read_at(self, n, at):
        self.counts.append(n)
        return self.file.read_at(n, at)


@pytest.mark.parametrize("block", [0, 512])
def test_tasks_read_their_own_bytes(tmp_path, monkeypatch, block):
    spec = GridSpec(64, 64, 64)
    values = np.arange(spec.n) % 1000
    path = write(tmp_path / "a.vti", values, block=block, spec=spec)
    monkeypatch.setattr(I, "GAP", 0)
    reader = I.BoxReader(path, spec.n // 64)
    files, name = I.store(path)
    parts, read = reader.partitions(), []
    assert len(parts) == 64
    with files.open_input_file(name) as file:
        for p in parts:
            counts = []
            starts = I.runs(spec, p) * 4
            got = b"".join(I._contents(Counted(file, counts), reader.made, p, starts, 4 * (p.hi[0] - p.lo[0])))
            assert len(got) == 4 * spec.n // 64
            read.append(sum(counts))
    if block:  # a block of 512 bytes holds two rows of the grid
        assert max(read) < 1.1 * sum(len(b) for b in I.appended_image((0, 0, 0), (63, 63, 63), "f", values.astype("f4"), block)) / 16
    else:
        assert max(read) == 4 * spec.n // 64


def test_spark_reads_boxes(spark, tmp_path):
    path = write(tmp_path / "a.vti", block=256)
    field, spec = I.read_boxes(spark, path, 300)
    assert spec == SPEC and field.rdd.getNumPartitions() == I.BoxReader(path, 300).blocks.n
    assert [r.f for r in field.orderBy("id").collect()] == VALUES.tolist()
    some, _ = I.read_boxes(spark, path, 300, (3, 2, 1), (5, 9, 4))
    cells = [(x, y, z) for z in range(1, 5) for y in range(2, 10) for x in range(3, 6)]
    assert sorted((r.id, r.f) for r in some.collect()) == sorted((i := x + SPEC.X * (y + SPEC.Y * z), float(VALUES[i])) for x, y, z in cells)
    assert some.rdd.getNumPartitions() < field.rdd.getNumPartitions()  # the others are never opened
    assert I.read_boxes(spark, path, 300, (9, 9, 9), (3, 3, 3))[0].count() == 0 and field.filter("x = 3").count() == SPEC.n // SPEC.X
    assert field.count() == SPEC.n
    loaded, _ = load_field(spark, path)
    assert sorted(merge_tree(loaded, spec).arcs.collect()) == sorted(merge_tree(field, spec, blocks=3).arcs.collect())


def test_errors(tmp_path):
    with pytest.raises(FieldError, match="Int64"):
        I.layout(write(tmp_path / "a.vti", kind="i8"))
    path = write(tmp_path / "b.vti")
    with pytest.raises(FieldError, match="bytes of values"):
        (tmp_path / "c.vti").write_bytes(open(path, "rb").read().replace(b'Extent="0 22', b'Extent="0 23'))
        I.layout(str(tmp_path / "c.vti"))
    values = VALUES.astype("f4")
    values[7] = np.nan
    reader = I.BoxReader(write(tmp_path / "d.vti", values), 1 << 20)
    with pytest.raises(FieldError, match="NaN"):
        list(reader.read(reader.partitions()[0]))
