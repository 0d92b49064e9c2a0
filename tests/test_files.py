import os
import re

import numpy as np
import pytest

from fieldtree.operators.grid import decompose, halved
from fieldtree.schema import GridSpec
from fieldtree.sources import file_set as W
from fieldtree.sources.image_boxes import image_cells

SPEC = GridSpec(9, 7, 5)


def labels(spark):
    return spark.range(SPEC.n).selectExpr("id", "id * 37 % 1000 AS arc", "'x' AS block")


@pytest.mark.parametrize("blocks", [decompose(SPEC, 6), halved(SPEC, 40)])
def test_label_images(spark, tmp_path, blocks):
    folder = f"{tmp_path}/out"
    W.write_label_images(labels(spark), blocks, folder)
    assert sorted(os.listdir(folder)) == sorted(f"output_{b}.vti" for b in range(blocks.n))
    got = {}
    for name in os.listdir(folder):
        with open(f"{folder}/{name}", "rb") as file:
            i, values = image_cells(file.read(), SPEC)
        got.update(zip(i.tolist(), values.tolist()))
    assert got == {i: i * 37 % 1000 for i in range(SPEC.n)}
    back = W.label_rows(spark.read.format("binaryFile").load(folder), SPEC)
    assert sorted(map(tuple, back.collect())) == sorted(got.items())


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    def broken(rows):
        def run(batches):
            for b in batches:
                yield b
            raise RuntimeError("broken")

        return rows.mapInArrow(run, "name string, content binary")

    good = W.label_files(labels(spark), halved(SPEC, 40))
    with pytest.raises(Exception, match="broken"):
        W.save_files(good.unionByName(broken(good)), f"{tmp_path}/out")
    assert not os.path.isdir(f"{tmp_path}/out") or os.listdir(f"{tmp_path}/out") == []
    twice = spark.createDataFrame([("a", b"1"), ("a", b"2")], "name string, content binary")
    with pytest.raises(Exception, match="one file name"):
        W.save_files(twice, f"{tmp_path}/twice")
    assert os.listdir(f"{tmp_path}/twice") == []
    with pytest.raises(Exception, match="2 of|labels for"):
        W.write_label_images(labels(spark).filter("id <> 3"), halved(SPEC, 40), f"{tmp_path}/lacks")


def parsed(content):
    """Points and connectivity of a poly-data file."""
    head, raw = content.split(b"\n_", 1)
    n = int(re.search(rb'NumberOfPoints="(\d+)"', head)[1])
    offsets = [int(x) for x in re.findall(rb'offset="(\d+)"', head)]
    sizes = [int(np.frombuffer(raw, "<u8", 1, at)[0]) for at in offsets]
    assert sizes == [12 * n, 8 * n, 4 * n]
    points = np.frombuffer(raw, "<f4", 3 * n, offsets[0] + 8).reshape(-1, 3)
    lines, ends = np.frombuffer(raw, "<i8", n, offsets[1] + 8), np.frombuffer(raw, "<i8", n // 2, offsets[2] + 8)
    assert ends.tolist() == list(range(2, n + 1, 2))
    return points[lines].reshape(-1, 6)


def test_arc_lines(spark, tmp_path):
    lines = spark.range(1000).selectExpr("id % 9 AS x0", "id % 7 AS y0", "id % 5 AS z0", "id AS x1", "0L AS y1", "1L AS z1").repartition(3)
    W.save_files(W.line_files(lines, 100), f"{tmp_path}/out", "output.pvtp")
    with open(f"{tmp_path}/out/output.pvtp") as file:
        pieces = re.findall('Source="([^"]+)"', file.read())
    assert sorted([*pieces, "output.pvtp"]) == sorted(os.listdir(f"{tmp_path}/out")) and len(pieces) >= 10
    rows = np.concatenate([parsed(open(f"{tmp_path}/out/{p}", "rb").read()) for p in pieces])
    assert sorted(map(tuple, rows.astype(int).tolist())) == sorted((i % 9, i % 7, i % 5, i, 0, 1) for i in range(1000))
    W.write_arc_lines(lines.limit(0), f"{tmp_path}/none")
    assert os.listdir(f"{tmp_path}/none") == ["output.pvtp"]
