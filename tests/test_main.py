import os

import numpy as np
from sweep import sweep

from fieldtree.__main__ import main
from fieldtree.schema import GridSpec
from fieldtree.sources.file_set import label_rows
from fieldtree.sources.image_boxes import appended_image


def test_command_line(spark, tmp_path):
    spec = GridSpec(7, 6, 4)
    values = np.random.default_rng(2).integers(0, 12, spec.n).astype(np.float32)
    (tmp_path / "a.vti").write_bytes(b"".join(appended_image((0, 0, 0), (6, 5, 3), "f", values)))
    labels, parent = sweep(values.tolist(), spec)
    for k, more in enumerate((["--blocks", "4"], ["--no-trunkskip"])):
        out = f"{tmp_path}/out{k}"
        made = main([str(tmp_path / "a.vti"), out, *more])
        assert made["edges"] == len(parent) and made["nodes"] == len(parent) + 1 and "write" in made["seconds"]
        images = [n for n in os.listdir(out) if n.endswith(".vti")]
        assert len(images) == (4 if k == 0 else 1) and "output.pvtp" in os.listdir(out)
        got = label_rows(spark.read.format("binaryFile").load(f"{out}/*.vti"), spec).collect()
        assert {r.id: r.arc for r in got} == dict(enumerate(labels))
