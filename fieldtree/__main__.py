"""``python -m fieldtree volume.vti out``: the join tree of an image file, as label images and arc lines in a folder.

Run it by ``spark-submit`` on a cluster; the input and the folder must be where all tasks reach them, and
``spark.checkpoint.dir`` a shared folder. What is there under the same names is replaced.
"""

from __future__ import annotations

import argparse
import json
import logging
import socket
import time

from pyspark.sql import SparkSession

from .operators.grid import decompose, halved
from .operators.tree import arc_count
from .plans.pipeline import merge_tree
from .sources.fields import load_field
from .sources.file_set import write_arc_lines, write_label_images
from .sources.vtk_io import arc_lines


def main(arguments: list[str] | None = None) -> dict:
    """Does what the arguments say; returns what it has printed: numbers of nodes, arcs and leaves, and seconds by step."""
    parser = argparse.ArgumentParser(prog="fieldtree", description=__doc__.splitlines()[0])
    parser.add_argument("input", help="an image file (.vti)")
    parser.add_argument("output", help="a folder for output_<block>.vti, output_<part>_<n>.vtp and output.pvtp")
    parser.add_argument("--no-trunkskip", action="store_true", help="climb the whole tree for labels instead of looking them up on the trunk; equal results")
    parser.add_argument("--blocks", type=int, help="number of blocks, by its prime factors; chosen by size if not given")
    parser.add_argument("--image-cells", type=int, default=1 << 24, help="cells of one label image at most, where --blocks is not given")
    options = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format=f"%(asctime)s {socket.gethostname()} %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("fieldtree").getOrCreate()
    began = time.time()
    field, spec = load_field(spark, options.input)
    tree = merge_tree(field, spec, blocks=options.blocks)
    labels = tree.labels("climb" if options.no_trunkskip else "asof")
    seconds = {**tree.seconds, "all": time.time() - began}
    began = time.time()
    write_label_images(labels, decompose(spec, options.blocks) if options.blocks else halved(spec, options.image_cells), options.output)
    write_arc_lines(arc_lines(tree.arcs, spec), options.output)
    made = arc_count(tree.arcs).first().asDict() | {"seconds": {k: round(s, 2) for k, s in (seconds | {"write": time.time() - began}).items()}}
    print(json.dumps(made))
    return made


if __name__ == "__main__":
    main()
