"""From a field to arcs and labels."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field as attribute

from pyspark.sql import DataFrame

from ..operators import block_tier, tree, trunk
from ..operators.halo import tiles
from ..schema import GridSpec
from ..sources.fields import check
from ..storage import stored

log = logging.getLogger(__name__)


@dataclass
class MergeTree:
    """A join tree and what it was made of. Tables and labels are stored, so reading one runs nothing again."""

    field: DataFrame
    spec: GridSpec
    basin: DataFrame
    nodes: DataFrame
    deaths: DataFrame | None = None
    hops: list[DataFrame] = attribute(default_factory=list)
    seconds: dict[str, float] = attribute(default_factory=dict)
    _made: dict[str, DataFrame] = attribute(default_factory=dict)

    @property
    def graph(self) -> DataFrame:
        """The basin graph (a, b, f, s), made when it is first asked for."""
        if "graph" not in self._made:
            self._made["graph"] = stored(tree.basin_edges(self.field, self.spec, self.basin.select("id", "basin")), "basin-edges")
        return self._made["graph"]

    @property
    def arcs(self) -> DataFrame:
        return tree.arcs_of(self.nodes)

    def labels(self, mode: str | None = None) -> DataFrame:
        """id, arc and arc_value of every vertex, by one of three ways to equal results.

        ``branch``: the greatest node of its branch (block tier only, and there the default); ``climb``: binary
        lifting for every vertex; ``asof``: only to the trunk, then a lookup (the global tier's default).
        """
        mode = mode or ("asof" if self.deaths is None else "branch")
        if mode not in ("climb", "asof", "branch") or mode == "branch" and self.deaths is None:
            raise ValueError(f"no label mode {mode}")
        if mode not in self._made:
            if mode == "branch":
                made = block_tier.branch_labels(self.basin, self.deaths, self.hops, self.nodes)
            else:
                made = (tree.labels_of if mode == "climb" else trunk.trunk_labels)(self.field, self.basin, self.nodes)
            self._made[mode] = stored(made, "labels")
        return self._made[mode]


def merge_tree(field: DataFrame, spec: GridSpec, blocks: int | None = None, tier: str = "blocks", checked: bool = False, region_edges: int = block_tier.REGION_EDGES) -> MergeTree:
    """The join tree of a dense field, which is checked to be one (``sources.fields.check``) unless it is said to be.

    ``tier``: ``blocks`` merges trees of blocks over growing regions (``operators.block_tier``); ``blocks`` is
    their number, by size if not given, and ``region_edges`` the number of a region's edges beyond which it is joined in ranges. ``global`` joins the whole basin graph in one ordered task. Equal results.
    """
    if tier not in ("blocks", "global"):
        raise ValueError(f"no tier {tier}")
    seconds, at = {}, time.time()

    def done(step: str) -> None:
        nonlocal at
        seconds[step], at = time.time() - at, time.time()
        log.info("%s: %.2f s", step, seconds[step])

    field = stored(field, "field")
    if not checked:
        check(field, spec)
    done("load")
    if tier == "blocks":
        cut = block_tier.blocks_for(spec, blocks, field.sparkSession.sparkContext.defaultParallelism)
        log.info("%d vertices in %d blocks of %s cells", spec.n, cut.n, "x".join(map(str, cut.size)))
        trees = block_tier.forest(stored(tiles(field, cut), "tiles"), cut)
        done("basins")
        dead = block_tier.deaths(trees, region_edges)
        done("merge")
        hops = block_tier.death_hops(dead)
        nodes = block_tier.branch_nodes(trees.basins, dead, hops)
        done("arcs")
        return MergeTree(field, spec, trees.basins, nodes, dead, hops, seconds)
    basin = tree.basins(field, spec)
    done("basins")
    made = MergeTree(field, spec, basin, basin, seconds=seconds)
    graph = made.graph
    done("basin graph")
    made.nodes = tree.node_table(field, basin, graph)
    done("merge")
    return made
