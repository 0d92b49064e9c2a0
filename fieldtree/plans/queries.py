"""Queries over fields that are binned from the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import show_value, value
from ..operators import critical, fixpoint, grid, ordered, sets, tree, trunk
from ..schema import GridSpec
from ..sources import fields
from ..operators.halo import tiles
from ..sources.file_set import field_files, label_rows, save_files, write_label_images
from ..sources.image_boxes import read_boxes
from ..sources.vtk_io import arc_lines
from ..storage import fresh
from .pipeline import MergeTree, merge_tree

Query = Callable[[SparkSession, str], DataFrame]

SPECS = {"f1": GridSpec(50, 11), "f2": GridSpec(30, 24), "f3": GridSpec(30), "f4": GridSpec(10, 11, 5)}
_CELLS = {
    "f1": ("lineitem", lambda: (F.col("l_quantity") - 1) + 50 * F.round(F.col("l_discount") * 100)),
    "f2": ("events", lambda: (F.dayofmonth("ts") - 1) + 30 * F.hour("ts")),
    "f3": ("events", lambda: F.dayofmonth("ts") - 1),
    "f4": ("lineitem", lambda: F.floor((F.col("l_quantity") - 1) / 5) + 10 * F.round(F.col("l_discount") * 100) + 110 * F.floor(F.round(F.col("l_tax") * 100) / 2)),
}
_CELLS_SQL = {
    "f1": ("lineitem", "(l_quantity - 1) + 50 * round(l_discount * 100)"),
    "f2": ("events", "(day(ts) - 1) + 30 * hour(ts)"),
    "f3": ("events", "day(ts) - 1"),
    "f4": ("lineitem", "floor((l_quantity - 1) / 5) + 10 * round(l_discount * 100) + 110 * floor(round(l_tax * 100) / 2)"),
}
BLOCKS = {"f1": 4, "f2": 6, "f3": 3, "f4": 8}


def field(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, cell = _CELLS[name]
    return fields.binned(spark.read.parquet(f"{sf_dir}/{table}.parquet"), cell(), SPECS[name])


def embeddings_field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GridSpec]:
    """The elements of the table embeddings, a row of the grid for each vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    spec = GridSpec(64, int(table.agg(F.max("vec_id")).first()[0]) + 1)
    return fields.from_arrays(table, "vec_id", "embedding", spec), spec


def _tree(spark: SparkSession, sf_dir: str, name: str) -> MergeTree:
    return merge_tree(field(spark, sf_dir, name), SPECS[name], blocks=BLOCKS[name], checked=True)


def _f(df: DataFrame, *columns: str) -> DataFrame:
    """Values as doubles, in which they compare exactly."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns or ("f",)})


# The small components that the boundary queries are about: steepest-descent basins.
def _boundaries(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    from ..storage import stored

    made, spec = stored(field(spark, sf_dir, name), "field"), SPECS[name]
    members = tree.basins(made, spec).select(F.col("basin").alias("comp"), "id")
    return made, stored(sets.boundary(made, spec, members), "boundary")


def _two(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The boundaries of the components with the most and second most boundary vertices, ties to the smaller.

    Without a second component the second boundary is empty, without any both are.
    """
    n = F.struct((-F.count(F.lit(1))).alias("n"), F.col("comp"))
    sizes = edge.groupBy("comp").agg(n.alias("at"))
    first = sizes.agg(F.min("at").alias("first"))
    second = sizes.join(first, F.col("at") > F.col("first")).agg(F.min("at").alias("second"))
    return edge.join(F.broadcast(first.select("first.comp")), "comp", "left_semi"), edge.join(F.broadcast(second.select("second.comp")), "comp", "left_semi")


def _pair(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The boundaries of the two components that share most vertices; both empty if no two share any."""
    met = F.broadcast(sets.most_shared(sets.shared_vertices(edge)))
    return tuple(edge.join(met.select(F.col(c).alias("comp")), "comp", "left_semi") for c in "ab")


def _queries_of(name: str) -> dict[str, Query]:
    spec, blocks = SPECS[name], grid.decompose(SPECS[name], BLOCKS[name])
    made = lambda s, d: field(s, d, name)
    built = lambda s, d: _tree(s, d, name)

    def split(s: SparkSession, d: str) -> DataFrame:
        t = built(s, d)
        r = t.labels().join(t.field.select("id", "f"), "id").join(t.arcs.select(F.col("extremum").alias("arc"), "saddle"), "arc")
        high = t.field.select(F.col("id").alias("s_id"), F.col("f").alias("s_f"))
        r = r.join(high, F.col("saddle") == F.col("s_id"), "left").withColumn("middle", F.struct(F.col("s_f").alias("f"), F.col("s_id").alias("id")))
        below, above = sets.split_members(r.filter("saddle IS NOT NULL"), F.col("middle"))
        return below.select(F.lit("below").alias("side")).unionByName(above.select(F.lit("above").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))

    def boundary_set(kind: str) -> Query:
        def query(s: SparkSession, d: str) -> DataFrame:
            one, two = _two(_boundaries(s, d, name)[1])
            if kind == "union":
                return _f(sets.unite(one, two))
            if kind == "intersect":
                return _f(sets.intersect(one, two)[0])
            return _f(sets.intersect(one, two)[1].select("id", "f"))

        return query

    def pair_set(pick: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        return lambda s, d: pick(*_pair(_boundaries(s, d, name)[1]))

    def members(made: DataFrame) -> DataFrame:
        return tree.basins(made, spec).select(F.col("basin").alias("comp"), "id")

    def basin_split(s: SparkSession, d: str) -> DataFrame:
        """Members of each minimum's basin, before any move up, against the saddle that ends its arc."""
        t = built(s, d)
        end = t.nodes.filter("saddle IS NOT NULL").select(F.col("node").alias("basin"), F.struct(F.col("fs").alias("f"), F.col("saddle").alias("id")).alias("middle"))
        below, above = sets.split_members(t.basin.select("id", "basin").join(t.field.select("id", "f"), "id").join(end, "basin"), F.col("middle"))
        return below.select("id", F.lit("below").alias("side")).unionByName(above.select("id", F.lit("above").alias("side")))

    def latest(s: SparkSession, d: str) -> DataFrame:
        """Each block answers for a basin with every cell that it sees of it, the id as counter."""
        field_ = made(s, d)
        seen = grid.ghosted(field_, blocks).join(tree.basins(field_, spec), "id")
        return _f(sets.latest_answers(seen.select(F.col("basin").alias("arc"), F.col("block").alias("location"), F.col("id").alias("counter"), "f")))

    def peers(s: SparkSession, d: str) -> DataFrame:
        field_ = made(s, d)
        found = sets.peers(grid.ghosted(field_, blocks), members(field_))
        return found.select("comp", F.array_join(F.transform("blocks", lambda b: b.cast("string")), ",").alias("blocks"))

    def peer_counts(s: SparkSession, d: str) -> DataFrame:
        field_ = made(s, d)
        return sets.peer_counts(sets.peer_bitmaps(grid.ghosted(field_, blocks), members(field_)))

    def unvisited(s: SparkSession, d: str) -> DataFrame:
        """Neighbours of minima, but for those that a first step of steepest descent has been to."""
        field_ = made(s, d)
        reached = sets.bitmaps(critical.steepest(field_, spec), "p")
        low = grid.with_coords(critical.minima(field_, spec), spec)
        return sets.unvisited(grid.neighbours(low, spec).select(F.col("nid").alias("id"), F.col("id").alias("comp")), reached)

    def fetched(s: SparkSession, d: str) -> DataFrame:
        arcs = built(s, d).arcs
        return sets.fetch_or_create(arcs.filter("is_leaf"), arcs.select("extremum", "is_leaf"))

    def sweepable(s: SparkSession, d: str) -> DataFrame:
        """Of components that hold only their minimum yet."""
        field_ = made(s, d)
        return critical.sweepable(field_, spec, critical.minima(field_, spec).select(F.col("id").alias("comp"), "id"))

    def added(s: SparkSession, d: str) -> DataFrame:
        field_, edge = _boundaries(s, d, name)
        return _f(sets.add(edge, critical.minima(field_, spec).select(F.col("id").alias("comp"), "id", "f")))

    def subtree(s: SparkSession, d: str) -> DataFrame:
        """Of each node: the vertices of all arcs from it down, and the least value among them."""
        t = built(s, d)
        sizes = tree.arc_size(t.labels()).select(F.col("arc").alias("node"), "vertices")
        rows = t.nodes.select("node", "saddle", F.col("f").alias("lowest")).join(sizes, "node")
        return _f(fixpoint.subtrees(rows, "node", "saddle", totals=("vertices",), least=("lowest",)), "lowest")

    def above(s: SparkSession, d: str) -> DataFrame:
        """Of each edge of the basin graph: is the vertex where two basins meet a node above the first one's minimum?"""
        t = built(s, d)
        told = fixpoint.intervals(t.nodes.select(F.col("node").alias("id"), F.col("saddle").alias("p")))
        return fixpoint.related(t.graph.select(F.col("s").alias("upper"), F.col("a").alias("lower")), told)

    def image_box(s: SparkSession, d: str) -> DataFrame:
        """The field as an image file, of which a box is read."""
        whole = grid.decompose(spec, 1)
        folder = fresh(s, "images")
        save_files(field_files(tiles(made(s, d), whole), whole), folder)
        return _f(read_boxes(s, f"{folder}/output_0.vti", 64, (1, 0, 0), (5, 3, 2))[0].select("id", "f"))

    def label_images(s: SparkSession, d: str) -> DataFrame:
        """Labels as image files of blocks, read back."""
        folder = fresh(s, "images")
        write_label_images(built(s, d).labels(), blocks, folder)
        return label_rows(s.read.format("binaryFile").load(folder), spec)

    def contained(s: SparkSession, d: str) -> DataFrame:
        """Of each vertex: is the one numbered after it on the boundary of its basin?"""
        field_, edge = _boundaries(s, d, name)
        return sets.contains(edge, tree.basins(field_, spec).select(F.col("basin").alias("comp"), (F.col("id") + 1).alias("id")))

    def without_least(s: SparkSession, d: str) -> DataFrame:
        edge = _boundaries(s, d, name)[1]
        return _f(sets.remove(edge, sets.boundary_min(edge)))

    return {
        "contains": contained,
        "filled": lambda s, d: _f(fields.filled(critical.minima(made(s, d), spec), spec, -1.0).select("id", "f")),
        "peer_counts": peer_counts,
        "unvisited": unvisited,
        "subtree": subtree,
        "above": above,
        "image_box": image_box,
        "label_images": label_images,
        "value_at": lambda s, d: _f(fields.value_at(s.range(0, spec.n + 10, 3), made(s, d))),
        "owned": lambda s, d: grid.owned(grid.ghosted(made(s, d), blocks)).select("block", "id"),
        "block_minima": lambda s, d: critical.block_minima(made(s, d), blocks),
        "sweepable": sweepable,
        "ending_saddle": lambda s, d: critical.ending_saddle(made(s, d), spec, members(made(s, d))),
        "latest_answers": latest,
        "peers": peers,
        "fetch_arcs": fetched,
        "dangling_chain": lambda s, d: trunk.chained(critical.minima(made(s, d), spec).select(F.col("id").alias("node"), "f")),
        "basin_split": basin_split,
        "inherited": lambda s, d: sets.inherit(built(s, d).labels().select("arc", "id"), built(s, d).arcs),
        "boundary_order": lambda s, d: sets.ordered_boundary(_boundaries(s, d, name)[1]),
        "boundary_add": added,
        "boundary_without": without_least,
        "pair_union": pair_set(lambda a, b: _f(sets.unite(a, b))),
        "pair_common": pair_set(lambda a, b: _f(sets.intersect(a, b)[0])),
        "pair_first": pair_set(lambda a, b: _f(sets.intersect(a, b)[1].select("id", "f"))),
        "pair_second": pair_set(lambda a, b: _f(sets.intersect(a, b)[2].select("id", "f"))),
        "pair_merged": pair_set(lambda a, b: trunk.chained(sets.unite(a, b).select(F.col("id").alias("node"), "f"))),
        "field": lambda s, d: _f(made(s, d).select("id", "f")),
        "coords": lambda s, d: made(s, d).select("id", "x", "y", "z"),
        "box": lambda s, d: _f(fields.box(made(s, d), (1, 0, 0), (5, 3, 2)).select("id", "f")),
        "block_of": lambda s, d: grid.block_of(made(s, d), blocks).select("id", "block"),
        "ghosts": lambda s, d: grid.ghosted(made(s, d), blocks).select("block", "id", "is_ghost", "owner"),
        "local": lambda s, d: grid.global_id(grid.local_coords(grid.ghosted(made(s, d), blocks), blocks), spec).select("block", "id", "local_idx", "mask", "gid"),
        "block_counts": lambda s, d: fields.counts(grid.ghosted(made(s, d), blocks)),
        "edges": lambda s, d: _f(grid.edges(made(s, d), spec), "fu", "fv"),
        "degree": lambda s, d: grid.degree(made(s, d), spec),
        "rank": lambda s, d: ordered.ranked(made(s, d)),
        "show": lambda s, d: made(s, d).select("id", show_value(F.struct(F.col("f").cast("long").alias("f"), "id")).alias("shown")),
        "minima": lambda s, d: _f(critical.minima(made(s, d), spec)),
        "minima_count": lambda s, d: critical.minima_count(made(s, d), spec),
        "lower_star": lambda s, d: critical.lower_star(made(s, d), spec),
        "steepest": lambda s, d: critical.steepest(made(s, d), spec),
        "basin": lambda s, d: tree.basins(made(s, d), spec),
        "basin_size": lambda s, d: tree.basins(made(s, d), spec).groupBy("basin").agg(F.count(F.lit(1)).alias("vertices")),
        "basin_edges": lambda s, d: _f(tree.basin_edges(made(s, d), spec, tree.basins(made(s, d), spec))),
        "arcs": lambda s, d: built(s, d).arcs,
        "arcs_by_ranges": lambda s, d: merge_tree(field(s, d, name), spec, blocks=BLOCKS[name], checked=True, region_edges=8 if name == "f1" else 32).arcs,
        "saddles": lambda s, d: tree.saddles(built(s, d).arcs),
        "children": lambda s, d: tree.children(built(s, d).arcs).select("saddle", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children")),
        "root": lambda s, d: tree.root(built(s, d).arcs),
        "arc_count": lambda s, d: tree.arc_count(built(s, d).arcs),
        "labels": lambda s, d: built(s, d).labels("climb").select("id", "arc"),
        "arc_value": lambda s, d: _f(built(s, d).labels().select("id", "arc_value"), "arc_value"),
        "arc_size": lambda s, d: tree.arc_size(built(s, d).labels()),
        "arc_lines": lambda s, d: arc_lines(built(s, d).arcs, spec),
        "trunk_chain": lambda s, d: _f(trunk.trunk_chain(built(s, d).nodes)),
        "trunk_label": lambda s, d: built(s, d).labels("asof").select("id", "arc"),
        "descendant": lambda s, d: fixpoint.ancestors(built(s, d).nodes.select("node", "saddle"), "node", "saddle").filter("steps > 0").select(F.col("id").alias("node"), "ancestor"),
        "member_split": split,
        "boundary": lambda s, d: _f(_boundaries(s, d, name)[1]),
        "boundary_min": lambda s, d: _f(sets.boundary_min(_boundaries(s, d, name)[1])),
        "boundary_shared": lambda s, d: sets.shared_vertices(_boundaries(s, d, name)[1]),
        "boundary_union": boundary_set("union"),
        "boundary_intersect": boundary_set("intersect"),
        "boundary_remove": boundary_set("remove"),
    }


def _sql_of(name: str) -> dict[str, str]:
    spec, blocks = SPECS[name], grid.decompose(SPECS[name], BLOCKS[name])
    X, Y, Z = spec.X, spec.Y, spec.Z
    table, cell = _CELLS_SQL[name]
    ctes: dict[str, str] = {}
    ctes["fld"] = f"SELECT r.range::BIGINT AS id, (r.range % {X})::INT AS x, (r.range // {X} % {Y})::INT AS y, (r.range // {X * Y})::INT AS z, coalesce(n, 0)::DOUBLE AS f FROM range({spec.n}) r LEFT JOIN (SELECT ({cell})::BIGINT AS cell, count(*) AS n FROM {table} GROUP BY 1) c ON c.cell = r.range"
    ctes["fwd"] = f"SELECT id, f, id + 1 AS nid FROM fld WHERE x < {X - 1} UNION ALL SELECT id, f, id + {X} FROM fld WHERE y < {Y - 1} UNION ALL SELECT id, f, id + {X * Y} FROM fld WHERE z < {Z - 1}"
    ctes["e"] = "SELECT a.id AS u, a.f AS fu, b.id AS v, b.f AS fv FROM fwd a JOIN fld b ON b.id = a.nid"
    ctes["low"] = "SELECT CASE WHEN (fu, u) < (fv, v) THEN v ELSE u END AS id, CASE WHEN (fu, u) < (fv, v) THEN u ELSE v END AS nid FROM e"
    ctes["mins"] = "SELECT id, f FROM fld WHERE NOT EXISTS (SELECT 1 FROM low WHERE low.id = fld.id)"
    ctes["steep"] = "SELECT fld.id, coalesce((SELECT arg_min(n.id, row(n.f, n.id)) FROM low JOIN fld n ON n.id = low.nid WHERE low.id = fld.id), fld.id) AS p FROM fld"
    ctes["bas"] = "SELECT id, basin FROM (SELECT id, arg_max(spot, steps) AS basin FROM walk GROUP BY id)"
    ctes["walk"] = "SELECT id, p AS spot, 1 AS steps FROM steep UNION ALL SELECT w.id, s.p, w.steps + 1 FROM walk w JOIN steep s ON s.id = w.spot WHERE s.p <> w.spot"
    ctes["bedge"] = "SELECT least(bu, bv) AS a, greatest(bu, bv) AS b, min(w).f AS f, min(w).s AS s FROM (SELECT p.basin AS bu, q.basin AS bv, CASE WHEN (fu, u) < (fv, v) THEN {'f': fv, 's': v} ELSE {'f': fu, 's': u} END AS w FROM e JOIN bas p ON p.id = e.u JOIN bas q ON q.id = e.v) WHERE bu <> bv GROUP BY 1, 2"
    ctes["rk"] = "SELECT id, f, row_number() OVER (ORDER BY f, id) AS rk FROM fld"
    ctes["o"] = "SELECT r.rk, list(n.rk) FILTER (WHERE n.rk IS NOT NULL) AS below FROM rk r LEFT JOIN low ON low.id = r.id LEFT JOIN rk n ON n.id = low.nid GROUP BY r.rk"
    ctes["st"] = (
        "SELECT 0::BIGINT AS i, []::BIGINT[] AS comp, 0::BIGINT AS lab, []::BIGINT[] AS kids UNION ALL "
        "SELECT i + 1, CASE len(ks) WHEN 0 THEN list_append(comp, i + 1) WHEN 1 THEN list_append(comp, ks[1]) ELSE list_append(list_transform(comp, lambda c: CASE WHEN list_contains(ks, c) THEN i + 1 ELSE c END), i + 1) END, "
        "CASE len(ks) WHEN 1 THEN ks[1] ELSE i + 1 END, CASE WHEN len(ks) > 1 THEN ks ELSE []::BIGINT[] END FROM (SELECT st.i, st.comp, list_distinct(list_transform(coalesce(o.below, []), lambda k: st.comp[k])) AS ks FROM st JOIN o ON o.rk = st.i + 1)"
    )
    ctes["lab"] = "SELECT r.id, n.id AS arc, n.f AS arc_value FROM st JOIN rk r ON r.rk = st.i JOIN rk n ON n.rk = st.lab WHERE st.i > 0"
    ctes["node"] = "SELECT r.id AS node, r.f, s.id AS saddle, s.f AS fs, len(st.kids) = 0 AS is_leaf FROM st JOIN rk r ON r.rk = st.i LEFT JOIN (SELECT unnest(kids) AS kid, i FROM st) k ON k.kid = st.i LEFT JOIN rk s ON s.rk = k.i WHERE st.i > 0 AND st.lab = st.i"
    ctes["up"] = "SELECT node, saddle AS ancestor FROM node WHERE saddle IS NOT NULL UNION ALL SELECT u.node, n.saddle FROM up u JOIN node n ON n.node = u.ancestor WHERE n.saddle IS NOT NULL"
    ctes["both"] = "SELECT u AS id, v AS nid FROM e UNION ALL SELECT v, u FROM e"
    ctes["bound"] = "SELECT DISTINCT c.basin AS comp, o.id, o.f FROM bas c JOIN nb ON nb.id = c.id JOIN bas d ON d.id = nb.nid AND d.basin <> c.basin JOIN fld o ON o.id = nb.nid"
    ctes["nb"] = ctes.pop("both")
    ctes["top"] = "SELECT comp, row_number() OVER (ORDER BY count(*) DESC, comp) AS n FROM bound GROUP BY comp"
    ctes["pair"] = "SELECT p.comp AS a, q.comp AS b FROM bound p JOIN bound q ON p.id = q.id AND p.comp < q.comp GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1"
    needs = {"pair": ["bound"], "fld": [], "fwd": ["fld"], "e": ["fwd"], "low": ["e"], "mins": ["low"], "steep": ["low"], "walk": ["steep"], "bas": ["walk"], "bedge": ["bas"], "rk": ["fld"], "o": ["rk", "low"], "st": ["o"], "lab": ["st"], "node": ["st"], "up": ["node"], "nb": ["e"], "bound": ["bas", "nb"], "top": ["bound"]}

    def sql(body: str, *used: str) -> str:
        order: list[str] = []

        def visit(n: str) -> None:
            for m in needs[n]:
                visit(m)
            if n not in order:
                order.append(n)

        for n in used:
            visit(n)
        # Recursive tables are read step by step; what they join is kept, not computed in each step.
        return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in ('walk', 'st', 'up') else 'MATERIALIZED '}({ctes[n]})" for n in order) + f"\n{body}"

    a, b, c = blocks.count
    p, q, r = blocks.size
    owner = f"(least(x // {p}, {a - 1}) + least(y // {q}, {b - 1}) * {a} + least(z // {r}, {c - 1}) * {a * b})"
    boxes = (
        f"SELECT i + j * {a} + k * {a * b} AS block, greatest(i * {p} - 1, 0) AS x0, CASE WHEN i = {a - 1} THEN {X - 1} ELSE i * {p} + {p} END AS x1, greatest(j * {q} - 1, 0) AS y0, CASE WHEN j = {b - 1} THEN {Y - 1} ELSE j * {q} + {q} END AS y1, greatest(k * {r} - 1, 0) AS z0, CASE WHEN k = {c - 1} THEN {Z - 1} ELSE k * {r} + {r} END AS z1 "
        f"FROM range({a}) t1(i), range({b}) t2(j), range({c}) t3(k)"
    )
    view = f"SELECT b.*, fld.*, {owner} AS owner FROM fld JOIN ({boxes}) b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1"
    mask = "(CASE WHEN z < z1 THEN 1 ELSE 0 END + CASE WHEN z > z0 THEN 2 ELSE 0 END + CASE WHEN y < y1 THEN 4 ELSE 0 END + CASE WHEN y > y0 THEN 8 ELSE 0 END + CASE WHEN x < x1 THEN 16 ELSE 0 END + CASE WHEN x > x0 THEN 32 ELSE 0 END + CASE WHEN owner <> block THEN 128 ELSE 0 END)"
    one, two = "(SELECT id, f FROM bound JOIN top USING (comp) WHERE n = 1)", "(SELECT id, f FROM bound JOIN top USING (comp) WHERE n = 2)"
    left, right = ("(SELECT id, f FROM bound WHERE comp = (SELECT %s FROM pair))" % c for c in "ab")
    return {
        "peer_counts": sql(f"SELECT basin AS comp, count(DISTINCT {owner})::BIGINT AS blocks FROM fld JOIN bas ON bas.id = fld.id GROUP BY 1", "bas"),
        "unvisited": sql("SELECT nb.nid AS id, nb.id AS comp FROM nb JOIN mins ON mins.id = nb.id WHERE nb.nid NOT IN (SELECT p FROM steep)", "nb", "mins", "steep"),
        "subtree": sql("SELECT n.node, sum(a.vertices)::BIGINT AS vertices, min(m.f) AS lowest FROM (SELECT node, ancestor FROM up UNION ALL SELECT node, node FROM node) u JOIN node n ON n.node = u.ancestor JOIN node m ON m.node = u.node JOIN (SELECT arc, count(*) AS vertices FROM lab GROUP BY 1) a ON a.arc = u.node GROUP BY 1", "up", "lab"),
        "above": sql("SELECT s AS upper, a AS lower, CASE WHEN s IN (SELECT node FROM node) THEN EXISTS (SELECT 1 FROM up WHERE up.node = bedge.a AND up.ancestor = bedge.s) END AS is_above FROM bedge", "up", "bedge"),
        "image_box": sql("SELECT id, f FROM fld WHERE x BETWEEN 1 AND 5 AND y BETWEEN 0 AND 3 AND z BETWEEN 0 AND 2", "fld"),
        "label_images": sql("SELECT id, arc FROM lab", "lab"),
        "value_at": sql(f"SELECT r.range::BIGINT AS id, f FROM range(0, {spec.n + 10}, 3) r LEFT JOIN fld ON fld.id = r.range", "fld"),
        "owned": sql(f"SELECT {owner}::INT AS block, id FROM fld", "fld"),
        "block_minima": sql(f"SELECT {owner}::INT AS block, id FROM fld WHERE id IN (SELECT id FROM mins)", "mins"),
        "sweepable": sql("SELECT low.nid AS comp, low.id, (SELECT count(*) FROM low o WHERE o.id = low.id) = 1 AS sweepable FROM low WHERE low.nid IN (SELECT id FROM mins)", "mins"),
        "ending_saddle": sql("SELECT b.basin AS comp, arg_min(v.id, row(v.f, v.id)) AS saddle FROM low JOIN bas b ON b.id = low.nid JOIN bas o ON o.id = low.id JOIN fld v ON v.id = low.id WHERE o.basin <> b.basin GROUP BY 1", "bas"),
        "latest_answers": sql(f"SELECT basin AS arc, block::INT AS location, max(v.id) AS counter, arg_max(v.f, v.id) AS f FROM ({view}) v JOIN bas ON bas.id = v.id GROUP BY 1, 2", "bas"),
        "peers": sql(f"SELECT comp, string_agg(block::VARCHAR, ',' ORDER BY block) AS blocks FROM (SELECT DISTINCT basin AS comp, {owner}::INT AS block FROM fld JOIN bas ON bas.id = fld.id) GROUP BY 1", "bas"),
        "fetch_arcs": sql("SELECT node AS extremum, CASE WHEN is_leaf THEN saddle END AS saddle, is_leaf FROM node", "node"),
        "dangling_chain": sql("SELECT id AS node, lead(id) OVER (ORDER BY f, id) AS next FROM mins", "mins"),
        "basin_split": sql("SELECT v.id, CASE WHEN (v.f, v.id) < (n.fs, n.saddle) THEN 'below' ELSE 'above' END AS side FROM bas JOIN fld v ON v.id = bas.id JOIN node n ON n.node = bas.basin WHERE n.saddle IS NOT NULL", "bas", "node"),
        "inherited": sql("SELECT arc, id FROM lab UNION ALL SELECT n.saddle, lab.id FROM lab JOIN node n ON n.node = lab.arc WHERE n.saddle IS NOT NULL", "lab", "node"),
        "boundary_order": sql("SELECT comp, id, lag(id) OVER (PARTITION BY comp ORDER BY f, id) AS prev FROM bound", "bound"),
        "boundary_add": sql("SELECT comp, id, f FROM bound UNION SELECT id, id, f FROM mins", "bound", "mins"),
        "boundary_without": sql("SELECT comp, id, f FROM bound WHERE (f, id) <> (SELECT min(row(b.f, b.id)) FROM bound b WHERE b.comp = bound.comp)", "bound"),
        "pair_union": sql(f"SELECT id, f FROM {left} UNION SELECT id, f FROM {right}", "pair"),
        "pair_common": sql(f"SELECT id, f FROM {left} INTERSECT SELECT id, f FROM {right}", "pair"),
        "pair_first": sql(f"SELECT id, f FROM {left} EXCEPT SELECT id, f FROM {right}", "pair"),
        "pair_second": sql(f"SELECT id, f FROM {right} EXCEPT SELECT id, f FROM {left}", "pair"),
        "pair_merged": sql(f"SELECT id AS node, lead(id) OVER (ORDER BY f, id) AS next FROM (SELECT id, f FROM {left} UNION SELECT id, f FROM {right})", "pair"),
        "field": sql("SELECT id, f FROM fld", "fld"),
        "coords": sql("SELECT id, x, y, z FROM fld", "fld"),
        "box": sql("SELECT id, f FROM fld WHERE x BETWEEN 1 AND 5 AND y BETWEEN 0 AND 3 AND z BETWEEN 0 AND 2", "fld"),
        "block_of": sql(f"SELECT id, {owner}::INT AS block FROM fld", "fld"),
        "ghosts": sql(f"SELECT block::INT AS block, id, owner <> block AS is_ghost, owner::INT AS owner FROM ({view})", "fld"),
        "local": sql(f"SELECT block::INT AS block, id, ((x - x0) + (y - y0) * (x1 - x0 + 1) + (z - z0) * (x1 - x0 + 1) * (y1 - y0 + 1))::BIGINT AS local_idx, {mask}::INT AS mask, id AS gid FROM ({view})", "fld"),
        "block_counts": sql(f"SELECT block::INT AS block, count(*)::BIGINT AS vertices, count(*) FILTER (WHERE owner = block)::BIGINT AS own FROM ({view}) GROUP BY 1", "fld"),
        "edges": sql("SELECT u, fu, v, fv FROM e", "e"),
        "degree": sql(f"SELECT id, ((x > 0)::INT + (x < {X - 1})::INT + (y > 0)::INT + (y < {Y - 1})::INT + (z > 0)::INT + (z < {Z - 1})::INT)::BIGINT AS degree FROM fld", "fld"),
        "rank": sql("SELECT id, rk::BIGINT AS rank FROM rk", "rk"),
        "show": sql("SELECT id, f::BIGINT || '@' || id AS shown FROM fld", "fld"),
        "minima": sql("SELECT id, f FROM mins", "mins"),
        "minima_count": sql("SELECT count(*)::BIGINT AS minima FROM mins", "mins"),
        "lower_star": sql("SELECT id, nid FROM low", "low"),
        "steepest": sql("SELECT id, p FROM steep", "steep"),
        "basin": sql("SELECT id, basin FROM bas", "bas"),
        "basin_size": sql("SELECT basin, count(*)::BIGINT AS vertices FROM bas GROUP BY 1", "bas"),
        "basin_edges": sql("SELECT a, b, f, s FROM bedge", "bedge"),
        "arcs": sql("SELECT node AS extremum, saddle, is_leaf FROM node", "node"),
        "contains": sql("SELECT bas.basin AS comp, bas.id + 1 AS id, EXISTS (SELECT 1 FROM bound WHERE bound.comp = bas.basin AND bound.id = bas.id + 1) AS is_in FROM bas", "bas", "bound"),
        "filled": sql("SELECT fld.id, coalesce(mins.f, -1)::DOUBLE AS f FROM fld LEFT JOIN mins ON mins.id = fld.id", "fld", "mins"),
        "arcs_by_ranges": sql("SELECT node AS extremum, saddle, is_leaf FROM node", "node"),
        "saddles": sql("SELECT saddle, count(*)::BIGINT AS arcs FROM node WHERE saddle IS NOT NULL GROUP BY 1", "node"),
        "children": sql("SELECT saddle, string_agg(node::VARCHAR, ',' ORDER BY node) AS children FROM node WHERE saddle IS NOT NULL GROUP BY 1", "node"),
        "root": sql("SELECT node AS root FROM node WHERE saddle IS NULL", "node"),
        "arc_count": sql("SELECT count(*)::BIGINT AS nodes, count(saddle)::BIGINT AS edges, count(*) FILTER (WHERE is_leaf)::BIGINT AS leaves FROM node", "node"),
        "labels": sql("SELECT id, arc FROM lab", "lab"),
        "arc_value": sql("SELECT id, arc_value FROM lab", "lab"),
        "arc_size": sql("SELECT arc, count(*)::BIGINT AS vertices FROM lab GROUP BY 1", "lab"),
        "arc_lines": sql("SELECT node AS extremum, saddle, p.x AS x0, p.y AS y0, p.z AS z0, q.x AS x1, q.y AS y1, q.z AS z1 FROM node JOIN fld p ON p.id = node JOIN fld q ON q.id = saddle", "node"),
        "trunk_chain": sql("SELECT node, f, saddle AS next FROM node WHERE node = (SELECT arg_min(id, row(f, id)) FROM fld) OR node IN (SELECT ancestor FROM up WHERE up.node = (SELECT arg_min(id, row(f, id)) FROM fld))", "up"),
        "trunk_label": sql("SELECT id, arc FROM lab", "lab"),
        "descendant": sql("SELECT node, ancestor FROM up", "up"),
        "member_split": sql("SELECT side, count(*)::BIGINT AS n FROM (SELECT CASE WHEN (v.f, v.id) < (n.fs, n.saddle) THEN 'below' ELSE 'above' END AS side FROM lab JOIN fld v ON v.id = lab.id JOIN node n ON n.node = lab.arc WHERE n.saddle IS NOT NULL) GROUP BY 1", "lab", "node"),
        "boundary": sql("SELECT comp, id, f FROM bound", "bound"),
        "boundary_min": sql("SELECT comp, arg_min(id, row(f, id)) AS id, min(f) AS f FROM bound GROUP BY 1", "bound"),
        "boundary_shared": sql("SELECT p.id, p.comp AS a, q.comp AS b FROM bound p JOIN bound q ON p.id = q.id AND p.comp < q.comp", "bound"),
        "boundary_union": sql(f"SELECT id, f FROM {one} UNION SELECT id, f FROM {two}", "top"),
        "boundary_intersect": sql(f"SELECT id, f FROM {one} INTERSECT SELECT id, f FROM {two}", "top"),
        "boundary_remove": sql(f"SELECT id, f FROM {one} EXCEPT SELECT id, f FROM {two}", "top"),
    }


#: Queries that build a tree run on three fields, the others on all four.
_TREES = {"arcs", "saddles", "children", "root", "arc_count", "labels", "arc_value", "arc_size", "arc_lines", "trunk_chain", "trunk_label", "descendant", "member_split", "boundary", "boundary_min", "boundary_shared", "boundary_union", "boundary_intersect", "boundary_remove"}
_TREES |= {"value_at", "owned", "block_minima", "sweepable", "ending_saddle", "latest_answers", "peers", "fetch_arcs", "dangling_chain", "basin_split", "inherited", "boundary_order", "boundary_add", "boundary_without", "pair_union", "pair_common", "pair_first", "pair_second", "pair_merged", "subtree", "above", "image_box", "label_images", "peer_counts", "unvisited", "arcs_by_ranges", "contains", "filled"}
#: Of these, on which fields.
_ON = {n: ("f1", "f4") for n in _TREES} | {n: ("f1", "f2", "f3", "f4") for n in ("arcs", "labels")} | {"trunk_label": ("f1", "f2", "f4"), "arc_count": ("f1", "f3", "f4")}


def queries() -> dict[str, Query]:
    return {f"{kind}_{name}": q for name in SPECS for kind, q in _queries_of(name).items() if name in _ON.get(kind, SPECS)}


def oracle_sql() -> dict[str, str]:
    return {f"{kind}_{name}": q for name in SPECS for kind, q in _sql_of(name).items() if name in _ON.get(kind, SPECS)}


def daily_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: local minima of the daily event count, and the day at which each basin merges."""
    t = _tree(spark, sf_dir, "f3")
    return t.arcs.filter("is_leaf").join(t.nodes.select(F.col("node").alias("extremum"), "f"), "extremum").select((F.col("extremum") + 1).alias("day"), F.col("f").cast("long").alias("events"), (F.col("saddle") + 1).alias("merges_on"))
