"""Critical points: minima, steepest descent, lower stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import value
from ..schema import GridSpec
from ..storage import stored
from .grid import Blocks, edges
from .halo import local_minima, tiles


def steepest(field: DataFrame, spec: GridSpec) -> DataFrame:
    """id and p, the least of the vertex and its neighbours; minima point to themselves.

    Every edge offers each end to the other; one aggregation, combined before its shuffle.
    """
    e = edges(field, spec)
    offers = (
        e.select(F.col("u").alias("id"), value("fv", "v").alias("to"))
        .unionByName(e.select(F.col("v").alias("id"), value("fu", "u").alias("to")))
        .unionByName(field.select("id", value().alias("to")))
    )
    return offers.groupBy("id").agg(F.min("to").alias("to")).select("id", F.col("to.id").alias("p"))


def minima(field: DataFrame, spec: GridSpec) -> DataFrame:
    """The vertices without a smaller neighbour, with their values."""
    e = edges(field, spec)
    above = F.when(value("fu", "u") < value("fv", "v"), F.col("v")).otherwise(F.col("u"))
    return field.select("id", "f").join(e.select(above.alias("id")), "id", "left_anti")


def minima_count(field: DataFrame, spec: GridSpec) -> DataFrame:
    return minima(field, spec).agg(F.count(F.lit(1)).alias("minima"))


def block_minima(field: DataFrame, blocks: Blocks) -> DataFrame:
    """block and id: the minima that each block has among its own cells, which it tells from them and its halo; those among its ghost cells are left out.

    A dense field without nulls is expected (``sources.fields.check``); ties fall to the smaller id.
    """
    return local_minima(stored(tiles(field, blocks), "tiles"), blocks)


def lower_star(field: DataFrame, spec: GridSpec) -> DataFrame:
    """id and nid: each vertex with its smaller neighbours."""
    e = edges(field, spec)
    up = value("fu", "u") < value("fv", "v")
    return e.select(F.when(up, F.col("v")).otherwise(F.col("u")).alias("id"), F.when(up, F.col("u")).otherwise(F.col("v")).alias("nid"))


def sweepable(field: DataFrame, spec: GridSpec, members: DataFrame) -> DataFrame:
    """comp, id, and whether all smaller neighbours of a vertex next to a component belong to it.

    ``members``: comp and id. A row for each vertex outside a component with a neighbour in it.
    """
    star = lower_star(field, spec)
    inside = members.select("comp", F.col("id").alias("nid"))
    touched = star.join(inside, "nid").groupBy("comp", "id").agg(F.count(F.lit(1)).alias("in"))
    total = star.groupBy("id").agg(F.count(F.lit(1)).alias("all"))
    return touched.join(members, ["comp", "id"], "left_anti").join(total, "id").select("comp", "id", (F.col("in") == F.col("all")).alias("sweepable"))


def ending_saddle(field: DataFrame, spec: GridSpec, members: DataFrame) -> DataFrame:
    """comp and saddle: the least vertex next to a component that isn't sweepable."""
    stuck = sweepable(field, spec, members).filter("NOT sweepable").join(field.select("id", "f"), "id")
    return stuck.groupBy("comp").agg(F.min(value()).alias("least")).select("comp", F.col("least.id").alias("saddle"))


def saddle_components(field: DataFrame, spec: GridSpec, component: DataFrame) -> DataFrame:
    """id and n: the number of components (``component``: id, comp) that a vertex's lower star meets."""
    return lower_star(field, spec).join(component.select(F.col("id").alias("nid"), "comp"), "nid").groupBy("id").agg(F.countDistinct("comp").alias("n"))
