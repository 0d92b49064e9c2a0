"""Global orders without a task that sees all rows: ranges, and what a driver needs to know of each.

Rows are dealt by ranges of the order and sorted within them. What crosses from one range to the next is one
row per range, which the driver hands on; so a group of any size is spread over as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def _ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def before(rows: DataFrame, descending: bool = False) -> DataFrame:
    """``rows`` (grp, f, id, is_node) with prev and prev_f: the nearest node ahead of it in its group, or null.

    The order within a group is (f, id), or its reverse; a node comes ahead of another row of equal (f, id).
    Nulls in grp, f or id are not expected. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    order = [F.col("grp").asc(), way("f"), way("id"), F.col("is_node").desc()]
    dealt = rows.select(F.col("grp").cast("long"), F.col("f").cast("double"), F.col("id").cast("long"), "is_node").repartitionByRange(_ranges(rows), *order).sortWithinPartitions(*order)
    schema = "grp long, f double, id long, is_node boolean, prev long, prev_f double, part int, open boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, f, id_, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "f", "id", "is_node"))
            if last is not None:
                grp, f, id_, node = (np.concatenate([[x], y]) for x, y in zip((*last, True), (grp, f, id_, node)))
            seen = np.maximum.accumulate(np.where(node, np.arange(len(node)), -1))
            ahead = np.concatenate([[-1], seen[:-1]])
            known = (ahead >= 0) & (grp[ahead] == grp)
            rest = slice(int(last is not None), None)
            columns = [grp, f, id_, node.astype(bool), pa.array(id_[ahead], mask=~known), pa.array(f[ahead], mask=~known), np.full(len(grp), part, np.int32), ahead < 0]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c))[rest] for c in columns], names=[c.split()[0] for c in schema.split(", ")])
            if seen[-1] >= 0:
                last = grp[seen[-1]], f[seen[-1]], id_[seen[-1]]
        if last is not None:  # the range's last node, for those behind it
            yield pa.RecordBatch.from_arrays([pa.array([int(last[0])], pa.int64()), pa.array([float(last[1])]), pa.array([int(last[2])], pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([part], pa.int32()), pa.array([False])], names=[c.split()[0] for c in schema.split(", ")])

    made = stored(dealt.mapInArrow(run, schema), "in-order")
    tails = {r.part: (r.grp, r.id, r.f) for r in made.filter("is_node IS NULL").collect()}
    carried, now = [], None
    for part in range(_ranges(rows)):  # a range without nodes hands on what it got
        if now is not None:
            carried.append((part, *now))
        now = tails.get(part, now)
    ahead = spark.createDataFrame(carried, "at int, c_grp long, c_id long, c_f double")
    filled = made.filter("is_node IS NOT NULL").join(F.broadcast(ahead), F.col("open") & (F.col("part") == F.col("at")) & (F.col("grp") == F.col("c_grp")), "left")
    return filled.select("grp", "f", "id", "is_node", F.coalesce("prev", "c_id").alias("prev"), F.coalesce("prev_f", "c_f").alias("prev_f"))


def ranked(rows: DataFrame) -> DataFrame:
    """id and rank, from 1, of ``rows`` (f, id) in their order; the driver holds one count per range."""
    dealt = rows.select("f", "id").repartitionByRange(_ranges(rows), "f", "id").sortWithinPartitions("f", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.arange(n + 1, n + batch.num_rows + 1)), pa.array(np.full(batch.num_rows, part, np.int32))], names=["id", "place", "part"])
            n += batch.num_rows

    made = stored(dealt.mapInArrow(run, "id long, place long, part int"), "ranked")
    sizes = sorted((r.part, r.n) for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "at int, start long")
    return made.join(F.broadcast(offsets), F.col("part") == F.col("at")).select("id", (F.col("place") + F.col("start")).alias("rank"))
