"""Approximate nearest neighbours: a navigable small-world graph per shard (operator 4).

*Index.* Equal vectors are one entry with the few smallest ids that a result can hold. Entries are
dealt to shards by a hash of the vector. A shard's graph has levels (each entry's top level is drawn
from a geometric law by its hash); on each level an entry keeps at most ``LINKS`` neighbours (twice
as many on the ground), chosen by the rule that a neighbour must be nearer to the entry than to any
neighbour chosen before. A shard is stored as one row of flat arrays: vectors, ids, per level the
entries and a neighbour matrix (-1: none).

Entries are inserted in batches that at most double the graph, so that a batch searches the graph
in step, as matrices; entries of one batch see each other through an exact search within the batch.

*Search.* Every query goes to every shard, in batches in step: greedy descent to the ground, then a
beam of ``EF`` entries. Shard results are merged by exact distance and id.

Distances of results are Euclidean in double precision on the original vectors. The graph itself is
walked on vectors less the shard's median, scaled to at most 1, by sums of squared differences: in
single precision, or in double where components differ too much in size for that.

Nulls: a row whose vector is null, zero, or holds null or non-finite components takes no part,
neither as a query nor as a candidate, nor does a row without an id. Vectors of other lengths than the
most common one are an error of the data and raise. Repeated rows with one id count once; an id with
several different vectors is as far as the nearest of them, be it asked for or found. Empty tables
give empty results; other columns are ignored. With fewer candidates than asked for, all are
returned: shards of at most ``EF`` entries are searched whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, to_arrow

SHARD_ENTRIES = 16_384
LINKS, BUILD_EF, EF = 16, 80, 160
QUERY_BATCH = 256
#: One task searches at most so many shards, some 16 MB each at 64 dimensions.
MOST_TOGETHER = 8
#: An entry goes up a level with this chance.
UP = 1 / LINKS


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def scaling(vectors: np.ndarray) -> tuple[np.ndarray, float, float, type]:
    """Of a shard: a first scale, the middle on that scale, the scale of what differs from it, and the precision that will do.

    Scales are powers of two, so they round nothing.
    """
    if not vectors.size:
        return np.zeros(vectors.shape[1:]), 1.0, 1.0, np.float32
    whole = 2.0 ** -np.ceil(np.log2(max(np.abs(vectors).max(), 2.0**-1000)) + 1)
    scaled = vectors * whole
    middle = np.partition(scaled, len(scaled) // 2, axis=0)[len(scaled) // 2]
    off = np.abs(scaled - middle)
    most = max(off.max(), 2.0**-1000)
    inner = float(2.0 ** -np.ceil(np.log2(most)))
    spread = np.median(off.max(axis=1)) if len(off) > 1 else most
    return middle, whole, inner, np.float32 if spread > most * 2.0**-10 else np.float64


def euclid(off: np.ndarray) -> np.ndarray:
    """Lengths of rows; scaled where squares would leave the range of doubles."""
    most = np.abs(off).max(initial=0.0)
    if 1e-140 < most < 1e150 or not most:
        return np.sqrt((off**2).sum(axis=1))
    scale = 2.0 ** np.floor(np.log2(np.maximum(np.abs(off).max(axis=1), 2.0**-1000)))
    return np.sqrt(((off / scale[:, None]) ** 2).sum(axis=1)) * scale


class Graph:
    """The graph of one shard: levels of entries with neighbour matrices."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.middle, self.whole, self.inner, self.kind = scaling(vectors)
        self.vectors = self.placed(vectors)
        self.levels = levels
        self.top = int(levels.max(initial=0))
        n = len(vectors)
        self.width = [2 * LINKS] + [LINKS] * self.top
        self.near = [np.full((n, w), -1, np.int32) for w in self.width]
        self.entry = -1

    def placed(self, points: np.ndarray) -> np.ndarray:
        """Points as the graph measures them; a query far outside is brought to its edge, where all entries are alike far."""
        made = (np.asarray(points, np.float64) * self.whole - self.middle) * self.inner
        most = np.abs(made).max(axis=1, initial=1.0)
        with np.errstate(invalid="ignore"):
            made = np.where(np.isfinite(most)[:, None], made / np.maximum(most / 2.0**40, 1.0)[:, None], 0.0)
        return np.ascontiguousarray(made, self.kind)

    # Distances are squared; rows of ``points`` are queries.
    def _far(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each query to its own row of entries."""
        off = self.vectors[at]
        off -= points[:, None]
        return np.einsum("bmd,bmd->bm", off, off)

    def _descend(self, points: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """The local nearest entry on a level, for all queries in step."""
        best = self._far(points, at[:, None])[:, 0]
        live = np.arange(len(points))
        while len(live):
            around = self.near[level][at[live]]
            far = np.where(around >= 0, self._far(points[live], np.maximum(around, 0)), np.inf)
            k = far.argmin(axis=1)
            least = far[np.arange(len(live)), k]
            better = least < best[live]
            live = live[better]
            best[live], at[live] = least[better], around[better, k[better]]
        return at

    def _beam(self, points: np.ndarray, start: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best entries that each query reaches, nearest first: entries (-1: none) and distances."""
        b, n = len(points), len(self.vectors)
        rows = np.arange(b)
        seen = np.zeros((b, n), bool)
        ids, far = np.full((b, ef), -1, np.int32), np.full((b, ef), np.inf, self.kind)
        done = np.ones((b, ef), bool)
        ids[:, 0], far[:, 0], done[:, 0] = start, self._far(points, start[:, None])[:, 0], False
        seen[rows, start] = True
        live = rows
        while len(live):
            # The nearest few entries that have not been opened, together.
            order = np.where(done[live], np.inf, far[live])
            take = np.argpartition(order, min(3, ef - 1), axis=1)[:, :4] if ef > 4 else order.argmin(axis=1)[:, None]
            open_ = np.isfinite(np.take_along_axis(order, take, 1))
            go = open_.any(axis=1)
            live, take, open_ = live[go], take[go], open_[go]
            if not len(live):
                break
            opened = np.where(open_, np.take_along_axis(ids[live], take, 1), -1)
            done[live[:, None], take] = True
            around = np.where(opened[:, :, None] >= 0, self.near[level][np.maximum(opened, 0)], -1).reshape(len(live), -1)
            # Each entry once per query.
            around.sort(axis=1)
            fresh = around >= 0
            fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
            fresh &= ~seen[live[:, None], np.maximum(around, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], around[r, c]] = True
            most = int(fresh.sum(axis=1).max(initial=0))
            if not most:
                continue
            packed = np.full((len(live), most), -1, np.int32)
            packed[r, (np.cumsum(fresh, axis=1) - 1)[r, c]] = around[r, c]
            new = np.where(packed >= 0, self._far(points[live], np.maximum(packed, 0)), np.inf).astype(self.kind)
            all_ids, all_far = np.concatenate([ids[live], packed], axis=1), np.concatenate([far[live], new], axis=1)
            all_done = np.concatenate([done[live], packed < 0], axis=1)
            keep = np.argpartition(all_far, ef - 1, axis=1)[:, :ef]
            ids[live], far[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_far, all_done))
        order = far.argsort(axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)

    def _choose(self, owner: np.ndarray, ids: np.ndarray, far: np.ndarray, width: int) -> np.ndarray:
        """Of each row of candidates, nearest first, those nearer to the owner than to any chosen before."""
        b, m = ids.shape
        out, count = np.full((b, width), -1, np.int32), np.zeros(b, np.int64)
        spread = np.full((b, m), np.inf, self.kind)  # of each candidate to the nearest chosen one
        rows = np.arange(b)
        vectors = self.vectors[np.maximum(ids, 0)]
        for k in range(m):
            good = (ids[:, k] >= 0) & (far[:, k] < spread[:, k]) & (count < width) & (ids[:, k] != owner)
            r = rows[good]
            if not len(r):
                continue
            out[r, count[r]] = ids[r, k]
            count[r] += 1
            off = vectors[r]
            off -= vectors[r, k][:, None]
            spread[r] = np.minimum(spread[r], np.einsum("bmd,bmd->bm", off, off))
        # Free places go to the nearest of those passed over.
        for k in range(m):
            r = rows[(ids[:, k] >= 0) & (count < np.minimum(width, LINKS)) & (ids[:, k] != owner)]
            r = r[~(out[r] == ids[r, k][:, None]).any(axis=1)] if len(r) else r
            out[r, count[r]] = ids[r, k]
            count[r] += 1
        return out

    def build(self) -> None:
        n = len(self.vectors)
        if not n:
            return
        order = np.argsort(-self.levels, kind="stable")  # upper levels first, so that the top entry stands
        self.entry = int(order[0])
        at = 1
        while at < n:
            batch = order[at : at + max(1, min(at, 512))]
            self._insert(batch)
            at += len(batch)

    def _insert(self, batch: np.ndarray) -> None:
        points = self.vectors[batch]
        start = np.full(len(batch), self.entry)
        inner = np.concatenate([self._far(points[lo : lo + 32], np.broadcast_to(batch, (len(points[lo : lo + 32]), len(batch)))) for lo in range(0, len(batch), 32)])
        np.fill_diagonal(inner, np.inf)
        for level in range(self.top, -1, -1):
            here = np.flatnonzero(self.levels[batch] >= level)
            above = np.flatnonzero(self.levels[batch] < level)
            if len(above):
                start[above] = self._descend(points[above], start[above], level)
            if not len(here):
                continue
            ids, far = self._beam(points[here], start[here], level, BUILD_EF)
            start[here] = ids[:, 0]
            mates = inner[np.ix_(here, here)]
            k = min(2 * LINKS, len(here) - 1)
            if k:
                near = np.argpartition(mates, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, batch[here][near].astype(np.int32)], axis=1)
                far = np.concatenate([far, np.take_along_axis(mates, near, 1)], axis=1)
                by = far.argsort(axis=1)
                ids, far = np.take_along_axis(ids, by, 1), np.take_along_axis(far, by, 1)
            chosen = self._choose(batch[here], ids[:, : 2 * BUILD_EF], far[:, : 2 * BUILD_EF], LINKS)
            self.near[level][batch[here], :LINKS] = chosen
            self._link_back(batch[here], chosen, level)

    def _link_back(self, owners: np.ndarray, chosen: np.ndarray, level: int) -> None:
        """Every chosen entry gets its chooser as a neighbour, and is thinned out where it has too many."""
        r, c = np.nonzero(chosen >= 0)
        to, by = chosen[r, c], owners[r]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(to)]]))
        width = self.width[level]
        targets = to[first]
        for lo in range(0, len(targets), 1024):
            t, s, f = targets[lo : lo + 1024], sizes[lo : lo + 1024], first[lo : lo + 1024]
            wide = np.full((len(t), width + int(s.max())), -1, np.int32)
            wide[:, :width] = self.near[level][t]
            rows = np.repeat(np.arange(len(t)), s)
            offset = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            wide[rows, width + offset] = by[np.repeat(f, s) + offset]
            wide.sort(axis=1)
            wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
            far = np.where(wide >= 0, self._far(self.vectors[t], np.maximum(wide, 0)), np.inf)
            by_far = far.argsort(axis=1)
            wide, far = np.take_along_axis(wide, by_far, 1), np.take_along_axis(far, by_far, 1)
            full = (wide >= 0).sum(axis=1) > width
            made = wide[:, :width].copy()
            if full.any():
                made[full] = self._choose(t[full], wide[full][:, : 4 * width], far[full][:, : 4 * width], width)
            self.near[level][t] = made

    def search(self, points: np.ndarray, k: int, ef: int = EF) -> np.ndarray:
        """Entries, nearest first as the graph measures; all of them where it has at most ``ef``."""
        n = len(self.vectors)
        if n <= max(ef, k):
            return np.broadcast_to(np.arange(n, dtype=np.int32), (len(points), n))
        points = self.placed(points)
        at = np.full(len(points), self.entry)
        for level in range(self.top, 0, -1):
            at = self._descend(points, at, level)
        # More than k, since single precision may order close ones otherwise.
        return self._beam(points, at, 0, max(ef, k))[0][:, : k + 16]

    def flat(self) -> bytes:
        """Levels one after another as flat arrays; entries without links on a level are left out."""
        parts = [struct.pack("<qqq", len(self.vectors), self.entry, self.top)]
        for level in range(self.top + 1):
            own = np.flatnonzero(self.levels >= level).astype(np.int32)
            parts += [struct.pack("<q", len(own)), own.tobytes(), self.near[level][own].tobytes()]
        return b"".join(parts)

    @classmethod
    def from_flat(cls, vectors: np.ndarray, data: bytes) -> Graph:
        n, entry, top = struct.unpack_from("<qqq", data)
        levels, at, near = np.zeros(n, np.int64), 24, []
        for level in range(top + 1):
            (count,) = struct.unpack_from("<q", data, at)
            own = np.frombuffer(data, np.int32, count, at + 8)
            width = 2 * LINKS if level == 0 else LINKS
            at += 8 + 4 * count
            matrix = np.full((n, width), -1, np.int32)
            matrix[own] = np.frombuffer(data, np.int32, count * width, at).reshape(count, width)
            at += 4 * count * width
            levels[own] = level
            near.append(matrix)
        out = cls(vectors, levels)
        out.near, out.entry, out.top = near, entry, top
        return out


def _vectors(column: pa.Array, kind: type) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return np.asarray(column.flatten()).astype(kind).reshape(len(lengths), -1) if len(lengths) else np.zeros((0, 0), kind)


def entries(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Distinct vectors as v, with the ``k + 1`` smallest ids of each: no more can be in a result.

    The ranking is limited in each task before the shuffle, so a vector that very many rows share
    sends a few rows per task.
    """
    usable_rows = rows.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    per = usable_rows.groupBy("v", "id").agg(F.lit(1).alias("one"))
    ranked = per.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def build_index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """The index as a stored table: shard, vectors (doubles), ids and their counts, and the flat graph."""
    distinct = stored(entries(rows, key, vector, k), "entries")
    shards = max(1, -(-distinct.count() // shard_entries))
    schema = "shard int, vectors binary, ids binary, counts binary, graph binary"
    arrow = to_arrow(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            vectors = _vectors(whole.column("v"), np.float64)
            ids = whole.column("ids").combine_chunks()
            codes = np.asarray(whole.column("code")).view(np.uint64)
            levels = np.minimum(np.floor(np.log(((codes >> np.uint64(11)).astype(np.float64) + 1) / 2**53) / np.log(UP)), 6).astype(np.int64)
            graph = Graph(vectors, levels)
            graph.build()
            counts = np.diff(np.asarray(ids.offsets)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([now], [vectors.tobytes()], [np.asarray(ids.flatten()).astype(np.int64).tobytes()], [counts.tobytes()], [graph.flat()]), arrow)], schema=arrow)

        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and shard[a] != now:
                        yield flush()
                        held.clear()
                    now = int(shard[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    coded = distinct.withColumn("code", F.xxhash64("v")).withColumn("shard", F.pmod(F.xxhash64("code", F.lit(7)), F.lit(shards)).cast("int"))
    dealt = coded.repartitionById(shards, "shard").sortWithinPartitions("shard", "code", "v").select("shard", "v", "ids", "code")
    return stored(dealt.mapInArrow(run, schema), "index")


def search_index(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found of each query but itself."""
    spark = index.sparkSession
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    # Shards that one task searches, so that a query's vector is sent once for all of them.
    together = max(1, min(MOST_TOGETHER, shards // (2 * spark.sparkContext.defaultParallelism)))
    tasks = -(-shards // together)
    schema = "query_id long, vec_id long, score double"
    arrow = to_arrow(index, schema)
    asked = queries.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v")).distinct()
    nothing = F.lit(None)
    left = index.select(F.floor(F.col("shard") / together).cast("int").alias("task"), F.lit(0).alias("kind"), "vectors", "ids", "counts", "graph", nothing.cast("long").alias("query_id"), nothing.cast("array<double>").alias("v"))
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(1).alias("kind"), *(nothing.cast("binary").alias(c) for c in ("vectors", "ids", "counts", "graph")), "query_id", "v")
    both = left.unionByName(right).repartitionById(tasks, "task").sortWithinPartitions("kind", "query_id").select("kind", "vectors", "ids", "counts", "graph", "query_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            cut = int(np.searchsorted(np.asarray(batch.column("kind")), 1))  # a task's shards come ahead of its queries
            held += [_loaded(batch.slice(i, 1)) for i in range(cut)]
            for lo in range(cut, batch.num_rows, QUERY_BATCH):
                some = batch.slice(lo, QUERY_BATCH)
                points, own = _vectors(some.column("v"), np.float64), np.asarray(some.column("query_id"))
                for state in held:
                    q, ids, far = _nearest(state, points, own, k, ef)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(far)], schema=arrow)

    found = both.mapInArrow(run, schema).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _loaded(part: pa.RecordBatch) -> dict:
    counts = np.frombuffer(part.column("counts")[0].as_py(), np.int32)
    vectors = np.frombuffer(part.column("vectors")[0].as_py(), np.float64).reshape(len(counts), -1)
    return {"graph": Graph.from_flat(vectors, part.column("graph")[0].as_py()), "vectors": vectors, "ids": np.frombuffer(part.column("ids")[0].as_py(), np.int64), "begins": np.concatenate([[0], np.cumsum(counts)])}


def _nearest(state: dict, points: np.ndarray, own: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard's best ``k`` rows for each query, in double precision, but the query itself."""
    found = state["graph"].search(points, k + 1, ef)
    qs, ids, far = [], [], []
    for query, point, entries_ in zip(own.tolist(), points, found):
        entries_ = entries_[entries_ >= 0]
        exact = euclid(state["vectors"][entries_] - point)
        order = np.argsort(exact, kind="stable")
        nearest: dict[int, float] = {}  # an id comes first with the nearest of its vectors
        for e in order.tolist():
            # Entries at one distance are read through before the count is taken.
            if len(nearest) >= k and exact[e] > sorted(nearest.values())[k - 1]:
                break
            for i in state["ids"][state["begins"][entries_[e]] : state["begins"][entries_[e] + 1]].tolist():
                if i != query:
                    nearest.setdefault(i, exact[e])
        rows = sorted((x, i) for i, x in nearest.items())[:k]
        qs += [query] * len(rows)
        ids += [i for _, i in rows]
        far += [x for x, _ in rows]
    return np.array(qs, np.int64), np.array(ids, np.int64), np.array(far, np.float64)
