"""Sets of word shingles, exact checks of pairs by Jaccard similarity, and the pairs that a fingerprint misses.

A part of operator 5 (``simhash_dedup.similar``). Words are lower-cased (A to Z) and split at ASCII white
space; a text's set holds the XXH64 values (seed 42) of its shingles, a text of fewer words is one shingle,
a text without words has the empty set.

*Checks* (``verified``). Candidate pairs are dealt by the connected components that they form, so that a set
travels once and not once for each of its pairs; components of many values are cut into blocks, and the
candidates of each pair of blocks are a task's unit. Sets are made again from the texts that a bitmap of fixed size
lets through: they are larger than the texts.

*Pairs* (``small_pairs``, ``large_links``). Two sets of at least 0.8 similarity share a value among the first
``n - ceil(0.8 n) + 1`` of either, in any one order of all values, so every pair to link meets in the bucket of
such a value. The order takes values that are frequent in a sample of documents last, which keeps buckets
small; the sample decides on speed only, never on results. Pairs of a bucket of at most ``SMALL`` sets are
written if enough values are left behind the shared one, which holds at the first value that two similar sets
share, and if parities of the sets (a bit per value or two) don't rule them out. A larger bucket first gives
pairs with the set that has the fewest rarer values, of near copies one with few changes; so rows grow with a group
of near copies and not with its square. Where these don't connect it, its sets are dealt to blocks by size and group,
and pairs of blocks whose sizes can be similar are compared by their parities, unless one group holds both. A set whose
place in the bucket leaves it too few values for sets of its own size or larger only meets smaller ones, or none. The
pairs left are checked like others; a block with very many of them is compared whole, by matrix products of memberships.
Sets that stay apart in a bucket are still compared with all of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, to_arrow, trimmed
from .components import FEW, components

SEED = 42
#: Least similarity, as a fraction of whole numbers.
OVER, UNDER = 4, 5
#: Long texts are cut into pieces of about so many bytes.
PIECE = 1 << 20
#: Least number of bits by which pairs are ruled out before whole sets are fetched.
PARITY_BITS = 64
#: Buckets of more sets than this are not written as pairs; blocks that they are cut into.
SMALL, BLOCK = 32, 256
#: A block in which parities leave more pairs per set than this is compared whole.
DENSE = 4
#: Candidates are checked in blocks of about so many values; blocks of large buckets, which are compared whole, hold fewer.
BLOCK_VALUES, LARGE_VALUES = 1 << 21, 1 << 19
#: Size of the bitmap of wanted documents, a power of two.
BITMAP_BITS = 1 << 23
#: One in so many documents is counted for the order; a value counts as frequent from so many, and so many values are kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 4, 1 << 16
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def shingles(text: bytes, words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in pieces; none for a text without words."""
    digest, at, last, held = xxhash.xxh64_intdigest, 0, [], False
    while at < len(text):
        cut = _BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        stop = cut.start() if cut else len(text)
        found = last + text[at:stop].lower().split()
        at = stop + 1
        if len(found) < words:
            last = found
            continue
        held = True
        whole = b" ".join(found)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(found) - words + 1]
        last = found[len(found) - words + 1 :]
        del found
        yield np.array([digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())], np.uint64)
    if not held and last:
        yield np.array([digest(b" ".join(last), SEED)], np.uint64)


def as_set(hashes: list[np.ndarray]) -> np.ndarray:
    """Rising, each value once, as signed numbers."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]).view(np.int64))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return as_set(list(shingles(text, words)))


def alike(shared, n, m):
    """Whether sets of n and m values that share so many are at least 0.8 similar, in whole numbers."""
    return (OVER + UNDER) * shared >= OVER * (n + m)


def prefix(values: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first values of a set in the order (frequency, value); as many as a similar set must meet."""
    if not len(values):
        return values
    many = len(values) - -(-OVER * len(values) // UNDER) + 1
    if not len(often):
        return values[:many]
    at = np.minimum(np.searchsorted(often, values), len(often) - 1)
    count = np.where(often[at] == values, counts[at], 0)
    return values[np.lexsort((values, count))][:many]


def frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a sample of rows (doc_id, payload) that recur, rising, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for t in part.column("payload").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words))], names=["value"])

    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("payload")
    found = sample.mapInArrow(run, "value long").groupBy("value").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "value").limit(MOST_FREQUENT).collect()
    values = np.array([r["value"] for r in found], np.int64)
    order = np.argsort(values)
    return values[order], np.array([r["count"] for r in found], np.int64)[order]


def parity(values: np.ndarray) -> bytes:
    """A power of two of bits, one per value or more; two sets differ in no fewer values than their parities differ in bits."""
    bits = max(PARITY_BITS, 1 << max(0, len(values) - 1).bit_length())
    return np.packbits(np.bincount(values & (bits - 1), minlength=bits) & 1).tobytes()


def parities_differ(x: bytes, y: bytes) -> int:
    """In how many bits, the longer one folded to the shorter one's size (which parities allow)."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sizes and parities don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([parities_differ(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())], np.int64)
            both = np.asarray(batch.column("n")).astype(np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((OVER + UNDER) * apart <= (UNDER - OVER) * both))

    left, right = (nodes.select(F.col("node").alias(f"{k}_node"), F.col("bits").alias(k), F.col("n").alias(f"{k}_n")) for k in "xy")
    joined = pairs.join(left, F.col("a") == F.col("x_node")).join(right, F.col("b") == F.col("y_node"))
    near = (OVER * F.col("x_n") <= UNDER * F.col("y_n")) & (OVER * F.col("y_n") <= UNDER * F.col("x_n"))
    return joined.filter(near).select("a", "b", "x", "y", (F.col("x_n") + F.col("y_n")).alias("n")).mapInArrow(run, "a long, b long")


def _bitmap(ids: DataFrame, column: str) -> bytes:
    """Which hashes, modulo ``BITMAP_BITS``, some ids have; of that size whatever their number."""
    place = F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))
    rows = ids.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    parts = {r["part"]: bytes(r["bits"]) for r in rows}  # 32,768 bits each; the engine counts them from 0 for place 0 and from 1 for the others
    return b"".join(parts.get(k, bytes(4096)) for k in range(BITMAP_BITS // 32768 + 2))


def sets_of(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """sig and set, as bytes, at least of the rows (doc_id, payload) whose id ``wanted`` (least) has; copies may repeat."""
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(wanted, "least"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS))
    schema = "sig binary, set binary"
    arrow = to_arrow(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            part, bit = (np.asarray(batch.column(c)).astype(np.int64) for c in ("part", "bit"))
            hit = table[part * 4096 + (bit >> 3)] >> (bit & 7) & 1
            for some in slices(batch.filter(pa.array(hit.astype(bool)))):
                sets = [shingle_set(t, words) for t in some.column("payload").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=arrow)

    return rows.select("payload", F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).mapInArrow(lambda batches: trimmed(run(batches)), schema)


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose sets are at least 0.8 similar, stored.

    ``nodes``: node, sig, n and least, an id of a row (doc_id, payload) that has the set.
    """
    pairs = stored(pairs, "candidates")
    group = components(pairs, few=FEW)
    placed = group.join(nodes.select(F.col("node").alias("of"), "sig", "n", "least"), F.col("node") == F.col("of")).drop("of")
    blocks = placed.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_VALUES).cast("int").alias("blocks"))
    placed = stored(placed.join(blocks, "component").select("node", "sig", "least", "component", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int").alias("block")), "candidate-nodes")
    left, right = (placed.select(F.col("node").alias(f"{k}_node"), F.col("block").alias(f"{k}_block"), F.col("component").alias(f"{k}_component")) for k in "xy")
    keyed = pairs.join(left, F.col("a") == F.col("x_node")).join(right.drop("y_component"), F.col("b") == F.col("y_node"))
    keyed = stored(keyed.select(F.col("x_component").alias("component"), F.least("x_block", "y_block").alias("i"), F.greatest("x_block", "y_block").alias("j"), "a", "b"), "candidate-blocks")
    sent = keyed.select("component", "i", "j", F.explode(F.array("a", "b")).alias("node")).distinct().join(placed.select(F.col("node").alias("of"), "sig"), F.col("node") == F.col("of")).drop("of")
    sets = sets_of(rows, placed, words).join(sent, "sig").select(F.col("component").alias("of"), F.col("i").alias("first"), F.col("j").alias("second"), "node", "set")

    def check(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {k: np.frombuffer(s.as_buffer(), np.int64) for k, s in zip(sets.column("node").to_pylist(), sets.column("set"))}
        a, b = pairs.column("a"), pairs.column("b")
        good = [alike(len(np.intersect1d(held[x], held[y], assume_unique=True)), len(held[x]), len(held[y])) for x, y in zip(a.to_pylist(), b.to_pylist())]
        return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return stored(keyed.groupBy("component", "i", "j").cogroup(sets.groupBy("of", "first", "second")).applyInArrow(check, "a long, b long"), "links")


def buckets(nodes: DataFrame) -> DataFrame:
    """Of sets (node, n, first, group): rows (a, b) of pairs of different groups that meet in a small bucket and can
    be similar, and rows (token, node, n, group, place) of the members of large buckets; stored."""
    schema = "a long, b long, token long, node long, n long, group long, place long"
    arrow = to_arrow(nodes, schema)

    def pairs_of(token: np.ndarray, node: np.ndarray, n: np.ndarray, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        order = np.lexsort((node, n, token))
        token, node, n, group, place = token[order], node[order], n[order], group[order], place[order]
        pairs = [np.empty((0, 2), np.int64)]
        for k in range(1, SMALL):
            same = token[k:] == token[:-k]
            if not same.any():
                break
            # The values to share, if similar; so many must be left from the shared one on in either set.
            least = -(-OVER * (n[k:] + n[:-k]) // (OVER + UNDER))
            same &= (group[k:] != group[:-k]) & (n[k:] - place[k:] >= least) & (n[:-k] - place[:-k] >= least)
            pairs.append(np.stack([node[:-k][same], node[k:][same]], 1))
        return np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)

    def answer(token: np.ndarray, node: np.ndarray, n: np.ndarray, group: np.ndarray, place: np.ndarray, large: bool = False) -> Iterator[pa.RecordBatch]:
        """Of whole buckets (sorted by token), or of a part of a large one."""
        size = np.ones(len(token), bool) if large else np.bincount(np.cumsum(np.r_[False, token[1:] != token[:-1]]))[np.cumsum(np.r_[False, token[1:] != token[:-1]])] > SMALL
        none = lambda k: pa.nulls(k, pa.int64())
        if size.any():
            yield pa.RecordBatch.from_arrays([none(size.sum()), none(size.sum()), *(pa.array(x[size]) for x in (token, node, n, group, place))], schema=arrow)
        found = pairs_of(*(x[~size] for x in (token, node, n, group, place)))
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), *(none(len(found)) for _ in range(5))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going = None, None  # going: a large bucket whose beginning has been written
        for batch in batches:
            token, node, packed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "node", "packed"))
            group = pc.coalesce(batch.column("group"), batch.column("node"))
            now = (token, node, packed >> 32, group.to_numpy(zero_copy_only=False), packed & 0xFFFFFFFF)
            held = now if held is None else tuple(map(np.concatenate, zip(held, now)))
            if going is not None and len(held[0]):
                stop = int(np.searchsorted(held[0], going, "right"))
                if stop:
                    yield from answer(*(c[:stop] for c in held), large=True)
                    held = tuple(c[stop:] for c in held)
            if not len(held[0]):
                continue
            going = None
            cut = int(np.searchsorted(held[0], held[0][-1]))  # sorted: the last token may go on
            if cut:
                yield from answer(*(c[:cut] for c in held))
                held = tuple(c[cut:] for c in held)
            if len(held[0]) > SMALL:
                going = int(held[0][-1])
                yield from answer(*held, large=True)
                held = tuple(c[:0] for c in held)
        if held is not None and len(held[0]):
            yield from answer(*held)

    # Few sets have a group other than themselves; rows are many, so they are kept narrow.
    rows = nodes.select("node", "n", F.nullif("group", "node").alias("group"), F.posexplode("first").alias("place", "token")).select("token", "node", "group", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("place")).alias("packed"))
    return stored(rows.repartition("token").sortWithinPartitions("token").mapInArrow(lambda batches: trimmed(run(batches)), schema), "buckets")


def _distinct_buckets(large: DataFrame) -> DataFrame:
    """The rows of one bucket of those with equal members: of the value that is the first of these in the order, as no other is
    the first that two of the members share."""
    mark = F.xxhash64("node")
    same = large.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("sum"), F.bit_xor(mark).alias("xor"), F.sum("place").alias("places"))
    one = same.groupBy("n", "sum", "xor").agg(F.min_by("token", "places").alias("one"))
    return large.join(one.select("one"), F.col("token") == F.col("one"), "left_semi")


def _size_class() -> Column:
    """Sets that can be similar are of one class or of neighbouring ones."""
    return F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / np.log(UNDER / OVER) + 1e-9).cast("int")


def star_pairs(large: DataFrame) -> DataFrame:
    """Pairs of each set of a large bucket with that of its class of size which has the fewest rarer values."""
    rows = _distinct_buckets(large).withColumn("class", _size_class())
    first = rows.groupBy(F.col("token").alias("t"), F.col("class").alias("c")).agg(F.min(F.struct("place", "node", "group")).alias("first"))
    found = rows.join(first, (F.col("token") == F.col("t")) & (F.col("class") == F.col("c"))).filter("group <> first.group")
    return found.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")).distinct()


def block_links(nodes: list[int], groups: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets, beyond those that their groups stand for."""
    place = np.concatenate(sets)
    held = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, held = place[order], held[order]
    place = np.cumsum(np.concatenate([[False], place[1:] != place[:-1]]))  # the number of each value
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 1 << 12):
        a, b = np.searchsorted(place, [lo, lo + (1 << 12)])
        has = np.zeros((len(sets), 1 << 12), np.float32)
        has[held[a:b], place[a:b] - lo] = 1
        shared += has @ has.T
    n = np.array([len(s) for s in sets])
    above = {g: g for g in groups}

    def top(g: int) -> int:
        while above[g] != g:
            above[g] = g = above[above[g]]
        return g

    out = []
    for i, j in np.argwhere(np.triu(alike(shared.astype(np.int64), n[:, None], n[None, :]), 1)).tolist():
        x, y = top(groups[i]), top(groups[j])
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((nodes[i], nodes[j]))
    return out


def screened(n: np.ndarray, group: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Rows (i, j) of the pairs of different groups that sizes and parities don't rule out."""
    width = min(map(len, bits)) // 8
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width), axis=0) for b in bits])
    apart = np.zeros((len(n), len(n)), np.int64)
    for k in range(width):
        apart += np.bitwise_count(folded[:, k, None] ^ folded[None, :, k])
    n = n.astype(np.int64)
    both = n[:, None] + n[None, :]
    near = (OVER * n[:, None] <= UNDER * n[None, :]) & (OVER * n[None, :] <= UNDER * n[:, None])
    return np.argwhere(np.triu(near & (group[:, None] != group[None, :]) & ((OVER + UNDER) * apart <= (UNDER - OVER) * both), 1))


def _open(large: DataFrame, linked: DataFrame) -> DataFrame:
    """token, node, n, place and group (by ``linked``) of the sets of large buckets that hold two groups or more."""
    named = _distinct_buckets(large).drop("group").join(linked.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("token", "node", "n", "place", F.coalesce("component", "node").alias("group"))
    apart = named.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select(F.col("token").alias("of"))
    return named.join(apart, F.col("token") == F.col("of"), "left_semi")


def _meeting(open_: DataFrame) -> DataFrame:
    """Rows of large buckets (token, node, n, place, group) and their ``kind``: twice the class of size, and 1 more if the
    values from the shared one on are too few for a set of equal size or a larger one. Such a row can only link to smaller
    sets that aren't of such a kind, and goes if its bucket has none that is small enough."""
    late = UNDER * F.col("n") - (OVER + UNDER) * F.col("place") < OVER * F.col("n")
    rows = open_.withColumn("late", late).withColumn("kind", 2 * _size_class() + F.col("late").cast("int"))
    least = rows.groupBy(F.col("token").alias("of")).agg(F.min(F.when(~F.col("late"), F.col("n"))).alias("least"))
    return rows.join(least, F.col("token") == F.col("of")).filter(~F.col("late") | (OVER * F.col("least") <= UNDER * F.col("n") - (OVER + UNDER) * F.col("place"))).drop("of", "least", "late")


def _dealt(open_: DataFrame) -> DataFrame:
    """Rows (token, c, i, d, j, node, group): each set of a large bucket, once for each pair of blocks that it is compared in.

    A group of many sets of one kind has blocks of its own (``whole``), which aren't compared with each other; the
    other groups of that kind share blocks.
    """
    rows = _meeting(open_)
    room = lambda sets, values: F.ceil(F.greatest(sets / BLOCK, values / LARGE_VALUES)).cast("int")
    of_group = rows.groupBy("token", "kind", "group").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("values"))
    of_group = of_group.withColumn("whole", F.when((F.col("sets") >= BLOCK) | (F.col("values") >= LARGE_VALUES), F.col("group")))
    blocks = of_group.groupBy("token", "kind", "whole").agg(room(F.sum("sets"), F.sum("values")).alias("blocks"))
    own = blocks.select(F.col("token").alias("t"), F.col("kind").alias("k"), F.col("whole").alias("w"), "blocks")
    names = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("kind"), F.col("whole"), k.alias("part")))
    others = blocks.groupBy(F.col("token").alias("of")).agg(F.flatten(F.collect_list(names)).alias("blocks_of"))
    large = of_group.filter("whole IS NOT NULL").select(F.col("token").alias("t"), F.col("kind").alias("k"), F.col("whole").alias("w"))
    rows = rows.join(large, (F.col("token") == F.col("t")) & (F.col("kind") == F.col("k")) & (F.col("group") == F.col("w")), "left").select("token", "node", "group", "kind", F.col("w").alias("whole"))
    rows = rows.join(own, (F.col("token") == F.col("t")) & (F.col("kind") == F.col("k")) & F.col("whole").eqNullSafe(F.col("w")))
    rows = rows.select("token", "node", "group", F.struct("kind", "whole", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("part")).alias("own"))

    def met(x: Column) -> Column:
        """Whether block ``x`` has sets to compare with those of ``own``: not of the same whole group, of a size near enough."""
        mine, step = F.col("own.kind"), x["kind"] - F.col("own.kind")
        near = F.when(mine % 2 == 0, step.isin(-2, 0, 1, 2, 3)).otherwise(step.isin(-3, -1))
        return near & F.coalesce(x["whole"] != F.col("own.whole"), F.lit(True))

    pair = F.transform(F.filter("blocks_of", met), lambda x: F.struct(F.least("own", x).alias("low"), F.greatest("own", x).alias("high")))
    pairs = rows.join(others, F.col("token") == F.col("of")).select("token", "node", "group", F.explode(pair).alias("u"))
    name = lambda k: F.concat_ws(".", F.col(f"u.{k}.part").cast("string"), F.col(f"u.{k}.whole").cast("string"))
    return pairs.select("token", F.col("u.low.kind").alias("c"), name("low").alias("i"), F.col("u.high.kind").alias("d"), name("high").alias("j"), "node", "group")


def large_links(large: DataFrame, linked: DataFrame, nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame | None:
    """Links between the groups (``linked``: node, component) that meet in a large bucket; None if none has two groups."""
    open_ = stored(_open(large, linked), "open-buckets")
    if open_.isEmpty():
        return None
    dealt = _dealt(open_)
    key = ("token", "c", "i", "d", "j")
    mixed = dealt.groupBy(*key).agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select(*key)
    dealt = dealt.join(mixed, list(key), "left_semi")
    measured = dealt.join(nodes.select(F.col("node").alias("of"), "n", "bits"), F.col("node") == F.col("of")).select(*key, "node", F.col("group").alias("grp"), "n", "bits")
    schema = f"a long, b long, {', '.join(f'{k} {t}' for k, t in measured.select(*key).dtypes)}, node long, grp long"
    arrow = to_arrow(rows, schema)

    def screen(table: pa.Table) -> pa.Table:
        found = screened(table.column("n").to_numpy(), table.column("grp").to_numpy(), table.column("bits").to_pylist())
        if len(found) > DENSE * table.num_rows:
            return pa.table([pa.nulls(table.num_rows, pa.int64())] * 2 + [table.column(c) for c in (*key, "node", "grp")], schema=arrow)
        node = table.column("node").to_numpy()[found]
        ends = np.sort(node.reshape(-1, 2), axis=1)
        return pa.table([pa.array(ends[:, 0]), pa.array(ends[:, 1]), *(pa.nulls(len(found), f.type) for f in list(arrow)[2:])], schema=arrow)

    seen = stored(measured.groupBy(*key).applyInArrow(screen, schema), "screened")
    links = verified(seen.filter("a IS NOT NULL").select("a", "b").distinct(), nodes, rows, words)
    dense = seen.filter("a IS NULL").drop("a", "b")
    if dense.isEmpty():
        return links
    known = stored(nodes.select(F.col("node").alias("of"), "sig", "least").join(dense.select("node").distinct(), F.col("of") == F.col("node"), "left_semi"), "open-nodes")
    sets = sets_of(rows, known, words).dropDuplicates(["sig"]).join(known.select("of", "sig"), "sig")
    grouped = dense.join(sets.select("of", "set"), F.col("node") == F.col("of")).select(*key, "node", "grp", "set")

    def compare(table: pa.Table) -> pa.Table:
        found = block_links(table.column("node").to_pylist(), table.column("grp").to_pylist(), [np.frombuffer(s, np.int64) for s in table.column("set").to_pylist()])
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return links.unionByName(stored(grouped.groupBy(*key).applyInArrow(compare, "a long, b long"), "large-links"))
