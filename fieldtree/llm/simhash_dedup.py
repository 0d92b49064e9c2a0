"""SimHash near-duplicates by the generalised pigeonhole principle (operator 5).

*Fingerprints.* Texts are lower-cased (A to Z), split at ASCII white space and taken as word shingles
with repeats; a text of fewer words is one shingle, a text without words has the zero fingerprint.
A bit is set if it is set in more than half of the shingles' XXH64 values (seed 42).

*Search.* Equal fingerprints are one from here on. The 64 bits are dealt into parts, correlated bits
together. If two fingerprints differ in at most ``t`` bits and the parts' thresholds sum to
``t - parts + 1``, then some part differs in no more than its threshold (-1 passes a part over). Each
fingerprint gets its own thresholds by dynamic programming on the number of candidates that the
parts' histograms promise. It is filed under its value of each part, and looks in every value within
its threshold. That holds for either side of a pair, so no link is lost. The number of parts is the
one with the least estimated work.

*Links.* A bucket's candidates are verified on all 64 bits, without writing pairs out: a bucket gives
a spanning forest of its links, at most one row per fingerprint. A bucket of more than
``BUCKET_ROWS`` fingerprints is cut into blocks, and each pair of blocks is a bucket of its own.
Connected components over these rows are the duplicate groups.

*Similarity* (``similar``). Fingerprints within a few bits are nearly always similar texts, but the reverse
doesn't hold: shingle sets of Jaccard similarity 0.8 differ in 10 of 64 bits on average and in up to 17,
and at that radius the pigeonhole search compares a fixed share of all pairs. So the search gives
candidates, which are checked on whole sets, and similar texts that are further apart come from the
prefixes of their sets, without loss (``shingle_sets``). Groups that the search has found are not compared
within themselves again.

Nulls: a null text has no words; a null id is never the least of its group unless all are null.
Repeated ids and rows stay, with equal results. Empty tables give empty results; other columns are
ignored (``near_duplicates_removed`` and ``similar_removed`` keep them). Long texts are taken in pieces
of a megabyte; beyond the text, a set takes eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, row_map, slices, stored, to_arrow, trimmed, unused, utf8
from .components import FEW, components
from .shingle_sets import as_set, buckets, digest, frequent, large_links, parity, possible, prefix, shingles, star_pairs, verified

BITS = 64
#: Largest radius and finest histogram that thresholds are planned with.
WIDEST, HISTOGRAM_BITS = 3, 16
BUCKET_ROWS = 1 << 14
#: Work, in nanoseconds, of a row that is filed or looked up, and of a pair that is compared.
ROW_COST, PAIR_COST = 4000, 8


def majority(hashes: Iterator[np.ndarray] | list[np.ndarray]) -> int:
    """The bits that are set in more than half of some hashes, unsigned."""
    counts, total = np.zeros(BITS, np.int64), 0
    for some in hashes:
        total += len(some)
        for lo in range(0, len(some), 1 << 14):
            counts += np.unpackbits(some[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(counts * 2 > total).astype(np.uint64)).sum())


def fingerprint(text: bytes, words: int) -> int:
    """Of one text, unsigned."""
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number; whole texts, no shuffle."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("payload"))
    schema = "doc_id long, fp long"
    arrow = to_arrow(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = np.array([fingerprint(t, words) for t in part.column("payload").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made.view(np.int64))], schema=arrow)

    return rows.mapInArrow(run, schema)


def _bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and in how many each two bits are set together, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = np.asarray(batch.column("fp")).view(np.uint64)
            for lo in range(0, len(values), 1 << 14):
                bits = np.unpackbits(np.ascontiguousarray(values[lo : lo + (1 << 14)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                rows += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel()), pa.array(np.full(BITS * BITS, rows, np.int64))], names=["cell", "n", "rows"])

    summed = prints.mapInArrow(run, "cell int, n double, rows long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    together = np.zeros(BITS * BITS)
    for row in summed:
        together[row.cell] = row.n
    return (summed[0].rows if summed else 0), together.reshape(BITS, BITS)


def correlated_parts(count: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into parts of nearly equal size, each grown from a bit by the strongest correlation."""
    share = np.diag(together) / max(count, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    strength = np.abs((together / max(count, 1) - np.outer(share, share)) / np.outer(spread, spread))
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        # Begin with the bit that says least: the most uneven one.
        part = [max(left, key=lambda b: (abs(share[b] - 0.5), -b))]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: (round(strength[b, part].sum(), 6), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def part_values(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for k, b in enumerate(bits):
        out |= (values >> np.uint64(b) & np.uint64(1)).astype(np.int64) << k
    return out


def within(histogram: np.ndarray, radius: int) -> np.ndarray:
    """For each value the rows whose value differs in at most 0, 1, ... ``radius`` bits."""
    width = int(np.log2(len(histogram)))
    shells = [histogram.astype(np.float64), *(np.zeros(len(histogram)) for _ in range(radius))]
    index = np.arange(len(histogram))
    for b in range(width):
        for r in range(radius, 0, -1):
            shells[r] += shells[r - 1][index ^ (1 << b)]
    return np.cumsum(shells, axis=0)


class Plan:
    """Parts, and for each fingerprint the thresholds with the fewest estimated candidates."""

    def __init__(self, parts: list[list[int]], near: list[np.ndarray], limit: int):
        self.parts, self.near, self.limit = parts, near, limit

    def thresholds(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per fingerprint and part the threshold, from -1; and the estimated cost."""
        total = self.limit + 1  # thresholds are counted from -1, so they sum to limit - parts + 1 + parts
        best = np.full((total + 1, len(values)), np.inf)
        best[0] = 0
        chosen = []
        for bits, near in zip(self.parts, self.near):
            folded = part_values(values, bits[:HISTOGRAM_BITS])
            probes, cost = 1.0, [np.zeros(len(values))]
            for r in range(min(WIDEST, len(bits)) + 1):
                if r:
                    probes += np.prod([(len(bits) - i) / (i + 1) for i in range(r)])
                cost.append(probes * ROW_COST + near[r][folded] * PAIR_COST)
            after = np.full_like(best, np.inf)
            pick = np.zeros(best.shape, np.int8)
            for used in range(total + 1):
                for r in range(min(len(cost), used + 1)):
                    now = best[used - r] + cost[r]
                    better = now < after[used]
                    after[used][better] = now[better]
                    pick[used][better] = r
            best, _ = after, chosen.append(pick)
        out, used = np.empty((len(self.parts), len(values)), np.int64), np.full(len(values), total)
        for k in range(len(self.parts) - 1, -1, -1):
            r = chosen[k][used, np.arange(len(values))].astype(np.int64)
            out[k], used = r - 1, used - r
        return out, best[total]


def plan(prints: DataFrame, limit: int) -> Plan | None:
    """Count all fingerprints' bits and part values, and take the number of parts with the least cost.

    The driver gets 64 x 64 counts and at most ``2 ** HISTOGRAM_BITS`` values a part, whatever the input.
    """
    count, together = _bit_counts(prints)
    if count < 2:
        return None
    candidates = {}
    for parts in range(max(2, -(-(limit + 1) // (WIDEST + 1))), limit + 2):
        made = correlated_parts(count, together, parts)
        # The mean cost under independent bits, each with its own share, is enough to rank the choices.
        share = np.diag(together) / count
        alike = share**2 + (1 - share) ** 2
        spare, cost = limit - parts + 1, 0.0
        radii = [spare // parts + (k < spare % parts) for k in range(parts)]
        for bits, r in zip(made, radii):
            shells = np.zeros(r + 1)
            shells[0] = 1
            for b in bits:
                shells = shells * alike[b] + np.concatenate([[0], shells[:-1]]) * (1 - alike[b])
            probes = sum(np.prod([(len(bits) - i) / (i + 1) for i in range(k)]) for k in range(r + 1))
            cost += (probes + 1) * ROW_COST + count * shells.sum() * PAIR_COST
        candidates[cost] = made
    parts = candidates[min(candidates)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << min(len(b), HISTOGRAM_BITS), np.int64) for b in parts]
        for batch in batches:
            values = np.asarray(batch.column("fp")).view(np.uint64)
            for total, bits in zip(sums, parts):
                total += np.bincount(part_values(values, bits[:HISTOGRAM_BITS]), minlength=len(total))
        for k, total in enumerate(sums):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(total[some])], names=["part", "value", "n"])

    share = np.diag(together) / count
    alike = share**2 + (1 - share) ** 2
    near = [np.zeros(1 << min(len(b), HISTOGRAM_BITS), np.int64) for b in parts]
    summed = prints.mapInArrow(run, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    for k, own in summed.groupby("part"):
        near[k][own["value"]] = own["n"]
    return Plan(parts, [unseen(within(h, WIDEST), alike[b[HISTOGRAM_BITS:]]) for h, b in zip(near, parts)], limit)


def unseen(near: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """``within`` for wider parts: of the bits beyond the histogram, each equal with its own chance, some may differ."""
    chance = np.zeros(len(near))
    chance[0] = 1
    for share in alike:
        chance = chance * share + np.concatenate([[0], chance[:-1]]) * (1 - share)
    shells = np.diff(near, axis=0, prepend=0)
    return np.stack([sum(shells[k] * chance[: r - k + 1].sum() for k in range(r + 1)) for r in range(len(near))])


def flips(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``radius`` set, by number of bits."""
    made = [np.zeros(1, np.int64)]
    for _ in range(radius):
        grown = (made[-1][:, None] | (np.int64(1) << np.arange(width))).ravel()
        grown = np.unique(grown)
        made.append(np.setdiff1d(grown, np.concatenate(made)))
    return np.concatenate(made)


def _filed(prints: DataFrame, plan: Plan) -> DataFrame:
    """bucket (part and value), fp, and whether the fingerprint is filed there or looks there."""
    schema = "bucket long, looks boolean, fp long"
    arrow = to_arrow(prints, schema)
    sent = prints.sparkSession.sparkContext.broadcast((plan.parts, plan.near, plan.limit))
    masks = {(len(b), r): flips(len(b), r) for b in plan.parts for r in range(WIDEST + 1) if r <= plan.limit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Plan(*sent.value)
        for batch in batches:
            all_values = np.asarray(batch.column("fp")).view(np.uint64)
            for lo in range(0, len(all_values), 4096):
                values = np.ascontiguousarray(all_values[lo : lo + 4096])
                thresholds, _ = own.thresholds(values)
                for k, bits in enumerate(own.parts):
                    places = part_values(values, bits)
                    tag = np.int64(k) << np.int64(58)
                    yield _rows(arrow, places | tag, False, values)
                    for r in range(WIDEST + 1):
                        if (chosen := thresholds[k] == r).any():
                            mask = masks[len(bits), r]
                            yield _rows(arrow, (places[chosen][:, None] ^ mask).ravel() | tag, True, np.repeat(values[chosen], len(mask)))

    return prints.mapInArrow(run, schema)


def _rows(arrow: pa.Schema, buckets: np.ndarray, looks: bool, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.full(len(buckets), looks)), pa.array(values.view(np.int64))], schema=arrow)


def forest(filed: np.ndarray, looking: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of at most ``limit`` bits between the two sides of a bucket: a spanning forest of them.

    Breadth first from each value: what is reached is never compared again, so a dense group costs
    little more than its size.
    """
    values = np.unique(np.concatenate([filed, looking]))
    sides = [np.isin(values, looking), np.isin(values, filed)]
    left = np.ones(len(values), bool)
    out = []
    for seed in range(len(values)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            # A pair counts if at least one of the two looks where the other is filed.
            may = left & ((sides[1] & sides[0][at]) | (sides[0] & sides[1][at]))
            others = np.flatnonzero(may)
            near = others[np.bitwise_count(values[others] ^ values[at]) <= limit]
            left[near] = False
            out += [(int(values[at]), int(values[o])) for o in near]
            queue += near.tolist()
    return out


def bucket_links(buckets: np.ndarray, looks: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole buckets, given sorted by bucket, as two arrays of ends."""
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(buckets)]]))
    filed = np.add.reduceat((~looks).astype(np.int64), first)
    pairs = filed * (sizes - filed)
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    big = pairs > 4096
    for f, n in zip(first[big], sizes[big]):
        own, side = values[f : f + n], looks[f : f + n]
        links = np.array(forest(own[~side], own[side], limit), np.uint64).reshape(-1, 2)
        left.append(links[:, 0])
        right.append(links[:, 1])
    # Small buckets together: every looking row against every filed row of its bucket.
    small = np.repeat(~big & (pairs > 0), sizes)
    bucket = np.repeat(np.arange(len(first)), sizes)
    ask = np.flatnonzero(small & looks)
    # Filed rows come first within a bucket.
    counts = filed[bucket[ask]]
    for lo in range(0, len(ask), 1 << 16):
        some, own = ask[lo : lo + (1 << 16)], counts[lo : lo + (1 << 16)]
        a = np.repeat(some, own)
        b = np.repeat(first[bucket[some]], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        differ = np.bitwise_count(values[a] ^ values[b])
        hit = (differ <= limit) & (differ > 0)
        left.append(values[a[hit]])
        right.append(values[b[hit]])
    return np.concatenate(left), np.concatenate(right)


def links(prints: DataFrame, limit: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """a and b: links whose components are those of all pairs within ``limit`` bits.

    ``prints`` has distinct values in column fp.
    """
    spark = prints.sparkSession
    made = plan(prints, limit)
    if made is None:
        return spark.createDataFrame([], "a long, b long")
    rows = _filed(prints, made).withColumn("block", F.lit(0))
    sizes = rows.groupBy("bucket").count().filter(F.col("count") > bucket_rows)
    large = stored(sizes.select(F.col("bucket").alias("large"), F.ceil(F.col("count") / bucket_rows).cast("int").alias("blocks")), "large-buckets")
    if not large.isEmpty():
        # Pairs of blocks: a row goes to each pair that its own block is in.
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(k, own) * F.col("blocks") + F.greatest(k, own))
        rows = rows.join(large, F.col("bucket") == F.col("large"), "left").select("bucket", "looks", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pair)).alias("block"))
    rows = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "looks")
    schema = "a long, b long"
    arrow = to_arrow(prints, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def answer(rows: list[np.ndarray]) -> pa.RecordBatch:
            bucket, block, looks, fp = rows
            same = np.concatenate([[0], np.cumsum((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]))])
            a, b = bucket_links(same, looks, fp.view(np.uint64), limit)
            ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k]).view(np.int64)) for k in (0, 1)], schema=arrow)

        for batch in batches:
            now = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("bucket", "block", "looks", "fp")]
            if not len(now[0]):
                continue
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield answer([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield answer(held)

    return rows.select("bucket", "block", "looks", "fp").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, limit: int = 4, **sizes: int) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id of the duplicate group, for every row."""
    rows = stored(fingerprints(docs, key, text, words), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = components(links(distinct.select("fp"), limit, **sizes))
    named = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    groups = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(groups, "component").select(F.col("fp").alias("of"), "component_id")
    return rows.join(by_print, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def hex_print(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def near_duplicates_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, limit: int = 4) -> DataFrame:
    """``docs`` without the rows of a duplicate group but one (``_removed``)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("payload")).withColumn("mark", F.unhex(F.md5("payload")))
    made = stored(row_map(rows, "doc_id long, mark binary, fp long", lambda i, m, t: (i, m, _signed(fingerprint(t, words))), ["doc_id", "mark", "payload"]), "fingerprints")
    classes = stored(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    return _removed(docs, _components_of(made, classes, components(links(classes.select("fp"), limit)), "fp", "fp"), key, text)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, mark, sig, n, fp, first and bits of every row (doc_id, mark, payload): of its shingles the set's
    digest and size, the fingerprint, the set's prefix and its parity. One pass over the texts; no shuffle."""
    often, counts = frequent(rows, words)
    schema = "doc_id long, mark binary, sig binary, n int, fp long, first array<long>, bits binary"
    arrow = to_arrow(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = []
                for t in part.column("payload").to_pylist():
                    hashes = list(shingles(t, words))
                    own = as_set(hashes)
                    made.append((digest(own), len(own), _signed(majority(hashes)), prefix(own, often, counts), parity(own)))
                sig, n, fp, first, bits = zip(*made)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate([*first, np.empty(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(sig, pa.binary()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), lists.cast(arrow.field("first").type), pa.array(bits, pa.binary())], schema=arrow)

    return rows.select("doc_id", "mark", "payload").mapInArrow(lambda batches: trimmed(run(batches)), schema)


def _candidates(nodes: DataFrame, limit: int) -> DataFrame:
    """a and b: sets with one fingerprint, and sets whose fingerprints the search links."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("top"))
    equal = nodes.join(first, "fp").filter("node <> top").select(F.col("top").alias("a"), F.col("node").alias("b"))
    at = lambda k: first.select(F.col("fp").alias(f"fp_{k}"), F.col("top").alias(f"top_{k}"))
    near = links(nodes.select("fp").distinct(), limit).join(at("a"), F.col("a") == F.col("fp_a")).join(at("b"), F.col("b") == F.col("fp_b"))
    return equal.unionByName(near.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b"))).distinct()


def _grouped(nodes: DataFrame, rows: DataFrame, words: int, limit: int) -> DataFrame:
    """node and component of the sets that are linked to others, over all links of 0.8 similarity or more."""
    found = verified(possible(_candidates(nodes, limit), nodes), nodes, rows, words)
    searched = components(found, few=FEW)
    named = nodes.join(searched.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "n", "first", F.coalesce("component", "node").alias("group"))
    met = buckets(named)
    large = met.filter("token IS NOT NULL").select("token", "node", "n", "group", "place")
    pairs = met.filter("token IS NULL").select("a", "b").unionByName(star_pairs(large)).distinct()
    edges = found.unionByName(verified(possible(pairs, nodes), nodes, rows, words))
    linked = components(edges, few=FEW)
    more = None if large.isEmpty() else large_links(large, linked, nodes, rows, words)
    return linked if more is None else components(edges.unionByName(more), few=FEW)


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, limit: int = 4) -> DataFrame:
    """doc_id, mark (a digest of the text), component (a number of the group of similar texts) and component_id,
    the group's least doc_id, for every row. Where ids repeat, several groups can have one least id."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("payload")).withColumn("mark", F.unhex(F.md5("payload")))
    made = stored(_sketches(rows, words), "sketches")
    nodes = made.groupBy("sig").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "first", "bits"))).withColumn("node", F.monotonically_increasing_id())
    nodes, made = stored(nodes, "nodes"), discarded(made, stored(made.select("doc_id", "mark", "sig"), "rows"))
    linked = _grouped(nodes, rows.select("doc_id", "payload"), words, limit)
    return _components_of(made, nodes.select("sig", "least", "node"), linked, "sig", "node")


def _components_of(made: DataFrame, classes: DataFrame, linked: DataFrame, value: str, node: str) -> DataFrame:
    """doc_id, mark, component and component_id of every row, by its class (``value``) and the classes' components."""
    named = classes.join(linked.withColumnRenamed("node", "of"), F.col(node) == F.col("of"), "left").select(F.col(value).alias("of"), "least", F.coalesce("component", node).alias("component"))
    groups = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return made.join(named.join(groups, "component").select("of", "component", "component_id"), F.col(value) == F.col("of")).select("doc_id", "mark", "component", "component_id")


def similar_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, limit: int = 4) -> DataFrame:
    """``docs`` without the rows of a group of similar texts but one (``_removed``)."""
    return _removed(docs, similar(docs, key, text, words, limit), key, text)


def _removed(docs: DataFrame, named: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` without the rows of each group (``named``: doc_id, mark, component, component_id) but one.

    That with the least id stays; if several texts of the group have it, that with the least MD5; if rows
    repeat both, one of them, and which one is not defined. A row without an id goes if its group has an
    id; groups without any id stay whole, since nothing tells which to keep.
    """
    mark_, id_, of_ = unused(docs, "mark", "id", "of")
    named = stored(named, "groups")
    first = named.filter("doc_id = component_id").groupBy(F.col("component").alias("of")).agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("n"))
    joined = named.join(first, F.col("component") == F.col("of"))
    gone = joined.filter("doc_id IS NULL OR doc_id <> component_id OR mark <> first").select(F.col("doc_id").alias(id_), F.col("mark").alias(of_)).distinct()
    rows = docs.withColumn(mark_, F.unhex(F.md5(utf8(text))))
    out = rows.join(gone, (F.col(mark_) == F.col(of_)) & F.col(key).cast("long").eqNullSafe(F.col(id_)), "left_anti")
    if not joined.filter("doc_id = component_id AND mark = first AND n > 1").groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        out = out.filter(F.col(key).isNotNull()).dropDuplicates([key, mark_]).unionByName(out.filter(F.col(key).isNull()))
    return out.select(*docs.columns)
