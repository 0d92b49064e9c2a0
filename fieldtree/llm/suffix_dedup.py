"""Suffix-array dedup (operator 10): remove every byte of a long string that occurs more than once.

A string of ``LENGTH`` bytes is repeated if it starts at two places of the corpus, in one document
or in two. The exact answer takes four steps, each bounded in memory per task:

1. *Anchors.* Of the ``LENGTH - GRAM + 1`` grams of ``GRAM`` bytes in a string, the one with the
   least hash (the first of equals) is its anchor, so equal strings have equal anchors. Neighbouring
   strings mostly share an anchor; the places at which they start form a run. Runs are dealt by
   their anchor's hash, and those whose anchor occurs once can't hold a repeated string.
2. *Shards.* The text of the remaining runs is dealt by anchor, in blocks of at most ``BLOCK``
   runs, and blocks are put together to shards of about ``SHARD_BYTES``. Runs with equal text are
   one entry with a count. Over all entries a shard builds a suffix array (Larsson and Sadakane's
   refinement: sort by eight bytes, then double the depth of the groups that are not yet single),
   finds common prefixes in Kasai's order (all entries in step), and marks the strings that share
   ``LENGTH`` bytes with a neighbour or whose entry counts more than once.
3. *Merging.* Only anchors with more than one block can have equal strings in different shards.
   Their shards give their distinct strings' 128-bit fingerprints, which are dealt by value, sorted
   and looked up by binary search.
4. *Cutting.* Spans come back to the texts by content digest.

Exact copies are one text with a count; all their bytes are repeated if they have ``LENGTH``.
Nulls: a null text is empty; ids play no part, so null and repeated ids are kept as they are.
Texts shorter than ``LENGTH`` keep all their bytes, however often they occur. Empty tables give
empty results and other columns are ignored (``cut_repeats`` keeps them). Long texts are hashed in
pieces; besides the text itself a task holds some 60 bytes for each byte of a piece, not of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, to_arrow, trimmed, unused, utf8

LENGTH, GRAM = 200, 64
BLOCK = 1024
SHARD_BYTES = 2 << 20
#: Texts are hashed in pieces of at most so many starting places.
PIECE = 1 << 19
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_PLACE = np.uint64((1 << 24) - 1)


def _words(data: bytes | np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes at each place, as integers."""
    return np.ndarray((len(data) - 7,), order, data, strides=(1,)).astype(np.uint64)


def _join(left: np.ndarray, right: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of two hashes side by side."""
    out = left * _A
    out ^= out >> np.uint64(29)
    out += (right ^ seed) * _B
    out ^= out >> np.uint64(32)
    out *= _C
    return out


def gram_hashes(data: bytes | np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at each place."""
    made, size = _words(data), 8
    while size < GRAM:
        made = _join(made[:-size], made[size:], np.uint64(seed))
        size *= 2
    return made


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: number of the text, anchor's hash, first start, count."""
    out: list[tuple] = []
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, PIECE):
            piece = text[at : at + PIECE + LENGTH - 1]
            group.append((k, at, piece))
            size += len(piece)
            if size >= PIECE:
                out.append(_anchors(group))
                group, size = [], 0
    if group:
        out.append(_anchors(group))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchors(group: list[tuple[int, int, bytes]]) -> tuple:
    sizes = np.array([len(x[2]) for x in group])
    begins = np.cumsum(sizes) - sizes
    hashes = gram_hashes(b"".join([x[2] for x in group]))
    least = ((hashes * _A) & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width, grams = 1, LENGTH - GRAM + 1
    while width * 2 <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[: width - grams], least[grams - width :])
    place = (least & _PLACE).astype(np.int64)
    # Starts at which a whole string fits into its own text; a run also ends with its text.
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(group)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    chosen = place[starts]
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]))
    length = np.diff(np.concatenate([first, [len(starts)]]))
    own = owner[first]
    number, offset = np.array([x[0] for x in group])[own], np.array([x[1] for x in group])[own]
    return number, hashes[chosen[first]], starts[first] - begins[own] + offset, length


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of ``data`` in order of all that follows.

    Kasai's rule below holds only for a whole order: groups must not be left open at ``LENGTH``.
    """
    n = len(data)
    keys = _words(np.concatenate([data, np.zeros(8, np.uint8)]), ">u8")[:n]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    # Places within the order that belong to groups of two or more.
    alone = first & np.concatenate([first[1:], [True]])
    open_ = np.flatnonzero(~alone)
    h = 8
    while len(open_):
        at = order[open_]
        beyond = at + h
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        keys = rank[at] << np.int64(32) | second
        by = np.argsort(keys)
        keys, at = keys[by], at[by]
        order[open_] = at
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        open_ = open_[~(first & np.concatenate([first[1:], [True]]))]
        h *= 2
    return order


_LOW = (np.uint64(0xFF) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).astype(np.uint64)


def common_prefixes(data: np.ndarray, order: np.ndarray, begins: np.ndarray, sizes: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each place in the order, the bytes (at most ``depth``) that it shares with the one before.

    Kasai's rule: a place shares at least one byte less with its forerunner than the place to its
    left does. The runs (``begins``, ``sizes``) each follow it from left to right, all in step.
    """
    n = len(data)
    words = _words(np.concatenate([data, np.zeros(depth + 16, np.uint8)]))
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    shared = np.zeros(n, np.int32)
    by_size = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[by_size], sizes[by_size]
    have = np.zeros(len(begins), np.int64)
    for step in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -step, "left"))  # runs longer than step
        here = begins[:live] + step
        there = before[here]
        h = np.maximum(have[:live] - 1, 0)
        h[there < 0] = 0
        # Neither suffix goes on beyond the data's end.
        limit = np.minimum(depth, n - np.maximum(here, there))
        limit[there < 0] = 0
        h = np.minimum(h, limit)
        todo = np.flatnonzero(h < limit)
        while len(todo):
            differ = words[here[todo] + h[todo]] ^ words[there[todo] + h[todo]]
            same = np.where(differ == 0, 8, 0)
            some = np.flatnonzero(differ)
            if len(some):
                low = differ[some] & (~differ[some] + np.uint64(1))
                same[some] = (np.log2(low.astype(np.float64)) // 8).astype(np.int64)
            h[todo] = np.minimum(h[todo] + same, limit[todo])
            todo = todo[(differ == 0) & (h[todo] < limit[todo])]
        have[:live] = h
        shared[here] = h
    return shared[order]


class _Fingerprints:
    """128 bits of the ``LENGTH`` bytes at a place; the hashes of the data's grams are made once, if at all."""

    def __init__(self, data: np.ndarray):
        self.data, self.grams = data, None

    def __call__(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.grams is None:
            self.grams = [(np.uint64(s), gram_hashes(self.data, s)) for s in (1, 2)]
        out = []
        for seed, grams in self.grams:
            left = _join(grams[places], grams[places + GRAM], seed)
            out.append(_join(left, _join(grams[places + 2 * GRAM], grams[places + LENGTH - GRAM], seed), seed).view(np.int64))
        return out[0], out[1]


def _spans(flags: np.ndarray, at: int) -> list[tuple[int, int]]:
    """Bytes covered by the strings that start at the marked places."""
    if flags.all():
        return [(at, at + len(flags) - 1 + LENGTH)]
    if not flags.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(at + int(a), at + int(b) - 1 + LENGTH) for a, b in zip(edges[::2], edges[1::2])]


def shard_repeats(rows: list[tuple[int, int, bool, bytes, int, int, bytes]]) -> tuple[list[tuple], list[tuple]]:
    """Spans of repeated strings in a shard, and what other shards have to be asked.

    ``rows``: anchor, block, whether there are others, digest of the text, first start, count of
    starts, bytes. Returns rows (digest, start, end), and per run (fingerprints, fingerprints, known to be repeated, digest, starts).
    """
    entries: dict[tuple[int, bytes], list[int]] = {}
    for k, row in enumerate(rows):
        entries.setdefault((row[0], row[6]), []).append(k)
    # Anchors with equal strings in other shards, perhaps.
    wide = {row[0] for row in rows if row[2]}
    spans, asked = [], []
    sorted_in = [(anchor, data, own) for (anchor, data), own in entries.items()]
    if not sorted_in:
        return spans, asked
    sizes = np.array([len(x[1]) for x in sorted_in])
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join([x[1] for x in sorted_in]), np.uint8)
    order = suffix_array(data)
    shared = common_prefixes(data, order, begins, sizes)
    whole = np.zeros(len(data), np.int64)  # where a whole string starts in its run, how often the run occurs
    counts = sizes - LENGTH + 1
    whole[np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())] = np.repeat([len(x[2]) for x in sorted_in], counts)
    group = np.cumsum(shared < LENGTH) - 1
    size = np.bincount(group, whole[order], group[-1] + 1)
    together = np.empty(len(data), np.int64)
    together[order] = group
    repeated = size[together] > 1
    named: set[int] = set()
    prints = _Fingerprints(data)
    for (anchor, text, own), begin, count in zip(sorted_in, begins.tolist(), counts.tolist()):
        flags = repeated[begin : begin + count]
        for k in own:
            spans += [(rows[k][3], a, b) for a, b in _spans(flags, rows[k][4])]
        if anchor in wide:
            places, marks = np.arange(begin, begin + count), flags.tolist()
            if flags.any():  # a string that is known to be repeated asks nothing, but answers once
                fresh = [i for i, (f, g) in enumerate(zip(marks, together[places].tolist())) if not f or not (g in named or named.add(g))]
                places, marks = places[fresh], [marks[i] for i in fresh]
            if marks:
                asked.append((*prints(places), np.array(marks), rows[own[0]][3], places + (rows[own[0]][4] - begin)))
    return spans, asked


def _digest(payload: Column) -> Column:
    return F.substring(F.unhex(F.sha2(payload, 256)), 1, 16)


def _key_column(digest: str) -> Column:
    """The first eight bytes of a digest as a signed number, like ``_key``."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Texts of at least ``LENGTH`` bytes with their digests, without most copies within the task."""
    seen: set[bytes] = set()
    for batch in batches:
        for part in slices(batch):
            texts, digests = [], []
            for text in part.column("payload").to_pylist():
                if len(text) >= LENGTH and (digest := hashlib.sha256(text).digest()[:16]) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(digest)
                    texts.append(text)
                    digests.append(digest)
            if texts:
                yield texts, digests


def _batch(arrow: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _anchor_rows(payloads: DataFrame) -> DataFrame:
    """anchor, key of the text, and packed: first start, count, 16 more bits of the digest."""
    schema = "anchor long, key long, run long"
    arrow = to_arrow(payloads, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, digests in _first_seen(batches):
            number, anchor, start, count = anchors(texts)
            keys = np.array([_key(d) for d in digests], np.int64)
            tags = np.array([int.from_bytes(d[8:10], "big") for d in digests], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(keys[number]), pa.array(start << 24 | count << 16 | tags[number])], schema=arrow)

    return payloads.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def _recurring(rows: DataFrame, block_runs: int) -> DataFrame:
    """Runs whose anchor has two or more different ones, with a block and whether there are others.

    Anchors are counted with one row per anchor and task; an anchor that very many runs share is then
    one side of a join, which the engine can split, and is spread over blocks by a hash of the run.
    """
    mark = F.xxhash64("key", "run")
    counted = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high")
    # Stored, so that the join deals out both of its sides itself and a large anchor can be split.
    wide = stored(counted.select(F.col("anchor").alias("of"), F.ceil(F.col("n") / block_runs).cast("int").alias("blocks")), "recurring-anchors")
    return rows.join(wide, F.col("anchor") == F.col("of")).select("anchor", "key", "run", F.pmod(mark, F.col("blocks")).cast("int").alias("block"), (F.col("blocks") > 1).alias("wide"))


def _packed_texts(payloads: DataFrame) -> DataFrame:
    """key, digest and compressed text, without most copies."""
    schema = "key long, digest binary, packed binary"
    arrow = to_arrow(payloads, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for texts, digests in _first_seen(batches):
            yield _batch(arrow, [(_key(d), d, packer.compress(t)) for d, t in zip(digests, texts)])

    return payloads.mapInArrow(run, schema)


def _run_texts(recurring: DataFrame, packed: DataFrame) -> DataFrame:
    """The bytes of the recurring runs."""
    schema = "anchor long, block int, wide boolean, digest binary, start long, count int, data binary"
    arrow = to_arrow(packed, schema)
    # A set, since copies of a text in other tasks have given the same runs.
    wanted = recurring.groupBy("key").agg(F.collect_set(F.struct("anchor", "run", "block", "wide")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, last = zstandard.ZstdDecompressor(), None
        for batch in batches:
            for part in slices(batch):
                out, size = [], 0
                for digest, packed, runs in zip(part.column("digest").to_pylist(), part.column("packed").to_pylist(), part.column("runs")):
                    if digest == last:  # a copy from another task
                        continue
                    last, text, tag = digest, unpacker.decompress(packed), int.from_bytes(digest[8:10], "big")
                    rows = runs.values
                    for anchor, place, block, wide in zip(*(rows.field(n).to_pylist() for n in ("anchor", "run", "block", "wide"))):
                        if place & 0xFFFF == tag:
                            start, count = place >> 24, place >> 16 & 0xFF
                            out.append((anchor, block, wide, digest, start, count, text[start : start + count + LENGTH - 1]))
                            size += count + LENGTH
                    if size > 4 << 20:
                        yield _batch(arrow, out)
                        out, size = [], 0
                if out:
                    yield _batch(arrow, out)

    return packed.join(wanted, "key").select("digest", "packed", "runs").mapInArrow(run, schema)


def _shards(runs: DataFrame, shard_bytes: int) -> DataFrame:
    """Spans (digest, start, stop) and questions (one, two, then digest, start) of all shards."""
    schema = "one long, two long, digest binary, start long, stop long"
    arrow = to_arrow(runs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            spans, asked = shard_repeats(held)
            for lo in range(0, len(spans), 50_000):
                some = spans[lo : lo + 50_000]
                yield _batch(arrow, [(None, None, d, a, b) for d, a, b in some])
            for lo in range(0, len(asked), 500):
                one, two, known, digests, starts = zip(*asked[lo : lo + 500])
                which = np.repeat(np.arange(len(starts), dtype=np.int32), [len(x) for x in starts])
                names = pa.DictionaryArray.from_arrays(pa.array(which, mask=np.concatenate(known)), pa.array(digests, pa.binary())).cast(pa.binary())
                starts = pa.array(np.concatenate(starts))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), names, starts, pa.nulls(len(starts), pa.int64())], schema=arrow)

        for batch in batches:
            for part in slices(batch):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if last and row[:6] == last[:6]:  # the same run of a copy from another task
                        continue
                    if size >= shard_bytes and row[:2] != last[:2]:
                        yield from flush()
                        held, size = [], 0
                    held.append(row)
                    size += len(row[6])
                    last = row
        if held:
            yield from flush()

    return runs.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "digest", "start").mapInArrow(lambda batches: trimmed(run(batches)), schema)


def _merged(asked: DataFrame) -> DataFrame:
    """Spans of the strings that more than one shard has."""
    schema = "digest binary, start long, stop long"
    arrow = to_arrow(asked, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            one = held.column("one").to_numpy()
            cut = int(np.searchsorted(one, one[-1])) if len(one) else 0  # equal values may go on in the next batch
            if cut:
                yield answer(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield answer(held)

    def answer(rows: pa.Table) -> pa.RecordBatch:
        one, two = rows.column("one").to_numpy(), rows.column("two").to_numpy()
        pairs = np.rec.fromarrays([one, two], names="one,two")
        inner = np.searchsorted(one, one, "right") - np.searchsorted(one, one, "left") > 1
        found = np.zeros(len(one), bool)
        if inner.any():
            some = pairs[inner]
            found[inner] = np.searchsorted(some, some, "right") - np.searchsorted(some, some, "left") > 1
        kept = rows.filter(pa.array(found)).filter(pc.is_valid(rows.filter(pa.array(found)).column("digest")))
        start = kept.column("start").to_numpy()
        return pa.RecordBatch.from_arrays([kept.column("digest").combine_chunks() if len(kept) else pa.array([], pa.binary()), pa.array(start), pa.array(start + LENGTH)], schema=arrow)

    return asked.repartition("one").sortWithinPartitions("one", "two").mapInArrow(run, schema)


def repeated_spans(payloads: DataFrame, block_runs: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """For a table with one column, ``payload``: its packed texts, and per key the spans to remove.

    A key's spans come as structs (digest, start, stop), unordered, and may overlap.
    """
    packed = _packed_texts(payloads)
    found = _shards(_run_texts(_recurring(_anchor_rows(payloads), block_runs), packed), shard_bytes)
    # What the shards found is read twice, so it is stored: a few bytes per recurring run.
    found = stored(found, "spans")
    spans = found.filter("stop IS NOT NULL").select("digest", "start", "stop").unionByName(_merged(found.filter("stop IS NULL").select("one", "two", "digest", "start")))
    return packed, spans.groupBy(_key_column("digest").alias("key")).agg(F.collect_list(F.struct("digest", "start", "stop")).alias("spans"))


def kept_pieces(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What remains of a text, and the number of maximal runs removed."""
    kept, runs, at = [], 0, 0
    reach = -1
    for start, stop in sorted(spans):
        if start > reach:
            runs += 1
            kept.append(text[at:start])
        reach = max(reach, stop)
        at = reach
    kept.append(text[at:])
    return b"".join(kept), runs


def _own_spans(spans: pa.Scalar, digest: bytes) -> list[tuple[int, int]]:
    rows = spans.values
    return [(a, b) for d, a, b in zip(*(rows.field(n).to_pylist() for n in ("digest", "start", "stop"))) if d == digest]


def repeat_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.col(key).alias("doc_id"), utf8(text).alias("payload"))
    packed, spans = repeated_spans(rows.select("payload"), **sizes)
    schema = "digest binary, n_removed long, n_spans long, kept_sha256 string"
    arrow = to_arrow(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch):
                out = []
                for digest, packed, spans in zip(part.column("digest").to_pylist(), part.column("packed").to_pylist(), part.column("spans")):
                    if own := _own_spans(spans, digest):
                        data = unpacker.decompress(packed)
                        kept, runs = kept_pieces(data, own)
                        out.append((digest, len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
                if out:
                    yield _batch(arrow, out)

    cut = packed.join(spans, "key").select("digest", "packed", "spans").mapInArrow(run, schema).dropDuplicates(["digest"])
    base = rows.select("doc_id", _digest(F.col("payload")).alias("digest"), F.length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("sha"))
    classes = base.filter(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).join(cut, "digest", "left").filter("copies > 1 OR n_removed IS NOT NULL")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    return base.join(classes, "digest", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def cut_repeats(docs: DataFrame, text: str = "text", **sizes: int) -> DataFrame:
    """``docs`` with what remains of each text; code points that a cut splits go too."""
    payload, names = utf8(text), docs.columns
    digest_, long_, of_, copies_, key_, by_, spans_ = unused(docs, "digest", "long", "of", "copies", "key", "by", "spans")
    _, spans = repeated_spans(docs.select(payload.alias("payload")), **sizes)
    rows = docs.withColumns({digest_: _digest(payload), long_: F.length(payload) >= LENGTH})
    copies = rows.filter(long_).groupBy(F.col(digest_).alias(of_)).agg(F.count(F.lit(1)).alias(copies_)).filter(F.col(copies_) > 1)
    rows = rows.join(copies, F.col(digest_) == F.col(of_), "left").withColumn(key_, _key_column(digest_))
    joined = rows.join(spans.withColumnsRenamed({"key": by_, "spans": spans_}), F.col(key_) == F.col(by_), "left")
    joined = joined.select(*names, digest_, F.coalesce(copies_, F.lit(1)).alias(copies_), spans_)
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = []
                for value, digest, copies, spans in zip(part.column(text).to_pylist(), part.column(digest_).to_pylist(), part.column(copies_).to_pylist(), part.column(spans_)):
                    if copies > 1:
                        value = ""
                    elif spans.is_valid and (own := _own_spans(spans, digest)):
                        value = kept_pieces(value.encode(), own)[0].decode("utf-8", "ignore")
                    texts.append(value)
                columns = [part.column(c) for c in names]
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
