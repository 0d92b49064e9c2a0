import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldtree.llm.vector_packing import Capacity, _Ids, demand, packed, placed, plan

MODEL = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "word", "é", "漢", ".", "'s", "1", "²", "\0", "\x1c", " ", " ", "<|endoftext|>", "<|endof"]), max_size=12).map("".join))
def test_ids_equal_the_library(text):
    with open(MODEL, "rb") as file:
        ids = _Ids.of(MODEL, file.read())
    for _ in range(2):  # new words, then known ones
        assert np.frombuffer(ids([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def fill(table):
    """Sequence to its pieces (offset, length) by a plan."""
    out = {}
    for length, _, n, each, first, used in table.tolist():
        for i in range(n):
            out.setdefault(first + i // each, []).append((used + i % each * length, length))
    return out


def holds(sequences, capacity):
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert all(sum(d) <= c for d, c in zip(zip(*(demand(n) for _, n in pieces)), (capacity.tokens, capacity.documents, capacity.attention)))


def one_by_one(lengths, capacity, rule):
    """The rule by its words: pieces from long to short, each to the best sequence of all that are open."""
    most, bins = (capacity.tokens, capacity.documents, capacity.attention), []
    for n in sorted(lengths, reverse=True):
        need, scored = demand(n), []
        for k, left in enumerate(bins):
            if all(a >= b for a, b in zip(left, need)):
                if rule == "norm":
                    score = sum(((a - b) / c * w) ** 2 for a, b, c, w in zip(left, need, most, capacity.weights))
                else:
                    score = -sum(w * (b / c) * (a / c) for a, b, c, w in zip(left, need, most, capacity.weights))
                scored.append((score, left[0], k))
        if scored:
            k = min(scored)[2]
        else:
            k = len(bins)
            bins.append(most)
        bins[k] = tuple(a - b for a, b in zip(bins[k], need))
    return sorted(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_against_one_by_one(rule):
    draw = np.random.default_rng(5)
    for _ in range(120):
        x = draw.integers(1, 33, draw.integers(1, 150))
        capacity = Capacity(32, int(draw.integers(1, 33)), 1024 + int(draw.integers(0, 60)))
        lengths, counts = np.unique(x, return_counts=True)
        got = fill(plan(lengths, counts, capacity, rule))
        holds(got, capacity)
        assert sorted(got) == list(range(len(got))) and sorted(n for p in got.values() for _, n in p) == sorted(x.tolist())
        assert len(got) == len(one_by_one(x.tolist(), capacity, rule))


def test_plan_reaches_the_bound():
    """Of many pieces of mixed lengths hardly any sequence has room left, and counts of any size cost the same."""
    draw = np.random.default_rng(2)
    x = np.minimum(np.maximum(1, draw.lognormal(6, 1.3, 40_000).astype(int)), 2048)
    lengths, counts = np.unique(x, return_counts=True)
    for times in (1, 10**6):
        table = plan(lengths, counts * times, Capacity())
        used = max(first + -(-n // each) for _, _, n, each, first, _ in table.tolist())
        assert used <= 1.001 * -(-int((lengths * counts).sum()) * times // 2048) + 1


def test_capacities_bind():
    with pytest.raises(ValueError):
        Capacity(16, 4, 100)
    with pytest.raises(ValueError):
        plan(np.array([1]), np.array([1]), Capacity(), "least")
    few = fill(plan(np.array([1, 8]), np.array([40, 4]), Capacity(16, 3, 256)))
    assert max(map(len, few.values())) == 3
    costly = fill(plan(np.array([9]), np.array([10]), Capacity(32, 32, 1024)))
    assert all(len(p) == 3 for p in list(costly.values())[:3])
    assert len(fill(plan(np.array([], int), np.array([], int), Capacity()))) == 0


def test_packed(spark, odd_texts):
    rows = [(i, t, "x") for i, t in enumerate(odd_texts)] + [(3, odd_texts[4], "x"), (None, "one two", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    capacity = Capacity(256, 256, 256 * 256)
    got = packed(docs.repartition(3), MODEL, capacity).collect()
    expected = []
    for i, t, _ in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        while len(ids) > 256:
            ids, tail = ids[:-256], ids[-256:]
            expected.append((i, tail))
        expected.append((i, ids))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(((r.doc_id, r.length, r.ids_crc32) for r in got), key=str) == sorted(((i, len(p), crc(p)) for i, p in expected), key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    holds(sequences, capacity)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for i, t, _ in rows:
        if [x[0] for x in rows].count(i) == 1:
            pieces = sorted(by[i])
            assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(n == 256 for _, _, n in pieces[1:])
            assert [s for _, s, _ in pieces] == [sum(n for _, _, n in pieces[:k]) for k in range(len(pieces))]
    assert packed(docs.limit(0), MODEL).count() == 0


def test_ranks_over_partitions(spark):
    """Every piece gets a place of its own, whatever partition it is in."""
    draw = random.Random(1)
    rows = [(i, draw.choice([3, 3, 3, 7, 16])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, length long").repartition(7)
    from fieldtree.llm.vector_packing import _places
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        seen = np.zeros(17, np.int64)
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(_places(b.column(1).to_numpy(), seen))], names=["doc_id", "length", "part", "place"])

    from fieldtree.storage import stored

    made = stored(df.mapInArrow(run, "doc_id long, length long, part int, place long"), "ranks")
    capacity = Capacity(16, 16, 256)
    sequences = {}
    for r in placed(made, capacity).collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    holds(sequences, capacity)
    assert sum(map(len, sequences.values())) == 500
