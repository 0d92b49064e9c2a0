"""Best-fit packing of tokenised documents into sequences that are limited in tokens, documents and attention cost.

A document is its token ids and an end id; one that is longer than a sequence is cut, and only its first piece
may be shorter than a sequence. A piece asks for (length, 1, length squared): tokens, one document, and the cost
of attention within it. Pieces are taken from long to short, as in best-fit decreasing, and go where the rule says:

- ``norm``: of the sequences with room in every capacity, the one whose weighted residuals, as shares of the
  capacities, have the least Euclidean norm once the piece is in. That sequence stays the best one for a further
  piece of the same length, so it takes as many as fit.
- ``dot``: the one whose weighted dot product of demand and residuals is largest, one piece at a time.

Ties fall to the fewest tokens left, then to the sequence opened first. Where none has room, new ones are opened.

What a piece asks for follows from its length alone, so the numbers of pieces of each length, at most as many
as a sequence has tokens, are all that the choice depends on. The driver gets these counts and no more, and works with
groups of sequences that have the same content: how many groups there are depends on the lengths, not on the
number of documents. The plan says which ranks of a length go where; ranks are dealt over partitions by the
counts of each partition. No text, and no piece, is shuffled by length.

A null text is an empty one: the end id alone. Null and repeated ids are kept as they are, a row of pieces for each
row. An empty table gives an empty one. Columns besides id and text play no part.
"""

from __future__ import annotations

import gc
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, to_arrow, trimmed

#: The end of a document.
END = 0
#: Words whose ids a worker keeps, some 200 bytes each.
WORDS = 1 << 20


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold, and the weights of the three residuals."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)

    def __post_init__(self) -> None:
        if min(self.tokens, self.documents) < 1 or self.attention < self.tokens**2:
            raise ValueError("a sequence must have room for a document, and for the attention of a whole piece")


def demand(length: int) -> tuple[int, int, int]:
    return length, 1, length * length


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: Capacity, rule: str = "norm") -> np.ndarray:
    """Rows (length, first rank, pieces, pieces a sequence, first sequence, offset), ordered by length and rank.

    Piece ``first rank + i`` of a length goes to sequence ``first sequence + i // pieces a sequence``, and there to
    ``offset + (i % pieces a sequence) * length``.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"no rule {rule}")
    most = np.array([capacity.tokens, capacity.documents, capacity.attention], np.int64)
    weights = np.array(capacity.weights)
    left, number, start = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows: list[tuple[int, ...]] = []
    opened = 0
    for length, n in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        need, rank = np.array(demand(length), np.int64), 0
        fits = np.flatnonzero((left >= need).all(1))
        while n:
            if len(fits) == 0:
                # New sequences, each as full as it gets; the last one may have fewer.
                each = int((most // need).min())
                left = np.concatenate([left, most[None]])
                number, start = np.append(number, -(-n // each)), np.append(start, opened)
                opened += int(number[-1])
                fits = np.array([len(left) - 1])
            rest = left[fits]
            if rule == "norm":
                score = (((rest - need) / most * weights) ** 2).sum(1)
                each = None
            else:
                score = -(weights * (need / most) * (rest / most)).sum(1)
                each = 1
            at = fits[np.lexsort((start[fits], rest[:, 0], score))[0]]
            each = each or int((left[at] // need).min())
            full = min(int(number[at]), n // each)
            used = capacity.tokens - int(left[at][0])
            more, extra = [], n - full * each if full < number[at] else 0
            if full:
                rows.append((length, rank, full * each, each, int(start[at]), used))
                more.append((left[at] - each * need, full, start[at]))
            if extra:  # fewer than one sequence takes
                rows.append((length, rank + full * each, extra, extra, int(start[at]) + full, used))
                more.append((left[at] - extra * need, 1, start[at] + full))
            over = int(number[at]) - full - bool(extra)
            if over:
                more.append((left[at], over, start[at] + full + bool(extra)))
            rank, n = rank + full * each + extra, n - full * each - extra
            keep = np.ones(len(left), bool)
            keep[at] = False
            more = [m for m in more if m[0].min() > 0]
            gone = np.cumsum(~keep)
            fits = fits[fits != at]
            fits = fits - gone[fits]
            base = int(keep.sum())
            left = np.concatenate([left[keep], np.array([m[0] for m in more], np.int64).reshape(-1, 3)])
            number, start = np.append(number[keep], [m[1] for m in more]).astype(np.int64), np.append(start[keep], [m[2] for m in more]).astype(np.int64)
            fits = np.append(fits, [base + k for k, m in enumerate(more) if (m[0] >= need).all()]).astype(np.int64)
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _bytes(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class _Ids:
    """Ids of texts as bytes, little-endian and unsigned with 32 bits, through a store of words that the worker keeps.

    The tokenizer's pattern always parts a text ahead of a space that something else than white space follows,
    so the stretches between these are encoded apart, each new one once. It parts letters from a mark behind them, and
    its special token parts texts, too.
    """

    #: By tokenizer file, kept as long as the worker.
    kept: dict[str, "_Ids"] = {}
    END_OF_TEXT = "<|endoftext|>"
    #: Letters below are letters in every edition of Unicode.
    LATIN = "\u0250"
    odd = re.compile(r" (?=\s|\Z)")
    part = re.compile(r"(?= \S)")

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.words: dict[str, bytes] = {}
        # A byte's character in the model's vocabulary: its own if it has a printed one, else one from 256 on.
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(printed))}
        self.marks = {m: _bytes(self.tokenizer.encode(m, add_special_tokens=False).ids) for m in ".,!?;:"}

    @classmethod
    def of(cls, path: str, model: bytes) -> "_Ids":
        if path not in cls.kept:
            cls.kept[path] = cls(model)
        return cls.kept[path]

    def parts(self, text: str) -> list[str]:
        """Stretches without their leading space; the first one has none, and gets one more to tell it apart."""
        if self.odd.search(text):
            first, *rest = self.part.split(text)
            return [" " + first, *(p[1:] for p in rest)]
        first, *rest = text.split(" ")
        return [" " + first, *rest]

    def learn(self, asked: set[str]) -> None:
        """Ids of new stretches. One that is a single word, or that and a mark, is given to the tokenizer's model at once; the others take all of its steps."""
        words, merge, rest = self.words, self.tokenizer.model.tokenize, []
        for key in asked:
            mark = self.marks.get(key[-1:])
            body = key if mark is None else key[:-1]
            if body.isalpha() and (body.isascii() or max(body) < self.LATIN):
                shown = body if body.isascii() else body.encode().decode("latin-1").translate(self.shown)
                words[key] = _bytes([t.id for t in merge(self.shown[32] + shown)]) + (mark or b"")
            else:
                rest.append(key)
        plain = [p[1:] if p[:1] == " " else " " + p for p in rest]
        for key, made in zip(rest, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)):
            words[key] = _bytes(made.ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > WORDS:
            self.words.clear()
        words, get = self.words, self.words.get
        whole, listed, asked = {}, [], set()
        for k, text in enumerate(texts):
            if self.END_OF_TEXT in text:  # rare: as a whole
                whole[k] = _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
                listed.append(([], []))
                continue
            parts = self.parts(text)
            ids = list(map(get, parts))
            missing = [(i, parts[i]) for i, v in enumerate(ids) if v is None] if None in ids else []
            asked.update([p for _, p in missing])
            listed.append((ids, missing))
        self.learn(asked)
        for ids, missing in listed:
            for i, part in missing:
                ids[i] = words[part]
        return [whole[k] if k in whole else b"".join(ids) for k, (ids, _) in enumerate(listed)]


_PIECES = "{id} {type}, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = END, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, piece, start, length and ids_crc32 of every piece, with part and place: its number among those of its length in a partition; stored.

    ``tokenizer`` is a file that the driver reads: a byte-level model without a normaliser that splits by its pattern.
    """
    with open(tokenizer, "rb") as file:
        model = file.read()
    schema = _PIECES.format(id=f"`{id}`", type=docs.schema[id].dataType.simpleString())
    arrow, last = to_arrow(docs, schema), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        ids = _Ids.of(tokenizer, model)
        gc.disable()  # nothing here points back to itself, and lists of words are costly to search for it
        for batch in batches:
            for some in slices(batch):
                names, made = some.column(0).to_pylist(), ids([t or "" for t in some.column(1).to_pylist()])
                rows = []
                for name, content in zip(names, made):
                    content += last
                    n = len(content) // 4
                    count = -(-n // size)
                    cuts = [0, *range(n - (count - 1) * size, n + 1, size)]
                    rows += [(name, k, lo, hi - lo, zlib.crc32(content[4 * lo : 4 * hi])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
                if rows:
                    name, piece, start, length, crc = zip(*rows)
                    place = _places(np.array(length), seen)
                    columns = [pa.array(name, arrow.field(0).type), *(pa.array(c, f.type) for c, f in zip((piece, start, length, crc, np.full(len(rows), part), place), list(arrow)[1:]))]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        gc.enable()

    return stored(docs.select(id, text).mapInArrow(lambda batches: trimmed(run(batches)), schema), "pieces")


def _places(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each among those of its length, going on from ``seen``, which is moved on."""
    order = np.argsort(length, kind="stable")
    sorted_ = length[order]
    first = np.searchsorted(sorted_, sorted_)
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(length)) - first + seen[sorted_]
    np.add.at(seen, length, 1)
    return out


def packed(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), rule: str = "norm", end: int = END, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    made = pieces(docs, tokenizer, capacity.tokens, end, id, text)
    return placed(made, capacity, rule).select(id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def placed(made: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm") -> DataFrame:
    """``made`` (of ``pieces``) with sequence_id and offset."""
    counts = stored(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).toPandas()  # at most as many rows as a sequence has tokens
    table = plan(total["length"].to_numpy(np.int64), total["n"].to_numpy(np.int64), capacity, rule)
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = made.join(first, ["part", "length"]).withColumn("_rank", F.col("place") + F.col("before"))
    names = [c for c in made.columns if c not in ("part", "place")]
    schema = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(_assign(table, to_arrow(made, schema)), schema)


def _assign(table: np.ndarray, arrow: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One key orders lengths and ranks: the place of a row's length in the table, then its rank.
        starts = np.rec.fromarrays([table[:, 0], table[:, 1]], names="length,rank")
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(starts, np.rec.fromarrays([length, rank], names="length,rank"), "right") - 1
            i = rank - table[at, 1]
            sequence, offset = table[at, 4] + i // table[at, 3], table[at, 5] + i % table[at, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in list(arrow)[:-2]), pa.array(sequence), pa.array(offset)], schema=arrow)

    return run
