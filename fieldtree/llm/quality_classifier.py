"""Quality classifier: supervised subword embeddings (operator 7).

Words, character n-grams of words and word pairs are hashed into buckets. Each bucket has a learned
vector; a document is the mean of its vectors, and a softmax layer gives the class probabilities.
Vectors and layer are trained by stochastic gradient descent in numpy, in one task of an executor,
on at most ``SAMPLE_DOCS`` labelled documents. Which ones is decided by a hash of their id, so it
does not depend on partitions. All documents are then scored by map-side work alone.

A mean followed by a linear layer is additive, so scoring folds both into one number per bucket, and a
long text is scored in pieces of about ``CHUNK_BYTES``, cut at white space, whose sums and counts add up
(a word longer than a piece is several words). Features of a batch of documents are made together in
numpy, from whole texts, over code points.

Nulls: a null or empty text has no features and gets the trained bias alone; a null id is scored
and counts as held out by no rule (``held_out`` is null); labels that are null are not learned from;
documents labelled twice count by their mean label, 0.5 up. Repeated rows give repeated results, an
empty table an empty one; other columns are ignored. Without any label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, to_arrow, trimmed, utf8

BUCKETS, DIM = 1 << 18, 8
#: Lengths of the character n-grams of a word, which is taken with a space at either end.
GRAMS = (3, 4)
EPOCHS, RATE = 3, 2.0
#: At most so many labelled documents are learned from.
SAMPLE_DOCS = 6_000
THRESHOLD = 0.3
CHUNK_BYTES = 1 << 17
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, 0xC2B2AE3D27D4EB4F, np.uint64))
_TO_SPACE = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def _bucket(keys: np.ndarray) -> np.ndarray:
    return ((keys * _SPREAD) >> np.uint64(40)) % np.uint64(BUCKETS)


def pieces(text: bytes) -> list[tuple[bytes, int]]:
    """A text in pieces, each with the word ahead of it, and that word's size in code points with its space."""
    if len(text) <= CHUNK_BYTES:
        return [(text, 0)]
    text, out, at, word = text.translate(_TO_SPACE), [], 0, b""
    while at < len(text):
        stop = min(len(text), at + CHUNK_BYTES)
        if stop < len(text):
            space = text.rfind(b" ", at, stop + 1)
            if space > at:
                stop = space
            else:
                stop -= next((k for k in range(3) if text[stop - k] & 0xC0 != 0x80), 0)  # not inside a code point
        part = text[at:stop]
        out.append((word + b" " + part, len(word.decode("utf-8", "replace")) + 1) if word else (part, 0))
        last = part.rsplit(None, 1)
        word = last[-1] if last else word
        at = stop
    return out


def features(texts: list[bytes], lead: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of some documents, and which document each is of.

    Features are words, character n-grams within words and pairs of neighbouring words. Of the first
    ``lead`` characters of a text only the pair with the word behind them counts.
    """
    read = [t.translate(_TO_SPACE).decode("utf-8", "replace") for t in texts]
    data = np.frombuffer(" ".join(["", *read, ""]).encode("utf-32-le"), np.uint32)
    # Document k owns the space ahead of its text and the text itself.
    first = np.cumsum([0, *(len(t) + 1 for t in read)])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    own = np.ones(len(data), bool)
    for k, n in enumerate(lead or ()):
        own[first[k] : first[k] + n] = False
    solid = data != 32
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    made, owners = [], []
    for n in GRAMS:
        whole = solid[1 : len(data) - n + 2] & own[: len(data) - n + 1]
        for k in range(2, n - 1):
            whole &= solid[k : len(data) - n + 1 + k]
        at = np.flatnonzero(whole[: max(0, len(data) - n + 1)])
        keys = np.full(len(at), n, np.uint64)
        for k in range(n):
            keys = (keys << np.uint64(16)) * np.uint64(0x9E3779B1) ^ data[at + k]
        made.append(_bucket(keys))
        owners.append(owner[at])
    if len(starts):
        ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        sizes = ends - starts
        inside = np.flatnonzero(solid)
        offsets = np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        codes = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[offsets & 255], np.cumsum(sizes) - sizes)
        words, counted = owner[starts], own[starts]
        made.append(_bucket(codes[counted]))
        owners.append(words[counted])
        near = np.flatnonzero((words[1:] == words[:-1]) & counted[1:])
        made.append(_bucket(codes[near] * np.uint64(31) + codes[near + 1]))
        owners.append(words[near])
    return np.concatenate(made).astype(np.uint32), np.concatenate(owners)


class Model:
    """A weight per bucket and a bias: the difference of the two classes' activations."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Of each text; pieces are taken together by about ``CHUNK_BYTES``, so that the arrays stay small."""
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        group: list[tuple[int, bytes, int]] = []
        size = 0

        def flush() -> None:
            found, owners = features([g[1] for g in group], [g[2] for g in group])
            place = np.array([g[0] for g in group])
            np.add.at(sums, place, np.bincount(owners, self.weights[found], len(group)))
            np.add.at(counts, place, np.bincount(owners, minlength=len(group)))

        for k, text in enumerate(texts):
            for piece, lead in pieces(text):
                group.append((k, piece, lead))
                size += len(piece)
                if size >= CHUNK_BYTES:
                    flush()
                    group, size = [], 0
        if group:
            flush()
        return 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + self.bias, -500, 500)))


def step(shares: np.ndarray, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one document the mean of its features' vectors, how far the softmax is off the label, and that carried back to the mean."""
    mean = shares @ vectors
    z = mean @ layer + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    off = -p
    off[label] += 1
    return mean, off, layer @ off


def network(texts: list[bytes], labels: list[int], seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, layer and bias by gradient descent, one document a step."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    made = []
    for text in texts:
        found, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *(features([piece], [lead])[0] for piece, lead in pieces(text))]), return_counts=True)
        made.append((found, (counts / max(1, counts.sum())).astype(np.float32)))
    share = np.clip(np.mean(labels), 1e-3, 1 - 1e-3)
    bias[:] = np.log([1 - share, share])
    steps, done = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for k in draw.permutation(len(texts)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            places, shares = made[k]
            mean, off, back = step(shares, vectors[places], layer, bias, labels[k])
            layer += rate * np.outer(mean, off)
            bias += rate * np.float32(0.02) * off
            vectors[places] += rate * shares[:, None] * back
    return vectors, layer, bias


def folded(vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, float]:
    """A number per bucket, and the bias: the difference of the two classes' activations."""
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(texts: list[bytes], labels: list[int], seed: int = 1) -> Model:
    return Model(*folded(*network(texts, labels, seed))) if texts else Model(np.zeros(BUCKETS, np.float32), 0.0)


def held_out(key: str | Column) -> Column:
    """Whether the row is never learned from: crc32 of the id as text leaves 0 by 5."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_DOCS) -> Model:
    """Learn from at most ``sample`` labelled rows that aren't held out, in one task."""
    known = labels.filter(F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("id")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # The join's result is bounded by the sample unless ids repeat, so the same order and limit hold again behind it.
    rows = docs.select(F.col(key).alias("id"), utf8(text).alias("payload")).join(F.broadcast(drawn), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("payload")).limit(sample).select("payload", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column("payload").to_pylist()
            marks += batch.column("label").to_pylist()
        model = train(texts, marks)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    made = rows.coalesce(1).mapInArrow(run, "weights binary, bias double").collect()
    if not made:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(made[0].weights, np.float32), made[0].bias)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", mark: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a score and, as ``mark``, whether it reaches the threshold; no shuffle.

    Columns that ``docs`` already has under these two names are replaced.

    The model goes out as a broadcast of ``BUCKETS`` floats, whatever the input.
    """
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kept = [f for f in docs.schema.fields if f.name not in (out, mark)]
    schema = StructType([*kept, StructField(out, DoubleType()), StructField(mark, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            for part in slices(batch):
                scores = model.score([(t or "").encode() for t in part.column(text).to_pylist()])
                marks = (scores >= threshold).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(scores), pa.array(marks)], names=[f.name for f in schema.fields])

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
