import hashlib
import os
import random
import struct

import pytest

from fieldtree.llm import sentencepiece_fst as P

sentencepiece = pytest.importorskip("sentencepiece")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="the public model is absent")


@pytest.fixture(scope="module")
def bpe():
    return P.Transducer(P.read_model(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(n, seed):
    draw = random.Random(seed)
    pieces = ["a", "b", "the", " ", "  ", "\n", "é", "漢", "▁", "‍", "𝔘", "ing", "<s>", "<0x0A>", "1", "23", ".", "\t", "_", "X", "   ", "=", "Hello", "\x00"]
    return ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 20))) for _ in range(n)]


def test_same_as_the_library(bpe):
    own, library = bpe
    for t in texts(3000, 1):
        ids = own.encode(t)
        assert ids.tolist() == library.encode(t), t
        assert own.decode(ids) == library.decode(ids.tolist())


def test_a_path_through_the_lattice_is_the_encoding(bpe):
    """The arcs of a word's lattice, their weights, and what the acceptor leaves of them."""
    own, library = bpe
    text = own.normalise("unrelated")
    codes = P.np.frombuffer(text.encode("utf-32-le"), P.np.uint32)
    start, stop, piece, weight = own.lattice(codes, P.np.full(len(codes), len(codes)))
    spans = {(a, b) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if text[a:b] in own.ids}
    assert set(zip(start.tolist(), stop.tolist())) == spans and len(start) == len(spans) > len(text)
    assert (weight == 1).all() and all(own.pieces[k] == text[a:b] for a, b, k in zip(start, stop, piece))

    def paths(at, left):
        if at == len(text):
            return [[]]
        return [[k, *rest] for a, b, k in zip(start.tolist(), stop.tolist(), piece.tolist()) if a == at and own.accepts(P.np.array([left]), P.np.array([k]))[0] for rest in paths(b, k)]

    assert paths(0, -1) == [library.encode("unrelated")] == [own.shortest([text])[0].tolist()]


def test_long_inputs(bpe, monkeypatch):
    """Cut at white space, or relaxed alone with the shared part written out: the same ids."""
    own, library = bpe
    monkeypatch.setattr(P, "GROUP_CHARS", 50)
    monkeypatch.setattr(P, "LATTICE_CHARS", 40)
    monkeypatch.setattr(P, "DECODE_IDS", 7)
    draw = random.Random(3)
    for t in [*texts(200, 4), " ".join(texts(60, 5)), "".join(draw.choice("abcdefgh漢é") for _ in range(3000)), " " * 300, "z" * 500, "  a  ".join(texts(30, 6))]:
        own.cache, own.older = {}, {}
        ids = own.encode(t)
        assert ids.tolist() == library.encode(t), t
        assert own.decode_all(ids, P.np.array([len(ids)])) == [library.decode(ids.tolist())]


def test_memory_of_a_long_text(bpe):
    import tracemalloc

    own = bpe[0]
    text = " ".join(texts(400_000, 7))
    tracemalloc.start()
    ids, counts = own.encode_all([text])
    own.decode_all(ids, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 + 16 * len(text.encode())


def test_merges_out_of_order_are_refused():
    model = message(1, 2, message(1, 2, b"<unk>") + message(3, 0, b"\x02"))
    for p, s in {"a": -9.0, "b": -9.0, "c": -9.0, "ab": -5.0, "abc": -1.0}.items():
        model += message(1, 2, message(1, 2, p.encode()) + message(2, 5, struct.pack("<f", s)))
    model += message(2, 2, message(3, 0, b"\x02"))
    with pytest.raises(ValueError, match="fall in score"):
        P.Transducer(model).verify()


def message(number, kind, value):
    return bytes([number << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)


def test_unigram_is_the_least_path():
    """A small unigram model: the shortest path is the best of all segmentations."""
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.9, "▁a": -4.2, "aba": -7.0, "▁ab": -6.5}
    model = message(1, 2, message(1, 2, b"<unk>") + message(3, 0, b"\x02"))
    for p, s in scores.items():
        model += message(1, 2, message(1, 2, p.encode()) + message(2, 5, struct.pack("<f", s)))
    model += message(2, 2, message(3, 0, b"\x01"))
    own = P.Transducer(model)

    def best(t):
        if not t:
            return 0.0
        return max((s + best(t[len(p) :]) for p, s in scores.items() if t.startswith(p)), default=-1e9)

    for t in ("ab", "aba", "b a ab", "abab aba"):
        total = sum(own.scores[k] for k in own.encode(t))
        assert abs(total - best(own.normalise(t))) < 1e-5
    assert own.encode("a??b").tolist().count(own.unknown) == 1


def test_table(spark, documents, odd_texts, bpe):
    own, library = bpe
    rows = P.encoded(documents.withColumnRenamed("n_chars", "ids"), P.read_model(MODEL)).collect()
    assert len(rows) == documents.count()
    for r in rows:
        text = odd_texts[4 if r.doc_id is None else r.doc_id] or ""
        assert r.ids == library.encode(text) and r.n_pieces == len(r.ids)
        back = library.decode(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest() and r.intact == (back == text)
    assert P.encoded(documents.limit(0), P.read_model(MODEL)).count() == 0
