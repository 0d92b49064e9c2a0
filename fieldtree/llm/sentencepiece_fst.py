"""SentencePiece encoding and decoding by weighted finite-state transducers (operator 9).

A model file is compiled into transducers: the normaliser (characters to characters; a function, so
composed with a text it gives a text again), the pieces (a trie whose paths read a piece's characters
and write its number), the fallback (an arc for each character without a piece, which writes byte
pieces), and, for byte-pair models, an acceptor of neighbouring pieces. Composing them with an input
gives a lattice of weighted arcs; its shortest path in the tropical semiring (weights add along a
path, the least path wins) is the encoding. Many inputs are composed and relaxed together in numpy,
one position of each in a step; long ones without white space alone, by the same rule.

Weights. In a unigram model an arc weighs the negative score of its piece, and states of the lattice
are positions. In a byte-pair model the encoding is what repeated merging leaves, and it is the only
path on which each two neighbours are what merging makes of the two alone. So an arc weighs 1, and
the acceptor gives other neighbours infinite weight; states are positions with their last piece.
That holds if scores fall from merge to merge within every piece; a byte-pair model in which they
don't is refused (``Transducer.verify``). Either way the result is that of the model's own library.

White space separates the lattice where no piece can cross it, so a word's shortest path is found
once and kept in a bounded cache. Whole texts are encoded: very long ones in cuts at white space of
about ``GROUP_CHARS`` characters, so beyond the text and its ids memory doesn't grow with them.

Nulls: a null text is empty and has no pieces; a null id stays null. Repeated rows give repeated
results, an empty table an empty one; other columns are ignored. The placeholder character U+2581 in
a text decodes to a space, as in the library; the column ``intact`` tells.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, to_arrow, trimmed

SPACE = "▁"
#: A character that isn't white space ahead of one that is: where a text may be cut.
_BREAK = re.compile(f"[^ {SPACE}][ {SPACE}]")
#: Added to piece numbers, of which those of characters without a piece are negative.
_OTHER = 0x110002
#: Encoded words, and accepted or refused neighbours, that a task keeps.
CACHE_WORDS, CACHE_NEIGHBOURS = 200_000, 400_000
#: Texts are encoded together by about so many characters.
GROUP_CHARS = 1 << 20
#: Inputs are composed together by so many characters; longer ones than ``STEPS`` are relaxed alone.
LATTICE_CHARS, STEPS = 1 << 17, 64
#: Ids are decoded by so many.
DECODE_IDS = 1 << 18
INFINITE = float("inf")
_POWERS = np.cumprod(np.full(256, 0xC2B2AE3D27D4EB4F, np.uint64))
# Fixed values of the model format: kinds of pieces, and kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of an encoded message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class _Table:
    """Whole numbers (not -1) to small ones, asked and filled by arrays: open addressing."""

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        out, todo, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slots(keys)
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            own = self.keys != -1
            keys, values = np.concatenate([self.keys[own], keys]), np.concatenate([self.values[own], values])
            self.__init__(max(self.bits + 1, int(np.ceil(np.log2(4 * len(keys) + 2)))))
            self.used = len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & (len(self.keys) - 1)


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after another."""
    return np.arange(sizes.sum()) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)


class Normaliser:
    """Character rewriting: the longest matching rule at each place, then white space by the flags."""

    def __init__(self, rules: bytes, dummy: bool, squeeze: bool, escape: bool):
        self.dummy, self.squeeze, self.escape = dummy, squeeze, escape
        self.rules = self._compile(rules) if rules else {}
        self.longest = max(map(len, self.rules), default=0)

    @staticmethod
    def _compile(blob: bytes) -> dict[bytes, bytes]:
        """The rules of a stored double-array trie, by walking all of its paths."""
        size = struct.unpack_from("<I", blob)[0]
        units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        out: dict[bytes, bytes] = {}
        stack = [(offset(units[0]), b"")]
        while stack:
            base, path = stack.pop()
            for c in range(1, 256):
                place = base ^ c
                if place >= len(units) or units[place] & (1 << 31 | 0xFF) != c:
                    continue
                unit, down = units[place], path + bytes([c])
                under = place ^ offset(unit)
                if unit >> 8 & 1:
                    at = units[under] & ((1 << 31) - 1)
                    out[down] = texts[at : texts.index(b"\0", at)]
                stack.append((under, down))
        return out

    def rewritten(self, text: str) -> str:
        """By the rules alone."""
        if self.rules:
            data, out, at = text.encode(), [], 0
            while at < len(data):
                for n in range(min(self.longest, len(data) - at), 0, -1):
                    if (to := self.rules.get(data[at : at + n])) is not None:
                        out.append(to)
                        at += n
                        break
                else:
                    n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                    out.append(data[at : at + n])
                    at += n
            text = b"".join(out).decode()
        return text

    def spaced(self, text: str, begins: bool = True, ends: bool = True) -> str:
        """White space by the flags, for a text or a cut of one: the states are the text's beginning, its
        inside and its end, and cuts are made ahead of white space, so that only the first and the last
        cut have an edge to trim."""
        if self.squeeze:
            text = re.sub(" +", " ", text)
            text = text.lstrip(" ") if begins else text
            text = text.rstrip(" ") if ends else text
        if self.dummy and begins and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def __call__(self, text: str) -> str:
        return self.spaced(self.rewritten(text))


class Transducer:
    """A model compiled for encoding and decoding."""

    def __init__(self, model: bytes, words: int | None = None, group: int | None = None):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.fallback, dummy, squeeze, escape, rules = UNIGRAM, False, True, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.kind, self.fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                rules, dummy, squeeze, escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        self.dummy = dummy
        self.normalise = Normaliser(rules, dummy, squeeze, escape)
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(self.pieces, self.kinds)) if t == BYTE}
        self.ids = {p: k for k, (p, t) in enumerate(zip(self.pieces, self.kinds)) if t in (NORMAL, USER)}
        self._compile_trie()
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # A character without a piece costs more than any piece (unigram), as in the library.
        self.unknown_cost = 10.0 - min((s for s, t in zip(self.scores, self.kinds) if t == NORMAL), default=0.0)
        self.split = not crossing
        self.plain: np.ndarray | None = None
        self.table: tuple | None = None
        #: The acceptor: pairs of pieces, as far as they have been asked for, and whether one may follow the other.
        self.follows = _Table(16)
        self.edges: tuple[dict[str, list], dict[str, list]] = {}, {}
        self.packing = "H" if len(self.pieces) <= 1 << 16 else "I"
        #: Encoded stretches, packed; the older half is dropped when the newer one is full.
        self.words, self.group = words, group
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _compile_trie(self) -> None:
        """The trie as arrays: a state per prefix (0: the root), arcs by state and character, and the piece that ends at a state (-1: none)."""
        alphabet = sorted({c for p in self.ids for c in p})
        number = {c: k + 1 for k, c in enumerate(alphabet)}
        self.classes = np.zeros((ord(alphabet[-1]) if alphabet else 0) + 2, np.int32)
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        states, final = {"": 0}, [-1]
        keys, targets = [], []
        for piece, k in self.ids.items():
            state = 0
            for n in range(1, len(piece) + 1):
                prefix = piece[:n]
                next_ = states.get(prefix)
                if next_ is None:
                    next_ = states[prefix] = len(final)
                    final.append(-1)
                    keys.append(state * self.width + number[piece[n - 1]])
                    targets.append(next_)
                state = next_
            final[state] = k
        self.final = np.array(final, np.int32)
        self.arcs = _Table(max(4, int(np.ceil(np.log2(2 * len(keys) + 2)))))
        self.arcs.put(np.array(keys, np.int64), np.array(targets, np.int32))
        self.costs = np.array([-s for s in self.scores] if self.kind != BPE else [1.0] * len(self.scores))

    def verify(self) -> Transducer:
        """Itself, unless merging the characters of some piece of a byte-pair model takes a better score after a worse one."""
        for piece in self.ids if self.kind == BPE else ():
            symbols, last = list(piece), INFINITE
            while (k := self._best(symbols)) >= 0:
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                if (now := self.scores[self.ids[symbols[k]]]) > last:
                    raise ValueError(f"merges of the piece {piece!r} don't fall in score")
                last = now
        return self

    def _unknown_ids(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.fallback else [self.unknown]

    def _best(self, symbols: list[str]) -> int:
        """The pair that is merged next: the best-scored one, the leftmost of equals; -1 if there is none."""
        best, at = None, -1
        for k in range(len(symbols) - 1):
            piece = self.ids.get(symbols[k] + symbols[k + 1])
            if piece is not None and (best is None or self.scores[piece] > best):
                best, at = self.scores[piece], k
        return at

    def _merged(self, symbols: list[str]) -> list[str]:
        """What merging makes of a few symbols."""
        while (k := self._best(symbols)) >= 0:
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def _label(self, k: int) -> str:
        """The characters of a piece; a character without one has the number -2 less its code."""
        return self.pieces[k] if k >= 0 else "" if k == -1 else chr(-2 - k)

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at a piece's left (0) or right (1) end while it is merged, each with the cost of
        the merge that consumes it; empty if merging the piece's characters doesn't give the piece."""
        known = self.edges[side].get(piece)
        if known is None:
            known, symbols, made = [(piece[-side], INFINITE)], list(piece), piece[-side]
            while len(symbols) > 1:
                k = self._best(symbols)
                if k < 0:
                    break
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                if symbols[-side] != made:
                    made = symbols[-side]
                    known[-1] = known[-1][0], -self.scores[self.ids[made]]
                    known.append((made, INFINITE))
            known = known if len(symbols) == 1 else []
            if len(self.edges[side]) > CACHE_NEIGHBOURS:  # characters without a piece are unlimited
                self.edges[side].clear()
            self.edges[side][piece] = known
        return known

    def _joins(self, one: str, two: str) -> bool:
        """Whether merging the characters of both leaves just the two.

        Scores fall from a piece's parts to the piece, so merges run by score within either side. A
        merge over the border happens if its score beats those of the merges that would consume its
        two parts (at the same score the one further left goes first). Runs of white space have one
        score in common and are merged out instead.
        """
        if not one or not two:
            return bool(self._edge(one or two, 0))
        if SPACE * 2 in one + two:
            return self._merged(list(one + two)) == [one, two]
        left, right = self._edge(one, 1), self._edge(two, 0)
        if not left or not right:
            return False
        ids, scores = self.ids, self.scores
        for x, x_cost in left:
            for y, y_cost in right:
                piece = ids.get(x + y)
                if piece is not None and (cost := -scores[piece]) < x_cost and cost <= y_cost:
                    return False
        return True

    def accepts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The acceptor: whether one piece may follow another (-1: the beginning)."""
        codes = (left.astype(np.int64) + _OTHER << np.int64(23)) | right.astype(np.int64) + _OTHER
        known = self.follows.get(codes)
        if len(new := np.flatnonzero(known < 0)):
            fresh, place = np.unique(codes[new], return_inverse=True)
            label = self._label
            made = np.array([self._joins(label(a), label(b)) for a, b in zip((fresh >> 23) - _OTHER, (fresh & ((1 << 23) - 1)) - _OTHER)], np.int32)
            known[new] = made[place]
            if self.follows.used > CACHE_NEIGHBOURS:
                self.follows = _Table(16)
            self.follows.put(fresh, made)
        return known > 0

    def lattice(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The composition of inputs with pieces and fallback: arcs (start, stop, piece, weight), by start, longer ones first.

        ``codes``: the inputs' characters one after another; ``ends``: for each the end of its input. All
        places walk down the trie in step. A character without a piece has the number -2 less its code.
        """
        own = self.classes[np.minimum(codes, len(self.classes) - 1)]
        places, states, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        starts, stops, pieces = [], [], []
        while len(places):
            on = np.flatnonzero(places + depth < ends[places])
            places, states = places[on], states[on]
            states = self.arcs.get(states * self.width + own[places + depth]).astype(np.int64)
            depth += 1
            on = states >= 0
            if depth == 1:
                bare = np.flatnonzero(~on | (self.final[np.maximum(states, 0)] < 0))
                starts, stops, pieces = [places[bare]], [places[bare] + 1], [-2 - codes[places[bare]].astype(np.int64)]
            places, states = places[on], states[on]
            read = self.final[states]
            some = np.flatnonzero(read >= 0)
            starts.append(places[some])
            stops.append(places[some] + depth)
            pieces.append(read[some].astype(np.int64))
        start, stop, piece = np.concatenate(starts), np.concatenate(stops), np.concatenate(pieces)
        order = np.argsort(start * np.int64(1 << 20) - stop + start, kind="stable")
        start, stop, piece = start[order], stop[order], piece[order]
        weight = np.where(piece >= 0, self.costs[np.maximum(piece, 0)] if len(self.costs) else 0.0, 1.0 if self.kind == BPE else self.unknown_cost)
        return start, stop, piece, weight

    def shortest(self, inputs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces on the shortest path of each input's lattice, one input after another, and their numbers.

        Relaxation goes by position: all arcs that end at a position are settled before those that start
        there are relaxed, for all inputs in step. A byte-pair model's state is an arc (position and last
        piece); a unigram model's state is a position, so only its best arc goes on.
        """
        sizes = np.array([len(t) for t in inputs], np.int64)
        codes = np.frombuffer("".join(inputs).encode("utf-32-le", "surrogatepass"), np.uint32)
        last = np.cumsum(sizes)
        begins = last - sizes
        start, stop, piece, weight = self.lattice(codes, np.repeat(last, sizes))
        out_first = np.searchsorted(start, np.arange(len(codes) + 1))
        by_stop = np.argsort(stop, kind="stable")
        in_first = np.searchsorted(stop[by_stop], np.arange(len(codes) + 2))
        best, back = np.full(len(start), INFINITE), np.full(len(start), -1, np.int64)
        falling = np.argsort(-sizes, kind="stable")
        rising = -sizes[falling]
        for step in range(int(sizes.max(initial=0))):
            here = begins[falling[: np.searchsorted(rising, -step)]] + step
            if step:
                count = in_first[here + 1] - in_first[here]
                before, at = by_stop[_ranges(in_first[here], count)], np.repeat(here, count)
                live = np.isfinite(best[before])
                before, at = before[live], at[live]
                if self.kind != BPE:
                    order = np.lexsort((start[before], best[before], at))
                    before, at = before[order], at[order]
                    first = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
                    before, at = before[first], at[first]
            else:
                before, at = np.full(len(here), -1), here
            count = out_first[at + 1] - out_first[at]
            after, before = _ranges(out_first[at], count), np.repeat(before, count)
            far = (best[before] if step else 0.0) + weight[after]
            if self.kind == BPE:
                allowed = self.accepts(piece[before] if step else before, piece[after])
                after, before, far = after[allowed], before[allowed], far[allowed]
            if (at[1:] == at[:-1]).any():  # several states at a position: the least comes last, and stays
                order = np.lexsort((-far, after))
                after, before, far = after[order], before[order], far[order]
            best[after], back[after] = far, before
        count = in_first[last + 1] - in_first[last]
        ending, own = by_stop[_ranges(in_first[last], count)], np.repeat(np.arange(len(inputs)), count)
        order = np.lexsort((start[ending], best[ending], own))
        ending, own = ending[order], own[order]
        first = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
        now = ending[first]
        if len(now) != len(inputs) or not np.isfinite(best[now]).all():
            raise ValueError("no path through the lattice")
        path, owner, live = [], [], np.arange(len(inputs))
        while len(now):
            path.append(piece[now])
            owner.append(live)
            now = back[now]
            live, now = live[now >= 0], now[now >= 0]
        path, owner = np.concatenate([np.zeros(0, np.int64), *path[::-1]]), np.concatenate([np.zeros(0, np.int64), *owner[::-1]])
        return path[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(inputs))

    def _shortest_alone(self, text: str) -> np.ndarray:
        """``shortest`` of one long input, position by position; what all open paths share is written out now and then."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, reach = len(codes), max(map(len, self.ids), default=1)
        open_: dict[int, list[tuple[float, int, int]]] = {0: [(0.0, -1, -1)]}  # weight, last piece, step into the trail
        trail: list[tuple[int, int]] = []
        accepted: dict[tuple[int, int], bool] = {}
        done: list[np.ndarray] = []

        def traced(step: int) -> list[int]:
            out = []
            while step >= 0:
                out.append(step)
                step = trail[step][1]
            return out[::-1]

        for lo in range(0, n, LATTICE_CHARS):
            some = codes[lo : lo + LATTICE_CHARS + reach]
            start, stop, piece, weight = self.lattice(some, np.full(len(some), len(some)))
            cut = int(np.searchsorted(start, min(LATTICE_CHARS, n - lo)))
            first = np.searchsorted(start[:cut], np.arange(min(LATTICE_CHARS, n - lo) + 1)).tolist()
            stop, piece, weight = (stop[:cut] + lo).tolist(), piece[:cut].tolist(), weight[:cut].tolist()
            if len(accepted) > CACHE_NEIGHBOURS:
                accepted.clear()
            for at in range(lo, min(lo + LATTICE_CHARS, n)):
                states = open_.pop(at, ())
                if self.kind != BPE and len(states) > 1:
                    states = (min(states),)
                for far, left, step in states:
                    for arc in range(first[at - lo], first[at - lo + 1]):
                        k = piece[arc]
                        if self.kind == BPE:
                            known = accepted.get((left, k))
                            if known is None:
                                known = accepted[left, k] = self._joins(self._label(left), self._label(k))
                            if not known:
                                continue
                        trail.append((k, step))
                        open_.setdefault(stop[arc], []).append((far + weight[arc], k, len(trail) - 1))
            ways = [[traced(s[2]) for s in states] for states in open_.values()]
            flat = [w for some in ways for w in some]
            if not flat:
                raise ValueError("no path through the lattice")
            same = next((i for i, x in enumerate(zip(*flat)) if len(set(x)) > 1), min(map(len, flat)))
            done.append(np.array([trail[s][0] for s in flat[0][:same]], np.int64))
            kept: list[tuple[int, int]] = []
            for states, some in zip(open_.values(), ways):
                for i, way in enumerate(some):
                    step = -1
                    for s in way[same:]:
                        kept.append((trail[s][0], step))
                        step = len(kept) - 1
                    states[i] = states[i][:2] + (step,)
            trail = kept
        if n not in open_:
            raise ValueError("no path through the lattice")
        done.append(np.array([trail[s][0] for s in traced(min(open_[n])[2])], np.int64))
        return np.concatenate(done)

    def _written(self, path: np.ndarray) -> bytes:
        """The packed ids of a path: byte pieces for characters without one, or the unknown piece, once for neighbours."""
        if (path < 0).any():
            out: list[int] = []
            for k in path.tolist():
                if k >= 0:
                    out.append(k)
                elif self.fallback or not out or out[-1] != self.unknown:
                    out += self._unknown_ids(chr(-2 - k))
            path = np.array(out, np.int64)
        return path.astype(self.packing).tobytes()

    def _solve(self, stretches: list[str]) -> list[bytes]:
        """The packed ids of some stretches; short ones are composed and relaxed together."""
        out: list[bytes] = [b""] * len(stretches)
        group, size = [], 0

        def flush() -> None:
            path, counts = self.shortest([stretches[k] for k in group])
            packed, width = np.maximum(path, 0).astype(self.packing).tobytes(), np.dtype(self.packing).itemsize
            stops = np.cumsum(counts)
            for k, a, b in zip(group, ((stops - counts) * width).tolist(), (stops * width).tolist()):
                out[k] = packed[a:b]
            bare = np.unique(np.searchsorted(stops, np.flatnonzero(path < 0), "right"))
            for i, a, b in zip(bare.tolist(), (stops - counts)[bare].tolist(), stops[bare].tolist()):
                out[group[i]] = self._written(path[a:b])

        for k, text in enumerate(stretches):
            if len(text) > STEPS:
                out[k] = self._written(self._shortest_alone(text))
                continue
            group.append(k)
            size += len(text)
            if size >= LATTICE_CHARS:
                flush()
                group, size = [], 0
        if group:
            flush()
        return out

    def _packed(self, stretches: list[str]) -> list[bytes]:
        """The packed ids of distinct stretches, by the cache where it has them."""
        found = list(map(self.cache.get, stretches))
        if None in found:
            missing = [k for k, x in enumerate(found) if x is None]
            older = [self.older.get(stretches[k]) for k in missing]
            unseen = [k for k, x in zip(missing, older) if x is None]
            for k, x in zip(missing, older):
                found[k] = x
            for k, x in zip(unseen, self._solve([stretches[k] for k in unseen])):
                found[k] = x
            for k in missing:
                if len(stretches[k]) < 256:
                    if len(self.cache) >= (self.words or CACHE_WORDS):
                        self.cache, self.older = {}, self.cache
                    self.cache[stretches[k]] = found[k]
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return self.encode_all([text])[0]

    def cuts(self, text: str) -> Iterator[str]:
        """A text normalised, in cuts of about ``GROUP_CHARS`` at the beginning of white space, where no piece crosses it."""
        text = self.normalise.rewritten(text)
        lo = 0
        while lo < len(text) or not lo:
            hi = min(lo + (self.group or GROUP_CHARS), len(text))
            if hi < len(text) and self.split:
                # Ahead of a run of white space (of a run that is cut, its beginning).
                found = _BREAK.search(text, hi)
                hi = found.start() + 1 if found else len(text)
            else:
                hi = len(text)
            yield self.normalise.spaced(text[lo:hi], lo == 0, hi == len(text))
            if hi == len(text):
                return
            lo = hi

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts one after another, and the number of ids of each.

        A stretch that occurs more than once is looked up once.
        """
        made, counts, group, owner, size = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            ids, own = self._encode_cuts(group)
            made.append(ids)
            np.add.at(counts, owner, own)

        for k, text in enumerate(texts):
            for cut in self.cuts(text):
                group.append(cut)
                owner.append(k)
                size += len(cut)
                if size >= (self.group or GROUP_CHARS):
                    flush()
                    group, owner, size = [], [], 0
        if group:
            flush()
        return np.concatenate([np.zeros(0, self.packing), *made]), counts

    def _encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.replace(SPACE, " ").encode() for t in cuts]
        sizes = np.array([len(r) for r in raw], np.int64)
        whole = b"".join(raw)
        if not whole:
            return np.zeros(0, self.packing), np.zeros(len(cuts), np.int64)
        data, ends = np.frombuffer(whole, np.uint8), np.cumsum(sizes)
        begins = (ends - sizes)[sizes > 0]
        if self.split:
            space = data == 32
            starts = space.copy()
            starts[1:] &= ~space[:-1]
            starts[begins] = True
            at = np.flatnonzero(starts)
        else:
            at = begins
        long = np.diff(np.concatenate([at, [len(data)]]))
        offset = np.arange(len(data)) - np.repeat(at, long)
        codes = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POWERS[offset & 255], at)
        _, first, which = np.unique(codes, return_index=True, return_inverse=True)
        alike = at[first][which]
        if (long[first][which] != long).any() or (data[np.repeat(alike, long) + offset] != data).any():  # two stretches, one code
            first = which = np.arange(len(at))
        stretches = [whole[a : a + n].decode().replace(" ", SPACE) for a, n in zip(at[first].tolist(), long[first].tolist())]
        packed = self._packed(stretches)
        ids = np.frombuffer(b"".join(packed), self.packing)
        counts = np.array([len(x) for x in packed], np.int64) // ids.itemsize
        flat, own = _gather(ids, np.cumsum(counts) - counts, counts, which)
        total = np.concatenate([[0], np.cumsum(own)])
        text_of = np.searchsorted(at, ends)  # stretches up to each text's end
        return flat, np.diff(np.concatenate([[0], total[text_of]]))

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of several runs of ids, the same as ``decode`` of each."""
        if self.table is None:
            made = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b"" for p, k in zip(self.pieces, self.kinds)]
            sizes = np.array([len(m) for m in made], np.int64)
            special = np.array([k not in (NORMAL, USER, BYTE) for k in self.kinds])
            self.table = np.frombuffer(b"".join(made), np.uint8), np.cumsum(sizes) - sizes, sizes, special
        data, begins, sizes, special = self.table
        stops = np.cumsum(counts)
        if special[ids].any():
            return [self.decode(ids[a:b]) for a, b in zip((stops - counts).tolist(), stops.tolist())]
        raw = b"".join([_gather(data, begins, sizes, ids[lo : lo + DECODE_IDS])[0].tobytes() for lo in range(0, len(ids), DECODE_IDS)])
        total = np.concatenate([[0], np.cumsum(sizes[ids])])
        out = []
        for a, b, k in zip(total[stops - counts].tolist(), total[stops].tolist(), counts.tolist()):
            if self.dummy and k and raw[a : a + 1] == b" ":
                a += 1
            out.append(raw[a:b].decode("utf-8", "replace"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        pieces, kinds = self.pieces, self.kinds
        numbers = ids.tolist()
        if self.plain is None:
            self.plain = np.array([k in (NORMAL, USER) for k in kinds])
        if self.plain[ids].all():
            text = "".join([pieces[k] for k in numbers])
        else:
            out, run = [], bytearray()
            for k in numbers:
                if kinds[k] == BYTE:
                    run.append(int(pieces[k][3:5], 16))
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                if kinds[k] == UNKNOWN:
                    out.append(" ⁇ ")
                elif kinds[k] != CONTROL:
                    out.append(pieces[k])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        if self.dummy and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


def _gather(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``data`` one after another, by number, and the size of each."""
    own = sizes[which]
    shift = begins[which] - (np.cumsum(own) - own)
    return data[np.repeat(shift, own) + np.arange(own.sum())], own


def read_model(path: str) -> bytes:
    with open(path, "rb") as source:
        return source.read()


def encoded(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", words: int | None = None, group: int | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256 and intact of every row; no shuffle.

    The model's file, of fixed size, goes out as a broadcast and is compiled once in a task. A task keeps about
    ``words`` encoded words and encodes texts together by ``group`` characters; both are a matter of memory alone.
    """
    Transducer(model).verify()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, intact boolean"
    arrow = to_arrow(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = None
        for batch in batches:
            fst = fst or Transducer(sent.value, words, group)
            for part in slices(batch):
                # A batch of very long rows is cut further.
                size = group or GROUP_CHARS
                step = max(1, part.num_rows * size // max(part.nbytes, size))
                for lo in range(0, part.num_rows, step):
                    some = part.slice(lo, step)
                    texts = some.column("text").to_pylist()
                    ids, counts = fst.encode_all(texts)
                    back = fst.decode_all(ids, counts)
                    sums = [hashlib.sha256(t.encode()).hexdigest() for t in back]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counts), lists.cast(arrow.field("ids").type), pa.array(sums), pa.array([b == t for b, t in zip(back, texts)])], schema=arrow)

    return rows.mapInArrow(lambda batches: trimmed(run(batches)), schema)
