"""An adaptive context-mixing range coder for token ids.

A block is a run of ids cut into ``lanes`` of ``STEPS`` ids. All lanes share one adaptive model and are coded
side by side, one id of each per step, each lane by its own range coder. The model predicts an id from the
two before it (order 2), from the one before it (order 1) and from its frequency (order 0). The probability
that the order-2 guess holds, and then that the order-1 guess holds, is a mix, in the logistic domain, of what
the three orders say; an id that neither guesses is coded by its order-0 frequency. What the orders say depends
on a few bits of a lane (how sure both guesses are, whether they agree, how frequent the guessed id is), so the
mix is worked out once for each value of these bits and looked up by the lanes. Guesses are learned at every
step; frequencies, hit rates and weights are counted at every step and used from the next update on. All
arithmetic is on integers, so a block decodes alike on any machine.

A block starts with a fresh model and carries its sizes and a checksum, so blocks are read independently.

Layout, little-endian: magic ``TKCM``, u32 version, u32 alphabet, u64 ids, u32 lanes, u32 crc32 of the ids
as u32, then u32 words per lane, then the lanes' u32 words one lane after the other.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"TKCM", 2
HEADER = struct.Struct("<4sIIQII")
STEPS = 256
#: Steps between two updates of frequencies, hit rates and weights; the first of them update each time.
UPDATE = 8
#: Bits of the order-2 and order-1 tables.
BITS2, BITS1 = 20, 16
#: Confidence of a guess: how often in a row it held, at most.
SURE_BITS = 3
SURE = (1 << SURE_BITS) - 1
#: Bits of a guessed id's frequency, as its rounded logarithm.
LEVEL_BITS = 4
#: Bits of a context: confidence and level of a guess, confidence of the other one, whether both agree.
OWN_BITS = SURE_BITS + LEVEL_BITS
AGREE = 1 << (OWN_BITS + SURE_BITS)
CONTEXTS = 2 * AGREE
#: Probabilities have 16 bits, order-0 frequencies this many; an id that no guess tells keeps ``REST`` at least.
P_BITS, TOTAL_BITS = 16, 20
REST = 64
#: Slots of order-0 frequencies that share an entry when an id is looked up.
NEAR_BITS = 4

_U = np.uint64
_FULL = _U(1 << 32)
_HASH1, _HASH2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """``stretch`` of a 12-bit probability, in 1/256, and ``squash`` of -2047..2047 back to 16 bits."""
    x = np.arange(-2047, 2048)
    squash = np.clip(np.rint(65536 / (1 + np.exp(-x / 256.0))), REST, 65536 - REST).astype(np.int64)
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.clip(np.rint(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int64)
    return stretch, squash


_STRETCH, _SQUASH = _tables()
#: Of a context: what order 2 and order 1 know of it, and what order 0 does.
_AT = np.arange(CONTEXTS)
_OWN, _LEVEL = _AT & SURE, (_AT >> SURE_BITS) & ((1 << LEVEL_BITS) - 1)
_OTHER, _SAME = (_AT >> OWN_BITS) & SURE, _AT // AGREE
#: Of both guesses, the index of an order-2 hit rate (by both confidences) and of an order-1 one.
_BY2 = np.stack([(_OWN * 8 + _OTHER) * 2 + _SAME, 128 + (_OTHER * 8 + _OWN) * 2 + _SAME])
_BY1 = np.stack([_OTHER * 2 + _SAME, 16 + _OWN * 2 + _SAME])
#: Levels are logarithms of frequencies from 2**5 on.
_LEAST_LEVEL = TOTAL_BITS - (1 << LEVEL_BITS) + 1
_BY0 = _STRETCH[np.minimum(3 << np.maximum(_LEVEL + _LEAST_LEVEL - 2 - (TOTAL_BITS - 12), 0) >> 1, 4095)]
#: By confidence, and by whether the guess held: what to add to an entry whose guess stays.
_CHANGE = np.array([0, 0, *((s >> 1) - s for s in range(2, SURE + 1)), *[1] * SURE, 0]).astype(np.uint32)


class _Model:
    """What is learned from the ids so far. The same calls, in the same order, code and decode.

    An entry of the order-2 and order-1 tables has the guessed id, its level when it was entered, and how sure it is.
    """

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        self.counts = np.ones(alphabet, np.int64)
        self.ends = np.zeros(alphabet + 1, _U)
        self.table2, self.table1 = np.zeros(1 << BITS2, np.uint32), np.zeros(1 << BITS1, np.uint32)
        self.rate2 = np.full(256, 1 << 15, np.int64)
        self.rate1 = np.full(32, 1 << 15, np.int64)
        self.weights = np.full((2, 3), 22000, np.int64)  # 1/65536
        self.one, self.two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.seen = np.zeros((2, 4, CONTEXTS), np.int64)
        self.step = 0
        self.late: list[np.ndarray] = []
        self.bare = np.arange(alphabet, dtype=np.uint32) << np.uint32(OWN_BITS)
        self.recount()
        self.mix()

    def recount(self) -> None:
        """Frequencies that add up to 2**TOTAL_BITS, none of them zero."""
        if self.late:
            self.counts += np.bincount(np.concatenate(self.late), minlength=self.alphabet) * 32
            self.late.clear()
        spare = (1 << TOTAL_BITS) - self.alphabet
        freq = self.counts * spare // int(self.counts.sum()) + 1
        freq[0] += (1 << TOTAL_BITS) - int(freq.sum())
        self.freq = freq.astype(_U)
        np.cumsum(self.freq, out=self.ends[1:])
        # the exponents of floats are the logarithms
        level = np.clip((freq.astype(np.float32).view(np.uint32) >> 23).astype(np.int32) - (126 + _LEAST_LEVEL), 0, (1 << LEVEL_BITS) - 1)
        self.entries = self.bare | level.astype(np.uint32) << np.uint32(SURE_BITS)
        self.near: np.ndarray | None = None

    def mix(self) -> None:
        """The probabilities of all contexts, from the hit rates and weights."""
        self.inputs = np.stack([_STRETCH[self.rate2[_BY2] >> 4], _STRETCH[self.rate1[_BY1] >> 4], np.stack([_BY0, _BY0])], 1)
        bins = np.clip(np.einsum("dk,dkc->dc", self.weights, self.inputs) >> 16, -2047, 2047)
        self.chances = _SQUASH[bins + 2047].astype(_U)
        self.chances[1, AGREE:] = 0  # the order-2 guess again

    def learn(self) -> None:
        """Hit rates and weights from what was seen since the last update."""
        seen = self.seen
        hits = np.stack([seen[0, 1], seen[1, 1]])
        n = np.stack([seen[0, 0], seen[1, 0]]) + hits
        n[1, AGREE:] = 0
        slope = (hits << P_BITS) - n * self.chances.astype(np.int64)
        for d in range(2):
            total = int(n[d].sum())
            if total:
                self.weights[d] += (self.inputs[d] @ slope[d]) // total >> 10
        np.clip(self.weights, -131072, 131072, out=self.weights)
        for rate, by in ((self.rate2, _BY2), (self.rate1, _BY1)):
            m = np.bincount(by.ravel(), n.ravel(), len(rate)).astype(np.int64)
            k = np.bincount(by.ravel(), hits.ravel(), len(rate)).astype(np.int64)
            some = m > 0
            m, k = m[some], k[some]
            # towards the hit rate of these steps, faster the more was seen
            pull = np.minimum(m, 1024)
            rate[some] += (((k << P_BITS) - k * 2 + m) // m - rate[some]) * pull // (pull + 32)
            np.clip(rate, 32, 65503, out=rate)
        seen[:] = 0

    def look(self) -> tuple[np.ndarray, ...]:
        """Of each lane both guesses, and the bounds of their intervals of 2**P_BITS."""
        own = np.uint32((1 << OWN_BITS) - 1)
        at = self.one * _HASH1
        self.at1 = (at >> np.uint32(32 - BITS1)).astype(np.intp)
        at += self.two * _HASH2
        self.at2 = (at >> np.uint32(32 - BITS2)).astype(np.intp)
        self.e2, self.e1 = e2, e1 = self.table2.take(self.at2, mode="clip"), self.table1.take(self.at1, mode="clip")
        self.g2, self.g1 = g2, g1 = e2 >> np.uint32(OWN_BITS), e1 >> np.uint32(OWN_BITS)
        self.s2, self.s1 = s2, s1 = e2 & np.uint32(SURE), e1 & np.uint32(SURE)
        same = (g1 == g2) * np.uint32(AGREE)
        self.in2 = ((e2 & own) + (s1 << np.uint32(OWN_BITS)) + same).astype(np.intp)
        self.in1 = ((e1 & own) + (s2 << np.uint32(OWN_BITS)) + same).astype(np.intp)
        p = self.chances[0].take(self.in2, mode="clip")
        more = _U(65536 - REST) - p
        more *= self.chances[1].take(self.in1, mode="clip")
        more >>= _U(P_BITS)
        return g2, g1, p, p + more

    def take(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Learn the ids of this step, in lane order; ``hit2`` and ``hit1`` tell which guess coded them."""
        fresh = self.entries.take(ids, mode="clip")
        for table, at, e, s, hit in ((self.table2, self.at2, self.e2, self.s2, hit2), (self.table1, self.at1, self.e1, self.s1, ids == self.g1)):
            # a guess that fails loses trust first and is replaced once it has little
            s += hit * np.uint32(SURE + 1)
            table[at] = np.where(s > 1, e + _CHANGE.take(s, mode="clip"), fresh)
        self.seen[0, :2] += np.bincount(self.in2 + hit2 * CONTEXTS, minlength=2 * CONTEXTS).reshape(2, -1)
        self.seen[1] += np.bincount(self.in1 + (hit2 * np.uint16(2 * CONTEXTS) + hit1 * np.uint16(CONTEXTS)), minlength=4 * CONTEXTS).reshape(4, -1)
        self.two, self.one = self.one, ids
        self.late.append(ids)
        self.step += 1
        if self.step <= UPDATE or self.step % UPDATE == 0:
            self.recount()
            self.learn()
            self.mix()

    def find(self, slots: np.ndarray) -> np.ndarray:
        """The ids that have these slots of the order-0 frequencies."""
        if self.near is None:
            first = (self.ends.astype(np.int64) + (1 << NEAR_BITS) - 1) >> NEAR_BITS
            self.near = np.repeat(np.arange(self.alphabet), np.diff(first))
        found = self.near.take((slots >> _U(NEAR_BITS)).astype(np.intp))
        todo = np.flatnonzero(self.ends.take(found + 1, mode="clip") <= slots)
        while len(todo):
            found[todo] += 1
            todo = todo[self.ends.take(found[todo] + 1, mode="clip") <= slots[todo]]
        return found


class _Writer:
    """One range coder per lane, giving 32-bit words; a carry goes into the words that a lane has."""

    def __init__(self, lanes: int, steps: int):
        # no id takes more than a word, and each lane ends with two
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
        self.words = np.zeros((lanes, steps + 2), np.uint32)
        self.flat = self.words.ravel()
        self.first = np.arange(lanes) * (steps + 2)
        self.at = self.first.copy()

    def step(self, model: _Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        live = len(ids)
        g2, g1, p, q = model.look()
        unit = self.range[:live] >> _U(P_BITS)
        hit2 = ids == g2
        hit1 = (ids == g1) & (q > p) & ~hit2
        p *= unit
        q *= unit
        start = np.where(hit1, p, q)
        span = np.where(hit1, q, unit << _U(P_BITS))
        start[hit2] = 0
        np.copyto(span, p, where=hit2)
        span -= start
        rest = np.flatnonzero(~(hit1 | hit2))
        found = ids.take(rest, mode="clip")
        unit = span.take(rest, mode="clip") >> _U(TOTAL_BITS)
        start[rest] += unit * model.ends.take(found, mode="clip")
        span[rest] = unit * model.freq.take(found, mode="clip")
        low = self.low[:live]
        start += low
        up = np.flatnonzero(start < low)
        if len(up):
            at = self.at[up] - 1
            while len(at):
                self.flat[at] += np.uint32(1)
                at = at[self.flat[at] == 0] - 1
        full = np.flatnonzero(span < _FULL)
        at, done = self.at[full], start[full]
        self.flat[at] = done >> _U(32)
        self.at[full] = at + 1
        start[full] = done << _U(32)
        span[full] <<= _U(32)
        self.low[:live], self.range[:live] = start, span
        return ids, hit2, hit1

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Words per lane, and the words of all lanes."""
        for shift in (32, 0):
            self.flat[self.at] = (self.low >> _U(shift)) & (_FULL - _U(1))
            self.at += 1
        used = self.at - self.first
        return used, self.words[np.arange(self.words.shape[1]) < used[:, None]]


class _Reader:
    """Reads what the writer wrote."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        lanes = len(starts)
        self.words = np.concatenate([words, np.zeros(2, "<u4")]).astype(_U)
        self.at = np.minimum(starts, len(words))
        self.code, self.range = self.words[self.at] << _U(32) | self.words[self.at + 1], np.full(lanes, ~_U(0))
        self.at += 2

    def step(self, model: _Model, live: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g2, g1, p, q = model.look()
        code = self.code[:live]
        unit = self.range[:live] >> _U(P_BITS)
        p *= unit
        q *= unit
        hit2 = code < p
        told = code < q
        hit1 = told & ~hit2
        ids = np.where(hit2, g2, g1)
        start = np.where(hit1, p, q)
        span = np.where(hit1, q, unit << _U(P_BITS))
        start[hit2] = 0
        np.copyto(span, p, where=hit2)
        span -= start
        code -= start
        rest = np.flatnonzero(~told)
        unit = span.take(rest, mode="clip") >> _U(TOTAL_BITS)
        left = code.take(rest, mode="clip")
        found = model.find(np.minimum(left // unit, _U((1 << TOTAL_BITS) - 1)))
        ids[rest] = found
        code[rest] = left - unit * model.ends.take(found, mode="clip")
        span[rest] = unit * model.freq.take(found, mode="clip")
        full = np.flatnonzero(span < _FULL)
        at = self.at[full]
        # past its last word a lane reads on; what it reads there is never needed
        code[full] = code[full] << _U(32) | self.words.take(at, mode="clip")
        self.at[full] = at + 1
        span[full] <<= _U(32)
        self.range[:live] = span
        return ids, hit2, hit1


def _lanes(n: int) -> tuple[int, np.ndarray]:
    """Lanes of a block, and how many of them have an id at each step."""
    lanes = -(-n // STEPS)
    steps = min(n, STEPS)
    last = n - (lanes - 1) * STEPS
    return lanes, np.where(np.arange(steps) < last, lanes, lanes - 1)


def _coded(model: _Model, live: int, step, ids) -> np.ndarray:
    """One id in each of the first ``live`` lanes."""
    model.one, model.two = model.one[:live], model.two[:live]
    done = step(model, ids)
    model.take(*done)
    return done[0]


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """A block of ids below ``alphabet``, which may be at most half of 2**TOTAL_BITS."""
    if alphabet > 1 << (TOTAL_BITS - 1):
        raise ValueError("the alphabet is too large")
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if n and int(ids.max()) >= alphabet:
        raise ValueError("an id is beyond the alphabet")
    crc = zlib.crc32(ids)
    lanes, live = _lanes(n)
    if not n:
        return HEADER.pack(MAGIC, VERSION, alphabet, 0, 0, crc)
    grid = np.zeros((lanes, STEPS), np.uint32)
    grid.ravel()[:n] = ids
    grid = np.ascontiguousarray(grid.T)
    model, coder = _Model(alphabet, lanes), _Writer(lanes, STEPS)
    for step, some in enumerate(live.tolist()):
        _coded(model, some, coder.step, grid[step, :some])
    used, words = coder.finish()
    return b"".join([HEADER.pack(MAGIC, VERSION, alphabet, n, lanes, crc), used.astype("<u4").tobytes(), words.astype("<u4").tobytes()])


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; a block that is damaged raises ``ValueError``."""
    if len(block) < HEADER.size:
        raise ValueError("the block is too short")
    magic, version, alphabet, n, lanes, crc = HEADER.unpack_from(block)
    if magic != MAGIC or version != VERSION or lanes != -(-n // STEPS):
        raise ValueError("not a block of ids")
    ids = np.zeros(0, "<u4")
    if n:
        body = HEADER.size + 4 * lanes
        if len(block) < body:
            raise ValueError("the block is too short")
        used = np.frombuffer(block, "<u4", lanes, HEADER.size).astype(np.int64)
        if len(block) != body + 4 * int(used.sum()):
            raise ValueError("the block has another length than it says")
        words = np.frombuffer(block, "<u4", offset=body)
        model, coder = _Model(alphabet, lanes), _Reader(words, np.cumsum(used) - used)
        grid = np.zeros((STEPS, lanes), "<u4")
        for step, some in enumerate(_lanes(n)[1].tolist()):
            grid[step, :some] = _coded(model, some, coder.step, some)
        ids = np.ascontiguousarray(grid.T).ravel()[:n]
    if zlib.crc32(ids) != crc:
        raise ValueError("the checksum does not match")
    return ids
