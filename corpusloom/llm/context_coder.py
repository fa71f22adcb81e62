"""Lossless blocks of ids: an adaptive mixture of order-0, order-1 and order-2 predictions drives a range coder.

A block begins with an empty model and can be decoded by itself. Its ids are cut into lanes, equal stretches that are coded
side by side: step t codes the t-th id of every lane as one numpy operation, each lane with its own coder, and all
lanes teach one model, which thus sees the whole block.

Order 0 is a distribution over all ids, from counts that are summed anew each time the coded ids have grown by a quarter. Orders
1 and 2 each name one id, the one that last held its ground after the same id or the same two ids, and how firmly. The
mixture gives each order a weight that depends on how firm both are and on whether they agree. Weights follow the share that
each order had in the probability of the ids that came. All arithmetic is of integers, so that every machine decodes alike.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES, LANE_IDS = 8192, 256  # lanes of a block at most; ids that a lane has at least, if the block has so many
MAX_ALPHABET = 1 << 19
TOTAL_BITS = 18  # frequencies of order 0 sum to 2 ** TOTAL_BITS, or more bits for more than half as many ids
SHARE_BITS = 10  # the weights of a mixture sum to 2 ** SHARE_BITS
CONTEXT_BITS = 18  # order-2 contexts are told apart by so many bits of a hash
FIRM_BITS = 3
FIRM_1, FIRM_2 = 3, 7  # the firmest predictions
AGES = 1 << 22  # evidence for a mixture's weights is halved beyond this
TEACH = 8  # every so many steps the weights learn
WORD = np.uint64(32)
FULL = np.uint64(0xFFFFFFFF)


class _Order:
    """One predicted id a context, and how firmly it is predicted (0: not at all), as one number."""

    def __init__(self, contexts: int, none: int, firmest: int):
        self.cells, self.firmest = np.full(contexts, none << FIRM_BITS, np.int32), firmest

    def predict(self, at: np.ndarray) -> None:
        self.at, self.cell = at, self.cells.take(at, mode="clip")
        self.named, self.firm = self.cell >> FIRM_BITS, self.cell & 7

    def learn(self, came: np.ndarray, right: np.ndarray) -> None:
        """A right prediction grows firmer, a wrong one weaker, and the id that came takes the place of one that has no firmness left. Of lanes with one context the last is heard."""
        moved = self.cell + right * (self.firm < self.firmest) - ~right
        fresh = came << FIRM_BITS | 1
        self.cells[self.at] = fresh + ((self.firm > 0) | right) * (moved - fresh)


class Model:
    """What the coder knows of a block before each step. Ids are below `alphabet`, which itself stands for no id."""

    def __init__(self, alphabet: int, lanes: int):
        self.none = alphabet
        self.bits = max(TOTAL_BITS, (alphabet - 1).bit_length() + 1)
        self.whole_bits = self.bits + SHARE_BITS  # at most 30: intervals are 32-bit integers
        self.counts = np.zeros(alphabet, np.int64)
        self.seen, self.summed, self.step, self.unsummed = 0, 0, 0, []
        self.orders = _Order(alphabet + 1, alphabet, FIRM_1), _Order(1 << CONTEXT_BITS, alphabet, FIRM_2)
        self.evidence = np.full((3, (FIRM_1 + 1) * (FIRM_2 + 1) * 2), 1 << 12, np.int64)
        self.before = np.full(lanes, alphabet, np.int64), np.full(lanes, alphabet, np.int64)
        self._sum()
        self._weigh()

    def _sum(self) -> None:
        """Frequencies of order 0, none of them zero; what rounding leaves over goes to the most frequent id."""
        if self.unsummed:
            self.counts += np.bincount(np.concatenate(self.unsummed), minlength=self.none)
        self.unsummed, self.summed = [], self.seen
        freq = 1 + self.counts * ((1 << self.bits) - self.none) // max(1, self.seen)
        freq[self.counts.argmax()] += (1 << self.bits) - freq.sum()
        self.freq = np.append(freq, 0).astype(np.int32)
        self.below = np.append(0, np.cumsum(freq)).astype(np.int32)
        self.owner = None

    def _weigh(self) -> None:
        share = ((self.evidence << SHARE_BITS) // self.evidence.sum(axis=0)).astype(np.int32)
        self.zero_of, self.mass_of = (1 << SHARE_BITS) - share[1] - share[2], (share[1] << self.bits, share[2] << self.bits)

    def predict(self, m: int) -> None:
        """The mixtures of the first m lanes."""
        one, two = self.before[0][:m], self.before[1][:m]
        a, b = self.orders
        a.predict(one)
        b.predict((one * 0x9E3779B1 + two * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - CONTEXT_BITS)
        self.agree = a.named == b.named
        self.context = ((b.firm * (FIRM_1 + 1) + a.firm) * 2 + self.agree).astype(np.int64)
        self.zero, *self.mass = (x.take(self.context, mode="clip") for x in (self.zero_of, *self.mass_of))

    def interval(self, came: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids lie in their mixtures, and how wide they are."""
        a, b = self.orders
        self.right = a.named == came, b.named == came
        own = self.zero * self.freq.take(came, mode="clip")
        low = self.zero * self.below.take(came, mode="clip") + self.mass[0] * (a.named < came) + self.mass[1] * (b.named < came)
        self.wide = own + self.mass[0] * self.right[0] + self.mass[1] * self.right[1]
        return low, self.wide

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the given points."""
        if self.owner is None:
            self.owner = np.repeat(np.arange(self.none, dtype=np.int32), self.freq[:-1])
        a, b = self.orders
        # order 0 alone is left when the named ids' masses are taken out, that of the lower id first; within a mass, its id begins
        low, high = np.minimum(a.named, b.named), np.maximum(a.named, b.named)
        first = self.mass[0] + (a.named > b.named) * (self.mass[1] - self.mass[0])
        for named, mass in ((low, first), (high, self.mass[0] + self.mass[1] - first)):
            at = np.minimum(at, np.maximum(at - mass, self.zero * self.below.take(named, mode="clip")))
        return self.owner.take((at / self.zero).astype(np.int64), mode="clip")

    def learn(self, came: np.ndarray) -> None:
        m, narrow = len(came), came.astype(np.int32)
        for order, right in zip(self.orders, self.right, strict=True):
            order.learn(narrow, right)
        if self.step % TEACH == 0:
            # an order's share in the probability of what came; divisions of doubles are exact to the last bit everywhere
            n = self.evidence.shape[1]
            shares = [np.floor((mass * right) * float(1 << SHARE_BITS) / self.wide) for mass, right in zip(self.mass, self.right, strict=True)]
            told = [np.bincount(self.context, weights=x, minlength=n).astype(np.int64) for x in shares]
            self.evidence += [(np.bincount(self.context, minlength=n) << SHARE_BITS) - told[0] - told[1], *told]
            old = self.evidence.sum(axis=0) > AGES
            self.evidence[:, old] = (self.evidence[:, old] >> 1) + (1 << SHARE_BITS)
            self._weigh()
        self.step += 1
        self.before[1][:m] = self.before[0][:m]
        self.before[0][:m] = came
        self.unsummed.append(narrow)
        self.seen += m
        if self.seen > self.summed + (self.summed >> 2):
            self._sum()


def _steps(n: int, lanes: int) -> tuple[int, np.ndarray]:
    """Ids a lane, and for each step the number of lanes that have an id left (the last lanes may be short or empty)."""
    steps = -(-n // lanes)
    full, rest = divmod(n, steps) if steps else (0, 0)
    return steps, np.where(np.arange(steps) < rest, full + 1, full)


def encode(ids: np.ndarray, lanes: int = LANES) -> bytes:
    """ids as bytes: the number of lanes, the words of each, the words."""
    n, alphabet = len(ids), int(np.max(ids, initial=0)) + 1
    if alphabet > MAX_ALPHABET or np.min(ids, initial=0) < 0:
        raise ValueError(f"ids lie between 0 and {MAX_ALPHABET - 1}")
    ids = np.asarray(ids, np.int64)
    lanes = max(1, min(lanes, n // LANE_IDS))
    steps, active = _steps(n, lanes)
    model = Model(alphabet, lanes)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    words, used, lane = np.zeros((steps + 2, lanes), np.uint32), np.zeros(lanes, np.int64), np.arange(lanes)

    def carry(at: np.ndarray) -> None:
        place = used[at] - 1
        while len(at):
            words[place, at] += np.uint32(1)
            on = words[place, at] == 0
            at, place = at[on], place[on] - 1

    def emit(at: np.ndarray) -> None:
        words[used[at], at] = low[at] >> WORD
        used[at] += 1
        low[at] = (low[at] & FULL) << WORD

    first = lane * steps
    for t in range(steps):
        m = int(active[t])
        came = ids[first[:m] + t]
        model.predict(m)
        at, size = model.interval(came)
        unit = wide[:m] >> np.uint64(model.whole_bits)
        added = low[:m] + unit * at.astype(np.uint64)
        over = np.flatnonzero(added < low[:m])
        low[:m] = added
        if len(over):
            carry(over)
        wide[:m] = unit * size.astype(np.uint64)
        small = np.flatnonzero(wide[:m] <= FULL)
        if len(small):
            emit(small)
            wide[small] <<= WORD
        model.learn(came)
    # a point of the last interval that ends in 32 zeros, which the decoder adds by itself
    ended = low + FULL
    over, low = np.flatnonzero(ended < low), ended
    if len(over):
        carry(over)
    emit(lane)
    head = np.array([n, alphabet, lanes], "<u4").tobytes() + used.astype("<u4").tobytes()
    return head + words.T[np.arange(steps + 2) < used[:, None]].astype("<u4").tobytes()


def decode(raw: bytes) -> np.ndarray:
    n, alphabet, lanes = (int(x) for x in np.frombuffer(raw, "<u4", 3))
    used = np.frombuffer(raw, "<u4", lanes, 12).astype(np.int64)
    # each lane's words and the 32 zeros that its coder left out
    until = np.cumsum(used)
    words = np.insert(np.frombuffer(raw, "<u4", offset=12 + 4 * lanes), until, 0).astype(np.uint64)
    steps, active = _steps(n, lanes)
    place = until - used + np.arange(lanes)

    def read(at: np.ndarray) -> np.ndarray:
        next_word = place[at]
        place[at] = next_word + 1
        return words.take(next_word, mode="clip")

    lane = np.arange(lanes)
    point = read(lane) << WORD
    point |= read(lane)
    wide = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    model, out, first = Model(alphabet, lanes), np.zeros(n, np.int32), lane * steps
    last = np.uint64((1 << model.whole_bits) - 1)
    for t in range(steps):
        m = int(active[t])
        model.predict(m)
        unit = wide[:m] >> np.uint64(model.whole_bits)
        came = model.find(np.minimum(point[:m] // unit, last).astype(np.int32))
        at, size = model.interval(came)
        point[:m] -= unit * at.astype(np.uint64)
        wide[:m] = unit * size.astype(np.uint64)
        small = np.flatnonzero(wide[:m] <= FULL)
        if len(small):
            point[small] = point[small] << WORD | read(small)
            wide[small] <<= WORD
        model.learn(came)
        out[first[:m] + t] = came
    return out.astype(np.uint32)


def checksum(raw: bytes | np.ndarray) -> int:
    return zlib.crc32(raw if isinstance(raw, bytes) else raw.astype("<u4").tobytes())
