"""Adaptive context-mixing range coder for token ids, run over many blocks in step.

A block is coded from a fresh model, so blocks are independent: the coder takes one id of every
block at a time, and each operation is one NumPy call over all of them. Ids become ranks, in the
order in which a block first holds them. Three predictions are mixed for every id:

* order 2 and order 1 name the rank that followed the two ranks, or the one rank, before it. How
  far such a name is believed is an adaptive probability for each pair of recent hit counts of the
  two orders; where they agree, the chances that both are wrong multiply, and where they differ,
  order 1 gets its share of what order 2 leaves;
* order 0 shares the rest among the ranks by their counts so far, as cumulative counts that are
  summed anew every ``REFRESH`` ids. Ranks that are newer than the last sum have the weight
  ``FRESH``, and so has the next new rank.

A new rank is followed by the id itself: its number of bits, by adaptive counts, and those bits.

``encode_words`` does the same for symbols out of a dictionary whose counts the decoder has: there order 0 is
those counts, so there are no new ranks, and only orders 1 and 2 adapt.
All arithmetic is on integers, so any machine decodes what another one has written.
"""

from __future__ import annotations

import numpy as np

#: Ids between two sums of the order-0 counts (four times as many after the first ``SETTLED`` ids).
REFRESH, SETTLED = 64, 1024
#: Weight of a count, and of a rank that has none yet.
COUNT, FRESH = 8, 4
#: Bits of a probability and of an order-2 slot, and the step by which probabilities adapt.
BITS, SLOT_BITS, RATE = 16, 12, 5
#: Hit counts of a named rank are below it.
LEVELS = 8
#: Longest block: its ranks and counts fit in the tables' 16 bits, its order-0 weights in 20.
LONGEST = 1 << 15
_ONE = 1 << BITS
_RENORM, _TOP = 1 << 40, (1 << 56) - 1


class _Writer:
    """Range coder of many lanes: low and range of 56 bits, 16-bit words out, carries pushed back."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, _TOP, np.int64)
        self.out, self.at = np.zeros((lanes, words), np.uint16), np.zeros(lanes, np.int64)

    def move(self, n: int, below: np.ndarray, wide: np.ndarray) -> None:
        """The first n lanes go on to the part of their range that starts at ``below`` and is ``wide``."""
        self.low[:n] += below
        self.range[:n] = wide
        over = np.flatnonzero(self.low[:n] > _TOP)
        if len(over):
            self.low[over] &= _TOP
            at = self.at[over] - 1
            while len(over):
                self.out[over, at] += np.uint16(1)
                again = self.out[over, at] == 0
                over, at = over[again], at[again] - 1
        short = np.flatnonzero(wide < _RENORM)
        while len(short):
            low = self.low[short]
            self._emit(short, low >> 40)
            self.low[short] = (low & (_RENORM - 1)) << 16
            wide = self.range[short] << 16
            self.range[short] = wide
            short = short[wide < _RENORM]

    def put(self, lanes: np.ndarray, below: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        """Codes one symbol in some lanes only."""
        n = len(self.low)
        low, wide = np.zeros(n, np.int64), self.range.copy()
        step = wide[lanes] // total
        low[lanes], wide[lanes] = step * below, step * size
        self.move(n, low, wide)

    def _emit(self, lanes: np.ndarray, words: np.ndarray) -> None:
        at = self.at[lanes]
        if at.max() >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[lanes, at] = words
        self.at[lanes] = at + 1

    def close(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(4 if len(every) else 0):
            self._emit(every, self.low >> 40)
            self.low = (self.low & (_RENORM - 1)) << 16
        return [row[:n].astype("<u2").tobytes() for row, n in zip(self.out, self.at, strict=True)]


class _Reader:
    """The reverse of ``_Writer``; past its end a lane reads zeros."""

    def __init__(self, payloads: list[bytes]):
        sizes = np.array([len(p) // 2 for p in payloads])
        self.words = np.zeros((len(payloads), int(sizes.max(initial=0)) + 4), np.uint16)
        for row, p in zip(self.words, payloads, strict=True):
            row[: len(p) // 2] = np.frombuffer(p, "<u2", len(p) // 2)
        self.range, self.at = np.full(len(payloads), _TOP, np.int64), np.full(len(payloads), 3)
        head = self.words[:, :4].astype(np.int64)
        self.code = head[:, 0] << 40 | head[:, 1] << 24 | head[:, 2] << 8 | head[:, 3] >> 8
        # The code holds 56 bits: three words and a half; ``half`` is the other half of the last one.
        self.half = head[:, 3] & 255

    def move(self, n: int, below: np.ndarray, wide: np.ndarray) -> None:
        self.code[:n] -= below
        self.range[:n] = wide
        short = np.flatnonzero(wide < _RENORM)
        while len(short):
            self.at[short] += 1
            word = self.words[short, np.minimum(self.at[short], self.words.shape[1] - 1)].astype(np.int64)
            self.code[short] = self.code[short] << 16 | self.half[short] << 8 | word >> 8
            self.half[short] = word & 255
            wide = self.range[short] << 16
            self.range[short] = wide
            short = short[wide < _RENORM]

    def get(self, lanes: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.minimum(self.code[lanes] // (self.range[lanes] // total), total - 1)

    def took(self, lanes: np.ndarray, below: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        n = len(self.code)
        low, wide = np.zeros(n, np.int64), self.range.copy()
        step = wide[lanes] // total
        low[lanes], wide[lanes] = step * below, step * size
        self.move(n, low, wide)


class _Model:
    """State of all lanes; ``longest`` is the longest block's length, which bounds the ranks of a lane."""

    def __init__(self, lanes: int, longest: int):
        self.ranks = longest + 2
        self.known = np.zeros(lanes, np.int64)  # ranks of each lane so far
        self.counts = np.zeros(lanes * self.ranks, np.uint16)
        self.base = np.arange(lanes) * self.ranks
        # A named rank + 1 (0: none) above three bits of hit count; two probabilities of 16 bits.
        self.order1 = np.zeros(lanes * self.ranks, np.uint32)
        self.order2 = np.zeros(lanes << SLOT_BITS, np.uint32)
        self.slots = np.arange(lanes) << SLOT_BITS
        self.trust = np.full(lanes * LEVELS * LEVELS, _ONE // 3 << BITS | _ONE // 4, np.uint32)
        self.trusts = np.arange(lanes) * LEVELS * LEVELS
        self.widths = np.ones((lanes, 33), np.int64)
        self.last, self.before = np.full(lanes, longest + 1), np.full(lanes, longest + 1)

    def refresh(self, n: int) -> None:
        """Sums the counts of the first n lanes: one running sum over all of them, ``start`` before each."""
        self.summed = self.known[:n].copy()
        width = int(self.summed.max(initial=0)) + 1
        sums = np.cumsum(self.counts.reshape(-1, self.ranks)[:n, :width], dtype=np.int64)
        self.sums = np.concatenate([np.zeros(1, np.int64), sums]) * COUNT
        self.row = np.arange(n) * width
        self.start = self.sums[self.row]
        self.total0 = self.sums[self.row + width] - self.start

    def names(self, n: int) -> None:
        """The ranks that orders 2 and 1 name in the first n lanes (-1: none) and their probabilities."""
        self.n = n
        last, before = self.last[:n], self.before[:n]
        self.at1 = self.base[:n] + last
        self.at2 = self.slots[:n] + ((last * 40503 + before * 30011 + (before >> 5)) & ((1 << SLOT_BITS) - 1))
        self.e1, self.e2 = self.order1[self.at1].astype(np.int64), self.order2[self.at2].astype(np.int64)
        self.t = self.trusts[:n] + ((self.e2 & 7) << 3 | self.e1 & 7)
        trust = self.trust[self.t].astype(np.int64)
        self.q2, self.q1 = trust >> BITS, trust & (_ONE - 1)
        self.n1, self.n2 = (self.e1 >> 3) - 1, (self.e2 >> 3) - 1
        p2 = self.q2 * (self.n2 >= 0)
        share = (self.q1 * (_ONE - p2) >> BITS) * (self.n1 >= 0)
        same = share * (self.n1 == self.n2)
        self.p2 = p2 + same
        self.named = p2 + share
        self.other1 = self.named > self.p2  # order 1 names another rank than order 2
        # Order 0's total in each lane; a lane that is not summed yet has its new ranks only.
        self.total = self.total0[:n] + (self.known[:n] + 1 - self.summed[:n]) * FRESH

    def order0(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order-0 weight of the ranks under the given one of each lane, and its own."""
        n = self.n
        old = np.minimum(ranks, self.summed[:n])
        at = self.row[:n] + old
        low = self.sums[at]
        newer = ranks - old
        size = np.where(ranks >= self.summed[:n], FRESH, self.sums[at + 1] - low)
        return low - self.start[:n] + newer * FRESH, size

    def find(self, value: np.ndarray) -> np.ndarray:
        """The rank whose order-0 interval holds the value."""
        n = self.n
        old = np.searchsorted(self.sums, np.minimum(value, self.total0[:n] - 1) + self.start[:n], "right") - 1 - self.row[:n]
        return np.where(value < self.total0[:n], old, self.summed[:n] + (value - self.total0[:n]) // FRESH)

    def update(self, rank: np.ndarray) -> None:
        n = self.n
        hit1, hit2 = rank == self.n1, rank == self.n2
        q1 = self.q1 + np.where(hit1, _ONE - self.q1 >> RATE, -(self.q1 >> RATE)) * (self.n1 >= 0)
        q2 = self.q2 + np.where(hit2, _ONE - self.q2 >> RATE, -(self.q2 >> RATE)) * (self.n2 >= 0)
        self.trust[self.t] = q2 << BITS | q1
        named = rank + 1 << 3
        for table, at, entry, hit in ((self.order1, self.at1, self.e1, hit1), (self.order2, self.at2, self.e2, hit2)):
            sure = entry & 7
            missed = np.where(sure < 2, named, entry - sure + (sure >> 1))
            table[at] = np.where(hit, entry + (sure < LEVELS - 1), missed)
        self.counts[self.base[:n] + rank] += np.uint16(1)
        self.known[:n] += rank == self.known[:n]
        self.before[:n] = self.last[:n]
        self.last[:n] = rank


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the ids by first occurrence, and where an id comes for the first time."""
    _, first, code = np.unique(ids, return_index=True, return_inverse=True)
    order = np.argsort(np.argsort(first))
    new = np.zeros(len(ids), bool)
    new[first] = True
    return order[code], new


def _lanes(sizes: list[int]) -> tuple[list[int], np.ndarray]:
    """Blocks with the longest first, so that those still running are the first lanes."""
    if max(sizes, default=0) > LONGEST:
        raise ValueError(f"a block of {max(sizes)} ids is longer than {LONGEST}")
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    return order, np.array([sizes[k] for k in order], np.int64)


def _running(sizes: np.ndarray, model: _Model):
    """Each step and the number of lanes that have an id there, with the model ready to name ranks."""
    for i in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -i, "left"))
        if i % (REFRESH if i < SETTLED else 4 * REFRESH) == 0:
            model.refresh(n)
        model.names(n)
        yield i, n


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """One payload for each block of ids (below 2**32)."""
    order, sizes = _lanes([len(b) for b in blocks])
    most = int(sizes.max(initial=0))
    ranks, news, ids = (np.zeros((most, len(blocks)), t) for t in (np.int64, bool, np.int64))
    for lane, k in enumerate(order):
        ranks[: sizes[lane], lane], news[: sizes[lane], lane] = _ranks(blocks[k])
        ids[: sizes[lane], lane] = blocks[k]
    model, out = _Model(len(blocks), most), _Writer(len(blocks), most // 2 + 16)
    for i, n in _running(sizes, model):
        rank = ranks[i, :n]
        is2, is1 = rank == model.n2, (rank == model.n1) & model.other1
        under, size = model.order0(rank)
        step = out.range[:n] >> BITS
        below = step * np.where(is2, 0, np.where(is1, model.p2, model.named))
        wide = step * np.where(is2, model.p2, np.where(is1, model.named - model.p2, _ONE - model.named))
        inner = wide // model.total
        hit = is2 | is1
        out.move(n, np.where(hit, below, below + inner * under), np.where(hit, wide, inner * size))
        lanes = np.flatnonzero(news[i, :n])
        if len(lanes):
            value = ids[i, lanes]
            width = np.frexp(value.astype(np.float64))[1].astype(np.int64)
            table, row = model.widths[lanes], np.arange(len(lanes))
            sums = np.cumsum(table, axis=1)
            out.put(lanes, sums[row, width] - table[row, width], table[row, width], sums[:, -1])
            model.widths[lanes, width] += 8
            if width.max() > 16:
                out.put(lanes, value >> 16, np.ones_like(value), 1 << np.maximum(width - 16, 0))
            out.put(lanes, value & 65535, np.ones_like(value), 1 << np.minimum(width, 16))
        model.update(rank)
    payloads = out.close()
    back = np.argsort(order, kind="stable")
    return [payloads[k] for k in back]


def decode(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The blocks of ids of ``encode``, from its payloads and their numbers of ids."""
    order, lengths = _lanes(sizes)
    most = int(lengths.max(initial=0))
    model, data = _Model(len(order), most), _Reader([payloads[k] for k in order])
    known = np.zeros((len(order), most + 2), np.uint32)  # id of each rank
    out, every = np.zeros((most, len(order)), np.uint32), np.arange(len(order))
    for i, n in _running(lengths, model):
        step = data.range[:n] >> BITS
        value = np.minimum(data.code[:n] // step, _ONE - 1)
        is2, is1 = value < model.p2, (value >= model.p2) & (value < model.named)
        below = step * np.where(is2, 0, np.where(is1, model.p2, model.named))
        wide = step * np.where(is2, model.p2, np.where(is1, model.named - model.p2, _ONE - model.named))
        inner = wide // model.total
        hit = is2 | is1
        rank = model.find(np.where(hit, 0, np.minimum((data.code[:n] - below) // inner, model.total - 1)))
        rank = np.where(is2, model.n2, np.where(is1, model.n1, rank))
        under, size = model.order0(rank)
        data.move(n, np.where(hit, below, below + inner * under), np.where(hit, wide, inner * size))
        lanes = np.flatnonzero(rank == model.known[:n])
        if len(lanes):
            table, row = model.widths[lanes], np.arange(len(lanes))
            sums = np.cumsum(table, axis=1)
            width = (sums <= data.get(lanes, sums[:, -1])[:, None]).sum(axis=1)
            data.took(lanes, sums[row, width] - table[row, width], table[row, width], sums[:, -1])
            model.widths[lanes, width] += 8
            upper = np.zeros(len(lanes), np.int64)
            if width.max() > 16:
                total = 1 << np.maximum(width - 16, 0)
                upper = data.get(lanes, total)
                data.took(lanes, upper, np.ones_like(upper), total)
            total = 1 << np.minimum(width, 16)
            lower = data.get(lanes, total)
            data.took(lanes, lower, np.ones_like(lower), total)
            known[lanes, rank[lanes]] = upper << 16 | lower
        out[i, :n] = known[every[:n], rank]
        model.update(rank)
    back = np.argsort(order, kind="stable")
    return [out[: sizes[k], lane].copy() for k, lane in enumerate(back)]


#: Bits of a slot of orders 1 and 2 of a word coder.
WORD_SLOTS = 10
#: Symbols coded with one dictionary at most: a part of a range is then never empty.
MOST_WORDS = 1 << 22
_MIX = 0x9E3779B1


#: What a slot's hit count gains by its count, without a hit and with one. Without a hit a count below 2 gets the new name.
_STEPS = np.array([0, 0, -1, -2, -2, -3, -3, -4, 0, 1, 1, 1, 1, 1, 1, 0], np.int32)


class _Followers:
    """Orders 2 and 1, in this sequence, of all lanes over symbols of a dictionary; symbols are given plus 1, 0 is none."""

    def __init__(self, lanes: int):
        # A named symbol + 1 above three bits of hit count, which is 0 only where none is named.
        self.orders = np.zeros(2 * lanes << WORD_SLOTS, np.int32)
        self.slots = np.arange(2 * lanes).reshape(2, lanes) << WORD_SLOTS
        # Two probabilities of 16 bits, 31 at least; those of a count of 0 are 0 and stay so.
        start = np.add.outer((_ONE // 3 << BITS) * (np.arange(LEVELS) > 0), _ONE // 4 * (np.arange(LEVELS) > 0))
        self.trust = np.tile(start.ravel(), lanes)
        self.trusts = np.arange(lanes) * LEVELS * LEVELS
        self.mixed = np.zeros((2, lanes), np.int64)

    def names(self, n: int) -> None:
        self.at = self.mixed[:, :n] >> 14
        self.at &= (1 << WORD_SLOTS) - 1
        self.at += self.slots[:, :n]
        self.entries = self.orders.take(self.at)
        self.sure = self.entries & 7
        self.t = self.sure[0] << 3 | self.sure[1]
        self.t = self.trusts[:n] + self.t
        trust = self.trust.take(self.t)
        self.q = np.empty((2, n), np.int64)
        np.right_shift(trust, BITS, out=self.q[0])
        np.bitwise_and(trust, _ONE - 1, out=self.q[1])
        self.n2, self.n1 = self.named_by = self.entries >> 3
        self.named = _ONE - self.q[0]
        self.named *= self.q[1]
        self.named >>= BITS
        self.named += self.q[0]
        self.p2 = np.where(self.n1 == self.n2, self.named, self.q[0])

    def update(self, symbol: np.ndarray) -> None:
        """``symbol``: of 4 bytes, as names are."""
        n = len(symbol)
        hit = self.named_by == symbol
        change = hit * (_ONE - 62)
        change += 31
        change -= self.q
        change >>= RATE
        self.q += change
        self.q[0] <<= BITS
        self.trust[self.t] = self.q[0] | self.q[1]
        self.sure += hit.view(np.int8) << 3
        self.orders[self.at] = np.where(self.sure < 2, symbol << 3 | 1, self.entries + _STEPS.take(self.sure))
        mixed = symbol.astype(np.int64)
        mixed *= _MIX
        mixed &= 0xFFFFFFFF
        np.multiply(self.mixed[1, :n], 3, out=self.mixed[0, :n])
        self.mixed[0, :n] += mixed
        self.mixed[1, :n] = mixed


def encode_words(blocks: list[np.ndarray], counts: np.ndarray) -> list[bytes]:
    """One payload for each block of symbols; ``counts``: how often each symbol occurs in all blocks, at least 1."""
    order, sizes = _lanes([len(b) for b in blocks])
    most, total = int(sizes.max(initial=0)), int(counts.sum())
    if total > MOST_WORDS:
        raise ValueError(f"{total} words of one dictionary are more than {MOST_WORDS}")
    sums = np.concatenate([[0], np.cumsum(counts)])
    symbols = np.zeros((most, len(blocks)), np.int32)
    for lane, k in enumerate(order):
        symbols[: sizes[lane], lane] = blocks[k]
    model, out = _Followers(len(blocks)), _Writer(len(blocks), most + 16)
    for i in range(most):
        n = int(np.searchsorted(-sizes, -i, "left"))
        symbol = symbols[i, :n]
        under, over = sums.take(symbol), sums.take(symbol + 1)
        symbol = symbol + 1
        model.names(n)
        is2, is1 = symbol == model.n2, (symbol == model.n1) & (model.named > model.p2)
        hit, step = is2 | is1, out.range[:n] >> BITS
        low = np.where(is1, model.p2, model.named)
        low *= ~is2
        high = np.where(is2, model.p2, np.where(is1, model.named, _ONE))
        below, wide = step * low, step * (high - low)
        inner = wide // total
        out.move(n, np.where(hit, below, below + inner * under), np.where(hit, wide, inner * (over - under)))
        model.update(symbol)
    payloads = out.close()
    return [payloads[k] for k in np.argsort(order, kind="stable")]


def decode_words(payloads: list[bytes], sizes: list[int], counts: np.ndarray) -> list[np.ndarray]:
    """The blocks of symbols of ``encode_words``."""
    order, lengths = _lanes(sizes)
    most, total = int(lengths.max(initial=0)), int(counts.sum())
    sums, symbol_at = np.concatenate([[0], np.cumsum(counts)]), np.repeat(np.arange(1, len(counts) + 1, dtype=np.int32), counts)
    model, data = _Followers(len(order)), _Reader([payloads[k] for k in order])
    out = np.zeros((most, len(order)), np.int32)
    for i in range(most):
        n = int(np.searchsorted(-lengths, -i, "left"))
        model.names(n)
        code, step = data.code[:n], data.range[:n] >> BITS
        edge2, edge = step * model.p2, step * model.named
        is2, hit = code < edge2, code < edge
        below = np.where(hit, edge2, edge) * ~is2
        wide = np.where(is2, edge2, np.where(hit, edge - edge2, step * (_ONE - model.named)))
        inner = wide // total
        value = np.minimum((code - below) // inner, total - 1)
        symbol = np.where(hit, np.where(is2, model.n2, model.n1), symbol_at.take(value))
        over, under = sums.take(symbol), sums.take(symbol - 1)
        data.move(n, np.where(hit, below, below + inner * under), np.where(hit, wide, inner * (over - under)))
        out[i, :n] = symbol
        model.update(symbol)
    out -= 1
    return [out[: sizes[k], lane].copy() for k, lane in enumerate(np.argsort(order, kind="stable"))]
