"""A context-mixing range coder for token ids, run on many independent blocks in step.

Each block of ids is coded from a fresh model, so blocks decode apart from one another. Step t codes id t of every block
at once with array operations over the blocks. For each id the model has three predictions: what followed the last two
ids before (order 2), what followed the last id before (order 1), and the block's own distribution of ids (order 0).
The chance that order 2 is right is mixed from two adaptive estimates, by its own run of hits and by both orders' runs
together, under a weight that learns which of the two is better; order 1 gets an adaptive share of the rest, and order 0
what then remains. Order 0 has the ids in CLASSES classes of about equal mass: the classes' shares adapt within the
block, and within a class the ids are as frequent as in the chunk that the blocks belong to. An id takes one coding step.
All arithmetic is on integers, so that coder and decoder agree on any machine.

The files of token_files are coded and read by the same model in RangeCoder.java, to the same bytes. What is here states
the format, and reads a chunk without Spark.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids a block; entries of a block's order-1 and order-2 tables.
BLOCK, ENTRIES = 2048, 1024
#: Bits of shares, of the classes' shares of order 0, and of the frequencies in a class.
BITS, BITS_C, BITS0 = 15, 14, 16
ONE, ONE_C = 1 << BITS, 1 << BITS_C
#: Order-0 classes; the least share of a class of order 0's, and of order 0 of all.
CLASSES, LEAST, LEAST0 = 8, 32, 512
#: Blocks that are coded in step; bounds the tables' memory to LANES * ENTRIES * 8 bytes.
LANES = 4096
LOW0 = (1 << BITS0) - 1
_U = np.uint64


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, frequent ones first, and their frequencies, at least 1, which sum to 2^BITS0 in each class."""
    which, counts = np.unique(ids, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    which, counts = which[order], counts[order].astype(np.int64)
    most = 1 << BITS0 - 1
    if len(which) > CLASSES * most:
        raise ValueError(f"over {CLASSES * most} distinct ids in a chunk")
    before = np.cumsum(counts) - counts
    of = np.minimum(before * CLASSES // counts.sum(), CLASSES - 1 - np.arange(len(which))[::-1] // most)
    freq = np.zeros(len(which), np.int64)
    for k in np.unique(of):
        own = np.flatnonzero(of == k)
        freq[own] = 1 + counts[own] * ((1 << BITS0) - len(own)) // counts[own].sum()
        freq[own[0]] += (1 << BITS0) - freq[own].sum()
    return which.astype(np.int64), freq


class _Model:
    """Tables and estimates of each lane. A table entry is the id seen last in its context, and its hits since then up to 3."""

    def __init__(self, lanes: int, classes: int):
        n = lanes
        self.base = np.arange(n, dtype=np.uint32) * np.uint32(ENTRIES)
        self.t1, self.t2 = (np.full(n * ENTRIES, -4, np.int32) for _ in range(2))
        self.by4, self.by32 = np.arange(n, dtype=np.int32) * 4, np.arange(n, dtype=np.int32) * 32
        self.pa = np.full(n * 4, ONE // 4, np.int32)
        self.pb, self.pd = (np.full(n * 32, ONE // 4, np.int32) for _ in range(2))
        self.w = np.full(n, ONE // 2, np.int32)
        self.prev1, self.prev2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        #: Where each class ends among order 0's ONE_C (unused ones at the end), and what that moves towards after each class.
        at, c = np.arange(1, CLASSES + 1), np.arange(classes)[:, None]
        self.cdf = np.tile(np.minimum(at * ONE_C // classes, ONE_C).astype(np.int16), (n, 1))
        self.by8 = np.arange(n, dtype=np.int64) * CLASSES
        towards = np.where(at <= c, at * LEAST, ONE_C - np.maximum(classes - at, 0) * LEAST).astype(np.int16)
        # a row of 16 bytes as one element, which is taken at once
        self.towards = towards.view(np.complex128)[:, 0]

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """For the first n lanes: the ids that order 2 and order 1 predict, and where their shares end."""
        p1 = self.prev1[:n] * _H1
        self.i1 = (p1 >> _SHIFT) + self.base[:n]
        self.i2 = ((p1 ^ self.prev2[:n]) * _H2 >> _SHIFT) + self.base[:n]
        e1, e2 = self.t1[self.i1], self.t2[self.i2]
        self.s1, self.s2, self.n1, self.n2 = e1 >> 2, e2 >> 2, e1 & 3, e2 & 3
        self.differ = self.s1 != self.s2
        self.ka = self.by4[:n] + self.n2
        self.kb = self.by32[:n] + (self.n2 << 3) + (self.n1 << 1) + self.differ
        self.a, self.b, self.d = self.pa[self.ka], self.pb[self.kb], self.pd[self.kb]
        end2 = self.b + (self.w[:n] * (self.a - self.b) >> BITS)
        np.minimum(np.maximum(end2, 16, out=end2), ONE - 2 * LEAST0, out=end2)
        share1 = ((ONE - end2) * self.d >> BITS) * self.differ
        end1 = np.minimum(np.maximum(share1, self.differ * np.int32(16), out=share1) + end2, ONE - LEAST0)
        return self.s2, self.s1, end2, end1

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        n = len(ids)
        target = hit2 * _FULL
        self.pa[self.ka] = self.a + (target - self.a >> 4)
        self.pb[self.kb] = self.b + (target - self.b >> 4)
        self.pd[self.kb] = self.d + (hit1 * _FULL - self.d >> 4) * (self.differ > hit2)
        gap = self.a - self.b >> 4
        w = self.w[:n] + np.where(hit2, gap, -gap)
        self.w[:n] = np.minimum(np.maximum(w, 1024, out=w), ONE - 1024, out=w)
        entry = ids << 2
        self.t1[self.i1] = entry + np.minimum(self.n1 + 1, 3) * (self.s1 == ids)
        self.t2[self.i2] = entry + np.minimum(self.n2 + 1, 3) * hit2
        self.prev2[:n] = self.prev1[:n]
        self.prev1[:n] = ids

    def starts(self, n: int, c: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where class c starts and ends in order 0's shares of the first n lanes."""
        at, flat = self.by8[:n] + c, self.cdf.reshape(-1)
        return rest * (flat[at - 1] * (c > 0)) >> BITS_C, rest * flat[at] >> BITS_C

    def learn_class(self, n: int, c: np.ndarray, miss: np.ndarray) -> None:
        rows = self.cdf[:n]
        change = self.towards.take(c).view(np.int16).reshape(n, CLASSES)
        change -= rows
        change >>= 5
        change &= _MASKS.take(miss).view(np.int16).reshape(n, CLASSES)
        rows += change


#: No bits or all of a row of classes.
_MASKS = np.repeat(np.array([0, -1], np.int16), CLASSES).view(np.complex128)
_H1, _H2, _SHIFT, _FULL = np.uint32(2654435761), np.uint32(2246822519), np.uint32(32 - (ENTRIES.bit_length() - 1)), np.int32(ONE - 1)
#: Ranges are kept above 2^40 and below 2^56; `low` has a carry above them, which stays in the digit put out.
_TOTAL, _TOP, _STEP = _U(BITS + BITS0), _U(40), _U(16)
_LOWEST = _U(1 << 40)
_MASK = _U((1 << 40) - 1)


class _Encoder:
    """Range coders in 64 bits, one a lane, each putting out 16-bit digits, whose carries are settled at the end."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 56) - 1, _U)
        self.lanes_out: list[np.ndarray] = []
        self.digits_out: list[np.ndarray] = []

    def code(self, n: int, start: np.ndarray, width: np.ndarray) -> None:
        """Of 2^(BITS + BITS0), for the first n lanes."""
        rng = self.range[:n] >> _TOTAL
        low = self.low[:n]
        low += rng * start.view(_U)
        np.multiply(rng, width.view(_U), out=self.range[:n])
        due = np.flatnonzero(self.range[:n] < _LOWEST)
        while len(due):
            low, rng = self.low[due], self.range[due] << _STEP
            self.lanes_out.append(due.astype(np.int32))
            self.digits_out.append((low >> _TOP).astype(np.int32))
            self.low[due], self.range[due] = (low & _MASK) << _STEP, rng
            due = due[rng < _LOWEST]

    def finish(self) -> list[bytes]:
        n = len(self.low)
        every = np.arange(n, dtype=np.int32)
        # the least multiple of 2^40 in the range, and what the decoder reads behind it
        for digit in ((self.low + _MASK >> _TOP).astype(np.int32), *([np.zeros(n, np.int32)] * 3)):
            self.lanes_out.append(every), self.digits_out.append(digit)
        lanes, digits = np.concatenate(self.lanes_out), np.concatenate(self.digits_out)
        digits = digits[np.argsort(lanes, kind="stable")]
        over = np.flatnonzero(digits >> 16)
        while len(over):  # a block's first digit has no carry, as its code is below 1
            digits[over] &= 0xFFFF
            digits[over - 1] += 1
            over = over[digits[over - 1] >> 16 > 0] - 1
        data, ends = digits.astype(">u2").tobytes(), np.cumsum(np.bincount(lanes, minlength=n)) * 2
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        data = np.frombuffer(b"".join(payloads) + b"\0" * 8, np.uint8).astype(np.uint16)
        self.words = (data[:-1] << 8 | data[1:]).astype(_U)  # two bytes from any byte on
        lengths = np.array([len(p) for p in payloads])
        at = np.cumsum(lengths) - lengths
        #: The code less the coder's low, and where its next two bytes are.
        self.gap = (self.words[at] << _U(40)) | (self.words[at + 2] << _U(24)) | (self.words[at + 4] << _U(8)) | (self.words[at + 6] >> _U(8))
        self.range, self.at = np.full(len(payloads), (1 << 56) - 1, _U), at + 7

    def take(self, n: int, start: np.ndarray, width: np.ndarray, unit: np.ndarray) -> None:
        gap, rng = self.gap[:n], self.range[:n]
        gap -= unit * start.view(_U)
        np.multiply(unit, width.view(_U), out=rng)
        np.maximum(rng, 1, out=rng)  # less only where damaged
        due = np.flatnonzero(rng < _LOWEST)
        while len(due):
            at, new = self.at[due], self.range[due] << _STEP
            self.gap[due] = self.gap[due] << _STEP | self.words[np.minimum(at, len(self.words) - 1)]  # past the end only where damaged
            self.range[due], self.at[due] = new, at + 2
            due = due[new < _LOWEST]


def _lengths(n: int) -> list[int]:
    return [BLOCK] * (n // BLOCK) + ([n % BLOCK] if n % BLOCK else [])


def encode(ids: np.ndarray) -> dict:
    """Ids (at least one, each below 2^28) as blocks: frequencies, payloads and checksums. The checksum of a block is the crc32 of its ids."""
    ids = ids.astype(np.int32)
    which, freq = frequencies(ids)
    place = np.cumsum(freq) - freq
    classes = int(freq.sum()) >> BITS0
    top = int(which.max()) + 1
    #: Class, start and frequency (less 1) of each id in one number.
    known = np.zeros(top, np.int64)
    known[which] = place >> BITS0 << 2 * BITS0 | (place & LOW0) << BITS0 | freq - 1
    payloads: list[bytes] = []
    sizes = _lengths(len(ids))
    for first in range(0, len(sizes), LANES):
        lanes = sizes[first : first + LANES]
        n = len(lanes)
        own = ids[first * BLOCK : first * BLOCK + sum(lanes)]
        grid = np.zeros(n * BLOCK, np.int32)
        grid[: len(own)] = own
        grid = np.ascontiguousarray(grid.reshape(n, BLOCK).T)
        model, coder = _Model(n, classes), _Encoder(n)
        for t in range(max(lanes)):
            live = n if t < lanes[-1] else n - 1  # only a last block can be shorter
            sym = grid[t, :live]
            s2, s1, end2, end1 = model.predict(live)
            hit2 = s2 == sym
            hit1 = (s1 == sym) & ~hit2
            miss = ~(hit2 | hit1)
            own = known[sym]
            c = own >> 2 * BITS0
            lo, hi = model.starts(live, c, ONE - end1)
            model.learn_class(live, c, miss)
            begin = np.where(hit2, 0, end2)
            begin = np.where(miss, end1 + lo, begin).astype(np.int64)
            each = np.where(miss, end1 + hi, np.where(hit2, end2, end1)) - begin
            start = (begin << BITS0) + each * ((own >> BITS0 & LOW0) * miss)
            width = each * np.where(miss, (own & LOW0) + 1, 1 << BITS0)
            coder.code(live, start, width)
            model.learn(sym, hit2, hit1)
        payloads += coder.finish()
    data, ends = ids.astype("<u4").tobytes(), np.cumsum([0, *sizes]) * 4
    return {"ids": which, "freqs": freq, "payloads": payloads, "crcs": [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], "n_ids": len(ids)}


def decode(which: np.ndarray, freq: np.ndarray, payloads: list[bytes], crcs: list[int], n_ids: int) -> np.ndarray:
    """The ids of consecutive blocks; ValueError if a block does not match its checksum."""
    place = np.cumsum(freq) - freq
    known = (place & LOW0) << BITS0 | freq - 1
    classes = int(freq.sum()) >> BITS0
    slot = np.repeat(np.arange(len(which), dtype=np.int32), freq)
    sizes, out = _lengths(n_ids), []
    for first in range(0, len(sizes), LANES):
        lanes = sizes[first : first + LANES]
        n = len(lanes)
        grid = np.zeros((BLOCK, n), np.int32)
        model, coder = _Model(n, classes), _Decoder(payloads[first : first + n])
        for t in range(max(lanes)):
            live = n if t < lanes[-1] else n - 1
            s2, s1, end2, end1 = model.predict(live)
            gap, unit = coder.gap[:live], coder.range[:live] >> _TOTAL
            whole = unit << _U(BITS0)
            hit2 = gap < whole * end2.astype(_U)
            miss = gap >= whole * end1.astype(_U)
            # the last class whose start is not above the value, and the value in it
            rest = ONE - end1
            value = np.minimum(gap // whole, _U(ONE - 1)).astype(np.int32) - end1
            upto = (((np.maximum(value, 0) + 1 << BITS_C) - 1) // rest).astype(np.int16)
            c = np.bitwise_count((model.cdf[:live] <= np.repeat(upto, CLASSES).reshape(live, CLASSES)).view(np.uint64)[:, 0])
            c = np.minimum(c, classes - 1).astype(np.int64)  # past the end only where damaged
            lo, hi = model.starts(live, c, rest)
            begin = np.where(hit2, 0, end2)
            begin = np.where(miss, end1 + lo, begin).astype(np.int64)
            each = np.where(miss, end1 + hi, np.where(hit2, end2, end1)) - begin
            start = begin << BITS0
            inside = (gap - unit * start.view(_U)) // (unit * each.view(_U))
            at = slot[(c << BITS0) + np.minimum(inside, _U(LOW0)).astype(np.int64)]
            own = known[at]
            start += each * ((own >> BITS0) * miss)
            width = each * np.where(miss, (own & LOW0) + 1, 1 << BITS0)
            sym = np.where(miss, which[at], np.where(hit2, s2, s1)).astype(np.int32)
            hit1 = ~(hit2 | miss)
            model.learn_class(live, c, miss)
            coder.take(live, start, width, unit)
            model.learn(sym, hit2, hit1)
            grid[t, :live] = sym
        out.append(np.ascontiguousarray(grid.T).reshape(-1)[: sum(lanes)])
    ids = np.concatenate(out)
    data, ends = ids.astype("<u4").tobytes(), np.cumsum([0, *sizes]) * 4
    for k, crc in enumerate(crcs):
        if zlib.crc32(data[ends[k] : ends[k + 1]]) != crc:
            raise ValueError(f"block {k} does not match its checksum")
    return ids
