"""Token ids in compressed, checksummed, independently decodable blocks.

Block payload: an adaptive range coder driven by order-0 to order-2 predictions, all reset at the block's start. A block's
ids are dealt to lanes of STEPS consecutive ids each; step t codes the t-th id of every lane under one shared model and
then updates the model with all of them, so that encoder and decoder run as vector operations and still adapt within the
block. The alphabet is the block's own: the ids that occur in it, listed in the header.

Model: the order-2 context (two preceding ids, hashed) predicts one id, with a confidence; the order-1 context (the
preceding id) holds a distribution over up to SLOTS successors, order 0 one over all ids of the alphabet, both by their
frequencies so far. The three are mixed: P = w2 P2 + w1 P1 + w0 P0, where the weights are learnt for each state (confidence
of order 2, evidence of order 1) from how often each order was the highest that knew what came. An id is coded within the
highest order that holds it, so decoding needs no search but order 0's. Tables of intervals are made anew every few steps
from counts that are kept all the time. All that decides intervals is integers or IEEE sums, products and quotients in a
fixed order, so the decoder repeats it exactly.

Coder: 64-bit low and span, 32-bit words out. A span below 2**32 gives out a word; if the word isn't settled yet, the span
is cut at the next border first, so no carry ever runs back.

A block is its header, the document table, the alphabet, the payload, and the crc32 of all that: magic "TMB2", u32
documents, u64 first start, u64 ids, u32 vocabulary, u32 bytes of the document table, u32 bytes of the alphabet, u32 words;
document table (zlib: i64 ids as differences, i64 lengths); alphabet (zlib: one bit an id); u32 words of each lane; u32
words, lane by lane; u32 crc32. Everything is little-endian. A null doc id is kept as the least i64.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TMB2"
HEAD = struct.Struct("<4sIQQIIII")
NULL_ID = np.iinfo(np.int64).min
STEPS = 1024
#: Order-1 successors of an id (the code below packs eight flags into a 64-bit word), and the total at which counts are halved.
SLOTS, HALVE = 8, 1020
BITS = 26
#: Scales of the intervals of orders 0 and 1 within their shares; a share is never so small that an id gets nothing.
ORDER0_BITS, ORDER1_BITS = 20, 14
LEAST2, LEAST1, LEAST0 = 1 << 12, 1 << ORDER1_BITS, 1 << ORDER0_BITS
CONTEXT2_BITS = 16
SURE = 8
U = np.uint64
WORD = U(1 << 32)
#: Products with a word of byte flags: their number in the top byte, and one more than the place of a single one.
NUMBER = U(0x0101010101010101)
PLACE = U(sum((k + 1) << 8 * (7 - k) for k in range(8)))


def _flags(x: np.ndarray) -> np.ndarray:
    """Rows of eight booleans as words."""
    return x.view(np.uint64).ravel()


class Model:
    """The shared adaptive state of a block over an alphabet of ``n`` ids."""

    def __init__(self, n: int):
        if n > 1 << ORDER0_BITS - 1:
            raise ValueError(f"a block holds at most {1 << ORDER0_BITS - 1} different ids, not {n}")
        self.n, self.t = n, 0
        #: Of each id: eight successors, the upper borders of their intervals, and their counts.
        self.next1 = np.full((n, SLOTS), -1, np.int32)
        self.border1 = np.zeros((n, SLOTS), np.int32)
        self.count1 = np.zeros((n, SLOTS), np.int64)
        self.next2 = np.full(1 << CONTEXT2_BITS, -SURE, np.int32)  # id * SURE + confidence
        self.mix = np.tile([1.0, 1.0, 2.0], (SURE * SURE, 1))
        self.seen = np.zeros(n, np.int64)
        #: What came since the tables were made: ids, states and orders, successors.
        self.late: tuple[list, list, list] = ([], [], [])
        #: Order-1 tables cost n rows, a step costs its lanes.
        self.every = max(16, n >> 8)
        self.refresh()

    def refresh(self) -> None:
        """Intervals from counts."""
        if self.late[0]:
            ids, kinds, hits = (np.concatenate(x) for x in self.late)
            self.seen += np.bincount(ids, minlength=self.n)
            self.mix += np.bincount(kinds, minlength=self.mix.size).reshape(self.mix.shape)
            self.count1 += np.bincount(hits, minlength=self.count1.size).reshape(self.count1.shape)
            self.late = ([], [], [])
        self.count1[self.count1.sum(axis=1) >= HALVE] >>= 1
        upto = np.cumsum(self.count1, axis=1, dtype=np.float64)
        scale = ((1 << ORDER1_BITS) - SLOTS) / np.maximum(upto[:, -1:], 1.0)
        self.border1[:] = (upto * scale).astype(np.int32) + np.arange(1, SLOTS + 1, dtype=np.int32)
        self.evidence = SURE * np.minimum(np.frexp(upto[:, -1])[1], SURE - 1).astype(np.int32)
        part = self.mix / self.mix.sum(axis=1, keepdims=True)
        room = (1 << BITS) - LEAST2 - LEAST1 - LEAST0
        self.share2 = (part[:, 0] * room).astype(np.int64) + LEAST2
        self.share1 = (part[:, 1] * room).astype(np.int64) + LEAST1
        total = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.seen, out=total[1:])
        free = (1 << ORDER0_BITS) - self.n
        self.cum = total * free // max(1, int(total[-1])) + np.arange(self.n + 1)
        self.cum[-1] = 1 << ORDER0_BITS
        self.near = None

    def predict(self, back1: np.ndarray, back2: np.ndarray) -> None:
        self.back1 = back1
        self.at2 = ((back2.astype(np.uint32) * np.uint32(0x9E3779B1) + back1.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - CONTEXT2_BITS)).astype(np.int64)
        self.packed2 = self.next2[self.at2]
        self.p2, self.sure = self.packed2 >> 3, self.packed2 & 7
        self.state = self.evidence[back1] + self.sure
        self.w2, self.w1 = self.share2[self.state], self.share1[self.state]

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of ids within the interval."""
        x4 = x.astype(np.int32)
        self.hit2 = self.p2 == x4
        place = _flags(self.next1.take(self.back1, axis=0) == x4[:, None]) * PLACE >> U(56)
        place[self.hit2] = 0
        self.at1 = np.nonzero(place)[0]
        self.slot1 = self.back1[self.at1] * SLOTS + place[self.at1].view(np.int64) - 1
        self.at0 = np.nonzero((place == 0) > self.hit2)[0]
        return self._intervals(x)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of the intervals that hold the values."""
        x = self.p2.astype(np.int64)
        self.hit2 = value < self.w2
        past = value - self.w2
        above = past >= self.w1
        self.at1, self.at0 = np.nonzero(~(above | self.hit2))[0], np.nonzero(above)[0]
        c = self.back1[self.at1]
        # Quotients of numbers this small are exact in doubles but for their fractions.
        want = (((past[self.at1] + 1 << ORDER1_BITS) - 1) / self.w1[self.at1]).astype(np.int32)
        slot = _flags(self.border1.take(c, axis=0) <= want[:, None]) * NUMBER >> U(56)
        self.slot1 = c * SLOTS + np.minimum(slot, U(SLOTS - 1)).view(np.int64)
        x[self.at1] = self.next1.reshape(-1)[self.slot1]
        if len(self.at0):
            rest = (1 << BITS) - self.w2[self.at0] - self.w1[self.at0]
            want = (((past[self.at0] - self.w1[self.at0] + 1 << ORDER0_BITS) - 1) / rest).astype(np.int64)
            if self.near is None:  # of every 32nd place, the id before
                self.near = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(-(-self.cum >> 5)))
            y = self.near[want >> 5].astype(np.int64)
            late = np.nonzero(self.cum[y + 1] <= want)[0]
            while len(late):
                y[late] += 1
                late = late[self.cum[y[late] + 1] <= want[late]]
            x[self.at0] = y
        return x, *self._intervals(x)

    def _intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, size = np.zeros(len(x), np.int64), self.w2.copy()
        if len(self.at1):
            border, w = self.border1.reshape(-1), self.w1[self.at1]
            low = w * (border[self.slot1 - 1] * (self.slot1 & SLOTS - 1 > 0)) >> ORDER1_BITS
            start[self.at1] = self.w2[self.at1] + low
            size[self.at1] = (w * border[self.slot1] >> ORDER1_BITS) - low
        if len(self.at0):
            known = self.w2[self.at0] + self.w1[self.at0]
            rest, y = (1 << BITS) - known, x[self.at0]
            low = self.cum[y] * rest >> ORDER0_BITS
            start[self.at0] = known + low
            size[self.at0] = (self.cum[y + 1] * rest >> ORDER0_BITS) - low
        return start, size

    def update(self, x: np.ndarray) -> None:
        """After locate(x), or find() of x. What a higher order coded isn't counted in lower ones, but in order 0."""
        kind = self.state * 3
        kind[self.at1] += 1
        kind[self.at0] += 2
        for late, new in zip(self.late, (x, kind, self.slot1), strict=True):
            late.append(new)
        down = np.where(self.sure > 0, self.packed2 - (self.sure + 1 >> 1), x.astype(np.int32) << 3)
        self.next2[self.at2] = np.where(self.hit2, self.packed2 + (self.sure < SURE - 1), down)
        if len(self.at0):
            count1 = self.count1.reshape(-1)
            at = self.back1[self.at0] * SLOTS + self.t % SLOTS
            old = count1[at]
            gone = np.nonzero(old <= 2)[0]  # a slot that is seldom right gives way, another one loses weight
            count1[at] = np.maximum(1, old - (old >> 2))
            at = at[gone]
            self.next1.reshape(-1)[at] = x[self.at0[gone]]
        self.t = t = self.t + 1
        if t % self.every == 0 or t & (t - 1) == 0:
            self.refresh()


def _settle(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes that give out or take in a word now; an unsettled one's span is cut at the next border."""
    go = np.nonzero(span < WORD)[0]
    lo, sp = low[go], span[go]
    split = ((lo ^ (lo + sp - U(1))) >> U(32)) != 0
    span[go] = np.where(split, WORD - (lo & (WORD - U(1))), sp)
    return go


def _live(n: int, lanes: int, t: int) -> int:
    """Lanes that have a t-th id: all, or all but the last."""
    return lanes if t < n - (lanes - 1) * STEPS else lanes - 1


def encode_ids(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each lane, words) of ids below ``alphabet``."""
    n = len(ids)
    lanes = -(-n // STEPS)
    if not lanes:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    grid = np.zeros(lanes * STEPS, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, STEPS).T)
    model = Model(alphabet)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~U(0), np.uint64)
    back1 = back2 = np.zeros(lanes, np.int64)
    out_lane, out_word = [], []
    for t in range(STEPS):
        live = _live(n, lanes, t)
        if not live:
            break
        x = grid[t, :live]
        model.predict(back1[:live], back2[:live])
        start, size = model.locate(x)
        lo, sp = low[:live], span[:live]
        unit = sp >> U(BITS)
        lo += unit * start.view(np.uint64)
        np.multiply(unit, size.view(np.uint64), out=sp)
        go = _settle(lo, sp)
        if len(go):
            out_lane.append(go)
            out_word.append((lo[go] >> U(32)).astype(np.uint32))
            lo[go] <<= U(32)
            sp[go] <<= U(32)
        model.update(x)
        back2, back1 = back1[:live], x
    out_lane.append(np.arange(lanes))
    out_word.append(((low + (WORD - U(1))) >> U(32)).astype(np.uint32))  # a span holds a multiple of WORD
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane.astype(np.uint16) if lanes <= 1 << 16 else lane, kind="stable")
    return np.bincount(lane, minlength=lanes).astype(np.uint32), word[order]


def decode_ids(n: int, sizes: np.ndarray, words: np.ndarray, alphabet: int) -> np.ndarray:
    lanes = len(sizes)
    if not lanes:
        return np.zeros(0, np.int64)
    grid = np.zeros((STEPS, lanes), np.int64)
    model = Model(alphabet)
    ends = np.cumsum(sizes.astype(np.int64))
    at = ends - sizes
    words = np.append(words.astype(np.uint64), U(0))
    end = len(words) - 1

    def take(lane) -> np.ndarray:
        """The next word of lanes, 0 beyond their last."""
        out = words[np.where(at[lane] < ends[lane], at[lane], end)]
        at[lane] += 1
        return out

    every = np.arange(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~U(0), np.uint64)
    code = take(every) << U(32)
    code |= take(every)
    back1 = back2 = np.zeros(lanes, np.int64)
    for t in range(STEPS):
        live = _live(n, lanes, t)
        if not live:
            break
        model.predict(back1[:live], back2[:live])
        lo, sp, co = low[:live], span[:live], code[:live]
        unit = sp >> U(BITS)
        value = np.minimum((co - lo) // unit, U((1 << BITS) - 1)).astype(np.int64)
        x, start, size = model.find(value)
        lo += unit * start.view(np.uint64)
        np.multiply(unit, size.view(np.uint64), out=sp)
        go = _settle(lo, sp)
        if len(go):
            co[go] = co[go] << U(32) | take(go)
            lo[go] <<= U(32)
            sp[go] <<= U(32)
        grid[t, :live] = x
        model.update(x)
        back2, back1 = back1[:live], x
    return grid.T.ravel()[:n]


def pack_block(doc_ids: list[int | None], parts: list[np.ndarray], first: int, vocabulary: int) -> bytes:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    used = np.zeros(vocabulary, bool)
    used[ids] = True
    place = np.cumsum(used) - 1
    sizes, words = encode_ids(place[ids], int(used.sum()))
    docs = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    with np.errstate(over="ignore"):
        steps = np.diff(docs, prepend=docs.dtype.type(0))
    table = zlib.compress(steps.astype("<i8").tobytes() + np.array([len(p) for p in parts], "<i8").tobytes())
    alphabet = zlib.compress(np.packbits(used).tobytes())
    head = HEAD.pack(MAGIC, len(parts), first, len(ids), vocabulary, len(table), len(alphabet), len(words))
    body = b"".join((head, table, alphabet, sizes.astype("<u4").tobytes(), words.astype("<u4").tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(block: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, doc ids, lengths, ids); ValueError if the checksum or the magic is wrong."""
    if len(block) < HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block checksum mismatch")
    magic, n_docs, first, n, vocabulary, n_table, n_alphabet, n_words = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEAD.size
    table = np.frombuffer(zlib.decompress(block[at : at + n_table]), "<i8")
    at += n_table
    used = np.nonzero(np.unpackbits(np.frombuffer(zlib.decompress(block[at : at + n_alphabet]), np.uint8), count=vocabulary))[0]
    at += n_alphabet
    sizes = np.frombuffer(block, "<u4", -(-n // STEPS), at)
    words = np.frombuffer(block, "<u4", n_words, at + sizes.nbytes)
    ids = decode_ids(n, sizes, words, len(used))
    return first, np.cumsum(table[:n_docs]), table[n_docs:], used[ids] if n else ids
