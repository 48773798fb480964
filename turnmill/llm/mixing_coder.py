"""Blocks of ids, coded with an adaptive context-mixing model and a range coder.

A block is `BLOCK` ids at most and starts from an empty model, so it can be read by itself. Its ids are numbered by first appearance (slots). For the next slot there are three
predictions: that which followed the last two slots, that which followed the last slot (each a single slot with a confidence of 1 to 3), and the frequencies of the block so far. They are mixed:
a set of weights, chosen by both confidences and by whether the two agree, gives the share of the range that goes to the first prediction, to the second, and to the
frequencies; after each id the weights move towards what was right. Frequencies are taken over at fixed places of the block (`REFRESH`). A slot that they don't hold yet is an escape:
a slot that came since the last of these places, or the next new one, whose id stands before the block's words.

The coder has 64 bits of range and writes words of 32; carries go back into written words. All arithmetic is on integers, so a block reads the same everywhere.

All blocks of a call go through the model in step, a place at a time: an array operation works on one id of each block.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 2048
#: Blocks that go in step; the model takes some 50 KB of memory for each.
LANES = 4096
SCALE_BITS = 12
SCALE = 1 << SCALE_BITS
#: Places after which frequencies are taken over.
REFRESH = (24, 88, 216, 472, 984)
CONTEXTS = 2048
RATE = 5
#: Of 65,536. A little less than 1 in 2 ** RATE, so that both weights together leave the frequencies a share.
RISE = 2000
#: Of two 16-bit numbers in one of 32 that is shifted by RATE, the bits that belong to each.
KEEP = np.uint32((0xFFFF >> RATE) << 16 | 0xFFFF >> RATE)
WORD = 1 << 32
#: Before a block's words: the number of its different ids, the bytes of one, and these ids by first appearance.
HEAD = struct.Struct("<HB")
U = np.uint64
# What becomes of a prediction's confidence (0: none yet): after a miss 0 and 1 give way, 2 and 3 sink; after a hit all but 3 rise.
STEP = np.array([0, 0, -1, -1, 1, 1, 1, 0], np.int16).view(np.uint16)
FOUR = np.uint16(4)


class _Coder:
    """The range of each block. bounded() narrows it to a part; lanes are indices or a slice."""

    def __init__(self, n: int):
        self.range = np.full(n, (1 << 64) - 1, U)


class _Writer(_Coder):
    def __init__(self, n: int):
        super().__init__(n)
        self.low = np.zeros(n, U)
        self.words = np.zeros((n, 1024), np.uint32)
        self.used = np.zeros(n, np.int64)

    def move(self, lanes, by: np.ndarray) -> None:
        """low += by, with the carry."""
        new = self.low[lanes] + by
        over = (new < by).nonzero()[0]
        self.low[lanes] = new
        if len(over):
            self.carry(over if isinstance(lanes, slice) else lanes[over])

    def carry(self, lanes: np.ndarray) -> None:
        at = self.used[lanes] - 1
        while len(lanes):
            self.words[lanes, at] += np.uint32(1)
            more = self.words[lanes, at] == 0
            lanes, at = lanes[more], at[more] - 1

    def refill(self, lanes: np.ndarray) -> None:
        if len(lanes):
            used = self.used[lanes]
            if used.max() >= self.words.shape[1] - 2:
                self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            self.words[lanes, used] = self.low[lanes] >> U(32)
            self.low[lanes] <<= U(32)
            self.range[lanes] <<= U(32)
            self.used[lanes] = used + 1

    def uniform(self, lanes: np.ndarray, n: np.ndarray, value: np.ndarray) -> None:
        r = self.range[lanes] // n
        self.move(lanes, r * value)
        self.range[lanes] = r
        self.refill(lanes[r < WORD])

    def ended(self) -> list[bytes]:
        """The least value of each block's range that ends in 32 zero bits; zero words at the end are left out."""
        new = (self.low + U(WORD - 1)) & ~U(WORD - 1)
        over = np.flatnonzero(new < self.low)
        if len(over):
            self.carry(over)
        self.words[np.arange(len(new)), self.used] = new >> U(32)
        out = []
        for k in range(len(new)):
            w = self.words[k, : self.used[k] + 1]
            used = np.flatnonzero(w)
            out.append(w[: used[-1] + 1 if len(used) else 0].astype("<u4").tobytes())
        return out


class _Reader(_Coder):
    def __init__(self, payloads: list[bytes]):
        super().__init__(len(payloads))
        most = max(len(p) // 4 for p in payloads) + 3  # zero words follow
        self.words = np.zeros((len(payloads), most), np.uint32)
        for k, p in enumerate(payloads):
            self.words[k, : len(p) // 4] = np.frombuffer(p, "<u4")
        self.code = (self.words[:, 0].astype(U) << U(32)) | self.words[:, 1]
        self.used = np.full(len(payloads), 2, np.int64)

    def refill(self, lanes: np.ndarray) -> None:
        if len(lanes):
            used = np.minimum(self.used[lanes], self.words.shape[1] - 1)
            self.code[lanes] = (self.code[lanes] << U(32)) | self.words[lanes, used]
            self.range[lanes] <<= U(32)
            self.used[lanes] = used + 1

    def uniform(self, lanes: np.ndarray, n: np.ndarray) -> np.ndarray:
        r = self.range[lanes] // n
        value = self.code[lanes] // r
        self.code[lanes] -= value * r
        self.range[lanes] = r
        self.refill(lanes[r < WORD])
        return value


class _Model:
    """The predictions of n blocks. Pairs of numbers that are read together lie in one: a slot over its confidence, both weights, a slot's share of the scale over what lies below it."""

    def __init__(self, n: int, longest: int):
        self.n, self.slots = n, longest + 1  # slot 0: escape
        lanes = np.arange(n)
        self.base1, self.base2, self.base_w, self.base_l = lanes * self.slots, lanes * CONTEXTS, lanes * 32, lanes * SCALE
        self.after1, self.after2 = np.zeros(n * self.slots, np.uint16), np.zeros(n * CONTEXTS, np.uint16)
        first = np.full((4, 4, 2), 8192 << 16 | 4096, np.uint32)  # by both confidences and whether both agree; least where there is no prediction
        first[0] = first[0] & 0xFFFF | 31 << 16
        first[:, 0] = first[:, 0] & 0xFFFF0000 | 31
        self.weights = np.tile(first.ravel(), n)
        self.last, self.mixed = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.counts = np.zeros((n, self.slots), np.int32)
        self.share = np.zeros(n * self.slots, np.uint32)
        self.share.reshape(n, -1)[:, 0] = SCALE << 16
        self.known = np.ones(n, np.int64)  # slots that the frequencies hold, the escape being one
        self.seen = np.ones(n, np.int64)  # all slots so far
        self.escapes = np.zeros(n, np.int64)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The shares of the second order's and of the first order's prediction, of 65,536."""
        self.at1 = self.base1[:n] + self.last[:n]
        self.at2 = self.base2[:n] + self.mixed[:n]
        self.e1, self.e2 = self.after1[self.at1], self.after2[self.at2]
        self.k1, self.k2, self.c1, self.c2 = self.e1 & 3, self.e2 & 3, self.e1 >> 2, self.e2 >> 2
        kind = (self.k2 << 3) + (self.k1 << 1)
        kind += self.c1 == self.c2
        self.at_w = self.base_w[:n] + kind
        self.w = self.weights[self.at_w]
        return (self.w >> 16).astype(U), (self.w & 0xFFFF).astype(U)

    def learn(self, n: int, slot: np.ndarray, small: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """slot, and as a small number. hit2, hit1: lanes that took the predictions."""
        w = self.w - ((self.w >> RATE) & KEEP)  # both halves at once
        w[hit2] += RISE << 16
        w[hit1] += RISE
        self.weights[self.at_w] = w
        fresh = (small << 2) | 1
        for table, at, e, k, c in ((self.after1, self.at1, self.e1, self.k1, self.c1), (self.after2, self.at2, self.e2, self.k2, self.c2)):
            k += (c == small).view(np.uint8) * FOUR
            e += STEP[k]
            np.copyto(e, fresh, where=k < 2)
            table[at] = e
        self.mixed[:n] = ((self.last[:n] << 5) ^ slot) & (CONTEXTS - 1)
        self.last[:n] = slot

    def refresh(self, slots: np.ndarray, lookup: bool) -> np.ndarray | None:
        """Take over frequencies: slots (lanes, places) since the last time. With lookup, the slot for each place of the scale."""
        n, places = slots.shape
        wide = int(self.seen.max())
        counts = self.counts[:, :wide]
        counts[:n] += np.bincount(((np.arange(n) * wide)[:, None] + slots).ravel(), minlength=n * wide).reshape(n, -1).astype(np.int32)
        total = counts.sum(axis=1) + 1
        escape = 1 + self.escapes * total // (2 * places)
        scale = (SCALE - self.seen) / (total + escape)  # doubles divide and multiply alike everywhere
        share = (counts * scale[:, None]).astype(np.int64) + (counts > 0)
        share[:, 0] = SCALE - share[:, 1:].sum(axis=1)
        self.share.reshape(self.n, -1)[:, :wide] = (share << 16) | (np.cumsum(share, axis=1) - share)
        self.known, self.escapes = self.seen.copy(), np.zeros(self.n, np.int64)
        if lookup:
            return np.repeat(np.tile(np.arange(wide, dtype=np.uint16), self.n), share.ravel())
        return None


def _slots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's slot in its row, from 1 by first appearance, and whether it is new there."""
    if ids.size and ids.max() > 1 << 20:
        ids = np.unique(ids, return_inverse=True)[1].reshape(ids.shape)
    place = np.arange(ids.shape[1])
    first_at = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    slots, new = np.empty(ids.shape, np.uint16), np.empty(ids.shape, bool)
    for row, slot, is_new in zip(ids, slots, new, strict=True):
        first_at[row[::-1]] = place[::-1]  # the last to be put is the first in the row
        at = first_at[row]
        np.equal(at, place, out=is_new)
        slot[:] = np.cumsum(is_new)[at]
    return slots, new


def _lengths(sizes: np.ndarray) -> list[int]:
    """For each place, how many blocks reach it; sizes fall."""
    return (len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), side="right")).tolist()


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    sizes = np.array([len(b) for b in blocks])
    longest = int(sizes[0])
    ids = np.zeros((len(blocks), longest), blocks[0].dtype)
    for k, b in enumerate(blocks):
        ids[k, : len(b)] = b
        ids[k, len(b) :] = b[-1]  # never coded
    slots, new = _slots(ids)
    model, coder = _Model(len(blocks), longest), _Writer(len(blocks))
    wide_ids = ids.dtype.itemsize > 2 and ids.max() > 0xFFFF
    listed_ids = [row[is_new].astype("<u4" if wide_ids else "<u2") for row, is_new in zip(ids, new, strict=True)]
    heads = [HEAD.pack(len(x), x.itemsize) + x.tobytes() for x in listed_ids]
    slots_t, new_t, since = np.ascontiguousarray(slots.T), np.ascontiguousarray(new.T), 0
    del slots, new, ids
    for t, n in enumerate(_lengths(sizes)):
        if t in REFRESH:
            model.refresh(slots_t[since:t, :n].T, False)
            since = t
        small = slots_t[t, :n]
        slot = small.astype(np.int64)
        f2, f1 = model.predict(n)
        r = coder.range[:n] >> U(16)
        two = r * f2
        one = r * f1
        one += two
        hit = ((model.c2 == small) | (model.c1 == small)).nonzero()[0]
        known = slot < model.known[:n]
        share = model.share[model.base1[:n] + slot * known]
        part = (coder.range[:n] - one) >> U(SCALE_BITS)
        by = part * (share & 0xFFFF)
        by += one
        size = part * (share >> 16)
        first = model.c2[hit] == small[hit]
        by[hit], size[hit] = np.where(first, U(0), two[hit]), np.where(first, two[hit], one[hit] - two[hit])
        coder.range[:n] = size
        coder.move(slice(0, n), by)
        coder.refill((size < WORD).nonzero()[0])
        known[hit] = True
        out = (~known).nonzero()[0]
        if len(out):
            recent = model.seen[out] - model.known[out] + 1
            fresh = new_t[t, :n][out]
            coder.uniform(out, recent.astype(U), np.where(fresh, 0, slot[out] - model.known[out] + 1).astype(U))
            model.escapes[out] += 1
            model.seen[out[fresh]] += 1
        model.learn(n, slot, small, hit[first], hit[~first])
    return [h + p for h, p in zip(heads, coder.ended(), strict=True)]


def _decode(payloads: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    longest, lanes = int(sizes[0]), len(payloads)
    ids, words = np.zeros((lanes, longest + 1), np.uint32), []  # ids by slot
    for row, p in zip(ids, payloads, strict=True):
        n, width = HEAD.unpack_from(p)
        row[1 : n + 1] = np.frombuffer(p, f"<u{width}", n, HEAD.size)
        words.append(p[HEAD.size + n * width :])
    model, coder = _Model(lanes, longest), _Reader(words)
    slots_t, since = np.zeros((longest, lanes), np.uint16), 0
    lookup = np.zeros(lanes * SCALE, np.uint16)
    for t, n in enumerate(_lengths(sizes)):
        if t in REFRESH:
            lookup = model.refresh(slots_t[since:t, :n].T, True)
            since = t
        f2, f1 = model.predict(n)
        r = coder.range[:n] >> U(16)
        two = r * f2
        one = r * f1
        one += two
        code = coder.code[:n]
        hit = (code < one).nonzero()[0]
        part = (coder.range[:n] - one) >> U(SCALE_BITS)
        rest = code - one
        place = np.minimum(rest // part, U(SCALE - 1)).view(np.int64)
        place += model.base_l[:n]
        small = lookup[place]
        share = model.share[model.base1[:n] + small]
        rest -= part * (share & 0xFFFF)
        size = part * (share >> 16)
        first = code[hit] < two[hit]
        small[hit] = np.where(first, model.c2[hit], model.c1[hit])
        rest[hit], size[hit] = code[hit] - np.where(first, U(0), two[hit]), np.where(first, two[hit], one[hit] - two[hit])
        coder.range[:n], coder.code[:n] = size, rest
        coder.refill((size < WORD).nonzero()[0])
        out = (small == 0).nonzero()[0]
        if len(out):
            which = coder.uniform(out, (model.seen[out] - model.known[out] + 1).astype(U)).astype(np.int64)
            fresh = which == 0
            small[out] = np.where(fresh, model.seen[out], which - 1 + model.known[out])
            model.escapes[out] += 1
            model.seen[out[fresh]] += 1
        slots_t[t, :n] = small
        model.learn(n, small.astype(np.int64), small, hit[first], hit[~first])
    return [row[slots] for row, slots in zip(ids, np.ascontiguousarray(slots_t.T), strict=True)]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """A payload for each block of ids (unsigned, 1 to `BLOCK` ids of 32 bits at most)."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    out: list[bytes] = [b""] * len(blocks)
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        for k, p in zip(part, _encode([blocks[k] for k in part]), strict=True):
            out[k] = p
    return out


def decode(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block, as uint32."""
    order = sorted(range(len(payloads)), key=lambda k: -sizes[k])
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(payloads)
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        for k, ids in zip(part, _decode([payloads[k] for k in part], np.array([sizes[k] for k in part])), strict=True):
            out[k] = ids[: sizes[k]]
    return out
