"""An adaptive context-mixing range coder for token ids.

A block of up to 131,072 ids is coded on its own: its models start empty and its bytes carry a checksum. It is cut into up to 64
segments of equal length, each a range coder's stream with its own context, and all of them teach and use the block's one
model. Step t codes the t-th id of every segment of every block at hand, so numpy works on wide rows; what a block's bytes
are depends on nothing outside it.

Model. Three predictions are mixed for each id: the id seen last after the same two ids (order 2), the id seen last after
the same id (order 1), both hashed and each with a confidence that grows with hits and falls with misses, and order 0, the
counts of the block's ids so far. For each pair of confidences the block counts how often order 2 or else order 1 was right;
these counts are the mixing weights, their shares of the coder's range. Order 0 has the rest, a quarter at least. An id without a
count is coded as an escape, whose share follows the block's escapes, and then by its 16 low bits (in wide blocks also its
16 high bits) with equal shares. Models and weights learn at the end of an epoch, which is at first 8 steps long and later up to
128: at most a 16th of a full block. Encoder and decoder learn the same from the same ids.

Coder. A carrying range coder with a 48-bit range and 16-bit output; carries run through the output words at the end.

Format of a block, little-endian: b"SLT3", or b"SLT4" if wide; uint32 ids, uint32 segments, uint32 crc32 of the ids as uint32;
for each segment uint32 words; then the words as uint16.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_HEAD = struct.Struct("<4sIII")
NARROW, WIDE = b"SLT3", b"SLT4"
#: Ids of a block, segments of a block, least ids of a segment, ids that are coded at once.
BLOCK, SEGMENTS, LEAST_SEGMENT, AT_ONCE = 131_072, 64, 64, 32 * 131_072
#: Hash bits of the order-1 and order-2 tables, bits of order 0, bits of the coder's range that shares are given in.
ONE_BITS, TWO_BITS, ZERO_BITS, PART_BITS = 13, 15, 14, 17
ZERO, PARTS = 1 << ZERO_BITS, 1 << PART_BITS
FIRST_EPOCH, LAST_EPOCH, BATCH = 8, 128, 8
#: Hits in 64 that each confidence, 0 to 7, stands for before the block has counted its own.
_PRIOR = np.array([0, 3, 6, 10, 14, 18, 21, 24], np.float64)
_LOW, _LEAST = 0xFFFFFFFF, 1 << 32


def _epochs(length: int):
    at, size = 0, FIRST_EPOCH
    while at < length:
        yield at, min(length, at + size)
        at += size
        size = min(LAST_EPOCH, at)


def _cut(n: int) -> tuple[int, int]:
    """Segments of a block of n ids and their length; the last may be shorter."""
    segments = max(1, min(SEGMENTS, n // LEAST_SEGMENT))
    length = -(-n // segments)
    return -(-n // length), length


class _Lanes:
    """The segments of some blocks, the longest first; those of a block stay in order."""

    def __init__(self, sizes: list[int]):
        blocks, sizes_, firsts = [], [], []
        for block, n in enumerate(sizes):
            segments, length = _cut(n)
            for k in range(segments):
                blocks.append(block)
                firsts.append(k * length)
                sizes_.append(min(length, n - k * length))
        order = np.argsort(-np.array(sizes_), kind="stable")
        self.block, self.first, self.size = (np.array(x, np.int64)[order] for x in (blocks, firsts, sizes_))
        self.steps = int(self.size[0])
        self.live = np.searchsorted(-self.size, -np.arange(self.steps), side="left").tolist()  # lanes longer than t


class _Models:
    """The tables of all blocks, flat."""

    def __init__(self, lanes: _Lanes, blocks: int, wide: bool):
        self.lanes, self.blocks = lanes, blocks
        self.bits, self.kind = (32, np.int64) if wide else (16, np.int32)
        self.id = (1 << self.bits) - 1
        self.base1, self.base2 = lanes.block << ONE_BITS, lanes.block << TWO_BITS
        self.cells = lanes.block << 6
        # Guesses: confidence << bits (order 2: << bits + 3) | id.
        self.one, self.two = np.zeros(blocks << ONE_BITS, self.kind), np.zeros(blocks << TWO_BITS, self.kind)
        self.known = np.zeros(0, np.int64)  # block << 50 | id << 18 | count, in order
        two, one = np.divmod(np.arange(64), 8)
        self.seen = np.full((blocks, 64), 64.0)
        self.hits2 = np.tile(_PRIOR[two], (blocks, 1))
        self.hits1 = np.tile(_PRIOR[one] * (1 - _PRIOR[two] / 64), (blocks, 1))
        self.kinds, self.novel, self.plain = np.zeros(blocks, np.int64), np.ones(blocks), np.full(blocks, 2.0)
        self._mix()
        self._zero()

    def slots(self, a: np.ndarray, b: np.ndarray, live: int) -> tuple[np.ndarray, np.ndarray]:
        near = b * 40503
        return (near >> 4 & ((1 << ONE_BITS) - 1)) + self.base1[:live], (a * 2654435 + near >> 5 & ((1 << TWO_BITS) - 1)) + self.base2[:live]

    def learn(self, past: np.ndarray, at: int, to: int) -> None:
        """past: (2 + steps, lanes) ids below two rows of zeros; at, to: the epoch that has ended."""
        keys = []
        for lo in range(at, to, BATCH):
            hi = min(to, lo + BATCH)
            live, least = self.lanes.live[lo], self.lanes.live[hi - 1]
            some = past[lo : hi + 2, :live].astype(np.int64)
            ids, (i1, i2) = some[2:], self.slots(some[:-2], some[1:-1], live)
            block = np.broadcast_to(self.lanes.block[:live], ids.shape)
            cell = np.broadcast_to(self.cells[:live], ids.shape)
            if least < live:
                on = np.arange(lo, hi)[:, None] < self.lanes.size[:live]
                ids, i1, i2, block, cell = ids[on], i1[on], i2[on], block[on], cell[on]
            ids, i1, i2, block, cell = (x.ravel() for x in (ids, i1, i2, block, cell))
            one, two = self.one.take(i1), self.two.take(i2)
            cell = cell + (one >> self.bits) + (two >> self.bits)
            short = ids.astype(self.kind)
            hit2 = ((two & self.id) == short) & (two > self.id)
            hit1 = ((one & self.id) == short) & (one > self.id) & ~hit2
            flat = self.blocks << 6
            self.seen += np.bincount(cell, minlength=flat).reshape(-1, 64)
            self.hits2 += np.bincount(cell[hit2], minlength=flat).reshape(-1, 64)
            self.hits1 += np.bincount(cell[hit1], minlength=flat).reshape(-1, 64)
            self.plain += np.bincount(block[~(hit1 | hit2)], minlength=self.blocks)
            self._guess(self.one, one, i1, short, self.bits)
            self._guess(self.two, two, i2, short, self.bits + 3)
            keys.append(block << 32 | ids)
        self._count(np.concatenate(keys))
        self.novel /= 2  # older epochs count less
        self.plain /= 2
        self._mix()
        self._zero()

    def _guess(self, table: np.ndarray, held: np.ndarray, slot: np.ndarray, ids: np.ndarray, shift: int) -> None:
        """The last id at a slot becomes its guess; that id also moves the slot's confidence."""
        was = held >> shift
        sure = np.maximum(was + np.where((held & self.id) == ids, self.kind(2), self.kind(-2)), 1)
        np.minimum(sure, 7, out=sure)
        sure[was == 0] = 1
        table[slot] = sure << shift | ids

    def _count(self, keys: np.ndarray) -> None:
        both = np.concatenate([self.known, keys << 18 | 1])
        both.sort()
        key = both >> 18
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        kinds = np.bincount(key[edge] >> 32, minlength=self.blocks)
        self.novel += kinds - self.kinds
        self.kinds = kinds
        self.known = key[edge] << 18 | np.add.reduceat(both & ((1 << 18) - 1), edge)

    def _mix(self) -> None:
        two, one = np.divmod(np.arange(64), 8)
        m2 = np.where(two > 0, np.maximum(self.hits2 / self.seen * PARTS, 8), 0).astype(np.int64)
        m1 = np.where(one > 0, np.maximum(self.hits1 / self.seen * PARTS, 8), 0).astype(np.int64)
        over = m1 + m2 > PARTS * 3 // 4
        cut = PARTS * 3 // 4 / np.maximum(m1 + m2, 1)
        m1, m2 = np.where(over, (m1 * cut).astype(np.int64), m1), np.where(over, (m2 * cut).astype(np.int64), m2)
        self.shares = (m1 + m2 << 20 | m2).ravel()

    def _zero(self) -> None:
        """Order 0 of block i: entries first[i] (the escape), first[i] + 1, ... in order of ids."""
        keys, counts = self.known >> 18, self.known & ((1 << 18) - 1)
        kinds = np.bincount(keys >> 32, minlength=self.blocks)
        floor = 1
        while (crowded := kinds > ZERO // 2).any():  # ids that are seen least stay escapes there
            keep = (counts > floor) | ~crowded[keys >> 32]
            keys, counts, floor = keys[keep], counts[keep], floor + 1
            kinds = np.bincount(keys >> 32, minlength=self.blocks)
        block = keys >> 32
        total = np.bincount(block, weights=counts, minlength=self.blocks).astype(np.int64)
        escape = np.clip((ZERO * self.novel / self.plain).astype(np.int64), 8, np.maximum(8, (ZERO - kinds) // 2))
        share = counts * (ZERO - kinds - escape)[block] // np.maximum(total, 1)[block] + 1
        rest = ZERO - np.bincount(block, weights=share, minlength=self.blocks).astype(np.int64)
        each = np.arange(self.blocks)
        self.first = each + np.concatenate([[0], np.cumsum(kinds)[:-1]])
        self.place = np.arange(len(keys)) + block + 1
        ids, self.parts = np.zeros(len(keys) + self.blocks, np.int64), np.zeros(len(keys) + self.blocks, np.int64)
        ids[self.place], self.parts[self.place], self.parts[self.first] = keys & _LOW, share, rest
        end = np.cumsum(self.parts) - np.repeat(each, kinds + 1) * ZERO
        self.packed = end << 46 | end - self.parts << 32 | ids
        self.zero_keys, self.lane_first = keys, self.first[self.lanes.block]


def _planned(past: np.ndarray, lanes: _Lanes, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the coder does: starts, frequencies and whether an escape follows, as (steps, lanes)."""
    models = _Models(lanes, blocks, int(past.max()) >= 1 << 16)
    if int(past.max()) < 1 << 16:
        used = np.zeros(1 << 16, np.int32)
        used[past] = 1
        names, dense_of = np.flatnonzero(used), np.cumsum(used, dtype=np.int32) - 1
    else:
        names, dense_of = np.unique(past), None
    where = np.zeros(blocks * len(names), np.int32)  # entry of order 0 by block and id, 0 for none
    starts, freqs = np.zeros((lanes.steps, len(lanes.size)), np.int32), np.ones((lanes.steps, len(lanes.size)), np.int32)
    escaped = np.zeros(starts.shape, bool)
    row = lanes.block * len(names)
    for at, to in _epochs(lanes.steps):
        where[:] = 0
        if len(models.zero_keys):
            where[(models.zero_keys >> 32) * len(names) + np.searchsorted(names, models.zero_keys & _LOW)] = models.place
        for lo in range(at, to, 16):
            hi = min(to, lo + 16)
            live = lanes.live[lo]
            raw = past[lo : hi + 2, :live]
            some = raw.astype(np.int64)
            ids, (i1, i2) = raw[2:].astype(models.kind), models.slots(some[:-2], some[1:-1], live)
            one, two = models.one.take(i1), models.two.take(i2)
            mix = models.shares.take(models.cells[:live] + (one >> models.bits) + (two >> models.bits))
            both, m2 = mix >> 20, mix & ((1 << 20) - 1)
            dense = dense_of.take(raw[2:]) if dense_of is not None else np.searchsorted(names, raw[2:])
            entry = where.take(row[:live] + dense)
            novel = entry == 0
            zero = models.packed.take(np.where(novel, models.lane_first[:live], entry))
            rest = PARTS - both
            s = both + ((zero >> 32 & (ZERO - 1)) * rest >> ZERO_BITS)
            f = both + ((zero >> 46) * rest >> ZERO_BITS) - s
            hit2 = (two > models.id) & ((two & models.id) == ids)
            hit1 = (one > models.id) & ((one & models.id) == ids) & ~hit2
            starts[lo:hi, :live] = np.where(hit2, 0, np.where(hit1, m2, s))
            freqs[lo:hi, :live] = np.where(hit2, m2, np.where(hit1, both - m2, f))
            escaped[lo:hi, :live] = novel & ~(hit1 | hit2)
        if to < lanes.steps:
            models.learn(past, at, to)
    return starts, freqs, escaped


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The bytes of each block of ids (at most BLOCK, each below 2**32)."""
    out: list[bytes] = [b""] * len(blocks)
    for wide in (False, True):
        own = [i for i, b in enumerate(blocks) if len(b) and (int(b.max()) >= 1 << 16) == wide]
        held = 0
        some: list[int] = []
        for i in own:
            if some and held + len(blocks[i]) > AT_ONCE:
                for k, raw in zip(some, _encoded([blocks[k] for k in some], wide)):
                    out[k] = raw
                some, held = [], 0
            some.append(i)
            held += len(blocks[i])
        for k, raw in zip(some, _encoded([blocks[k] for k in some], wide) if some else []):
            out[k] = raw
    return [raw or _HEAD.pack(NARROW, 0, 0, 0) for raw in out]


def _encoded(blocks: list[np.ndarray], wide: bool) -> list[bytes]:
    lanes = _Lanes([len(b) for b in blocks])
    n = len(lanes.size)
    past = np.zeros((lanes.steps + 2, n), np.uint32)
    for lane, (block, first, size) in enumerate(zip(lanes.block.tolist(), lanes.first.tolist(), lanes.size.tolist())):
        past[2 : 2 + size, lane] = blocks[block][first : first + size]
    starts, freqs, escaped = _planned(past, lanes, len(blocks))
    low, size, sent = np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64), np.zeros(n, np.int64)
    cells = np.zeros((2 * lanes.steps + 8, n), np.uint32)  # words by place and lane; grows if escapes need more
    most = 0  # words a lane has sent at most

    def due(lo: np.ndarray, sz: np.ndarray, who: np.ndarray | None) -> None:
        nonlocal most
        short = (sz < _LEAST).nonzero()[0]
        if len(short):
            lane = short if who is None else who.take(short)
            was, at = lo.take(short), sent.take(lane)
            cells[at, lane] = was >> 32
            lo[short] = (was & _LOW) << 16
            sz[short] = sz.take(short) << 16
            sent[lane] = at + 1
            most += 1

    for t, live in enumerate(lanes.live):
        if most + 8 > len(cells):
            most = int(sent.max())
            if most + 64 > len(cells):
                cells = np.concatenate([cells, np.zeros_like(cells)])
        lo, sz = low[:live], size[:live]
        part = sz >> PART_BITS
        lo += part * starts[t, :live]
        np.multiply(part, freqs[t, :live], out=sz)
        due(lo, sz, None)
        who = escaped[t, :live].nonzero()[0]
        if len(who):
            ids = past[t + 2, who].astype(np.int64)
            for piece in (ids & 0xFFFF, ids >> 16) if wide else (ids,):
                lo, sz = low[who], size[who] >> 16
                lo += sz * piece
                due(lo, sz, who)
                low[who], size[who] = lo, sz
    for _ in range(3):
        cells[sent, np.arange(n)] = low >> 32
        low = (low & _LOW) << 16
        sent += 1
    cells = cells[: int(sent.max())]
    while (carry := cells >> 16).any():
        cells &= 0xFFFF
        cells[:-1] += carry[1:]
    sent_words = np.ascontiguousarray(cells.astype("<u2").T)
    counts: list[list[int]] = [[] for _ in blocks]
    words: list[list[bytes]] = [[] for _ in blocks]
    for lane, (block, k) in enumerate(zip(lanes.block.tolist(), sent.tolist())):
        counts[block].append(k)
        words[block].append(sent_words[lane, :k].tobytes())
    heads = [_HEAD.pack(WIDE if wide else NARROW, len(b), len(c), zlib.crc32(np.asarray(b).astype("<u4").tobytes())) for b, c in zip(blocks, counts)]
    return [head + np.array(c, "<u4").tobytes() + b"".join(w) for head, c, w in zip(heads, counts, words)]


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; ValueError if a block is not what encode() wrote."""
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    heads, words = [], []
    for block in blocks:
        if len(block) < _HEAD.size or block[:4] not in (NARROW, WIDE):
            raise ValueError("not a block of token ids")
        head = _HEAD.unpack_from(block)
        if head[1] > BLOCK or head[2] != (_cut(head[1])[0] if head[1] else 0) or len(block) < _HEAD.size + 4 * head[2]:
            raise ValueError("not a block of token ids")
        own = np.frombuffer(block, "<u4", head[2], _HEAD.size).astype(np.int64)
        if len(block) != _HEAD.size + 4 * head[2] + 2 * int(own.sum()):
            raise ValueError("a block of token ids is cut off")
        heads.append(head)
        words.append(own)
    for kind in (NARROW, WIDE):
        some: list[int] = []
        for i in [i for i, h in enumerate(heads) if h[0] == kind and h[1]] + [-1]:
            if some and (i < 0 or sum(heads[k][1] for k in some) + heads[i][1] > AT_ONCE):
                for k, ids in zip(some, _decoded([blocks[k] for k in some], [heads[k][1] for k in some], [words[k] for k in some], kind == WIDE)):
                    found[k] = ids
                some = []
            if i >= 0:
                some.append(i)
    for ids, head in zip(found, heads):
        if zlib.crc32(ids.astype("<u4").tobytes()) != head[3]:
            raise ValueError("a block of token ids fails its checksum")
    return found


def _decoded(blocks: list[bytes], sizes: list[int], words: list[np.ndarray], wide: bool) -> list[np.ndarray]:
    lanes = _Lanes(sizes)
    n = len(lanes.size)
    # The words of all lanes one after the other, with zeros behind.
    flat = np.concatenate([np.frombuffer(b, "<u2", -1, _HEAD.size + 4 * len(w)) for b, w in zip(blocks, words)] + [np.zeros(4, "<u2")]).astype(np.int64)
    starts = np.cumsum(np.concatenate([[0], *words]))[:-1]
    block_first = np.cumsum([0] + [len(w) for w in words])[:-1]
    segment = lanes.first // np.array([_cut(s)[1] for s in sizes])[lanes.block]
    nxt = starts[block_first[lanes.block] + segment]
    last = len(flat) - 1
    code = flat.take(nxt) << 32 | flat.take(np.minimum(nxt + 1, last)) << 16 | flat.take(np.minimum(nxt + 2, last))
    nxt += 3
    size = np.full(n, 1 << 48, np.int64)
    past = np.zeros((lanes.steps + 2, n), np.uint32)
    models = _Models(lanes, len(blocks), wide)
    block_parts = lanes.block << ZERO_BITS

    # Quotients here are below 2**17 and divisors below 2**32, so the double nearest to one has its floor.
    def renew(code: np.ndarray, size: np.ndarray, nxt: np.ndarray) -> None:
        due = (size < _LEAST).nonzero()[0]
        if len(due):
            at = nxt.take(due)
            code[due] = code.take(due) << 16 | flat.take(np.minimum(at, last))
            size[due] = size.take(due) << 16
            nxt[due] = at + 1

    def raw(who: np.ndarray) -> np.ndarray:
        c, s, x = code[who], size[who] >> 16, nxt[who]
        got = np.minimum((c / s).astype(np.int64), 0xFFFF)
        c -= got * s
        renew(c, s, x)
        code[who], size[who], nxt[who] = c, s, x
        return got

    a = b = np.zeros(n, np.int64)
    for at, to in _epochs(lanes.steps):
        ranks = np.repeat(np.arange(len(models.parts), dtype=np.int32), models.parts)  # for each part of each block its entry
        first, packed, shares = models.lane_first, models.packed, models.shares
        for t in range(at, to):
            live = lanes.live[t]
            i1, i2 = models.slots(a[:live], b[:live], live)
            one, two = models.one.take(i1), models.two.take(i2)
            cell = models.cells[:live] + (one >> models.bits)
            cell += two >> models.bits
            mix = shares.take(cell)
            both, m2 = mix >> 20, mix & ((1 << 20) - 1)
            c, s = code[:live], size[:live]
            part = s >> PART_BITS
            q = (c / part).astype(np.int64)
            np.minimum(q, PARTS - 1, out=q)
            v, rest = q - both, PARTS - both
            z = (((np.maximum(v, 0) + 1 << ZERO_BITS) - 1) / rest).astype(np.int64)
            z += block_parts[:live]
            entry = ranks.take(z)
            zero = packed.take(entry)
            start = ((zero >> 32 & (ZERO - 1)) * rest >> ZERO_BITS) + both
            freq = ((zero >> 46) * rest >> ZERO_BITS) + both
            freq -= start
            ids = zero & _LOW
            escape = entry == first[:live]
            g = (v < 0).nonzero()[0]
            if len(g):
                m = m2.take(g)
                by_two = q.take(g) < m
                ids[g] = np.where(by_two, two.take(g), one.take(g)) & models.id
                start[g] = np.where(by_two, 0, m)
                freq[g] = np.where(by_two, m, both.take(g) - m)
                escape[g] = False
            start *= part
            c -= start
            np.multiply(part, freq, out=s)
            renew(c, s, nxt[:live])
            escaped = escape.nonzero()[0]
            if len(escaped):
                ids[escaped] = raw(escaped)
                if wide:
                    ids[escaped] |= raw(escaped) << 16
            past[t + 2, :live] = ids
            a, b = b, ids
        if to < lanes.steps:
            models.learn(past, at, to)
    out = [np.zeros(k, np.uint32) for k in sizes]
    for lane, (block, begin, k) in enumerate(zip(lanes.block.tolist(), lanes.first.tolist(), lanes.size.tolist())):
        out[block][begin : begin + k] = past[2 : 2 + k, lane]
    return out
