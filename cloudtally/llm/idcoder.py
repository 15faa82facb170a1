"""Token ids in blocks: order-0 to order-2 predictions, mixed by adaptive counts, drive a range coder.

Order 0 gives each id the share of its count in the block, orders 1 and 2 the
id that followed their context last. An id's probability is the sum of what
all three give it, weighted by counts of how often each was right in the same
state, and of an even share of the vocabulary if it is new to the block.

The coder is the range coder of asymmetric numerals (rANS): what an id owns of
the range need not lie together. So order 0 gives every earlier place of the
block the same part of the range, an id owns those of its places, and no sums
of counts are kept. It writes backwards what is read forwards; the encoder
first goes through the block to learn the predictions.

Blocks are reset and checked on their own. Many are coded side by side, one
id of each per step, so that a step is a handful of array operations. All
arithmetic is on whole numbers (quotients by doubles are exact below 2**52,
those by floats below 2**20), so a reader on another machine agrees.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
MAGIC = b"CTID"
VERSION = 3
_HEADER = "<4sHIQI"  # magic, version, ids per block, ids, blocks

# Events: the order-2 prediction is right, the order-1 one is, another id seen before in the block, a new id.
_STEP = 3
_U = np.uint64
_MASK16, _UPPER, _ONCE = _U(0xFFFF), np.uint32(0xFFFF0000), np.uint32(1 << 16)
# Four 16-bit counts in a word times this: their running sums.
_SUMS = _U(0x0001_0001_0001_0001)
# The range is 2**20 parts; states of the coder are below 2**52 and leave or take 32 bits at once.
_BITS, _WORD = 20, 32
_RANGE = 1 << _BITS
_MASK, _MASK32 = _RANGE - 1, (1 << _WORD) - 1
#: Rows looked at together where steps do not matter; only bounds memory.
_TOGETHER = 128
#: Most ids of a block: each keeps a part of the range, and sums of counts 16 bits.
_LONGEST = 2048
# Parts of the range for one count, by the sum of counts.
_UNIT = np.array([0, *((_RANGE - 2 * _LONGEST) // n for n in range(1, _STEP * _LONGEST + 128))], np.int32)


def _first_counts() -> np.ndarray:
    """Event counts to start with, four 16-bit numbers in a word, per state of the two predictions.

    A state is 16 if both predict the same, plus 4 times the trust in the
    order-2 prediction, plus that in the order-1 one (0 none, then 1 to 3). An
    event that cannot happen in a state has no count and never gets one.
    """
    counts = np.zeros(32, np.uint64)
    for state in range(32):
        agree, trust2, trust1 = state >> 4, state >> 2 & 3, state & 3
        first = (0, 3, 12, 30)[trust2] * (1 + agree)
        second = 0 if agree else (0, 2, 5, 10)[trust1]
        counts[state] = first | second << 16 | 3 << 32 | 2 << 48
    return counts


class _Model:
    """What both sides know after the ids so far, for ``lanes`` blocks at once.

    Ids go by the place of their first occurrence in the block. Contexts are
    such places too. What order 1 predicts is kept by the caller, who has other
    things to keep by place. Choices between lanes are sums and products, which
    cost less than branches.
    """

    def __init__(self, lanes: int, block: int) -> None:
        slots = 1 << max(4, (block - 1).bit_length())
        lane = np.arange(lanes, dtype=np.int64)
        self.shift, self.slot0, self.state0 = _U(64 - (slots.bit_length() - 1)), lane * slots, lane * 32
        self.order2, self.counts = np.zeros(lanes * slots, np.uint16), np.tile(_first_counts(), lanes)
        self.before = np.zeros(lanes, np.uint64)
        self.entry = np.zeros((2, lanes), np.uint16)

    def predict(self, last: np.ndarray, entry1: np.ndarray) -> np.ndarray:
        """Counts of the four events after ids first seen at ``last``, for which order 1 has ``entry1``."""
        key = last.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
        self.at2 = ((key + self.before) >> self.shift).view(np.int64) + self.slot0
        self.before = key * _U(0xC2B2AE3D27D4EB4F)
        # An entry is (place + 1) * 4 + trust; zero where nothing was seen. Order 2 is above, order 1 below.
        self.entry[0], self.entry[1] = self.order2.take(self.at2), entry1
        self.guess, self.trust = self.entry >> 2, self.entry & 3
        agree = (self.guess[0] == self.guess[1]).astype(np.uint16)
        self.state = self.state0 + ((agree << 4) + (self.trust[0] << 2) + self.trust[1])
        self.count = self.counts.take(self.state)
        return self.count

    def update(self, spelled: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Learns the ids by their places plus 1: (the new order-1 entries, which orders are right, the events)."""
        right = self.guess == spelled
        wrong = (~right).view(np.uint8)
        event = wrong[0] + (wrong[0] & wrong[1]) + new.view(np.uint8)
        self.counts[self.state] = self.count + (_U(_STEP) << (event << 4).astype(np.uint64))
        # Right: trust grows to 3. Wrong: trust of 2 or 3 shrinks, else the entry is made anew.
        one, fresh = right.astype(np.uint16), (spelled << 2) | 1
        anew = (one | self.trust >> 1) - np.uint16(1)
        entry = self.entry + one - ((self.trust + 2 - one) >> 2) + (anew & (fresh - self.entry))
        self.order2[self.at2] = entry[0]
        return entry[1], right, event


def _shares(count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of the range that orders 2 and 1 have, what order 0 gives each of ``n`` places, and where the three end."""
    unit = _UNIT.take((count * _SUMS >> _U(48)).view(np.int64))
    share2 = (count & _MASK16).astype(np.int32) * unit
    share1 = (count >> _U(16) & _MASK16).astype(np.int32) * unit
    each = (count >> _U(32) & _MASK16).astype(np.int32) * unit // n + 1
    return share2, share1, each, share2 + share1 + each * n


def _occurrences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place and row, where its id came first, how often before, and where its places begin in the row's list of them (16 bits each); the lists."""
    lanes, steps = rows.shape
    told, lists = np.empty((steps, lanes), np.uint64), np.empty((lanes, steps), np.uint16)
    for begin in range(0, lanes, _TOGETHER):
        ids = rows[begin : begin + _TOGETHER]
        kind = np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32
        places = np.argsort(ids.astype(kind), axis=1, kind="stable")
        lists[begin : begin + _TOGETHER] = places
        row = np.arange(len(ids))[:, None]
        ordered = ids.reshape(-1).take(places + row * steps)
        begins = np.ones(ids.shape, bool)
        begins[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        heads = np.flatnonzero(begins)
        head = np.repeat(heads, np.diff(heads, append=ids.size))
        words = places.reshape(-1).take(head) | np.arange(ids.size) - head << 16
        words |= (head.reshape(ids.shape) - row * steps << 32).reshape(-1)
        some = np.empty((steps, len(ids)), np.int64)
        some.reshape(-1)[(places * len(ids) + row).reshape(-1)] = words
        told[:, begin : begin + _TOGETHER] = some
    return told, lists.reshape(-1)


def _steps(n: int, block: int) -> int:
    return min(n, block)


def encode(ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> bytes:
    """The ids (each below ``vocabulary``) as one container of blocks; no ids give a container of none."""
    if block > _LONGEST or vocabulary > _RANGE:
        raise ValueError("blocks or vocabulary too large")
    n = len(ids)
    if not n:
        return struct.pack(_HEADER, MAGIC, VERSION, block, 0, 0) + struct.pack("<I", vocabulary)
    lanes = -(-n // block)
    # The last of several blocks is filled up, which costs next to nothing and keeps the steps alike.
    steps = _steps(n, block)
    padded = np.zeros(lanes * steps, np.uint32)
    padded[:n] = ids
    rows = padded.reshape(lanes, steps)
    known, places = _occurrences(rows)
    model, lane = _Model(lanes, steps), np.arange(lanes)
    order1 = np.zeros(steps * lanes, np.uint16)
    counts, events = np.empty((steps, lanes), np.uint64), np.full((steps, lanes), 3, np.uint8)
    last = np.zeros(lanes, np.uint16)
    for t in range(1, steps):
        at = last * np.int64(lanes) + lane
        counts[t] = model.predict(last, order1.take(at))
        last = known[t].astype(np.uint16)
        order1[at], _, events[t] = model.update(last + np.uint16(1), last == t)
    width = 2 * steps + 2
    flat, put = np.zeros(lanes * width, np.uint32), np.arange(1, lanes + 1) * width - 1
    lists, state, even = lane * steps, np.full(lanes, _RANGE), _RANGE // vocabulary
    for t in range(steps - 1, -1, -1):
        event = events[t]
        told = np.flatnonzero(event == 3)
        if len(told):
            some = state.take(told)
            full = np.flatnonzero(some >= even << _WORD)
            at = told.take(full)
            over, place = some.take(full), put.take(at)
            flat[place], put[at], some[full] = over, place - 1, over >> _WORD
            of = some // even
            state[told] = (of << _BITS) + padded.take(lists.take(told) + t) * np.int64(even) + (some - of * even)
        if not t:
            break
        share2, share1, each, end = _shares(counts[t], t)
        came = (known[t] >> _U(16) & _MASK16).astype(np.int32)
        plain, right1 = each * came, event == 1
        begin, own = right1 * share2, plain + (event == 0) * share2 + right1 * share1
        begin[told] = end = end.take(told)
        own[told] = _RANGE - end
        full = np.flatnonzero((state >> _WORD).astype(np.int32) >= own)
        over, place = state.take(full), put.take(full)
        flat[place], put[full], state[full] = over, place - 1, over >> _WORD
        of = (state / own).astype(np.int64)
        rank = (state - of * own).astype(np.int32)
        # By order 0: which of the id's places, and which part of it.
        part = (rank.astype(np.float32) / np.maximum(came, 1).astype(np.float32)).astype(np.int32)
        which = (known[t] >> _U(32)).view(np.int64) + lists + (rank - part * came)
        by_place = share2 + share1 + part * t + places.take(which, mode="clip")
        begin += rank - plain
        state = (of << _BITS) + (begin + (by_place - begin) * (rank < plain))
    for half in (state >> _WORD, state & _MASK32):
        flat[put] = half
        put -= 1
    used = np.arange(1, lanes + 1) * width - 1 - put
    checks = [zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) for i in range(lanes)]
    index = np.array([used, checks], np.int64).T.astype("<u4").tobytes()
    out = flat.reshape(lanes, width).astype("<u4", copy=False)
    body = b"".join(out[i, width - size :].tobytes() for i, size in enumerate(used.tolist()))
    return struct.pack(_HEADER, MAGIC, VERSION, block, n, lanes) + struct.pack("<I", vocabulary) + index + body


def decode(data: bytes) -> np.ndarray:
    """The ids of a container; raises ValueError if it is not one, is cut off, or a block fails its check."""
    if len(data) < struct.calcsize(_HEADER) + 4:
        raise ValueError("no container of id blocks")
    magic, version, block, n, lanes = struct.unpack_from(_HEADER, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("no container of id blocks, or of another version")
    (vocabulary,) = struct.unpack_from("<I", data, struct.calcsize(_HEADER))
    if not n:
        return np.zeros(0, np.uint32)
    if not 0 < block <= _LONGEST or not 0 < vocabulary <= _RANGE:
        raise ValueError("blocks or vocabulary too large")
    at = struct.calcsize(_HEADER) + 4
    if lanes != -(-n // block) or at + 8 * lanes > len(data):
        raise ValueError("the block index is cut off")
    index = np.frombuffer(data, "<u4", 2 * lanes, at).reshape(lanes, 2).astype(np.int64)
    if 4 * int(index[:, 0].sum()) != len(data) - at - 8 * lanes:
        raise ValueError("the blocks are cut off")
    words = np.append(np.frombuffer(data, "<u4", offset=at + 8 * lanes).astype(np.uint32), np.zeros(2, np.uint32))
    read = np.concatenate([[0], np.cumsum(index[:, 0])])[:-1]
    steps = _steps(n, block)
    model, lane = _Model(lanes, steps), np.arange(lanes)
    # By place: the order-1 entry of the id first seen there, and above 16 bits how often it came.
    known = np.zeros(steps * lanes, np.uint32)
    # By place: where its id came first, and above 16 bits how often before.
    places = np.zeros((steps, lanes), np.uint32)
    columns = np.zeros((steps, lanes), np.uint32)
    all_places = places.reshape(-1)
    even = _RANGE // vocabulary
    # A damaged block may lead anywhere; it stays inside its tables and fails its check.
    state = (words.take(read, mode="clip").astype(np.int64) | words.take(read + 1, mode="clip").astype(np.int64) << _WORD) & ((1 << 52) - 1)
    read += 2
    before1 = lane - lanes
    at = told = lane
    last, entry1, came = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16), np.full(lanes, 1 << 16, np.uint32)
    for t in range(steps):
        if t:
            share2, share1, each, end = _shares(model.predict(last, entry1), t)
            value, ends = (state & _MASK).astype(np.int32), share2 + share1
            past, new = value - ends, value >= end
            part = past // t
            some = all_places.take((past - part * t) * np.int64(lanes) + lane)
            by2, by1 = value < share2, past < 0
            spelled = some.astype(np.uint16) + np.uint16(1)
            spelled += (model.guess[1] - spelled) * by1 + (model.guess[0] - model.guess[1]) * by2
            told = np.flatnonzero(new)
            spelled[told] = t + 1
            entry1, right, _ = model.update(spelled, new)
            known[at] = entry1 | came
            at = spelled * np.int64(lanes) + before1
            both = known.take(at)
            entry1, last, came = both.astype(np.uint16), spelled - np.uint16(1), both & _UPPER
            places[t] = came | last
            often = (both >> 16).view(np.int32)
            came += _ONCE
            plain = each * often
            own = plain + right[0] * share2 + right[1] * share1
            rank = part * often + (some >> 16).view(np.int32)
            rank += (plain + value - share2 - rank) * by1 + by2 * share2
            end = end.take(told)
            own[told], rank[told] = _RANGE - end, value.take(told) - end
            state = (state >> _BITS) * own + rank
            low = np.flatnonzero(state < _RANGE)
            place = read.take(low)
            state[low] = state.take(low) << _WORD | words.take(place, mode="clip")
            read[low] = place + 1
        if len(told):
            some = state.take(told)
            value = some & _MASK
            x = np.minimum(value // even, vocabulary - 1)
            columns[t, told] = x
            some = (some >> _BITS) * even + (value - x * even)
            low = np.flatnonzero(some < _RANGE)
            lower = told.take(low)
            place = read.take(lower)
            some[low] = some.take(low) << _WORD | words.take(place, mode="clip")
            read[lower] = place + 1
            state[told] = some
    ids = np.empty((lanes, steps), np.uint32)
    for begin in range(0, lanes, _TOGETHER):
        first = places[:, begin : begin + _TOGETHER].T & np.uint32(0xFFFF)
        some = np.ascontiguousarray(columns[:, begin : begin + _TOGETHER].T)
        ids[begin : begin + _TOGETHER] = np.take_along_axis(some, first.astype(np.int64), axis=1)
    ids = ids.reshape(-1)[:n]
    for i, check in enumerate(index[:, 1].tolist()):
        if zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) != check:
            raise ValueError(f"block {i} fails its check")
    return ids
