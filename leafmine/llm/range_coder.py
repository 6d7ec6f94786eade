"""A range coder for blocks of token ids, mixed from adaptive predictions of order 0 to 2.

In each block, two tables remember which id last followed the last id (order 1) and the last two
(order 2), and a counter follows the id that the block holds most often (order 0). How far each is trusted
is learned from how it did so far in the block, given how sure the entries of orders 1 and 2 are and whether they
agree; what all leave goes to the id frequencies in the segment's head. The mixture drives an
arithmetic coder of 20-bit steps. Every block starts anew, so any one decodes by itself (with the head), and
carries a checksum; so does the head. Blocks of a segment are coded side by side, one id of each at a
time, which makes each step of the coder a few numpy operations.
"""

import struct
import zlib

import numpy as np

BLOCK = 1024
MAGIC = b"IDMX\x02"
#: Blocks that are coded side by side at most: their tables stay near the processor.
LANES = 2048
#: Blocks whose words are put together at once, and pairs of words that are packed at once.
CARRIED, PACKED = 256, 1 << 16
_BITS = 20  # of a coder step, and of the words written
_FREQ = 17  # of the total of the frequencies in the head
_ROWS = 8  # bits of the number of rows of a block's table of entries
_SHARE = 13 << _BITS - 4  # of the range, at most, for all predictions
_KEEP, _SURE = 10, 40  # the order-0 candidate: what a hit adds, and the most it can have
_U = np.uint64
_B = _U(_BITS)
_TOP, _MASK3 = _U(1 << 2 * _BITS), _U((1 << 3 * _BITS) - 1)
_OVER = 1 + 2.0**-40
_HEAD = "<QII"


class Corrupt(ValueError):
    """Ids, or a segment's head, without their checksum, or a segment that is cut off."""


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, and frequencies that sum to 2 ** _FREQ, each at least 1."""
    count = np.bincount(ids)
    present = np.flatnonzero(count)
    c, total = count[present].astype(np.int64), 1 << _FREQ
    if len(c) > total:
        raise ValueError(f"more than {total} different ids")
    f = 1 + c * (total - len(c)) // c.sum()
    f[np.argmax(c)] += total - f.sum()
    return present.astype(np.uint32), f.astype(np.uint32)


class _Model:
    """The state of blocks (lanes) that are coded side by side. Row 0 of two is order 1, row 1 order 2.

    The entries of one last id lie side by side: one of order 1, three of order 2."""

    def __init__(self, lanes: int):
        at = np.arange(lanes, dtype=np.intp)
        self.lane, self.base = at, at << _ROWS + 2
        # an entry is its id, and in the last two bits how sure it is
        self.last = np.zeros(lanes << _ROWS + 2, np.int32)
        # trust in what an order says, by how sure it is, for order 1 also by whether order 2 says the same
        self.trust = np.full(16 * lanes, 1 << 13, np.int32)
        self.context = np.stack((at * 16, at * 16 + 8))
        self.a, self.b = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.most, self.held = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.slot, self.cell = np.empty((2, lanes), np.intp), np.empty((2, lanes), np.intp)
        self.ends = np.zeros((4, lanes), np.int64)  # 0, and of the intervals of order 2, 1 and 0

    def predict(self) -> None:
        """Predicted ids (p: orders 1 and 2; most: order 0), and the ends of their intervals of the coder's range."""
        np.add(self.base, self.b * np.uint32(0x9E3779B1) >> np.uint32(32 - _ROWS) << np.uint32(2), out=self.slot[0])
        np.add(self.slot[0], np.maximum(self.a * np.uint32(0x85EBCA77) >> np.uint32(30), 1), out=self.slot[1])
        self.v = self.last.take(self.slot)
        self.p, self.sure = self.v >> 2, self.v & 3
        same = self.p[0] == self.p[1]
        np.add(self.context, self.sure, out=self.cell)
        self.cell[0] += same.view(np.uint8) << 2
        self.t = self.trust.take(self.cell)
        e2, e1, e0 = self.ends[1], self.ends[2], self.ends[3]
        np.multiply(self.t[1], _SHARE >> 16, out=e2)
        e2 += 1
        np.subtract(_SHARE, e2, out=e1)
        e1 *= self.t[0]
        e1 *= ~same
        e1 >>= 16
        e1 += e2
        e1 += 1
        np.subtract(_SHARE, e1, out=e0)
        e0 *= self.held
        e0 >>= 9
        e0 += e1
        e0 += 3

    def update(self, x: np.ndarray, hit: np.ndarray, hit0: np.ndarray) -> None:
        """x: the ids; hit: where order 1 and order 2 said so; hit0: where order 0 did."""
        self.trust[self.cell] = self.t + (hit * np.int32(65535) - self.t >> 4)
        # right: surer; wrong: less sure by two, or replaced
        self.last[self.slot] = np.where(hit, self.v + (self.sure < 3), np.where(self.sure > 1, self.v - 2, x << 2))
        self.held += hit0 * np.int32(_KEEP + 1) - 1
        np.minimum(self.held, _SURE, out=self.held)
        gone = self.held < 0
        np.copyto(self.most, x, where=gone)
        np.copyto(self.held, _KEEP, where=gone)
        self.a, self.b = self.b, x.view(np.uint32)


def _case(hit: np.ndarray, hit0: np.ndarray) -> np.ndarray:
    """0 where order 2 says the id, 1 where order 1 does, 2 where order 0 does, 3 elsewhere."""
    miss2 = ~hit[1]
    miss1 = miss2 & ~hit[0]
    return miss2.astype(np.intp) + miss1 + (miss1 & ~hit0)


def _coded(steps: np.ndarray, low_of: np.ndarray, high_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 20-bit words of some blocks, one after another, and how many each has. steps: id of each block, step by step; low_of, high_of: ends of the ids' intervals."""
    n, lanes = steps.shape
    model = _Model(lanes)
    low, rng = np.zeros(lanes, _U), np.full(lanes, _MASK3, _U)
    # of each step: its word, whether it is written, and what the step carries into the words before
    word, full, carry = np.empty((n + 3, lanes), np.uint32), np.ones((n + 3, lanes), bool), np.zeros((n + 3, lanes), np.uint8)
    ends = np.empty((5, lanes), np.int64)
    for i, x in enumerate(steps):
        model.predict()
        hit, hit0 = model.p == x, model.most == x
        ends[:4] = model.ends
        case = _case(hit, hit0)
        at = case * lanes
        at += model.lane
        # an id that no order says
        e0 = model.ends[3]
        left = (1 << _BITS) - e0
        np.add(high_of.take(x) * left >> _FREQ, e0, out=ends[4])
        lo = np.where(case == 3, (low_of.take(x) * left >> _FREQ) + e0, ends.take(at))
        at += lanes
        hi = ends.take(at)
        part = rng >> _B
        low += part * lo.view(_U)
        rng = part * (hi - lo).view(_U)
        carry[i] = low >> _U(3 * _BITS)
        low &= _MASK3
        small = rng < _TOP
        full[i] = small
        word[i] = low >> _U(2 * _BITS)
        shift = small * _B
        low = low << shift & _MASK3
        rng <<= shift
        model.update(x, hit, hit0)
    for i in range(n, n + 3):
        word[i] = low >> _U(2 * _BITS)
        low = low << _B & _MASK3
    # some blocks at a time, so that their places take little memory
    parts = [_carried(*(x[:, i : i + CARRIED] for x in (word, full, carry))) for i in range(0, lanes, CARRIED)]
    return np.concatenate(parts), full.sum(0)


def _carried(word: np.ndarray, full: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """The words written, block by block; a step's carry goes to the last word that its block wrote before it, and from there on to earlier ones."""
    at = np.flatnonzero(np.ascontiguousarray(full.T))
    words = np.ascontiguousarray(word.T).reshape(-1)[at]
    over = np.searchsorted(at, np.flatnonzero(np.ascontiguousarray(carry.T))) - 1
    while len(over):
        words += np.bincount(over, minlength=len(words)).astype(np.uint32)
        over = np.flatnonzero(words >> np.uint32(_BITS))
        words[over] &= np.uint32((1 << _BITS) - 1)
        over -= 1
    return words


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment: all ids in blocks of `block`, each with its checksum."""
    n = len(ids)
    present, freq = frequencies(ids) if n else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    lanes = -(-n // block)
    words, used = [], []
    if n:
        cum = np.concatenate(([0], np.cumsum(freq))).astype(np.int32)
        low_of, high_of = (np.zeros(int(present[-1]) + 1, np.int32) for _ in range(2))
        low_of[present], high_of[present] = cum[:-1], cum[1:]
        full = np.full(lanes * block, ids[-1], np.int32)
        full[:n] = ids
        ids = full[:n].view(np.uint32)
        for i in range(0, lanes, LANES):
            w, u = _coded(np.ascontiguousarray(full[i * block : (i + LANES) * block].reshape(-1, block).T), low_of, high_of)
            words.append(w)
            used.append(u)
    used = np.concatenate(used).astype(np.uint32) if used else np.zeros(0, np.uint32)
    sums = np.array([zlib.crc32(ids[i : i + block].tobytes()) for i in range(0, n, block)], np.uint32)
    table = zlib.compress(np.diff(present, prepend=0).astype(np.uint32).tobytes() + freq.tobytes() + used.tobytes() + sums.tobytes(), 1)
    head = MAGIC + struct.pack(_HEAD, n, block, len(present)) + struct.pack("<I", len(table)) + table
    return head + struct.pack("<I", zlib.crc32(head)) + _packed(np.concatenate(words) if words else np.zeros(0, np.uint32))


def _packed(words: np.ndarray) -> bytes:
    """20-bit words, two in five bytes."""
    out = np.empty((-(-len(words) // 2), 5), np.uint8)
    for i in range(0, len(out), PACKED):
        w = words[2 * i : 2 * (i + PACKED)].astype(_U)
        both = w[::2] << _B
        both[: len(w) // 2] |= w[1::2]
        out[i : i + PACKED] = both.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return out.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, -(-n // 2) * 5).reshape(-1, 5)
    words = np.empty((len(raw), 2), np.uint32)
    for i in range(0, len(raw), PACKED):
        full = np.zeros((min(PACKED, len(raw) - i), 8), np.uint8)
        full[:, :5] = raw[i : i + PACKED]
        both = full.reshape(-1).view("<u8")
        words[i : i + PACKED, 0], words[i : i + PACKED, 1] = both >> _B, both & _U((1 << _BITS) - 1)
    return words.reshape(-1)[:n]


def _head(data: bytes) -> tuple:
    """Ids, size of a block, ids that occur, their frequencies, words and checksum of each block, and where the words begin."""
    try:
        n, block, n_present = struct.unpack_from(_HEAD, data, len(MAGIC))
        at = len(MAGIC) + struct.calcsize(_HEAD)
        end = at + 4 + struct.unpack_from("<I", data, at)[0]
        if data[: len(MAGIC)] != MAGIC or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
            raise Corrupt("the head has not its checksum")
    except struct.error as e:
        raise Corrupt("the head is cut off") from e
    table = np.frombuffer(zlib.decompress(data[at + 4 : end]), np.uint32)
    lanes = -(-n // block)
    present, freq, used, sums = np.split(table, (n_present, 2 * n_present, 2 * n_present + lanes))
    return n, block, np.cumsum(present).astype(np.int32), freq, used.astype(np.int64), sums, end + 4


def _decoded(words: np.ndarray, used: np.ndarray, block: int, present: np.ndarray, low_of: np.ndarray, high_of: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The ids of some blocks, step by step."""
    lanes = len(used)
    words = np.append(words, np.zeros(4, words.dtype))
    pos = np.cumsum(used) - used
    end = pos + used
    code = words[pos].astype(_U) << _U(2 * _BITS) | words[pos + 1].astype(_U) << _B | words[pos + 2]
    pos = pos + 3
    rng = np.full(lanes, _MASK3, _U)
    model = _Model(lanes)
    out = np.empty((block, lanes), np.int32)
    says, ends = np.empty((4, lanes), np.int32), np.empty((5, lanes), np.int64)
    for i in range(block):
        model.predict()
        part = rng >> _B
        # quotients by way of doubles: never too small, and one too large at most
        v = (code * _OVER / part).astype(_U)
        v -= v * part > code
        v = np.minimum(v.view(np.int64), (1 << _BITS) - 1)
        e0 = model.ends[3]
        left = (1 << _BITS) - e0
        # small enough for doubles to be exact
        t = np.minimum((((np.maximum(v - e0, 0) + 1 << _FREQ) - 1) / left).astype(np.int64), (1 << _FREQ) - 1)
        r = slot.take(t)
        says[0], says[1], says[2], says[3] = model.p[1], model.p[0], model.most, present.take(r)
        ends[:4] = model.ends
        np.add(high_of.take(r) * left >> _FREQ, e0, out=ends[4])
        case = (v >= ends[1]).astype(np.intp) + (v >= ends[2]) + (v >= e0)
        at = case * lanes
        at += model.lane
        x = says.take(at)
        lo = np.where(case == 3, (low_of.take(r) * left >> _FREQ) + e0, ends.take(at))
        at += lanes
        hi = ends.take(at)
        code -= part * lo.view(_U)
        rng = part * (hi - lo).view(_U)
        small = rng < _TOP
        shift = small * _B
        code = code << shift | words.take(np.minimum(pos, end, out=at)) * small
        rng <<= shift
        pos += small
        model.update(x, model.p == x, model.most == x)
        out[i] = x
    return out


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; Corrupt if the head's or a block's checksum fails, or ids are missing."""
    n, block, present, freq, used, sums, at = _head(data)
    total = int(used.sum())
    if len(data) - at < -(-total // 2) * 5:
        raise Corrupt("the segment is cut off")
    words = _unpacked(data[at:], total)
    cum = np.concatenate(([0], np.cumsum(freq))).astype(np.int32)
    slot = np.repeat(np.arange(len(present), dtype=np.uint16 if len(present) <= 1 << 16 else np.uint32), freq)
    first = np.concatenate(([0], np.cumsum(used)))
    parts = [_decoded(words[first[i] : first[min(i + LANES, len(used))]], used[i : i + LANES], block, present, cum[:-1], cum[1:], slot).T.reshape(-1) for i in range(0, len(used), LANES)]
    ids = np.concatenate(parts)[:n].astype(np.uint32) if parts else np.zeros(0, np.uint32)
    for i, want in enumerate(sums.tolist()):
        if zlib.crc32(ids[i * block : (i + 1) * block].tobytes()) != want:
            raise Corrupt(f"block {i} has not its checksum")
    return ids
