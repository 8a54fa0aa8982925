"""External induced sorting of the suffixes of a shard, with LCP values.

The shard is a list of byte strings, each ended by a terminator of its own.
Suffixes are L type (larger than the next suffix) or S type; an S suffix after
an L suffix is a seed.  One sweep over the buckets of first bytes puts the L
suffixes in order: the suffix before each one taken out is put into the queue
of its own first byte.  A sweep the other way does the same for S.  The queue
is a monotone priority queue: (first byte, order of arrival).  Its tuples
(position, common prefix with the one before) live in chunks that go to a
disk file beyond `memory` bytes, so it may be far larger than memory.

Common prefixes are carried along: of two neighbours in a bucket it is one
more than the least of those between their origins, found as a range minimum
over the chunk in hand plus a running minimum per bucket.  They are cut off at
`cap`, the repeat length asked for.

Seeds are sorted by the same two sweeps over the seed substrings (names), and
the string of names is ranked by doubling, until all differ or `cap` is reached.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .textbatch import BYTE_CODE, mix

CHUNK = 1 << 17
CHARS = 257
BIG = np.int16(32_000)


_P = np.uint64((1 << 61) - 1)
_61, _32, _29, _3 = (np.uint64(x) for x in (61, 32, 29, 3))
_LOW32, _LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_BASE = 0x0B504F333F9DE649


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, by halves of 32 and 29 bits."""
    a1, a0, b1, b0 = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    mid, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduce(((a1 * b1) << _3) + (mid >> _29) + ((mid & _LOW29) << _32) + (low >> _61) + (low & _P))


class Prefix61:
    """Polynomial prefix hashes of a byte array modulo the prime 2**61 - 1:
    tells any two ranges of it apart but for chance."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.ones(n + 1, dtype=np.uint64)
        have, step = 1, _BASE  # step = base ** have
        while have <= n:
            m = min(have, n + 1 - have)
            power[have:have + m] = times61(power[:m], np.uint64(step))
            step, have = step * step % ((1 << 61) - 1), 2 * have
        code = times61(BYTE_CODE[data] >> _3, power[:n])
        high, low = np.cumsum(code >> _32, dtype=np.uint64), np.cumsum(code & _LOW32, dtype=np.uint64)
        high = _reduce(high)
        self.acc = np.zeros(n + 1, dtype=np.uint64)
        self.acc[1:] = _reduce(((high & _LOW29) << _32) + (high >> _29) + _reduce(low))
        self.power = power

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The value of each [start, end); values of equal lengths compare."""
        return times61(_reduce(self.acc[end] + (_P - self.acc[start])), self.power[len(self.power) - 1 - start])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


class BucketQueue:
    """Tuples (position, lcp) by bucket, in order of arrival, disk-backed."""

    def __init__(self, memory: int):
        self.parts: list[list] = [[] for _ in range(CHARS)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        parts = self.parts[c]
        if parts and isinstance(parts[-1], list) and parts[-1][2] + len(pos) <= CHUNK:
            last = parts[-1]
            last[0].append(pos)
            last[1].append(lcp)
            last[2] += len(pos)
        else:
            parts.append([[pos], [lcp], len(pos)])
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="bucket-queue-")
        self.file.seek(0, 2)
        for parts in self.parts:
            for i, p in enumerate(parts):
                if isinstance(p, list):
                    pos, lcp = np.concatenate(p[0]), np.concatenate(p[1])
                    parts[i] = (self.file.tell(), len(pos), pos.dtype)
                    self.file.write(pos.tobytes())
                    self.file.write(lcp.tobytes())
        self.held = 0

    def get(self, c: int, i: int):
        """Chunk i of bucket c; taken as it is, it gets no more tuples."""
        p = self.parts[c][i]
        if isinstance(p, list):
            p[2] = CHUNK + 1  # closed: what arrives now starts a new chunk
            return np.concatenate(p[0]), np.concatenate(p[1])
        at, n, kind = p
        self.file.seek(at)
        pos = np.frombuffer(self.file.read(n * kind.itemsize), dtype=kind)
        return pos, np.frombuffer(self.file.read(n * 2), dtype=np.int16)

    def count(self, c: int) -> int:
        return len(self.parts[c])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class RangeMin:
    """Range minima over one chunk (sparse table)."""

    def __init__(self, a: np.ndarray):
        self.levels = [a]
        span = 1
        while span * 2 <= len(a):
            prev = self.levels[-1]
            self.levels.append(np.minimum(prev[:-span], prev[span:]))
            span *= 2
        self.n = len(a)

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of a[lo..hi], both ends included."""
        width = hi - lo + 1
        level = np.frexp(width.astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int16)
        for k in np.unique(level):
            m = level == k
            t = self.levels[k]
            out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << int(k)) + 1])
        return out


class Shard:
    def __init__(self, bodies: list[bytes], cap: int, memory: int = 1 << 27):
        self.cap, self.memory = cap, memory
        size = sum(map(len, bodies)) + len(bodies)
        text = np.zeros(size, dtype=np.int16)
        starts = np.zeros(len(bodies), dtype=np.int64)
        at = 0
        for i, b in enumerate(bodies):
            starts[i] = at
            text[at:at + len(b)] = np.frombuffer(b, dtype=np.uint8)
            text[at:at + len(b)] += 1
            at += len(b) + 1
        self.text, self.starts = text, starts
        self.kind = np.int32 if size < 1 << 31 else np.int64
        change = np.empty(size, dtype=bool)
        change[:-1] = text[1:] != text[:-1]
        change[-1] = True
        end = np.where(change, np.arange(size, dtype=self.kind), self.kind(size))
        end = np.minimum.accumulate(end[::-1])[::-1]
        self.run_end = end
        nxt = np.append(text, np.int16(1))[end + 1]
        self.small = nxt > text[end]
        seed = np.zeros(size, dtype=bool)
        seed[1:] = self.small[1:] & ~self.small[:-1]
        self.seeds = np.flatnonzero(seed).astype(self.kind)

    def _run(self, p: int) -> int:
        return int(self.run_end[p]) - int(p) + 1

    def _border(self, a, b) -> int:
        """Common prefix of an L and an S suffix of one bucket."""
        return 0 if a is None or b is None else min(self._run(a), self._run(b), self.cap)

    def _take(self, queue: BucketQueue, pos, lcp, small: bool, carry: np.ndarray | None) -> None:
        """Put the suffixes before `pos` (in this order) into their buckets."""
        for i in range(0, len(pos), CHUNK):
            p, m = pos[i:i + CHUNK], lcp[i:i + CHUNK]
            before = p - 1
            c = self.text[before]
            idx = np.flatnonzero((c != 0) & (self.small[before] == small) & (p > 0))
            if len(idx) == 0:
                if carry is not None and len(m):
                    np.minimum(carry, m.min(), out=carry)
                continue
            c = c[idx]
            order = np.argsort(c, kind="stable")
            c, idx = c[order], idx[order]
            head = np.empty(len(c), dtype=bool)
            head[0] = True
            head[1:] = c[1:] != c[:-1]
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(c)) - 1
            if carry is None:
                got = np.zeros(len(idx), dtype=np.int16)
            else:
                rmq = RangeMin(m)
                lo = np.zeros(len(idx), dtype=np.int64)
                lo[1:] = idx[:-1] + 1
                lo[first] = 0
                got = rmq.query(lo, idx)
                got[first] = np.minimum(got[first], carry[c[first]])
                got = np.minimum(got + 1, self.cap).astype(np.int16)
                np.minimum(carry, m.min(), out=carry)
                tail = idx[last]
                after = np.full(len(last), BIG, dtype=np.int16)
                some = tail + 1 < len(m)
                if some.any():
                    after[some] = rmq.query(tail[some] + 1, np.full(int(some.sum()), len(m) - 1))
                carry[c[first]] = after
            before = before[idx]
            for a, b in zip(first, last + 1, strict=True):
                queue.put(int(c[a]), before[a:b], got[a:b])

    def sweep_left(self, seeds, seed_lcp, lcp: bool) -> BucketQueue:
        """L suffixes of every bucket in ascending order; seeds in order."""
        queue = BucketQueue(self.memory)
        carry = np.full(CHARS, -1, dtype=np.int16) if lcp else None
        bound = np.searchsorted(self.text[seeds], np.arange(CHARS + 1))
        for c in range(CHARS):
            i, tail = 0, None
            while i < queue.count(c):
                pos, m = queue.get(c, i)
                self._take(queue, pos, m, False, carry)
                tail, i = pos[-1], i + 1
            a, b = bound[c], bound[c + 1]
            if a < b:
                m = seed_lcp[a:b].copy()
                m[0] = self._border(tail, seeds[a])
                self._take(queue, seeds[a:b], m, False, carry)
        return queue

    def sweep_right(self, left: BucketQueue, lcp: bool) -> BucketQueue:
        """S suffixes of every bucket in descending order."""
        queue = BucketQueue(self.memory)
        carry = np.full(CHARS, -1, dtype=np.int16) if lcp else None
        for c in range(CHARS - 1, -1, -1):
            i, tail = 0, None
            while i < queue.count(c):
                pos, m = queue.get(c, i)
                self._take(queue, pos, m, True, carry)
                tail, i = pos[-1], i + 1
            above = None
            for i in range(left.count(c) - 1, -1, -1):
                pos, m = left.get(c, i)
                down = np.empty_like(m)
                down[:-1] = m[1:]
                down[-1] = self._border(pos[-1], tail) if above is None else above
                above = m[0]
                self._take(queue, pos[::-1], down[::-1], True, carry)
        return queue

    def sorted_seeds(self):
        """(seeds in suffix order, common prefix of each with the one before)."""
        seeds = self.seeds
        n = len(seeds)
        plain = np.argsort(self.text[seeds], kind="stable")
        zero = np.zeros(n, dtype=np.int16)
        left = self.sweep_left(seeds[plain], zero, lcp=False)
        right = self.sweep_right(left, lcp=False)
        is_seed = np.zeros(len(self.text), dtype=bool)
        is_seed[seeds] = True
        ends = seeds[self.text[seeds] == 0]
        got = [ends]
        for c in range(CHARS):
            for i in range(right.count(c) - 1, -1, -1):
                pos, _ = right.get(c, i)
                pos = pos[::-1]
                got.append(pos[is_seed[pos]])
        left.close()
        right.close()
        order = np.concatenate(got)
        index = np.full(len(self.text), -1, dtype=self.kind)
        index[seeds] = np.arange(n)
        order = index[order]

        # Names: equal seed substrings (to the next seed, terminators apart).
        data = (self.text - 1).astype(np.uint8)
        data[self.text == 0] = 0
        pre = Prefix61(data)
        nxt = np.append(seeds[1:], seeds[-1] + 1).astype(np.int64)
        body = self.text[seeds] != 0
        length = np.where(body, nxt - seeds + 1, 1)
        stop_is_end = body & (self.text[np.minimum(nxt, len(self.text) - 1)] == 0)
        h = pre.hash(seeds.astype(np.int64), seeds + length - stop_is_end)
        new = np.ones(n, dtype=bool)
        a, b = order[:-1], order[1:]
        new[1:] = ~((h[a] == h[b]) & (length[a] == length[b]) & (stop_is_end[a] == stop_is_end[b]) & body[a] & body[b])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        step = 1
        while step < self.cap:
            size = np.bincount(rank, minlength=n)
            tied = np.flatnonzero(size[rank] > 1)
            if len(tied) == 0:
                break
            second = rank[np.minimum(tied + step, n - 1)]
            o = np.argsort(rank[tied] * n + second, kind="stable")
            tied, r, s = tied[o], rank[tied][o], second[o]
            fresh_r = np.append(True, r[1:] != r[:-1])
            fresh = fresh_r | np.append(True, s[1:] != s[:-1])
            at = np.arange(len(r))
            rank[tied] = r + (np.maximum.accumulate(np.where(fresh, at, 0))
                              - np.maximum.accumulate(np.where(fresh_r, at, 0)))
            step *= 2
        order = np.argsort(rank, kind="stable")
        return seeds[order], self._seed_lcp(pre, seeds[order].astype(np.int64))

    def _seed_lcp(self, pre: Prefix61, pos: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours, by binary search over prefix hashes."""
        ends = np.flatnonzero(self.text == 0)
        left = np.minimum(ends[np.searchsorted(ends, pos)] - pos, self.cap)
        a, b = pos[:-1], pos[1:]
        hi = np.minimum(left[:-1], left[1:])
        # Eight bytes at once settle most pairs; equal ones are tried whole.
        data = np.append((self.text - 1).astype(np.uint8), np.zeros(8, np.uint8))
        words = np.ndarray(len(self.text), dtype=">u8", buffer=data.data, strides=(1,))
        diff = words[a].astype(np.uint64) ^ words[b].astype(np.uint64)
        lo = np.minimum(8 - (np.frexp(diff.astype(np.float64))[1] + 7) // 8, hi)
        # float rounding may count one bit too many at a byte border
        lo = np.where((lo < np.minimum(hi, 8)) & (data[a + lo] == data[b + lo]), lo + 1, lo)
        open_ = np.flatnonzero((lo >= 8) & (hi > 8))
        same = pre.raw(a[open_], a[open_] + hi[open_]) == pre.raw(b[open_], b[open_] + hi[open_])
        lo[open_[same]] = hi[open_[same]]
        open_ = open_[~same]
        top = hi.copy()
        top[open_] -= 1
        while len(open_):
            mid = (lo[open_] + top[open_] + 1) // 2
            same = pre.raw(a[open_], a[open_] + mid) == pre.raw(b[open_], b[open_] + mid)
            lo[open_[same]] = mid[same]
            top[open_[~same]] = mid[~same] - 1
            open_ = open_[lo[open_] < top[open_]]
        out = np.zeros(len(pos), dtype=np.int16)
        out[1:] = lo
        return out

    def repeated(self) -> np.ndarray:
        """Flag for each position of the text: its first `cap` bytes also
        start elsewhere in the shard."""
        seeds, seed_lcp = self.sorted_seeds()
        left = self.sweep_left(seeds, seed_lcp, lcp=True)
        right = self.sweep_right(left, lcp=True)
        flag = np.zeros(len(self.text), dtype=bool)
        for queue in (left, right):
            for c in range(1, CHARS):
                tail = None
                for i in range(queue.count(c)):
                    pos, m = queue.get(c, i)
                    hit = np.flatnonzero(m >= self.cap)
                    flag[pos[hit]] = True
                    flag[pos[hit[hit > 0] - 1]] = True
                    if len(hit) and hit[0] == 0 and tail is not None:
                        flag[tail] = True
                    tail = pos[-1]
        for c in range(1, CHARS):  # the largest L and the smallest S suffix of a bucket
            if left.count(c) and right.count(c):
                a = left.get(c, left.count(c) - 1)[0][-1]
                b = right.get(c, right.count(c) - 1)[0][-1]
                if self._border(a, b) >= self.cap:
                    flag[[a, b]] = True
        left.close()
        right.close()
        return flag


def repeated_starts(bodies: list[bytes], cap: int, memory: int = 1 << 27) -> list[np.ndarray]:
    """For each body, the positions whose next `cap` bytes occur elsewhere."""
    if not bodies:
        return []
    shard = Shard(bodies, cap, memory)
    flag = shard.repeated()
    out = []
    for s, b in zip(shard.starts, bodies, strict=True):
        out.append(np.flatnonzero(flag[s:s + len(b)]))
    return out
