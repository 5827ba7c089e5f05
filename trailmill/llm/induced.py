"""Sorted suffixes with common-prefix lengths by external induced sorting.

All arrays as long as the text are mapped from task-local files, and tuples wait in queues that spill to
one, so memory follows neither the text nor the recursion, only BATCH and HELD. The queues of a pass, one
for each bucket of symbols, are one priority queue: tuples arrive in the order of the suffix after them, so
popping bucket after bucket, first in first out, gives them by (symbol, suffix after).

A level of the recursion names the stretches between its starting suffixes (those smaller than both
neighbours' suffixes) by a first induction, sorts the text of names, which is at most half as long, by
another level, and induces the order of all its suffixes from that. Names are the places of their first
stretch, so BATCH neighbouring names stand for BATCH suffixes at most, besides those of the last of them.
On the text itself the tuples of the last induction carry common prefixes, too: those of the starting
suffixes are measured in text order, where each is at least the one before less the distance, and each
induced one follows from the least among the tuples between.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Suffixes that are handled at once.
BATCH = 1 << 18
#: Bytes of tuples that a pass keeps in memory.
HELD = 1 << 24
#: Texts of names up to this length are sorted in memory.
BASE = 1 << 15
#: In so many rounds the common prefixes of starting suffixes are measured, each from those of the round before.
STRIDE = 64
TUPLE = np.dtype([("pos", "<i8"), ("lcp", "<u2")])
PAD = 1024


def mapped(n: int, dtype: str | type) -> np.ndarray:
    """`n` zeros, mapped from a nameless file that goes with the array; few of them are in memory."""
    size = n * np.dtype(dtype).itemsize
    if size <= 1 << 16:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(size)
        return np.memmap(f, dtype, "r+", shape=(n,))


def spans(n: int) -> Iterator[slice]:
    return (slice(at, min(at + BATCH, n)) for at in range(0, n, BATCH))


class Spool:
    """Queues of tuples, one for each bucket; beyond `held` bytes all go to one file, block after block."""

    def __init__(self, buckets: int, dtype: str | np.dtype, held: int | None = None):
        self.blocks = [deque() for _ in range(buckets)]
        self.dtype = np.dtype(dtype)
        self.limit = (HELD if held is None else held) // self.dtype.itemsize
        self.held, self.file, self.end = 0, None, 0

    def push(self, bucket: int, block: np.ndarray) -> None:
        if len(block):
            self.blocks[bucket].append(block if block.base is None else block.copy())  # else the array it is cut from stays, too
            self.held += len(block)
            if self.held > self.limit:
                self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for queue in self.blocks:
            tail = []
            while queue and isinstance(queue[-1], np.ndarray):
                tail.append(queue.pop())
            if tail:
                block = np.concatenate(tail[::-1])
                for part in spans(len(block)):
                    size = os.pwrite(self.file.fileno(), block[part].tobytes(), self.end)
                    queue.append((self.end, size // self.dtype.itemsize))
                    self.end += size
        self.held = 0

    def _load(self, block: np.ndarray | tuple[int, int]) -> np.ndarray:
        if isinstance(block, np.ndarray):
            self.held -= len(block)
            return block
        return np.frombuffer(os.pread(self.file.fileno(), block[1] * self.dtype.itemsize, block[0]), self.dtype)

    def take(self, bucket: int, back: bool = False) -> np.ndarray:
        """About BATCH tuples from the front, or from the back and then the last one first."""
        queue, out, n = self.blocks[bucket], [], 0
        while queue:
            block = queue[-1 if back else 0]
            size = len(block) if isinstance(block, np.ndarray) else block[1]
            if out and n + size > BATCH:
                break
            out.append(self._load(queue.pop() if back else queue.popleft()))
            n += size
        if not out:
            return np.zeros(0, self.dtype)
        return np.concatenate(out[::-1])[::-1] if back else np.concatenate(out)

    def rest(self, bucket: int, back: bool = False) -> np.ndarray:
        out = []
        while self.blocks[bucket]:
            out.append(self.take(bucket, back))
        return np.concatenate(out) if out else np.zeros(0, self.dtype)


class Level:
    """One text of the recursion. Its buckets ascend: for every `width` symbols all but the last, then the last."""

    def __init__(self, text: np.ndarray, n: int, width: int, last: np.ndarray):
        self.t, self.n, self.width, self.last = text, n, width, last
        self.kind = np.dtype("<u4") if n < 1 << 32 else np.dtype("<i8")

    def bucket(self, symbols: np.ndarray) -> np.ndarray:
        group = symbols // self.width
        return 2 * group.astype(np.int64) + (symbols == self.last[group])

    def stars(self) -> np.ndarray:
        """Starting suffixes in text order: smaller than the suffix after them, where the one before is larger than its next."""
        out, free = mapped(self.n // 2 + 1, self.kind), self.n // 2 + 1
        hi, after, rising = self.n, -1, False  # symbol at `hi` and whether its suffix is smaller than the next
        while hi > 0:
            lo = max(hi - BATCH, 0)
            x = np.append(self.t[lo:hi].astype(np.int64), after)
            differ = x[:-1] != x[1:]
            at = np.where(differ, np.arange(len(differ)), len(differ))
            at = np.minimum.accumulate(at[::-1])[::-1]  # the first from here on that differs from its next
            small = np.append(np.append(x[:-1] < x[1:], rising)[at], rising)
            found = np.flatnonzero(small[1:] & ~small[:-1]) + lo + 1  # may be `hi`, whose symbol belongs to the part after
            out[free - len(found) : free] = found
            free -= len(found)
            hi, after, rising = lo, int(x[0]), bool(small[0])
        return out[free:]

    def spooled(self, pos: np.ndarray) -> Spool:
        """Positions dealt to their buckets in the order given."""
        out = Spool(2 * len(self.last), self.kind)
        for part in spans(len(pos)):
            block = np.asarray(pos[part])
            self._push(out, block, self.bucket(self.t[block]))
        return out

    def _push(self, queues: Spool, pos: np.ndarray, bucket: np.ndarray) -> None:
        if 2 * len(self.last) < 1 << 16:
            bucket = bucket.astype(np.uint16)  # a radix sort
        if not len(pos):
            return
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for k, block in zip(bucket[heads].tolist(), np.split(pos[order].astype(self.kind), heads[1:]), strict=True):
            queues.push(k, block)

    def _before(self, pos: np.ndarray, equal: bool | np.ndarray, down: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which suffixes have one before them that they induce, and that one's symbol. equal: a like symbol counts."""
        before, here = self.t[np.maximum(pos, 1) - 1], self.t[pos]
        return (pos > 0) & ((before < here if down else before > here) | (before == here) & equal), before

    def _deal(self, queues: Spool, pos: np.ndarray, equal: bool | np.ndarray, down: bool, apart: int = -1) -> None:
        good, before = self._before(pos, equal, down)
        bucket = self.bucket(before[good])
        far = bucket != apart
        self._push(queues, pos[good][far] - 1, bucket[far])

    def scan(self, seeds: Spool, down: bool) -> Iterator[tuple[int, np.ndarray, bool | np.ndarray]]:
        """(bucket, positions in order, whether they were induced or else seeds), the least first or, `down`, the largest.

        Upwards, suffixes larger than their next are induced from sorted starting ones; downwards, those smaller
        from all larger ones. Among suffixes of a like first symbol the induced ones come first either way.
        """
        queues = Spool(2 * len(self.last), self.kind)
        if not down:  # nothing follows the last suffix, which is less than anything
            self._push(queues, np.array([self.n - 1]), self.bucket(self.t[self.n - 1 : self.n]))
        for b in range(2 * len(self.last) - 1, -1, -1) if down else range(2 * len(self.last)):
            if b % 2:
                while queues.blocks[b]:
                    pos = queues.take(b).astype(np.int64)
                    yield b, pos, True
                    self._deal(queues, pos, True, down)
                while seeds.blocks[b]:
                    pos = seeds.take(b, down).astype(np.int64)
                    yield b, pos, False
                    self._deal(queues, pos, False, down)
            elif queues.blocks[b] or seeds.blocks[b]:
                pos, own = self._closed(queues.rest(b).astype(np.int64), seeds.rest(b, down).astype(np.int64), b, down)
                for part in spans(len(pos)):
                    yield b, pos[part], own[part]
                    self._deal(queues, pos[part], own[part], down, b)

    def _closed(self, came: np.ndarray, seeds: np.ndarray, b: int, down: bool) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes of a bucket of several symbols, in order: those that came, the seeds, and what they induce here.

        Order is by symbol, then what came, then what is induced here by the suffix after it, then seeds. The
        chains of suffixes that induce each other are compared by doubling.
        """
        given = len(came) + len(seeds)
        found, parents = [np.concatenate((came, seeds))], [np.arange(given)]
        front, ids, equal, n = found[0], parents[0], np.arange(given) < len(came), given
        while len(front):
            good, before = self._before(front, equal, down)
            good[good] = self.bucket(before[good]) == b
            front, parent, equal = front[good] - 1, ids[good], True
            ids = n + np.arange(len(front))
            n += len(front)
            found.append(front)
            parents.append(parent)
        pos, up = np.concatenate(found), np.concatenate(parents)
        symbol = self.t[pos].astype(np.int64)
        symbol = symbol.max() - symbol if down else symbol - symbol.min()
        at = np.arange(n)
        own = (at < len(came)) | (at >= given)
        kind = np.where(own, (at >= given).astype(np.int64), 2)
        key, rank = (symbol * 3 + kind) * (n + 1) + np.where(at < given, at, 0), np.empty(n, np.int64)
        while True:
            order = np.argsort(key)
            new = np.append(True, key[order[1:]] != key[order[:-1]])
            rank[order] = np.cumsum(new) - 1
            if new.all():
                return pos[order], own[order]
            key, up = rank * n + rank[up], up[up]

    def _named(self, stars: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """The text of names, the last name of each BATCH of them, and whether all differ.

        `order` has the starting suffixes by their stretches up to the next one and its symbol; alike ones are compared.
        """
        m = len(stars)
        which = mapped(self.n // 2 + 1, self.kind)  # no two of them are neighbours
        for part in spans(m):
            which[stars[part] // 2] = np.arange(part.start, part.stop)
        names, last = mapped(m, self.kind), np.zeros(-(-m // BATCH), np.int64)
        before, name, unique = -1, 0, True
        for part in spans(m):
            pos = order[part].astype(np.int64)
            prev = np.append(before if before >= 0 else pos[0], pos[:-1])
            mine, other = which[pos // 2].astype(np.int64), which[prev // 2].astype(np.int64)
            size = np.where(mine + 1 < m, stars[np.minimum(mine + 1, m - 1)], -1).astype(np.int64) - pos
            like = (size > 0) & (other + 1 < m) & (mine != other)
            like &= stars[np.minimum(other + 1, m - 1)].astype(np.int64) - prev == size
            live, k = np.flatnonzero(like), 0
            while len(live):
                same = self.t[pos[live] + k] == self.t[prev[live] + k]
                like[live[~same]] = False
                k += 1
                live = live[same]
                live = live[size[live] >= k]
            unique &= not like.any()
            place = np.maximum.accumulate(np.where(like, name, np.arange(part.start, part.stop)))
            names[mine] = place
            np.maximum.at(last, place // BATCH, place)
            before, name = int(pos[-1]), int(place[-1])
        return names, last, unique

    def sorted_stars(self) -> np.ndarray:
        """Starting suffixes from the least to the largest."""
        stars = self.stars()
        m = len(stars)
        if m < 2:
            return stars
        larger = self._larger(self.spooled(stars))
        order, free = mapped(m, self.kind), 0
        for _, pos, own in self.scan(larger, down=True):
            before = self.t[np.maximum(pos, 1) - 1]
            pos = pos[(pos > 0) & (before > self.t[pos]) & own]
            order[m - free - len(pos) : m - free] = pos[::-1]
            free += len(pos)
        names, last, unique = self._named(stars, order)
        if unique:
            return order
        places = _in_memory(np.asarray(names)) if m <= BASE else Level(names, m, BATCH, last).sorted_suffixes()
        for part in spans(m):
            order[part] = stars[places[part]]
        return order

    def _larger(self, seeds: Spool) -> Spool:
        out = Spool(2 * len(self.last), self.kind)
        for b, pos, own in self.scan(seeds, down=False):
            out.push(b, (pos if own is True else pos[own] if own is not False else pos[:0]).astype(self.kind))
        return out

    def sorted_suffixes(self) -> np.ndarray:
        """All suffixes from the least to the largest."""
        larger = self._larger(self.spooled(self.sorted_stars()))
        out, free = mapped(self.n, self.kind), self.n
        for _, pos, _ in self.scan(larger, down=True):
            out[free - len(pos) : free] = pos[::-1]
            free -= len(pos)
        return out


def _in_memory(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a short text, by doubling."""
    n, step, rank = len(names), 1, names.astype(np.int64)
    key = rank
    while True:
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order[1:]] != key[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        key = rank * (n + 1) + np.append(rank[step:], np.zeros(min(step, n), np.int64))[:n]
        step *= 2


class Prefixes:
    """The last induction on a text of bytes: its tuples carry common prefixes, up to `depth`.

    `text` has PAD bytes 255 after its `n` own, which are less; it has no other 255.
    """

    def __init__(self, text: np.ndarray, n: int, depth: int):
        self.t, self.n, self.depth = text, n, depth
        self.words = np.ndarray(len(text) - 7, "<u8", buffer=text, strides=(1,))

    def common(self, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes that are known to share `least` bytes, eight bytes at a time."""
        out = least.astype(np.int64)
        live = np.flatnonzero(out < self.depth)
        while len(live):
            x = self.words[a[live] + out[live]] ^ self.words[b[live] + out[live]]
            out[live] += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            live = live[(x == 0) & (out[live] < self.depth)]
        return np.minimum(out, self.depth)

    def measured(self, stars: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The common prefix of each of `order` with the one before, from `stars`, the same in text order."""
        m = len(order)
        which = mapped(self.n // 2 + 1, "<u4" if self.n < 1 << 32 else "<i8")
        for part in spans(m):
            which[stars[part] // 2] = np.arange(part.start, part.stop)
        before = mapped(m, order.dtype)
        for part in spans(m):
            prev = order[max(part.start - 1, 0) : part.stop - 1]
            before[which[order[part.stop - len(prev) : part.stop] // 2]] = prev
        if m:
            before[which[order[0] // 2]] = order[0]
        found = mapped(m, "<u2")
        for k in range(min(STRIDE, m)):
            for part in spans(-(-(m - k) // STRIDE)):
                at = k + STRIDE * np.arange(part.start, part.stop)
                a, b = stars[at].astype(np.int64), before[at].astype(np.int64)
                least = np.zeros(len(at), np.int64)
                if k:
                    # sure only where the match reaches the next start, which makes this one a start on both sides
                    shared, prev = found[at - 1].astype(np.int64), stars[at - 1].astype(np.int64)
                    sure = (at + 1 < m) & (stars[np.minimum(at + 1, m - 1)].astype(np.int64) < prev + shared)
                    least = np.where(sure, shared - (a - prev), 0)
                least[a == b] = self.depth  # the first of all has none before it
                found[at] = np.where(a == b, 0, self.common(a, b, least))
        out = mapped(m, "<u2")
        for part in spans(m):
            out[part] = found[which[order[part] // 2]]
        return out

    def _run(self, pos: int) -> int:
        """Bytes equal to the one at `pos` from there on."""
        differ = np.flatnonzero(self.t[pos : pos + self.depth] != self.t[pos])
        return int(differ[0]) if len(differ) else self.depth

    def _deal(self, queues: Spool, pos: np.ndarray, lcp: np.ndarray, state: np.ndarray, equal: bool, down: bool) -> None:
        """Send the suffixes before `pos` that it induces to the queues of their bytes.

        `state` has, for each byte, the least common prefix among all tuples scanned since its last one (or
        -1 where there was none).
        """
        before, here = self.t[np.maximum(pos, 1) - 1], self.t[pos[0]]  # all of one byte
        good = (pos > 0) & ((before < here if down else before > here) | (before == here) & equal)
        order = np.flatnonzero(good)
        char = before[order]
        order = order[np.argsort(char, kind="stable")]  # bytes: a radix sort
        counts = np.bincount(char, minlength=256)
        chars = np.flatnonzero(counts)
        bounds = np.concatenate(([0], np.cumsum(counts[chars])))
        lows = np.minimum.accumulate(lcp)
        for k, c in enumerate(chars.tolist()):
            at = order[bounds[k] : bounds[k + 1]]
            # from after each tuple up to the next one
            least = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1)).astype(np.int64)
            least[0] = min(int(lows[at[0]]), int(state[c])) if state[c] >= 0 else -1
            block = np.empty(len(at), TUPLE)
            block["pos"], block["lcp"] = pos[at] - 1, np.minimum(least + 1, self.depth)
            queues.push(c, block)
            state[c] = int(lcp[at[-1] + 1 :].min()) if at[-1] + 1 < len(lcp) else self.depth
        quiet = state >= 0
        quiet[chars] = False
        state[quiet] = np.minimum(state[quiet], int(lows[-1]))

    def _scan(self, seeds: Spool, down: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """As Level.scan, for each byte, with the common prefix of each tuple with the one before."""
        queues, state = Spool(256, TUPLE), np.full(256, -1, dtype=np.int64)
        if not down:
            c = int(self.t[self.n - 1])
            queues.push(c, np.array([(self.n - 1, 0)], TUPLE))
            state[c] = 0
        for c in range(255, -1, -1) if down else range(256):
            last = -1
            while queues.blocks[c]:
                x = queues.take(c)
                pos, lcp = x["pos"].copy(), x["lcp"].astype(np.int64)
                last = int(pos[-1])
                yield c, pos, lcp, True
                self._deal(queues, pos, lcp, state, True, down)
            carried = None
            while seeds.blocks[c]:
                x = seeds.take(c, down)
                pos, lcp = x["pos"].copy(), x["lcp"].astype(np.int64)
                if down:  # each has the common prefix with the one that comes after it here
                    lcp, carried = np.append(-1 if carried is None else carried, lcp[:-1]), int(lcp[-1])
                if last != -2:  # the first seed: bytes of one run, smaller and larger after it
                    lcp[0] = min(self._run(last), self._run(int(pos[0]))) if last >= 0 else 0
                    last = -2
                yield c, pos, lcp, False
                self._deal(queues, pos, lcp, state, False, down)

    def suffixes(self, order: np.ndarray, shared: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From sorted starting suffixes to all, the largest first: (positions, common prefix with the one before)."""
        seeds, larger = Spool(256, TUPLE), Spool(256, TUPLE)
        for part in spans(len(order)):
            block = np.empty(part.stop - part.start, TUPLE)
            block["pos"], block["lcp"] = order[part], shared[part]
            char = self.t[order[part]]
            heads = np.flatnonzero(np.append(True, char[1:] != char[:-1]))  # in order, so each byte's are together
            for c, x in zip(char[heads].tolist(), np.split(block, heads[1:]), strict=True):
                seeds.push(c, x)
        for c, pos, lcp, own in self._scan(seeds, down=False):
            if own:
                block = np.empty(len(pos), TUPLE)
                block["pos"], block["lcp"] = pos, lcp
                larger.push(c, block)
        for _, pos, lcp, _ in self._scan(larger, down=True):
            yield pos, lcp


def repeated(text: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Whether the `depth` bytes from each of the first `n` positions on also start elsewhere.

    `text` has PAD bytes 255 after its `n` own. 0 stands for a break between parts and belongs to no stretch;
    PAD must exceed `depth` by 8.
    """
    out = mapped(n, bool)
    if n == 0:
        return out
    level = Level(text, n, 1, np.arange(256))
    order, before = level.sorted_stars(), -1
    prefixes = Prefixes(text, n, depth)
    shared = prefixes.measured(level.stars(), order)
    for pos, lcp in prefixes.suffixes(order, shared):
        deep = lcp >= depth
        out[pos[deep]] = True
        out[pos[:-1][deep[1:]]] = True
        if deep[0] and before >= 0:
            out[before] = True
        before = int(pos[-1])
    room = n  # the first break from a position on
    for part in reversed(list(spans(n))):
        at = np.where(text[part] == 0, np.arange(part.start, part.stop), room)
        at[-1] = min(at[-1], room)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[part] &= np.arange(part.start, part.stop) + depth <= at
        room = int(at[0])
    return out
