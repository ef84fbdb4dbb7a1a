"""External induced sorting of suffixes, with common prefixes known up to a bound.

Suffixes of a string over bytes are sorted by induction: each suffix is of type S or L (smaller or larger than the one
behind it); the leftmost S suffixes are sorted first, then a queue takes suffixes in ascending order and gives each one's L
predecessor, and another in descending order gives the S predecessors. The queues are bulk priority queues: tuples of one
leading symbol form a bucket that is taken at once, and buckets that exceed the memory given wait in a scratch file. The
leftmost-S suffixes are sorted by the same induction on their substrings, named, and, where names repeat, by the names'
reduced string, whose order is needed only as far as `bound` symbols of the original and which is finished by doubling.
"""

from __future__ import annotations

import tempfile

import numpy as np

from tarja.llm.common import mix


class Queue:
    """Positions by bucket, in order of arrival; past `held` positions in memory, arrivals go to a scratch file."""

    def __init__(self, buckets: int, held: int = 8 << 20):
        self.parts: list[list] = [[] for _ in range(buckets)]
        self.held, self.now, self.file = held, 0, None

    def push(self, bucket: int, items: np.ndarray) -> None:
        if self.now + len(items) > self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile(prefix="queue-")
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(items.tobytes())
            self.parts[bucket].append((at, len(items), items.dtype))
        else:
            self.now += len(items)
            self.parts[bucket].append(items)

    def take(self, bucket: int) -> np.ndarray | None:
        parts, self.parts[bucket] = self.parts[bucket], []
        out = []
        for p in parts:
            if isinstance(p, tuple):
                self.file.seek(p[0])
                out.append(np.frombuffer(self.file.read(p[1] * p[2].itemsize), p[2]))
            else:
                self.now -= len(p)
                out.append(p)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _spread(queue: Queue, symbols: np.ndarray, items: np.ndarray) -> None:
    order = np.argsort(symbols, kind="stable")
    symbols, items = symbols[order], items[order]
    cuts = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(items)]
    for a, b in zip(cuts, cuts[1:]):
        queue.push(int(symbols[a]), items[a:b])


def _induce(s: np.ndarray, kind: np.ndarray, seeds: np.ndarray, sigma: int, held: int) -> tuple[list, list]:
    """Buckets of L suffixes ascending and of S suffixes descending, from leftmost-S suffixes in ascending order."""
    queue = Queue(sigma, held)
    cuts = np.searchsorted(s[seeds], np.arange(sigma + 1))  # seeds ascend, and so do their first symbols
    large: list[np.ndarray | None] = [None] * sigma
    for c in range(sigma):
        now, done = queue.take(c), []
        while now is not None and len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[~kind[before]]
            symbols = s[before]
            same = symbols == c
            if not same.all():
                _spread(queue, symbols[~same], before[~same])
            now = before[same]
        if done:
            large[c] = np.concatenate(done)
        own = seeds[cuts[c] : cuts[c + 1]]
        if len(own):
            before = own[own > 0] - 1
            before = before[~kind[before]]
            if len(before):
                _spread(queue, s[before], before)
    queue.close()
    queue = Queue(sigma, held)
    small: list[np.ndarray | None] = [None] * sigma
    for c in range(sigma - 1, -1, -1):
        now, done = queue.take(c), []
        while now is not None and len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[kind[before]]
            symbols = s[before]
            same = symbols == c
            if not same.all():
                _spread(queue, symbols[~same], before[~same])
            now = before[same]
        if done:
            small[c] = np.concatenate(done)
        if large[c] is not None:
            own = large[c][::-1]
            before = own[own > 0] - 1
            before = before[kind[before]]
            if len(before):
                _spread(queue, s[before], before)
    queue.close()
    return large, small


def sorted_suffixes(s: np.ndarray, bound: int, held: int = 8 << 20) -> np.ndarray:
    """Positions of s by suffix; suffixes that agree for `bound` symbols may stand in any order among themselves.

    s: symbols (uint16) that end with a 0 which occurs nowhere else."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    step = np.sign(s[1:].astype(np.int32) - s[:-1])  # > 0: smaller than the next
    turn = np.where(step != 0, np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    kind = np.r_[step[turn] > 0, True]
    leftmost = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    sigma = int(s.max()) + 1
    seeds = leftmost[np.argsort(s[leftmost], kind="stable")]
    _, small = _induce(s, kind, seeds, sigma, held)
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    parts = [x[::-1] for x in small if x is not None]
    order = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    order = np.r_[n - 1, order[is_left[order] & (order != n - 1)]]  # the leftmost S substrings, sorted
    # names: equal substrings (up to and with the next leftmost S position) get one name
    with np.errstate(over="ignore"):
        power = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, 0x5851F42D4C957F2D, np.uint64), out=power[1:])
        total = np.r_[np.uint64(0), np.cumsum(mix(s.astype(np.uint64), 3) * power[:-1], dtype=np.uint64)]
        rank_of = np.cumsum(is_left) - 1
        end = np.minimum(np.r_[leftmost[1:], n - 1][rank_of[order]] + 1, n)
        # compare neighbours by the content's hash, shifted to a common power
        value = total[end] - total[order]
        size = end - order
        a, b = np.arange(len(order) - 1), np.arange(1, len(order))
        new = (size[a] != size[b]) | (value[a] * power[np.maximum(0, order[b] - order[a])] != value[b] * power[np.maximum(0, order[a] - order[b])])
    rank = np.zeros(len(order), np.int64)
    rank[rank_of[order]] = np.r_[0, np.cumsum(new)]
    # the reduced string, as far as `bound` symbols reach (a leftmost S position comes every two symbols at most)
    reach = 1
    while reach * 2 <= bound + 2 and rank.max() + 1 < len(rank):
        follow = np.r_[rank[reach:], np.zeros(min(reach, len(rank)), np.int64)][: len(rank)] + 1
        follow[max(0, len(rank) - reach) :] = 0
        key = rank * (len(rank) + 2) + follow
        by = np.argsort(key, kind="stable")
        rank = rank.copy()
        rank[by] = np.cumsum(np.r_[False, key[by][1:] != key[by][:-1]])
        reach *= 2
    large, small = _induce(s, kind, leftmost[np.argsort(rank, kind="stable")], sigma, held)
    out = []
    for c in range(sigma):
        if large[c] is not None:
            out.append(large[c])
        if small[c] is not None:
            out.append(small[c][::-1])
    order = np.concatenate(out)
    return order if len(order) == n else np.r_[n - 1, order]


def same_prefix(s: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares `length` symbols with the one before it in the order (False for the first). s: uint8, and
    every suffix in order has `length` symbols."""
    data = np.ascontiguousarray(np.r_[s, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(s) + 1,), "<u8", data, strides=(1,))
    out = np.ones(len(order), bool)
    out[:1] = False
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]:
        at = np.flatnonzero(out)
        out[at] = eight[order[at] + k] == eight[order[at - 1] + k]
    if length < 8:
        for k in range(length):
            out[1:] &= s[order[1:] + k] == s[order[:-1] + k]
    return out
