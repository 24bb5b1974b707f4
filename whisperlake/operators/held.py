"""A graph that a task holds whole: searches from many vertices at once, a bit for each, and pairs counted layer by layer.

Vertices stand in layers, by their hops from an end of their component, and an edge goes from a layer to itself or to the
next. What a vertex knows of all that lies beyond a layer is how far each place of that layer is, so that sources whose
distances to a layer differ by a constant only go on as one. A long graph of narrow layers soon has few such kinds, and
its pairs take time in proportion to its length instead of its square. Nothing is estimated: wide components are searched
from every vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast

#: A search in a task is from 64 * WORDS sources at once
WORDS = 8
#: Components of more vertices than SMALL, with layers of at most WIDE, are counted layer by layer
SMALL, WIDE = 4096, 1000
#: So few kinds of sources are carried to the end by one search, as are more if they are not so few PATIENCE layers behind the last source
FEW, PATIENCE = 64, 32
#: Layers whose places are further apart than 2 * REACH hops are no short cut: what is left is searched from every vertex
REACH = 32


class Graph:
    """Edges of numbered vertices, each once, as lists of neighbours in an order in which neighbours are close: by component, then by hops from an end of it."""

    def __init__(self, ends: np.ndarray, others: np.ndarray):
        self.size = int(max(ends.max(), others.max())) + 1
        self._arrange(ends, others)
        part = self._parts()
        starts = np.flatnonzero(part == np.arange(self.size))
        for _ in range(2):  # what is furthest from the first vertex is an end
            depth = np.zeros(self.size, np.int32)
            for k, reached in enumerate(self.layers(starts)):
                depth[reached] = k
            order = np.lexsort((depth, part))
            starts = order[np.flatnonzero(np.diff(part[order], append=-1))]
        #: the vertex at each place
        self.vertex = order.astype(np.int32)
        self.place = np.empty(self.size, np.int32)
        self.place[self.vertex] = np.arange(self.size, dtype=np.int32)
        part, depth = part[order], depth[order]
        at = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(depth, prepend=-1) != 0))
        #: where each layer begins, and with which layer each component does
        self.edge, self.first = np.append(at, self.size), np.append(np.flatnonzero(depth[at] == 0), len(at))
        self._arrange(self.place[ends], self.place[others])

    def _arrange(self, ends: np.ndarray, others: np.ndarray) -> None:
        n, key = len(ends), np.empty(2 * len(ends), np.int64)  # in place, since a graph may fill much of a task's memory
        key[:n], key[n:] = ends, others
        key *= self.size
        key[:n] += others
        key[n:] += ends
        key.sort()
        self.start = np.searchsorted(key, np.arange(self.size + 1, dtype=np.int64) * self.size)
        key %= self.size
        self.near = key.astype(np.int32)

    def _parts(self) -> np.ndarray:
        """The least vertex of each one's component."""
        low = np.arange(self.size, dtype=np.int32)
        while True:
            least = np.minimum(low, np.minimum.reduceat(low[self.near], self.start[:-1]))
            new = low.copy()
            np.minimum.at(new, low, least)
            new = np.minimum(new, least)
            while (new != new[new]).any():
                new = new[new]
            if (new == low).all():
                return low
            low = new

    def main(self) -> tuple[int, int]:
        """From which layer to which the largest component goes (ties: that of the least vertex)."""
        k = int(np.argmax(np.diff(self.edge[self.first])))
        return int(self.first[k]), int(self.first[k + 1])

    def slots(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the neighbours of these vertices stand in ``near``, and where each one's begin among them."""
        counts = self.start[of + 1] - self.start[of]
        first = np.cumsum(counts) - counts
        return np.repeat(self.start[of] - first, counts) + np.arange(counts.sum()), first

    def layers(self, sources: np.ndarray) -> Iterator[np.ndarray]:
        """The vertices 0, 1, 2, ... hops from the nearest of ``sources``."""
        seen, front = np.zeros(self.size, bool), sources
        while len(front):
            seen[front] = True
            yield front
            found = self.near[self.slots(front)[0]]
            front = np.unique(found[~seen[found]])

    def _spread(self, begin: list[tuple[np.ndarray, np.ndarray]], low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After 0, 1, 2, ... hops the places that bits came to, from ``low`` on, and their new bits; ``begin`` are those set at each hop.

        Only places from ``low`` up to ``high``, whole layers of a component or whole components, are gone to.
        """
        size, words = high - low, begin[0][1].shape[1]
        seen, marked = np.zeros((size + 1, words), np.uint64), np.zeros(size + 1, bool)  # the last row stands for all other places
        now, every = seen.copy(), np.bitwise_or.reduce(np.concatenate([b for _, b in begin]))
        front = np.empty(0, np.int64)

        def near(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            where, first = self.slots(of + low)
            found = self.near[where] - low
            return np.where((found >= 0) & (found < size), found, size), first

        for hop in range(2 * self.size):
            marked[near(front)[0]] = True
            places, bits = begin[hop] if hop < len(begin) else (front[:0], now[:0])
            marked[places] = True
            maybe = np.flatnonzero(marked[:size])
            marked[maybe] = False
            maybe = maybe[(seen[maybe] != every).any(axis=1)]
            new = now[:0]
            if len(maybe):
                beside, first = near(maybe)
                new = np.bitwise_or.reduceat(now[beside], first, axis=0)
                at = np.searchsorted(maybe, places)
                own = np.append(maybe, -1)[at] == places
                new[at[own]] |= bits[own]
                new &= ~seen[maybe]
            some = new.any(axis=1)
            now[front] = 0
            front, new = maybe[some], new[some]
            if not len(front) and hop + 1 >= len(begin):
                return
            now[front] = new
            seen[front] |= new
            yield front, new

    def pairs(self, sources: np.ndarray) -> np.ndarray:
        """How many places lie 0, 1, 2, ... hops from the sources, which are places in ascending order."""
        return np.array([np.bitwise_count(new).sum() for _, new in self._spread([(sources, _bits(len(sources)))], 0, self.size)], np.int64)

    def between(self, layer: int, first: int, last: int) -> np.ndarray | None:
        """Hops from each place of a layer to those of it and of the next one, within the component of layers ``first`` to ``last``; none if more than 2 * REACH.

        A path that leaves the layers so many (``reach``) before and behind has 2 * reach + 1 hops at least before it is back.
        """
        low, high, n = self.edge[layer], self.edge[min(layer + 2, last)], self.edge[layer + 1] - self.edge[layer]
        reach = 4
        while reach <= REACH:
            a, b = self.edge[max(first, layer - reach)], self.edge[min(layer + 2 + reach, last)]
            near = self.near[self.start[a] : self.start[b]] - a
            near[(near < 0) | (near >= b - a)] = b - a  # a row without a bit
            begin = self.start[a:b] - self.start[a]
            seen = np.zeros((b - a + 1, -(-n // 64)), np.uint64)
            seen[low - a : low - a + n] = _bits(n)
            every, hops = np.bitwise_or.reduce(seen), np.zeros((high - low, n), np.int32)
            for _ in range(2 * reach + 1):
                own = seen[low - a : high - a]
                if (own == every).all():
                    return hops.T
                hops += 1 - np.unpackbits(own.view(np.uint8), axis=1, count=n, bitorder="little")
                seen[:-1] |= np.bitwise_or.reduceat(seen[near], begin, axis=0)
            reach *= 2
        return None

    def _onward(self, layer: int, last: int, far: np.ndarray) -> np.ndarray:
        """(kinds, hops): how many places behind a layer lie so many hops from each kind of sources, which are ``far`` from the layer's places."""
        low, high = self.edge[layer], self.edge[last]
        width, own, begin = self.edge[layer + 1] - low, _bits(len(far)), []
        for k in range(int(far.max()) + 1):
            there = far == k
            places = np.flatnonzero(there.any(axis=0))
            begin.append((places, np.array([np.bitwise_or.reduce(own[there[:, x]], axis=0) for x in places], np.uint64).reshape(len(places), own.shape[1])))
        found = []
        for front, new in self._spread(begin, low, high):
            new = new[front >= width]
            found.append(np.unpackbits(new.view(np.uint8), axis=1, count=len(far), bitorder="little").sum(axis=0, dtype=np.int64))
        return np.array(found).T

    def _later(self, sources: np.ndarray, first: int, last: int) -> np.ndarray:
        """How many ordered pairs lie 0, 1, 2, ... hops apart, of a source and a place in its layer, and twice of it and one in a later layer."""
        own, low = _bits(len(sources)), self.edge[first]
        layer = np.searchsorted(self.edge, sources, "right")
        at = np.unique(layer)
        # the searches from a layer, and from those before it
        level = np.array([np.bitwise_or.reduce(own[layer == k]) for k in at])
        before = np.bitwise_or.accumulate(np.concatenate([np.zeros_like(level[:1]), level]))
        found = []
        for front, new in self._spread([(sources - low, own)], int(low), int(self.edge[last])):
            there = np.searchsorted(self.edge, front + low, "right")
            k = np.searchsorted(at, there)
            same = new & level[np.minimum(k, len(at) - 1)]
            same[(k == len(at)) | (at[np.minimum(k, len(at) - 1)] != there)] = 0
            found.append(2 * int(np.bitwise_count(new & before[k]).sum()) + int(np.bitwise_count(same).sum()))
        return np.array(found, np.int64)

    def along(self, low: int, high: int, first: int, last: int) -> np.ndarray:
        """How many ordered pairs lie 0, 1, 2, ... hops apart, of a place from ``low`` up to ``high`` and one in its layer, and twice of it and one in a later layer.

        Over all places of a component these are its ordered pairs. ``far`` has a row for each kind of sources: the hops to
        the places of the layer, less those to the nearest; a kind's sources are counted by how far they are from that.
        """
        counts, n = np.zeros(2 * (last - first), np.int64), 64 * WORDS
        far = kind = off = number = np.empty(0, np.int64)

        def count(times: int, far: np.ndarray, kind: np.ndarray, off: np.ndarray, number: np.ndarray) -> None:
            for k in range(0, len(kind), 2048):
                some = slice(k, k + 2048)
                hops = off[some, None] + far[kind[some]]
                found = np.bincount(hops.ravel(), np.repeat(times * number[some], far.shape[1])).astype(np.int64)  # sums are far below 2**53
                counts[: len(found)] += found

        layer = int(np.searchsorted(self.edge, low, "right")) - 1
        end = int(np.searchsorted(self.edge, high, "left"))  # the first layer without a source
        while True:
            begin = self.edge[layer]
            far = far.reshape(-1, self.edge[layer + 1] - begin)
            count(2, far, kind, off, number)
            hops = None if layer >= end and (len(far) <= FEW or layer > end + PATIENCE) else self.between(layer, first, last)
            if hops is None:
                break
            if layer < end:
                own = hops[max(low - begin, 0) : high - begin, : far.shape[1]]
                new = np.arange(len(own))
                count(1, own, new, new * 0, new * 0 + 1)
                far, kind = np.concatenate([far, own]), np.append(kind, len(far) + new)
                off, number = np.append(off, new * 0), np.append(number, new * 0 + 1)
            if layer + 1 == last:
                return counts
            far = _shortest(far, hops[:, len(hops) :])
            least = far.min(axis=1)
            far, merged = _distinct(far - least[:, None])
            # sources of one kind at one distance are one number
            key, which = np.unique(merged[kind] * len(counts) + off + least[kind], return_inverse=True)
            kind, off, number = key // len(counts), key % len(counts), np.bincount(which, number).astype(np.int64)
            layer += 1
        for k in range(0, len(far), n):
            for j, found in enumerate(self._onward(layer, last, far[k : k + n]), k):
                both = 2 * np.convolve(np.bincount(off[kind == j], number[kind == j]).astype(np.int64), found)
                used = np.flatnonzero(both)
                counts[used] += both[used]
        rest = np.arange(max(low, begin), high)
        for k in range(0, len(rest), n):
            counts = _sum(counts, self._later(rest[k : k + n], first, last))
        return counts

    def counts(self, low: int, high: int, small: int = SMALL, wide: int = WIDE) -> np.ndarray:
        """What the places from ``low`` up to ``high`` add to the numbers of ordered pairs 0, 1, 2, ... hops apart."""
        total, rest = np.zeros(1, np.int64), []
        at = np.searchsorted(self.edge[self.first], [low, high - 1], "right") - 1
        for k in range(at[0], at[1] + 1):
            first, last = self.first[k], self.first[k + 1]
            a, b = max(low, self.edge[first]), min(high, self.edge[last])
            if self.edge[last] - self.edge[first] > small and np.diff(self.edge[first : last + 1]).max() <= wide:
                total = _sum(total, self.along(a, b, first, last))
            else:
                rest.append(np.arange(a, b))
        rest = np.concatenate([np.empty(0, np.int64), *rest])
        for a in range(0, len(rest), 64 * WORDS):
            total = _sum(total, self.pairs(rest[a : a + 64 * WORDS]))
        return total


def _bits(n: int) -> np.ndarray:
    """A row for each of n bits, of which it is set."""
    out, k = np.zeros((n, -(-n // 64)), np.uint64), np.arange(n)
    out[k, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
    return out


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def _shortest(far: np.ndarray, hops: np.ndarray) -> np.ndarray:
    """The least of far[i, k] + hops[k, j] over k.

    If both are small, by a product of powers of 1/1024: fewer than 1024 terms never add up to the next power.
    """
    if len(far) > 2048:
        return np.concatenate([_shortest(far[k : k + 2048], hops) for k in range(0, len(far), 2048)])
    if len(hops) <= WIDE and 10 * (int(far.max(initial=0)) + int(hops.max())) < 1000:
        exponent = np.frexp(np.exp2(-10.0 * far) @ np.exp2(-10.0 * hops))[1]
        return -((exponent - 1) // 10)
    out = far[:, :1] + hops[0]
    for k in range(1, len(hops)):
        np.minimum(out, far[:, k : k + 1] + hops[k], out=out)
    return out


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that differ, and which of them each one is."""
    rows, index = np.ascontiguousarray(rows), {}
    which = np.array([index.setdefault(r.tobytes(), len(index)) for r in rows], np.int64)
    return rows[np.unique(which, return_index=True)[1]], which


_KEPT: list = []


def graph_of(shared: Broadcast) -> Graph:
    """The graph of shared ends of edges, which a worker of Spark's makes once and keeps for its next tasks."""
    if not _KEPT or _KEPT[0] is not shared.value:
        _KEPT.clear()
        _KEPT.extend([shared.value, Graph(*shared.value)])
    return _KEPT[1]
