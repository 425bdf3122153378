"""Peeling heuristics on neighbour lists, for use inside a task on a graph that is known to fit one.

Peeling is sequential by nature: which vertex goes next depends on all that went before. A vertex is only tested for
being a cut vertex when it is the next to go; one that is stays parked until a vertex dies whose being alive
proves it. Each loop is bounded by a deadline.
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable, Iterable, Sequence

Need = Callable[[int], int]


class Neighbours:
    """A graph as sorted neighbour lists over positions 0..n-1 of the sorted ``ids``."""

    def __init__(self, pairs: Sequence[tuple[int, int]]):
        self.ids = sorted({v for p in pairs for v in p})
        self.at = {v: i for i, v in enumerate(self.ids)}
        near: list[set[int]] = [set() for _ in self.ids]
        for u, v in pairs:
            if u != v:
                near[self.at[u]].add(self.at[v])
                near[self.at[v]].add(self.at[u])
        self.near = [sorted(x) for x in near]

    def __len__(self) -> int:
        return len(self.ids)

    def reach(self, start: int, inside: set[int]) -> set[int]:
        """Vertices of ``inside`` connected with ``start``."""
        got, front = {start}, [start]
        while front:
            for w in self.near[front.pop()]:
                if w in inside and w not in got:
                    got.add(w)
                    front.append(w)
        return got

    def parts(self, inside: set[int]) -> list[set[int]]:
        """Components within ``inside``, by their least vertex."""
        out, left = [], set(inside)
        for v in sorted(inside):
            if v in left:
                out.append(self.reach(v, left))
                left -= out[-1]
        return out

    def feasible(self, members: Iterable[int], need: Need, connected: bool = True) -> bool:
        """Whether the set has the degrees that its size asks for and, if asked, is connected; lone vertices pass."""
        own = set(members)
        if len(own) < 2:
            return bool(own)
        least = need(len(own))
        return all(sum(w in own for w in self.near[v]) >= least for v in own) and (not connected or self.reach(min(own), own) == own)


def core_numbers(g: Neighbours) -> list[int]:
    """Core number of each vertex; ``removal`` order comes with ``degeneracy_order``."""
    return degeneracy_order(g)[1]


def degeneracy_order(g: Neighbours) -> tuple[list[int], list[int]]:
    """(vertices in the order in which a vertex of least degree, then least position, goes; their core numbers)."""
    degree = [len(x) for x in g.near]
    heap = [(d, v) for v, d in enumerate(degree)]
    heapq.heapify(heap)
    core, gone, order, level = [0] * len(g), bytearray(len(g)), [], 0
    while heap:
        d, v = heapq.heappop(heap)
        if gone[v] or d != degree[v]:
            continue
        gone[v], level = 1, max(level, d)
        core[v] = level
        order.append(v)
        for w in g.near[v]:
            if not gone[w]:
                degree[w] -= 1
                heapq.heappush(heap, (degree[w], w))
    return order, core


def level_sizes(g: Neighbours, core: list[int]) -> dict[int, int]:
    """Core level -> size of the largest component at that level or above, for all levels in one sweep from the top."""
    up, size, out, most = list(range(len(g))), [1] * len(g), {}, 0

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    by_level: dict[int, list[int]] = {}
    for v, c in enumerate(core):
        by_level.setdefault(c, []).append(v)
    for k in range(max(core, default=0), 0, -1):
        for v in by_level.get(k, ()):
            most = max(most, 1)
            for w in g.near[v]:
                if core[w] >= k and (a := root(v)) != (b := root(w)):
                    up[a] = b
                    size[b] += size[a]
                    most = max(most, size[b])
        out[k] = most
    return out


def seed_and_scope(g: Neighbours, need: Need, lower_fallback: bool) -> tuple[set[int], set[int]]:
    """(seed, scope): the largest component of the least core level k from 2 whose size asks for at most k, and around it
    the component of level k - 1.

    Without such a level the scope is, with ``lower_fallback``, the component of the top core's largest part,
    which is then the seed; else all of the level below the top core, and there is no seed.
    """
    core = core_numbers(g)
    top, sizes = max(core), level_sizes(g, core)
    at = lambda k: {v for v, c in enumerate(core) if c >= k}
    largest = lambda k: max(g.parts(at(k)), key=len)  # noqa: E731  the first of equal ones
    level = next((k for k in range(2, top + 1) if need(sizes[k]) <= k), None)
    if level is not None:
        seed = largest(level)
        return seed, g.reach(min(seed), at(level - 1))
    if lower_fallback:
        seed = largest(top)
        return seed, g.reach(min(seed), at(0))
    return set(), at(top - 1)


def split_by(near: list[list[int]], alive: bytearray, v: int) -> tuple[int, int] | None:
    """Two neighbours' sides that ``v`` alone holds together, as a vertex of each; None if ``v`` is no cut vertex.

    Searches start from all neighbours and take turns, so the work is that of the smaller sides.
    """
    starts = [w for w in near[v] if alive[w]]
    if len(starts) < 2:
        return None
    owner = {w: i for i, w in enumerate(starts)}
    up, fronts = list(range(len(starts))), [deque([w]) for w in starts]

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    groups = len(starts)
    turn = deque(range(len(starts)))
    while groups > 1:
        i = turn.popleft()
        if root(i) != i:
            continue
        if not fronts[i]:  # this side is complete and met no other
            return starts[i], next(w for j, w in enumerate(starts) if root(j) != i)
        x = fronts[i].popleft()
        for w in near[x]:
            if not alive[w] or w == v:
                continue
            if w not in owner:
                owner[w] = i
                fronts[i].append(w)
            elif (j := root(owner[w])) != i:
                up[j] = i
                fronts[i].extend(fronts[j])
                groups -= 1
        turn.append(i)
    return None


def peel(g: Neighbours, scope: set[int], need: Need, floor: int = 0, by_arrival: bool = False, deadline: float = float("inf")) -> tuple[set[int] | None, bool]:
    """Remove the least-degree vertex that is no cut vertex until all degrees suffice: (the rest or None, late).

    Ties go to the least position or, with ``by_arrival``, to the vertex that has had its degree longest. None where no more than
    ``floor`` vertices are left or no vertex can go; a vertex without neighbours cannot.
    """
    near, alive, n = g.near, bytearray(len(g)), len(scope)
    for v in scope:
        alive[v] = 1
    degree = [sum(alive[w] for w in near[v]) if alive[v] else 0 for v in range(len(g))]
    key, stamp = list(range(len(g))), len(g)
    heap = [(degree[v], v, v) for v in scope]
    heapq.heapify(heap)
    count = [0] * (max((degree[v] for v in scope), default=0) + 1)
    for v in scope:
        count[degree[v]] += 1
    low, watch, steps = 0, {}, 0
    while n > floor:
        while low < len(count) - 1 and not count[low]:
            low += 1
        if low >= need(n):
            return {v for v in scope if alive[v]}, False
        v = -1
        while heap:
            d, k, x = heapq.heappop(heap)
            if not alive[x] or d != degree[x] or k != key[x] or d == 0:
                continue
            steps += 1
            if steps % 256 == 0 and time.monotonic() > deadline:
                return None, True
            sides = split_by(near, alive, x)
            if sides is None:
                v = x
                break
            for w in sides:  # while both live, x stays a cut vertex
                watch.setdefault(w, []).append(x)
        if v < 0:
            return None, False
        alive[v], n = 0, n - 1
        count[degree[v]] -= 1
        for w in near[v]:
            if alive[w]:
                count[degree[w]] -= 1
                degree[w] -= 1
                count[degree[w]] += 1
                low = min(low, degree[w])
                if by_arrival:
                    key[w], stamp = stamp, stamp + 1
                heapq.heappush(heap, (degree[w], key[w], w))
        for x in watch.pop(v, ()):
            if alive[x]:
                heapq.heappush(heap, (degree[x], key[x], x))
    return None, False


def npa(g: Neighbours, need: Need, deadline: float = float("inf")) -> tuple[set[int], bool]:
    """(set, late): peeling around the core seed, ties to the least position; empty where it gets stuck."""
    if not len(g):
        return set(), False
    rest, late = peel(g, seed_and_scope(g, need, True)[1], need, deadline=deadline)
    return rest or set(), late


def fpa(g: Neighbours, need: Need, deadline: float = float("inf")) -> tuple[set[int], bool]:
    """(set, late): peeling around the core seed, ties by arrival, down to the size of the seed where that is feasible.

    The scope may be disconnected where no core level qualified; the set is then whatever part of it is left.
    """
    if not len(g):
        return set(), False
    seed, scope = seed_and_scope(g, need, False)
    best = seed if seed and g.feasible(seed, need) else set()
    rest, late = peel(g, scope, need, len(best), True, deadline)
    return rest or best, late


def component_cap(least_degree: int, tau: float) -> int:
    """Size from which on a component of this least degree is not peeled: floor(least_degree ** (1 / tau)), 0 for 0."""
    return int(least_degree ** (1 / tau)) if least_degree > 0 else 0


def greedy(g: Neighbours, need: Need, tau: float, inside: set[int] | None = None, deadline: float = float("inf")) -> tuple[set[int], bool]:
    """(set, late): each component peeled by least degree, then position, whether or not it stays connected.

    Components wait in a queue, larger ones first; one no larger than the best, or whose cap is not, is passed over. A rest
    whose degrees suffice is the new best if connected; else its larger parts join the queue.
    """
    best: set[int] = set()
    queue = deque(sorted(g.parts(set(range(len(g))) if inside is None else inside), key=lambda p: -len(p)))
    while queue:
        own = queue.popleft()
        if len(own) <= len(best):
            continue
        if time.monotonic() > deadline:
            return best, True
        degree = {v: sum(w in own for w in g.near[v]) for v in own}
        if component_cap(min(degree.values()), tau) <= len(best):
            continue
        heap = [(d, v) for v, d in degree.items()]
        heapq.heapify(heap)
        left = set(own)
        while left:
            d, v = heap[0]
            if v not in left or d != degree[v]:
                heapq.heappop(heap)
                continue
            if d >= need(len(left)):
                parts = g.parts(left)
                if len(parts) == 1:
                    best = left if len(left) > len(best) else best
                else:
                    queue.extend(p for p in parts if len(p) > len(best))
                break
            heapq.heappop(heap)
            left.remove(v)
            for w in g.near[v]:
                if w in left:
                    degree[w] -= 1
                    heapq.heappush(heap, (degree[w], w))
    return best, False


def ball(g: Neighbours, start: int, hops: int, cap: int) -> set[int]:
    """The first ``cap`` vertices of a breadth-first search of ``hops`` hops, neighbours in order of position."""
    got, layer, order = {start}, [start], 1
    for _ in range(hops):
        following = []
        for u in layer:
            for w in g.near[u]:
                if w not in got:
                    got.add(w)
                    following.append(w)
                    order += 1
                    if order >= cap:
                        return got
        layer = following
    return got


def multi_seed(g: Neighbours, need: Need, tau: float, seeds: int = 40, hops: int = 2, cap: int = 5000, deadline: float = float("inf")) -> tuple[set[int], bool]:
    """(set, late): the best of ``fpa`` and of ``greedy`` in balls around vertices of large degree outside all earlier balls."""
    best, late = fpa(g, need, deadline)
    covered: set[int] = set()
    run = 0
    for v in sorted(range(len(g)), key=lambda v: (-len(g.near[v]), v)):
        if run == seeds or len(g.near[v]) < 2 or late:
            break
        if v in covered:
            continue
        own = ball(g, v, hops, cap)
        covered |= own
        run += 1
        if len(own) > len(best):
            found, late = greedy(g, need, tau, own, deadline)
            best = found if len(found) > len(best) else best
    return best, late


def cut_vertices(g: Neighbours) -> set[int]:
    """Articulation points, by low links of an explicit depth-first search."""
    order, low, cut = [-1] * len(g), [0] * len(g), set()
    clock = 0
    for start in range(len(g)):
        if order[start] >= 0:
            continue
        order[start] = low[start] = clock
        clock += 1
        branches, stack = 0, [(start, -1, iter(g.near[start]))]
        while stack:
            v, parent, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[v])
                    if parent == start:
                        branches += 1
                    elif low[v] >= order[parent]:
                        cut.add(parent)
            elif order[w] < 0:
                order[w] = low[w] = clock
                clock += 1
                stack.append((w, v, iter(g.near[w])))
            elif w != parent:
                low[v] = min(low[v], order[w])
        if branches > 1:
            cut.add(start)
    return cut
