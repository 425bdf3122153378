"""Small combinatorial kernels in plain Python on bit sets, for use inside Arrow tasks.

A graph is a list of neighbour masks over positions 0..n-1. These run on what is left after the DataFrame
reductions; each call is bounded by a deadline.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class SolverOptions:
    """Switches of the exact search; none of them changes the size found, only the work."""

    degree_rule: bool = True
    diameter_rule: bool = True
    size_bound: bool = True
    saturation: bool = True
    sibling_break: bool = True
    followers: bool = True
    global_rule: bool = True
    order: str = "width"  # width | degree_asc | degree_desc | random
    warm_start: bool = True
    trace: bool = False
    seed: int = 0xC0FFEE


def bits(mask: int) -> Iterable[int]:
    """Positions of the set bits, ascending."""
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def masks_of(ids: list[int], edges: Iterable[tuple[int, int]]) -> list[int]:
    """Neighbour masks by position in ``ids``."""
    at = {v: i for i, v in enumerate(ids)}
    out = [0] * len(ids)
    for u, v in edges:
        if u in at and v in at and u != v:
            out[at[u]] |= 1 << at[v]
            out[at[v]] |= 1 << at[u]
    return out


def reach(adj: list[int], start: int, inside: int) -> int:
    """Vertices of ``inside`` connected with the bits of ``start``."""
    got = front = start & inside
    while front:
        step = 0
        for v in bits(front):
            step |= adj[v]
        front = step & inside & ~got
        got |= front
    return got


def parts(adj: list[int], inside: int) -> list[int]:
    """Components within ``inside``, by their least vertex."""
    out = []
    while inside:
        got = reach(adj, inside & -inside, inside)
        out.append(got)
        inside &= ~got
    return out


def within(adj: list[int], start: int, inside: int, hops: int) -> int:
    """Vertices of ``inside`` at most ``hops`` away from vertex ``start``."""
    got = front = (1 << start) & inside
    for _ in range(hops):
        step = 0
        for v in bits(front):
            step |= adj[v]
        front = step & inside & ~got
        if not front:
            break
        got |= front
    return got


def feasible(adj: list[int], members: int, need: Callable[[int], int], connected: bool) -> bool:
    """Whether the set meets its size's degree threshold and, if asked, is connected."""
    n = members.bit_count()
    if n == 0:
        return False
    if n == 1:
        return True
    least = need(n)
    return all((adj[v] & members).bit_count() >= least for v in bits(members)) and (not connected or reach(adj, members & -members, members) == members)


@dataclass
class Search:
    """Largest feasible set of at least one vertex, by include-exclude with reduction to a fixpoint.

    ``need`` must not fall with the size. A better set than the best has at least max(|inside|, best + 1) members,
    so each of its members has that size's threshold as degree; candidates short of it go.
    """

    adj: list[int]
    need: Callable[[int], int]
    connected: bool
    best: int = 0
    best_size: int = 0
    deadline: float = float("inf")
    options: SolverOptions = field(default_factory=SolverOptions)
    branches: int = 0
    timed_out: bool = False

    def _late(self) -> bool:
        if self.branches % 256 == 0 and time.monotonic() > self.deadline:
            self.timed_out = True
        return self.timed_out

    def _room(self, inside: int, degree: dict[int, int]) -> int:
        """Upper bound of the size: the largest s that s vertices, and all chosen ones, have the degree for."""
        ranked = sorted(degree.values(), reverse=True)
        weakest = min((degree[v] for v in bits(inside)), default=len(ranked))
        s = len(ranked)
        while s > 0 and (ranked[s - 1] < self.need(s) or weakest < self.need(s)):
            s -= 1
        return s

    def reduce(self, inside: int, scope: int) -> tuple[int, dict[int, int]]:
        """The scope (chosen and candidates) after reduction, with degrees in it; 0 where nothing better is left."""
        while True:
            if self.connected and inside:
                scope &= reach(self.adj, inside & -inside, scope)
                if inside & ~scope:
                    return 0, {}
            degree = {v: (self.adj[v] & scope).bit_count() for v in bits(scope)}
            if scope.bit_count() <= self.best_size:
                return 0, {}
            if not self.options.degree_rule:
                return scope, degree
            least = self.need(max(inside.bit_count(), self.best_size + 1))
            weak = 0
            for v, d in degree.items():
                if d < least:
                    weak |= 1 << v
            if weak & inside:
                return 0, {}
            if not weak:
                if self.options.size_bound and self._room(inside, degree) <= self.best_size:
                    return 0, {}
                return scope, degree
            scope &= ~weak

    def _pick(self, free: int, inside: int, degree: dict[int, int]) -> int:
        near = 0
        if self.connected:
            for v in bits(inside):
                near |= self.adj[v]
        pool = list(bits(free & near or free))
        if self.options.order == "random":
            return random.Random(self.options.seed ^ self.branches).choice(pool)
        sign = -1 if self.options.order == "degree_desc" else 1
        return min(pool, key=lambda v: (sign * degree[v], v))

    def run(self, inside: int, scope: int) -> None:
        """Search all sets between ``inside`` (not empty) and ``scope``."""
        stack = [(inside, scope)]
        while stack and not self._late():
            inside, scope = stack.pop()
            self.branches += 1
            scope, degree = self.reduce(inside, scope)
            if not scope:
                continue
            if feasible(self.adj, scope, self.need, self.connected):
                self.best, self.best_size = scope, scope.bit_count()
                continue
            if inside.bit_count() > self.best_size and feasible(self.adj, inside, self.need, self.connected):
                self.best, self.best_size = inside, inside.bit_count()
            free = scope & ~inside
            if not free:
                continue
            v = self._pick(free, inside, degree)
            # the candidate of least degree is most likely out, so the branch without it is searched first
            stack += [(inside | 1 << v, scope), (inside, scope & ~(1 << v))]


def radius_bound(n: int, need: Callable[[int], int], size: int) -> int:
    """Largest distance that two members of a connected set of ``size``..``n`` vertices with its degrees may have."""
    k = need(size)
    for far in range(1, n):
        least = far + 1 if k <= 0 else k + far if far <= 2 or k == 1 else k + far + 1 + (far // 3) * (k - 2)
        if least > n:
            return far - 1
    return max(1, n)
