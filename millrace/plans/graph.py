"""Dependency graphs: order, cycles, closures."""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterable, Mapping
from typing import TypeVar

N = TypeVar("N", bound=Hashable)


class Graph:
    """Nodes with the nodes that each depends on."""

    def __init__(self, needs: Mapping[N, Iterable[N]]) -> None:
        self.needs = self._clean(needs)
        self.feeds: dict = {n: [] for n in self.needs}
        for n, deps in self.needs.items():
            for d in deps:
                self.feeds[d].append(n)

    @staticmethod
    def _clean(needs: Mapping) -> dict:
        known = set(needs)
        return {n: tuple(sorted(set(deps) & known)) for n, deps in needs.items()}

    def order(self) -> list:
        """A topological order that always takes the smallest ready node; nodes on cycles are left out."""
        waits = {n: len(d) for n, d in self.needs.items()}
        ready = [n for n, k in waits.items() if k == 0]
        heapq.heapify(ready)
        out = []
        while ready:
            n = heapq.heappop(ready)
            out.append(n)
            for m in self.feeds[n]:
                waits[m] -= 1
                if waits[m] == 0:
                    heapq.heappush(ready, m)
        return out

    def cycle(self) -> list | None:
        """One cycle as a closed path, from its smallest node; None if there is none."""
        rest = set(self.needs) - set(self.order())
        if not rest:
            return None
        # Every node left waits for another one left; following them must close a loop.
        at, seen = min(rest), {}
        path = []
        while at not in seen:
            seen[at] = len(path)
            path.append(at)
            at = min(d for d in self.needs[at] if d in rest)
        loop = path[seen[at] :]
        k = loop.index(min(loop))
        loop = loop[k:] + loop[:k]
        return [*loop, loop[0]]

    def upstream(self, nodes: Iterable) -> set:
        """Everything that the nodes depend on, themselves included."""
        return self._reach(nodes, self.needs)

    def downstream(self, nodes: Iterable) -> set:
        """Everything that depends on the nodes, themselves included."""
        return self._reach(nodes, self.feeds)

    @staticmethod
    def _reach(nodes: Iterable, edges: Mapping) -> set:
        seen, stack = set(), list(nodes)
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack.extend(edges[n])
        return seen
