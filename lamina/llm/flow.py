"""Minimum-cost flow on a small graph, by successive shortest paths."""

from __future__ import annotations


class Network:
    """Nodes are numbers, capacities and costs integers; arcs may be parallel, costs mustn't be negative."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = {}

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        """Add an arc; its number is good for used()."""
        k = len(self.to)
        self.to += [b, a]
        self.room += [room, 0]
        self.cost += [cost, -cost]
        self.out.setdefault(a, []).append(k)
        self.out.setdefault(b, []).append(k + 1)
        return k

    def used(self, arc: int) -> int:
        return self.room[arc + 1]

    def run(self, source: int, sink: int) -> int:
        """Send as much as fits, as cheaply as possible; the amount sent."""
        sent = 0
        while True:
            best, via, queue, queued = {source: 0}, {}, [source], {source}
            while queue:
                a = queue.pop(0)
                queued.discard(a)
                for k in self.out.get(a, ()):
                    b = self.to[k]
                    if self.room[k] > 0 and best[a] + self.cost[k] < best.get(b, 1 << 62):
                        best[b], via[b] = best[a] + self.cost[k], k
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if sink not in via:
                return sent
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            room = min(self.room[k] for k in path)
            for k in path:
                self.room[k] -= room
                self.room[k ^ 1] += room
            sent += room
