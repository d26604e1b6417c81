"""Graph work that is sequential by nature, on one group's rows at a time (a document, a component)."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterable

import pandas as pd
from pyspark.sql import DataFrame


class DisjointSet:
    """Union by size with path halving; members are kept with their root."""

    def __init__(self, items: Iterable[Hashable] = ()):
        self.parent: dict = {}
        self.group: dict = {}
        for x in items:
            self.find(x)

    def find(self, x: Hashable) -> Hashable:
        if x not in self.parent:
            self.parent[x], self.group[x] = x, [x]
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: Hashable, y: Hashable) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            if len(self.group[x]) < len(self.group[y]):
                x, y = y, x
            self.parent[y] = x
            self.group[x] += self.group.pop(y)

    def members(self, x: Hashable) -> list:
        return list(self.group[self.find(x)])

    def size(self, x: Hashable) -> int:
        return len(self.group[self.find(x)])


class MinQueue:
    """A priority queue whose entries can be removed; equal keys leave in the order they came."""

    def __init__(self):
        self.heap, self.gone, self.turn, self.live = [], set(), 0, {}

    def add(self, key: float, value: Hashable) -> None:
        self.remove(value)
        self.turn += 1
        self.live[value] = self.turn
        heapq.heappush(self.heap, (key, self.turn, value))

    def remove(self, value: Hashable) -> None:
        turn = self.live.pop(value, None)
        if turn is not None:
            self.gone.add(turn)

    def pop(self) -> tuple[float, Hashable]:
        while True:
            key, turn, value = heapq.heappop(self.heap)
            if turn in self.gone:
                self.gone.discard(turn)
                continue
            del self.live[value]
            return key, value

    def __len__(self) -> int:
        return len(self.live)


def agglomerate(
    weights: dict[tuple, float], strictness: float, compatible: Callable[[Hashable, Hashable], bool] = lambda a, b: True, same: Callable[[Hashable, Hashable], bool] = lambda a, b: a == b, complete: Callable[[Hashable, int], bool] | None = None, mop_up: bool = False, coherent: float = 1e-9,
) -> tuple[list[list], set]:
    """(clusters, selected): merge along edges from the heaviest (ties: smaller pair).

    Two sets merge when the share of their cross pairs that are linked and compatible
    reaches ``strictness``. ``complete(node, times)`` hears of every selected node and
    says whether coverage is complete (6 times while merging, 3 at the end), which stops
    the pass. With ``mop_up`` single nodes then join their heaviest neighbour. Clusters
    whose mean pair weight isn't above ``coherent`` are left out; the selected nodes are
    those that the coherent clusters cover, most coherent first.
    """
    key = lambda a, b: (a, b) if a <= b else (b, a)
    edges = sorted(((w, *k) for k, w in weights.items()), key=lambda e: (-e[0], e[1], e[2]))
    sets = DisjointSet(x for k in weights for x in k)
    linked: dict = {x: {} for k in weights for x in k}  # between sets, by their roots, the number of pairs that are linked and compatible
    for a, b in weights:
        if a != b and compatible(a, b):
            linked[a][b] = linked[b][a] = 1
    for _, a, b in edges:
        one, two = sets.find(a), sets.find(b)
        if one == two:
            continue
        if linked[one].get(two, 0) / (sets.size(a) * sets.size(b)) >= strictness:
            sets.join(a, b)
            root = sets.find(a)
            for c, n in linked.pop(two if root == one else one).items():
                if c != root:
                    del linked[c][two if root == one else one]
                    linked[root][c] = linked[c][root] = linked[root].get(c, 0) + n
            linked[root].pop(two if root == one else one, None)
            if complete and (complete(a, 6) | complete(b, 6)):
                break
    if mop_up:
        for _, a, b in edges:
            if sets.find(a) != sets.find(b) and 1 in (sets.size(a), sets.size(b)):
                sets.join(a, b)
    clusters = []
    for members in sets.group.values():
        pairs = [(x, y) for x in members for y in members if not same(x, y)]
        if len(pairs) > 1 and (mean := sum(weights.get(key(x, y), 0.0) for x, y in pairs) / len(pairs)) > coherent:
            clusters.append((mean, sorted(members)))
    clusters.sort(key=lambda c: (-c[0], c[1]))
    selected: set = set()
    for _, members in clusters:
        done = False
        for x in members:
            selected.add(x)
            done = bool(complete and complete(x, 3))
        if done:
            break
    return [m for _, m in clusters], selected


def set_distance(left: list, right: list, weights: dict[tuple, float]) -> float:
    """Mean linked weight times the squared ratio of all cross pairs to linked ones; infinite when none is linked."""
    found = [weights[k] for x in left for y in right if (k := (x, y) if x <= y else (y, x)) in weights]
    return sum(found) / len(found) * (len(left) * len(right) / len(found)) ** 2 if found else float("inf")


def complete_linkage(distances: dict[tuple, float], crop: float) -> list[list]:
    """Clusters whose farthest members are at most ``crop`` apart, merged nearest first."""
    key = lambda a, b: (a, b) if a <= b else (b, a)
    groups = {x: [x] for k in distances for x in k}
    far = {key(a, b): d for (a, b), d in distances.items()}
    while far:
        (a, b), d = min(far.items(), key=lambda e: (e[1], e[0]))
        if d > crop:
            break
        groups[a] += groups.pop(b)
        merged = {}
        for c in groups:
            if c != a:
                x, y = far.get(key(a, c), float("inf")), far.get(key(b, c), float("inf"))
                if max(x, y) < float("inf"):
                    merged[key(a, c)] = max(x, y)
        far = {k: v for k, v in far.items() if a not in k and b not in k} | merged
    return sorted(sorted(g) for g in groups.values())


def groups_of(weights: dict[tuple, float], strictness: float, mop_up: bool) -> dict:
    """Each linked topic's cluster, -1 for those in no coherent one, topics in order; ``weights`` has smaller ends first."""
    clusters, _ = agglomerate(weights, strictness, mop_up=mop_up)
    group = {x: i for i, c in enumerate(clusters) for x in c}
    return {t: group.get(t, -1) for t in sorted({x for k in weights for x in k})}


def cluster_topics(links: DataFrame, strictness: float = 0.7, mop_up: bool = False) -> DataFrame:
    """(doc, topic, group_id) of each document's linked topics (doc, a, b, weight), -1 for those in no coherent cluster."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = {(min(a, b), max(a, b)): w for a, b, w in zip(pdf["a"], pdf["b"], pdf["weight"])}
        group = groups_of(weights, strictness, mop_up)
        return pd.DataFrame({"doc": pdf["doc"].iloc[0], "topic": list(group), "group_id": list(group.values())})

    kind = links.schema["a"].dataType.simpleString()
    return links.select("doc", "a", "b", "weight").groupBy("doc").applyInPandas(one, f"doc {links.schema['doc'].dataType.simpleString()}, topic {kind}, group_id int")
