"""Communities, strong components, closures, shortest paths, and the hierarchy built from them."""

from __future__ import annotations

import heapq
import random
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .clustering import DisjointSet


def strong_components(edges: Iterable[tuple], least: int = 1) -> list[list]:
    """Strongly connected node sets of edges that occur at least ``least`` times (Tarjan's algorithm without recursion), each sorted, smallest first."""
    count: dict[tuple, int] = {}
    for e in edges:
        count[e] = count.get(e, 0) + 1
    sinks: dict = {}
    for (a, b), n in count.items():
        sinks.setdefault(a, [])
        sinks.setdefault(b, [])
        if n >= least:
            sinks[a].append(b)
    index: dict = {}
    low: dict = {}
    stack: list = []
    held: set = set()
    out: list[list] = []
    for root in sorted(sinks):
        if root in index:
            continue
        work = [(root, iter(sorted(sinks[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    held.add(nxt)
                    work.append((nxt, iter(sorted(sinks[nxt]))))
                    break
                if nxt in held:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        held.discard(part[-1])
                    out.append(sorted(part))
    return sorted(out, key=lambda c: (len(c), c))


def scc(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, component) of a directed edge table (a, b): forward and backward colouring, the component being its smallest node.

    Nodes that can't be in a cycle are trimmed; then the smallest label that reaches a
    node spreads forward, and a component is what its label's node can be reached from
    among nodes of that label. Each round removes at least one component per colour.
    No side of a join is broadcast, as that would send it to the driver in every round.
    """
    left = written(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "scc-edges")
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node is not null").distinct(), "scc-nodes")
    done: DataFrame | None = None
    for _ in range(rounds):
        colour = written(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("c", F.col("node")), "scc-colour")
        if colour.isEmpty():
            break
        while True:
            step = colour.join(left.select("a", F.col("b").alias("to")).hint("merge"), colour["node"] == F.col("a")).groupBy(F.col("to").alias("node")).agg(F.min("c").alias("n"))
            new = written(colour.join(step.hint("merge"), "node", "left").select("node", F.least("c", "n").alias("c")), "scc-colour")
            moved = new.join(colour.withColumnRenamed("c", "o").hint("merge"), "node").where("c <> o").isEmpty()
            colour = new
            if moved:
                break
        inside = written(left.join(colour.withColumnsRenamed({"node": "a", "c": "ca"}).hint("merge"), "a").join(colour.withColumnsRenamed({"node": "b", "c": "cb"}).hint("merge"), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")), "scc-inside")
        got = written(colour.where("node = c"), "scc-got")
        front = got
        while True:
            front = written(inside.join(front.select(F.col("node").alias("b"), "c").hint("merge"), ["b", "c"]).select(F.col("a").alias("node"), "c").distinct().join(got.hint("merge"), ["node", "c"], "left_anti"), "scc-front")
            if front.isEmpty():
                break
            got = written(got.unionByName(front), "scc-got")
        part = got.select("node", F.col("c").alias("component"))
        done = part if done is None else written(done.unionByName(part), "scc-done")
        left = written(left.join(part.select(F.col("node").alias("a")).hint("merge"), "a", "left_anti").join(part.select(F.col("node").alias("b")).hint("merge"), "b", "left_anti").select("a", "b"), "scc-edges")
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    return done.unionByName(nodes.join(done.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component")))


def louvain_levels(edges: Iterable[tuple], epsilon: float = 1e-6, seed: int = 0) -> list[dict]:
    """Community of each original node, level by level, by the method of Blondel et al. (2008); edges are (a, b, weight), each once.

    Nodes are visited in a seeded random order; a node moves to the neighbouring
    community of largest modularity gain (ties: it stays, else the smallest). Community
    names are their smallest node.
    """
    graph: dict = {}
    for a, b, w in edges:
        graph.setdefault(a, {})
        graph.setdefault(b, {})
        graph[a][b] = graph[a].get(b, 0.0) + w
        if a != b:
            graph[b][a] = graph[b].get(a, 0.0) + w
    rng, home, out = random.Random(seed), {x: x for x in graph}, []
    total = sum(w * (2 if a == b else 1) for a, n in graph.items() for b, w in n.items())
    loops = {a: 2 * n.get(a, 0.0) for a, n in graph.items()}
    while graph and total > 0:
        degree = {a: loops[a] + sum(w for b, w in n.items() if b != a) for a, n in graph.items()}
        group, sums = {a: a for a in graph}, dict(degree)
        moved_any, order = False, sorted(graph)
        rng.shuffle(order)
        while True:
            gained = 0.0
            for a in order:
                near: dict = {}
                for b, w in graph[a].items():
                    if b != a:
                        near[group[b]] = near.get(group[b], 0.0) + w
                own = group[a]
                sums[own] -= degree[a]
                score = lambda g: near.get(g, 0.0) - sums.get(g, 0.0) * degree[a] / total  # noqa: B023, E731
                best = max(sorted(near), key=score, default=own)
                if score(best) > score(own) + 1e-12:
                    gained += 2 * (score(best) - score(own)) / total
                    group[a] = best
                    moved_any = True
                sums[group[a]] = sums.get(group[a], 0.0) + degree[a]
            if gained <= epsilon:
                break
        if not moved_any:
            break
        least: dict = {}
        for a, g in group.items():
            least[g] = min(least.get(g, a), a)
        name = {a: least[g] for a, g in group.items()}
        home = {x: name[h] for x, h in home.items()}
        out.append(dict(home))
        joined: dict = {g: {} for g in set(name.values())}
        inner = dict.fromkeys(joined, 0.0)
        for a, n in graph.items():
            inner[name[a]] += loops[a]
            for b, w in n.items():
                if b == a:
                    continue
                if name[a] == name[b]:
                    inner[name[a]] += w
                else:
                    joined[name[a]][name[b]] = joined[name[a]].get(name[b], 0.0) + w
        graph, loops = joined, inner
    return out or [home]


def louvain(edges: DataFrame, group: str = "component", epsilon: float = 1e-6, seed: int = 0) -> DataFrame:
    """(component, level, node, community), the components in parallel; ``edges`` has (group, a, b, weight)."""
    kind = edges.schema["a"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf[group].iloc[0], level, node, c) for level, home in enumerate(louvain_levels(zip(pdf["a"], pdf["b"], pdf["weight"]), epsilon, seed)) for node, c in sorted(home.items())]
        return pd.DataFrame(rows, columns=[group, "level", "node", "community"])

    return edges.select(group, "a", "b", "weight").groupBy(group).applyInPandas(one, f"{group} {edges.schema[group].dataType.simpleString()}, level int, node {kind}, community {kind}")


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row (modularity) of a partition (node, community) over undirected edges (a, b, weight): sum of in / m - (tot / m)^2."""
    sized = edges.join(partition.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(partition.withColumnsRenamed({"node": "b", "community": "cb"}), "b")
    ends = sized.select(F.col("ca").alias("c"), "weight").unionByName(sized.select(F.col("cb").alias("c"), "weight"))
    tot = ends.groupBy("c").agg(F.sum("weight").alias("tot"))
    inside = sized.where("ca = cb").groupBy(F.col("ca").alias("c")).agg((F.sum("weight") * 2).alias("inn"))
    m = ends.agg(F.sum("weight").alias("m"))
    return tot.join(inside, "c", "left").crossJoin(F.broadcast(m)).agg(F.sum(F.coalesce(F.col("inn"), F.lit(0.0)) / F.col("m") - (F.col("tot") / F.col("m")) ** 2).alias("modularity"))


def community_graph(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(a, b, weight) between communities, a <= b: the graph of the next level."""
    c = edges.join(partition.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(partition.withColumnsRenamed({"node": "b", "community": "cb"}), "b")
    return c.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight"))


def closure(starts: DataFrame, edges: DataFrame, most: int = 50, banned: DataFrame | None = None) -> DataFrame:
    """(start, node, hops): everything that can be reached from each start within ``most`` steps, by frontier rounds; banned nodes end a path.

    What was reached before is taken off at hops that are twice as far apart each time
    while nothing is reached twice, so a tree's rows meet a few times and not in each
    round; once something is, it is taken off after every hop. Where no node has several
    steps, a round has no rows to make distinct.
    """
    step = edges.select("a", "b").distinct()
    if banned is not None:
        step = step.join(banned.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
    step = written(step, "closure-edges")
    single = step.groupBy("a").count().where("count > 1").isEmpty()
    seen = front = written(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")).distinct(), "closure")
    fresh: list[DataFrame] = []  # fronts since the last check
    wait = 1
    for hop in range(1, most + 1):
        new = front.select("start", F.col("node").alias("a")).join(step, "a").select("start", F.col("b").alias("node"))
        front = written((new if single else new.distinct()).withColumn("hops", F.lit(hop)), "closure")
        over = front.isEmpty()
        if not over:
            fresh.append(front)
        if fresh and (over or hop == most or len(fresh) >= wait):
            found = reduce(DataFrame.unionByName, fresh)
            first = found if len(fresh) == 1 else found.groupBy("start", "node").agg(F.min("hops").alias("hops"))
            first = written(first.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "closure")
            wait = 2 * wait if first.count() == found.count() else 1
            seen, front, fresh = seen.unionByName(first), first.where(F.col("hops") == hop), []
            over = over or front.isEmpty()
        if over:
            break
    return seen


def shortest_paths(starts: DataFrame, edges: DataFrame, limit: float = float("inf"), rounds: int = 1000) -> DataFrame:
    """(start, node, distance) over non-negative directed edges (a, b, weight), up to ``limit``: rounds of relaxation until nothing gets shorter."""
    step = written(edges.groupBy("a", "b").agg(F.min("weight").alias("weight")), "paths-edges")
    best = front = written(starts.select(F.col("node").alias("start"), "node", F.lit(0.0).alias("distance")).distinct(), "paths")
    for _ in range(rounds):
        new = front.join(step.withColumnRenamed("a", "node"), "node").select("start", F.col("b").alias("node"), (F.col("distance") + F.col("weight")).alias("distance")).where(F.col("distance") <= limit)
        new = new.groupBy("start", "node").agg(F.min("distance").alias("distance"))
        front = written(new.join(best.withColumnRenamed("distance", "had"), ["start", "node"], "left").where("had is null or distance < had").select("start", "node", "distance"), "paths")
        if front.isEmpty():
            break
        best = written(best.unionByName(front).groupBy("start", "node").agg(F.min("distance").alias("distance")), "paths")
    return best


def dijkstra(starts: Iterable, near: dict, weight: Callable | None = None, visit: Callable | None = None) -> dict:
    """node -> (distance, previous) from the nearest start; ``near`` is node -> {node: weight}; ``visit(node, distance)`` false ends there."""
    out: dict = {}
    queue = [(0.0, 0, s, None) for s in sorted(starts)]
    heapq.heapify(queue)
    turn = 1
    while queue:
        d, _, node, previous = heapq.heappop(queue)
        if node in out:
            continue
        out[node] = (d, previous)
        if visit and not visit(node, d):
            continue
        for nxt, w in sorted(near.get(node, {}).items()):
            if nxt not in out:
                heapq.heappush(queue, (d + (weight(node, nxt, w) if weight else w), turn, nxt, node))
                turn += 1
    return out


class TopicHierarchy:
    """A tree over topics from an undirected graph of categories: flow, pruning, compression, spanning, splitting."""

    def __init__(self, edges: Iterable[tuple], topics: Iterable):
        self.near: dict = {}
        self.topics = set(topics)
        self.flow: dict[tuple, float] = {}
        for a, b, w in edges:
            if a != b:
                self.near.setdefault(a, {})[b] = min(w, self.near.get(a, {}).get(b, w))
                self.near.setdefault(b, {})[a] = self.near[a][b]

    def _key(self, a, b) -> tuple:
        return (a, b) if a <= b else (b, a)

    def remove(self, node) -> None:
        for b in self.near.pop(node, {}):
            self.near[b].pop(node, None)

    def label_flow(self, most: float = float("inf")) -> None:
        """One unit of flow on the shortest path between each two topics that are at most ``most`` apart."""
        self.flow = {}
        for t in sorted(self.topics & self.near.keys()):
            tree = dijkstra([t], self.near, visit=lambda n, d: d <= most)
            for u in sorted(self.topics):
                if u > t and u in tree and tree[u][0] <= most:
                    at = u
                    while tree[at][1] is not None:
                        k = self._key(at, tree[at][1])
                        self.flow[k] = self.flow.get(k, 0.0) + 1
                        at = tree[at][1]

    def prune(self) -> None:
        """Drop edges without flow, then nodes without edges that aren't topics."""
        for a in list(self.near):
            for b in list(self.near[a]):
                if not self.flow.get(self._key(a, b)):
                    del self.near[a][b]
        for a in [a for a, n in self.near.items() if not n and a not in self.topics]:
            del self.near[a]

    def prune_far(self, most: float) -> None:
        """Drop nodes farther than ``most`` from every topic."""
        kept = dijkstra(self.topics & self.near.keys(), self.near)
        for a in [a for a in self.near if a not in kept or kept[a][0] > most]:
            self.remove(a)

    def compress(self) -> None:
        """Replace nodes of two edges that aren't topics by one edge with both weights."""
        todo = sorted(a for a, n in self.near.items() if a not in self.topics and len(n) == 2)
        while todo:
            a = todo.pop(0)
            if len(self.near.get(a, ())) != 2:
                continue
            (x, wx), (y, wy) = sorted(self.near[a].items())
            flow = max(self.flow.get(self._key(a, x), 0.0), self.flow.get(self._key(a, y), 0.0))
            self.remove(a)
            w = min(wx + wy, self.near[x].get(y, float("inf")))
            self.near[x][y] = self.near[y][x] = w
            self.flow[self._key(x, y)] = max(flow, self.flow.get(self._key(x, y), 0.0))
            todo.extend(n for n in (x, y) if n not in self.topics and len(self.near[n]) == 2)

    def span(self) -> None:
        """Reverse delete: edges of least flow go unless their ends would part. Kept edges form a forest, found by taking them in the opposite order."""
        edges = sorted(((self.flow.get((a, b), 0.0), -w, a, b) for a, n in self.near.items() for b, w in n.items() if a < b), key=lambda e: (-e[0], -e[1], e[2], e[3]))
        sets = DisjointSet(self.near)
        for _, _, a, b in edges:
            if sets.find(a) == sets.find(b):
                del self.near[a][b], self.near[b][a]
            else:
                sets.join(a, b)

    def tree(self) -> list[tuple]:
        """(node, parent, depth) of a tree rooted in the middle of each part's longest path (in hops); topics without edges are roots."""
        rows, seen = [], set()
        hops = {a: dict.fromkeys(n, 1.0) for a, n in self.near.items()}
        for a in sorted(self.near):
            if a in seen:
                continue
            far = dijkstra([a], hops)
            end = max(sorted(far), key=lambda n: far[n][0])
            back = dijkstra([end], hops)
            at = max(sorted(back), key=lambda n: back[n][0])
            path = [at]
            while back[path[-1]][1] is not None:
                path.append(back[path[-1]][1])
            tree = dijkstra([path[len(path) // 2]], hops)
            seen |= tree.keys()
            rows += [(n, p, int(d)) for n, (d, p) in sorted(tree.items())]
        rows += [(t, None, 0) for t in sorted(self.topics - self.near.keys())]
        return rows

    def build(self, most: float = float("inf")) -> list[tuple]:
        self.label_flow(most)
        self.prune()
        self.compress()
        self.span()
        return self.tree()


def spanning_hierarchy(edges: DataFrame, topics: DataFrame, group: str = "component", most: float = float("inf")) -> DataFrame:
    """(component, node, parent, depth) of each component's hierarchy, in parallel; ``edges`` (component, a, b, weight), ``topics`` (component, topic)."""
    kind = edges.schema["a"].dataType.simpleString()

    def one(key: tuple, e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows = TopicHierarchy(zip(e["a"], e["b"], e["weight"]), t["topic"]).build(most)
        out = pd.DataFrame(rows, columns=["node", "parent", "depth"])
        out.insert(0, group, key[0])
        return out

    return edges.groupBy(group).cogroup(topics.select(F.col(group).alias("__group"), "topic").groupBy("__group")).applyInPandas(one, f"{group} {edges.schema[group].dataType.simpleString()}, node {kind}, parent {kind}, depth int")


def tree_lines(tree: Iterable[tuple]) -> list[str]:
    """A tree's rows as indented lines, children in order under their parent."""
    children: dict = {}
    for node, parent, _ in tree:
        children.setdefault(parent, []).append(node)
    out: list[str] = []
    work = [(n, 0) for n in sorted(children.get(None, []), reverse=True)]
    while work:
        node, depth = work.pop()
        out.append("  " * depth + str(node))
        work += [(n, depth + 1) for n in sorted(children.get(node, []), reverse=True)]
    return out
