"""Resolution of a document's mentions by the classes of its sites.

Sites of one class have the same candidates, and links weigh the same between any two of
these, so sets of candidates of equal make-up can be told apart only by their places. All
steps of ``resolve.prune`` are taken here for such sets and such sites together: nothing
is kept for a pair of mentions, and no edge is looked at that can't merge two sets.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd


class Pruner:
    """Candidates of classes (``site`` being the class), in the order of ``resolve``, and the weights between each two of them at different sites."""

    def __init__(self, cands: pd.DataFrame, between: np.ndarray, strictness: float = 0.99):
        self.strictness, self.between = strictness, between
        kind, self.alt, self.start = (cands[c].to_numpy() for c in ("site", "alternative", "start"))
        self.topic = pd.factorize(cands["topic"])[0]
        self.of = {int(k): np.flatnonzero(kind == k) for k in np.unique(kind)}

    def resolve(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Site, candidate and weight of what is left of a document's sites, given their classes."""
        own = _Document(self, kinds)
        return own.left(own.covered())


class _Document:
    def __init__(self, table: Pruner, kinds: np.ndarray):
        none = np.zeros(0, np.int64)
        used, self.kind = np.unique(kinds, return_inverse=True)
        each = [table.of.get(int(k), none) for k in used]
        self.at = np.concatenate([none, *each])
        self.strictness, self.width = table.strictness, max([1, *map(len, each)])
        ends = np.cumsum([0, *map(len, each)]).tolist()
        self.mine = [range(a, b) for a, b in zip(ends, ends[1:])]  # a class's candidates
        self.weight = table.between[np.ix_(self.at, self.at)]
        self.w = self.weight.tolist()
        self.alt, self.start, self.topic = (x[self.at].tolist() for x in (table.alt, table.start, table.topic))
        order = np.argsort(self.kind, kind="stable")
        self.sites = [x.tolist() for x in np.split(order, np.cumsum(np.bincount(self.kind, minlength=len(used)))[:-1])] if len(used) else []
        self.first = [r.start for r in self.mine]
        self.kind = self.kind.tolist()

    def apart(self, a: int, b: int) -> bool:
        """Whether two candidates of a class can't be linked at one site."""
        return self.alt[a] != self.alt[b] or self.start[a] == self.start[b]

    def covered(self) -> dict[int, int]:
        """Each site's candidates (as bits) at whose places a coherent cluster has a candidate: links are merged from the heaviest, as in ``clustering.agglomerate``.

        Nodes are numbered by site and candidate. Sets are known by their types, the
        candidates in them; of a level of equal weights only nodes of types that can merge
        are visited.
        """
        width, first, kind, w = self.width, self.first, self.kind, self.w
        members: list[tuple] = []
        toward: list[list[int]] = []
        number: dict[tuple, int] = {}
        able: dict[tuple[int, int], bool] = {}
        link = (self.weight > 0).astype(np.int64)

        def type_of(t: tuple) -> int:
            if t not in number:
                number[t] = len(members)
                members.append(t)
                toward.append(link[list(t)].sum(0).tolist())
            return number[t]

        def fits(a: int, b: int) -> bool:
            got = able.get((a, b))
            if got is None:
                to = toward[a]
                got = able[a, b] = able[b, a] = sum(to[y] for y in members[b]) / (len(members[a]) * len(members[b])) >= self.strictness
            return got

        cand = self.cand = [first[k] + r for k in kind for r in range(width)]
        where: list[dict[int, list[int]]] = []
        for u, sites in enumerate(self.sites):
            where += [{type_of((i,)): [s * width + i - first[u] for s in sites]} for i in self.mine[u]]
        sets: dict[int, tuple[int, list[int]]] = {}  # of nodes that aren't alone: their set's type and nodes

        def merged(a: int, b: int) -> int | None:
            """The type of the set of two nodes' sets; None if they don't merge."""
            x, y = cand[a], cand[b]
            if a // width == b // width and self.apart(x, y):
                return None
            one, two = sets.get(a) or (type_of((x,)), [a]), sets.get(b) or (type_of((y,)), [b])
            if one[1] is two[1]:
                return None
            here: dict[int, list[int]] = {}
            for n in one[1]:
                here.setdefault(n // width, []).append(cand[n])
            lost = sum(w[p][q] > 0 and self.apart(p, q) for n in two[1] if n // width in here for q in [cand[n]] for p in here[n // width])
            to = toward[one[0]]
            if lost and (sum(to[q] for q in members[two[0]]) - lost) / (len(one[1]) * len(two[1])) < self.strictness:
                return None
            for t, nodes in (one, two):
                for n in nodes:
                    held = where[cand[n]]
                    if len(held[t]) > 1:
                        del held[t][bisect_left(held[t], n)]
                    else:
                        del held[t]
            t = type_of(tuple(sorted(members[one[0]] + members[two[0]])))
            both = (t, one[1] + two[1])
            for n in both[1]:
                sets[n] = both
                insort(where[cand[n]].setdefault(t, []), n)
            return t

        i, j = np.nonzero(np.triu(self.weight, 1))
        order = np.argsort(-self.weight[i, j], kind="stable")
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.diff(self.weight[i, j])) + 1
        i, j = i.tolist(), j.tolist()
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)]):
            if not any(fits(a, b) for x, y in zip(i[lo:hi], j[lo:hi]) for a in where[x] for b in where[y]):
                continue
            partners: dict[int, list[int]] = {}
            for x, y in zip(i[lo:hi], j[lo:hi]):
                partners.setdefault(x, []).append(y)
                partners.setdefault(y, []).append(x)
            meets = lambda t, x: any(fits(t, b) for y in partners[x] for b in where[y])  # noqa: B023, E731
            todo = [n for x in partners for t, nodes in where[x].items() if meets(t, x) for n in nodes]
            heapq.heapify(todo)
            last = -1
            while todo:
                a = heapq.heappop(todo)
                if a == last:
                    continue
                last = after = a
                x = cand[a]
                while True:
                    t = sets[a][0] if a in sets else type_of((x,))
                    b = None
                    for y in partners[x]:
                        for u, nodes in where[y].items():
                            if fits(t, u) and nodes[-1] > after:
                                n = nodes[bisect_right(nodes, after)]
                                b = n if b is None or n < b else b
                    if b is None:
                        break
                    after = b
                    t = merged(a, b)
                    if t is not None:
                        for n in sets[a][1]:
                            if n > a and cand[n] in partners and meets(t, cand[n]):
                                heapq.heappush(todo, n)
        cover: dict[int, int] = {}
        place = [sum(1 << b - self.mine[u].start for b in self.mine[u] if self.alt[a] == self.alt[b] and self.start[a] == self.start[b]) for u in range(len(self.mine)) for a in self.mine[u]]
        whole: dict[int, bool] = {}  # whether all pairs of different topics are linked, if at different sites
        done: set[int] = set()
        for t, nodes in sets.values():
            if id(nodes) in done:
                continue
            done.add(id(nodes))
            if t not in whole:
                whole[t] = all(w[p][q] > 0 or self.topic[p] == self.topic[q] for p in members[t] for q in members[t])
            if whole[t] and len({n // width for n in nodes}) == len(nodes) or self._mean(nodes) > 1e-9:
                for n in nodes:
                    cover[n // width] = cover.get(n // width, 0) | place[cand[n]]
        return cover

    def _mean(self, nodes: list[int]) -> float:
        """The mean weight of a set's pairs of different topics."""
        each = [(n // self.width, self.cand[n]) for n in nodes]
        found = [0.0 if s == z and self.apart(p, q) else self.w[p][q] for s, p in each for z, q in each if self.topic[p] != self.topic[q]]
        return sum(found) / len(found)

    def left(self, cover: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the covered candidates: the reading with the least weight goes until each site has one, then the candidate with the least weight until each form has one.

        Sites of one class with the same candidates left are a state and have the same
        weights. Of equal weights the one that was longest unchanged goes first, then the
        first in order.
        """
        live = np.zeros(len(self.at))
        states: dict[tuple[int, int], list[int]] = {}
        for s in sorted(cover):
            states.setdefault((self.kind[s], cover[s]), []).append(s)
        bits = lambda u, m: [a for a in self.mine[u] if m >> a - self.first[u] & 1]
        for (u, m), sites in states.items():
            live[bits(u, m)] += len(sites)
        total = (self.weight @ live).tolist()
        inside: dict[tuple[int, int], dict[int, float]] = {}

        def off(state: tuple[int, int]) -> dict[int, float]:
            """What a state's candidates would weigh with those of their own site, which they can't be linked to."""
            if state not in inside:
                own = bits(*state)
                inside[state] = {a: sum(self.w[b][a] for b in own if self.apart(a, b)) for a in own}
            return inside[state]

        watched = [a for u, m in states for r in [bits(u, m)] if len(r) > 1 for a in r]
        watched = sorted(set(watched))
        events: dict[int, list[tuple[int, int, int]]] = {a: [] for a in watched}  # time, site and candidate of what went of a candidate's peers
        clock = 0

        def move(state: tuple[int, int], site: int, gone: list[int], noted: bool) -> tuple[int, int]:
            nonlocal clock
            u, m = state
            sites = states[state]
            del sites[bisect_left(sites, site)]
            if not sites:
                del states[state]
            for a in gone:
                m &= ~(1 << a - self.first[u])
                live[a] -= 1
                clock += 1
                for b in watched:
                    if self.w[a][b] > 0:
                        total[b] -= self.w[a][b]
                        if noted:
                            events[b].append((clock, site, a))
            insort(states.setdefault((u, m), []), site)
            return u, m

        def readings(state: tuple[int, int]) -> dict[int, list[int]]:
            out: dict[int, list[int]] = {}
            for a in bits(*state):
                out.setdefault(self.alt[a], []).append(a)
            return out

        known: dict[tuple[int, int], dict[int, list[int]]] = {}
        read = lambda state: known[state] if state in known else known.setdefault(state, readings(state))
        while unread := [(sum(total[a] - off(x)[a] for a in own), sites[0], alt, x) for x, sites in states.items() if len(read(x)) > 1 for alt, own in read(x).items()]:
            _, s, alt, x = min(unread)
            move(x, s, read(x)[alt], False)

        forms: dict[tuple[int, int], list[int]] = {}

        def rivals(state: tuple[int, int]) -> list[int]:
            """Candidates of forms that have several left."""
            if state not in forms:
                own = bits(*state)
                starts = [self.start[a] for a in own]
                forms[state] = [a for a in own if starts.count(self.start[a]) > 1]
            return forms[state]

        open_states = {x for x in states if rivals(x)}
        while True:
            best = None
            for x in open_states:
                sites = states[x]
                for a in rivals(x):
                    score = total[a] - off(x)[a]
                    if best is not None and score > best[0]:
                        continue
                    s, t = sites[0], 0
                    if events[a]:
                        t, at, by = events[a][-1]
                        if self._among(sites, at) and self.kind[at] == x[0] and self.apart(by, a):  # its own loss didn't change it
                            s = at
                            t = next((when for when, where, what in reversed(events[a]) if where != s or not self.apart(what, a)), 0)
                    if best is None or (score, t, s, a) < best[:4]:
                        best = (score, t, s, a, x)
            if best is None:
                break
            x = best[4]
            new = move(x, best[2], [best[3]], True)
            if x not in states:
                open_states.discard(x)
            if rivals(new):
                open_states.add(new)

        rows = []
        for x, sites in states.items():
            own = bits(*x)
            for a in own:
                others = live.copy()
                for b in own:
                    others[b] -= self.apart(a, b)
                each = self.weight[a] * others
                if each.any():
                    rows.append((sites, a, round(float(each.sum()), 12)))
        site = np.concatenate([np.zeros(0, np.int64), *[np.array(x) for x, _, _ in rows]]).astype(np.int64)
        size = [len(x) for x, _, _ in rows]
        at = np.repeat(np.array([a for _, a, _ in rows], np.int64), size)
        weight = np.repeat(np.array([v for _, _, v in rows], float), size)
        order = np.lexsort((at, site))
        return site[order], self.at[at[order]], weight[order]

    @staticmethod
    def _among(sites: list[int], site: int) -> bool:
        at = bisect_left(sites, site)
        return at < len(sites) and sites[at] == site
