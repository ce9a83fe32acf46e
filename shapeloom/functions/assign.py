"""Assignment of arcs to the constraints of a bag expression.

Arcs come as classes: how many arcs may take which symbols.  Copies of the
sub-expressions are bounded top-down and bottom-up, which bounds the arcs of
every symbol; a flow with these lower and upper bounds deals the classes out.
If the bag that it makes is in the language, it is the answer; if there is no
flow, there is no answer within the bounds; else the copies of one
sub-expression are halved and both halves are tried.  With all copies fixed a
flow is exact, so the search is; a conjunction never branches.  Its size
depends on the logarithm of the counts, not on the counts.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

from . import rbe

INF = rbe.INF


class Tree:
    """An expression with numbered nodes, parents first, and a leaf of its own for every occurrence of a symbol."""

    def __init__(self, e):
        self.kinds, self.children, self.low, self.high, self.names = [], [], [], [], []
        self.expr = self._add(e)[1]
        self.leaves = [v for v, k in enumerate(self.kinds) if k is rbe.Symbol]
        self.at = {v: i for i, v in enumerate(self.leaves)}
        self.taking: dict = {}
        for i, v in enumerate(self.leaves):
            self.taking.setdefault(self.names[v], []).append(i)

    def _add(self, e):
        v = len(self.kinds)
        self.kinds.append(type(e))
        self.children.append([])
        self.low.append(getattr(e, "min", 1))
        self.high.append(getattr(e, "max", 1))
        self.names.append(getattr(e, "name", None))
        if isinstance(e, rbe.Symbol):
            return v, rbe.Symbol(v, e.min, e.max)
        if isinstance(e, rbe.And | rbe.Or):
            made = [self._add(x) for x in e.items]
            self.children[v] = [c for c, _ in made]
            return v, type(e)(tuple(x for _, x in made))
        if isinstance(e, rbe.Repeat):
            c, x = self._add(e.item)
            self.children[v] = [c]
            return v, rbe.Repeat(x, e.min, e.max)
        return v, e

    def start(self, arcs: int) -> tuple[list[int], list[int]]:
        """Bounds of copies to begin with: no more are of use than the least that are asked for and one for each arc."""
        n = len(self.kinds)
        low, high = [0] * n, [INF] * n
        low[0] = high[0] = 1
        for v in range(n):
            for c in self.children[v]:
                high[c] = min(INF, high[v] * max(self.low[v], 1) + arcs) if self.kinds[v] is rbe.Repeat else high[v]
        return low, high

    def tighten(self, low: list[int], high: list[int], least: list[int], most: list[int]) -> tuple[list[int], list[int]] | None:
        """Bounds of copies made consistent, in place, and the bounds of arcs by leaf; None if there are none.

        least, most: arcs that have to and that may go to a leaf.
        """
        kinds, n = self.kinds, len(self.kinds)
        while True:
            before = (tuple(low), tuple(high))
            for v in range(n):
                kids = self.children[v]
                if kinds[v] is rbe.And:
                    for c in kids:
                        low[c], high[c] = max(low[c], low[v]), min(high[c], high[v])
                elif kinds[v] is rbe.Or:
                    a, b = sum(low[c] for c in kids), sum(high[c] for c in kids)
                    for c in kids:
                        low[c], high[c] = max(low[c], low[v] - (b - high[c])), min(high[c], high[v] - (a - low[c]))
                elif kinds[v] is rbe.Repeat:
                    c, m = kids[0], self.high[v]
                    low[c] = max(low[c], low[v] * self.low[v])
                    high[c] = min(high[c], INF if m is None and high[v] else high[v] * (m or 0))
                elif kinds[v] is rbe.Fail:
                    high[v] = 0
            for v in range(n - 1, -1, -1):
                kids, m = self.children[v], self.high[v]
                if kinds[v] is rbe.And:
                    low[v], high[v] = max([low[v], *(low[c] for c in kids)]), min([high[v], *(high[c] for c in kids)])
                elif kinds[v] is rbe.Or:
                    low[v], high[v] = max(low[v], sum(low[c] for c in kids)), min(high[v], sum(high[c] for c in kids))
                elif kinds[v] in (rbe.Repeat, rbe.Symbol):
                    a, b = (low[kids[0]], high[kids[0]]) if kids else (least[self.at[v]], most[self.at[v]])
                    if a:
                        low[v] = max(low[v], 1 if m is None else INF if m == 0 else -(-a // m))
                    if self.low[v]:
                        high[v] = min(high[v], b // self.low[v])
            if any(a > b for a, b in zip(low, high, strict=True)):
                return None
            if before == (tuple(low), tuple(high)):
                break
        floor, roof = [], []
        for i, v in enumerate(self.leaves):
            m = self.high[v]
            floor.append(max(least[i], low[v] * self.low[v]))
            roof.append(min(most[i], INF if m is None and high[v] else high[v] * (m or 0)))
        return (floor, roof) if all(a <= b for a, b in zip(floor, roof, strict=True)) else None


tree = lru_cache(maxsize=10_000)(Tree)


def flow(supply: list[int], options: list[tuple], floor: list[int], roof: list[int], exact: bool = True) -> dict | None:
    """{(class, leaf): arcs} that hands out every class and keeps every leaf within its bounds, or None.

    Leaves are first filled to their lower bounds, then to the upper ones: a path
    that adds to a leaf never takes from what another one has got in sum.
    ``exact=False``: only the lower bounds have to be met.
    """
    given: dict[tuple, int] = {}
    load, left = [0] * len(floor), list(supply)
    back: list[set] = [set() for _ in floor]
    for caps in (floor, roof):
        if caps is roof and not exact:
            break
        while True:
            came: dict = {("c", c): None for c in range(len(left)) if left[c]}
            todo, end = deque(came), None
            while todo and end is None:
                kind, x = todo.popleft()
                if kind == "c":
                    for leaf in options[x]:
                        if ("l", leaf) not in came:
                            came["l", leaf] = (kind, x)
                            if load[leaf] < caps[leaf]:
                                end = leaf
                                break
                            todo.append(("l", leaf))
                else:
                    for c in back[x]:
                        if ("c", c) not in came:
                            came["c", c] = (kind, x)
                            todo.append(("c", c))
            if end is None:
                break
            steps, at = [], ("l", end)
            while came[at] is not None:
                steps.append((came[at], at))
                at = came[at]
            n = min([left[at[1]], caps[end] - load[end], *(given[b[1], a[1]] for a, b in steps if a[0] == "l")])
            for a, b in steps:
                key, d = ((a[1], b[1]), n) if a[0] == "c" else ((b[1], a[1]), -n)
                given[key] = given.get(key, 0) + d
                (back[key[1]].add if given[key] else back[key[1]].discard)(key[0])
            left[at[1]] -= n
            load[end] += n
        if caps is floor and any(a < b for a, b in zip(load, floor, strict=True)):
            return None
    return None if exact and any(left) else {k: n for k, n in given.items() if n}


def _reach(t: Tree, options: list[tuple], low: list[int], high: list[int]) -> tuple[list[int], list[int]]:
    """Arcs that have to and that may go to every leaf, from classes of low..high arcs."""
    least, most = [0] * len(t.leaves), [0] * len(t.leaves)
    for leaves, a, b in zip(options, low, high, strict=True):
        for i in leaves:
            most[i] += b
        if len(leaves) == 1:
            least[leaves[0]] += a
    return least, most


def assignment(e, options: list[tuple[tuple, int]]) -> dict | None:
    """{(number of the class, symbol): arcs} with a bag in the language of ``e``, or None; options: (symbols an arc may take, how many such arcs)."""
    t = tree(e)
    leaves = [tuple(i for s in names for i in t.taking.get(s, ())) for names, _ in options]
    supply = [n for _, n in options]
    if any(n and not x for n, x in zip(supply, leaves, strict=True)):
        return None
    least, most = _reach(t, leaves, supply, supply)
    todo = [t.start(sum(supply))]
    while todo:
        low, high = todo.pop()
        bounds = t.tighten(low, high, least, most)
        made = None if bounds is None else flow(supply, leaves, *bounds)
        if made is None:
            continue
        bag: dict[int, int] = {}
        for (_, i), n in made.items():
            bag[t.leaves[i]] = bag.get(t.leaves[i], 0) + n
        lo, hi = rbe.interval(t.expr, bag)
        if lo <= 1 <= hi:
            out: dict[tuple, int] = {}
            for (c, i), n in made.items():
                key = (c, t.names[t.leaves[i]])
                out[key] = out.get(key, 0) + n
            return out
        v = next(v for v in range(len(low)) if low[v] < high[v])
        middle = (low[v] + high[v]) // 2
        upper, lower = list(low), list(high)
        upper[v], lower[v] = middle + 1, middle
        todo += [(upper, high), (list(low), lower)]
    return None


def possible(e, options: list[tuple[tuple, int, int]]) -> bool:
    """False only if no numbers of arcs within low..high of each class fit; options: (symbols, low, high)."""
    t = tree(e)
    leaves = [tuple(i for s in names for i in t.taking.get(s, ())) for names, _, _ in options]
    low, high = [a for _, a, _ in options], [b for _, _, b in options]
    if any(a and not x for a, x in zip(low, leaves, strict=True)):
        return False
    bounds = t.tighten(*t.start(sum(high)), *_reach(t, leaves, low, high))
    # leaves' lower bounds by all arcs there may be, and classes' by all the room there is: if both can be had, so can both at once
    return bounds is not None and flow(high, leaves, bounds[0], bounds[1], exact=False) is not None and flow(low, leaves, [0] * len(bounds[0]), bounds[1]) is not None
