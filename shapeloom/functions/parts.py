"""Shapes over parts of a node's arcs: whether arcs can be dealt so that every base holds on its part and the rest on its own.

Arcs come as classes: those of one path that satisfy the same constraints.  If
every part has to satisfy one shape, or one of several, all parts together are
one assignment.  Otherwise (several shapes on one part, negation) the numbers
of arcs that each part gets are bounded by what its shapes can take, and halved
until they are settled.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from . import assign, rbe


@dataclass(frozen=True)
class Flat:
    """One shape: its bag expression, the paths it mentions and those it lets have further values."""

    expr: object
    paths: frozenset
    extra: frozenset


@dataclass(frozen=True)
class OnNode:
    """A condition on the node itself, by its number."""

    at: int


@dataclass(frozen=True)
class All:
    items: tuple


@dataclass(frozen=True)
class Any:
    items: tuple


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Parts:
    items: tuple


@dataclass(frozen=True)
class Arcs:
    """Arcs first..first+n-1 of a class, with their path and the constraints that each of them satisfies."""

    path: object
    symbols: tuple
    n: int
    number: int = 0
    first: int = 0

    def cut(self, at: int, n: int) -> Arcs:
        return Arcs(self.path, self.symbols, n, self.number, self.first + at)


def paths(tree) -> frozenset:
    if isinstance(tree, Flat):
        return tree.paths
    if isinstance(tree, OnNode):
        return frozenset()
    if isinstance(tree, Not):
        return paths(tree.item)
    return frozenset().union(*(paths(x) for x in tree.items))


def holds(tree, classes: list[tuple], flags: int = 0) -> bool:
    """classes: (path, symbols of the constraints that each of the arcs satisfies, how many arcs); flags: bits of the conditions on the node."""
    return deal(tree, [Arcs(p, s, n, i) for i, (p, s, n) in enumerate(classes)], flags) is not None


def deal(tree, classes: list[Arcs], flags: int = 0) -> list[tuple] | None:
    """(class, symbol, first arc, arcs) of a way to deal that satisfies the tree, or None.  An arc may serve in several shapes over one part."""
    if isinstance(tree, OnNode):
        return [] if flags >> tree.at & 1 else None
    if isinstance(tree, All):
        found = []
        for x in tree.items:
            if (some := deal(x, classes, flags)) is None:
                return None
            found += some
        return found
    if isinstance(tree, Any):
        return next((f for x in tree.items if (f := deal(x, classes, flags)) is not None), None)
    if isinstance(tree, Not):
        return [] if deal(tree.item, classes, flags) is None else None
    if isinstance(tree, Parts):
        return _dealt(tree.items, classes, flags)
    return _joint([tree], [(a, [0]) for a in classes])


def _taken(f: Flat, a: Arcs) -> tuple | None:
    """Symbols of a shape that arcs may be dealt to; () if they may stay without one, None if the shape does not have them."""
    mine = tuple(s for s in a.symbols if s in set(rbe.symbols(f.expr)))
    return mine if mine or a.path not in f.paths or a.path in f.extra else None


def _joint(flats: list[Flat], classes: list[tuple[Arcs, list[int]]]) -> list[tuple] | None:
    """A way to deal arcs to shapes, each with a part of its own; classes: arcs and the shapes that may get them."""
    free = {i: ("free", i) for i in range(len(flats))}
    options = []
    for a, takers in classes:
        names: tuple = ()
        for i in takers:
            mine = _taken(flats[i], a)
            names += () if mine is None else mine or (free[i],)
        options.append((names, a.n))
    e = rbe.And((*(f.expr for f in flats), *(rbe.Symbol(s, 0, None) for s in free.values())))
    made = assign.assignment(e, options)
    if made is None:
        return None
    out, at = [], [a.first for a, _ in classes]
    for (c, s), n in sorted(made.items(), key=repr):
        if not (isinstance(s, tuple) and s[0] == "free"):
            out.append((classes[c][0].number, s, at[c], n))
        at[c] += n
    return out


def _alternatives(tree, flags: int) -> list[Flat] | None:
    """The shapes of which a part has to satisfy one; None if that does not express the tree."""
    if isinstance(tree, Flat):
        return [tree]
    if isinstance(tree, OnNode):
        return [Flat(rbe.Empty(), frozenset(), frozenset())] if flags >> tree.at & 1 else []
    if isinstance(tree, Any):
        found = [_alternatives(x, flags) for x in tree.items]
        return None if None in found else [f for fs in found for f in fs]
    if isinstance(tree, All):
        found = [_alternatives(x, flags) for x in tree.items if not isinstance(x, OnNode)]
        if any(isinstance(x, OnNode) and not flags >> x.at & 1 for x in tree.items):
            return []
        return found[0] if len(found) == 1 else [Flat(rbe.Empty(), frozenset(), frozenset())] if not found else None
    return None


def _dealt(items: tuple, classes: list[Arcs], flags: int) -> list[tuple] | None:
    mentioned = [paths(x) for x in items]
    meant = [(a, t) for a in classes if (t := [i for i, m in enumerate(mentioned) if a.path in m])]
    choices = [_alternatives(x, flags) for x in items]
    if None not in choices:
        return next((f for flats in product(*choices) if (f := _joint(list(flats), meant)) is not None), None)
    return _searched(items, meant, flags)


def _possible(tree, arcs: list[tuple[Arcs, int, int]], flags: int) -> bool:
    """False only if no numbers of arcs within low..high of each class satisfy the tree."""
    if isinstance(tree, OnNode):
        return bool(flags >> tree.at & 1)
    if isinstance(tree, All):
        return all(_possible(x, arcs, flags) for x in tree.items)
    if isinstance(tree, Any):
        return any(_possible(x, arcs, flags) for x in tree.items)
    if not isinstance(tree, Flat):
        return True
    options = []
    for a, low, high in arcs:
        mine = _taken(tree, a)
        if mine is None and low:
            return False
        if mine:
            options.append((mine, low, high))
    return assign.possible(tree.expr, options)


def _first_flat(tree) -> Flat | None:
    if isinstance(tree, Flat):
        return tree
    return next((f for x in tree.items if (f := _first_flat(x))), None) if isinstance(tree, All | Any) else None


def _guesses(items: tuple, classes: list[tuple[Arcs, list[int]]], bounds: dict):
    """Numbers of arcs by class and part, within the bounds: as one shape of every part would have them, and the first parts first."""
    flats = [_first_flat(x) or Flat(rbe.Empty(), frozenset(), frozenset()) for x in items]
    at = [Arcs(a.path, a.symbols, a.n, c) for c, (a, _) in enumerate(classes)]
    made = _joint(flats, [(a, t) for a, (_, t) in zip(at, classes, strict=True)])
    if made is not None:
        y, left = dict.fromkeys(bounds, 0), [a.n for a in at]
        owner = {s: i for i, f in enumerate(flats) for s in rbe.symbols(f.expr)}
        for c, s, _, n in made:
            y[c, owner[s]] += n
            left[c] -= n
        for c, (_, takers) in enumerate(classes):
            y[c, takers[-1]] += left[c]
        if all(low <= y[k] <= high for k, (low, high) in bounds.items()):
            yield y
    y = {k: low for k, (low, _) in bounds.items()}
    for c, (a, takers) in enumerate(classes):
        left = a.n - sum(y[c, i] for i in takers)
        for i in takers:
            more = min(left, bounds[c, i][1] - y[c, i])
            y[c, i] += more
            left -= more
    yield y


def _searched(items: tuple, classes: list[tuple[Arcs, list[int]]], flags: int) -> list[tuple] | None:
    todo = [{(c, i): (0, a.n) for c, (a, takers) in enumerate(classes) for i in takers}]
    while todo:
        bounds = todo.pop()
        for c, (a, takers) in enumerate(classes):
            low, high = sum(bounds[c, i][0] for i in takers), sum(bounds[c, i][1] for i in takers)
            for i in takers:
                x, y = bounds[c, i]
                bounds[c, i] = max(x, a.n - (high - y)), min(y, a.n - (low - x))
        if any(x > y for x, y in bounds.values()):
            continue
        if not all(_possible(x, [(classes[c][0], *b) for (c, j), b in bounds.items() if j == i], flags) for i, x in enumerate(items)):
            continue
        for y in _guesses(items, classes, bounds):
            found, at = [], [0] * len(classes)
            for i, x in enumerate(items):
                part = []
                for c, (a, takers) in enumerate(classes):
                    if i in takers and y[c, i]:
                        part.append(a.cut(at[c], y[c, i]))
                        at[c] += y[c, i]
                if (some := deal(x, part, flags)) is None:
                    break
                found += some
            else:
                return found
        wide = [k for k, (x, y) in bounds.items() if x < y]
        if wide:
            k = max(wide, key=lambda k: bounds[k][1] - bounds[k][0])
            middle = sum(bounds[k]) // 2
            todo += [{**bounds, k: (middle + 1, bounds[k][1])}, {**bounds, k: (bounds[k][0], middle)}]
    return None
