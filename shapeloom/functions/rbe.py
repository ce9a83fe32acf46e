"""Regular bag expressions: membership of a bag of symbols.

A single-occurrence expression is decided by intervals: for a sub-expression,
the numbers of copies of it that use up its share of the bag exactly form an
interval, from which the parent's follows.  The same arithmetic runs on
numbers and on columns.  Expressions that repeat a symbol use derivatives.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = 1 << 40


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class Fail:
    pass


@dataclass(frozen=True)
class Symbol:
    name: int | str
    min: int = 1
    max: int | None = 1


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Repeat:
    item: object
    min: int = 0
    max: int | None = None


def star(e) -> Repeat:
    return Repeat(e, 0, None)


def plus(e) -> Repeat:
    return Repeat(e, 1, None)


def symbols(e) -> list:
    if isinstance(e, Symbol):
        return [e.name]
    if isinstance(e, And | Or):
        return [s for x in e.items for s in symbols(x)]
    return symbols(e.item) if isinstance(e, Repeat) else []


def single_occurrence(e) -> bool:
    s = symbols(e)
    return len(s) == len(set(s))


# intervals over numbers -----------------------------------------------------

EMPTY = (1, 0)


def _split(lo: int, hi: int, n: int, m: int | None) -> tuple[int, int]:
    """Copies k with n*k..m*k meeting lo..hi."""
    if lo > hi:
        return EMPTY
    low = 0 if lo == 0 else 1 if m is None else INF if m == 0 else -(-lo // m)
    high = INF if n == 0 or hi >= INF else hi // n
    return (low, high) if low < INF else EMPTY


def interval(e, bag: dict) -> tuple[int, int]:
    if isinstance(e, Empty):
        return (0, INF)
    if isinstance(e, Fail):
        return (0, 0)
    if isinstance(e, Symbol):
        w = bag.get(e.name, 0)
        return _split(w, w, e.min, e.max)
    if isinstance(e, And):
        parts = [interval(x, bag) for x in e.items]
        return (max([0, *(p[0] for p in parts)]), min([INF, *(p[1] for p in parts)]))
    if isinstance(e, Or):
        parts = [interval(x, bag) for x in e.items]
        if any(lo > hi for lo, hi in parts):
            return EMPTY
        return (sum(p[0] for p in parts), min(INF, sum(p[1] for p in parts)))
    return _split(*interval(e.item, bag), e.min, e.max)


def matches_interval(e, bag: dict) -> bool:
    """Single-occurrence expressions only."""
    known = set(symbols(e))
    if any(n and s not in known for s, n in bag.items()):
        return False
    lo, hi = interval(e, bag)
    return lo <= 1 <= hi


# intervals over columns -----------------------------------------------------


def _split_columns(lo: Column, hi: Column, n: int, m: int | None) -> tuple[Column, Column]:
    low = F.when(lo == 0, 0).otherwise(F.lit(1) if m is None else F.lit(INF) if m == 0 else F.ceil(lo / m))
    high = F.lit(INF) if n == 0 else F.when(hi >= INF, INF).otherwise(F.floor(hi / n))
    empty = lo > hi
    return F.when(empty, 1).otherwise(low).cast("long"), F.when(empty, 0).otherwise(high).cast("long")


def interval_columns(e, counts: dict) -> tuple[Column, Column]:
    """The interval as two long columns; counts: symbol to a long column, never null."""
    zero, inf = F.lit(0).cast("long"), F.lit(INF).cast("long")
    if isinstance(e, Empty):
        return zero, inf
    if isinstance(e, Fail):
        return zero, zero
    if isinstance(e, Symbol):
        w = counts[e.name]
        return _split_columns(w, w, e.min, e.max)
    if isinstance(e, And):
        lows, highs = zip(*(interval_columns(x, counts) for x in e.items), strict=True) if e.items else ((), ())
        return F.greatest(zero, zero, *lows), F.least(inf, inf, *highs)
    if isinstance(e, Or):
        parts = [interval_columns(x, counts) for x in e.items]
        empty, low, high = F.lit(False), zero, zero
        for lo, hi in parts:
            empty, low, high = empty | (lo > hi), low + lo, F.least(inf, high + hi)
        return F.when(empty, 1).otherwise(low).cast("long"), F.when(empty, 0).otherwise(high).cast("long")
    return _split_columns(*interval_columns(e.item, counts), e.min, e.max)


def matches_columns(e, counts: dict) -> Column:
    lo, hi = interval_columns(e, counts)
    return (lo <= 1) & (hi >= 1)


# derivatives ----------------------------------------------------------------


def nullable(e) -> bool:
    if isinstance(e, Empty):
        return True
    if isinstance(e, Fail):
        return False
    if isinstance(e, Symbol):
        return e.min == 0
    if isinstance(e, And):
        return all(nullable(x) for x in e.items)
    if isinstance(e, Or):
        return any(nullable(x) for x in e.items)
    return e.min == 0 or nullable(e.item)


def _and(items) -> object:
    flat = []
    for x in items:
        if isinstance(x, Fail):
            return Fail()
        flat += x.items if isinstance(x, And) else [] if isinstance(x, Empty) else [x]
    return Empty() if not flat else flat[0] if len(flat) == 1 else And(tuple(sorted(flat, key=repr)))


def _or(items) -> object:
    flat = {}
    for x in items:
        for y in x.items if isinstance(x, Or) else [] if isinstance(x, Fail) else [x]:
            flat[y] = None
    return Fail() if not flat else next(iter(flat)) if len(flat) == 1 else Or(tuple(flat))


def _repeat(e, n: int, m: int | None):
    if isinstance(e, Fail):
        return Empty() if n == 0 else Fail()
    if isinstance(e, Empty) or m == 0:
        return Empty()
    return e if (n, m) == (1, 1) else Repeat(e, n, m)


@lru_cache(maxsize=100_000)
def derivative(e, s):
    """What is left of an expression after one symbol."""
    if isinstance(e, Symbol):
        if e.name != s or e.max == 0:
            return Fail()
        n, m = max(e.min - 1, 0), None if e.max is None else e.max - 1
        return Empty() if m == 0 else Symbol(s, n, m)
    if isinstance(e, And):
        return _or(_and([derivative(x, s), *e.items[:i], *e.items[i + 1 :]]) for i, x in enumerate(e.items))
    if isinstance(e, Or):
        return _or(derivative(x, s) for x in e.items)
    if isinstance(e, Repeat) and e.max != 0:
        d = derivative(e.item, s)
        n, m = max(e.min - 1, 0), None if e.max is None else e.max - 1
        return _and([d, _repeat(e.item, n, m)])
    return Fail()


def matches_derivative(e, bag: dict) -> bool:
    for s, n in sorted(bag.items(), key=lambda x: repr(x[0])):
        for _ in range(n):
            e = derivative(e, s)
            if isinstance(e, Fail):
                return False
    return nullable(e)


def matches(e, bag: dict, open_: bool = False) -> bool:
    """Whether a bag is in the expression's language; ``open_`` lets symbols be that it does not mention."""
    known = set(symbols(e)) if open_ else bag
    bag = {s: n for s, n in bag.items() if n and s in known}
    return matches_interval(e, bag) if single_occurrence(e) else matches_derivative(e, bag)


def assignable(e, options: list[tuple[tuple, int]]) -> bool:
    """Whether arcs can be assigned to symbols so that the bag matches; options: (symbols an arc may take, how many such arcs)."""
    from .assign import assignment

    return assignment(e, options) is not None


def splits(n: int, k: int):
    if k == 1:
        yield (n,)
        return
    for first in range(n, -1, -1):
        for rest in splits(n - first, k - 1):
            yield (first, *rest)
