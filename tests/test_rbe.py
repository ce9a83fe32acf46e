"""Bag expressions: intervals against derivatives, columns against numbers."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shapeloom.functions import rbe
from shapeloom.functions.rbe import And, Empty, Or, Repeat, Symbol, assignable, interval, matches, matches_columns, matches_derivative, matches_interval

_cards = st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 2))).map(lambda c: (c[0], None if c[1] is None else c[0] + c[1]))


def _exprs(names):
    if len(names) == 1:
        return _cards.map(lambda c: Symbol(names[0], *c))
    half = len(names) // 2
    pair = st.tuples(_exprs(names[:half]), _exprs(names[half:]))
    inner = st.one_of(pair.map(And), pair.map(Or))
    return st.one_of(inner, st.tuples(inner, _cards).map(lambda x: Repeat(x[0], *x[1])))


_bags = st.fixed_dictionaries({s: st.integers(0, 4) for s in "abcd"})


@given(_exprs("abcd"), _bags)
@settings(max_examples=400, deadline=None)
def test_interval_agrees_with_derivative(e, bag):
    assert matches_interval(e, bag) == matches_derivative(e, {s: n for s, n in bag.items() if n})


def test_interval_values():
    assert interval(Symbol("a", 2, 4), {"a": 2}) == (1, 1)
    assert interval(Empty(), {})[0] == 0
    assert matches(Or((Symbol("a"), Symbol("b"))), {"a": 1}) and not matches(Or((Symbol("a"), Symbol("b"))), {"a": 1, "b": 1})
    assert matches(And((Symbol("a", 1, 1), Symbol("a", 2, 2))), {"a": 3})


def test_assignment():
    e = And((Symbol(0), Symbol(1, 1, 2)))
    assert assignable(e, [((0,), 1), ((0, 1), 1)])
    assert not assignable(e, [((0,), 2)])


def test_columns_agree(spark):
    e = And((Repeat(Or((Symbol("a", 1, 2), Symbol("b", 0, 1))), 1, 3), Symbol("c", 0, None)))
    rows = [(a, b, c) for a in range(5) for b in range(4) for c in range(3)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = df.withColumn("ok", matches_columns(e, {s: F.col(s) for s in "abc"})).collect()
    assert all(r["ok"] == matches_derivative(e, {s: r[s] for s in "abc" if r[s]}) for r in got)


def test_open_bags():
    e = rbe.And((rbe.Symbol("a", 1, 2), rbe.Or((rbe.Symbol("b", 1, 1), rbe.Symbol("c", 1, 1)))))
    assert rbe.matches(e, {"a": 1, "c": 1, "z": 4}, open_=True) and not rbe.matches(e, {"a": 1, "c": 1, "z": 4}) and not rbe.matches(e, {"a": 3, "c": 1}, open_=True)


def _random_expression(r, depth, names):
    from shapeloom.functions import rbe

    kind = r.random()
    cards = [(1, 1), (0, 1), (0, None), (1, None), (2, 3), (0, 2), (2, 2), (1, 2)]
    if depth == 0 or kind < 0.25:
        return rbe.Symbol(names.pop(), *r.choice(cards)) if names else rbe.Empty()
    if kind < 0.75:
        return (rbe.And if kind < 0.5 else rbe.Or)(tuple(_random_expression(r, depth - 1, names) for _ in range(r.randint(1, 3))))
    return rbe.Repeat(_random_expression(r, depth - 1, names), *r.choice(cards))


def test_assignments_agree_with_all_splits():
    import random
    from itertools import product

    from shapeloom.functions import assign, rbe

    r, met = random.Random(11), 0
    for _ in range(3000):
        names = ["a", "b", "c", "d", *(["a"] if r.random() < 0.2 else [])]
        r.shuffle(names)
        e = _random_expression(r, 3, names)
        known = sorted(set(rbe.symbols(e))) or ["z"]
        options = [(tuple(sorted(r.sample(known, r.randint(1, len(known))))), r.randint(0, 4)) for _ in range(r.randint(0, 3))]
        want = False
        for dealt in product(*(list(rbe.splits(n, len(s))) for s, n in options)):
            bag: dict = {}
            for (s, _), split in zip(options, dealt, strict=True):
                for name, n in zip(s, split, strict=True):
                    bag[name] = bag.get(name, 0) + n
            want = want or rbe.matches(e, bag)
        got = assign.assignment(e, options)
        assert (got is not None) == want, (e, options)
        if got is not None:
            bag = {}
            for (c, s), n in got.items():
                assert s in options[c][0]
                bag[s] = bag.get(s, 0) + n
            assert rbe.matches(e, bag) and all(sum(n for (c, _), n in got.items() if c == i) == n_ for i, (_, n_) in enumerate(options))
            assert assign.possible(e, [(s, max(0, n - 1), n + 1) for s, n in options])
        met += want
    assert 500 < met < 2500


def test_large_counts_are_solved_at_once():
    import time

    from shapeloom.functions import assign, parts, rbe

    s = rbe.Symbol
    e = rbe.Or((rbe.And((s(0, 1, None), s(1, 2, 4000), s(2, 0, 3000))), rbe.Repeat(rbe.And((s(3, 1, 1), s(4, 1, 2))), 1, None), s(5, 0, None)))
    began = time.time()
    assert assign.assignment(e, [((0, 3), 2500), ((1, 4), 3000), ((2, 3, 4), 2500), ((0, 1, 2, 3, 4, 5), 2000)])
    assert assign.assignment(e, [((3, 4), 10_001)]) and assign.assignment(e, [((3,), 3333), ((4,), 6667)]) is None
    pairs = rbe.Repeat(rbe.And((s(0, 2, 2), s(1, 3, 3))), 0, None)
    assert assign.assignment(pairs, [((0, 1), 9999)]) is None and assign.assignment(pairs, [((0, 1), 10_000)]) == {(0, 0): 4000, (0, 1): 6000}
    flat = lambda x: parts.Flat(x, frozenset("p"), frozenset())
    tree = parts.Parts((parts.All((flat(s(0, 1, None)), parts.Not(flat(s(1, 0, 3000))))), flat(rbe.And((s(2, 2, None), s(3, 0, 5))))))
    assert parts.holds(tree, [("p", (0, 1, 2), 9000), ("p", (0, 2, 3), 1000)]) and not parts.holds(tree, [("p", (0, 1, 2), 3000)])
    assert time.time() - began < 5
