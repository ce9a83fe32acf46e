"""Reachability: counts, components and interval labels against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from shapeloom.operators import reach


def brute(edges):
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for s in out:
        seen, todo = set(), [s]
        while todo:
            for t in out.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        found[s] = seen
    return found


def table(spark, edges):
    return spark.createDataFrame(edges, "start string, node string")


R = random.Random(5)
GRAPHS = {
    "chain": [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n0", "n1")],
    "one out": [(f"n{i}", f"n{R.randrange(14)}") for i in range(14)] + [("x", "n3"), ("s", "s")],
    "one in": [(f"n{R.randrange(14)}", f"n{i}") for i in range(14)] + [("n3", "x")],
    "tree": [(f"n{R.randrange(i)}", f"n{i}") for i in range(1, 15)],
    "any": [(f"n{R.randrange(12)}", f"n{R.randrange(12)}") for _ in range(18)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_counts(spark, name):
    got = {r["start"]: r["reached"] for r in reach.counts(table(spark, GRAPHS[name])).collect()}
    assert got == {k: len(v) for k, v in brute(GRAPHS[name]).items()}


@pytest.mark.parametrize("name", ["any", "one out", "empty"])
def test_components(spark, name):
    edges = GRAPHS[name]
    found = brute(edges)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in reach.components(table(spark, edges)).collect()}
    assert set(got) == nodes
    for a in nodes:
        for b in nodes:
            assert (got[a] == got[b]) == (a == b or b in found.get(a, ()) and a in found.get(b, ()))


def test_intervals(spark):
    edges = [*GRAPHS["tree"], ("m0", "m1"), ("m0", "m2"), ("m2", "m3")]
    found = brute(edges)
    label = {r["node"]: (r["first"], r["last"]) for r in reach.intervals(table(spark, edges)).collect()}
    assert len({a for a, _ in label.values()}) == len(label)
    for a in label:
        for b in label:
            assert (label[a][0] < label[b][0] <= label[a][1]) == (b in found.get(a, ()))
    for wrong in ([("a", "c"), ("b", "c")], [("a", "b"), ("b", "a")]):
        with pytest.raises(ValueError, match="not a forest"):
            reach.intervals(table(spark, wrong))


def test_a_long_chain(spark):
    n = 100_000
    edges = spark.range(n).select(F.col("id").cast("string").alias("start"), (F.col("id") + 1).cast("string").alias("node"))
    got = reach.counts(edges)
    assert got.where(F.col("reached") != n - F.col("start").cast("long")).isEmpty() and got.count() == n
