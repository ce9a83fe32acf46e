"""Graphs up to the names of blank nodes."""

import random

import pytest

from shapeloom.operators import blanks, reach
from shapeloom.sources import graph, rdf

P = "PREFIX : <http://e/>\n"


def triples(spark, ttl, rename=None):
    g = graph.of_terms(spark, rdf.parse_turtle(P + ttl)).df
    if rename is None:
        return g
    rows = [tuple(r) for r in g.collect()]
    names = sorted({x for s, _, k, o, *_ in rows for x in ([s] if s.startswith("_:") else []) + ([o] if k == "bnode" else [])})
    r = random.Random(rename)
    new = [f"_:n{i}" for i in range(len(names))]
    r.shuffle(new)
    to = dict(zip(names, new, strict=True))
    rows = [(to.get(s, s), p, k, to[o] if k == "bnode" else o, *rest) for s, p, k, o, *rest in rows]
    r.shuffle(rows)
    return spark.createDataFrame(rows, g.schema)


CYCLE = lambda n: " ".join(f"_:c{i} :next _:c{(i + 1) % n} ." for i in range(n))
TWO = CYCLE(3) + " " + CYCLE(3).replace("_:c", "_:d")
GRAPHS = {
    "list": ":a :p ( 1 2 [ :q 3 ] ) .",
    "copies": ":a :p [ :q 1 ], [ :q 1 ], [ :q 2 ] .",
    "cycle": CYCLE(6),
    "two": TWO,
    "named": "_:x :p :a . _:y :p :a . _:x :q _:y .",
    "ground": ":a :p :b .",
    "square": "_:a :e _:b . _:b :e _:c . _:c :e _:d . _:d :e _:a . _:a :f _:c . _:b :f _:d .",
}


@pytest.mark.parametrize("name", GRAPHS)
def test_renamed_graphs_are_equal(spark, name):
    assert blanks.same_graph(triples(spark, GRAPHS[name]), triples(spark, GRAPHS[name], rename=3))


@pytest.mark.parametrize(
    "a, b",
    [
        (GRAPHS["cycle"], GRAPHS["two"]),
        (GRAPHS["list"], ":a :p ( 2 1 [ :q 3 ] ) ."),
        (GRAPHS["copies"], ":a :p [ :q 1 ], [ :q 2 ], [ :q 2 ] ."),
        (GRAPHS["named"], "_:x :p :a . _:y :p :a . _:y :q _:y ."),
        (GRAPHS["ground"], ":a :p :c ."),
        (GRAPHS["copies"], ":a :p [ :q 1 ], [ :q 2 ] ."),
        ("_:x :p _:y .", "_:x :p _:x ."),
    ],
)
def test_changed_graphs_are_not(spark, a, b):
    assert not blanks.same_graph(triples(spark, a), triples(spark, b, rename=5))


def test_result_maps_up_to_names(spark):
    a, b = triples(spark, GRAPHS["list"]), triples(spark, GRAPHS["list"], rename=9)
    la, lb = blanks.labels(a), blanks.labels(b)
    result = lambda known, bad: known.selectExpr("node", "'S' AS shape", f"IF({bad}, 'nonconformant', 'conformant') AS status")
    assert blanks.compare_results(result(la, "false"), result(lb, "false"), la, lb).isEmpty()
    one = lb.first()["node"]
    assert blanks.compare_results(result(la, "false"), result(lb, f"node = '{one}'"), la, lb).count() == 2


def test_large_tied_parts_raise(spark, monkeypatch):
    monkeypatch.setattr(blanks, "MOST", 4)
    with pytest.raises(ValueError, match="look alike"):
        blanks.form(triples(spark, GRAPHS["cycle"]))


def test_what_hangs_together(spark):
    r = random.Random(4)
    edges = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in edges:
        root[max(find(x), find(y))] = min(find(x), find(y))
    got = {r["node"]: r["component"] for r in reach.undirected(spark.createDataFrame(edges, "start string, node string")).collect()}
    assert got == {x: find(x) for x in root}
