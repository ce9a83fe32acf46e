"""Shape paths over tables of schemas."""

import pytest

from shapeloom.schema.ast import SchemaError
from shapeloom.shapepath import tables

P = "PREFIX : <http://e/> "
TEXT = P + "start = @:A :A { :p @:B ; ( :q . | :r [1 2] ) } AND NOT @:C OR IRI :B CLOSED { :p { :s . } } :C { }"
NAMES = {"": "http://e/"}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(1, TEXT), (2, P + ":A { :p . }"), (3, P), (4, None)]
    return tables.nodes(spark.createDataFrame(rows, "key long, text string")).cache()


def names(spark, nodes, path, key=1):
    found = tables.evaluate(nodes, tables.parse(path, NAMES)).join(nodes.select("key", "first", "kind", "name"), ["key", "first"]).where(f"key = {key}").orderBy("first").collect()
    return [f"{r['kind']}{' ' + r['name'].replace('http://e/', ':') if r['name'] else ''}" for r in found]


def test_numbers_hold_subtrees(nodes):
    rows = {r["first"]: r for r in nodes.where("key = 1").collect()}
    assert sorted(rows) == list(range(len(rows))) and rows[0]["last"] == len(rows) - 1 and rows[0]["parent"] is None
    for r in rows.values():
        if r["parent"] is not None:
            assert rows[r["parent"]]["first"] < r["first"] <= r["last"] <= rows[r["parent"]]["last"]
    assert nodes.where("key = 3").count() == 1 and nodes.where("key = 4").count() == 0


@pytest.mark.parametrize(
    "path, want",
    [
        ("/*", ["shaperef START", "shapeor :A", "shape :B", "shape :C"]),
        ("/@:A/shapeand/shape//tripleconstraint", ["tripleconstraint :p", "tripleconstraint :q", "tripleconstraint :r"]),
        ("//:p", ["tripleconstraint :p", "tripleconstraint :p"]),
        ("//oneof/*", ["tripleconstraint :q", "tripleconstraint :r"]),
        ("//tripleconstraint except //oneof/*", ["tripleconstraint :p", "tripleconstraint :p", "tripleconstraint :s"]),
        ("//tripleconstraint intersect /@:A//* , /@:C", ["tripleconstraint :p", "tripleconstraint :q", "tripleconstraint :r", "shape :C"]),
        ("/@:B//shape/:s | //shapenot/*", ["shaperef :C", "tripleconstraint :s"]),
        ("/@:A/nested-or-self-shape-expression shaperef", ["shaperef :B", "shaperef :C"]),
        ("/@:B/child tripleconstraint", ["tripleconstraint :p"]),
        ("/@:Z//*", []),
        ("/<http://e/C>", ["shape :C"]),
    ],
)
def test_paths(spark, nodes, path, want):
    assert names(spark, nodes, path) == want


def test_every_schema_answers_for_itself(spark, nodes):
    assert names(spark, nodes, "//tripleconstraint", 2) == ["tripleconstraint :p"] and names(spark, nodes, "//*", 3) == []


@pytest.mark.parametrize("path", ["", "shape", "/", "//x:y", "/shape extra", "/shape except", "/@shape"])
def test_what_is_no_path(path):
    with pytest.raises(SchemaError):
        tables.parse(path, NAMES)
