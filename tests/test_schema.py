"""Parsers, codecs and analysis: driver-side only."""

import pytest

from shapeloom.schema import analyze, shexj
from shapeloom.schema.ast import SchemaError
from shapeloom.schema.shexc import parse
from shapeloom.schema.show import show
from shapeloom.shapepath import mapping

P = "PREFIX : <http://e/>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"

GOOD = [
    ":S { :p xsd:integer ; :q . * }",
    ":S CLOSED { :p [ 1 2.5 1e3 'x' \"y\"@en true <http://x/> ] }",
    ":S EXTRA :p { :p [ <http://a/>~ - <http://a/b>~ ] | ^:q IRI {2,4} }",
    ":S { $:e ( :p . ; :q . ){2} ; &:f } :T { $:f :r LITERAL + }",
    "start = @:S  :S IRI /^http/ AND NOT @:T OR { :p @:S ? }  :T BNODE",
    ":S { :p [ @en~ - @en-GB . ] }".replace(" . ]", " ]"),
    ":S { :p xsd:decimal MININCLUSIVE 1 MAXEXCLUSIVE 2.5 TOTALDIGITS 3 }",
    ":S { :p MINLENGTH 2 MAXLENGTH 4 /a\\/b/i }",
    "ABSTRACT :A { :p . } :B EXTENDS @:A { :q . } // :note 'x'",
    ":S { !:p . ; :q { :r . } } %:act{ print(s) %}",
    ":S { :p [ . - 'a' - 'b'~ ] } :E EXTERNAL",
    ":S { :p . {0} ; :q . {2,} ; a [ :S ] }",
]

BAD = [
    ":S { :p . ",
    ":S { :p xsd:string MININCLUSIVE 1 }",
    ":S { :p LENGTH 1 LENGTH 2 }",
    ":S { nope:p . }",
    ":S { :p . {3,2} }",
    ":S { !!:p . }",
    ":S { :p 'a\\qb' }",
    ":S { :p . } :S { :q . }",
    ":S { :p [ @~ - @~ ] }",
    ":S IRI MININCLUSIVE 3",
]


@pytest.mark.parametrize("text", GOOD)
def test_round_trips(text):
    schema = parse(P + text)
    assert analyze.same_schema(parse(show(schema)), schema)
    assert analyze.same_schema(shexj.loads(shexj.dumps(schema)), schema)


@pytest.mark.parametrize("text", BAD)
def test_rejects(text):
    with pytest.raises(SchemaError):
        parse(P + text)


@pytest.mark.parametrize(
    "text",
    [
        ":S { :p @:Missing }",
        ":S { &:missing }",
        ":S { :p NOT @:S }",
        ":S { :p @:T } :T { :q NOT @:S }",
        ":S EXTRA :p { :p @:S }",
        ":A EXTENDS @:B { } :B EXTENDS @:A { }",
    ],
)
def test_not_well_formed(text):
    assert analyze.problems(parse(P + text))


def test_well_formed_recursion_and_strata():
    schema = parse(P + ":S { :p @:S ; :q NOT @:T } :T { :r @:U } :U { :s @:T ? }")
    assert not analyze.problems(schema)
    order = analyze.strata(schema)
    assert order.index(["http://e/T", "http://e/U"]) < order.index(["http://e/S"])


def test_odd_and_even_negation():
    odd = analyze.dependencies(parse(P + ":S { :p NOT @:T } :T { :q @:S }"))
    even = analyze.dependencies(parse(P + ":S { :p NOT @:T } :T { :q NOT @:S }"))
    assert analyze.odd_negative_cycles(odd) and not analyze.odd_negative_cycles(even)
    assert analyze.negative_cycles(odd) and analyze.negative_cycles(even)


def test_inheritance():
    schema = parse(P + ":A { :p . } :B EXTENDS @:A { :q . } :C EXTENDS @:B { ^:r . }")
    assert analyze.ancestors(schema, "http://e/C") == {"http://e/A", "http://e/B"}
    assert analyze.descendants(schema, "http://e/A") == {"http://e/B", "http://e/C"}
    assert analyze.paths(schema, "http://e/C") == {("http://e/p", False), ("http://e/q", False), ("http://e/r", True)}


def test_difference():
    a, b = parse(P + ":S { :p . } :T { :q . }"), parse(P + "PREFIX x: <http://x/> :S { :p . } :T { :q . + }")
    assert analyze.difference(a, b) == ["prefix x: None / http://x/", "shape http://e/T"]


def test_shape_path_and_mapping():
    schema = parse(P + ":S { :p . ; :q [ 1 ] ; :p IRI }")
    found, errors = mapping.evaluate(schema, mapping.parse_path("/@:S/:p", prefixes=schema.prefixes))
    assert len(found) == 2 and not errors
    found, _ = mapping.evaluate(schema, mapping.parse_path("/@:S/:p[2]", prefixes=schema.prefixes))
    assert [t.value.kind for t in found] == ["iri"]
    found, errors = mapping.evaluate(schema, mapping.parse_path("/@:S/:none", prefixes=schema.prefixes))
    assert not found and errors
    changed = mapping.convert(schema, mapping.parse("PREFIX : <http://e/> /@:S/:p ~> <http://e/new>"))
    assert [t.predicate for t in changed.shape("http://e/S").expr.expression.exprs] == ["http://e/new", "http://e/q", "http://e/new"]
    with pytest.raises(SchemaError):
        mapping.parse_path("/@:S/:p | /@:T", prefixes=schema.prefixes)


def test_isomorphic_dependencies():
    deps = lambda text: analyze.dependencies(parse("PREFIX : <http://e/> " + text))
    a = deps(":A { :p @:B ; :q NOT @:C } :B { :p @:B ? } :C { :x . }")
    b = deps(":X { :x . } :Y { :p @:Y ? } :Z { :p @:Y ; :q NOT @:X }")
    assert analyze.isomorphic(a, b) == {"http://e/A": "http://e/Z", "http://e/B": "http://e/Y", "http://e/C": "http://e/X"}
    assert analyze.isomorphic(a, deps(":X { :x . } :Y { :p @:Y ? } :Z { :p @:Y ; :q @:X }")) is None
    assert analyze.isomorphic(a, deps(":Y { :p @:Z ? } :X { :x . } :Z { :p @:Y ; :q NOT @:X }")) is None
    ring = deps(":A { :p @:B } :B { :p @:C } :C { :p @:A }")
    assert analyze.isomorphic(ring, deps(":U { :p @:V } :V { :p @:W } :W { :p @:U }")) and analyze.isomorphic({}, {}) == {}
