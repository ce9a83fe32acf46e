"""Entities, RDF form and imports of schemas, streams."""

import gzip
import json

import pytest

from shapeloom.schema import analyze, resolve, shexr
from shapeloom.schema.ast import SchemaError
from shapeloom.schema.shexc import parse
from shapeloom.sources import graph, rdf
from shapeloom.streaming import local
from shapeloom.wikibase import model, entityschema
from shapeloom.wikibase import rdf as entity_rdf
from shapeloom.wikibase.matcher import Matcher

P = "PREFIX : <http://www.wikidata.org/entity/>\n"


def snak(p, kind, value, snaktype="value"):
    body = {"wikibase-entityid": {"id": value}, "string": value, "quantity": {"amount": value}, "time": {"time": value}}[kind]
    return {"snaktype": snaktype, "property": p} | ({"datavalue": {"type": kind, "value": body}} if snaktype == "value" else {})


DUMP = [
    {
        "id": "Q42", "type": "item", "labels": {"en": {"language": "en", "value": "Douglas"}}, "descriptions": {}, "aliases": {"en": [{"language": "en", "value": "DNA"}]},
        "claims": {
            "P31": [{"mainsnak": snak("P31", "wikibase-entityid", "Q5"), "rank": "normal", "qualifiers": {"P1": [snak("P1", "string", "x")]}, "references": [{"snaks": {"P2": [snak("P2", "string", "y")]}}]}],
            "P734": [{"mainsnak": snak("P734", "string", "Adams"), "rank": "preferred"}, {"mainsnak": snak("P734", "string", "Noel"), "rank": "normal"}],
            "P569": [{"mainsnak": snak("P569", "time", "+1952-03-00T00:00:00Z"), "rank": "normal"}],
        },
    },
    {"id": "Q43", "type": "item", "labels": {}, "claims": {"P31": [{"mainsnak": snak("P31", "wikibase-entityid", "Q5")}, {"mainsnak": snak("P31", "wikibase-entityid", "Q6")}], "P40": [{"mainsnak": snak("P40", "wikibase-entityid", "Q42")}], "P9": [{"mainsnak": snak("P9", "string", "", "novalue")}]}},
]


@pytest.fixture(scope="module")
def entities(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "dump.json.gz"
    lines = ["[", *(json.dumps(e) + "," for e in DUMP[:1]), json.dumps(DUMP[1]), "no entity", "]"]
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    rows = model.read_dump(spark, str(path))
    assert rows.where("_bad IS NOT NULL").count() == 1
    return rows.where("_bad IS NULL").drop("_bad").cache()


@pytest.mark.parametrize(
    "schema, want",
    [
        ("<S> { }", {"Q42", "Q43"}),
        ("<S> { :P31 [ :Q5 ] }", {"Q42"}),
        ("<S> EXTRA :P31 { :P31 [ :Q5 ] }", {"Q42", "Q43"}),
        ("<S> { :P31 [ :Q5 :Q6 ] + }", {"Q42", "Q43"}),
        ("<S> EXTRA :P734 { :P734 /Ad/ }", {"Q42"}),
        ("<S> { :P734 /Ad/ }", set()),
        ("<S> { :P31 . {| :P1 . |} }", {"Q42"}),
        ("<S> { :P31 . + REFERENCES {| :P2 [ 'y' ] |} }", {"Q42"}),
        ("<S> LABEL (en -> .) { }", {"Q42"}),
        ("<S> ALIAS (en -> [ 'DNA' ]) { :P31 . }", {"Q42"}),
        ("start = @<T>  <S> { :P1 . }  <T> NOT @<S> AND { :P31 . {2} }", {"Q43"}),
        ("<S> { :P40 @<S> | :P569 . }", {"Q42", "Q43"}),
        ("<S> { :P31 [ <http://www.wikidata.org/entity/Q>~ ] * }", {"Q42", "Q43"}),
    ],
)
def test_matching(entities, schema, want):
    m = Matcher(entityschema.parse(P + schema, "http://x/"))
    assert {r["id"] for r in m.filter(entities).collect()} == want


def test_projection_graph_and_closed(entities):
    m = Matcher(entityschema.parse(P + "<S> EXTRA :P31 { :P31 [ :Q5 ] }", "http://x/"))
    assert {(r["id"], len(r["statements"])) for r in m.filter(entities, project=True).collect()} == {("Q42", 1), ("Q43", 1)}
    assert Matcher(m.schema, check_closed=True).filter(entities).count() == 2
    schema = entityschema.parse(P + "<P> { :P40 @<H> } <H> EXTRA :P31 { :P31 [ :Q5 ] ; :P734 . + }", "http://x/")
    got = {r["id"]: r["ok_shapes"] for r in Matcher(schema).match_graph(entities).collect()}
    assert got == {"Q42": ["http://x/H"], "Q43": ["http://x/P"]}


@pytest.mark.parametrize(
    "schema, label, want",
    [
        ("<P> { :P40 @<H> } <H> EXTRA :P31 { :P31 [ :Q5 ] ; :P734 . + }", "P", {"Q42": ["too-few P40"], "Q43": []}),
        ("<P> { :P40 @<N> } <N> NOT @<H> <H> { :P734 . + }", "P", {"Q42": ["too-few P40"], "Q43": ["no-match P40", "reference P40", "too-few P40"]}),
        ("<N> NOT @<H> <H> { :P734 . + }", "N", {"Q42": ["not"], "Q43": []}),
        ("<A> @<B> AND { :P40 . } <B> { :P734 . + }", "A", {"Q42": ["too-few P40"], "Q43": ["too-few P734"]}),
        ("<L> { :P40 @<L> }", "L", {"Q42": ["too-few P40"], "Q43": ["no-match P40", "reference P40", "too-few P40"]}),
        ("<L> EXTRA :P40 { :P40 @<H> } <H> { :P1 . }", "L", {"Q42": ["too-few P40"], "Q43": ["reference P40", "too-few P40"]}),
    ],
)
def test_reasons_along_references(entities, schema, label, want):
    m = Matcher(entityschema.parse(P + schema, "http://x/"))
    got = {r["id"]: r["reasons"] for r in m.reasons_graph(entities, "http://x/" + label).collect()}
    assert got == want
    held = {r["id"]: "http://x/" + label in r["ok_shapes"] for r in m.match_graph(entities).collect()}
    assert held == {k: not v for k, v in got.items()}


def test_entity_rdf(entities):
    t = {(r["s"].rsplit("/")[-1], r["p"].rsplit("/", 2)[-2] + "/" + r["p"].rsplit("/")[-1], r["o_lex"]) for r in entity_rdf.full(entities).collect()}
    assert ("Q42>", "direct/P734", "Adams") in t and ("Q42>", "direct/P734", "Noel") not in t
    assert any(p == "statement/P734" and o == "Noel" for _, p, o in t) and any(p == "qualifier/P1" and o == "x" for _, p, o in t)
    assert ("Q42>", "direct/P569", "1952-03-01T00:00:00Z") in t and not any(p.endswith("/P9") and "direct" in p for _, p, _ in t)
    assert {r["value"] for r in model.to_text(entities).collect()} == {"Q42 Douglas (4)", "Q43  (4)"}
    assert all(json.loads(r["value"])["id"] for r in model.to_json(entities).collect())


def test_entity_schema_conversion():
    plain = parse("PREFIX wdt: <http://www.wikidata.org/prop/direct/> PREFIX wd: <http://www.wikidata.org/entity/> <S> EXTRA wdt:P31 { wdt:P31 [ wd:Q5 ] ; wdt:P106 @<S> * }", "http://x/")
    there = entityschema.from_plain(plain)
    assert there.shapes[0].expr.extra == ("http://www.wikidata.org/entity/P31",)
    assert analyze.same_schema(entityschema.to_plain(there), plain)
    with pytest.raises(SchemaError):
        entityschema.to_plain(entityschema.parse(P + "<S> { :P1 . {| :P2 . |} }", "http://x/"))


@pytest.mark.parametrize("text", [":S CLOSED { :P1 [ :a 'b'@en 1 ] ; ^:P2 @:T {2,} } :T IRI AND NOT { :P3 xsd:decimal MAXEXCLUSIVE 2.5 // :n 'x' }", "ABSTRACT :A { :p . } :B EXTENDS @:A { :q [ <http://a/>~ - <http://a/b>~ ] }"])
def test_rdf_form(spark, text):
    schema = parse(P + "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n" + text)
    assert analyze.same_schema(shexr.from_triples(shexr.to_triples(schema)), schema)
    assert shexr.to_graph(spark, schema).df.count() == len(set(map(repr, shexr.to_triples(schema))))


def test_imports(tmp_path):
    (tmp_path / "b.shex").write_text("PREFIX : <http://e/> IMPORT <http://e/c> start = @:B :B { :q @:C }")
    (tmp_path / "c.json").write_text('{"type": "Schema", "imports": ["http://e/b"], "shapes": [{"type": "ShapeDecl", "id": "http://e/C", "shapeExpr": {"type": "Shape"}}]}')
    schema = resolve.closure(parse("PREFIX : <http://e/> IMPORT <http://e/b> :A { :p @:B }"), resolve.file_fetcher(str(tmp_path)))
    assert set(schema.labels) == {"http://e/A", "http://e/B", "http://e/C"} and schema.start is not None and not analyze.problems(schema)
    clash = parse("PREFIX : <http://e/> IMPORT <http://e/b> :B { }")
    with pytest.raises(SchemaError):
        resolve.closure(clash, resolve.file_fetcher(str(tmp_path)))
    with pytest.raises(SchemaError):
        resolve.load(str(tmp_path / "none"))


def test_streams(spark, tmp_path):
    g = graph.of_terms(spark, rdf.parse_turtle("PREFIX : <http://e/> :a :p 1 ; :q 2 . :b :p 'x' ; :q 2 . :c :q 2 ."))
    g.df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(g.df.schema).parquet(str(tmp_path / "in"))
    schema = parse("PREFIX : <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> :S { :p xsd:integer ; :q . }")
    q = local.flat_shape(stream, schema, "http://e/S").writeStream.outputMode("complete").format("memory").queryName("statuses").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["node"], r["status"]) for r in spark.table("statuses").collect()} == {("<http://e/a>", "conformant"), ("<http://e/b>", "nonconformant"), ("<http://e/c>", "nonconformant")}
    terms = stream.selectExpr("o_kind AS kind", "o_lex AS lex", "o_dt AS dt", "o_lang AS lang")
    q = local.node_constraints(terms, parse("<N> LITERAL MINLENGTH 1", "http://e/").shapes[0].expr).writeStream.format("memory").queryName("terms").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("terms").where("status = 'conformant'").count() == 5
    with pytest.raises(SchemaError):
        local.flat_shape(stream, parse("PREFIX : <http://e/> :S { :p @:S }"), "http://e/S")


def test_command_line(tmp_path, capsys, spark):
    from shapeloom.__main__ import main

    (tmp_path / "s.shex").write_text("PREFIX : <http://e/> :S { :p . } :T EXTENDS @:S { :q . }")
    (tmp_path / "d.ttl").write_text("PREFIX : <http://e/> :a :p 1 . :b :q 1 .")
    (tmp_path / "m.sm").write_text(":a@:S, :b@:S")
    (tmp_path / "r.map").write_text("/@:S/:p ~> <http://e/new>")
    s = ["--schema", str(tmp_path / "s.shex")]
    assert main(["validate", *s, "--data", str(tmp_path / "d.ttl"), "--map", str(tmp_path / "m.sm")]) == 0
    assert set(capsys.readouterr().out.split()) == {"<http://e/a>@<http://e/S>", "<http://e/b>@!<http://e/S>"}
    assert main(["schema", *s]) == 0 and ":S <- :T" in capsys.readouterr().out
    assert main(["convert", *s]) == 0 and '"TripleConstraint"' in capsys.readouterr().out
    assert main(["path", *s, "--path", "/@:S/:p"]) == 0 and main(["path", *s, "--path", "/@:X"]) == 1
    capsys.readouterr()
    assert main(["map", *s, "--mapping", str(tmp_path / "r.map")]) == 0 and ":new" in capsys.readouterr().out


def test_manifest(tmp_path, spark):
    from shapeloom.shapemap import manifest

    (tmp_path / "s.shex").write_text("PREFIX : <http://e/> :S { :p . }")
    (tmp_path / "bad.shex").write_text("PREFIX : <http://e/> :S { :p ")
    (tmp_path / "d.ttl").write_text("PREFIX : <http://e/> :a :p 1 . :b :q 1 .")
    (tmp_path / "m.sm").write_text("<http://e/a>@<http://e/S>, <http://e/b>@<http://e/S>")
    (tmp_path / "r.sm").write_text("<http://e/a>@<http://e/S>, <http://e/b>@!<http://e/S>")
    (tmp_path / "manifest.ttl").write_text(
        "PREFIX mf: <http://www.w3.org/2001/sw/DataAccess/tests/test-manifest#> PREFIX sht: <http://www.w3.org/ns/shacl/test-suite#> PREFIX : <http://e/>\n"
        "<> a mf:Manifest ; mf:entries ( <#1> <#2> <#3> <#4> ) .\n"
        "<#1> a sht:ValidationTest ; mf:name 'one' ; mf:action [ sht:schema <s.shex> ; sht:data <d.ttl> ; sht:shape :S ; sht:focus :a ] .\n"
        "<#2> a sht:ValidationFailure ; mf:name 'two' ; mf:action [ sht:schema <s.shex> ; sht:data <d.ttl> ; sht:shape :S ; sht:focus :b ] .\n"
        "<#3> a sht:Validate ; mf:name 'three' ; mf:action [ sht:schema <s.shex> ; sht:data <d.ttl> ; sht:map <m.sm> ] ; mf:result <r.sm> .\n"
        "<#4> a sht:NegativeSyntax ; mf:name 'four' ; sht:schema <bad.shex> .\n"
    )
    entries = manifest.read(str(tmp_path / "manifest.ttl"))
    assert [e.name for e in entries] == ["one", "two", "three", "four"]
    assert all(manifest.run(spark, e) for e in entries)
