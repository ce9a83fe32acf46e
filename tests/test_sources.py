"""Documents in every syntax, to triples."""

import pytest
from pyspark.sql import functions as F

from shapeloom.functions.terms import literal_id
from shapeloom.schema.ast import SchemaError
from shapeloom.sources import graph, jsonld, rdf, rdfxml

HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/d">'

#: The same graphs in Turtle, RDF/XML and JSON-LD.
SAME = [
    ("<http://e/a> a <http://e/P> ; <http://e/n> 'x'@en , 'y' .", '<e:P rdf:about="http://e/a" e:n="y"><e:n xml:lang="en">x</e:n></e:P>', '{"@id": "http://e/a", "@type": "http://e/P", "http://e/n": [{"@value": "x", "@language": "en"}, "y"]}'),
    ("<http://b/d#i> <http://e/k> <http://b/x> , 4 .", '<rdf:Description rdf:ID="i"><e:k rdf:resource="x"/><e:k rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">4</e:k></rdf:Description>', '{"@context": {"k": "http://e/k"}, "@id": "#i", "k": [{"@id": "x"}, 4]}'),
    ("<http://e/a> <http://e/l> ( <http://e/b> <http://e/c> ) .", '<rdf:Description rdf:about="http://e/a"><e:l rdf:parseType="Collection"><rdf:Description rdf:about="http://e/b"/><rdf:Description rdf:about="http://e/c"/></e:l></rdf:Description>', '{"@context": {"e": "http://e/", "l": {"@id": "e:l", "@type": "@id", "@container": "@list"}}, "@id": "e:a", "l": ["e:b", "e:c"]}'),
    ("<http://e/a> <http://e/p> [ <http://e/q> true ] .", '<rdf:Description rdf:about="http://e/a"><e:p rdf:parseType="Resource"><e:q rdf:datatype="http://www.w3.org/2001/XMLSchema#boolean">true</e:q></e:p></rdf:Description>', '{"@context": {"@vocab": "http://e/"}, "@id": "http://e/a", "p": {"q": true}}'),
    ("<http://e/a> <http://e/p> _:x . _:x <http://e/p> <http://e/a> .", '<rdf:Description rdf:about="http://e/a"><e:p rdf:nodeID="x"/></rdf:Description><rdf:Description rdf:nodeID="x"><e:p rdf:resource="http://e/a"/></rdf:Description>', '{"@context": {"@vocab": "http://e/"}, "@graph": [{"@id": "http://e/a", "p": {"@id": "_:x"}}, {"@id": "_:x", "p": {"@id": "http://e/a"}}]}'),
    ("<http://e/b> <http://e/p> <http://e/a> .", '<rdf:Description rdf:about="http://e/b"><e:p><rdf:Description rdf:about="http://e/a"/></e:p></rdf:Description>', '{"@context": {"r": {"@reverse": "http://e/p", "@type": "@id"}}, "@id": "http://e/a", "r": "http://e/b"}'),
]


def shape(triples):
    """Triples with blank nodes numbered by their places, so that equal graphs of these simple kinds compare equal."""
    flat = sorted((literal_id(s), p, literal_id(o)) for s, p, o in triples)
    order = sorted({x for t in flat for x in (t[0], t[2]) if x.startswith("_:")}, key=lambda b: sorted((s == b, p, o if s == b and not o.startswith("_:") else "" if s == b else s if not s.startswith("_:") else "") for s, p, o in flat if b in (s, o)))
    names = {b: f"_:{i}" for i, b in enumerate(order)}
    return sorted((names.get(s, s), p, names.get(o, o)) for s, p, o in flat)


@pytest.mark.parametrize("turtle, xml, json", SAME)
def test_syntaxes_agree(turtle, xml, json):
    want = shape(rdf.parse_turtle(turtle, "http://b/d"))
    assert shape(rdfxml.parse(f"{HEAD}{xml}</rdf:RDF>")) == want
    assert shape(jsonld.parse(json, "http://b/d")) == want


def test_reified_and_numbered_properties():
    got = rdfxml.parse(f'{HEAD}<rdf:Bag rdf:about="http://e/b"><rdf:li>x</rdf:li><rdf:li>y</rdf:li><e:p rdf:ID="r">z</e:p><e:x rdf:parseType="Literal">a<b/></e:x></rdf:Bag></rdf:RDF>')
    predicates = [p.rsplit("/", 1)[-1].rsplit("#", 1)[-1] for _, p, _ in got]
    assert predicates == ["type", "_1", "_2", "p", "type", "subject", "predicate", "object", "x"]
    with pytest.raises(SchemaError):
        rdfxml.parse(f'{HEAD}<e:A><e:p><e:A/><e:A/></e:p></e:A></rdf:RDF>')


def test_numbers_languages_and_contexts_of_json():
    text = '{"@context": [{"@vocab": "http://e/", "@language": "fr", "d": {"@type": "http://e/dt"}, "m": {"@container": "@language"}, "gone": null}], "@id": "http://e/a", "n": [1, 2.5, 1e30, "s", null], "d": "v", "m": {"en": "x", "de": ["y", "z"]}, "gone": 1, "set": {"@set": [true]}}'
    got = sorted((p.rsplit("/", 1)[-1], literal_id(o).replace("http://www.w3.org/2001/XMLSchema#", "xsd:")) for _, p, o in jsonld.parse(text))
    assert got == [("d", '"v"^^<http://e/dt>'), ("m", '"x"@en'), ("m", '"y"@de'), ("m", '"z"@de'), ("n", '"1"^^<xsd:integer>'), ("n", '"1.0E30"^^<xsd:double>'), ("n", '"2.5E0"^^<xsd:double>'), ("n", '"s"@fr'), ("set", '"true"^^<xsd:boolean>')]
    with pytest.raises(SchemaError):
        jsonld.parse('{"@context": "http://e/context", "p": 1}')


def test_files_keep_their_blank_nodes_apart(spark, tmp_path):
    for form, suffix, text in (("turtle", "ttl", "_:x <http://e/p> 1 ."), ("jsonld", "jsonld", '{"@id": "_:x", "http://e/p": 1}'), ("rdfxml", "rdf", f'{HEAD}<rdf:Description rdf:nodeID="x"><e:p>1</e:p></rdf:Description></rdf:RDF>'), ("ntriples", "nt", '_:x <http://e/p> "1" .')):
        folder = tmp_path / form
        folder.mkdir()
        for i in range(3):
            (folder / f"{i}.{suffix}").write_text(text)
        g = rdf.read(spark, str(folder), form)
        assert g.df.select("s").distinct().count() == 3 and g.df.where(F.length("s") > 32).count() == 3
    with pytest.raises(ValueError):
        rdf.read(spark, str(tmp_path), "csv")


def test_escapes_of_lines(spark):
    line = r'<http://e/é> <http://e/p> "a\\u0041A\t\b\n\r\f\"\U0001F600\\" .'
    (r,) = rdf.ntriples_lines(spark.createDataFrame([(line,)], "value string")).collect()
    assert r["s"] == "<http://e/é>" and r["o_lex"] == 'a\\u0041A\t\b\n\r\f"\U0001f600\\'


def test_lines_round_trip(spark):
    g = graph.of_terms(spark, rdf.parse_turtle("PREFIX : <http://e/> :a :p 'q\\\\n\\n\"é\\t'@en-GB , 1.5 , _:b , :c ; :q '' ."))
    assert sorted(map(str, rdf.ntriples_lines(rdf.to_ntriples(g.df)).collect())) == sorted(map(str, g.df.collect()))
    assert g.triples_to(rdf.parse_turtle("<x> <y> 1.5 .", "http://e/")[0][2]).count() == 1


def test_decimals_of_any_length(spark):
    from decimal import Decimal

    from shapeloom.functions.terms import decimal_order

    texts = ["0", "-0.0", "+1.50", "1.5", "00012", "-3.25", "123456789012345678901234567890.000000000000000000001", "123456789012345678901234567890", "-0.00000000000000000000000000000001", ".5", "5.", "1.50000000000000000001", "-123456789012345678901234567890123456789012345"]
    bounds = ["0", "1.5", "-3.25", "123456789012345678901234567890", "-0.00000000000000000000000000000002", "1.500000000000000000005", "100"]
    table = spark.createDataFrame([(t,) for t in [*texts, "x", "1e3"]], "lex string")
    for r in table.select("lex", *(decimal_order(F.col("lex"), b).alias(b) for b in bounds)).collect():
        for b in bounds:
            if r["lex"] not in texts:
                assert r[b] is None
                continue
            x, y = Decimal(r["lex"]), Decimal(b)
            assert r[b] == (x > y) - (x < y), (r["lex"], b)


@pytest.fixture(scope="module")
def server():
    """Recorded answers behind a local address."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    term = lambda x: {"type": "uri", "value": x}
    rows = [{"s": term(f"http://e/{i}"), "p": term("http://e/p"), "o": {"type": "literal", "value": str(i), "datatype": "http://www.w3.org/2001/XMLSchema#integer"}} for i in range(25)]
    rows += [{"s": {"type": "bnode", "value": "x"}, "p": term("http://e/q"), "o": {"type": "literal", "value": "a", "xml:lang": "en"}}, {"s": term("http://e/0"), "p": term("http://e/r"), "o": {"type": "bnode", "value": "x"}}]
    entity = lambda i: {"type": "item", "id": i, "labels": {"en": {"language": "en", "value": f"label {i}"}}, "claims": {"P1": [{"rank": "normal", "mainsnak": {"snaktype": "value", "property": "P1", "datavalue": {"type": "string", "value": "v"}}}]}}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            if at.path == "/sparql":
                query = parse_qs(at.query)["query"][0].split()
                limit, offset = int(query[query.index("LIMIT") + 1]), int(query[query.index("OFFSET") + 1])
                out = {"head": {"vars": ["s", "p", "o"]}, "results": {"bindings": rows[offset : offset + limit]}}
            else:
                out = {"entities": {at.path[1:-5]: entity(at.path[1:-5])}}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_endpoints(spark, server):
    from shapeloom.schema.shexc import parse
    from shapeloom.shapemap import maps
    from shapeloom.sources import endpoint
    from shapeloom.wikibase import entityschema
    from shapeloom.wikibase.matcher import Matcher

    g = endpoint.read_sparql(spark, f"{server}/sparql", "SELECT ?s ?p ?o WHERE { ?s ?p ?o } ORDER BY ?s", pages=3, page_size=10)
    rows = g.df.collect()
    assert len(rows) == 27 and len({r["s"] for r in rows if r["p"] == "http://e/q"} | {r["o_lex"] for r in rows if r["o_kind"] == "bnode"}) == 1
    result = maps.run(g, parse("<S> { <http://e/p> MININCLUSIVE 20 ; <http://e/r> . * }", "http://e/"), maps.parse("{FOCUS <http://e/p> _}@<S>", "http://e/", {}, "http://e/", {}))
    assert result.where("status = 'conformant'").count() == 5
    found = endpoint.read_entities(spark, server + "/{}.json", ["Q1", "Q2", "Q3"])
    m = Matcher(entityschema.parse("PREFIX : <http://www.wikidata.org/entity/> <S> LABEL (en -> /Q[12]$/) { :P1 [ 'v' ] }", "http://x/"))
    assert {r["id"] for r in m.filter(found).collect()} == {"Q1", "Q2"}
