"""Selectors, property paths and result maps."""

import pytest

from shapeloom.operators import bags, paths
from shapeloom.schema.ast import SchemaError
from shapeloom.shapemap import maps
from shapeloom.sources import graph, rdf

P = "PREFIX : <http://e/>\n"


@pytest.fixture(scope="module")
def g(spark):
    return graph.of_terms(spark, rdf.parse_turtle(P + ":a :p :b ; :n 1 . :b :p :c . :c :p :a ; :q :d . :e :q :d , :a ; a :T ."))


def nodes(g, text):
    a = maps.parse(text + "@:S", "http://e/", {"": "http://e/"})[0]
    return sorted(r["node"].replace("<http://e/", "").rstrip(">") for r in maps.select(g, a.selector).collect())


@pytest.mark.parametrize(
    "selector, want",
    [
        (":a", ["a"]),
        ("{FOCUS :p _}", ["a", "b", "c"]),
        ("{FOCUS :q :d}", ["c", "e"]),
        ("{_ :q FOCUS}", ["a", "d"]),
        ("{:e :q FOCUS}", ["a", "d"]),
        ("{FOCUS a :T}", ["e"]),
        ("{FOCUS :n 1}", ["a"]),
        ("{:a :p/:p FOCUS}", ["c"]),
        ("{:a :p/:p/:q FOCUS}", ["d"]),
        ("{:d ^:q FOCUS}", ["c", "e"]),
        ("{:a :p+ FOCUS}", ["a", "b", "c"]),
        ("{:e (:q/:p)* FOCUS}", ["b", "e"]),
        ("{:c (:p|:q) FOCUS}", ["a", "d"]),
        ("{:c :q? FOCUS}", ["c", "d"]),
        ("{:d ^(:p/:q) FOCUS}", ["b"]),
    ],
)
def test_selectors(g, selector, want):
    assert nodes(g, selector) == want


def test_sql_selector_and_generic(g):
    found = maps.select(g, maps.Sql("SELECT s FROM triples WHERE p = 'http://e/q'")).collect()
    assert len(found) == 2
    with pytest.raises(SchemaError):
        maps.select(g, maps.Generic("http://x/", "y"))


def test_statuses_and_json(g):
    a = maps.parse(":a@!:S, :b@?:S, :c@START", "http://e/", {"": "http://e/"})
    assert [x.status for x in a] == ["nonconformant", "undefined", "conformant"]
    assert maps.from_json(maps.to_json(a)) == a


def test_contradiction(g):
    a = maps.parse(":a@:S, :a@!:S", "http://e/", {"": "http://e/"})
    with pytest.raises(Exception, match="contradictory"):
        maps.fixed(g, a).collect()


def test_results(spark):
    a = spark.createDataFrame([("<x>", "S", "conformant", None), ("<y>", "S", "nonconformant", "r"), ("_:b", "S", "conformant", None)], "node string, shape string, status string, reason string")
    b = spark.createDataFrame([("<x>", "S", "conformant", None), ("<y>", "S", "conformant", None), ("_:c", "S", "conformant", None)], a.schema)
    assert [(r["node"], r["status_a"], r["status_b"]) for r in maps.compare(a, b).collect()] == [("<y>", "nonconformant", "conformant")]
    assert not maps.all_conformant(a) and maps.all_conformant(b)
    assert sorted(r["value"] for r in maps.render(a, "details").collect()) == ["<x>@<S>", "<y>@!<S> # r", "_:b@<S>"]
    assert '"status":"nonconformant"' in "".join(r["value"] for r in maps.render(a, "json").collect())


def test_bags(spark):
    a = spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "k long, symbol string, n long")
    b = spark.createDataFrame([(1, "x", 1), (1, "z", 3)], "k long, symbol string, n long")
    get = lambda d: {r["symbol"]: r["n"] for r in d.collect()}
    assert get(bags.union(a, b, ["k"])) == {"x": 3, "y": 1, "z": 3}
    assert get(bags.intersection(a, b, ["k"])) == {"x": 1}
    one = spark.createDataFrame([(1, "y")], "k long, symbol string")
    assert get(bags.delete(a, ["k"], one)) == {"x": 2} and get(bags.insert(a, ["k"], one)) == {"x": 2, "y": 2}
    assert get(bags.delta(a, ["k"], {"x": (0, 1), "y": (1, 1), "z": (1, None)})) == {"x": 2, "z": 0}
    assert bags.size(a, ["k"]).first()["size"] == 3 and bags.to_map(a, ["k"]).first()["bag"] == {"x": 2, "y": 1}


def test_files(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://e/a> <http://e/p> "x\\"\\\\n\\n"@en . # note\n\n# c\n_:b <http://e/p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .\n<http://e/a> <http://e/q> _:b .\n')
    (tmp_path / "a.ttl").write_text(P + ":a :p ( 1 2 ) ; :q [ :r 'x' ] .")
    nt = rdf.read_ntriples(spark, str(tmp_path / "a.nt")).df.collect()
    assert len(nt) == 3 and {r["o_lex"] for r in nt if r["o_lang"]} == {'x"\\n\n'}
    assert len({r["s"] for r in nt if r["s"].startswith("_:")} | {r["o_lex"] for r in nt if r["o_kind"] == "bnode"}) == 1
    assert rdf.read_turtle(spark, str(tmp_path / "a.ttl")).df.count() == 7


@pytest.mark.parametrize("path", [":p", "^:p", ":p+", ":p*", ":p?", "^(:p/:q)", ":p+/:q", ":p/:q+", ":p*/:q", "(:p|:q)+/^:q", "^(:p+)", "(:q?/:p)"])
@pytest.mark.parametrize("pattern", ["{{FOCUS {} _}}", "{{_ {} FOCUS}}"])
def test_ends_of_a_path_are_those_of_its_pairs(spark, path, pattern):
    g = graph.of_terms(spark, rdf.parse_turtle("PREFIX : <http://e/> :a :p :b . :b :p :c . :c :q :d . :d :p :a . :e :q 'x' . :b :q 1 . :f :p :f ."))
    selector = maps.parse(pattern.format(path) + "@:S", "http://e/", {"": "http://e/"})[0].selector
    pairs = paths.pairs(g, selector.path)
    want = {r[0] for r in pairs.select("start" if selector.focus == "subject" else "node").collect()}
    got = [r["node"] for r in maps.select(g, selector).collect()]
    assert sorted(got) == sorted(want)


def test_json_of_selectors():
    text = "{FOCUS (:p/^:q)+|:r? _}@:S, {:x :p* FOCUS}@!:T, 'a'@en@:S, SQL 'SELECT s FROM triples'@?:S"
    found = maps.parse(text, "http://e/", {"": "http://e/"}, "http://e/", {"": "http://e/"})
    assert maps.from_json(maps.to_json(found)) == found


def test_maps_are_read_from_streams_files_and_addresses(spark, tmp_path):
    import io
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    text = ":a@:S, {FOCUS :p _}@!:T"
    want = maps.parse(text, "http://e/", {"": "http://e/"}, "http://e/", {"": "http://e/"})

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "m.sm").write_text(text)
    (tmp_path / "m.json").write_text(maps.to_json(want))
    for source in (io.StringIO(text), io.BytesIO(text.encode()), str(tmp_path / "m.sm"), f"http://127.0.0.1:{server.server_port}/m"):
        assert maps.read(spark, source, "http://e/", {"": "http://e/"}) == want
    server.shutdown()
    assert [a.label for a in maps.read(spark, str(tmp_path / "m.json"), form="json")] == [a.label for a in want]


def test_what_an_application_adds_is_rendered(spark):
    result = spark.createDataFrame([("<http://e/a>", "http://e/S", "conformant", None, "v1")], "node string, shape string, status string, reason string, appInfo string")
    assert '"appInfo":"v1"' in maps.render(result, "json").first()["value"]
