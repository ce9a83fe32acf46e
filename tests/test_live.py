"""Endpoint scans that end by themselves, and the cache of a live source, against a recorded server."""

import json
import re
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from shapeloom.sources import endpoint, live

XSD = "http://www.w3.org/2001/XMLSchema#"


def _uri(x):
    return {"type": "uri", "value": x}


def _row(s, p, o):
    return {"s": _uri(s), "p": _uri(p), "o": {"type": "literal", "value": o, "datatype": XSD + "integer"}}


ROWS = [_row(f"http://e/s{i:05d}", "http://e/p", str(i)) for i in range(24_000)] + [_row("http://e/hot", "http://e/q", str(i)) for i in range(700)] + [_row(f"http://e/s{i // 3:05d}", "http://e/q", str(i)) for i in range(290)]
ROWS += [{"s": {"type": "bnode", "value": f"b{i}"}, "p": _uri("http://e/q"), "o": _uri("http://e/x")} for i in range(10)]
QUOTED = 'http://e/a"b\\c'
ROWS += [_row(QUOTED, "http://e/q", str(i)) for i in range(3)]


@pytest.fixture(scope="module")
def server():
    asked: Counter = Counter()

    def answer(query):
        rows = ROWS
        if "DISTINCT ?p" in query:
            rows = [{"p": _uri(p)} for p in sorted({r["p"]["value"] for r in ROWS})]
        if m := re.search(r"VALUES \?p \{ <(.*?)> \}", query):
            rows = [r for r in rows if r["p"]["value"] == m[1]]
        if "isIRI(?s)" in query:
            rows = sorted((r for r in rows if r["s"]["type"] == "uri"), key=lambda r: r["s"]["value"])
        if "isBlank(?s)" in query:
            rows = [r for r in rows if r["s"]["type"] == "bnode"]
        if m := re.search(r'STR\(\?s\) (>=|>|=) "((?:[^"\\]|\\.)*)"', query):
            key = re.sub(r"\\(.)", r"\1", m[2])
            rows = [r for r in rows if {">=": r["s"].get("value") >= key, ">": r["s"]["value"] > key, "=": r["s"]["value"] == key}[m[1]]]
        limit, offset = int(re.search(r"LIMIT (\d+)", query)[1]), int(re.search(r"OFFSET (\d+)", query)[1])
        if "IGNORES" in query:
            offset = 0
        return {"results": {"bindings": rows[offset : offset + limit]}}

    def entity(i):
        n = int(i[1:])
        snak = lambda p, q: {"rank": "normal", "mainsnak": {"snaktype": "value", "property": p, "datavalue": {"type": "wikibase-entityid", "value": {"entity-type": "item", "id": q}}}}
        return {"entities": {i: {"type": "item", "id": i, "claims": {"P1": [snak("P1", f"Q{n // 2}")] if n > 1 else [], "P2": [snak("P2", f"Q{n + 100}")]}}}}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            asked[at.path] += 1
            if at.path == "/sparql":
                out = answer(parse_qs(at.query)["query"][0])
            elif int(at.path[2:-5]) % 100 == 13:
                self.send_error(404)
                return
            else:
                out = entity(at.path[1:-5])
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_a_default_call_returns_everything(spark, server):
    query = "SELECT ?s ?p ?o WHERE { ?s ?p ?o } ORDER BY ?s ?p ?o"
    for more in ({}, {"pages": 3, "page_size": 1000}, {"pages": 40, "page_size": 1000}):
        g = endpoint.read_sparql(spark, f"{server[0]}/sparql", query, **more)
        assert g.df.count() == len(ROWS) == 25_003


def test_graph_by_predicates_and_subjects(spark, server):
    url = f"{server[0]}/sparql"
    g = endpoint.read_graph(spark, url, page_size=250)
    by = {(r["p"][-1], r["kind"]): (r["n"], r["d"]) for r in g.df.groupBy("p", F.when(F.col("s").startswith("_:"), "b").when(F.col("s").contains("hot"), "h").otherwise("i").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("s", "o_lex").alias("d")).collect()}
    assert by == {("p", "i"): (24_000, 24_000), ("q", "h"): (700, 700), ("q", "i"): (293, 293), ("q", "b"): (10, 10)}
    assert endpoint.read_graph(spark, url, ["http://e/q"], page_size=90).df.count() == 1003
    assert endpoint.read_graph(spark, url, ["http://e/none"]).df.count() == 0 and endpoint.read_graph(spark, url, []).df.count() == 0


def test_an_endpoint_that_does_not_page_raises(spark, server):
    with pytest.raises(Exception, match="same page again"):
        endpoint.read_sparql(spark, f"{server[0]}/sparql", "IGNORES", page_size=100).df.count()


def test_cache_of_a_live_source(spark, server, tmp_path):
    url, asked = server[0] + "/{}.json", server[1]
    ids = spark.createDataFrame([("Q40",), ("Q41",), ("Q40",), ("Q13",), (None,)], "id string")
    first = live.Cache(spark, str(tmp_path / "cache"), url)
    got = {r["id"] for r in first.closure(ids, follow={"P1"}).collect()}
    assert got == {"Q40", "Q41", "Q20", "Q10", "Q5", "Q2", "Q1"} and first.fetched == 8  # Q13 does not exist
    assert all(asked[f"/{i}.json"] == 1 for i in got)
    again = live.Cache(spark, str(tmp_path / "cache"), url)
    assert {r["id"] for r in again.closure(ids, follow={"P1"}).collect()} == got and again.fetched == 0
    wider = {r["id"] for r in again.closure(ids.where("id = 'Q40'"), hops=1).collect()}
    assert wider == {"Q40", "Q20", "Q140"} and again.fetched == 1
    assert live.Cache(spark, str(tmp_path / "none"), url).closure(ids.where("false")).count() == 0
