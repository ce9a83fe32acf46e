"""Live sources as Spark data sources: triples of a SPARQL endpoint by pages, entity documents of a Wikibase by chunks of ids.

    endpoint.read_graph(spark, "https://host/sparql")
    endpoint.read_sparql(spark, "https://host/sparql", "SELECT ?s ?p ?o WHERE { ?s ?p ?o } ORDER BY ?s ?p ?o", pages=40)
    endpoint.read_entities(spark, "https://host/wiki/Special:EntityData/{}.json", ["Q42", "Q64"])

``read_graph`` takes a graph whole: predicates share out the work, and within
one a page starts at the key where the one before ended, so no page is
counted off by the server.  ``read_sparql`` pages any query by offsets; it has
to order its rows, or pages may overlap.  ``pages`` of them are fetched side by side
and the last task goes on until a page is not full, so nothing is cut off.
Pages are fetched where tasks run; a lost task fetches its own again.  Recorded
answers in files are read by ``of_results``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.terms import TRIPLES
from ..schema.ast import RDF, XSD
from .graph import Graph

_BINDING = "STRUCT<type: STRING, value: STRING, datatype: STRING, `xml:lang`: STRING>"
_RESULTS = f"STRUCT<results: STRUCT<bindings: ARRAY<STRUCT<s: {_BINDING}, p: {_BINDING}, o: {_BINDING}>>>>"


def _fetch(url: str, accept: str, timeout: float) -> str:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"Accept": accept, "User-Agent": "shapeloom"}), timeout=timeout) as answer:
        return answer.read().decode("utf-8")


class _Part(InputPartition):
    def __init__(self, url: str, name: str):
        self.url, self.name = url, name


class _Reader(DataSourceReader):
    def __init__(self, parts: list, accept: str, timeout: float):
        self.parts, self.accept, self.timeout = parts, accept, timeout

    def partitions(self):
        return self.parts

    def read(self, partition):
        yield partition.name, _fetch(partition.url, self.accept, self.timeout)


class _Pages(InputPartition):
    """Pages first, first + 1, ... of a query: one of them, or (open) until one is not full."""

    def __init__(self, query: str, first: int, open_: bool, name: str):
        self.query, self.first, self.open, self.name = query, first, open_, name


class _Keyed(InputPartition):
    """The triples of one predicate in the order of their subjects."""

    def __init__(self, predicate: str, name: str):
        self.predicate, self.name = predicate, name


class _Paging(DataSourceReader):
    """Pages of answers, each a row (name, value: the JSON text)."""

    ACCEPT = "application/sparql-results+json"

    def __init__(self, parts: list, endpoint: str, size: int, timeout: float):
        self.parts, self.endpoint, self.size, self.timeout = parts, endpoint, size, timeout

    def partitions(self):
        return self.parts

    def ask(self, query: str, offset: int = 0) -> list[dict]:
        import json
        from urllib.parse import urlencode

        text = f"{query} LIMIT {self.size} OFFSET {offset}"
        return json.loads(_fetch(f"{self.endpoint}?{urlencode({'query': text, 'format': 'json'})}", self.ACCEPT, self.timeout))["results"]["bindings"]

    def by_offset(self, query: str, first: int = 0, open_: bool = True):
        before, at = None, first
        while True:
            rows = self.ask(query, at * self.size)
            if rows and rows == before:
                raise ValueError("the endpoint gives the same page again: it does not page this query")
            yield rows
            if not open_ or len(rows) < self.size:
                return
            before, at = rows, at + 1

    def by_subject(self, predicate: str):
        """Pages that start at the subject after the last whole one; a subject of more than a page is paged by itself."""
        graph = f"SELECT ?s ?p ?o WHERE {{ VALUES ?p {{ <{predicate}> }} ?s ?p ?o "
        last, past = None, ">="
        while True:
            key = "" if last is None else f" && STR(?s) {past} {_quoted(last)}"
            rows = self.ask(f"{graph} FILTER(isIRI(?s){key}) }} ORDER BY STR(?s)")
            if len(rows) < self.size:
                yield rows
                break
            end = rows[-1]["s"]["value"]
            whole = [r for r in rows if r["s"]["value"] != end]
            if whole:
                yield whole
                last, past = end, ">="
                continue
            yield from self.by_offset(f"{graph} FILTER(isIRI(?s) && STR(?s) = {_quoted(end)}) }} ORDER BY ?o")
            last, past = end, ">"
        yield from self.by_offset(f"{graph} FILTER(isBlank(?s)) }} ORDER BY ?s ?o")

    def read(self, partition):
        import json

        pages = self.by_subject(partition.predicate) if isinstance(partition, _Keyed) else self.by_offset(partition.query, partition.first, partition.open)
        for rows in pages:
            if rows:
                yield partition.name, json.dumps({"results": {"bindings": rows}})


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'


class SparqlSource(DataSource):
    """Answers (name, value: the JSON text), one a page; options endpoint, page_size, timeout, and query with pages, or predicates (separated by blanks)."""

    @classmethod
    def name(cls):
        return "shapeloom-sparql"

    def schema(self):
        return "name string, value string"

    def reader(self, schema):
        o = self.options
        pages = int(o.get("pages", "1"))
        if o.get("query"):
            parts: list = [_Pages(o["query"], i, i == pages - 1, "b") for i in range(pages)]
        else:
            parts = [_Keyed(p, "b") for p in o["predicates"].split()]
        return _Paging(parts, o["endpoint"], int(o.get("page_size", "10000")), float(o.get("timeout", "60")))


class EntitySource(DataSource):
    """Documents (name, value: the JSON text) of entities; options url (with {} for the id), ids (comma-separated), timeout."""

    @classmethod
    def name(cls):
        return "shapeloom-entities"

    def schema(self):
        return "name string, value string"

    def reader(self, schema):
        o = self.options
        return _Reader([_Part(o["url"].format(i), i) for i in o["ids"].split(",") if i], "application/json", float(o.get("timeout", "60")))


def of_results(answers: DataFrame) -> Graph:
    """Triples of SPARQL JSON results (name, value) with variables s, p and o; blank nodes are those of one answer."""
    b = F.col("b")
    rows = answers.select("name", F.explode(F.from_json("value", _RESULTS)["results"]["bindings"]).alias("b"))
    own = lambda x: F.concat(F.lit("_:"), F.col("name"), F.lit("_"), x["value"])
    kind = F.when(b["o"]["type"] == "uri", "iri").when(b["o"]["type"] == "bnode", "bnode").otherwise("literal")
    lang = b["o"]["xml:lang"]
    out = rows.select(
        F.when(b["s"]["type"] == "bnode", own(b["s"])).otherwise(F.concat(F.lit("<"), b["s"]["value"], F.lit(">"))).alias("s"),
        b["p"]["value"].alias("p"),
        kind.alias("o_kind"),
        F.when(b["o"]["type"] == "bnode", own(b["o"])).otherwise(b["o"]["value"]).alias("o_lex"),
        F.when(kind == "literal", F.when(lang.isNotNull(), RDF + "langString").otherwise(F.coalesce(b["o"]["datatype"], F.lit(XSD + "string")))).alias("o_dt"),
        lang.alias("o_lang"),
    )
    return Graph(out.select(*(c.split()[0] for c in TRIPLES.split(", "))))


def read_sparql(spark: SparkSession, endpoint: str, query: str, pages: int = 1, page_size: int = 10_000, timeout: float = 60) -> Graph:
    """All answers of a query with variables s, p and o and an order; ``pages`` are fetched at a time, the rest one after the other."""
    spark.dataSource.register(SparqlSource)
    rows = spark.read.format(SparqlSource.name()).options(endpoint=endpoint, query=query, pages=pages, page_size=page_size, timeout=timeout).load()
    return of_results(rows)


def read_graph(spark: SparkSession, endpoint: str, predicates: list[str] | None = None, page_size: int = 10_000, timeout: float = 60) -> Graph:
    """The graph of an endpoint, or its triples of some predicates.  The endpoint may not change meanwhile; blank nodes are those of a predicate's pages if the endpoint keeps their names."""
    spark.dataSource.register(SparqlSource)
    if predicates is None:
        found = _Paging([], endpoint, page_size, timeout).by_offset("SELECT DISTINCT ?p WHERE { ?s ?p ?o } ORDER BY ?p")
        predicates = [r["p"]["value"] for rows in found for r in rows]
    if not predicates:
        return Graph(spark.createDataFrame([], TRIPLES))
    rows = spark.read.format(SparqlSource.name()).options(endpoint=endpoint, predicates=" ".join(predicates), page_size=page_size, timeout=timeout).load()
    return of_results(rows)


def read_entities(spark: SparkSession, url: str, ids: list[str], timeout: float = 60) -> DataFrame:
    """Entity rows of documents ``{"entities": {id: entity}}`` or of bare entities."""
    from ..wikibase.model import parse_json

    spark.dataSource.register(EntitySource)
    rows = spark.read.format(EntitySource.name()).options(url=url, ids=",".join(ids), timeout=timeout).load()
    inner = F.map_values(F.from_json(F.get_json_object("value", "$.entities"), "MAP<STRING, STRING>"))
    return parse_json(rows.select(F.explode(F.coalesce(inner, F.array("value"))).alias("value"))).drop("_bad")
