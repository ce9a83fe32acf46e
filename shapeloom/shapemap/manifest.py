"""Test manifests: entries that name data, a schema, a map or a focus, and what is expected."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from ..schema import resolve
from ..schema.ast import RDF, START, Iri, Literal, SchemaError
from ..sources import graph as graphs
from ..sources import rdf
from . import maps

MF = "http://www.w3.org/2001/sw/DataAccess/tests/test-manifest#"
SHT = "http://www.w3.org/ns/shacl/test-suite#"


@dataclass(frozen=True)
class Entry:
    name: str
    kind: str
    schema: str | None = None
    data: str | None = None
    shape: str | None = None
    focus: object | None = None
    map: str | None = None
    result: str | None = None


def read(path: str) -> list[Entry]:
    """Entries of a manifest and of those that it includes."""
    base = Path(path).resolve().parent.as_uri() + "/"
    about: dict = {}
    for s, p, o in rdf.parse_turtle(Path(path).read_text(encoding="utf-8"), base):
        about.setdefault(s, {}).setdefault(p, []).append(o)

    def listed(head) -> list:
        out = []
        while head in about and RDF + "first" in about[head]:
            out.append(about[head][RDF + "first"][0])
            head = about[head][RDF + "rest"][0]
        return out

    def one(node, local: str):
        for ns in (SHT, MF):
            found = about.get(node, {}).get(ns + local)
            if found:
                return found[0]
        return None

    def text(x):
        return None if x is None else x.value if isinstance(x, Iri) else x.lex if isinstance(x, Literal) else x.value

    out = []
    for props in list(about.values()):
        for head in props.get(MF + "include", []):
            for x in listed(head) or [head]:
                out += read(x.value.removeprefix("file://"))
        for head in props.get(MF + "entries", []):
            for e in listed(head):
                action = (about[e].get(MF + "action") or [None])[0]
                at = action if action in about else e
                result = (about[e].get(MF + "result") or [None])[0]
                kinds = about[e].get(RDF + "type", [Iri(SHT + "Validate")])
                out.append(Entry(text(one(e, "name")) or text(e), kinds[0].value.rsplit("#", 1)[-1], text(one(at, "schema")), text(one(at, "data")), text(one(at, "shape")), one(at, "focus"), text(one(at, "map") or one(at, "shapeMap")), text(one(result, "resultShapeMap") or result)))
    return out


def run(spark, entry: Entry) -> bool:
    """Whether an entry gives what it expects."""
    local = lambda x: Path(x.removeprefix("file://"))
    if entry.schema is None:
        raise SchemaError(f"{entry.name} has no schema")
    if entry.kind in ("NegativeSyntax", "NegativeStructure"):
        from ..schema import analyze

        try:
            return bool(analyze.problems(resolve.load(str(local(entry.schema)), entry.schema)))
        except SchemaError:
            return True
    schema = resolve.load(str(local(entry.schema)), entry.schema)
    schema = resolve.closure(schema, resolve.file_fetcher(str(local(entry.schema).parent)))
    if entry.data is None:
        return True  # a syntax test: it was read
    graph = graphs.of_terms(spark, rdf.parse_turtle(local(entry.data).read_text(encoding="utf-8"), entry.data))
    prefixes = schema.prefixes
    if entry.map is not None:
        wanted = maps.parse(local(entry.map).read_text(encoding="utf-8"), entry.data, prefixes, entry.schema, prefixes)
    else:
        wanted = [maps.Association(maps.Node(entry.focus), entry.shape or START)]
    result = maps.run(graph, schema, wanted)
    if entry.result is not None and local(entry.result).is_file():
        expected = maps.parse(local(entry.result).read_text(encoding="utf-8"), entry.data, prefixes, entry.schema, prefixes)
        return maps.compare(result, maps.fixed(graph, expected)).where("status_a IS NOT NULL AND status_b IS NOT NULL").isEmpty()
    return maps.all_conformant(result) != (entry.kind == "ValidationFailure")


def run_all(spark, entries: list[Entry], at_once: int = 8) -> DataFrame:
    """(name, kind, ok, error) of all entries of a manifest; ``at_once`` of them are Spark jobs at a time.

    ok is null where an entry could not be run, and error says why.
    """

    def one(e: Entry) -> tuple:
        try:
            return e.name, e.kind, bool(run(spark, e)), None
        except Exception as x:  # an entry that cannot be run is a result of the suite
            return e.name, e.kind, None, f"{type(x).__name__}: {x}"[:500]

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(one, entries))
    return spark.createDataFrame(rows, "name string, kind string, ok boolean, error string")
