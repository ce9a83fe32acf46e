"""Schemas as RDF: one node per part of the JSON form, lists as RDF lists."""

from __future__ import annotations

import json

from ..sources import graph as graphs
from ..sources import rdf
from . import shexj
from .ast import RDF, XSD, BNode, Iri, Literal, Schema, SchemaError

SX = "http://www.w3.org/ns/shex#"

#: Keys of the JSON form whose values are lists, those that are named in the singular, and those whose strings are IRIs.
LISTS = {"shapes", "shapeExprs", "expressions", "values", "startActs", "semActs", "annotations", "exclusions", "imports", "extends", "restricts"}
SINGULAR = {"annotations": "annotation", "exclusions": "exclusion"}
IRIS = {"predicate", "datatype", "valueExpr", "shapeExpr", "expression", "start", "name", "shapes", "extra", "imports", "extends", "restricts", "expressions", "shapeExprs", "object"}
NAMES_ONLY = {"extends", "restricts", "extra", "imports", "predicate", "datatype", "name", "object"}


class _Writer:
    def __init__(self):
        self.out, self.n = [], 0

    def fresh(self) -> BNode:
        self.n += 1
        return BNode(f"_:x{self.n}")

    def node(self, x, key: str):
        if isinstance(x, dict):
            if "value" in x and "type" in x and not x["type"].startswith("http") or "value" in x and "type" not in x:
                return Literal(x["value"], RDF + "langString", x["language"]) if x.get("language") else Literal(x["value"])
            if "value" in x:
                return Literal(x["value"], x["type"])
            me = BNode(x["id"]) if str(x.get("id", "")).startswith("_:") else Iri(x["id"]) if "id" in x else self.fresh()
            self.out.append((me, RDF + "type", Iri(SX + x["type"])))
            for k, v in x.items():
                if k not in ("id", "type", "@context"):
                    self.add(me, k, v)
            return me
        if isinstance(x, bool):
            return Literal(str(x).lower(), XSD + "boolean")
        if isinstance(x, int):
            return Literal(str(x), XSD + "integer")
        if isinstance(x, float):
            return Literal(repr(x), XSD + ("double" if "e" in repr(x) else "decimal"))
        if key == "nodeKind":
            return Iri(SX + x)
        if key in IRIS or key == "values":
            return BNode(x) if x.startswith("_:") else Iri(x)
        if key in ("stem", "exclusions") and x.startswith("http"):
            return Literal(x, XSD + "anyURI")
        return Literal(x)

    def add(self, me, key: str, value) -> None:
        p = SX + SINGULAR.get(key, key)
        if key in LISTS:
            items = [self.node(v, key) for v in value]
            head = Iri(RDF + "nil")
            for x in reversed(items):
                cell = self.fresh()
                self.out += [(cell, RDF + "first", x), (cell, RDF + "rest", head)]
                head = cell
            self.out.append((me, p, head))
        elif isinstance(value, list):
            for v in value:
                self.out.append((me, p, self.node(v, key)))
        else:
            self.out.append((me, p, self.node(value, key)))


def to_triples(schema: Schema) -> list[tuple]:
    """Triples of a schema, driver-side."""
    w = _Writer()
    x = json.loads(shexj.dumps(schema))
    w.node(x, "")
    return w.out


def to_graph(spark, schema: Schema) -> graphs.Graph:
    return graphs.of_terms(spark, to_triples(schema))


def from_triples(triples: list[tuple]) -> Schema:
    about: dict = {}
    for s, p, o in triples:
        about.setdefault(s, {}).setdefault(p, []).append(o)

    def listed(head) -> list:
        out = []
        while head != Iri(RDF + "nil"):
            cell = about[head]
            out.append(cell[RDF + "first"][0])
            head = cell[RDF + "rest"][0]
        return out

    def plain(o, key: str):
        if isinstance(o, Literal):
            if key in ("values", "object"):
                return {"value": o.lex} | ({"language": o.lang} if o.lang else {} if o.dt == XSD + "string" else {"type": o.dt})
            name = o.dt.removeprefix(XSD)
            if name == "boolean":
                return o.lex == "true"
            if name == "integer":
                return int(o.lex)
            return float(o.lex) if name in ("decimal", "double") else o.lex
        kinds = None if key in NAMES_ONLY else about.get(o, {}).get(RDF + "type")
        if key == "values" and kinds and not kinds[0].value.removeprefix(SX).startswith(("Iri", "Literal", "Language")):
            kinds = None
        if kinds and kinds[0].value.startswith(SX) and kinds[0].value != SX + "Wildcard":
            if key in ("valueExpr", "shapeExpr", "shapeExprs", "start") and kinds[0].value == SX + "ShapeDecl":
                return o.value
            if key in ("expression", "expressions") and o in inside:
                return o.value
            return unit(o, kinds[0].value[len(SX) :], key)
        if kinds:
            return {"type": "Wildcard"}
        if key == "nodeKind":
            return o.value[len(SX) :]
        return o.value

    inside: set = set()

    def unit(me, kind: str, key: str) -> dict:
        x: dict = {"type": kind}
        if isinstance(me, Iri) or key == "shapes":
            x["id"] = me.value
        if key in ("expression", "expressions"):
            inside.add(me)
        for p, values in about[me].items():
            if p == RDF + "type" or not p.startswith(SX):
                continue
            k = {v: k for k, v in SINGULAR.items()}.get(p[len(SX) :], p[len(SX) :])
            many = k in LISTS or k == "extra"
            items = [y for v in values for y in (listed(v) if v == Iri(RDF + "nil") or RDF + "first" in about.get(v, {}) else [v])] if many else values
            made = [plain(v, k) for v in items]
            x[k] = made if many else made[0]
        return x

    roots = [s for s, ps in about.items() if Iri(SX + "Schema") in ps.get(RDF + "type", ())]
    if len(roots) != 1:
        raise SchemaError(f"{len(roots)} schemas in the graph")
    x = unit(roots[0], "Schema", "")
    x.pop("id", None)
    return shexj.loads(json.dumps(x))


def loads(text: str, base: str | None = None) -> Schema:
    """Schema of a Turtle document."""
    return from_triples(rdf.parse_turtle(text, base))
