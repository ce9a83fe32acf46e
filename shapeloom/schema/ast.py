"""Schema objects: shape expressions, triple expressions, node constraints.  Driver-side metadata, immutable."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
START = "START"


class SchemaError(ValueError):
    """A schema that cannot be read or is not well formed."""


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class BNode:
    value: str


@dataclass(frozen=True)
class Literal:
    lex: str
    dt: str = XSD + "string"
    lang: str | None = None


Term = Iri | BNode | Literal


# value sets -----------------------------------------------------------------


@dataclass(frozen=True)
class LanguageTag:
    tag: str


@dataclass(frozen=True)
class Stem:
    """kind: iri, literal or language."""

    kind: str
    stem: str


@dataclass(frozen=True)
class StemRange:
    """stem None is the wildcard; an exclusion is a plain value or a Stem."""

    kind: str
    stem: str | None
    exclusions: tuple = ()


ValueSetValue = Term | LanguageTag | Stem | StemRange


# shape expressions ----------------------------------------------------------


@dataclass(frozen=True)
class ShapeOr:
    exprs: tuple


@dataclass(frozen=True)
class ShapeAnd:
    exprs: tuple


@dataclass(frozen=True)
class ShapeNot:
    expr: object


@dataclass(frozen=True)
class ShapeRef:
    label: str


@dataclass(frozen=True)
class ShapeExternal:
    pass


@dataclass(frozen=True)
class NodeConstraint:
    kind: str | None = None  # iri, bnode, nonliteral, literal
    datatype: str | None = None
    facets: tuple = ()  # (name, value[, flags])
    values: tuple | None = None


@dataclass(frozen=True)
class SemAct:
    name: str
    code: str | None = None


@dataclass(frozen=True)
class Annotation:
    predicate: str
    object: Term


@dataclass(frozen=True)
class Shape:
    expression: object | None = None
    closed: bool = False
    extra: tuple = ()
    extends: tuple = ()
    restricts: tuple = ()
    acts: tuple = ()
    annotations: tuple = ()


@dataclass(frozen=True)
class ShapeParts:
    """Each base holds on a part of the node's arcs, and ``own`` on the rest.  No schema says so; analysis makes it of EXTENDS."""

    bases: tuple
    own: Shape

    @property
    def shapes(self) -> list[Shape]:
        out, todo = [self.own], list(self.bases)
        while todo:
            x = todo.pop()
            if isinstance(x, ShapeParts):
                out += x.shapes
            elif isinstance(x, Shape):
                out.append(x)
            else:
                todo += shape_children(x)
        return out

    @property
    def closed(self) -> bool:
        return any(x.closed for x in self.shapes)

    @property
    def extra(self) -> tuple:
        return tuple(e for x in self.shapes for e in x.extra)

    @property
    def acts(self) -> tuple:
        return tuple(a for x in self.shapes for a in x.acts)


# triple expressions ---------------------------------------------------------


@dataclass(frozen=True)
class TripleConstraint:
    predicate: str
    value: object | None = None
    min: int = 1
    max: int | None = 1
    inverse: bool = False
    negated: bool = False
    acts: tuple = ()
    annotations: tuple = ()
    id: str | None = None


@dataclass(frozen=True)
class EachOf:
    exprs: tuple
    min: int = 1
    max: int | None = 1
    acts: tuple = ()
    annotations: tuple = ()
    id: str | None = None


@dataclass(frozen=True)
class OneOf:
    exprs: tuple
    min: int = 1
    max: int | None = 1
    acts: tuple = ()
    annotations: tuple = ()
    id: str | None = None


@dataclass(frozen=True)
class Inclusion:
    label: str


@dataclass(frozen=True)
class BinExpr:
    """A value expression; parsed and kept, never evaluated."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class ValueExpr:
    expr: object
    id: str | None = None


@dataclass(frozen=True)
class Declaration:
    label: str
    expr: object
    abstract: bool = False


@dataclass(frozen=True)
class Schema:
    shapes: tuple = ()  # Declaration
    start: object | None = None
    start_acts: tuple = ()
    prefixes: dict = field(default_factory=dict, hash=False)
    base: str | None = None
    imports: tuple = ()

    def shape(self, label: str):
        for d in self.shapes:
            if d.label == label:
                return d
        raise SchemaError(f"no shape {label}")

    @property
    def labels(self) -> list[str]:
        return [d.label for d in self.shapes]

    def qualify(self, name: str) -> str:
        """Expand ``prefix:local`` or ``<iri>``."""
        if name.startswith("<") and name.endswith(">"):
            return resolve_iri(self.base, name[1:-1])
        prefix, colon, local = name.partition(":")
        if colon and prefix in self.prefixes:
            return self.prefixes[prefix] + local
        return name

    def relativise(self, iri: str) -> str:
        """Shortest ``prefix:local``, else ``<iri>``."""
        best = max((p for p in self.prefixes.items() if iri.startswith(p[1])), key=lambda p: len(p[1]), default=None)
        local = iri[len(best[1]) :] if best else ""
        return f"{best[0]}:{local}" if best and local.replace("_", "").replace("-", "").isalnum() else f"<{iri}>"


def resolve_iri(base: str | None, iri: str) -> str:
    """An IRI against a base; absolute ones, with their empty fragments, stay as they are."""
    from urllib.parse import urljoin

    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
        return iri
    return urljoin(base, iri) + ("#" if iri.endswith("#") else "")


def triple_children(te) -> tuple:
    return te.exprs if isinstance(te, EachOf | OneOf) else ()


def walk_triples(te) -> Iterator:
    if te is None:
        return
    yield te
    for x in triple_children(te):
        yield from walk_triples(x)


def shape_children(se) -> tuple:
    """Direct sub-expressions that are shape expressions, values of triple constraints included."""
    if isinstance(se, ShapeAnd | ShapeOr):
        return se.exprs
    if isinstance(se, ShapeNot):
        return (se.expr,)
    if isinstance(se, ShapeParts):
        return (*se.bases, se.own)
    if isinstance(se, Shape):
        return tuple(t.value for t in walk_triples(se.expression) if isinstance(t, TripleConstraint) and t.value is not None)
    return ()


def walk_shapes(se) -> Iterator:
    if se is None:
        return
    yield se
    for x in shape_children(se):
        yield from walk_shapes(x)


def triple_map(schema: Schema) -> dict[str, object]:
    """Labelled triple expressions of a schema."""
    out = {}
    for d in schema.shapes:
        for se in walk_shapes(d.expr):
            if isinstance(se, Shape):
                for te in walk_triples(se.expression):
                    if getattr(te, "id", None):
                        if te.id in out and out[te.id] != te:
                            raise SchemaError(f"triple expression {te.id} is defined twice")
                        out[te.id] = te
    return out
