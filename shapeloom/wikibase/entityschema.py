"""Entity schemas: the compact syntax with qualifiers, references and term constraints; printing; conversion to and from plain schemas."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..schema.ast import (
    Declaration,
    EachOf,
    Literal,
    NodeConstraint,
    OneOf,
    Schema,
    SchemaError,
    Shape,
    ShapeAnd,
    ShapeNot,
    ShapeOr,
    ShapeRef,
    TripleConstraint,
)
from ..schema.shexc import Parser
from ..schema.show import Printer

WDT = "http://www.wikidata.org/prop/direct/"
WD = "http://www.wikidata.org/entity/"


@dataclass(frozen=True)
class TermConstraint:
    """what: label, description or alias; test: None (any), ("set", strings) or ("facet", facet)."""

    what: str
    lang: str
    test: tuple | None = None


@dataclass(frozen=True)
class EntityShape(Shape):
    terms: tuple = ()


@dataclass(frozen=True)
class StatementConstraint(TripleConstraint):
    qualifiers: object | None = None  # a triple expression over qualifier snaks
    references: tuple = ()  # alternatives: (triple expression, min, max)


def property_of(iri: str) -> str:
    """P31 of any of the property namespaces."""
    return iri.rsplit("/", 1)[-1]


class _Entities(Parser):
    def shape(self, inline: bool):
        terms = []
        t = self.t
        start = t.i
        while t.word() in ("label", "description", "alias"):
            terms += self.terms()
        if not terms:
            t.i = start
        out = super().shape(inline)
        return EntityShape(**{f: getattr(out, f) for f in Shape.__dataclass_fields__}, terms=tuple(terms)) if terms else out

    def starts_shape(self) -> bool:
        return super().starts_shape() or self.t.word() in ("label", "description", "alias")

    def terms(self) -> list[TermConstraint]:
        t, out = self.t, []
        what = t.next()[1].lower()
        t.expect("(")
        while not t.accept(")"):
            lang = t.next()[1].lstrip("@")
            t.expect("-")
            t.expect(">")
            if t.accept("."):
                out.append(TermConstraint(what, lang))
            elif t.peek()[0] in ("string", "long") or t.accept("["):
                strings = []
                while t.peek()[0] in ("string", "long"):
                    strings.append(self.string())
                t.accept("]")
                out.append(TermConstraint(what, lang, ("set", tuple(strings))))
            else:
                out.append(TermConstraint(what, lang, ("facet", self.node_constraint().facets)))
            t.accept(",")
        return out

    def constraint(self, name):
        tc = super().constraint(name)
        t, qualifiers, references = self.t, None, []
        if t.is_op("{") and t.is_op("|", k=1):
            qualifiers = self.spec()
        if t.accept_word("references"):
            while True:
                spec = self.spec()
                references.append((spec, *self.cardinality()))
                if not t.accept("|"):
                    break
        if qualifiers is None and not references:
            return tc
        return StatementConstraint(**{f: getattr(tc, f) for f in TripleConstraint.__dataclass_fields__}, qualifiers=qualifiers, references=tuple(references))

    def spec(self):
        t = self.t
        t.expect("{")
        t.expect("|")
        out = self.each_of_until_bar()
        alternatives = [out]
        while t.is_op("|") and not t.is_op("}", k=1):
            t.next()
            alternatives.append(self.each_of_until_bar())
        t.expect("|")
        t.expect("}")
        return alternatives[0] if len(alternatives) == 1 else OneOf(tuple(alternatives))

    def each_of_until_bar(self):
        items = [Parser.constraint(self, None)]
        while self.t.accept(";"):
            if self.t.is_op("|"):
                break
            items.append(Parser.constraint(self, None))
        return items[0] if len(items) == 1 else EachOf(tuple(items))


def parse(text: str, base: str | None = None) -> Schema:
    return _Entities(text, base).schema()


# printing ---------------------------------------------------------------------


def show(schema: Schema) -> str:
    """The schema in the compact syntax, entity parts included."""
    return _Show(schema).text()


class _Show(Printer):
    def shape(self, se) -> str:
        terms = "".join(f"{c.what.upper()} ({c.lang} -> {self._test(c.test)}) " for c in getattr(se, "terms", ()))
        return terms + super().shape(se)

    def _test(self, test) -> str:
        if test is None:
            return "."
        if test[0] == "set":
            return "[ " + " ".join(self.quoted(x) for x in test[1]) + " ]"
        return " ".join(self.facet(f) for f in test[1])

    def triple(self, te) -> str:
        out = super().triple(te)
        if isinstance(te, StatementConstraint):
            if te.qualifiers is not None:
                out += f" {{| {self.spec(te.qualifiers)} |}}"
            if te.references:
                out += " REFERENCES " + " | ".join(f"{{| {self.spec(e)} |}}{self.cardinality(lo, hi)}" for e, lo, hi in te.references)
        return out

    def spec(self, te) -> str:
        if isinstance(te, OneOf):
            return " | ".join(self.spec(x) for x in te.exprs)
        return " ; ".join(self.triple(x) for x in te.exprs) if isinstance(te, EachOf) else self.triple(te)


# conversion -------------------------------------------------------------------


def _convert(schema: Schema, shape, constraint) -> Schema:
    def se(x):
        if isinstance(x, ShapeAnd | ShapeOr):
            return type(x)(tuple(se(y) for y in x.exprs))
        if isinstance(x, ShapeNot):
            return ShapeNot(se(x.expr))
        if isinstance(x, Shape):
            return shape(x, te)
        return value(x)

    def te(x):
        if isinstance(x, EachOf | OneOf):
            return replace(x, exprs=tuple(te(y) for y in x.exprs))
        if isinstance(x, TripleConstraint):
            return constraint(x, se)
        return x

    def value(x):
        return x

    start = se(schema.start) if schema.start is not None else None
    return replace(schema, shapes=tuple(Declaration(d.label, se(d.expr), d.abstract) for d in schema.shapes), start=start)


def from_plain(schema: Schema) -> Schema:
    """Plain schema over direct properties to an entity schema: wdt: becomes the property, values stay."""

    def constraint(tc, se):
        if not tc.predicate.startswith((WDT, WD)):
            raise SchemaError(f"{tc.predicate} is no direct property")
        return replace(tc, predicate=WD + property_of(tc.predicate), value=None if tc.value is None else se(tc.value))

    def shape(s, te):
        return replace(s, expression=None if s.expression is None else te(s.expression), extra=tuple(WD + property_of(e) for e in s.extra))

    return _convert(schema, shape, constraint)


def to_plain(schema: Schema) -> Schema:
    """Entity schema to a plain one over direct properties and labels; qualifiers and references have no place there and raise."""

    def constraint(tc, se):
        if isinstance(tc, StatementConstraint):
            raise SchemaError("qualifiers and references need full statements")
        return replace(tc, predicate=WDT + property_of(tc.predicate), value=None if tc.value is None else se(tc.value))

    def shape(s, te):
        parts = [te(s.expression)] if s.expression is not None else []
        paths = {"label": "http://www.w3.org/2000/01/rdf-schema#label", "description": "http://schema.org/description", "alias": "http://www.w3.org/2004/02/skos/core#altLabel"}
        extra = [WDT + property_of(e) for e in s.extra]
        for c in getattr(s, "terms", ()):
            from ..schema.ast import RDF, LanguageTag

            test = NodeConstraint(values=(LanguageTag(c.lang),)) if c.test is None else NodeConstraint(values=tuple(Literal(x, RDF + "langString", c.lang) for x in c.test[1])) if c.test[0] == "set" else NodeConstraint(facets=c.test[1])
            parts.append(TripleConstraint(paths[c.what], test, 1, None if c.what == "alias" else 1))
            extra.append(paths[c.what])
        expr = None if not parts else parts[0] if len(parts) == 1 else EachOf(tuple(parts))
        return Shape(expr, s.closed, tuple(dict.fromkeys(extra)), s.extends, s.restricts, s.acts, s.annotations)

    return _convert(schema, shape, constraint)


def dependencies(schema: Schema) -> dict[str, set[str]]:
    """Labels that each shape refers to."""
    from ..schema.ast import walk_shapes

    return {d.label: {x.label for x in walk_shapes(d.expr) if isinstance(x, ShapeRef)} for d in schema.shapes}

