"""Schemas back in the compact syntax."""

from __future__ import annotations

from .ast import (
    RDF,
    START,
    XSD,
    BinExpr,
    BNode,
    EachOf,
    Inclusion,
    Iri,
    LanguageTag,
    Literal,
    NodeConstraint,
    OneOf,
    Schema,
    Shape,
    ShapeAnd,
    ShapeExternal,
    ShapeNot,
    ShapeOr,
    ShapeRef,
    Stem,
    StemRange,
    ValueExpr,
)


class Printer:
    def __init__(self, schema: Schema):
        self.schema = schema

    def text(self) -> str:
        s = self.schema
        out = [f"PREFIX {p}: <{i}>" for p, i in s.prefixes.items()]
        out += [f"IMPORT <{i}>" for i in s.imports]
        out += [self.act(a) for a in s.start_acts]
        if s.start is not None:
            out.append(f"start = {self.expr(s.start)}")
        for d in s.shapes:
            body = "EXTERNAL" if isinstance(d.expr, ShapeExternal) else self.expr(d.expr)
            out.append(f"{'ABSTRACT ' if d.abstract else ''}{self.label(d.label)} {body}")
        return "\n".join(out) + "\n"

    def label(self, x: str) -> str:
        return x if x.startswith("_:") else self.schema.relativise(x)

    def quoted(self, s: str) -> str:
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            s = s.replace(a, b)
        return f'"{s}"'

    def term(self, t) -> str:
        if isinstance(t, Iri):
            return self.label(t.value)
        if isinstance(t, BNode):
            return t.value
        if t.lang:
            return f"{self.quoted(t.lex)}@{t.lang}"
        return self.quoted(t.lex) + ("" if t.dt == XSD + "string" else f"^^{self.label(t.dt)}")

    def act(self, a) -> str:
        code = "%" if a.code is None else "{" + a.code.replace("\\", "\\\\").replace("%", "\\%") + "%}"
        return f"%{self.label(a.name)}{code}"

    def tail(self, x) -> str:
        notes = [f" // {self.label(a.predicate)} {self.term(a.object)}" for a in x.annotations]
        return "".join(notes + [f" {self.act(a)}" for a in x.acts])

    # shape expressions

    def expr(self, se) -> str:
        if isinstance(se, ShapeOr):
            return " OR ".join(self.inner(x) for x in se.exprs)
        if isinstance(se, ShapeAnd):
            return " AND ".join(self.inner(x) for x in se.exprs)
        if isinstance(se, ShapeNot):
            return f"NOT {self.inner(se.expr)}"
        return self.inner(se)

    def inner(self, se) -> str:
        if isinstance(se, ShapeOr | ShapeAnd | ShapeNot):
            return f"({self.expr(se)})"
        if isinstance(se, ShapeRef):
            return "@START" if se.label == START else f"@{self.label(se.label)}"
        if isinstance(se, ShapeExternal):
            return "EXTERNAL"
        if isinstance(se, NodeConstraint):
            return self.constraint(se)
        return self.shape(se)

    def constraint(self, nc: NodeConstraint) -> str:
        parts = [nc.kind.upper()] if nc.kind else []
        if nc.datatype:
            parts.append(self.label(nc.datatype))
        if nc.values is not None:
            parts.append("[ " + " ".join(self.value(v) for v in nc.values) + " ]")
        parts += [self.facet(f) for f in nc.facets]
        return " ".join(parts) or "."

    def facet(self, f: tuple) -> str:
        if f[0] == "pattern":
            p = f[1].replace("/", "\\/").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
            return f"/{p}/{f[2] if len(f) > 2 else ''}"
        if isinstance(f[1], Literal):
            return f"{f[0].upper()} {f[1].lex}"
        return f"{f[0].upper()} {f[1]}"

    def value(self, v) -> str:
        if isinstance(v, LanguageTag):
            return f"@{v.tag}"
        if isinstance(v, Stem):
            return self.stem(v.kind, v.stem) + "~"
        if isinstance(v, StemRange):
            head = "." if v.stem is None else self.stem(v.kind, v.stem) + "~"
            return head + "".join(f" - {self.value(e)}" for e in v.exclusions)
        return self.term(v)

    def stem(self, kind: str, s: str) -> str:
        return f"<{s}>" if kind == "iri" else self.quoted(s) if kind == "literal" else f"@{s}"

    def shape(self, se: Shape) -> str:
        out = "".join(f"EXTENDS @{self.label(b)} " for b in se.extends) + "".join(f"RESTRICTS @{self.label(b)} " for b in se.restricts)
        out += "CLOSED " if se.closed else ""
        out += "EXTRA " + " ".join(self.predicate(e) for e in se.extra) + " " if se.extra else ""
        body = "" if se.expression is None else f" {self.triple(se.expression)} "
        return f"{out}{{{body}}}{self.tail(se)}"

    def predicate(self, p: str) -> str:
        return "a" if p == RDF + "type" else self.label(p)

    # triple expressions

    def triple(self, te) -> str:
        if isinstance(te, Inclusion):
            return f"&{self.label(te.label)}"
        name = f"${self.label(te.id)} " if te.id else ""
        if isinstance(te, ValueExpr):
            return f"{name}= {self.calc(te.expr)}"
        if isinstance(te, EachOf | OneOf):
            inner = (" ; " if isinstance(te, EachOf) else " | ").join(f"( {self.triple(x)} )" if isinstance(x, EachOf | OneOf) and not x.id and (x.min, x.max) == (1, 1) and not x.acts and not x.annotations else self.triple(x) for x in te.exprs)
            plain = not name and (te.min, te.max) == (1, 1) and not te.acts and not te.annotations
            return inner if plain else f"{name}( {inner} ){self.cardinality(te.min, te.max)}{self.tail(te)}"
        sense = ("!" if te.negated else "") + ("^" if te.inverse else "")
        value = "." if te.value is None else self.expr(te.value)
        if te.value is not None and isinstance(te.value, ShapeOr | ShapeAnd | ShapeNot):
            value = f"({value})"
        return f"{name}{sense}{self.predicate(te.predicate)} {value}{self.cardinality(te.min, te.max)}{self.tail(te)}"

    def calc(self, e) -> str:
        if isinstance(e, BinExpr):
            return f"({self.calc(e.left)} {e.op} {self.calc(e.right)})"
        return self.term(e)

    def cardinality(self, lo: int, hi: int | None) -> str:
        if (lo, hi) == (1, 1):
            return ""
        short = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((lo, hi))
        return f" {short or ('{' + str(lo) + ('' if hi == lo else ',' if hi is None else f',{hi}') + '}')}"


def show(schema: Schema) -> str:
    return Printer(schema).text()


