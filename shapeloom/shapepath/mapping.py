"""Shape paths over schemas, and schema mappings that rename predicates.

``/@<S>/<p>`` goes from the schema to the shape S and on to its constraints of
p; an index in brackets takes the n-th of what a step finds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema.ast import EachOf, OneOf, Schema, SchemaError, Shape, ShapeAnd, ShapeNot, ShapeOr, ShapeRef, TripleConstraint, walk_triples
from ..schema.shexc import PATH_TOKENS, Parser

CONTEXTS = {
    "shapeand": ShapeAnd, "shapeor": ShapeOr, "shapenot": ShapeNot, "shape": Shape, "shaperef": ShapeRef,
    "eachof": EachOf, "oneof": OneOf, "tripleconstraint": TripleConstraint,
}


@dataclass(frozen=True)
class Step:
    """kind: shape (by label), constraint (by predicate or triple label) or index; n: occurrence, from 1."""

    kind: str
    value: object
    n: int | None = None
    axis: str = "child"


@dataclass(frozen=True)
class Rule:
    path: tuple
    iri: str


class _Paths(Parser):
    def path(self) -> tuple:
        out = []
        self.t.accept("/")
        while True:
            out.append(self.step())
            if not self.t.accept("/"):
                break
        if self.t.is_op(",", "|") or self.t.word() in ("union", "intersect", "except"):
            raise SchemaError("set operations on paths are not supported")
        return tuple(out)

    def step(self) -> Step:
        t = self.t
        word = t.word()
        if word in CONTEXTS and t.peek(1)[1].startswith(":"):
            raise SchemaError(f"context test {word} is not supported")
        if word in ("child", "descendant", "nested") or t.accept("//"):
            raise SchemaError(f"axis {word or 'descendant'} is not supported")
        if t.accept("@"):
            kind, value = "shape", "START" if t.accept_word("start") else self.label()
        elif t.peek()[0] == "integer":
            return Step("index", int(t.next()[1]))
        else:
            kind, value = "constraint", self.label()
        n = None
        if t.accept("["):
            n = int(t.next()[1])
            t.expect("]")
        return Step(kind, value, n)

    def header(self) -> None:
        while self.t.word() in ("prefix", "base"):
            if self.t.next()[1].lower() == "base":
                self.base = self.iri()
            else:
                name = self.t.next()[1][:-1]
                self.prefixes[name] = self.iri()

    def rules(self) -> list[Rule]:
        self.header()
        out = []
        while self.t.peek()[0] != "end":
            path = self.path()
            self.t.expect("~")
            self.t.expect(">")
            out.append(Rule(path, self.iri()))
            self.t.accept(";")
        return out


def parse(text: str, base: str | None = None, prefixes: dict | None = None) -> list[Rule]:
    """Rules ``path ~> iri`` of a mapping document."""
    p = _Paths(text, base, PATH_TOKENS)
    p.prefixes |= prefixes or {}
    return p.rules()


def parse_path(text: str, base: str | None = None, prefixes: dict | None = None) -> tuple:
    p = _Paths(text, base, PATH_TOKENS)
    p.prefixes |= prefixes or {}
    p.header()
    out = p.path()
    if p.t.peek()[0] != "end":
        p.t.fail("expected the end")
    return out


def _nth(found: list, n: int | None) -> list:
    return found if n is None else found[n - 1 : n]


def evaluate(schema: Schema, path: tuple) -> tuple[list, list[str]]:
    """Schema objects that a path leads to, and what went wrong on the way."""
    nodes, errors = [schema], []
    for step in path:
        found = []
        for x in nodes:
            got, why = _one(x, step, schema)
            found += got
            errors += why
        nodes = found
    return nodes, errors


def _one(x, step: Step, schema: Schema) -> tuple[list, list[str]]:
    if step.kind == "shape":
        if isinstance(x, Schema):
            if step.value == "START":
                return ([x.start], []) if x.start is not None else ([], ["no start shape"])
            found = [d.expr for d in x.shapes if d.label == step.value]
        elif isinstance(x, ShapeAnd | ShapeOr):
            found = [e for e in x.exprs if isinstance(e, ShapeRef) and e.label == step.value]
        elif isinstance(x, ShapeRef):
            return _one(schema.shape(x.label).expr, step, schema)
        else:
            found = []
        return (_nth(found, step.n), []) if found else ([], [f"no shape {step.value} in {type(x).__name__}"])
    if step.kind == "index":
        members = x.shapes if isinstance(x, Schema) else x.exprs if isinstance(x, ShapeAnd | ShapeOr | EachOf | OneOf) else (x.expr,) if isinstance(x, ShapeNot) else _triples(x)
        members = [m.expr if isinstance(x, Schema) else m for m in members]
        found = _nth(list(members), step.value)
        return (found, []) if found else ([], [f"no member {step.value} in {type(x).__name__}"])
    found = [t for t in _constraints(x, schema) if (isinstance(t, TripleConstraint) and t.predicate == step.value) or getattr(t, "id", None) == step.value]
    return (_nth(found, step.n), []) if found else ([], [f"no constraint {step.value} in {type(x).__name__}"])


def _triples(x) -> tuple:
    if isinstance(x, Shape) and x.expression is not None:
        return x.expression.exprs if isinstance(x.expression, EachOf) else (x.expression,)
    return ()


def _constraints(x, schema: Schema):
    if isinstance(x, Shape):
        yield from walk_triples(x.expression)
    elif isinstance(x, EachOf | OneOf):
        yield from walk_triples(x)
    elif isinstance(x, ShapeAnd | ShapeOr):
        for e in x.exprs:
            yield from _constraints(e, schema)
    elif isinstance(x, ShapeRef):
        yield from _constraints(schema.shape(x.label).expr, schema)
    elif isinstance(x, TripleConstraint) and x.value is not None:
        yield from _constraints(x.value, schema)


def _label_and_predicate(path: tuple) -> tuple[str, str]:
    if len(path) != 2 or path[0].kind != "shape" or path[1].kind != "constraint":
        raise SchemaError("a mapping replaces at @label/predicate")
    return path[0].value, path[1].value


def convert(schema: Schema, rules: list[Rule]) -> Schema:
    """The schema with predicates renamed, rule by rule."""
    for rule in rules:
        label, predicate = _label_and_predicate(rule.path)
        if label not in schema.labels:
            raise SchemaError(f"no shape {label}")

        def shape(se, predicate=predicate, iri=rule.iri):
            if isinstance(se, ShapeAnd | ShapeOr):
                return type(se)(tuple(shape(e) for e in se.exprs))
            if isinstance(se, ShapeNot):
                return ShapeNot(shape(se.expr))
            if isinstance(se, Shape) and se.expression is not None:
                extra = tuple(iri if e == predicate else e for e in se.extra)
                return replace(se, expression=triple(se.expression, predicate, iri), extra=extra)
            return se

        def triple(te, predicate, iri):
            if isinstance(te, EachOf | OneOf):
                return replace(te, exprs=tuple(triple(e, predicate, iri) for e in te.exprs))
            if isinstance(te, TripleConstraint) and te.predicate == predicate:
                return replace(te, predicate=iri)
            return te

        schema = replace(schema, shapes=tuple(replace(d, expr=shape(d.expr)) if d.label == label else d for d in schema.shapes))
    return schema


def rename(triples: DataFrame, rules: list[Rule]) -> DataFrame:
    """The data side: predicates of triples by the rules; a CASE, since rules are schema-sized."""
    p = F.col("p")
    for rule in rules:
        _, predicate = _label_and_predicate(rule.path)
        p = F.when(F.col("p") == predicate, F.lit(rule.iri)).otherwise(p)
    return triples.withColumn("p", p)


