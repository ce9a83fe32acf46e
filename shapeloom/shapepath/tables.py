"""Shape paths over many schemas at once: axes and set operations as joins.

Every schema becomes a table of its nodes, numbered in the order of their
text: a node's descendants are those numbered after it and up to its ``last``.
The child axis is an equi-join, the descendant axis a range join within a schema,
and union, intersect and except are set operations on (key, first).

    nodes = tables.nodes(schemas)                   # key, text
    tables.evaluate(nodes, tables.parse("//shapenot/shaperef | /shape//tripleconstraint except //oneof/*", prefixes))

A step is ``/`` (child) or ``//`` (descendant), an optional axis (``child``,
``descendant``, ``nested-or-self-shape-expression``,
``nested-or-self-triple-expression``) and a test: a kind of node, ``*``, or a
name (the label of a shape or a reference, the predicate of a constraint), which
``@`` may precede for labels.  ``,`` ``|`` and ``union`` unite, ``intersect`` and
``except`` bind more closely and go from left to right.

Defined results: a path that leads nowhere gives no rows; texts that are no
schemas raise; null texts have no nodes; repeated keys are taken for one schema
only if their texts are equal, else results mix.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import spread
from ..schema.ast import EachOf, Inclusion, NodeConstraint, OneOf, SchemaError, Shape, ShapeAnd, ShapeExternal, ShapeNot, ShapeOr, ShapeRef, TripleConstraint
from ..schema.shexc import parse as parse_schema

#: Kinds of nodes by their names in paths.
KINDS = {ShapeAnd: "shapeand", ShapeOr: "shapeor", ShapeNot: "shapenot", Shape: "shape", ShapeRef: "shaperef", ShapeExternal: "shapeexternal", NodeConstraint: "nodeconstraint", EachOf: "eachof", OneOf: "oneof", TripleConstraint: "tripleconstraint", Inclusion: "inclusion"}
SHAPES = ("shapeand", "shapeor", "shapenot", "shape", "shaperef", "shapeexternal", "nodeconstraint")
TRIPLES = ("eachof", "oneof", "tripleconstraint", "inclusion")
AXES = ("child", "descendant", "nested-or-self-shape-expression", "nested-or-self-triple-expression")
NODE = "key long, first int, last int, parent int, kind string, name string"


@dataclass(frozen=True)
class Step:
    axis: str
    kind: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class Path:
    steps: tuple


@dataclass(frozen=True)
class Sets:
    """op: union, intersect or except."""

    op: str
    left: object
    right: object


_TOKEN = re.compile(r"\s*(//?|[|,*@]|::|<[^>]*>|nested-or-self-(?:shape|triple)-expression|[\w.-]*:(?!:)[\w.-]*|\w+)")


class _Reader:
    def __init__(self, text: str, prefixes: dict):
        self.tokens, self.i, self.prefixes = [], 0, prefixes
        at, text = 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError(f"no shape path: {text[at:]}")
            self.tokens.append(m[1])
            at = m.end()

    def peek(self) -> str:
        return self.tokens[self.i] if self.i < len(self.tokens) else ""

    def take(self, *words: str) -> str:
        if self.peek() in words:
            self.i += 1
            return self.tokens[self.i - 1]
        return ""

    def expr(self):
        out = self.closer()
        while self.take("|", ",", "union"):
            out = Sets("union", out, self.closer())
        return out

    def closer(self):
        out = self.path()
        while word := self.take("intersect", "except"):
            out = Sets(word, out, self.path())
        return out

    def path(self) -> Path:
        steps = []
        while slash := self.take("/", "//"):
            axis = self.take(*AXES) or ("descendant" if slash == "//" else "child")
            self.take("::")
            label, word = bool(self.take("@")), self.peek()
            self.i += 1
            if word == "*":
                steps.append(Step(axis))
            elif word in KINDS.values() and not label:
                steps.append(Step(axis, word))
            elif word.startswith("<"):
                steps.append(Step(axis, name=word[1:-1]))
            elif ":" in word and word.partition(":")[0] in self.prefixes:
                steps.append(Step(axis, name=self.prefixes[word.partition(":")[0]] + word.partition(":")[2]))
            else:
                raise SchemaError(f"no test in a shape path: {word or 'the end'}")
        if not steps:
            raise SchemaError("a shape path begins with / or //")
        return Path(tuple(steps))


def parse(text: str, prefixes: dict | None = None):
    r = _Reader(text, prefixes or {})
    out = r.expr()
    if r.peek():
        raise SchemaError(f"unexpected {r.peek()} in a shape path")
    return out


def _children(x):
    if isinstance(x, ShapeAnd | ShapeOr | EachOf | OneOf):
        return x.exprs
    if isinstance(x, ShapeNot):
        return (x.expr,)
    if isinstance(x, Shape):
        return () if x.expression is None else (x.expression,)
    if isinstance(x, TripleConstraint):
        return () if x.value is None else (x.value,)
    return ()


def numbered(text: str) -> list[tuple]:
    """(first, last, parent, kind, name) of a schema's nodes; the schema itself is 0.  A declared shape has its label as name."""
    schema, out = parse_schema(text), []

    def add(x, parent: int, label: str | None = None) -> None:
        at = len(out)
        out.append(None)
        name = label or (x.label if isinstance(x, ShapeRef | Inclusion) else x.predicate if isinstance(x, TripleConstraint) else None)
        for c in _children(x):
            add(c, at)
        out[at] = (at, len(out) - 1, parent, KINDS.get(type(x), "other"), name)

    out.append(None)
    if schema.start is not None:
        add(schema.start, 0, "START")
    for d in schema.shapes:
        add(d.expr, 0, d.label)
    out[0] = (0, len(out) - 1, None, "schema", None)
    return out


BATCH = 50_000  # rows that a task holds at a time


def nodes(schemas: DataFrame) -> DataFrame:
    """(key, first, last, parent, kind, name) of schemas (key, text in the compact syntax); a task numbers equal texts once."""
    schema = pa.schema([("key", pa.int64()), *((c, pa.int32()) for c in ("first", "last", "parent")), ("kind", pa.string()), ("name", pa.string())])

    def run(batches):
        seen, of = None, ()
        for batch in batches:
            out = [[] for _ in schema]
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text != seen:
                    seen, of = text, list(zip(*numbered(text), strict=True))
                out[0] += [key] * len(of[0])
                for mine, more in zip(out[1:], of, strict=True):
                    mine += more
                if len(out[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
                    out = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    texts = schemas.select(F.col("key").cast("long").alias("key"), "text").where("text IS NOT NULL")
    return spread(texts, "text", F.pmod(F.xxhash64("key"), F.lit(8))).mapInArrow(run, NODE)


def _step(table: DataFrame, at: DataFrame | None, step: Step) -> DataFrame:
    """Where a step leads from ``at``, or from the schemas themselves: everything is inside those, so that takes no join."""
    column = (lambda x: F.col(f"n.{x}")) if at is not None else F.col
    where = F.lit(True)
    if step.axis.startswith("nested"):
        where = column("kind").isin(*(SHAPES if "shape" in step.axis else TRIPLES))
    if step.kind is not None:
        where = where & (column("kind") == step.kind)
    if step.name is not None:
        where = where & (column("name") == step.name)
    if at is None:
        inside = {"child": F.col("parent") == 0}.get(step.axis, F.col("first") > 0)
        return table.where(inside & where).select("key", "first", "last").distinct()
    # both sides may be as large as the corpus: never sent to every task
    n, c = table.alias("n"), at.hint("merge").alias("c")
    inside = (F.col("n.first") > F.col("c.first")) & (F.col("n.first") <= F.col("c.last"))
    itself = F.col("n.first") == F.col("c.first")
    there = {"child": F.col("n.parent") == F.col("c.first"), "descendant": inside}.get(step.axis, inside | itself)
    return n.join(c, (F.col("n.key") == F.col("c.key")) & there & where).select("n.key", "n.first", "n.last").distinct()


def evaluate(table: DataFrame, expr) -> DataFrame:
    """(key, first, last) of the nodes that a path expression selects in each schema of ``table``."""
    if isinstance(expr, Sets):
        a, b = evaluate(table, expr.left), evaluate(table, expr.right)
        if expr.op == "union":
            return a.unionByName(b).distinct()
        return a.join(b.select("key", "first").hint("merge"), ["key", "first"], "left_semi" if expr.op == "intersect" else "left_anti")
    return reduce(lambda at, s: _step(table, at, s), expr.steps, None)
