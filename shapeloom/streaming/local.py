"""Validation of streams: shapes that need no other node.

Node constraints are stateless predicates on each arriving row.  A flat shape
keeps counts per node and emits a node's status whenever it changes (update
mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nodeconstraint import compile_constraint
from ..functions.terms import TRIPLES, TermColumns, term_at
from ..plans.validate import CONFORMANT, NONCONFORMANT, Validator
from ..schema.ast import NodeConstraint, Schema, SchemaError, Shape, ShapeAnd, ShapeNot, ShapeOr
from ..sources.graph import Graph

_TRIPLE = [c.split()[0] for c in TRIPLES.split(", ")]


def node_constraints(terms: DataFrame, expr, t: TermColumns | None = None) -> DataFrame:
    """Rows of terms (kind, lex, dt, lang) with ``status``; expr: boolean combinations of node constraints."""
    t = t or term_at("")

    def column(e):
        if isinstance(e, ShapeAnd | ShapeOr):
            parts = [column(x) for x in e.exprs]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(e, ShapeAnd) else out | p
            return out
        if isinstance(e, ShapeNot):
            return ~column(e.expr)
        if isinstance(e, NodeConstraint):
            return compile_constraint(e, t)
        raise SchemaError("a stream of terms has node constraints only")

    return terms.withColumn("status", F.when(column(expr), CONFORMANT).otherwise(NONCONFORMANT))


def flat_shape(triples: DataFrame, schema: Schema, label: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(node, status) of a streamed triples table by one flat shape over outgoing arcs; the same counts as in batch.

    Graphs are sets: a triple that comes again counts once; with ``event_time``
    it is remembered for ``delay`` only.  All arcs of a node meet in its
    counts, however far apart they come.
    """
    once = triples.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(_TRIPLE) if event_time else triples.dropDuplicates(_TRIPLE)
    v = Validator(schema, Graph(once.select(*_TRIPLE), distinct=False))
    se, atoms = v.exprs[label], v.atoms[label]
    if not isinstance(se, Shape) or len(atoms) != 1 or atoms[0].plan == "GENERAL" or atoms[0].backward or any(v._references(label)):
        raise SchemaError("only flat shapes over outgoing arcs are streamed")
    (counted,) = v._counts(atoms, set(), {})
    return counted.select("node", F.when(v._atom(atoms[0]), CONFORMANT).otherwise(NONCONFORMANT).alias("status"))
