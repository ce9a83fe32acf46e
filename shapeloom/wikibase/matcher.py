"""Matching entities against entity schemas: a boolean column over the nested row, without a shuffle.

References between entities count statements only in a local match.  ``match_graph``
follows them: each entity gets a map from the entities that its statements name
to the labels known of those, and references become look-ups in the same
expressions, so choices, negation, EXTRA and cardinalities hold as they do locally.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rbe
from ..functions.nodeconstraint import facet
from ..functions.terms import TermColumns
from ..plans.storage import keep
from ..plans.validate import bag_expression
from ..schema import analyze
from ..schema.ast import (
    START,
    XSD,
    EachOf,
    Iri,
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
    Stem,
    TripleConstraint,
    walk_shapes,
)
from .entityschema import WD, StatementConstraint, TermConstraint, property_of


SALTS = 8  # a target that many entities name is met in so many parts
FEW = 100_000  # ids that may be sent to all tasks, so that a round of few changes moves no whole table


def _few(ids: DataFrame) -> DataFrame:
    """A kept table that joins send to all tasks, if it is small."""
    ids = keep(ids)
    return F.broadcast(ids) if ids.count() <= FEW else ids


def _all(xs) -> Column:
    return reduce(lambda a, b: a & b, xs, F.lit(True))


def snak_matches(nc, snak: Column, refs=None) -> Column:
    """A value constraint on one snak; entities are IRIs, other values literals.

    refs: what tells whether a snak's entity has a label; without it, what a
    reference leads to is not looked at.
    """
    if nc is None:
        return F.lit(True)
    if isinstance(nc, ShapeRef):
        return F.lit(True) if refs is None else refs(nc.label, snak)
    if isinstance(nc, Shape) and nc == Shape():
        return F.lit(True)
    if isinstance(nc, ShapeAnd):
        return _all(snak_matches(x, snak, refs) for x in nc.exprs)
    if isinstance(nc, ShapeOr):
        return reduce(lambda a, b: a | b, (snak_matches(x, snak, refs) for x in nc.exprs))
    if isinstance(nc, ShapeNot):
        return ~snak_matches(nc.expr, snak, refs)
    if not isinstance(nc, NodeConstraint):
        raise SchemaError(f"no local constraint: {type(nc).__name__}")
    entity = snak["vtype"] == "entity"
    parts = []
    if nc.kind:
        parts.append({"iri": entity, "nonliteral": F.coalesce(entity, F.lit(False)) | (snak["kind"] == "somevalue"), "literal": (snak["kind"] == "value") & ~entity, "bnode": snak["kind"] == "somevalue"}[nc.kind])
    if nc.datatype:
        kinds = {XSD + "string": ["string"], XSD + "decimal": ["quantity"], XSD + "dateTime": ["time"]}
        if nc.datatype not in kinds:
            raise SchemaError(f"datatype {nc.datatype} has no entity value")
        parts.append(snak["vtype"].isin(kinds[nc.datatype]))
    if nc.values is not None:
        parts.append(reduce(lambda a, b: a | b, (_value(v, snak) for v in nc.values), F.lit(False)))
    number = snak["vtype"] == "quantity"
    t = TermColumns(F.when(entity, "iri").otherwise("literal"), F.regexp_replace(snak["value"], r"^\+", ""), F.when(number, XSD + "decimal").otherwise(XSD + "string"), F.lit(None).cast("string"))
    parts += [(snak["kind"] == "value") & facet(f, t) for f in nc.facets]
    return F.coalesce(_all(parts), F.lit(False))


def _value(v, snak: Column) -> Column:
    entity = snak["vtype"] == "entity"
    if isinstance(v, Iri):
        return entity & (snak["value"] == property_of(v.value)) if v.value.startswith(WD) else (snak["value"] == v.value)
    if isinstance(v, Stem) and v.kind == "iri":
        return F.concat(F.lit(WD), snak["value"]).startswith(v.stem) & entity
    if isinstance(v, Literal) and not v.lang:
        return ~entity & (snak["value"] == v.lex)
    raise SchemaError(f"no entity value: {v}")


def _counted(te, snaks: Column, refs=None) -> Column:
    """A triple expression over snaks of qualifiers or of one reference: per constraint the matching ones are counted."""
    if isinstance(te, EachOf):
        return _all(_counted(x, snaks, refs) for x in te.exprs)
    if isinstance(te, OneOf):
        return reduce(lambda a, b: a | b, (_counted(x, snaks, refs) for x in te.exprs))
    p = property_of(te.predicate)
    mine = F.size(F.filter(snaks, lambda s: (s["property"] == p) & snak_matches(te.value, s, refs)))
    others = F.exists(snaks, lambda s: (s["property"] == p) & ~snak_matches(te.value, s, refs))
    return _bounds(mine, te.min, te.max) & ~others


def _bounds(n: Column, lo: int, hi: int | None) -> Column:
    ok = n >= lo
    return ok if hi is None else ok & (n <= hi)


def statement_matches(tc: TripleConstraint, s: Column, refs=None) -> Column:
    return snak_matches(tc.value, s["snak"], refs) & _all(test for _, test in _beside(tc, s, refs))


def _beside(tc: TripleConstraint, s: Column, refs=None) -> list[tuple[str, Column]]:
    """What a constraint asks of a statement beside its value, by name."""
    out = []
    if isinstance(tc, StatementConstraint):
        if tc.qualifiers is not None:
            out.append(("qualifiers", _counted(tc.qualifiers, s["qualifiers"], refs)))
        if tc.references:
            out.append(("references", reduce(lambda a, b: a | b, (_bounds(F.size(F.filter(s["refs"], _of_reference(spec, refs))), lo, hi) for spec, lo, hi in tc.references))))
    return out


def _of_reference(spec, refs):
    return lambda r: _counted(spec, r, refs)


def _statements(tc: TripleConstraint, matching: bool, refs=None):
    """Function from a statement to whether it is of the constraint's property and matches it, or does not."""
    p = property_of(tc.predicate)
    return lambda s: (s["property"] == p) & (statement_matches(tc, s, refs) if matching else ~statement_matches(tc, s, refs))


def constraint_matches(tc: TripleConstraint, extra: set[str], refs=None) -> Column:
    """Matching statements within the cardinality; others of the property only under EXTRA."""
    ok = _bounds(F.size(F.filter("statements", _statements(tc, True, refs))), tc.min, tc.max)
    if property_of(tc.predicate) not in extra:
        ok = ok & ~F.exists("statements", _statements(tc, False, refs))
    return ok


def _grouped(te) -> bool:
    """Whether a group of statements has a cardinality of its own."""
    return isinstance(te, EachOf | OneOf) and ((te.min, te.max) != (1, 1) or any(_grouped(x) for x in te.exprs))


def _repeated(te, extra: set[str], refs=None) -> Column:
    """A group that repeats: interval arithmetic over the numbers of matching statements, as for arcs; no property may stand in it twice."""
    constraints: list[TripleConstraint] = []
    e = bag_expression(te, constraints)
    properties = [property_of(c.predicate) for c in constraints]
    if len(set(properties)) < len(properties):
        raise SchemaError("a property stands twice in a group of statements with a cardinality")
    counts = {i: F.size(F.filter("statements", _statements(c, True, refs))).cast("long") for i, c in enumerate(constraints)}
    others = [~F.exists("statements", _statements(c, False, refs)) for c, p in zip(constraints, properties, strict=True) if p not in extra]
    return rbe.matches_columns(e, counts) & _all(others)


def _triples(te, extra: set[str], refs=None) -> Column:
    if _grouped(te):
        return _repeated(te, extra, refs)
    if isinstance(te, EachOf | OneOf):
        parts = [_triples(x, extra, refs) for x in te.exprs]
        return _all(parts) if isinstance(te, EachOf) else reduce(lambda a, b: a | b, parts)
    return constraint_matches(te, extra, refs)


def term_matches(c: TermConstraint) -> Column:
    def test(x: Column) -> Column:
        if c.test is None:
            return x.isNotNull()
        if c.test[0] == "set":
            return x.isin(list(c.test[1]))
        t = TermColumns(F.lit("literal"), x, F.lit(XSD + "string"), F.lit(None).cast("string"))
        return _all(facet(f, t) for f in c.test[1])

    if c.what == "alias":
        return F.coalesce(F.exists(F.try_element_at("aliases", F.lit(c.lang)), test), F.lit(False))
    column = {"label": "labels", "description": "descriptions"}[c.what]
    return F.coalesce(test(F.try_element_at(column, F.lit(c.lang))), F.lit(False))


class Matcher:
    """A compiled entity schema."""

    def __init__(self, schema: Schema, check_closed: bool = False):
        self.schema, self.check_closed, self.rounds = schema, check_closed, 0
        self.exprs = {d.label: d.expr for d in schema.shapes}
        if schema.start is not None:
            self.exprs[START] = schema.start

    def first(self) -> str:
        """The start shape, or else the first."""
        if START in self.exprs:
            return START
        if not self.exprs:
            raise SchemaError("no shapes")
        return next(iter(self.exprs))

    def column(self, label: str | None = None) -> Column:
        """Whether an entity matches, looking at its own row only."""
        return self._expr(self.exprs[label or self.first()], ())

    def _expr(self, se, trail: tuple, refs=None) -> Column:
        if isinstance(se, ShapeAnd):
            return _all(self._expr(x, trail, refs) for x in se.exprs)
        if isinstance(se, ShapeOr):
            return reduce(lambda a, b: a | b, (self._expr(x, trail, refs) for x in se.exprs))
        if isinstance(se, ShapeNot):
            return ~self._expr(se.expr, trail, refs)
        if isinstance(se, ShapeRef):
            if se.label in trail:
                raise SchemaError(f"shape {se.label} refers to itself")
            if se.label not in self.exprs:
                raise SchemaError(f"no shape {se.label}")
            return self._expr(self.exprs[se.label], (*trail, se.label), refs)
        if isinstance(se, Shape):
            return self._shape(se, refs)
        raise SchemaError(f"cannot match {type(se).__name__} with an entity")

    def _shape(self, se: Shape, refs=None) -> Column:
        extra = {property_of(e) for e in se.extra}
        ok = F.lit(True) if se.expression is None else _triples(se.expression, extra, refs)
        for c in getattr(se, "terms", ()):
            ok = ok & term_matches(c)
        if se.closed and self.check_closed:
            ok = ok & ~F.exists("statements", lambda s: ~s["property"].isin(sorted(self._properties(se.expression))))
        return ok

    def _properties(self, te) -> set[str]:
        if te is None:
            return set()
        if isinstance(te, EachOf | OneOf):
            return set().union(*(self._properties(x) for x in te.exprs))
        return {property_of(te.predicate)}

    def kept(self, label: str | None = None) -> Column:
        """The statements that the shape's constraints matched: the projected entity's.  Of a choice, those of the operands that hold."""
        return F.filter("statements", self._keeps(self.exprs[label or self.first()], ()))

    def _keeps(self, se, trail):
        """Function from a statement to whether the expression matched it."""
        if isinstance(se, ShapeAnd | ShapeOr):
            parts = [self._keeps(x, trail) for x in se.exprs]
            whole = [F.coalesce(self._expr(x, trail), F.lit(False)) if isinstance(se, ShapeOr) else F.lit(True) for x in se.exprs]
            return lambda s: reduce(lambda a, b: a | b, (w & p(s) for w, p in zip(whole, parts, strict=True)))
        if isinstance(se, ShapeRef) and se.label not in trail:
            return self._keeps(self.exprs[se.label], (*trail, se.label))
        mine = list(self._constraints(se, trail))
        return lambda s: reduce(lambda a, b: a | b, ((s["property"] == property_of(tc.predicate)) & statement_matches(tc, s) for tc in mine), F.lit(False))

    def reasons(self, label: str | None = None, refs=None) -> Column:
        """Why an entity fails: codes with their properties, by constraint; empty where the shape holds.

        ``too-few``, ``too-many`` and ``no-match`` count statements; ``reference``
        (an entity lacks the label asked of it, told only with ``refs``), ``qualifiers``
        and ``references`` say what a statement fails by; ``not`` is a negation
        whose operand holds.  Operands of a choice that fails all tell their codes.
        """
        se = self.exprs[label or self.first()]
        found = []
        for shape in self._same_entity(se, (), refs):
            if isinstance(shape, Column):
                found.append(F.when(shape, F.lit("not")))
                continue
            extra = {property_of(e) for e in shape.extra}
            for tc in self._constraints(shape, ()):
                p = property_of(tc.predicate)
                mine = F.size(F.filter("statements", _statements(tc, True, refs)))
                found.append(F.when(mine < tc.min, F.lit(f"too-few {p}")))
                if tc.max is not None:
                    found.append(F.when(mine > tc.max, F.lit(f"too-many {p}")))
                blamed = mine < tc.min if p in extra else F.lit(True)
                if p not in extra:
                    found.append(F.when(F.exists("statements", _statements(tc, False, refs)), F.lit(f"no-match {p}")))
                found += [F.when(blamed & F.exists("statements", fails), F.lit(f"{code} {p}")) for code, fails in self._faults(tc, refs)]
            for c in getattr(shape, "terms", ()):
                found.append(F.when(~term_matches(c), F.lit(f"{c.what} {c.lang}")))
        none = F.array().cast("array<string>")
        return F.when(F.coalesce(self._expr(se, (), refs), F.lit(False)), none).otherwise(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))) if found else none)

    @staticmethod
    def _faults(tc: TripleConstraint, refs):
        """Codes of what a statement can fail by, each with a function from a statement to whether it does."""
        p = property_of(tc.predicate)
        mine = lambda s: (s["property"] == p) & snak_matches(tc.value, s["snak"], refs)
        if refs is not None and tc.value is not None and any(isinstance(x, ShapeRef) for x in walk_shapes(tc.value)):
            yield "reference", lambda s: (s["property"] == p) & (s["snak"]["vtype"] == "entity") & ~snak_matches(tc.value, s["snak"], refs)
        if isinstance(tc, StatementConstraint):
            if tc.qualifiers is not None:
                yield "qualifiers", lambda s: mine(s) & ~dict(_beside(tc, s, refs))["qualifiers"]
            if tc.references:
                yield "references", lambda s: mine(s) & ~dict(_beside(tc, s, refs))["references"]

    def _same_entity(self, se, trail, refs):
        """Shapes that the entity itself has to have, and of each negation whether its operand holds."""
        if isinstance(se, ShapeAnd | ShapeOr):
            for x in se.exprs:
                yield from self._same_entity(x, trail, refs)
        elif isinstance(se, ShapeRef) and se.label not in trail:
            yield from self._same_entity(self.exprs[se.label], (*trail, se.label), refs)
        elif isinstance(se, ShapeNot):
            yield self._expr(se.expr, trail, refs)
        elif isinstance(se, Shape):
            yield se

    def _constraints(self, se, trail):
        if isinstance(se, ShapeAnd | ShapeOr):
            for x in se.exprs:
                yield from self._constraints(x, trail)
        elif isinstance(se, ShapeRef) and se.label not in trail:
            yield from self._constraints(self.exprs[se.label], (*trail, se.label))
        elif isinstance(se, Shape) and se.expression is not None:
            todo = [se.expression]
            while todo:
                te = todo.pop()
                if isinstance(te, EachOf | OneOf):
                    todo += te.exprs
                else:
                    yield te

    # over many entities

    def match(self, entities: DataFrame, label: str | None = None) -> DataFrame:
        """``entities`` with ``matches``."""
        return entities.withColumn("matches", F.coalesce(self.column(label), F.lit(False)))

    def filter(self, entities: DataFrame, label: str | None = None, project: bool = False) -> DataFrame:
        """Matching entities; projected ones keep matched statements only."""
        out = entities.where(self.column(label))
        return out.withColumn("statements", self.kept(label)) if project else out

    def fold(self, entities: DataFrame, *aggregates: Column, label: str | None = None) -> DataFrame:
        """Aggregates over matching entities: what a caller's monoid is to a dump reader."""
        return self.filter(entities, label).agg(*aggregates)

    def _asked(self, se) -> set[str]:
        """Labels that an expression asks of other entities, those of its own entity's references included."""
        out, todo, seen = set(), [se], set()
        while todo:
            e = todo.pop()
            if isinstance(e, ShapeAnd | ShapeOr | EachOf | OneOf):
                todo += e.exprs
            elif isinstance(e, ShapeNot):
                todo.append(e.expr)
            elif isinstance(e, ShapeRef) and e.label not in seen:
                if e.label not in self.exprs:
                    raise SchemaError(f"no shape {e.label}")
                seen.add(e.label)
                todo.append(self.exprs[e.label])
            elif isinstance(e, Shape) and e.expression is not None:
                todo.append(e.expression)
            elif isinstance(e, TripleConstraint):
                inner = [e]
                while inner:
                    x = inner.pop()
                    if isinstance(x, EachOf | OneOf):
                        inner += x.exprs
                        continue
                    out |= {y.label for y in walk_shapes(x.value) if isinstance(y, ShapeRef)} if x.value is not None else set()
                    if isinstance(x, StatementConstraint):
                        inner += [q for q in (x.qualifiers, *(r[0] for r in x.references)) if q is not None]
        return out

    def match_graph(self, entities: DataFrame) -> DataFrame:
        """(id, ok_shapes): labels whose shapes hold, references followed."""
        typed = self._typed(entities)[0]
        return entities.select("id").join(typed.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("ok_shapes")), "id", "left").select("id", F.coalesce("ok_shapes", F.array().cast("array<string>")).alias("ok_shapes"))

    def reasons_graph(self, entities: DataFrame, label: str | None = None) -> DataFrame:
        """(id, reasons): why an entity fails where references are followed; see ``reasons``."""
        label = label or self.first()
        _, rows, known, refs = self._typed(entities)
        wanted = self._asked(self.exprs[label])
        rows = rows.join(known(wanted), "id", "left") if wanted else rows
        return rows.select("id", self.reasons(label, refs).alias("reasons"))

    def _typed(self, entities: DataFrame):
        """(id, label) of all labels that hold, the entities as far as labels look at them, what they know of labels, and the test of a reference.

        Labels go in strata, those asked first.  Labels that ask each other
        start as held by all entities and lose those whose expressions fail,
        until nothing changes; a round looks at those only that name an entity
        which lost a label.  Negation inside such a cycle is refused.
        Entities that are named but not among ``entities`` have no label.
        """
        wrong = analyze.negative_cycles(analyze.dependencies(self.schema))
        if wrong:
            raise SchemaError(f"negation through the cycle {', '.join(wrong[0])}")
        asked = {x: self._asked(e) for x, e in self.exprs.items()}
        used = set().union(*(self._properties(x.expression) for e in self.exprs.values() for x in analyze.same_node(e) if isinstance(x, Shape)))
        mine = entities if self.check_closed else entities.withColumn("statements", F.filter("statements", lambda s: s["property"].isin(sorted(used))))
        mine = keep(mine.select("id", "labels", "descriptions", "aliases", "statements"))
        named = lambda s: F.transform(F.filter(F.concat(F.array(s["snak"]), s["qualifiers"], F.flatten(s["refs"])), lambda x: x["vtype"] == "entity"), lambda x: x["value"])
        arcs = keep(mine.select("id", F.explode(F.array_distinct(F.flatten(F.transform("statements", named)))).alias("target"))) if any(asked.values()) else None
        typed = None

        def known(labels: set[str], only: DataFrame | None = None) -> DataFrame:
            links, have = arcs, typed
            if only is not None:
                links = keep(arcs.join(only, "id", "left_semi"))
                have = typed.join(_few(links.select(F.col("target").alias("id")).distinct()), "id", "left_semi")
            have = have.where(F.col("label").isin(sorted(labels))).groupBy("id").agg(F.collect_set("label").alias("has")).withColumnRenamed("id", "target")
            spread = have.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # many may name one entity
            return links.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["target", "_salt"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("target", "has"))).alias("_known"))

        def refs(label: str, snak: Column) -> Column:
            return (snak["vtype"] == "entity") & F.coalesce(F.array_contains(F.try_element_at("_known", snak["value"]), label), F.lit(False))

        def verdicts(labels: list[str], only: DataFrame | None = None) -> DataFrame:
            wanted = set().union(*(asked[x] for x in labels))
            rows = mine if only is None else mine.join(only, "id", "left_semi")
            rows = rows.join(known(wanted, only), "id", "left") if wanted else rows
            holds = F.array_compact(F.array(*(F.when(F.coalesce(self._expr(self.exprs[x], (), refs), F.lit(False)), F.lit(x)) for x in labels)))
            return keep(rows.select("id", F.explode(holds).alias("label")))

        for group in analyze.strongly_connected(asked):
            done = typed
            if any(asked[x] & set(group) for x in group):
                before = mine.select("id", F.explode(F.array(*map(F.lit, group))).alias("label"))
                typed = self._with(done, before)
                now = verdicts(group)
                lost = keep(before.join(now, ["id", "label"], "left_anti"))
                typed, gone = self._with(done, now), None
                while not lost.isEmpty():  # only what names an entity that lost a label is looked at again
                    self.rounds += 1
                    near = _few(arcs.join(_few(lost.select(F.col("id").alias("target")).distinct()), "target", "left_semi").select("id").distinct())
                    again = verdicts(group, near)
                    held = now.join(near, "id", "left_semi")
                    if gone is not None:
                        held = held.join(gone.join(near, "id", "left_semi"), ["id", "label"], "left_anti")
                    lost = keep(held.join(again, ["id", "label"], "left_anti"))
                    gone = lost if gone is None else gone.unionByName(lost)
                    if self.rounds % 8 == 0:  # what is lost is taken out now and then, not in every round
                        now, gone = keep(now.join(gone, ["id", "label"], "left_anti")), None
                    typed = self._with(done, now if gone is None else now.join(_few(gone), ["id", "label"], "left_anti"))
                now = now if gone is None else keep(now.join(gone, ["id", "label"], "left_anti"))
                typed = self._with(done, now)
            else:
                typed = self._with(done, verdicts(group))
        return typed, mine, known, refs

    @staticmethod
    def _with(a: DataFrame | None, b: DataFrame) -> DataFrame:
        return b if a is None else a.unionByName(b)
