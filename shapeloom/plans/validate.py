"""Validation: shape expressions compiled to aggregates and column predicates.

Every label is evaluated for all its nodes at once:

* arcs of the mentioned predicates (a filter that reaches the scan) get one
  flag per triple constraint;
* one ``groupBy(node)`` counts flags, with map-side partial sums;
* the bag expression is interval arithmetic over those counts;
* arcs that several constraints of one path may take are counted by set of
  constraints: a conjunction has an assignment if no set of constraints gets
  more arcs that fit no others than it may hold, nor fewer that fit it than it
  needs, so this too is a condition on counts;
* only other expressions over such arcs, and bases with conditions of their own
  (``ShapeParts``), go to a solver, once a task per distinct vector of counts.

Labels go in strata, dependencies first.  References are joins with the nodes
that conform to the label; those to labels of node constraints only are
predicates, and those to labels over arcs only need no demand.  A recursive
stratum starts from all demanded pairs and drops failing ones until nothing
changes (the greatest fixpoint); a round looks again only at nodes with arcs to
what the last one dropped.  Negation inside a cycle has to come in even numbers;
such a stratum is two-sided, and each side gets the typing most favourable to it.  A label that refers to itself by one arc at most is
a chain: pointers double, so n hops take log n rounds.  Demand is closed first
by following arcs from the requested pairs.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parts, rbe
from ..functions.nodeconstraint import compile_constraint
from ..functions.terms import TermColumns, resource, term_at, term_id
from ..schema import analyze
from ..schema.ast import (
    RDF,
    START,
    XSD,
    Declaration,
    EachOf,
    NodeConstraint,
    OneOf,
    Schema,
    SchemaError,
    Shape,
    ShapeAnd,
    ShapeNot,
    ShapeOr,
    ShapeParts,
    ShapeRef,
    TripleConstraint,
    ValueExpr,
    walk_shapes,
)
from ..sources.graph import Graph
from .storage import keep

CONFORMANT, NONCONFORMANT = "conformant", "nonconformant"
TEST = "http://shex.io/extensions/Test/"

_NODE = ("node", "kind", "lex", "dt", "lang")
NODE = "node string, kind string, lex string, dt string, lang string"


class Actions:
    """Semantic actions by IRI: each gets (code) and returns a Column that has to hold, or None."""

    def __init__(self):
        self.handlers = {TEST: lambda code: F.lit(False) if (code or "").strip().startswith("fail") else None}

    def register(self, iri: str, handler) -> None:
        self.handlers[iri] = handler

    def holds(self, acts: tuple) -> Column | None:
        found = [h(a.code) for a in acts if (h := self.handlers.get(a.name))]
        found = [f for f in found if f is not None]
        return reduce(lambda a, b: a & b, found) if found else None


#: Constraints of one path whose assignment is decided by counts; there are two for each set of them.
HALL = 5
#: Conditions on the node inside the bases of one shape; the solver answers for each combination of them.
CONDITIONS = 10
#: Classes of arcs that are counted in columns of their own; vectors of more are put together by a second aggregate.
CLASSES = 64
#: Vectors whose verdicts a task remembers.
KNOWN = 100_000


@dataclass
class Atom:
    """One shape of a label: its constraints (symbols of ``expr`` are their positions)."""

    shape: Shape | ShapeParts
    constraints: list[TripleConstraint]
    expr: object
    name: str
    conditions: tuple = ()  # on the node itself, of bases

    @property
    def dealt(self) -> bool:
        """Whether arcs are dealt to bases."""
        return isinstance(self.shape, ShapeParts)

    @property
    def paths(self) -> list[tuple[str, bool]]:
        return list(dict.fromkeys((c.predicate, c.inverse) for c in self.constraints))

    def of_path(self, path: tuple[str, bool]) -> list[int]:
        return [i for i, c in enumerate(self.constraints) if (c.predicate, c.inverse) == path]

    @property
    def conjunction(self) -> bool:
        e = self.expr
        return isinstance(e, rbe.Symbol | rbe.Empty) or isinstance(e, rbe.And) and all(isinstance(x, rbe.Symbol) for x in e.items)

    @property
    def solved(self) -> bool:
        """Whether it takes the solver."""
        most = max((len(self.of_path(p)) for p in self.paths), default=0)
        return self.dealt or most > (HALL if self.conjunction else 1)

    def classes(self) -> list[tuple[int, int]]:
        """(path, mask) of all classes that arcs can fall into, in order: paths by number and sets of their constraints as bits; none if those are too many."""
        groups = [self.of_path(p) for p in self.paths]
        if sum(1 << len(g) for g in groups) > CLASSES:
            return []
        found = [(k, _bits(some)) for k, g in enumerate(groups) for some in [*([()] if self.dealt else []), *_subsets(g)]]
        return sorted(found)

    def on_nothing(self, flags: int = 0) -> bool:
        """The verdict for a node without arcs."""
        return parts.holds(self.expr, [], flags) if self.dealt else rbe.matches(self.expr, {})

    def deal(self, classes: list[parts.Arcs], flags: int = 0) -> list[tuple] | None:
        """(class, constraint, first arc, arcs) of an assignment of classes of arcs, or None."""
        tree = self.expr if self.dealt else parts.Flat(self.expr, frozenset(), frozenset())
        return parts.deal(tree, classes, flags)

    @property
    def direct(self) -> set[str]:
        return {c.predicate for c in self.constraints if not c.inverse}

    @property
    def backward(self) -> set[str]:
        return {c.predicate for c in self.constraints if c.inverse}

    @property
    def plan(self) -> str:
        """FLAT: a conjunction of counts; SORBE: intervals; GENERAL: assignment."""
        if self.solved:
            return "GENERAL"
        return "FLAT" if self.conjunction else "SORBE"


def bag_expression(te, constraints: list[TripleConstraint]):
    """Bag expression of a triple expression; appends its constraints."""
    if te is None or isinstance(te, ValueExpr):
        return rbe.Empty()
    if isinstance(te, TripleConstraint):
        constraints.append(te)
        s = rbe.Symbol(len(constraints) - 1, te.min, te.max)
        return rbe.Repeat(s, 0, 1) if te.negated else s
    kind = rbe.And if isinstance(te, EachOf) else rbe.Or
    items = tuple(bag_expression(x, constraints) for x in te.exprs)
    if kind is rbe.And:  # nested groups without a cardinality are one conjunction
        items = tuple(y for x in items for y in (x.items if isinstance(x, rbe.And) else (x,)))
    e = items[0] if len(items) == 1 else kind(items)
    return e if (te.min, te.max) == (1, 1) else rbe.Repeat(e, te.min, te.max)


def part_tree(se, constraints: list[TripleConstraint], conditions: list[NodeConstraint]):
    """Tree of shapes over parts; appends their constraints, and their conditions on the node."""
    if isinstance(se, ShapeParts):
        return parts.Parts(tuple(part_tree(x, constraints, conditions) for x in (*se.bases, se.own)))
    if isinstance(se, ShapeAnd | ShapeOr):
        return (parts.All if isinstance(se, ShapeAnd) else parts.Any)(tuple(part_tree(x, constraints, conditions) for x in se.exprs))
    if isinstance(se, ShapeNot):
        return parts.Not(part_tree(se.expr, constraints, conditions))
    if isinstance(se, NodeConstraint):
        if se not in conditions:
            conditions.append(se)
        return parts.OnNode(conditions.index(se))
    if not isinstance(se, Shape):
        raise SchemaError(f"a base cannot hold {type(se).__name__}")
    at = len(constraints)
    e = bag_expression(se.expression, constraints)
    mine = frozenset((c.predicate, c.inverse) for c in constraints[at:])
    return parts.Flat(e, mine, frozenset((x, False) for x in se.extra))


def hoist(schema: Schema) -> Schema:
    """Shapes nested in values become labels of their own, so that values are constraints and references only."""
    added: list[Declaration] = []

    def value(se):
        if isinstance(se, ShapeAnd | ShapeOr):
            return type(se)(tuple(value(x) for x in se.exprs))
        if isinstance(se, ShapeNot):
            return ShapeNot(value(se.expr))
        if isinstance(se, Shape):
            if se == Shape():
                return NodeConstraint()
            label = f"nested:{len(added)}"
            added.append(Declaration(label, se))
            at = len(added) - 1
            added[at] = Declaration(label, outer(se))
            return ShapeRef(label)
        return se

    def triple(te):
        if isinstance(te, EachOf | OneOf):
            return replace(te, exprs=tuple(triple(x) for x in te.exprs))
        if isinstance(te, TripleConstraint) and te.value is not None:
            return replace(te, value=value(te.value))
        return te

    def outer(se):
        if isinstance(se, ShapeAnd | ShapeOr):
            return type(se)(tuple(outer(x) for x in se.exprs))
        if isinstance(se, ShapeNot):
            return ShapeNot(outer(se.expr))
        if isinstance(se, ShapeParts):
            return ShapeParts(tuple(outer(x) for x in se.bases), outer(se.own))
        if isinstance(se, Shape) and se.expression is not None:
            return replace(se, expression=triple(se.expression))
        return se

    shapes = [Declaration(d.label, outer(d.expr)) for d in schema.shapes]
    start = outer(schema.start) if schema.start is not None else None
    return replace(schema, shapes=tuple(shapes + added), start=start)


class Validator:
    """A compiled schema over a graph."""

    def __init__(self, schema: Schema, graph: Graph, resolver=None, actions: Actions | None = None, track: bool = False):
        wrong = analyze.problems(schema)
        if wrong:
            raise SchemaError("; ".join(wrong))
        self.graph, self.actions = graph, actions or Actions()
        flat = hoist(analyze.flatten(schema, resolver))
        self.exprs = {d.label: d.expr for d in flat.shapes}
        if flat.start is not None:
            self.exprs[START] = flat.start
        self.order = analyze.strata(flat)
        deps = analyze.dependencies(flat)
        self.recursive = {x for c in self.order for x in c if len(c) > 1 or any(t == x for t, _ in deps[x])}
        self.atoms: dict[str, list[Atom]] = {}
        for label, se in self.exprs.items():
            found = []
            for x in _own_shapes(se):
                if isinstance(x, ShapeParts) or x != Shape() and (x.expression is not None or x.closed):
                    constraints: list[TripleConstraint] = []
                    conditions: list[NodeConstraint] = []
                    e = part_tree(x, constraints, conditions) if isinstance(x, ShapeParts) else bag_expression(x.expression, constraints)
                    if len(conditions) > CONDITIONS:
                        raise SchemaError(f"the bases of {label} have more than {CONDITIONS} conditions on the node")
                    found.append(Atom(x, constraints, e, f"a{len(found)}", tuple(conditions)))
            self.atoms[label] = found
        self.rounds = 0
        self.typing: dict[str, DataFrame] = {}
        self.sides = analyze.sides(deps)
        self.chains = {} if track else {x: p for comp in self.order if len(comp) == 1 for x in comp if x in self.recursive and (p := self._chain(x))}
        self.inline: set[str] = set()
        self.default: dict[str, bool] = {}
        if not track:
            self._classify()

    def _classify(self) -> None:
        """Labels that need no demand.

        Inline: node constraints only, so a reference is a predicate on the
        value.  Open (``default``): shapes over arcs only, so they are
        evaluated for every node that has arcs, and all other nodes get the
        verdict of an empty neighbourhood.
        """
        for comp in self.order:
            label = comp[0]
            if len(comp) > 1 or label in self.recursive:
                continue
            here, there = self._references(label)
            kinds = {type(x) for x in _same_node(self.exprs[label])}
            known = self.inline | set(self.default)
            if here or not {r for refs in there.values() for r in refs} <= known:
                continue
            if not self.atoms[label]:
                self.inline.add(label)
            elif NodeConstraint not in kinds and not any(a.conditions for a in self.atoms[label]) and not any(x.acts for x in _own_shapes(self.exprs[label])):
                self.default[label] = _on_nothing(self.exprs[label], self.atoms[label])

    def _chain(self, label: str) -> tuple[str, bool] | None:
        """The path by which a label asks for itself, if that takes one arc at most and a failing target fails the node."""
        if any(isinstance(x, ShapeOr | ShapeNot) for x in _same_node(self.exprs[label])):
            return None
        asking = [(a, i, c) for a in self.atoms[label] for i, c in enumerate(a.constraints) if c.value is not None and any(x == ShapeRef(label) for x in walk_shapes(c.value))]
        if len(asking) != 1:
            return None
        a, _, c = asking[0]
        path = (c.predicate, c.inverse)
        plain = c.value == ShapeRef(label) and c.max == 1 and not c.negated and not c.acts and c.predicate not in a.shape.extra
        return path if plain and a.plan == "FLAT" and len(a.of_path(path)) == 1 else None

    def plan_of(self, label: str) -> str:
        """The physical template of a label."""
        kinds = [a.plan for a in self.atoms[label]] or ["NODE"]
        best = max(kinds, key=["NODE", "FLAT", "SORBE", "GENERAL"].index)
        return f"RECURSIVE {best}" if label in self.recursive else best

    # demand

    def _references(self, label: str) -> tuple[set[str], dict[tuple[str, bool], set[str]]]:
        """Labels asked of the node itself, and of what its arcs lead to, by path."""
        here: set[str] = set()
        there: dict[tuple[str, bool], set[str]] = {}
        for se in _same_node(self.exprs[label]):
            if isinstance(se, ShapeRef):
                here.add(se.label)
        for a in self.atoms[label]:
            for c in a.constraints:
                refs = {x.label for x in walk_shapes(c.value) if isinstance(x, ShapeRef)} if c.value is not None else set()
                if refs:
                    there.setdefault((c.predicate, c.inverse), set()).update(refs)
        return here, there

    def _targets(self, nodes: DataFrame, path: tuple[str, bool]) -> DataFrame:
        """Terms that a path leads to from nodes."""
        predicate, inverse = path
        arcs = _arcs(self.graph, set() if inverse else {predicate}, {predicate} if inverse else set())
        met = arcs.join(nodes.select("node"), "node", "left_semi")
        return met.select(term_id(term_at("")).alias("node"), "kind", "lex", "dt", "lang").distinct()

    def _demand(self, requested: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Nodes of every label that the requested ones depend on.  Strata in reverse: what asks comes before what is asked."""
        wanted: dict[str, list[DataFrame]] = {k: [v] for k, v in requested.items()}
        known: dict[str, DataFrame] = {}
        for comp in reversed(self.order):
            if not any(x in wanted for x in comp):
                continue
            if len(comp) == 1 and comp[0] not in self.recursive:
                label = comp[0]
                known[label] = _union_nodes(wanted[label])
                self._pass_on(label, known[label], wanted)
                continue
            if comp[0] in self.chains:
                known[comp[0]] = self._reached(_union_nodes(wanted[comp[0]]), self.chains[comp[0]])
                self._pass_on(comp[0], known[comp[0]], wanted, None, set(comp))
                continue
            done: dict[str, DataFrame] = {}
            fresh = {x: keep(_union_nodes(wanted[x])) for x in comp if x in wanted}
            while fresh:
                found: dict[str, list[DataFrame]] = {}
                for label, nodes in fresh.items():
                    done[label] = nodes if label not in done else done[label].unionByName(nodes)
                    self._pass_on(label, nodes, found, set(comp))
                fresh = {}
                for label, parts in found.items():
                    nodes = _union_nodes(parts)
                    if label in done:
                        nodes = nodes.join(done[label].select("node"), "node", "left_anti")
                    nodes = keep(nodes)
                    if not nodes.isEmpty():
                        fresh[label] = nodes
            for label, nodes in done.items():
                known[label] = keep(nodes)
                self._pass_on(label, known[label], wanted, None, set(comp))
            for label in set(comp) - set(done):  # asked by the others, but of no node
                known[label] = self.graph.spark.createDataFrame([], NODE)
        return known

    def _single(self, path: tuple[str, bool]) -> DataFrame:
        """(node, target, and the target's term) of nodes with one target by a path."""
        predicate, inverse = path
        arcs = _arcs(self.graph, set() if inverse else {predicate}, {predicate} if inverse else set())
        targets = arcs.select(F.col("node"), F.struct(term_id(term_at("")).alias("node"), "kind", "lex", "dt", "lang").alias("t"))
        one = targets.groupBy("node").agg(F.min("t").alias("t"), F.max("t").alias("_last")).where(F.col("t.node") == F.col("_last.node"))
        return one.select("node", "t")

    def _reached(self, nodes: DataFrame, path: tuple[str, bool]) -> DataFrame:
        """Nodes and all that chains of a path lead to from them: reach doubles every round."""
        found, hop = keep(nodes), keep(self._single(path))
        while True:
            more = found.select("node").join(hop, "node").select("t.*").join(found.select("node"), "node", "left_anti").dropDuplicates(["node"])
            more = keep(more)
            if more.isEmpty():
                return found
            found = keep(found.unionByName(more))
            far = hop.select(F.col("node").alias("t_node"), F.col("t").alias("t_next"))
            hop = keep(hop.join(far, F.col("t.node") == F.col("t_node")).select("node", F.col("t_next").alias("t")))

    def _pass_on(self, label, nodes, wanted, only: set | None = None, without: set = frozenset()) -> None:
        here, there = self._references(label)
        without = set(without) | self.inline | set(self.default)
        for r in here:
            if (only is None or r in only) and r not in without:
                wanted.setdefault(r, []).append(nodes)
        for path, refs in there.items():
            refs = {r for r in refs if (only is None or r in only) and r not in without}
            if refs:
                targets = self._targets(nodes, path)
                for r in refs:
                    wanted.setdefault(r, []).append(targets)

    # evaluation

    def evaluate(self, requested: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """label -> (node, kind, lex, dt, lang, ok, reason) for every demanded pair of the labels involved."""
        known = self._demand(requested)
        true: dict[str, DataFrame] = {}
        out: dict[str, DataFrame] = {}
        for comp in self.order:  # plans only; what nobody refers to is never run
            if comp[0] in self.default:
                true[comp[0]] = self._exceptions(comp[0], true)
        for comp in self.order:
            comp = [x for x in comp if x in known]
            if not comp:
                continue
            if len(comp) == 1 and comp[0] not in self.recursive:
                label = comp[0]
                out[label] = self._label(label, known[label], true)
                if label not in self.default:
                    true[label] = out[label].where("ok").select("node")
                continue
            if comp[0] in self.chains:
                out[comp[0]] = self._by_chain(comp[0], known[comp[0]], true)
                true[comp[0]] = out[comp[0]].where("ok").select("node")
            elif comp[0] in self.sides:
                out |= self._by_sides(comp, known, true)
            else:
                out |= self._by_rounds(comp, known, true)
        self.typing = true
        return out

    def _by_sides(self, comp: list[str], known: dict, true: dict) -> dict[str, DataFrame]:
        """A stratum with negation: labels stand on two sides, and negation always crosses (the cycles are even).

        With the other side's verdicts turned round everything is monotone, so
        the verdicts of a side are those of the typing that says yes to it
        wherever nothing refutes that, and no to the other side wherever nothing
        proves it: what is asked may be assumed.  Where the other side's typing
        says otherwise, the verdict rests on its own assumption, and the reason says so.
        """
        with ThreadPoolExecutor(2) as both:  # small jobs that do not wait for each other
            views = list(both.map(lambda mine: self._alternating(comp, known, true, {x: self.sides[x] == mine for x in comp}), (0, 1)))
        out = {}
        for x in comp:
            own, other = views[self.sides[x]][x], views[1 - self.sides[x]][x].select(F.col("node").alias("_n"), F.col("ok").alias("_ok"))
            assumed = F.col("ok") & ~F.col("_ok")
            met = own.join(other, F.col("node") == F.col("_n"))
            out[x] = keep(met.select(*_NODE, "ok", F.when(assumed, "holds by assumption: nothing refutes it").otherwise(F.col("reason")).alias("reason")))
            true[x] = out[x].where("ok").select("node")
        return out

    def _alternating(self, comp: list[str], known: dict, true: dict, first: dict[str, bool]) -> dict[str, DataFrame]:
        """The fixpoint from verdicts ``first`` of all nodes; a round looks again at nodes with arcs to those whose verdict changed."""
        asks = {x: self._references(x) for x in comp}
        here_true = true | {x: known[x].select("node").where(F.lit(first[x])) for x in comp}
        results = {x: keep(self._label(x, known[x], here_true)) for x in comp}
        changed = {x: results[x].where(F.col("ok") != F.lit(first[x])).select("node") for x in comp}
        while True:
            self.rounds += 1
            changed = {x: c for x, c in changed.items() if not c.isEmpty()}
            if not changed:
                return results
            here_true = true | {x: results[x].where("ok").select("node") for x in comp}
            fresh = {}
            for x in comp:
                here, there = asks[x]
                met = [changed[r].select("node") for r in here if r in changed]
                met += [self._sources(path, changed[r]) for path, refs in there.items() for r in refs & set(changed)]
                if met:
                    again = results[x].select(*_NODE).join(reduce(DataFrame.unionByName, met).distinct(), "node", "left_semi")
                    new = self._label(x, again, here_true, narrow=True)
                    old = results[x].select(F.col("node").alias("_n"), F.col("ok").alias("_ok"))
                    fresh[x] = keep(new.join(old, F.col("node") == F.col("_n")).where("ok != _ok").drop("_n", "_ok"))
            results |= {x: keep(results[x].join(f.select("node"), "node", "left_anti").unionByName(f)) for x, f in fresh.items() if not f.isEmpty()}
            changed = {x: f.select("node") for x, f in fresh.items()}

    # evidence

    def evidence(self, label: str, result: DataFrame) -> DataFrame:
        """Which constraint of which shape every arc of a conforming node serves: (node, part, constraint, predicate, inverse, target).

        result: the label's verdicts by ``evaluate``.  part counts the shapes of
        the label, constraint the constraints of a shape, both from 0; shapes that a
        choice or a negation does not need are left out where they do not hold.
        An arc may serve in several shapes, but in one constraint of each; where
        bases share a node's arcs it serves in one base.
        """
        se, true = self.exprs[label], self.typing
        nodes = keep(result.where("ok").select(*_NODE))
        t = TermColumns(*(F.col(c) for c in _NODE[1:]))
        out = None
        for part, a in enumerate(self.atoms[label]):
            refs = {x.label for c in a.constraints if c.value is not None for x in walk_shapes(c.value) if isinstance(x, ShapeRef)}
            held = nodes
            if not (a.shape is se or isinstance(se, ShapeAnd) and any(x is a.shape for x in se.exprs)):
                for counted in self._counts([a], refs, true, nodes):
                    held = held.join(counted, "node", "left")
                held = held.where(F.coalesce(self._atom(a, t), F.lit(False))).select(*_NODE)
            one = self._served(a, self._marked(a, held, refs, true), held.select("node", _flags(a, t).alias("flags")))
            one = one.select("node", F.lit(part).alias("part"), "constraint", "p", "inverse", "target")
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.graph.spark.createDataFrame([], "node string, part int, constraint int, predicate string, inverse boolean, target string")
        return out.withColumnRenamed("p", "predicate")

    def _marked(self, a: Atom, nodes: DataFrame, refs: set[str], true: dict) -> DataFrame:
        """(node, p, inverse, target, path, mask): arcs of nodes that satisfy constraints of a shape, and which."""
        arcs = _arcs(self.graph, a.direct, a.backward).withColumn("target", term_id(term_at(""))).join(nodes.select("node"), "node", "left_semi")
        if refs - self.inline:
            arcs = _with_labels(arcs, "target", refs - self.inline, true, "_labels")
        t, p, inv = term_at(""), F.col("p"), F.col("inverse")
        mask = reduce(lambda x, y: x.bitwiseOR(y), (F.when((p == c.predicate) & (inv == F.lit(c.inverse)) & self._value(c, t), 1 << i).otherwise(0).cast("long") for i, c in enumerate(a.constraints)), F.lit(0).cast("long"))
        path = reduce(lambda x, y: F.when((p == y[1][0]) & (inv == F.lit(y[1][1])), y[0]).otherwise(x), enumerate(a.paths), F.lit(None).cast("int"))
        marked = arcs.select("node", "p", "inverse", "target", path.cast("int").alias("path"), mask.alias("mask"))
        return marked if a.dealt else marked.where("mask > 0")

    def _served(self, a: Atom, arcs: DataFrame, flags: DataFrame) -> DataFrame:
        """``arcs`` with ``constraint``: the one that each serves."""
        if not a.dealt:
            # an arc that fits one constraint serves that one; the others wait for an assignment of all the node's arcs
            one = F.bit_count("mask") == 1
            plain = arcs.where(one).select("node", "p", "inverse", "target", F.log2("mask").cast("int").alias("constraint"))
            if all(len(a.of_path(path)) == 1 for path in a.paths):
                return plain
            open_ = keep(arcs.where(~one))
            vectors = _vectors(arcs.select("node", "path", "mask").join(open_.select("node").distinct(), "node", "left_semi"))
            arcs = open_
        else:
            plain, arcs = None, keep(arcs)
            vectors = _vectors(arcs)
        vectors = keep(vectors.join(flags, "node"))

        def run(frames):
            import pandas as pd

            for pdf in frames:
                dealt = []
                for k, bits in zip(pdf["k"], pdf["flags"], strict=True):
                    rows = json.loads(k)
                    dealt.append([{"path": rows[c]["path"], "mask": rows[c]["mask"], "constraint": s, "first": first, "n": n} for c, s, first, n in a.deal(_classes(k, a.paths), int(bits)) or []])
                yield pd.DataFrame({"k": pdf["k"], "flags": pdf["flags"], "dealt": dealt})

        solved = vectors.select("k", "flags").distinct().mapInPandas(run, "k string, flags int, dealt array<struct<path: int, mask: long, constraint: int, first: long, n: long>>")
        shares = vectors.join(solved, ["k", "flags"]).select("node", F.explode("dealt").alias("d")).select("node", "d.*")
        met = _numbered(arcs).join(shares, ["node", "path", "mask"]).where("place >= first AND place < first + n")
        met = met.select("node", "p", "inverse", "target", "constraint")
        return met if plain is None else plain.unionByName(met)

    def _by_rounds(self, comp: list[str], known: dict, true: dict) -> dict[str, DataFrame]:
        """The greatest fixpoint of a stratum: what fails takes along what asks for it."""
        true |= {x: known[x].select("node") for x in comp}
        asks = {x: self._references(x) for x in comp}
        results = {x: keep(self._label(x, known[x], true)) for x in comp}
        dropped = {x: results[x].where("not ok").select("node") for x in comp}
        while True:
            self.rounds += 1
            dropped = {x: d for x, d in dropped.items() if not d.isEmpty()}
            true |= {x: results[x].where("ok").select("node") for x in comp}
            if not dropped:
                return results
            fresh = {}
            for x in comp:
                here, there = asks[x]
                met = [dropped[r].select("node") for r in here if r in dropped]
                for path, refs in there.items():
                    for r in refs & set(dropped):
                        met.append(self._sources(path, dropped[r]))
                if met:
                    again = results[x].where("ok").select(*_NODE).join(reduce(lambda a, b: a.unionByName(b), met).distinct(), "node", "left_semi")
                    fresh[x] = keep(self._label(x, again, true, narrow=True).where("not ok"))
            results |= {x: keep(results[x].join(f.select("node"), "node", "left_anti").unionByName(f)) for x, f in fresh.items() if not f.isEmpty()}
            dropped = {x: f.select("node") for x, f in fresh.items()}

    def _sources(self, path: tuple[str, bool], targets: DataFrame) -> DataFrame:
        """Nodes that a path leads from to targets."""
        predicate, inverse = path
        arcs = _arcs(self.graph, set() if inverse else {predicate}, {predicate} if inverse else set())
        return arcs.select("node", term_id(term_at("")).alias("_t")).join(targets.select(F.col("node").alias("_t")), "_t", "left_semi").select("node")

    def _by_chain(self, label: str, nodes: DataFrame, true: dict) -> DataFrame:
        """A label that asks for itself by one arc: verdicts without that arc, then failures run up the chains by pointer doubling."""
        first = keep(self._label(label, nodes, true | {label: nodes.select("node")}))
        hop = self._single(self.chains[label]).select("node", F.col("t.node").alias("next"))
        state = keep(first.join(hop, "node", "left").select("node", F.when(F.col("ok"), F.col("next")).alias("next"), (~F.col("ok")).alias("bad")))
        left = state.count()
        while left > 0 and not state.where("next is not null").isEmpty():
            self.rounds += 1
            ahead = state.select(F.col("node").alias("_n"), F.col("next").alias("_next"), F.col("bad").alias("_bad"))
            met = state.join(ahead, F.col("next") == F.col("_n"), "left")
            bad = F.col("bad") | F.coalesce("_bad", F.lit(False))
            state = keep(met.select("node", F.when(~bad, F.col("_next")).alias("next"), bad.alias("bad")))
            left //= 2  # pointers now reach past all of a shorter chain; what still points on goes in circles
        fails = state.where("bad").select("node", F.lit(True).alias("_bad"))
        done = first.join(fails, "node", "left")
        ok = F.col("ok") & F.col("_bad").isNull()
        return keep(done.select(*_NODE, ok.alias("ok"), F.when(F.col("ok") & ~ok, "leads to a node that does not conform").otherwise(F.col("reason")).alias("reason")))

    def _exceptions(self, label: str, true: dict[str, DataFrame]) -> DataFrame:
        """Nodes whose verdict differs from the default: one aggregate over the label's arcs."""
        atoms, (_, there) = self.atoms[label], self._references(label)
        first, *rest = self._counts(atoms, {r for refs in there.values() for r in refs}, true)
        for part in rest:
            first = first.join(part, "node", "left")
        ok = self._focus(self.exprs[label], None, {id(a.shape): self._atom(a) for a in atoms}, true)
        return first.where(~ok if self.default[label] else ok).select("node")

    def _conforms(self, r: str, t: TermColumns, labels: str) -> Column:
        """Whether a term conforms to a label: a predicate, or its presence among the joined labels."""
        if r in self.inline:
            return self._focus(self.exprs[r], t, {}, {})
        found = F.coalesce(F.array_contains(labels, r), F.lit(False))
        return ~found if self.default.get(r) else found

    def _label(self, label: str, nodes: DataFrame, true: dict[str, DataFrame], narrow: bool = False) -> DataFrame:
        """Verdicts for nodes; ``narrow``: they are few of those with arcs, so only their arcs are counted."""
        se, atoms = self.exprs[label], self.atoms[label]
        here, there = self._references(label)
        base = nodes
        if here - self.inline:
            base = _with_labels(base, "node", here - self.inline, true, "_here")
        counted = self._counts(atoms, {r for refs in there.values() for r in refs}, true, nodes if narrow else None, nodes)
        for part in counted:
            base = base.join(part, "node", "left")
        t = TermColumns(*(F.col(c) for c in ("kind", "lex", "dt", "lang")))
        verdicts = {id(a.shape): self._atom(a, t) for a in atoms}
        ok = self._focus(se, t, verdicts, true)
        reasons = [r for a in atoms for r in self._reasons(a, t)]
        if any(isinstance(x, NodeConstraint) for x in _same_node(se)):
            reasons.append(F.when(~ok, "node constraint"))
        reason = F.when(~ok, F.array_join(F.array_compact(F.array(*reasons)), "; ")) if reasons else F.lit(None).cast("string")
        return base.select("node", "kind", "lex", "dt", "lang", F.coalesce(ok, F.lit(False)).alias("ok"), reason.alias("reason"))

    def _focus(self, se, t: TermColumns, verdicts: dict, true: dict) -> Column:
        if isinstance(se, ShapeAnd):
            return reduce(lambda a, b: a & b, (self._focus(x, t, verdicts, true) for x in se.exprs))
        if isinstance(se, ShapeOr):
            return reduce(lambda a, b: a | b, (self._focus(x, t, verdicts, true) for x in se.exprs))
        if isinstance(se, ShapeNot):
            return ~self._focus(se.expr, t, verdicts, true)
        if isinstance(se, NodeConstraint):
            return compile_constraint(se, t)
        if isinstance(se, ShapeRef):
            return self._conforms(se.label, t, "_here")
        if isinstance(se, Shape | ShapeParts):
            acts = self.actions.holds(se.acts)
            ok = next((v for k, v in verdicts.items() if k == id(se)), F.lit(True))
            return ok if acts is None else ok & acts
        raise SchemaError(f"cannot evaluate {type(se).__name__}")

    def _value(self, c: TripleConstraint, t: TermColumns) -> Column:
        ok = F.lit(True) if c.value is None else self._value_expr(c.value, t)
        if c.negated:
            ok = ~ok
        acts = self.actions.holds(c.acts)
        return ok if acts is None else ok & acts

    def _value_expr(self, se, t: TermColumns) -> Column:
        if isinstance(se, ShapeAnd):
            return reduce(lambda a, b: a & b, (self._value_expr(x, t) for x in se.exprs))
        if isinstance(se, ShapeOr):
            return reduce(lambda a, b: a | b, (self._value_expr(x, t) for x in se.exprs))
        if isinstance(se, ShapeNot):
            return ~self._value_expr(se.expr, t)
        if isinstance(se, ShapeRef):
            return self._conforms(se.label, t, "_labels")
        return compile_constraint(se, t)

    def _counts(self, atoms: list[Atom], refs: set[str], true: dict, only: DataFrame | None = None, of: DataFrame | None = None) -> list[DataFrame]:
        """Per node: counts of every atom; and verdicts of the solver for those that need one.  of: only these nodes matter, others may be left out."""
        if not atoms:
            return []
        direct = None if any(a.shape.closed for a in atoms) else {p for a in atoms for p in a.direct}
        arcs = _arcs(self.graph, direct, {p for a in atoms for p in a.backward}, of)
        if only is not None:
            arcs = arcs.join(only.select("node"), "node", "left_semi")
        refs = refs - self.inline
        if refs:
            arcs = _with_labels(arcs.withColumn("_target", term_id(term_at(""))), "_target", refs, true, "_labels")
        t, p, inv = term_at(""), F.col("p"), F.col("inverse")
        aggs, parts_, in_line = [], [], []
        for a in atoms:
            mine = [F.when((p == c.predicate) & (inv == F.lit(c.inverse)), self._value(c, t)).otherwise(F.lit(False)) for c in a.constraints]
            mentioned = (~inv & p.isin(sorted(a.direct)) if a.direct else F.lit(False)) | (inv & p.isin(sorted(a.backward)) if a.backward else F.lit(False))
            extra = ~inv & p.isin(list(a.shape.extra)) if a.shape.extra else F.lit(False)
            taken = reduce(lambda x, y: x | y, mine, F.lit(False))
            # arcs that fit nothing may stand outside a negated condition of a base, so the solver sees them
            aggs.append((F.count_if(mentioned & ~extra & ~taken) if not a.dealt else F.lit(0).cast("long")).alias(f"{a.name}_bad"))
            if a.shape.closed:
                aggs.append(F.count_if(~inv & ~mentioned).alias(f"{a.name}_other"))
            if a.solved:
                mask = reduce(lambda x, y: x.bitwiseOR(y), (F.when(m, 1 << i).otherwise(0).cast("long") for i, m in enumerate(mine)), F.lit(0).cast("long"))
                at = reduce(lambda x, y: x.when(*y), [((p == name) & (inv == F.lit(turned)), k) for k, (name, turned) in enumerate(a.paths)][1:], F.when((p == a.paths[0][0]) & (inv == F.lit(a.paths[0][1])), 0)) if a.paths else F.lit(None)
                if classes := a.classes():  # few: counted along with the rest, in one pass and without a shuffle of their own
                    arcs = arcs.withColumn(f"{a.name}_path", F.when(mentioned, at.cast("int"))).withColumn(f"{a.name}_mask", mask)
                    aggs += [F.count_if((F.col(f"{a.name}_path") == k) & (F.col(f"{a.name}_mask") == bits)).alias(f"{a.name}_n{i}") for i, (k, bits) in enumerate(classes)]
                    in_line.append((a, classes))
                    continue
                rows = arcs.select("node", at.cast("int").alias("path"), mask.alias("mask")).where(mentioned if a.dealt else F.col("mask") > 0)
                parts_.append(_vectors(rows).select("node", self._solved(a, F.col("k")).alias(f"{a.name}_fits")))
                continue
            for path in a.paths:
                group = a.of_path(path)
                if len(group) == 1:
                    aggs.append(F.count_if(mine[group[0]]).alias(f"{a.name}_{group[0]}"))
                    continue
                for some in _subsets(group):
                    inside = reduce(lambda x, y: x | y, (mine[i] for i in some))
                    beside = reduce(lambda x, y: x | y, (mine[i] for i in group if i not in some), F.lit(False))
                    aggs += [F.count_if(inside & ~beside).alias(f"{a.name}_only{_bits(some)}"), F.count_if(inside).alias(f"{a.name}_any{_bits(some)}")]
        counted = arcs.groupBy("node").agg(*aggs)
        for a, classes in in_line:
            n = [F.col(f"{a.name}_n{i}") for i in range(len(classes))]
            rows = (F.when(x > 0, F.concat(F.lit(f'{{"path":{k},"mask":{bits},"n":'), x.cast("string"), F.lit("}"))) for x, (k, bits) in zip(n, classes, strict=True))
            counted = counted.withColumn(f"{a.name}_fits", self._solved(a, F.concat(F.lit("["), F.concat_ws(",", *rows), F.lit("]")))).drop(*(f"{a.name}_n{i}" for i in range(len(classes))))
        return [counted, *parts_]

    def _solved(self, a: Atom, k: Column) -> Column:
        """Verdicts of the solver for vectors of counts, one for each combination of conditions; a task solves equal ones once."""
        known: dict[str, list[bool]] = {}
        paths, combinations_ = a.paths, range(1 << len(a.conditions))

        def fits(ks):
            import pandas as pd

            if len(known) > KNOWN:
                known.clear()
            at, different = pd.factorize(ks)
            for x in different:
                if x not in known:
                    classes = _classes(x, paths)
                    known[x] = [a.deal(classes, flags) is not None for flags in combinations_]
            verdicts = [known[x] for x in different]
            return pd.Series([verdicts[i] for i in at], dtype="object")

        return F.pandas_udf(fits, "array<boolean>")(k)

    def _atom(self, a: Atom, t: TermColumns | None = None) -> Column:
        zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
        ok = zero(f"{a.name}_bad") == 0
        if a.shape.closed:
            ok = ok & (zero(f"{a.name}_other") == 0)
        if a.solved:
            return ok & F.get(F.coalesce(F.col(f"{a.name}_fits"), F.array(*(F.lit(a.on_nothing(flags)) for flags in range(1 << len(a.conditions))))), _flags(a, t))
        if a.plan == "FLAT":
            for path in a.paths:
                group = a.of_path(path)
                for some in _subsets(group):
                    low, high = sum(a.constraints[i].min for i in some), [a.constraints[i].max for i in some]
                    inside, touching = (zero(f"{a.name}_{group[0]}"),) * 2 if len(group) == 1 else (zero(f"{a.name}_{x}{_bits(some)}") for x in ("only", "any"))
                    if low:
                        ok = ok & (touching >= low)
                    if None not in high:
                        ok = ok & (inside <= sum(high))
            return ok
        return ok & rbe.matches_columns(a.expr, {i: zero(f"{a.name}_{i}") for i in range(len(a.constraints))})

    def _reasons(self, a: Atom, t: TermColumns) -> list[Column]:
        zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
        out = [F.when(zero(f"{a.name}_bad") > 0, "an arc satisfies no constraint of its path")]
        if a.shape.closed:
            out.append(F.when(zero(f"{a.name}_other") > 0, "closed: an arc of another predicate"))
        if a.plan == "FLAT":
            for i, c in enumerate(a.constraints):
                if len(a.of_path((c.predicate, c.inverse))) > 1:
                    continue
                n = zero(f"{a.name}_{i}")
                wrong = (n < c.min) | (n > c.max) if c.max is not None else n < c.min
                if not c.negated:
                    out.append(F.when(wrong, f"cardinality of {'^' if c.inverse else ''}{c.predicate}"))
        if a.plan != "FLAT" or len(a.paths) < len(a.constraints):
            out.append(F.when(~self._atom(a, t), "no assignment of arcs matches"))
        return out


def _vectors(arcs: DataFrame) -> DataFrame:
    """(node, k) of (node, path, mask): how many arcs of each path satisfy which set of constraints, as text."""
    counts = arcs.groupBy("node", "path", "mask").agg(F.count("*").alias("n"))
    return counts.groupBy("node").agg(F.to_json(F.array_sort(F.collect_list(F.struct("path", "mask", "n")))).alias("k"))


def _classes(k: str, paths: list) -> list[parts.Arcs]:
    """Classes of arcs of such a vector."""
    return [parts.Arcs(paths[x["path"]], tuple(i for i in range(x["mask"].bit_length()) if x["mask"] >> i & 1), x["n"], c) for c, x in enumerate(json.loads(k))]


def _flags(a: Atom, t: TermColumns) -> Column:
    """Which of the bases' conditions the node satisfies, as bits."""
    return reduce(lambda x, y: x + y, (F.when(compile_constraint(c, t), 1 << i).otherwise(0) for i, c in enumerate(a.conditions)), F.lit(0))


def _numbered(arcs: DataFrame, salts: int = 64) -> DataFrame:
    """``arcs`` with ``place``: their number from 0 within (node, path, mask).  A node's arcs are numbered in ``salts`` parts, each from where the one before ends."""
    key = ["node", "path", "mask"]
    salted = arcs.withColumn("_salt", F.pmod(F.xxhash64("target", "p"), F.lit(salts)))
    before = Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*key, "_salt").agg(F.count("*").alias("_n")).select(*key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*key, "_salt").orderBy("target", "p"))
    return salted.withColumn("_within", within).join(starts, [*key, "_salt"]).withColumn("place", F.col("_start") + F.col("_within") - 1).drop("_salt", "_within", "_start")


def _subsets(items: list[int]) -> list[tuple[int, ...]]:
    return [c for k in range(1, len(items) + 1) for c in combinations(items, k)]


def _bits(items: tuple[int, ...]) -> int:
    return sum(1 << i for i in items)


def _on_nothing(se, atoms: list[Atom]) -> bool:
    """The verdict for a node without arcs."""
    if isinstance(se, ShapeAnd):
        return all(_on_nothing(x, atoms) for x in se.exprs)
    if isinstance(se, ShapeOr):
        return any(_on_nothing(x, atoms) for x in se.exprs)
    if isinstance(se, ShapeNot):
        return not _on_nothing(se.expr, atoms)
    return all(a.on_nothing() for a in atoms if a.shape is se)


def _own_shapes(se):
    return [x for x in _same_node(se) if isinstance(x, Shape | ShapeParts)]


def _same_node(se):
    yield se
    if isinstance(se, ShapeAnd | ShapeOr):
        for x in se.exprs:
            yield from _same_node(x)
    elif isinstance(se, ShapeNot):
        yield from _same_node(se.expr)


def _arcs(graph: Graph, direct: set[str] | None, backward: set[str], of: DataFrame | None = None) -> DataFrame:
    """(node, p, inverse, kind, lex, dt, lang): arcs out of and into nodes.  of: where all predicates are asked for, what cannot have these nodes as subjects is not read."""
    out = None
    if direct is None or direct:
        source = graph if direct is not None or of is None else graph.about(of)
        out = source.triples(direct).select(F.col("s").alias("node"), "p", F.lit(False).alias("inverse"), F.col("o_kind").alias("kind"), F.col("o_lex").alias("lex"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
    if backward:
        r = resource(F.col("s"))
        back = graph.triples(backward).select(term_id(term_at()).alias("node"), "p", F.lit(True).alias("inverse"), r.kind.alias("kind"), r.lex.alias("lex"), r.dt.alias("dt"), r.lang.alias("lang"))
        out = back if out is None else out.unionByName(back)
    if out is None:
        out = graph.triples(set()).select(F.col("s").alias("node"), "p", F.lit(False).alias("inverse"), *(F.col(f"o_{x}").alias(x) for x in ("kind", "lex", "dt", "lang")))
    return out


def _with_labels(df: DataFrame, key: str, labels: set[str], true: dict[str, DataFrame], out: str) -> DataFrame:
    """Add the array of those labels that the node in ``key`` conforms to."""
    typed = None
    for r in sorted(labels):
        one = true[r].select(F.col("node").alias("_n"), F.lit(r).alias("_l"))
        typed = one if typed is None else typed.unionByName(one)
    by_node = typed.groupBy("_n").agg(F.collect_set("_l").alias(out)) if len(labels) > 1 else typed.select("_n", F.array("_l").alias(out))
    joined = df.join(by_node, df[key] == by_node["_n"], "left").drop("_n")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def _union_nodes(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("node", "kind", "lex", "dt", "lang")
    for p in parts[1:]:
        out = out.unionByName(p.select("node", "kind", "lex", "dt", "lang"))
    # an id has one such form: rows that are distinct by node already need not be moved for it
    dt = F.when(F.col("lang").isNotNull(), RDF + "langString").when(F.col("kind") == "literal", F.coalesce("dt", F.lit(XSD + "string")))
    return out.select("node", "kind", "lex", dt.alias("dt"), F.lower("lang").alias("lang")).distinct()


def validate(graph: Graph, schema: Schema, pairs: list[tuple[DataFrame, str, str]], resolver=None, actions: Actions | None = None, include_dependents: bool = False) -> DataFrame:
    """(node, shape, status, reason, as_expected) of requested pairs.

    pairs: (nodes, label, expected status); nodes have node, kind, lex, dt, lang.
    """
    v = Validator(schema, graph, resolver, actions, track=include_dependents)
    requested: dict[str, list[DataFrame]] = {}
    for nodes, label, _ in pairs:
        if label not in v.exprs:
            raise SchemaError(f"no shape {label}")
        requested.setdefault(label, []).append(nodes)
    results = v.evaluate({k: _union_nodes(x) for k, x in requested.items()})
    asked = {x for label in v.exprs for group in (v._references(label)[0], *v._references(label)[1].values()) for x in group}
    out = None
    for nodes, label, expected in pairs:
        r = results[label]
        if len(requested[label]) > 1 or label in asked:
            r = r.join(nodes.select("node"), "node", "left_semi")
        status = F.when(F.col("ok"), CONFORMANT).otherwise(NONCONFORMANT)
        one = r.select("node", F.lit(label).alias("shape"), status.alias("status"), "reason", (status == expected).alias("as_expected"))
        out = one if out is None else out.unionByName(one)
    if include_dependents:
        for label, r in results.items():
            if label not in requested and not label.startswith(("own:", "nested:")):
                out = out.unionByName(r.where("ok").select("node", F.lit(label).alias("shape"), F.lit(CONFORMANT).alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("as_expected")))
    return out


def evidence(graph: Graph, schema: Schema, pairs: list[tuple[DataFrame, str]], resolver=None, actions: Actions | None = None) -> DataFrame:
    """Why requested nodes conform: (node, shape, part, constraint, predicate, inverse, target), one row per arc and shape that it serves in.

    pairs: (nodes, label); see ``Validator.evidence``.
    """
    v = Validator(schema, graph, resolver, actions, track=True)
    requested: dict[str, list[DataFrame]] = {}
    for nodes, label in pairs:
        if label not in v.exprs:
            raise SchemaError(f"no shape {label}")
        requested.setdefault(label, []).append(nodes)
    asked = {k: _union_nodes(x) for k, x in requested.items()}
    results = v.evaluate(asked)
    return reduce(DataFrame.unionByName, [v.evidence(label, results[label].join(nodes.select("node"), "node", "left_semi")).withColumn("shape", F.lit(label)) for label, nodes in asked.items()])
