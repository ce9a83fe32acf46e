"""Schema analysis on the driver: references, signs, strata, inheritance, comparison."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import replace
from decimal import Decimal

from .ast import (
    START,
    Declaration,
    EachOf,
    Inclusion,
    Literal,
    NodeConstraint,
    OneOf,
    Schema,
    SchemaError,
    Shape,
    ShapeAnd,
    ShapeExternal,
    ShapeNot,
    ShapeOr,
    ShapeParts,
    ShapeRef,
    TripleConstraint,
    triple_map,
    walk_shapes,
    walk_triples,
)

# signed dependencies ---------------------------------------------------------


def dependencies(schema: Schema) -> dict[str, set[tuple[str, int]]]:
    """label -> {(label, +1 or -1)}: NOT, cardinality {0}, negated constraints and EXTRA change the sign."""
    table = triple_map(schema)
    out: dict[str, set[tuple[str, int]]] = {d.label: set() for d in schema.shapes}

    def shape(se, sign: int, edges: set, seen: frozenset) -> None:
        if isinstance(se, ShapeRef):
            edges.add((se.label, sign))
        elif isinstance(se, ShapeAnd | ShapeOr):
            for x in se.exprs:
                shape(x, sign, edges, seen)
        elif isinstance(se, ShapeNot):
            shape(se.expr, -sign, edges, seen)
        elif isinstance(se, ShapeParts):
            for x in (*se.bases, se.own):
                shape(x, sign, edges, seen)
        elif isinstance(se, Shape):
            for b in se.extends:
                edges.add((b, sign))
            triple(se.expression, sign, edges, set(se.extra), seen)

    def triple(te, sign: int, edges: set, extra: set, seen: frozenset) -> None:
        if isinstance(te, EachOf | OneOf):
            for x in te.exprs:
                triple(x, sign, edges, extra, seen)
        elif isinstance(te, Inclusion):
            if te.label not in table:
                raise SchemaError(f"no triple expression {te.label}")
            if te.label in seen:
                raise SchemaError(f"triple expression {te.label} includes itself")
            triple(table[te.label], sign, edges, extra, seen | {te.label})
        elif isinstance(te, TripleConstraint) and te.value is not None:
            flips = te.negated or te.max == 0
            shape(te.value, -sign if flips else sign, edges, seen)
            if te.predicate in extra:
                shape(te.value, -sign, edges, seen)

    for d in schema.shapes:
        shape(d.expr, 1, out[d.label], frozenset())
    if schema.start is not None:
        out[START] = set()
        shape(schema.start, 1, out[START], frozenset())
    return out


def strongly_connected(graph: dict[str, set[str]]) -> list[list[str]]:
    """Components, dependencies first (Tarjan, without recursion)."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in graph:
        if root in index:
            continue
        work = [(root, iter(sorted(graph.get(root, ()))))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in graph:
                    continue
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(sorted(graph[w]))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        comp.append(w)
                        if w == v:
                            break
                    out.append(sorted(comp))
    return out


def strata(schema: Schema) -> list[list[str]]:
    deps = dependencies(schema)
    return strongly_connected({k: {t for t, _ in v} for k, v in deps.items()})


def negative_cycles(deps: dict[str, set[tuple[str, int]]]) -> list[list[str]]:
    """Components that hold a negative edge inside."""
    comps = strongly_connected({k: {t for t, _ in v} for k, v in deps.items()})
    where = {v: i for i, c in enumerate(comps) for v in c}
    bad = {where[a] for a, es in deps.items() for b, s in es if s < 0 and where.get(b) == where[a]}
    return [comps[i] for i in sorted(bad)]


def odd_negative_cycles(deps: dict[str, set[tuple[str, int]]]) -> list[list[str]]:
    """Components with a cycle of an odd number of negative edges: a vertex that reaches its own negation."""
    comps = strongly_connected({(v, s): {(t, s * g) for t, g in es} for v, es in deps.items() for s in (1, -1)})  # type: ignore[misc]
    found = {v for c in comps for v, s in c if (v, -s) in c}
    where = strongly_connected({k: {t for t, _ in v} for k, v in deps.items()})
    return [c for c in where if found & set(c)]


def sides(deps: dict[str, set[tuple[str, int]]]) -> dict[str, int]:
    """Side 0 or 1 of every label in a component with negation inside, such that negation crosses; only where all its cycles are even."""
    odd = {v for c in odd_negative_cycles(deps) for v in c}
    out: dict[str, int] = {}
    for comp in negative_cycles(deps):
        if odd & set(comp):
            continue
        todo = [comp[0]]
        out[comp[0]] = 0
        while todo:
            v = todo.pop()
            for t, sign in deps[v]:
                if t in comp and t not in out:
                    out[t] = out[v] if sign > 0 else 1 - out[v]
                    todo.append(t)
    return out


def isomorphic(a: dict[str, set[tuple[str, int]]], b: dict[str, set[tuple[str, int]]]) -> dict[str, str] | None:
    """A renaming of labels that makes two signed dependency graphs equal, or None.  Labels are matched by their edges' signs first."""

    def sides(g):
        back: dict[str, list[int]] = {v: [] for v in g}
        for edges in g.values():
            for t, sign in edges:
                back.setdefault(t, []).append(sign)
        return {v: (tuple(sorted(sign for _, sign in g.get(v, ()))), tuple(sorted(back[v])), (v, 1) in g.get(v, ()), (v, -1) in g.get(v, ())) for v in back}

    left, right = sides(a), sides(b)
    if sorted(left.values()) != sorted(right.values()):
        return None
    order = sorted(left, key=lambda v: (sum(w == left[v] for w in right.values()), v))

    def extend(i: int, names: dict[str, str]) -> dict[str, str] | None:
        if i == len(order):
            return names
        v = order[i]
        for w in sorted(right):
            if right[w] != left[v] or w in names.values():
                continue
            more = names | {v: w}
            fits = all(((more[t], s) in b.get(more[u], ())) == ((t, s) in a.get(u, ())) for u in more for t in more for s in (1, -1) if v in (u, t))
            if fits and (done := extend(i + 1, more)) is not None:
                return done
        return None

    return extend(0, {})


def references(schema: Schema) -> set[str]:
    """Every shape label that the schema mentions."""
    exprs = [d.expr for d in schema.shapes] + ([schema.start] if schema.start is not None else [])
    out = set()
    for e in exprs:
        for se in walk_shapes(e):
            if isinstance(se, ShapeRef):
                out.add(se.label)
            elif isinstance(se, Shape):
                out |= set(se.extends) | set(se.restricts)
    return out


def problems(schema: Schema) -> list[str]:
    """Why a schema is not well formed; empty if it is."""
    known = set(schema.labels) | ({START} if schema.start is not None else set())
    out = [f"no shape {r}" for r in sorted(references(schema) - known)]
    table = triple_map(schema)
    for d in schema.shapes:
        for se in walk_shapes(d.expr):
            if isinstance(se, Shape):
                out += [f"no triple expression {t.label}" for t in walk_triples(se.expression) if isinstance(t, Inclusion) and t.label not in table]
    out += [f"{x} is a shape and a triple expression" for x in sorted(set(table) & set(schema.labels))]
    if out:
        return out
    try:
        deps = dependencies(schema)
    except SchemaError as e:
        return [str(e)]
    out += [f"an odd number of negations through the cycle {', '.join(c)}" for c in odd_negative_cycles(deps)]
    graph = {d.label: {b for se in walk_shapes(d.expr) if isinstance(se, Shape) for b in se.extends} for d in schema.shapes}
    out += [f"extension through the cycle {', '.join(c)}" for c in strongly_connected(graph) if len(c) > 1 or c[0] in graph[c[0]]]
    return out


# inheritance -----------------------------------------------------------------


def inheritance(schema: Schema) -> dict[str, set[tuple[str, str]]]:
    """label -> {(kind, target)}; kinds extends, restricts, references."""
    out: dict[str, set[tuple[str, str]]] = {d.label: set() for d in schema.shapes}
    for d in schema.shapes:
        for se in same_node(d.expr):
            if isinstance(se, Shape):
                out[d.label] |= {("extends", b) for b in se.extends} | {("restricts", b) for b in se.restricts}
            elif isinstance(se, ShapeRef):
                out[d.label].add(("references", se.label))
    return out


def same_node(se):
    """Sub-expressions about the same node."""
    yield se
    if isinstance(se, ShapeAnd | ShapeOr):
        for x in se.exprs:
            yield from same_node(x)
    elif isinstance(se, ShapeNot):
        yield from same_node(se.expr)


def _closure(edges: dict[str, set[str]], label: str) -> set[str]:
    out, todo = set(), [label]
    while todo:
        for t in edges.get(todo.pop(), ()):
            if t not in out:
                out.add(t)
                todo.append(t)
    return out


def ancestors(schema: Schema, label: str, kinds=("extends",)) -> set[str]:
    return _closure({k: {t for kind, t in v if kind in kinds} for k, v in inheritance(schema).items()}, label)


def descendants(schema: Schema, label: str, kinds=("extends",)) -> set[str]:
    back: dict[str, set[str]] = defaultdict(set)
    for k, v in inheritance(schema).items():
        for kind, t in v:
            if kind in kinds:
                back[t].add(k)
    return _closure(back, label) - {label}


def paths(schema: Schema, label: str) -> set[tuple[str, bool]]:
    """(predicate, inverse) of a shape and everything it extends."""
    table, out = triple_map(schema), set()

    def triple(te, seen):
        for t in walk_triples(te):
            if isinstance(t, TripleConstraint):
                out.add((t.predicate, t.inverse))
            elif isinstance(t, Inclusion) and t.label not in seen:
                triple(table[t.label], seen | {t.label})

    for name in {label, *ancestors(schema, label)}:
        for se in same_node(schema.shape(name).expr):
            if isinstance(se, Shape):
                triple(se.expression, frozenset())
    return out


# rewriting -------------------------------------------------------------------


def own_label(label: str) -> str:
    return f"own:{label}"


def _main_shape(se) -> tuple[Shape, list]:
    """The shape of a base and the further conditions that stand beside it."""
    if isinstance(se, Shape):
        return se, []
    if isinstance(se, ShapeAnd):
        shapes = [e for e in se.exprs if isinstance(e, Shape)]
        if shapes:
            rest = list(se.exprs)
            rest.remove(shapes[0])
            return shapes[0], rest
    if isinstance(se, NodeConstraint):
        return Shape(), [se]
    raise SchemaError("a base has to be a shape, or a conjunction with one")


def _extended(schema: Schema, shape: Shape, trail: tuple) -> tuple[Shape, list]:
    """A shape with its bases' expressions beside its own; and the bases' further conditions."""
    if not shape.extends:
        return shape, []
    parts, rest, extra, closed = [], [], list(shape.extra), shape.closed
    for b in shape.extends:
        if b in trail:
            raise SchemaError(f"shape {b} extends itself")
        base, conditions = _main_shape(schema.shape(b).expr)
        base, more = _extended(schema, base, (*trail, b))
        if base.expression is not None:
            parts.append(base.expression)
        rest += conditions + more
        extra += base.extra
        closed = closed or base.closed
    if shape.expression is not None:
        parts.append(shape.expression)
    expr = None if not parts else parts[0] if len(parts) == 1 else EachOf(tuple(parts))
    return replace(shape, expression=expr, closed=closed, extra=tuple(dict.fromkeys(extra)), extends=(), restricts=()), rest


def _has_conditions(schema: Schema, label: str, trail: tuple) -> bool:
    """Whether a base, or what it extends, has conditions on arcs beside its shape."""
    if label in trail:
        raise SchemaError(f"shape {label} extends itself")
    se = schema.shape(label).expr
    if isinstance(se, Shape):
        return any(_has_conditions(schema, b, (*trail, label)) for b in se.extends)
    shapes = [x for x in (se.exprs if isinstance(se, ShapeAnd) else [se]) if not isinstance(x, NodeConstraint)]
    if len(shapes) == 1 and isinstance(shapes[0], Shape):
        return any(_has_conditions(schema, b, (*trail, label)) for b in shapes[0].extends)
    return bool(shapes)


def _inlined(schema: Schema, se, trail: tuple):
    """A base with references of the same node replaced by what they refer to, since they hold on its part too."""
    if isinstance(se, ShapeAnd | ShapeOr):
        return type(se)(tuple(_inlined(schema, x, trail) for x in se.exprs))
    if isinstance(se, ShapeNot):
        return ShapeNot(_inlined(schema, se.expr, trail))
    if isinstance(se, ShapeRef):
        if se.label in trail:
            raise SchemaError(f"shape {se.label} refers to itself outside of arcs")
        return _inlined(schema, schema.shape(se.label).expr, (*trail, se.label))
    return se


def _lifted(se):
    """A base's conditions on its part (None: none), and those on the node as such."""
    if isinstance(se, NodeConstraint):
        return None, [se]
    if isinstance(se, ShapeAnd):
        parts = [_lifted(x) for x in se.exprs]
        kept = tuple(k for k, _ in parts if k is not None)
        return (None if not kept else kept[0] if len(kept) == 1 else ShapeAnd(kept)), [n for _, ns in parts for n in ns]
    return se, []


def flatten(schema: Schema, resolver=None) -> Schema:
    """Equivalent schema without extends, abstract, external and inclusion: what the planner compiles.

    A label with descendants becomes the choice of its own conditions (unless
    abstract) and of the descendants; abstract labels without any fail.
    """
    table = triple_map(schema)

    def shape(se, label, trail=()):
        if isinstance(se, ShapeAnd | ShapeOr):
            return type(se)(tuple(shape(x, label, trail) for x in se.exprs))
        if isinstance(se, ShapeNot):
            return ShapeNot(shape(se.expr, label, trail))
        if isinstance(se, ShapeExternal):
            found = resolver(label) if resolver else None
            if found is None:
                raise SchemaError(f"external shape {label} is not resolved")
            return shape(found, label, trail)
        if isinstance(se, Shape):
            if any(_has_conditions(schema, b, trail) for b in se.extends):
                return _over_parts(se, label, trail)
            merged, rest = _extended(schema, se, trail)
            merged = replace(merged, expression=triple(merged.expression, label, frozenset()))
            return ShapeAnd((merged, *(shape(x, label, trail) for x in rest))) if rest else merged
        return se

    def _over_parts(se, label, trail):
        bases, beside = [], []
        for b in se.extends:
            if b in trail:
                raise SchemaError(f"shape {b} extends itself")
            kept, node = _lifted(shape(_inlined(schema, schema.shape(b).expr, (b,)), label, (*trail, b)))
            bases += [] if kept is None else [kept]
            beside += node
        own = shape(replace(se, extends=(), restricts=()), label, trail)
        parts = ShapeParts(tuple(bases), own)
        return ShapeAnd((parts, *beside)) if beside else parts

    def triple(te, label, seen):
        if isinstance(te, EachOf | OneOf):
            return replace(te, exprs=tuple(triple(x, label, seen) for x in te.exprs))
        if isinstance(te, Inclusion):
            if te.label in seen or te.label not in table:
                raise SchemaError(f"cannot include {te.label}")
            return triple(table[te.label], label, seen | {te.label})
        if isinstance(te, TripleConstraint) and te.value is not None:
            return replace(te, value=shape(te.value, label))
        return te

    out = []
    for d in schema.shapes:
        below = sorted(descendants(schema, d.label))
        own = shape(d.expr, d.label, (d.label,))
        if not below and not d.abstract:
            out.append(Declaration(d.label, own))
            continue
        choices = [ShapeRef(own_label(x) if descendants(schema, x) else x) for x in below if not schema.shape(x).abstract]
        if descendants(schema, d.label):
            out.append(Declaration(own_label(d.label), own))
        if not d.abstract:
            choices.insert(0, ShapeRef(own_label(d.label)))
        out.append(Declaration(d.label, ShapeOr(tuple(choices)) if choices else NodeConstraint(values=())))
    start = shape(schema.start, START) if schema.start is not None else None
    return replace(schema, shapes=tuple(out), start=start)


# comparison ------------------------------------------------------------------


def _normal(x):
    if isinstance(x, Literal) and x.dt.rsplit("#")[-1] in ("integer", "decimal", "double"):
        try:
            return ("number", Decimal(x.lex))
        except ArithmeticError:
            return x
    if isinstance(x, NodeConstraint):
        return ("nc", x.kind, x.datatype, frozenset(tuple(_normal(p) for p in f) for f in x.facets), None if x.values is None else tuple(map(_normal_value, x.values)))
    if isinstance(x, tuple):
        return tuple(_normal(y) for y in x)
    if hasattr(x, "__dataclass_fields__"):
        return (type(x).__name__, *(_normal(getattr(x, f)) for f in x.__dataclass_fields__))
    return x


def _normal_value(v):
    if isinstance(v, Literal) and v.lang:
        return ("lang", v.lex, v.lang.lower())
    return v


def same_schema(a: Schema, b: Schema) -> bool:
    """Equal shapes, start, actions and imports; the order of shapes, prefixes and the form of numbers do not matter."""
    view = lambda s: (frozenset((d.label, d.abstract, _normal(d.expr)) for d in s.shapes), _normal(s.start), s.start_acts, s.imports)
    return view(a) == view(b)


def difference(a: Schema, b: Schema) -> list[str]:
    """Where two schemas differ: prefixes, base, start, start actions, and shapes by label."""
    out = [f"prefix {p}: {a.prefixes.get(p)} / {b.prefixes.get(p)}" for p in sorted(set(a.prefixes) | set(b.prefixes)) if a.prefixes.get(p) != b.prefixes.get(p)]
    for name in ("base", "start", "start_acts"):
        if _normal(getattr(a, name)) != _normal(getattr(b, name)):
            out.append(name)
    x, y = ({d.label: _normal(d.expr) for d in s.shapes} for s in (a, b))
    return out + [f"shape {k}" for k in sorted(set(x) | set(y)) if x.get(k) != y.get(k)]
