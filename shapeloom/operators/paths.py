"""Property paths: from and to which nodes a path leads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import resource, term_at, term_id
from ..plans.storage import keep
from ..sources.graph import Graph

END = ("node", "kind", "lex", "dt", "lang")


@dataclass(frozen=True)
class Step:
    predicate: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    paths: tuple


@dataclass(frozen=True)
class Alternative:
    paths: tuple


@dataclass(frozen=True)
class Closure:
    """One or more; with ``zero`` none, too."""

    path: object
    zero: bool = False


@dataclass(frozen=True)
class Maybe:
    path: object


def predicates(path) -> set[str]:
    if isinstance(path, Step):
        return {path.predicate}
    if isinstance(path, Sequence | Alternative):
        return set().union(*(predicates(p) for p in path.paths))
    return predicates(path.path)


def _identity(graph: Graph) -> DataFrame:
    """Every node of the graph with itself."""
    t = graph.triples()
    s, o = resource(F.col("s")), term_at()
    ends = t.select(F.col("s").alias("node"), s.kind.alias("kind"), s.lex.alias("lex"), s.dt.alias("dt"), s.lang.alias("lang"))
    objects = t.select(term_id(o).alias("node"), o.kind.alias("kind"), o.lex.alias("lex"), o.dt.alias("dt"), o.lang.alias("lang"))
    return ends.unionByName(objects).dropDuplicates(["node"]).select(F.col("node").alias("start"), *END)


def pairs(graph: Graph, path, starts: DataFrame | None = None) -> DataFrame:
    """(start, node, kind, lex, dt, lang): which node a path leads to from each start.

    starts: a table of ``start`` ids that bounds the search, where there is one;
    closures then grow from those alone.
    """
    if isinstance(path, Step):
        o = term_at()
        out = graph.triples({path.predicate}).select(F.col("s").alias("start"), term_id(o).alias("node"), o.kind.alias("kind"), o.lex.alias("lex"), o.dt.alias("dt"), o.lang.alias("lang"))
        return out if starts is None else out.join(starts, "start", "left_semi")
    if isinstance(path, Inverse):
        if isinstance(path.path, Inverse):
            return pairs(graph, path.path.path, starts)
        if isinstance(path.path, Step):
            s = resource(F.col("s"))
            out = graph.triples({path.path.predicate}).select(term_id(term_at()).alias("start"), F.col("s").alias("node"), s.kind.alias("kind"), s.lex.alias("lex"), s.dt.alias("dt"), s.lang.alias("lang"))
            return out if starts is None else out.join(starts, "start", "left_semi")
        return pairs(graph, _turned(path.path), starts)
    if isinstance(path, Sequence):
        out = pairs(graph, path.paths[0], starts)
        for p in path.paths[1:]:
            via = out.select("start", F.col("node").alias("_via"))
            then = pairs(graph, p, via.select(F.col("_via").alias("start")).distinct() if isinstance(p, Closure) else None)
            out = via.join(then.withColumnRenamed("start", "_via"), "_via").select("start", *END).dropDuplicates(["start", "node"])
        return out
    if isinstance(path, Alternative):
        out = pairs(graph, path.paths[0], starts)
        for p in path.paths[1:]:
            out = out.unionByName(pairs(graph, p, starts))
        return out.dropDuplicates(["start", "node"])
    if isinstance(path, Maybe):
        same = _identity(graph)
        same = same if starts is None else same.join(starts, "start", "left_semi")
        return same.unionByName(pairs(graph, path.path, starts)).dropDuplicates(["start", "node"])
    one = keep(pairs(graph, path.path).dropDuplicates(["start", "node"]))
    edges = one.withColumnRenamed("start", "_via")
    found = keep(one if starts is None else one.join(starts, "start", "left_semi"))
    fresh, rounds = found, 0
    while not fresh.isEmpty():  # semi-naive: only what the last round added grows
        rounds += 1
        grown = fresh.select("start", F.col("node").alias("_via")).join(edges, "_via").select("start", *END).dropDuplicates(["start", "node"])
        fresh = keep(grown.join(found.select("start", "node"), ["start", "node"], "left_anti"))
        found = found.unionByName(fresh)  # written parts; put together now and then, as plans grow with them
        found = keep(found) if rounds % 16 == 0 else found
    if path.zero:
        same = _identity(graph)
        same = same if starts is None else same.join(starts, "start", "left_semi")
        found = found.unionByName(same).dropDuplicates(["start", "node"])
    return found


def ends(graph: Graph, path) -> DataFrame:
    """Distinct nodes (node, kind, lex, dt, lang) from which a path leads anywhere.  No pairs are made where a closure stands alone or last."""
    if isinstance(path, Step):
        s = resource(F.col("s"))
        return graph.triples({path.predicate}).select(F.col("s").alias("node"), s.kind.alias("kind"), s.lex.alias("lex"), s.dt.alias("dt"), s.lang.alias("lang")).dropDuplicates(["node"])
    if isinstance(path, Inverse):
        if isinstance(path.path, Step):
            o = term_at()
            return graph.triples({path.path.predicate}).select(term_id(o).alias("node"), o.kind.alias("kind"), o.lex.alias("lex"), o.dt.alias("dt"), o.lang.alias("lang")).dropDuplicates(["node"])
        return ends(graph, _turned(path.path))
    if isinstance(path, Alternative):
        out = ends(graph, path.paths[0])
        for p in path.paths[1:]:
            out = out.unionByName(ends(graph, p))
        return out.dropDuplicates(["node"])
    if isinstance(path, Sequence):
        first, *rest = path.paths
        inner = ends(graph, Sequence(tuple(rest))) if len(rest) > 1 else ends(graph, rest[0])
        return pairs(graph, _turned(first), inner.select(F.col("node").alias("start"))).select(*END).dropDuplicates(["node"])
    if isinstance(path, Maybe) or path.zero:
        return _identity(graph).select(*END)
    return ends(graph, path.path)


def _turned(path):
    """A path read backwards, inverses pushed down to single steps."""
    if isinstance(path, Step):
        return Inverse(path)
    if isinstance(path, Inverse):
        return path.path
    if isinstance(path, Sequence):
        return Sequence(tuple(_turned(p) for p in reversed(path.paths)))
    if isinstance(path, Alternative):
        return Alternative(tuple(_turned(p) for p in path.paths))
    if isinstance(path, Closure):
        return Closure(_turned(path.path), path.zero)
    return Maybe(_turned(path.path))
