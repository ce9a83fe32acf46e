"""Graphs up to the names of their blank nodes.

Blank nodes take colours from the arcs around them, refined round by round: a
colour is a hash of the multiset of (direction, predicate, other end), where the
other end is a term or a colour; a round is one aggregate over the arcs that
touch blank nodes.  It ends when no colour splits any more.  Parts of a graph
that hang together by blank nodes (``components``) are compared as wholes, so
equal parts may stand for each other.  Where nodes of one part still share a
colour, one of them is marked and its part refined again, and of all choices the
least result counts; this is done part by part in tasks, small parts in
batches, for parts of up to ``MOST`` arcs (larger ones with ties raise).

Colours are 128 bits, so different parts are told apart but for a chance of
about 2**-100 for a billion of them.

Defined results: repeated triples count once; a graph without blank nodes is its
own form; an empty graph equals an empty graph only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import term_at, term_id
from ..plans.storage import keep
from .reach import undirected

MOST = 100_000
#: Arcs of parts that are handed over in batches.
SMALL = 16


def _arcs(triples: DataFrame) -> DataFrame:
    """(node, dir, p, other, blank): arcs of blank nodes in both directions; other is an id, blank whether it is a blank node."""
    t = triples.select("s", "p", term_id(term_at()).alias("o"), (F.col("o_kind") == "bnode").alias("ob"), F.col("s").startswith("_:").alias("sb")).distinct()
    out = t.where("sb").select(F.col("s").alias("node"), F.lit("out").alias("dir"), "p", F.col("o").alias("other"), F.col("ob").alias("blank"))
    return keep(out.unionByName(t.where("ob").select(F.col("o").alias("node"), F.lit("in").alias("dir"), "p", F.col("s").alias("other"), F.col("sb").alias("blank"))))


def _sum(*parts: Column) -> Column:
    """A hash of a multiset of rows: two sums, so that order does not matter."""
    one = lambda seed: F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)"))
    return F.md5(F.concat_ws(",", one(1).cast("string"), one(2).cast("string"), F.count("*").cast("string")))


def colours(triples: DataFrame) -> DataFrame:
    """(node, component, colour) of blank nodes, stable under refinement.

    Every part is refined for as many rounds as it takes to settle by itself, so
    equal parts of different graphs have equal colours.
    """
    arcs = _arcs(triples)
    parts = undirected(arcs.where("dir = 'out' AND blank").select(F.col("node").alias("start"), F.col("other").alias("node")))
    nodes = arcs.select("node").distinct().join(parts, "node", "left")
    active = keep(nodes.select("node", F.coalesce("component", "node").alias("component"), F.lit("").alias("colour"), F.lit(1).cast("long").alias("n")))
    done = active.where("false").drop("n")
    while not active.isEmpty():
        far = active.select(F.col("node").alias("other"), F.col("colour").alias("_c"))
        met = arcs.join(active.select("node"), "node", "left_semi").join(far, "other", "left")
        ends = met.select("node", "dir", "p", "blank", F.when(F.col("blank"), F.col("_c")).otherwise(F.col("other")).alias("end"))
        fresh = ends.groupBy("node").agg(_sum(F.col("dir"), F.col("p"), F.col("blank"), F.col("end")).alias("_new"))
        # the colour before is part of the new one, so classes only split
        known = keep(active.join(fresh, "node").select("node", "component", F.md5(F.concat("colour", F.lit("|"), "_new")).alias("colour"), F.col("n").alias("_before")))
        counts = known.groupBy("component").agg(F.count_distinct("colour").alias("n"))
        met = keep(known.join(counts, "component"))
        done = done.unionByName(met.where("n <= _before").select("node", "component", "colour"))
        active = met.where("n > _before").select("node", "component", "colour", "n")
    return keep(done)


def labels(triples: DataFrame) -> DataFrame:
    """(node, label, part): a label of every blank node that does not depend on names, and the form of the part of the graph that it is in.

    Nodes that a renaming of the graph onto itself exchanges may have the same label.
    """
    triples = keep(triples)
    nodes = colours(triples)
    t = triples.select("s", "p", term_id(term_at()).alias("o"), (F.col("o_kind") == "bnode").alias("ob"), F.col("s").startswith("_:").alias("sb")).distinct()
    by_s = nodes.select(F.col("node").alias("s"), F.col("colour").alias("cs"), F.col("component").alias("ks"))
    by_o = nodes.select(F.col("node").alias("o"), F.col("colour").alias("co"), F.col("component").alias("ko"))
    mine = keep(t.where("sb OR ob").join(by_s, "s", "left").join(by_o, "o", "left").withColumn("component", F.coalesce("ks", "ko")))
    ends = (F.coalesce("cs", "s"), F.col("p"), F.coalesce("co", "o"), F.col("sb"), F.col("ob"))
    tied = keep(nodes.groupBy("component", "colour").agg(F.count("*").alias("n")).where("n > 1").select("component").distinct())
    plain = mine.join(tied, "component", "left_anti").groupBy("component").agg(_sum(*ends).alias("part"))
    done = nodes.join(plain, "component").select("node", F.col("colour").alias("label"), "part")
    if tied.isEmpty():
        return done
    sizes = keep(mine.join(tied, "component", "left_semi").groupBy("component").agg(F.count("*").alias("n")))
    if not sizes.where(F.col("n") > MOST).isEmpty():
        raise ValueError(f"a part of more than {MOST} arcs holds blank nodes that look alike")
    # a small part is a row, so a task's parts come in batches; only a larger one gets a frame of its own
    small, large = (mine.join(sizes.where(F.col("n") <= SMALL if few else F.col("n") > SMALL), "component", "left_semi") for few in (True, False))
    rows = small.groupBy("component").agg(F.collect_list(F.struct("s", "p", "o", "sb", "ob", "cs", "co")).alias("arcs"))
    done = done.unionByName(rows.select(F.explode(_solve()("arcs")).alias("r")).select("r.*"))
    if sizes.where(F.col("n") > SMALL).isEmpty():
        return done
    return done.unionByName(large.groupBy("component").applyInPandas(_frame, "node string, label string, part string"))


def _frame(pdf):
    """Labels of one part, as a frame."""
    import pandas as pd

    return pd.DataFrame(_part(pdf.to_dict("records")), columns=["node", "label", "part"])


def _solve():
    """A function from the arcs of parts with ties to the labels of their nodes: every choice of a marked node is tried, and the least form counts."""

    def solve(parts):
        import pandas as pd

        return pd.Series([_part(arcs) for arcs in parts], dtype="object")

    return F.pandas_udf(solve, "array<struct<node: string, label: string, part: string>>")


def _part(rows) -> list[dict]:
    """Labels of one part with ties."""
    arcs, first = [], {}
    for r in rows:
        s, p, o, sb, ob, c, d = (r[x] for x in ("s", "p", "o", "sb", "ob", "cs", "co"))
        arcs.append((s, p, o, sb, ob))
        first |= ({s: c} if isinstance(c, str) else {}) | ({o: d} if isinstance(d, str) else {})
    form, names = least_form(arcs, first)
    return [{"node": n, "label": c, "part": form} for n, c in names.items()]


def _hash(x) -> str:
    return hashlib.md5(repr(x).encode()).hexdigest()


def refine(arcs: list, names: dict) -> dict:
    n = len(set(names.values()))
    while True:
        around: dict = {b: [] for b in names}
        for s, p, o, sb, ob in arcs:
            if sb:
                around[s].append(("out", p, names[o] if ob else o, bool(ob)))
            if ob:
                around[o].append(("in", p, names[s] if sb else s, bool(sb)))
        new = {b: _hash((names[b], sorted(around[b]))) for b in names}
        now = len(set(new.values()))
        if now == n:
            return names
        names, n = new, now


def least_form(arcs: list, names: dict) -> tuple[str, dict]:
    """The least form over all choices, and its names.  Choices that lead to equal forms are interchangeable: of those one is followed."""
    names = refine(arcs, names)
    classes: dict = {}
    for b, c in names.items():
        classes.setdefault(c, []).append(b)
    ties = sorted((len(v), c) for c, v in classes.items() if len(v) > 1)
    form = lambda names: _hash(sorted((names[s] if sb else s, p, names[o] if ob else o, bool(sb), bool(ob)) for s, p, o, sb, ob in arcs))
    if not ties:
        return form(names), names
    best = None
    tried = set()
    for b in sorted(classes[ties[0][1]]):
        marked = refine(arcs, {**names, b: _hash(("marked", names[b]))})
        key = form(marked)
        if key in tried:
            continue
        tried.add(key)
        got = least_form(arcs, marked)
        if best is None or got[0] < best[0]:
            best = got
    return best


def form(triples: DataFrame) -> tuple:
    """What two graphs have in common exactly if they are equal up to the names of blank nodes: hashes of the rest and of the multiset of parts."""
    triples = keep(triples)
    ground = triples.where("NOT startswith(s, '_:') AND o_kind != 'bnode'").distinct()
    rest = ground.agg(_sum(*(F.coalesce(c, F.lit("")) for c in ("s", "p", "o_kind", "o_lex", "o_dt", "o_lang"))).alias("h")).first()["h"]
    t = labels(triples)
    parts = t.groupBy("part").agg(F.count("*").alias("n")).agg(_sum(F.col("part"), F.col("n")).alias("h")).first()["h"]
    return rest, parts


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    """Whether two triples tables are equal up to the names of blank nodes."""
    return form(a) == form(b)


def compare_results(a: DataFrame, b: DataFrame, labels_a: DataFrame, labels_b: DataFrame) -> DataFrame:
    """Where two result maps differ up to the names of blank nodes: (node, shape, status, in_a, in_b) with how many there are; a blank node is shown by label and part."""

    def counted(result, known, name):
        named = result.join(known.select("node", F.concat(F.lit("_:"), "label", F.lit("/"), "part").alias("_l")), "node", "left")
        return named.groupBy(F.coalesce("_l", "node").alias("node"), "shape", "status").agg(F.count("*").alias(name))

    both = counted(a, labels_a, "in_a").join(counted(b, labels_b, "in_b"), ["node", "shape", "status"], "full")
    return both.select("node", "shape", "status", F.coalesce("in_a", F.lit(0)).alias("in_a"), F.coalesce("in_b", F.lit(0)).alias("in_b")).where("in_a != in_b")
