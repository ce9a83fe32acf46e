"""Reachability without a table of all pairs.

Where every node has one arc out at most (or one in), a closure needs no pairs:
pointers double, so paths of n arcs take log n rounds of one self-join each.

* One arc out: the nodes reached are those of the node's tail and of the cycle that it ends in.
* One arc in: the nodes reached are a subtree; subtrees add up along doubling pointers.
* Interval labels of such a forest (a node reaches another if its interval
  holds the other's number) answer any number of questions by comparisons.

Other graphs are condensed first (``components``: strongly connected ones, by the
least node that reaches and is reached), and pairs are made between
components only where arcs branch both ways.

Defined results: repeated arcs count once; a node without arcs out reaches
nothing (and has no row in ``counts``); arcs from a node to itself are cycles of
one; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import keep


def counts(edges: DataFrame) -> DataFrame:
    """(start, reached): how many distinct nodes each start leads to by one arc or more; edges: start, node."""
    edges = keep(edges.select("start", "node").distinct())
    if edges.groupBy("start").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _along(edges)
    if edges.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _below(edges)
    return _condensed(edges)


def _doubled(state: DataFrame, add: list, most: int) -> DataFrame:
    """Follow ``hop`` of (node, hop, ...) until it is null, or ``most`` arcs at least: columns ``add`` of where it leads are added up."""
    reach = 1
    while reach < most and not state.where("hop IS NOT NULL").isEmpty():
        ahead = state.select(F.col("node").alias("_n"), F.col("hop").alias("_h"), *(F.col(c).alias(f"_{c}") for c in add))
        met = state.join(ahead, F.col("hop") == F.col("_n"), "left")
        more = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in add]
        state = keep(met.select("node", F.col("_h").alias("hop"), *more, *(c for c in state.columns if c not in ("node", "hop", *add))))
        reach *= 2
    return state


def _cycles(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, cycle) of the nodes on cycles of a graph with one arc out at most: cycle is its least node."""
    arcs = nodes.join(edges.select(F.col("start").alias("node"), F.col("node").alias("hop")), "node", "left")
    far = _doubled(keep(arcs.select("node", "hop")), [], 2 * n)
    on = keep(far.where("hop IS NOT NULL").select(F.col("hop").alias("node")).distinct())
    ring = keep(on.join(edges.select(F.col("start").alias("node"), F.col("node").alias("hop")), "node").select("node", "hop", F.col("node").alias("cycle")))
    size, reach = ring.count(), 1
    while reach < size:
        ahead = ring.select(F.col("node").alias("_n"), F.col("hop").alias("_h"), F.col("cycle").alias("_c"))
        ring = keep(ring.join(ahead, F.col("hop") == F.col("_n")).select("node", F.col("_h").alias("hop"), F.least("cycle", "_c").alias("cycle")))
        reach *= 2
    return ring.select("node", "cycle")


def _nodes(edges: DataFrame) -> DataFrame:
    return keep(edges.select(F.col("start").alias("node")).unionByName(edges.select("node")).distinct())


def _along(edges: DataFrame) -> DataFrame:
    """Counts where every node has one arc out at most."""
    nodes = _nodes(edges)
    n = nodes.count()
    ring = _cycles(edges, nodes, n)
    sizes = ring.groupBy("cycle").agg(F.count("*").alias("size"))
    on = keep(ring.join(sizes, "cycle").select(F.col("node").alias("_on"), "size"))
    arcs = edges.join(on.select(F.col("_on").alias("start")), "start", "left_anti")  # cycles are where tails end
    tails = nodes.join(arcs.select(F.col("start").alias("node"), F.col("node").alias("hop")), "node", "left")
    state = keep(tails.select("node", "hop", F.col("hop").isNotNull().cast("long").alias("steps"), F.coalesce("hop", "node").alias("end")))
    reach = 1
    while reach < n and not state.where("hop IS NOT NULL").isEmpty():
        ahead = state.select(F.col("node").alias("_n"), F.col("hop").alias("_h"), F.col("steps").alias("_s"), F.col("end").alias("_e"))
        met = state.join(ahead, F.col("hop") == F.col("_n"), "left")
        state = keep(met.select("node", F.col("_h").alias("hop"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), F.coalesce("_e", "end").alias("end")))
        reach *= 2
    met = state.join(on, F.col("end") == F.col("_on"), "left")
    reached = F.when(F.col("size").isNull(), F.col("steps")).when(F.col("steps") == 0, F.col("size")).otherwise(F.col("steps") - 1 + F.col("size"))
    return met.select(F.col("node").alias("start"), reached.cast("long").alias("reached")).where("reached > 0")


def _subtrees(parents: DataFrame, n: int) -> DataFrame:
    """(node, size) of a forest (node, hop: the parent or null): nodes at and below each."""
    state = keep(parents.select("node", "hop", F.lit(1).cast("long").alias("size")))
    reach = 1
    while reach < 2 * n and not state.where("hop IS NOT NULL").isEmpty():
        below = state.where("hop IS NOT NULL").groupBy(F.col("hop").alias("_n")).agg(F.sum("size").alias("_more"))
        ahead = state.select(F.col("node").alias("_p"), F.col("hop").alias("_h"))
        met = state.join(below, F.col("node") == F.col("_n"), "left").join(ahead, F.col("hop") == F.col("_p"), "left")
        state = keep(met.select("node", F.col("_h").alias("hop"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")))
        reach *= 2
    return state.select("node", "size")


def _below(edges: DataFrame) -> DataFrame:
    """Counts where every node has one arc in at most."""
    back = edges.select(F.col("node").alias("start"), F.col("start").alias("node"))
    nodes = _nodes(edges)
    n = nodes.count()
    ring = keep(_cycles(back, nodes, n))
    parents = nodes.join(back.select(F.col("start").alias("node"), F.col("node").alias("hop")), "node", "left")
    parents = parents.join(ring.select(F.col("node").alias("_on"), "cycle"), F.col("node") == F.col("_on"), "left")
    parents = keep(parents.select("node", F.when(F.col("_on").isNull(), F.col("hop")).alias("hop"), "cycle"))  # a cycle's nodes are roots
    sized = parents.select("node", "cycle").join(_subtrees(parents.select("node", "hop"), n), "node")
    whole = sized.where("cycle IS NOT NULL").groupBy(F.col("cycle").alias("_c")).agg(F.sum("size").alias("all"))
    met = sized.join(whole, F.col("cycle") == F.col("_c"), "left")
    return met.select(F.col("node").alias("start"), F.coalesce("all", F.col("size") - 1).cast("long").alias("reached")).where("reached > 0")


def intervals(edges: DataFrame) -> DataFrame:
    """(node, first, last) of a forest with arcs from parents to children: a node reaches those whose ``first`` lies after its own and up to its ``last``.

    Trees are numbered apart by their place among the roots; arcs that are no forest raise.
    """
    edges = keep(edges.select("start", "node").distinct())
    nodes = _nodes(edges)
    n = nodes.count()
    if n and not (edges.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()):
        raise ValueError("a node has several arcs in: not a forest")
    back = edges.select(F.col("node").alias("start"), F.col("start").alias("node"))
    if not _cycles(back, nodes, n).isEmpty():
        raise ValueError("arcs go in a circle: not a forest")
    parents = keep(nodes.join(back.select(F.col("start").alias("node"), F.col("node").alias("hop")), "node", "left"))
    sized = keep(parents.join(_subtrees(parents, n), "node"))
    # where a subtree begins after its parent: behind the parent and the subtrees of earlier siblings
    before = F.sum("size").over(Window.partitionBy("hop", "_salt").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    parts = salted.groupBy("hop", "_salt").agg(F.sum("size").alias("_sum"))
    starts = parts.withColumn("_from", F.coalesce(F.sum("_sum").over(Window.partitionBy("hop").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("hop").alias("_p"), F.col("_salt").alias("_s"), "_from")
    placed = salted.withColumn("_before", F.coalesce(before, F.lit(0))).join(starts, F.col("hop").eqNullSafe(F.col("_p")) & (F.col("_salt") == F.col("_s")))
    offset = F.col("_from") + F.col("_before") + F.when(F.col("hop").isNull(), 0).otherwise(1)
    done = _doubled(keep(placed.select("node", "hop", offset.cast("long").alias("first"), "size")), ["first"], 2 * n)
    return done.select("node", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components, each named by one of its nodes.

    Nodes take the greatest name that reaches them; a name's component are those
    of its colour that reach it back.  What is found leaves, and the rest goes on.
    """
    edges = keep(edges.select("start", "node").where("start != node").distinct())
    left, found = _nodes(edges), None
    while not left.isEmpty():
        colours = left.select("node", F.col("node").alias("colour"))
        while True:
            best = edges.join(colours.withColumnRenamed("node", "start"), "start").groupBy(F.col("node").alias("_n")).agg(F.max("colour").alias("_c"))
            new = keep(colours.join(best, F.col("node") == F.col("_n"), "left").select("node", "colour", F.greatest("colour", F.coalesce("_c", "colour")).alias("_new")))
            done = new.where("colour != _new").isEmpty()
            colours = new.select("node", F.col("_new").alias("colour"))
            if done:
                break
        own = keep(edges.join(colours.select(F.col("node").alias("start"), F.col("colour").alias("a")), "start").join(colours.select("node", F.col("colour").alias("b")), "node").where("a = b").select("start", "node"))
        back = keep(colours.where("node = colour"))
        fresh = back
        while not fresh.isEmpty():
            more = own.join(fresh.select("node", "colour"), "node").select(F.col("start").alias("node"), "colour").distinct()
            fresh = keep(more.join(back.select("node"), "node", "left_anti"))
            back = keep(back.unionByName(fresh))
        got = back.select("node", F.col("colour").alias("component"))
        found = got if found is None else keep(found.unionByName(got))
        left = keep(left.join(back.select("node"), "node", "left_anti"))
        edges = keep(edges.join(left.withColumnRenamed("node", "start"), "start", "left_semi").join(left, "node", "left_semi"))
    return found if found is not None else left.select("node", F.col("node").alias("component"))


def _condensed(edges: DataFrame) -> DataFrame:
    """Counts of any graph: closure between components, sizes added up."""
    nodes = _nodes(edges)
    named = keep(nodes.join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("c")))
    arcs = edges.join(named.select(F.col("node").alias("start"), F.col("c").alias("a")), "start").join(named.select("node", F.col("c").alias("b")), "node")
    loops = arcs.where("a = b").select("a").distinct()
    one = keep(arcs.where("a != b").select("a", "b").distinct())
    closure, fresh = one, one
    while not fresh.isEmpty():
        grown = fresh.withColumnRenamed("b", "_via").join(one.withColumnRenamed("a", "_via"), "_via").select("a", "b").distinct()
        fresh = keep(grown.join(closure, ["a", "b"], "left_anti"))
        closure = keep(closure.unionByName(fresh))
    sizes = named.groupBy("c").agg(F.count("*").alias("size"))
    all_ = closure.unionByName(loops.select("a", F.col("a").alias("b")))
    reached = all_.join(sizes.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.sum("size").alias("reached"))
    return named.join(reached, F.col("c") == F.col("a")).select(F.col("node").alias("start"), F.col("reached").cast("long").alias("reached"))


def undirected(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes that hang together, named by the least of them: neighbours hang on the least one they know, until nothing moves."""
    left = keep(edges.select(F.col("start").alias("a"), F.col("node").alias("b")).where("a != b").distinct())
    names = _nodes(edges)
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        far = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        near = far.where("a != b").unionByName(least.where("a != m").select("a", F.col("m").alias("b"))).distinct()
        down = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        new = down.join(low, "a")
        new = keep(new.where("b != m").select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        if new.exceptAll(left).isEmpty() and left.exceptAll(new).isEmpty():
            break
        left = new
    return names.join(new.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
