"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words (``targets``).  A document's expected number
of copies is its source's target over the source's size; its fraction has to be
rounded, so a document gets the whole number below or above.  Rounding is
pivotal and weighted by size: of two undecided units of a source mass moves from
one to the other, in a random direction with the odds that keep both
expectations, until a fraction is 0 or 1, so words and expectations stay as they
are.  In a group documents take turns, the largest first, each paired with
all smaller undecided ones as one unit, which share evenly in what the unit
gives or takes; the pair ends when the document is whole, or when one of the unit
is (it then leaves the unit, decided).  A large document is thus made up for by
many small ones, and at most one document of a group stays open.

Groups form a reduction tree: a source's documents are dealt by a hash of their
key to leaves of about ``LEAF``; ``FAN`` leaves hand their open documents to a
group of the next level, until one group per source is left.  Its last open
document is drawn; where other documents can make up for one of the two
outcomes only, it takes that one.  What a source then misses its target by is
less than that one document.  Where this is more than ``MISS`` of the target
(few documents, or one that outweighs the others) documents below twice
the miss get a copy more or less, the largest that fit first, within 0 and
``cap``, until none brings the source nearer.  Draws come from a generator seeded by (seed, level,
source, group) or a hash of the document: reruns agree, whatever the partitions.

The tree sees keys and sizes only; ``mix`` joins its copies with the rows.  Rows of the same doc_id, source and
size are one item with their sizes added up and share a number of copies.

Defined results: null text has size 0 and is taken 0 times, as is text without
words; null sources form one source, ordered last; null ids are ids like any
other; an empty table gives an empty result; with sizes all 0 all targets are
0.  Extra columns are kept; ``size``, ``source_size``, ``target``, ``copies``
and ``taken`` are replaced.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, ranked, shielded, word_count

LEAF = 4096
FAN = 64
CAP = 3.0
WEIGHTS = (1, 2, 3)
SALT = 64
BROADCAST_BYTES = 32 << 20
MISS = 0.002
CHANGES = 64  # documents of a source that a turn of corrections looks at; turns go on until none is of use


def targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """source, source_size, target of (source, size): weights 1, 2, 3 repeat in code-point order, null last.

    Targets share the total by weight, stop at ``cap`` times the source's size,
    and the excess is reshared by weight until none is above.  One row per
    source stays distributed; each round brings two sums to the driver.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(by_source, [F.col("source").isNull(), F.col("source")], F.lit(1), "place")
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    table = checkpoint(placed.withColumn("w", F.element_at(weights, (F.col("place") % len(WEIGHTS) + 1).cast("int"))))
    rate, total = None, table.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    while True:
        r = table.agg(F.sum(F.when(~capped, F.col("w")).otherwise(0.0)).alias("w"), F.sum(F.when(capped, cap * F.col("source_size")).otherwise(0.0)).alias("held")).first()
        if not r["w"]:
            break
        new = (total - r["held"]) / r["w"]
        if rate is not None and new <= rate:
            break
        rate = new
        capped = F.col("w") * F.lit(rate) > cap * F.col("source_size")
    share = F.col("w") * F.lit(float(rate or 0.0))
    return table.select("source", "source_size", F.least(share, cap * F.col("source_size")).alias("target"))


def settle(weight: list[float], expected: list[float], cap: float, rng) -> list[float]:
    """Copies of the members of one group, heaviest first: the whole number below or above the expected one, but for at most one that stays open."""
    e, n = list(expected), len(weight)
    base = [float(int(x + 1e-9)) for x in e]
    alive = [1e-9 < x - b < 1 - 1e-9 for x, b in zip(e, base, strict=True)]
    e = [x if a else float(round(x)) for x, a in zip(e, alive, strict=True)]

    def suffixes():
        low, high, rest = [1.0] * (n + 1), [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(n - 1, -1, -1):
            low[j], high[j], rest[j] = (min(low[j + 1], e[j] - base[j]), max(high[j + 1], e[j] - base[j]), rest[j + 1] + weight[j]) if alive[j] else (low[j + 1], high[j + 1], rest[j + 1])
        return low, high, rest

    def spread():  # what the unit has shared so far becomes each member's own
        for j in range(i + 1, n):
            if alive[j]:
                e[j] += shift
                if e[j] - base[j] < 1e-9 or e[j] - base[j] > 1 - 1e-9:
                    e[j], alive[j] = float(round(e[j])), False

    low, high, rest = suffixes()
    shift = 0.0
    for i in range(n):
        if not alive[i]:
            continue
        alive[i] = False
        x, a = e[i] + shift, weight[i]
        while True:
            f = x - base[i]
            if f < 1e-9 or f > 1 - 1e-9:
                x = float(round(x))
                break
            words = rest[i + 1]
            if words <= 0:
                break
            up, down = min(a * (1 - f), words * (low[i + 1] + shift)), min(a * f, words * (1 - high[i + 1] - shift))
            rises = rng.random() * (up + down) < down
            moved = up if rises else -down
            x += moved / a
            shift -= moved / words
            if low[i + 1] + shift < 1e-9 or 1 - high[i + 1] - shift < 1e-9:  # members at a bound are decided
                spread()
                shift = 0.0
                low, high, rest = suffixes()
        e[i] = x
    return e


_SCHEMA = "doc_id long, source string, size long, rows long, h long, groups long, e double"


def _level(level: int, seed: int, cap: float):
    """Function over one group (an Arrow table): ``e`` after the group's pairs."""

    def run(table):
        table = table.append_column("weight", pc.multiply(table["size"], table["rows"]).cast(pa.float64())).sort_by([("weight", "descending"), ("h", "ascending"), ("doc_id", "ascending"), ("rows", "ascending")])
        key = (seed, level, table["source"][0].as_py(), table["leaf"][0].as_py())
        rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
        e = settle(table["weight"].to_pylist(), table["e"].to_pylist(), cap, rng)
        names = [n.split()[0] for n in _SCHEMA.split(", ")]
        return table.select(names[:-1]).append_column("e", pa.array(e, pa.float64()))

    return run


def round_copies(items: DataFrame, seed: int = 42, cap: float = CAP) -> DataFrame:
    """(doc_id, source, size, rows, h, e) of items: doc_id, source, size, rows, groups (of their source), e (expected copies); of a source at most one ``e`` is not whole."""
    e, columns = F.col("e"), ("doc_id", "source", "size", "rows", "h", "e")
    open_items = items.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")).select("doc_id", "source", "size", "rows", "h", "groups", "e")
    decided, level = [], 0
    while True:
        leaf = F.pmod("h", F.col("groups")).alias("leaf")
        out = checkpoint(open_items.select("*", leaf).groupBy("source", "leaf").applyInArrow(_level(level, seed, cap), _SCHEMA))
        last = F.col("groups") == 1
        decided.append(out.where((e == F.round(e)) | last).select(*columns))
        open_items = out.where((e != F.round(e)) & ~last).withColumn("groups", F.ceil(F.col("groups") / FAN))
        if open_items.isEmpty():
            break
        level += 1
    return reduce(DataFrame.unionByName, decided)


def drawn(rounded: DataFrame, plan: DataFrame, seed: int = 42, cap: float = CAP) -> DataFrame:
    """(doc_id, source, size, rows, h, copies): the last open document of a source takes the side that the others can make up for, or draws."""
    words, e = (F.col("size") * F.col("rows")).cast("double"), F.col("e")
    whole = e == F.floor(e)
    room = rounded.groupBy("source").agg(F.sum(F.when(whole, words * e).otherwise(0.0)).alias("_less"), F.sum(F.when(whole, words * (cap - e)).otherwise(0.0)).alias("_more"), F.count_if(~whole).alias("_open"))
    room = checkpoint(room.where("_open > 0").drop("_open"))
    closed = rounded.where(whole).withColumn("copies", e.cast("long")).drop("e")
    part = e - F.floor(e)
    up, down = (1 - part) * words <= F.col("_less"), part * words <= F.col("_more")
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "source", "h", "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < part
    more = F.when(up & ~down, 1).when(down & ~up, 0).otherwise(chance.cast("int"))
    opened = with_source(rounded.where(~whole), room).withColumn("copies", (F.floor(e) + more).cast("long"))
    return closed.unionByName(opened.select(*closed.columns))


def corrected(made: DataFrame, plan: DataFrame, cap: float = CAP, miss: float = MISS) -> DataFrame:
    """Copies of ``made`` (doc_id, source, size, rows, h, copies), changed where a source misses its target by more than ``miss`` of it."""
    words = F.col("size") * F.col("rows")
    made = checkpoint(made)
    while True:
        taken = made.groupBy("source").agg(F.sum(words * F.col("copies")).alias("_taken"))
        off = taken.alias("t").join(plan.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source"))).select("p.source", (F.col("target") - F.col("_taken")).alias("_off"), "target")
        off = checkpoint(off.where(F.abs("_off") > miss * F.col("target")).drop("target"))
        if off.isEmpty():
            return made
        rises = F.col("_off") > 0
        fits = (words > 0) & (words < 2 * F.abs("_off")) & F.when(rises, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        near = with_source(made, off).where(fits)
        place = F.row_number().over(Window.partitionBy("source").orderBy(words.desc(), "h", "doc_id"))
        changes = checkpoint(near.withColumn("_place", place).where(F.col("_place") <= CHANGES).groupBy("source").applyInPandas(_changes, "doc_id long, source string, size long, _change long"))
        if changes.isEmpty():
            return made
        joined = made.alias("d").join(changes.alias("f"), _same("d", "f"), "left")
        made = checkpoint(joined.select(*(F.col(f"d.{c}") for c in made.columns if c != "copies"), (F.col("d.copies") + F.coalesce("f._change", F.lit(0))).alias("copies")))


def _changes(pdf):
    """A copy more or less of each document that still fits into what its source misses."""
    import pandas as pd

    pdf = pdf.sort_values("_place")
    left, sign, out = abs(pdf["_off"].iloc[0]), 1 if pdf["_off"].iloc[0] > 0 else -1, []
    words = (pdf["size"] * pdf["rows"]).tolist()
    for w in words:
        out.append(sign * int(left >= w))
        left -= abs(out[-1]) * w
    past = [i for i, (n, w) in enumerate(zip(out, words, strict=True)) if not n and w < 2 * left]
    if past:  # one more goes beyond the target, but comes nearer to it
        out[min(past, key=lambda i: abs(left - words[i]))] = sign
    return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "source": pdf["source"], "size": pdf["size"], "_change": out})[[n != 0 for n in out]]


def with_source(items: DataFrame, per: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``items`` beside the columns of ``per``, which has one row a source.

    A table of sources of a checked size is broadcast; a larger one is repeated
    ``SALT`` times, so that a hot source's items meet it in as many tasks.
    """
    per = per.withColumnRenamed("source", "_s")
    same = F.col("source").eqNullSafe(F.col("_s"))
    if (per.agg(F.sum(F.coalesce(F.octet_length("_s"), F.lit(0)) + 64)).first()[0] or 0) <= most_bytes:
        return items.join(F.broadcast(per), same).drop("_s")
    salted = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = items.withColumn("_salt_of", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALT)))
    return dealt.join(salted, same & (F.col("_salt_of") == F.col("_salt"))).drop("_s", "_salt", "_salt_of")


def copies(sizes: DataFrame, seed: int = 42, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """Copies of every item (doc_id, source, size) of ``sizes``, and the table of targets."""
    grouped = checkpoint(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    groups = grouped.groupBy("source").agg(F.greatest(F.ceil(F.count_if(F.col("size") > 0) / LEAF), F.lit(1)).alias("groups"))
    plan = targets(sizes, cap)
    plan = checkpoint(plan.alias("p").join(groups.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.*", "groups"))
    some = grouped.where("size > 0")
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    items = with_source(some, plan).select("doc_id", "source", "size", "rows", "groups", expected.alias("e"))
    none = grouped.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copies"))
    plan = plan.drop("groups")
    made = corrected(drawn(round_copies(items, seed, cap), plan, seed, cap), plan, cap)
    return made.select(*none.columns).unionByName(none), plan


def _same(x: str, y: str):
    return F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source")) & (F.col(f"{x}.size") == F.col(f"{y}.size"))


def mix(docs: DataFrame, seed: int = 42, cap: float = CAP) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken") if "size" not in docs.columns or "text" in docs.columns else docs
    sized = docs.withColumn("size", word_count(F.col("text"))) if "text" in docs.columns else docs
    made, plan = copies(checkpoint(sized.select("doc_id", "source", "size")), seed, cap)
    full = with_source(made, plan)
    keep = [F.col(f"d.`{c}`") for c in sized.columns]
    return sized.alias("d").join(full.alias("f"), _same("d", "f")).select(*keep, "f.source_size", "f.target", "f.copies", (F.col("f.copies") * F.col("d.size")).alias("taken"))


def repeat(docs: DataFrame, seed: int = 42, cap: float = CAP) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    Rows come by number of copy, in the order of a hash: copies of a document are a whole pass over the others apart.
    """
    safe, back = shielded(docs, ("size", "source_size", "target", "copies", "taken", "_copy"))
    mixed = mix(safe, seed, cap).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    wide, place = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(F.lit(seed), "doc_id")
    mixed = mixed.repartition(wide, F.col("_copy"), F.pmod(place, F.lit(wide))).sortWithinPartitions("_copy", place)
    return mixed.select(*(F.col(f"`{c}`") for c in safe.columns)).withColumnsRenamed(back)


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, with its source's target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can express."""
    return op1_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES = {"op1_source_mixing": op1_source_mixing, "mixing_targets": mixing_targets}
ORACLE = {
    # of the sources in the order of size over weight the first k stop at their caps: the fewest that leave the next one below its own
    "mixing_targets": r"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w FROM z GROUP BY source
), o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS k FROM s
), c AS (SELECT 0 AS k UNION ALL SELECT k FROM o
), r AS (
  SELECT c.k, ((SELECT sum(source_size) FROM o) - coalesce(sum(3.0 * source_size) FILTER (o.k <= c.k), 0)) / nullif(sum(w) FILTER (o.k > c.k), 0) AS rate FROM c, o GROUP BY c.k
), f AS (SELECT min(r.k) AS k FROM r LEFT JOIN o ON o.k = r.k + 1 WHERE o.k IS NULL OR rate * w <= 3 * source_size
), t AS (SELECT source, source_size, CASE WHEN o.k <= f.k THEN 3.0 * source_size ELSE rate * w END AS target FROM o, f JOIN r ON r.k = f.k)
SELECT doc_id, size, source_size, round(target, 3) AS target FROM z JOIN t ON t.source IS NOT DISTINCT FROM z.source
"""
}
