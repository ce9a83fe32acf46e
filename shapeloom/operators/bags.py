"""Bags as tables: keys, a symbol and its multiplicity ``n``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of(rows: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Bag of a column's values per key."""
    return rows.groupBy(*keys, F.col(symbol).alias("symbol")).agg(F.count("*").alias("n"))


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Multiplicities add up."""
    return a.unionByName(b).groupBy(*keys, "symbol").agg(F.sum("n").alias("n"))


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The lesser multiplicity."""
    other = b.withColumnRenamed("n", "m")
    return a.join(other, [*keys, "symbol"]).select(*keys, "symbol", F.least("n", "m").alias("n"))


def insert(a: DataFrame, keys: list[str], rows: DataFrame) -> DataFrame:
    """Add one of each row's symbol."""
    return union(a, rows.select(*keys, "symbol", F.lit(1).cast("long").alias("n")), keys)


def delete(a: DataFrame, keys: list[str], rows: DataFrame) -> DataFrame:
    """Take one of each row's symbol away, down to none."""
    less = rows.groupBy(*keys, "symbol").agg(F.count("*").alias("m"))
    left = a.join(less, [*keys, "symbol"], "left").select(*keys, "symbol", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"))
    return left.where("n > 0")


def size(a: DataFrame, keys: list[str]) -> DataFrame:
    return a.groupBy(*keys).agg(F.sum("n").alias("size"))


def delta(a: DataFrame, keys: list[str], bounds: dict[str, tuple[int, int | None]]) -> DataFrame:
    """Symbols whose multiplicity is out of the schema's bounds, missing ones included."""
    table = F.array(*(F.struct(F.lit(s).alias("symbol"), F.lit(lo).cast("long").alias("low"), F.lit(hi).cast("long").alias("high")) for s, (lo, hi) in sorted(bounds.items())))
    full = a.select(*keys).distinct().select(*keys, F.explode(table).alias("b")).select(*keys, "b.*").join(a, [*keys, "symbol"], "left")
    n = F.coalesce("n", F.lit(0))
    return full.where((n < F.col("low")) | F.coalesce(n > F.col("high"), F.lit(False))).select(*keys, "symbol", n.alias("n"))


def to_map(a: DataFrame, keys: list[str]) -> DataFrame:
    """One sorted map per key, where a whole bag is wanted in a row."""
    return a.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "n")))).alias("bag"))
