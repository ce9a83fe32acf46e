"""Entity documents as rows: nested structs, one row an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNAK = "STRUCT<property: STRING, kind: STRING, vtype: STRING, value: STRING>"
STATEMENT = f"STRUCT<property: STRING, snak: {SNAK}, rank: STRING, qualifiers: ARRAY<{SNAK}>, refs: ARRAY<ARRAY<{SNAK}>>>"
ENTITY = f"id STRING, type STRING, labels MAP<STRING, STRING>, descriptions MAP<STRING, STRING>, aliases MAP<STRING, ARRAY<STRING>>, statements ARRAY<{STATEMENT}>"

_J_SNAK = "STRUCT<snaktype: STRING, property: STRING, datavalue: STRUCT<value: STRING, type: STRING>>"
_J_TERM = "STRUCT<language: STRING, value: STRING>"
_J_ENTITY = (
    f"STRUCT<id: STRING, type: STRING, labels: MAP<STRING, {_J_TERM}>, descriptions: MAP<STRING, {_J_TERM}>, aliases: MAP<STRING, ARRAY<{_J_TERM}>>, "
    f"claims: MAP<STRING, ARRAY<STRUCT<mainsnak: {_J_SNAK}, rank: STRING, qualifiers: MAP<STRING, ARRAY<{_J_SNAK}>>, references: ARRAY<STRUCT<snaks: MAP<STRING, ARRAY<{_J_SNAK}>>>>>>>>"
)

#: Datavalue types of the public JSON format and the part of each that is its value.
VALUE_PARTS = {"wikibase-entityid": ("entity", "$.id"), "time": ("time", "$.time"), "quantity": ("quantity", "$.amount"), "monolingualtext": ("monolingual", "$.text"), "globecoordinate": ("globe", "$.latitude")}


def _snak(s: Column) -> Column:
    v, t = s["datavalue"]["value"], s["datavalue"]["type"]
    vtype, value = F.when(s["snaktype"] == "value", F.lit("string")), v
    for name, (kind, part) in VALUE_PARTS.items():
        vtype = F.when(t == name, F.lit(kind)).otherwise(vtype)
        value = F.when(t == name, F.get_json_object(v, part)).otherwise(value)
    return F.struct(s["property"].alias("property"), s["snaktype"].alias("kind"), vtype.alias("vtype"), value.alias("value"))


def _snaks(m: Column) -> Column:
    none = F.array().cast(f"ARRAY<{SNAK}>")
    return F.coalesce(F.flatten(F.transform(F.map_values(m), lambda xs: F.transform(xs, _snak))), none)


def parse_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entities of JSON lines; what is no entity gives a row with a null id and its text in ``_bad``."""
    j = lines.withColumn("_j", F.from_json(column, _J_ENTITY))
    statement = lambda c: F.struct(
        c["mainsnak"]["property"].alias("property"), _snak(c["mainsnak"]).alias("snak"), F.coalesce(c["rank"], F.lit("normal")).alias("rank"),
        _snaks(c["qualifiers"]).alias("qualifiers"), F.coalesce(F.transform(c["references"], lambda r: _snaks(r["snaks"])), F.array().cast(f"ARRAY<ARRAY<{SNAK}>>")).alias("refs"),
    )
    terms = lambda m: F.coalesce(F.transform_values(m, lambda _, v: v["value"]), F.create_map().cast("MAP<STRING, STRING>"))
    return j.select(
        F.col("_j.id").alias("id"),
        F.col("_j.type").alias("type"),
        terms(F.col("_j.labels")).alias("labels"),
        terms(F.col("_j.descriptions")).alias("descriptions"),
        F.coalesce(F.transform_values("_j.aliases", lambda _, v: F.transform(v, lambda x: x["value"])), F.create_map().cast("MAP<STRING, ARRAY<STRING>>")).alias("aliases"),
        F.coalesce(F.flatten(F.transform(F.map_values("_j.claims"), lambda cs: F.transform(cs, statement))), F.array().cast(f"ARRAY<{STATEMENT}>")).alias("statements"),
        F.when(F.col("_j.id").isNull(), F.col(column)).alias("_bad"),
    )


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump: one entity a line between brackets, lines ended by commas; compressed files are read as they are."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",$", "").alias("value"))
    return parse_json(lines.where(~F.col("value").isin("[", "]", "")))


def stream_dump(spark: SparkSession, folder: str) -> DataFrame:
    """The same over a folder that receives files."""
    lines = spark.readStream.format("text").load(folder).select(F.regexp_replace(F.trim("value"), r",$", "").alias("value"))
    return parse_json(lines.where(~F.col("value").isin("[", "]", "")))


def to_json(entities: DataFrame) -> DataFrame:
    """One JSON text per entity, in this model's own form; ``ok_shapes`` and the like go along."""
    return entities.select(F.to_json(F.struct(*entities.columns)).alias("value"))


def to_text(entities: DataFrame) -> DataFrame:
    """One short line per entity: id, its label and how many statements it has."""
    label = F.coalesce(F.element_at("labels", "en"), F.try_element_at(F.map_values("labels"), F.lit(1)), F.lit(""))
    return entities.select(F.concat_ws(" ", "id", label, F.concat(F.lit("("), F.size("statements"), F.lit(")"))).alias("value"))


def best_rank(statements: str = "statements") -> Column:
    """Truthy statements: of each property the preferred ones, else the normal ones; an array function, no shuffle."""
    s = F.col(statements)
    preferred = F.array_distinct(F.transform(F.filter(s, lambda x: x["rank"] == "preferred"), lambda x: x["property"]))
    return F.filter(s, lambda x: (x["rank"] == "preferred") | ((x["rank"] == "normal") & ~F.array_contains(preferred, x["property"])))
