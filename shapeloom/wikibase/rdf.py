"""Entities as RDF: terms, truthy and full statements, qualifiers and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import TRIPLES
from ..schema.ast import RDF, XSD
from .model import best_rank

ENTITY = "http://www.wikidata.org/entity/"
STATEMENT = "http://www.wikidata.org/entity/statement/"
REFERENCE = "http://www.wikidata.org/reference/"
PROP = "http://www.wikidata.org/prop/"

_COLUMNS = [c.split()[0] for c in TRIPLES.split(", ")]


def time_literal(value: Column) -> Column:
    """``+2001-12-31T00:00:00Z`` to a dateTime; days and months that are 0 become 1; years before year 0 keep their sign."""
    x = F.regexp_replace(F.regexp_replace(value, r"^\+", ""), r"^(-?\d+)-00", "$1-01")
    return F.regexp_replace(x, r"^(-?\d+-\d\d)-00", "$1-01")


def quantity_literal(value: Column) -> Column:
    """Decimal with its sign."""
    return F.when(value.startswith("+") | value.startswith("-"), value).otherwise(F.concat(F.lit("+"), value))


def globe_literal(latitude: Column, longitude: Column) -> Column:
    return F.concat(F.lit("Point("), longitude, F.lit(" "), latitude, F.lit(")"))


def _object(snak: Column) -> tuple[Column, Column, Column]:
    kind = F.when(snak["vtype"] == "entity", "iri").when(snak["kind"] == "somevalue", "bnode").otherwise("literal")
    lex = (
        F.when(snak["vtype"] == "entity", F.concat(F.lit(ENTITY), snak["value"]))
        .when(snak["vtype"] == "time", time_literal(snak["value"]))
        .when(snak["vtype"] == "quantity", quantity_literal(snak["value"]))
        .when(snak["kind"] == "somevalue", F.concat(F.lit("_:some"), F.hex(F.xxhash64(F.to_json(snak)))))
        .otherwise(snak["value"])
    )
    dt = F.when(kind != "literal", F.lit(None)).when(snak["vtype"] == "time", XSD + "dateTime").when(snak["vtype"] == "quantity", XSD + "decimal").otherwise(XSD + "string")
    return kind, lex, dt.cast("string")


def _triple(s, p, kind, lex, dt, lang=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(s.alias("s"), p.alias("p"), kind.alias("o_kind"), lex.alias("o_lex"), dt.alias("o_dt"), (none if lang is None else lang).alias("o_lang"))


def truthy(entities: DataFrame, prefix: str = PROP + "direct/") -> DataFrame:
    """Triples entity, property, value of the best-ranked statements."""
    e = entities.select(F.concat(F.lit("<" + ENTITY), F.col("id"), F.lit(">")).alias("s"), F.explode(best_rank()).alias("t")).where(F.col("t.snak.kind") != "novalue")
    kind, lex, dt = _object(F.col("t.snak"))
    return e.select(_triple(F.col("s"), F.concat(F.lit(prefix), F.col("t.property")), kind, lex, dt).alias("r")).select("r.*")


def full(entities: DataFrame) -> DataFrame:
    """Terms, truthy and full statements with qualifiers and references."""
    subject = F.concat(F.lit("<" + ENTITY), F.col("id"), F.lit(">"))
    out = truthy(entities)
    lang_string = F.lit(RDF + "langString")
    for column, predicate in (("labels", "http://www.w3.org/2000/01/rdf-schema#label"), ("descriptions", "http://schema.org/description")):
        part = entities.select(subject.alias("s"), F.explode(column).alias("lang", "value"))
        out = out.unionByName(part.select(_triple(F.col("s"), F.lit(predicate), F.lit("literal"), F.col("value"), lang_string, F.col("lang")).alias("r")).select("r.*"))
    part = entities.select(subject.alias("s"), F.explode("aliases").alias("lang", "values")).select("s", "lang", F.explode("values").alias("value"))
    out = out.unionByName(part.select(_triple(F.col("s"), F.lit("http://www.w3.org/2004/02/skos/core#altLabel"), F.lit("literal"), F.col("value"), lang_string, F.col("lang")).alias("r")).select("r.*"))
    st = entities.select(subject.alias("s"), F.col("id"), F.posexplode("statements").alias("i", "t"))
    st = st.withColumn("node", F.concat(F.lit(STATEMENT), F.col("id"), F.lit("-"), F.col("i").cast("string"))).withColumn("sn", F.concat(F.lit("<"), F.col("node"), F.lit(">")))
    none = F.lit(None).cast("string")
    rows = [st.select(_triple(F.col("s"), F.concat(F.lit(PROP), F.col("t.property")), F.lit("iri"), F.col("node"), none).alias("r"))]
    kind, lex, dt = _object(F.col("t.snak"))
    rows.append(st.where(F.col("t.snak.kind") != "novalue").select(_triple(F.col("sn"), F.concat(F.lit(PROP + "statement/"), F.col("t.property")), kind, lex, dt).alias("r")))
    q = st.select("sn", F.explode("t.qualifiers").alias("q")).where(F.col("q.kind") != "novalue")
    kind, lex, dt = _object(F.col("q"))
    rows.append(q.select(_triple(F.col("sn"), F.concat(F.lit(PROP + "qualifier/"), F.col("q.property")), kind, lex, dt).alias("r")))
    ref = st.select("sn", F.explode("t.refs").alias("ref")).withColumn("rn", F.concat(F.lit(REFERENCE), F.hex(F.xxhash64(F.to_json("ref")))))
    rows.append(ref.select(_triple(F.col("sn"), F.lit("http://www.w3.org/ns/prov#wasDerivedFrom"), F.lit("iri"), F.col("rn"), none).alias("r")))
    inner = ref.select(F.concat(F.lit("<"), F.col("rn"), F.lit(">")).alias("rs"), F.explode("ref").alias("x")).where(F.col("x.kind") != "novalue")
    kind, lex, dt = _object(F.col("x"))
    rows.append(inner.select(_triple(F.col("rs"), F.concat(F.lit(REFERENCE + "prop/"), F.col("x.property")), kind, lex, dt).alias("r")))
    for r in rows:
        out = out.unionByName(r.select("r.*"))
    return out.select(*_COLUMNS).distinct()
