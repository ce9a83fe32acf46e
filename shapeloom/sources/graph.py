"""Graphs as triples tables, and relational tables seen as graphs (direct mapping)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import TRIPLES, literal_id, resource, term_at, term_id, term_row
from ..schema.ast import RDF, XSD

BASE = "http://shapes.example/"
TYPE = RDF + "type"

#: Spark types to datatypes.
DATATYPES = {"bigint": "integer", "int": "integer", "double": "double", "string": "string", "timestamp": "dateTime", "boolean": "boolean", "date": "date"}


class Graph:
    """A triples table: s, p, o_kind, o_lex, o_dt, o_lang.  Triples are a set."""

    def __init__(self, df: DataFrame, distinct: bool = True):
        self.df = df.distinct() if distinct else df

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def triples(self, predicates: set[str] | None = None) -> DataFrame:
        """All triples, or those of some predicates: a filter that reaches the scan."""
        return self.df if predicates is None else self.df.where(F.col("p").isin(sorted(predicates)))

    def triples_with(self, predicate: str, term) -> DataFrame:
        """Triples of one predicate and object."""
        return self.triples({predicate}).where(_is_object(term))

    def triples_to(self, term) -> DataFrame:
        """Triples of one object, whatever their predicates."""
        return self.triples().where(_is_object(term))

    def subjects(self) -> DataFrame:
        return self.df.select("s").distinct()

    def about(self, nodes: DataFrame) -> Graph:
        """A part of the graph that holds all triples with nodes (column ``node``) as subjects."""
        return self

    def leading_to(self, nodes: DataFrame) -> Graph:
        """A part of the graph that holds all triples with nodes (column ``node``) as objects."""
        return self

    def neighbours(self, nodes: DataFrame | None = None) -> DataFrame:
        """(node, direction, p, kind, lex, dt, lang): arcs out of and into nodes (column ``node``), or all."""
        t, u, s = (self if nodes is None else self.about(nodes)).triples(), (self if nodes is None else self.leading_to(nodes)).triples(), resource(F.col("s"))
        out = t.select(F.col("s").alias("node"), F.lit("out").alias("direction"), "p", *(F.col(f"o_{x}").alias(x) for x in ("kind", "lex", "dt", "lang")))
        back = u.select(term_id(term_at()).alias("node"), F.lit("in").alias("direction"), "p", s.kind.alias("kind"), s.lex.alias("lex"), s.dt.alias("dt"), s.lang.alias("lang"))
        both = out.unionByName(back)
        return both if nodes is None else both.join(nodes.select("node"), "node", "left_semi")


def _is_object(term) -> Column:
    kind, lex, dt, lang = term_row(term)
    return (F.col("o_kind") == kind) & (F.col("o_lex") == lex) & F.col("o_dt").eqNullSafe(dt) & F.lower("o_lang").eqNullSafe(lang.lower() if lang else None)


def of_terms(spark: SparkSession, triples: list[tuple]) -> Graph:
    """A graph of driver-side terms: (subject, predicate IRI, object)."""
    rows = [(literal_id(s), p, *term_row(o)) for s, p, o in triples]
    return Graph(spark.createDataFrame(rows, TRIPLES))


def union(*graphs: Graph) -> Graph:
    out = graphs[0].df
    for g in graphs[1:]:
        out = out.unionByName(g.df)
    return Graph(out)


@dataclass(frozen=True)
class Link:
    """A column that holds the key of another table's row."""

    table: str


@dataclass(frozen=True)
class Column_:
    name: str
    to: Link | None = None
    lang: str | None = None  # column with the language
    iri: bool = False  # the value is an IRI itself
    expr: str | None = None  # SQL over the row; the column's own value by default
    dt: str | None = None  # datatype IRI, where it does not follow from the column's type
    predicate: str | None = None  # full IRI, ``<base name>`` by default

    @property
    def iri_of(self) -> str:
        return self.predicate or BASE + self.name


@dataclass
class TableMapping:
    """One row, one subject ``<base table/key>``; one non-null column, one triple."""

    table: str
    key: str  # SQL of the subject's key
    columns: list[Column_] = field(default_factory=list)
    cls: str | None = None
    about: str | None = None  # table whose subjects these rows describe
    typed: bool = True  # gives rdf:type
    distinct: bool = False  # several rows may give one triple

    @property
    def subject(self) -> str:
        return f"concat('<{BASE}{self.about or self.table}/', {self.key}, '>')"


class MappedGraph(Graph):
    """Tables as a graph.  Only columns whose predicates are asked for are read."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], mappings: list[TableMapping]):
        self._spark, self.tables, self.mappings = spark, tables, mappings

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def df(self) -> DataFrame:
        return self.triples(None)

    def triples(self, predicates: set[str] | None = None) -> DataFrame:
        out = None
        for m in self.mappings:
            cols = [c for c in m.columns if predicates is None or c.iri_of in predicates]
            typed = m.typed and (predicates is None or TYPE in predicates)
            if not cols and not typed:
                continue
            table = self.tables[m.table]
            kinds = dict(table.dtypes)
            if m.distinct and not typed and all(c.lang is None for c in cols):
                one = self._distinct(table, m, cols, kinds)
                out = one if out is None else out.unionByName(one)
                continue
            objects = [(self._object(c, kinds, self._value(c, kinds)), self._raw(c).isNotNull()) for c in cols]
            if typed:
                objects.append((_object_of(F.lit(TYPE), "iri", F.lit(BASE + (m.cls or m.table)), None, None), F.lit(True)))
            subject = F.expr(m.subject).alias("s")
            if len(objects) == 1:  # the null test can reach the scan
                one = table.where(objects[0][1]).select(subject, *objects[0][0])
            else:  # a row a place and no nested values, so what is not asked for is never made; no name of a table's own columns starts so
                rows = table.select(F.col("*"), subject.alias("_s_"), F.explode(F.array(*(F.lit(i) for i in range(len(objects))))).alias("_i_"))
                picked = [_pick([o[k] for o, _ in objects]).alias(name) for k, name in enumerate(_OBJECT)]
                one = rows.where(_pick([there for _, there in objects])).select(F.col("_s_").alias("s"), *picked)
            one = one.distinct() if m.distinct else one
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self._spark.createDataFrame([], TRIPLES)
        return out

    def triples_with(self, predicate: str, term) -> DataFrame:
        """A type is a table: only tables of that class are read."""
        if predicate != TYPE:
            return super().triples_with(predicate, term)
        mine = [m for m in self.mappings if m.typed and term_row(term) == ("iri", BASE + (m.cls or m.table), None, None)]
        # rdf:type as data of its own, where a mapping has it as a column
        mine += [replace(m, typed=False) for m in self.mappings if any(c.iri_of == TYPE for c in m.columns)]
        return Graph.triples_with(MappedGraph(self._spark, self.tables, mine), predicate, term)

    def subjects(self) -> DataFrame:
        out = None
        for m in self.mappings:
            one = self.tables[m.table].select(F.expr(m.subject).alias("s"))
            out = one if out is None else out.unionByName(one)
        return out

    def about(self, nodes: DataFrame) -> MappedGraph:
        """Only tables that describe such subjects are read."""
        spaces = list(dict.fromkeys(m.about or m.table for m in self.mappings))
        found = self._any(nodes, [F.col("node").startswith(f"<{BASE}{x}/") for x in spaces])
        mine = {x for x, there in zip(spaces, found, strict=True) if there}
        return MappedGraph(self._spark, self.tables, [m for m in self.mappings if (m.about or m.table) in mine])

    def leading_to(self, nodes: DataFrame) -> MappedGraph:
        """Only columns whose values can be such objects are read: links by their table, literals by their quotes; a class is one IRI."""
        node = F.col("node")
        tests = {"iri": node.startswith("<"), "literal": node.startswith('"')}
        tests |= {("link", c.to.table): node.startswith(f"<{BASE}{c.to.table}/") for m in self.mappings for c in m.columns if c.to is not None}
        tests |= {("class", m.cls or m.table): node == f"<{BASE}{m.cls or m.table}>" for m in self.mappings if m.typed}
        found = {k for k, there in zip(tests, self._any(nodes, list(tests.values())), strict=True) if there}
        kind = lambda c: ("link", c.to.table) if c.to is not None else "iri" if c.iri else "literal"
        mine = [replace(m, columns=[c for c in m.columns if kind(c) in found], typed=m.typed and ("class", m.cls or m.table) in found) for m in self.mappings]
        return MappedGraph(self._spark, self.tables, [m for m in mine if m.columns or m.typed])

    def _any(self, nodes: DataFrame, tests: list[Column]) -> list[bool]:
        """Whether some node passes each test: one row of answers."""
        if not tests:
            return []
        return [bool(x) for x in nodes.agg(*(F.max(x).alias(f"t{i}") for i, x in enumerate(tests))).first()]

    def _distinct(self, table: DataFrame, m: TableMapping, cols: list[Column_], kinds: dict) -> DataFrame:
        """Triples that several rows give: keys and values are made distinct before terms are built of them, so narrow rows are shuffled."""
        each = table.select(F.expr(m.key).alias("_k"), F.posexplode(F.array(*(self._value(c, kinds) for c in cols))).alias("_i", "_v"))
        rows = each.where("_v IS NOT NULL").distinct()
        objects = [self._object(c, kinds, F.col("_v")) for c in cols]
        subject = F.expr(replace(m, key="_k").subject)
        return rows.select(subject.alias("s"), *(_pick([o[k] for o in objects], "_i").alias(name) for k, name in enumerate(_OBJECT)))

    def _raw(self, c: Column_) -> Column:
        return F.expr(c.expr or f"`{c.name}`")

    def _value(self, c: Column_, kinds: dict) -> Column:
        """A column's value as text."""
        value = self._raw(c)
        if c.expr is None and kinds.get(c.name) == "timestamp" and c.to is None and not c.iri and c.lang is None:
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        return value.cast("string")

    def _object(self, c: Column_, kinds: dict, value: Column) -> tuple[Column, ...]:
        p = F.lit(c.iri_of)
        if c.to is not None:
            return _object_of(p, "iri", F.when(value.isNotNull(), F.concat(F.lit(f"{BASE}{c.to.table}/"), value)), None, None)
        if c.iri:
            return _object_of(p, "iri", value, None, None)
        if c.lang is not None:
            return _object_of(p, "literal", value, RDF + "langString", F.col(c.lang))
        kind = "string" if c.expr else kinds.get(c.name, "string")
        return _object_of(p, "literal", value, c.dt or XSD + DATATYPES.get(kind, "string"), None)


_OBJECT = ("p", "o_kind", "o_lex", "o_dt", "o_lang")


def _object_of(p: Column, kind: str, lex: Column, dt: str | None, lang: Column | None) -> tuple[Column, ...]:
    """Predicate and object of a triple, as ``_OBJECT`` names them."""
    none = F.lit(None).cast("string")
    return (
        p.alias("p"), F.lit(kind).alias("o_kind"), lex.alias("o_lex"),
        (F.lit(dt) if dt else none).alias("o_dt"), (none if lang is None else lang).alias("o_lang"),
    )


def _pick(values: list[Column], at: str = "_i_") -> Column:
    """The value whose number stands in a column."""
    out = F.when(F.col(at) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col(at) == i, v)
    return out
