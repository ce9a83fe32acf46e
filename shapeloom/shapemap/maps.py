"""Shape maps: which nodes to test against which shapes, and result maps."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import literal_id, resource, term_at, term_id, term_row
from ..operators import paths as pp
from ..plans.validate import CONFORMANT, NODE, NONCONFORMANT, validate
from ..plans.validate import evidence as explain
from ..schema.ast import RDF, START, BNode, Iri, Literal, Schema, SchemaError
from ..schema.shexc import PATH_TOKENS, Parser
from ..sources.graph import Graph

UNDEFINED = "undefined"
_NODE = ("node", "kind", "lex", "dt", "lang")


@dataclass(frozen=True)
class Node:
    term: object


@dataclass(frozen=True)
class Triples:
    """{subject path object}: FOCUS on one side; the other is a term, or None for any."""

    focus: str  # subject or object
    path: object
    other: object | None = None


@dataclass(frozen=True)
class Sql:
    """A Spark SQL query over the view ``triples`` that gives one column of node ids (the SPARQL selector's place)."""

    query: str


@dataclass(frozen=True)
class Generic:
    iri: str
    parameter: str


@dataclass(frozen=True)
class Association:
    selector: object
    label: str
    status: str = CONFORMANT


class _Maps(Parser):
    """Compact shape maps, on the tokens of the compact schema syntax."""

    def __init__(self, text: str, base=None, prefixes=None, shape_base=None, shape_prefixes=None):
        super().__init__(text, base, PATH_TOKENS)
        self.prefixes = dict(prefixes or {})
        self.own = (base, self.prefixes)
        self.shapes_of = (shape_base, dict(shape_prefixes or prefixes or {}))

    def parse(self) -> list[Association]:
        out, t = [], self.t
        while t.peek()[0] != "end":
            selector = self.selector()
            kind, text = t.peek()
            if kind == "langtag" and text.lower() == "@start":
                t.next()
                label, status = START, CONFORMANT
            else:
                t.expect("@")
                status = CONFORMANT
                if t.accept("!") or t.accept_word("not"):
                    status = NONCONFORMANT
                elif t.accept("?"):
                    status = UNDEFINED
                if t.word() == "start":
                    t.next()
                    label = START
                else:
                    self.base, self.prefixes = self.shapes_of
                    label = self.label()
                    self.base, self.prefixes = self.own
            out.append(Association(selector, label, status))
            if t.peek()[0] != "end":
                t.expect(",")
        return out

    def term(self):
        kind, text = self.t.peek()
        if kind == "bnode":
            self.t.next()
            return BNode(text)
        return self.literal() if self.is_literal() else Iri(self.iri())

    def selector(self):
        t = self.t
        if t.word() in ("sparql", "sql"):
            t.next()
            return Sql(self.string())
        if t.accept("{"):
            if t.accept_word("focus"):
                path = self.path()
                other = None if self._any() else self.term()
                out = Triples("subject", path, other)
            else:
                other = None if self._any() else self.term()
                path = self.path()
                if not t.accept_word("focus"):
                    t.fail("expected FOCUS")
                out = Triples("object", path, other)
            t.expect("}")
            return out
        term = self.term()
        if isinstance(term, Iri) and t.peek()[0] in ("string", "long"):
            return Generic(term.value, self.string())
        return Node(term)

    def _any(self) -> bool:
        return bool(self.t.accept_word("_"))

    def path(self):
        items = [self.path_sequence()]
        while self.t.accept("|"):
            items.append(self.path_sequence())
        return items[0] if len(items) == 1 else pp.Alternative(tuple(items))

    def path_sequence(self):
        items = [self.path_step()]
        while self.t.accept("/"):
            items.append(self.path_step())
        return items[0] if len(items) == 1 else pp.Sequence(tuple(items))

    def path_step(self):
        t = self.t
        inverse = bool(t.accept("^"))
        if t.accept("("):
            p = self.path()
            t.expect(")")
        else:
            p = pp.Step(self.predicate())
        if t.accept("*"):
            p = pp.Closure(p, True)
        elif t.accept("+"):
            p = pp.Closure(p)
        elif t.accept("?"):
            p = pp.Maybe(p)
        return pp.Inverse(p) if inverse else p


def _prepared(text: str) -> str:
    """``_`` and ``@<S>`` read as tokens of the schema syntax; ``@p:S`` is no language tag there either."""
    import re

    out, at = [], 0
    while at < len(text):
        if text[at] == "_" and not text.startswith("_:", at):
            out.append(" Q_Q ")
            at += 1
            continue
        m = PATH_TOKENS.match(text, at)
        if not m or m.end() == at:
            raise SchemaError(f"unexpected character at {at}: {text[at : at + 20]!r}")
        out.append(m[0])
        at = m.end()
    return re.sub(r" Q_Q ", " any_ ", "".join(out))


def parse(text: str, base=None, prefixes=None, shape_base=None, shape_prefixes=None) -> list[Association]:
    """Associations of a compact shape map."""
    p = _Maps(_prepared(text), base, prefixes, shape_base, shape_prefixes)
    p._any = lambda: bool(p.t.accept_word("any_"))  # type: ignore[method-assign]
    return p.parse()


def read(spark, source, base=None, prefixes=None, form: str = "compact") -> list[Association]:
    """A shape map from an open stream, an http(s) address, or a file of any file system that Spark reads; form: compact or json."""
    if hasattr(source, "read"):
        text = source.read()
        text = text.decode("utf-8") if isinstance(text, bytes) else text
    elif source.startswith(("http://", "https://")):
        from ..sources.endpoint import _fetch

        text = _fetch(source, "*/*", 60)
    else:
        text = "\n".join(r["value"] for r in spark.read.text(source, wholetext=True).collect())  # a map, not data
    return from_json(text, prefixes) if form == "json" else parse(text, base, prefixes, base, prefixes)


def show_path(path) -> str:
    """A property path in the compact syntax."""
    if isinstance(path, pp.Step):
        return f"<{path.predicate}>"
    if isinstance(path, pp.Inverse):
        return f"^{_grouped(path.path)}"
    if isinstance(path, pp.Sequence | pp.Alternative):
        return ("/" if isinstance(path, pp.Sequence) else "|").join(_grouped(p) for p in path.paths)
    if isinstance(path, pp.Closure):
        return _grouped(path.path) + ("*" if path.zero else "+")
    return f"{_grouped(path.path)}?"


def _grouped(path) -> str:
    return show_path(path) if isinstance(path, pp.Step) else f"({show_path(path)})"


def from_json(text: str, prefixes=None) -> list[Association]:
    """The JSON form: objects with node (a term, a pattern of subject, path and object, or a query), shape and status."""
    out = []
    for x in json.loads(text):
        node = x["node"]
        if isinstance(node, dict):
            node = f"SQL {json.dumps(node['sparql'])}" if "sparql" in node else f"{{{node['subject']} {node['path']} {node['object']}}}"
        label = x["shape"]
        label = START if label in ("START", "Start") else label[1:-1] if label.startswith("<") else label
        out.append(Association(parse(f"{node}@<x>", prefixes=prefixes)[0].selector, label, x.get("status", CONFORMANT)))
    return out


def to_json(associations: list[Association]) -> str:
    rows = []
    for a in associations:
        s = a.selector
        if isinstance(s, Node):
            node: object = literal_id(s.term)
        elif isinstance(s, Sql):
            node = {"sparql": s.query}
        elif isinstance(s, Triples):
            other = "_" if s.other is None else literal_id(s.other)
            node = {"subject": "FOCUS" if s.focus == "subject" else other, "path": show_path(s.path), "object": other if s.focus == "subject" else "FOCUS"}
        else:
            raise SchemaError("a generic selector has no JSON form")
        rows.append({"node": node, "shape": a.label, "status": a.status})
    return json.dumps(rows)


# selection --------------------------------------------------------------------


def select(graph: Graph, selector) -> DataFrame:
    """Distinct nodes (node, kind, lex, dt, lang) of a selector."""
    if isinstance(selector, Node):
        return graph.spark.createDataFrame([(literal_id(selector.term), *term_row(selector.term))], NODE)
    if isinstance(selector, Sql):
        graph.df.createOrReplaceTempView("triples")
        out = graph.spark.sql(selector.query)
        if len(out.columns) != 1:
            raise SchemaError("a query selector gives one column")
        r = resource(F.col("node"))
        ids = out.toDF("node").where("node is not null").distinct()
        return ids.select("node", r.kind.alias("kind"), r.lex.alias("lex"), r.dt.alias("dt"), r.lang.alias("lang"))
    if isinstance(selector, Generic):
        raise SchemaError(f"no generic selector {selector.iri}")
    path, other = selector.path, selector.other
    if selector.focus == "subject":
        if isinstance(path, pp.Step):  # no join: subjects of the predicate's triples
            t = graph.triples({path.predicate}) if other is None else graph.triples_with(path.predicate, other)
            r = resource(F.col("s"))
            # distinct by the id alone, of which the rest follows: rows lie by node then, and joins by node need not move them
            return t.select("s").distinct().select(F.col("s").alias("node"), r.kind.alias("kind"), r.lex.alias("lex"), r.dt.alias("dt"), r.lang.alias("lang"))
        if other is None:
            return pp.ends(graph, path)
        path = pp.Inverse(path)
    elif other is None:
        return pp.ends(graph, pp.Inverse(path))
    starts = graph.spark.createDataFrame([(literal_id(other),)], "start string")
    return pp.pairs(graph, path, starts).select(*_NODE).dropDuplicates(["node"])


def all_of_type(graph: Graph, cls: str) -> DataFrame:
    return select(graph, Triples("subject", pp.Step(RDF + "type"), Iri(cls)))


def targets(graph: Graph) -> DataFrame:
    """(node, shape) declared by sh:targetNode."""
    t = graph.triples({"http://www.w3.org/ns/shacl#targetNode"})
    return t.select(term_id(term_at()).alias("node"), F.col("o_kind").alias("kind"), F.col("o_lex").alias("lex"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"), F.regexp_replace("s", "^<|>$", "").alias("shape"))


def run(graph: Graph, schema: Schema, associations: list[Association], **options) -> DataFrame:
    """Result map of a query map: (node, shape, status, reason, as_expected)."""
    return validate(graph, schema, [(select(graph, a.selector), a.label, a.status) for a in associations], **options)


def evidence(graph: Graph, schema: Schema, associations: list[Association], **options) -> DataFrame:
    """Why the conforming nodes of a query map conform: (node, shape, part, constraint, predicate, inverse, target), one row per arc and shape that it serves in."""
    return explain(graph, schema, [(select(graph, a.selector), a.label) for a in associations], **options)


def run_targets(graph: Graph, schema: Schema, **options) -> DataFrame:
    """Result map of the graph's own target declarations, for the schema's shapes."""
    t = targets(graph)
    return validate(graph, schema, [(t.where(F.col("shape") == x).drop("shape").distinct(), x, CONFORMANT) for x in schema.labels], **options)


def fixed(graph: Graph, associations: list[Association]) -> DataFrame:
    """(node, shape, status) of a query map; contradictory expectations raise when the table is computed."""
    out = None
    for a in associations:
        one = select(graph, a.selector).select("node", F.lit(a.label).alias("shape"), F.lit(a.status).alias("status"))
        out = one if out is None else out.unionByName(one)
    return merge(out)


def merge(rows: DataFrame) -> DataFrame:
    """One row per (node, shape)."""
    g = rows.groupBy("node", "shape").agg(F.min("status").alias("status"), F.max("status").alias("_other"))
    clash = F.raise_error(F.concat(F.lit("contradictory statuses of "), F.col("node"), F.lit(" at "), F.col("shape")))
    return g.select("node", "shape", F.when(F.col("status") == F.col("_other"), F.col("status")).otherwise(clash).alias("status"))


# results ------------------------------------------------------------------------


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where two result maps differ, blank nodes aside: (node, shape, status_a, status_b)."""
    x = a.where(~F.col("node").startswith("_:")).select("node", "shape", F.col("status").alias("status_a"))
    y = b.where(~F.col("node").startswith("_:")).select("node", "shape", F.col("status").alias("status_b"))
    return x.join(y, ["node", "shape"], "full").where(~F.col("status_a").eqNullSafe(F.col("status_b")))


def summary(result: DataFrame) -> DataFrame:
    """(shape, conformant, nonconformant) counts."""
    return result.groupBy("shape").agg(F.count_if(F.col("status") == CONFORMANT).alias("conformant"), F.count_if(F.col("status") == NONCONFORMANT).alias("nonconformant"))


def all_conformant(result: DataFrame) -> bool:
    return result.where(F.col("status") != CONFORMANT).isEmpty()


def shapes_of(result: DataFrame, status: str = CONFORMANT) -> DataFrame:
    """(node, shapes): labels of that status per node."""
    return result.where(F.col("status") == status).groupBy("node").agg(F.array_sort(F.collect_set("shape")).alias("shapes"))


def render(result: DataFrame, form: str = "compact") -> DataFrame:
    """One text column ``value``: compact, details or json."""
    shape = F.when(F.col("shape") == START, F.lit("START")).otherwise(F.concat(F.lit("<"), F.col("shape"), F.lit(">")))
    mark = F.when(F.col("status") == CONFORMANT, "").when(F.col("status") == NONCONFORMANT, "!").otherwise("?")
    compact = F.concat(F.col("node"), F.lit("@"), mark, shape)
    if form == "compact":
        return result.select(compact.alias("value"))
    if form == "details":
        return result.select(F.concat_ws(" # ", compact, F.nullif(F.col("reason"), F.lit(""))).alias("value"))
    if form == "json":
        more = [c for c in ("appInfo",) if c in result.columns]  # what an application adds, as it is
        return result.select(F.to_json(F.struct("node", F.col("shape"), "status", "reason", *more)).alias("value"))
    raise ValueError(f"no form {form}")


def write(result: DataFrame, path: str, form: str = "compact") -> None:
    render(result, form).write.mode("overwrite").text(path)


