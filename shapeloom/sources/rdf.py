"""RDF files as graphs: N-Triples by lines; Turtle by blocks (``splits``); RDF/XML and JSON-LD by files."""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import TRIPLES, escaped, literal_id, term_at, term_id, term_row
from ..plans.storage import spread
from ..schema.ast import RDF, XSD, BNode, Iri, Literal, SchemaError, resolve_iri
from ..schema.shexc import Tokens, unescape
from . import jsonld, rdfxml
from .graph import Graph

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s.]\S*)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*\.\s*(?:#.*)?$'

#: Groups of a line in the order they are cut out in, and what parts them: no group but the text may hold both a newline and a closing bracket before it.
_PARTS, _CUT = (1, 2, 3, 4, 6, 7, 5), ">\n>"


def _unescape(c):
    """N-Triples escapes, each decoded once from left to right: the text is cut at escapes and put together again."""
    parts = F.regexp_extract_all(c, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))
    code = lambda x: F.conv(F.substr(x, F.lit(3)), 16, 10).cast("long")
    # four bytes of big-endian UTF-32, read back as text
    letter = lambda x: F.decode(F.unhex(F.lpad(F.hex(code(x)), 8, "0")), "UTF-32")
    plain = F.create_map(*(F.lit(y) for pair in (("\\t", "\t"), ("\\b", "\b"), ("\\n", "\n"), ("\\r", "\r"), ("\\f", "\f")) for y in pair))
    one = lambda x: F.when(~x.startswith("\\"), x).when(x.rlike(r"^\\[uU]."), letter(x)).otherwise(F.coalesce(F.try_element_at(plain, x), F.substr(x, F.lit(2))))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def ntriples_lines(lines: DataFrame, scope=None) -> DataFrame:
    """Triples of N-Triples lines (column ``value``); blank nodes are named apart per ``scope``; other lines are dropped if blank or comments, else raise."""
    scope = F.lit("") if scope is None else scope
    # the line is matched once: its parts follow each other, the text last, parted by what none before it can hold
    parts = F.split(F.regexp_replace("value", _LINE, _CUT.join(f"${i}" for i in _PARTS)), _CUT, len(_PARTS))
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$")).withColumn("_parts", parts)
    raw = lambda i: F.get("_parts", F.lit(_PARTS.index(i)))
    part = lambda i: F.nullif(raw(i), F.lit(""))
    name = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("_:"), scope, F.substr(c, F.lit(3)))).otherwise(c)
    ok = F.when(F.size("_parts") == len(_PARTS), part(1)).otherwise(F.raise_error(F.concat(F.lit("no N-Triples line: "), F.col("value"))))
    literal = part(3).isNull() & part(4).isNull()
    iri_empty = (raw(3) == "") & (raw(4) == "") & (raw(5) == "") & F.col("value").rlike(r"^\s*(?:<[^>]*>|_:\S+)\s+<[^>]*>\s+<>")
    return rows.select(
        name(_unescape(ok)).alias("s"), _unescape(part(2)).alias("p"),
        F.when(part(3).isNotNull() | iri_empty, "iri").when(part(4).isNotNull(), "bnode").otherwise("literal").alias("o_kind"),
        F.coalesce(_unescape(part(3)), name(part(4)), F.when(iri_empty, ""), _unescape(raw(5))).alias("o_lex"),
        F.when(literal & ~iri_empty, F.when(part(7).isNotNull(), RDF + "langString").otherwise(F.coalesce(_unescape(part(6)), F.lit(XSD + "string")))).alias("o_dt"),
        part(7).alias("o_lang"),
    )


def read_ntriples(spark: SparkSession, path: str, base: str | None = None) -> Graph:
    """Lines of any number of files, split as text; a file's hash names its blank nodes."""
    return Graph(ntriples_lines(spark.read.text(path), F.concat(_scope(), F.lit("_"))))


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One line of text (``value``) a triple."""
    # ids have languages in lower case
    o = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit('"'), escaped(F.col("o_lex")), F.lit('"@'), F.col("o_lang"))).otherwise(term_id(term_at()))
    return triples.select(F.concat(F.col("s"), F.lit(" <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("value"))


def to_turtle(triples: DataFrame) -> DataFrame:
    """One Turtle document (name, value) a subject, predicates and objects grouped; ``name`` is the subject."""
    o = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit('"'), escaped(F.col("o_lex")), F.lit('"@'), F.col("o_lang"))).otherwise(term_id(term_at()))
    p = F.when(F.col("p") == RDF + "type", F.lit("a")).otherwise(F.concat(F.lit("<"), F.col("p"), F.lit(">")))
    of_predicate = triples.select("s", p.alias("p"), o.alias("o")).groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("o"))
    part = F.concat(F.lit("    "), F.col("p"), F.lit(" "), F.array_join("o", " , "))
    whole = of_predicate.select("s", part.alias("t")).groupBy("s").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select(F.col("s").alias("name"), F.concat(F.col("s"), F.lit("\n"), F.array_join("t", " ;\n"), F.lit(" .\n")).alias("value"))


def _scope():
    """128 bits of the file's name."""
    return F.concat(F.lit("b"), F.md5(F.input_file_name()))


def of_documents(documents: DataFrame, parse) -> Graph:
    """Triples of documents (name, value) with a state of their own (prefixes, nesting): one is a unit of work, many go in parallel.

    Blank nodes are named apart by ``name``.
    """
    names = [c.split()[0] for c in TRIPLES.split(", ")]

    def triples(frames):
        for pdf in frames:
            for name, text in zip(pdf["name"], pdf["value"], strict=True):
                for s, p, o in parse(text):
                    yield literal_id(_scope_term(s, name)), p, *term_row(_scope_term(o, name))

    def run(frames):
        import pandas as pd

        rows = triples(frames)
        # full frames, however few triples a document has: a frame costs more than parsing a small document
        while part := list(islice(rows, 10_000)):
            yield pd.DataFrame(part, columns=names)

    return Graph(spread(documents.select("name", "value"), "name").mapInPandas(run, TRIPLES))


def _read_whole(spark: SparkSession, path: str, parse) -> Graph:
    return of_documents(spark.read.text(path, wholetext=True).select(_scope().alias("name"), "value"), parse)


def read_turtle(spark: SparkSession, path: str, base: str | None = None) -> Graph:
    """Files of any size, each by many tasks."""
    from . import splits

    return splits.read_turtle(spark, path, base)


def read_rdfxml(spark: SparkSession, path: str, base: str | None = None) -> Graph:
    return _read_whole(spark, path, lambda text: rdfxml.parse(text, base))


def read_jsonld(spark: SparkSession, path: str, base: str | None = None) -> Graph:
    return _read_whole(spark, path, lambda text: jsonld.parse(text, base))


#: Reader by the name of a format.
READERS = {"ntriples": read_ntriples, "turtle": read_turtle, "rdfxml": read_rdfxml, "jsonld": read_jsonld}


def read(spark: SparkSession, path: str, form: str, base: str | None = None) -> Graph:
    if form not in READERS:
        raise ValueError(f"no format {form}; there are {', '.join(READERS)}")
    return READERS[form](spark, path, base)


def _scope_term(t, name: str):
    return BNode(f"_:{name}_{t.value[2:]}") if isinstance(t, BNode) else t


class Turtle:
    """Recursive descent over the shared tokens."""

    def __init__(self, text: str, base: str | None = None):
        text = re.sub(r"(?m)^\s*@(prefix|base)\b", r"\1", text)
        self.t, self.base, self.prefixes, self.out, self.n = Tokens(text), base, {}, [], 0

    def fresh(self) -> BNode:
        self.n += 1
        return BNode(f"_:anon{self.n}")

    def iri(self) -> str:
        kind, text = self.t.next()
        if kind == "iri":
            return resolve_iri(self.base, unescape(text[1:-1]))
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SchemaError(f"prefix {prefix}: is not declared")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        self.t.i -= 1
        self.t.fail("expected an IRI")

    def parse(self) -> list[tuple]:
        t = self.t
        while t.peek()[0] != "end":
            word = t.word()
            if word in ("prefix", "base") and t.peek(1)[0] in ("pname", "iri"):
                t.next()
                if word == "prefix":
                    name = t.next()[1][:-1]
                    self.prefixes[name] = self.iri()
                else:
                    self.base = self.iri()
                t.accept(".")
                continue
            if t.is_op("["):
                s = self.object()
                if not t.is_op("."):
                    self.predicates(s)
            else:
                s = self.object()
                if isinstance(s, Literal):
                    t.fail("a literal is no subject")
                self.predicates(s)
            t.expect(".")
        return self.out

    def predicates(self, s) -> None:
        t = self.t
        while True:
            if t.peek() == ("word", "a"):
                t.next()
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                self.out.append((s, p, self.object()))
                if not t.accept(","):
                    break
            while t.accept(";"):
                pass
            if t.is_op(".", "]") or t.peek()[0] == "end":
                return

    def object(self):
        t = self.t
        kind, text = t.peek()
        if kind in ("iri", "pname"):
            return Iri(self.iri())
        if kind == "bnode":
            t.next()
            return BNode(text)
        if t.accept("["):
            b = self.fresh()
            if not t.is_op("]"):
                self.predicates(b)
            t.expect("]")
            return b
        if t.accept("("):
            items = []
            while not t.accept(")"):
                items.append(self.object())
            head: Iri | BNode = Iri(RDF + "nil")
            for x in reversed(items):
                b = self.fresh()
                self.out += [(b, RDF + "first", x), (b, RDF + "rest", head)]
                head = b
            return head
        if kind in ("integer", "decimal", "double"):
            t.next()
            return Literal(text, XSD + kind)
        if kind == "word" and text in ("true", "false"):
            t.next()
            return Literal(text, XSD + "boolean")
        if kind in ("string", "long"):
            t.next()
            lex = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if t.peek()[0] == "langtag":
                return Literal(lex, RDF + "langString", t.next()[1][1:])
            if t.accept("^^"):
                return Literal(lex, self.iri())
            return Literal(lex)
        t.fail("expected a term")


def parse_turtle(text: str, base: str | None = None) -> list[tuple]:
    """(subject, predicate IRI, object) of a Turtle document."""
    return Turtle(text, base).parse()
