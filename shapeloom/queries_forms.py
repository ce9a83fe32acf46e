"""Registered queries of sources, schema forms, resolvers, actions, reasons and schema paths; each over whole tables, with equivalent SQL."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F

from .plans.storage import keep
from .plans.validate import Actions
from .queries import _FLAGS, GRAPH, NAMES, PREFIXES, _case, graph, key_of
from .schema import analyze, resolve, shexj, shexr
from .schema.ast import RDF, XSD, Iri, Schema, TripleConstraint
from .schema.shexc import parse
from .schema.show import show
from .shapemap import maps
from .shapepath import mapping as schema_path
from .sources import jsonld, rdf, rdfxml
from .sources.graph import BASE, Graph

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def _map(text: str):
    return maps.parse(text, BASE, NAMES, BASE, NAMES)


# sources: one document a customer, in each syntax, validated alike

_CUSTOMER = parse(PREFIXES + ":S { :c_name [@en~] ; :c_acctbal xsd:decimal MININCLUSIVE 0 ; :at { :nation [nation:1~] } }")
_ME, _NATION = f"{BASE}customer/", f"{BASE}nation/"
_BALANCE = "format_string('%.2f', c_acctbal)"

_DOCUMENTS = {
    "rdf_turtle": (
        f"""concat('PREFIX : <{BASE}> <{_ME}', c_custkey, '> :c_name "', c_name, '"@en ; :c_acctbal ', {_BALANCE}, ' ; :at [ :nation <{_NATION}', c_nationkey, '> ] .')""",
        rdf.parse_turtle,
    ),
    "rdf_xml": (
        f"""concat('<rdf:RDF xmlns:rdf="{RDF}" xmlns="{BASE}"><rdf:Description rdf:about="{_ME}', c_custkey, '"><c_name xml:lang="en">', c_name, '</c_name><c_acctbal rdf:datatype="{XSD}decimal">', {_BALANCE},
            '</c_acctbal><at rdf:parseType="Resource"><nation rdf:resource="{_NATION}', c_nationkey, '"/></at></rdf:Description></rdf:RDF>')""",
        rdfxml.parse,
    ),
    "rdf_jsonld": (
        f"""concat('{{"@context": {{"@vocab": "{BASE}", "nation": {{"@type": "@id"}}, "c_name": {{"@language": "en"}}, "c_acctbal": {{"@type": "{XSD}decimal"}}}}, "@id": "{_ME}', c_custkey, '", "c_name": "', c_name,
            '", "c_acctbal": "', {_BALANCE}, '", "at": {{"nation": "{_NATION}', c_nationkey, '"}}}}')""",
        jsonld.parse,
    ),
}


def _documents(text: str, parser):
    def query(spark, sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("b"), "c_custkey").alias("name"), F.expr(text).alias("value"))
        parsed = Graph(keep(rdf.of_documents(rows, parser).df), distinct=False)  # a validation reads it several times
        return maps.run(parsed, _CUSTOMER, _map("{FOCUS :c_name _}@:S")).select(key_of().alias("c_custkey"), "status")

    return query


for _name, (_text, _parser) in _DOCUMENTS.items():
    _add(_name, _documents(_text, _parser), f"SELECT c_custkey, {_case('round(c_acctbal, 2) >= 0 AND starts_with(CAST(c_nationkey AS VARCHAR), ' + repr('1') + ')')} FROM customer")


def rdf_ntriples(spark, sf_dir):
    """Lines with every kind of escape, back to terms."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.concat(F.lit(f"<{BASE}part/"), "p_partkey", F.lit(f"> <{BASE}na\\u006De> \"\\t\\\"\\\\\\u0041\\U0001F600"), "p_name", F.lit('\\b\\f\\n\\r"@en-GB .'))
    t = rdf.ntriples_lines(part.select(line.alias("value")))
    return t.where(F.col("p") == BASE + "name").select(key_of("s").alias("p_partkey"), F.col("o_lex").alias("lex"), F.length("o_lex").cast("long").alias("size"), F.col("o_lang").alias("lang"))


_add("rdf_ntriples", rdf_ntriples, "SELECT p_partkey, chr(9) || '\"\\A' || chr(128512) || p_name || chr(8) || chr(12) || chr(10) || chr(13) AS lex, CAST(length(p_name) + 9 AS BIGINT) AS size, 'en-GB' AS lang FROM part")


def ntriples_round_trip(spark, sf_dir):
    """Triples written as lines and read again are the same triples."""
    g = graph(spark, sf_dir, [m for m in GRAPH if m.table in ("part", "pages")])
    again = rdf.ntriples_lines(rdf.to_ntriples(g.df))
    return again.intersect(g.df).groupBy(F.regexp_extract("p", r"([^/#]+)$", 1).alias("predicate")).agg(F.count("*").alias("triples"))


_PART = ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")
_add("ntriples_round_trip", ntriples_round_trip, " UNION ALL ".join(f"SELECT '{c}' AS predicate, count({c}) AS triples FROM part" for c in _PART) + " UNION ALL SELECT 'url', count(url) FROM pages UNION ALL SELECT 'type', (SELECT count(*) FROM part) + (SELECT count(*) FROM pages)")


def triples_to_object(spark, sf_dir):
    """All triples of one object."""
    g = graph(spark, sf_dir)
    return g.triples_to(Iri(BASE + "nation/3")).groupBy(F.regexp_extract("p", r"([^/#]+)$", 1).alias("predicate")).agg(F.count("*").alias("triples"))


_add("triples_to_object", triples_to_object, "SELECT 'c_nationkey' AS predicate, count(*) AS triples FROM customer WHERE c_nationkey = 3 HAVING count(*) > 0 UNION ALL SELECT 's_nationkey', count(*) FROM supplier WHERE s_nationkey = 3 HAVING count(*) > 0")

# schema forms: written, read again, and then in use

_ORDER = ':S EXTRA :line_flag { :o_orderstatus ["F" "O"] ; :line_flag ["R"] ; ( :line_no xsd:integer MINEXCLUSIVE 0 {2,} | :none . ) } AND NOT { :o_orderpriority [ "1"~ - "1-U" ] }'
_ORDER_SQL = f"SELECT f.o_orderkey, {_case('o_orderstatus IN (' + repr('F') + ', ' + repr('O') + ') AND r AND numbers >= 2 AND NOT (starts_with(o_orderpriority, ' + repr('1') + ') AND o_orderpriority <> ' + repr('1-U') + ')')} FROM ({_FLAGS}) f JOIN orders o ON o.o_orderkey = f.o_orderkey"


def _schema_query(name: str, made, sql: str = _ORDER_SQL, of: str = "{FOCUS rdf:type :orders}@:S", key: str = "o_orderkey", **options) -> None:
    """A validation by a schema that ``made`` gives when the query runs."""

    def query(spark, sf_dir):
        more = {k: v() for k, v in options.items()}
        return maps.run(graph(spark, sf_dir), made(), _map(of), **more).select(key_of().alias(key), "status")

    _add(name, query, sql)


_schema_query("schema_compact_form", lambda: parse(show(parse(PREFIXES + _ORDER))))
_schema_query("schema_json_form", lambda: shexj.loads(shexj.dumps(parse(PREFIXES + _ORDER))))
_schema_query("schema_rdf_form", lambda: shexr.from_triples(shexr.to_triples(parse(PREFIXES + _ORDER))))


def _imported() -> Schema:
    texts = {"http://e/rest": 'IMPORT <http://e/more> :Rest { :o_orderstatus ["F"] }', "http://e/more": "IMPORT <http://e/rest> :More { :o_totalprice MININCLUSIVE 1000 }"}
    return resolve.closure(parse(PREFIXES + "IMPORT <http://e/rest> :S @:Rest AND @:More"), lambda iri: parse(PREFIXES + texts[iri]))


_schema_query("schema_imports", _imported, f"SELECT o_orderkey, {_case('o_orderstatus = ' + repr('F') + ' AND o_totalprice >= 1000')} FROM orders")
_schema_query(
    "external_resolver",
    lambda: parse(PREFIXES + ":S { :o_custkey @:X } :X EXTERNAL"),
    f"SELECT o_orderkey, {_case('coalesce(c_acctbal >= 2000, false)')} FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    resolver=lambda: lambda label: parse(PREFIXES + ":Y { :c_acctbal MININCLUSIVE 2000 }").shapes[0].expr,
)


def _actions() -> Actions:
    out = Actions()
    out.register("http://e/even", lambda code: F.col("lex").cast("double") % int(code) == 0)
    return out


_schema_query("semantic_actions", lambda: parse(PREFIXES + ":S { :o_totalprice . ; :o_custkey . ; :line_no . * %<http://e/even>{ 2 %} }"), f"SELECT o_orderkey, {_case('odd = 0')} FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_linenumber % 2 = 1) AS odd FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey".replace("odd = 0", "coalesce(odd, 0) = 0"), actions=_actions)
_schema_query("test_action_fails", lambda: parse(PREFIXES + 'PREFIX t: <http://shex.io/extensions/Test/> :S { :o_orderstatus ["F"] ? %t:{ fail(o) %} ; :o_orderstatus ["O" "P"] ? }'), f"SELECT o_orderkey, {_case('o_orderstatus <> ' + repr('F'))} FROM orders")
_schema_query("empty_shape", lambda: parse(PREFIXES + ":S { :o_custkey {} }"), f"SELECT o_orderkey, {_case('o_custkey IS NOT NULL')} FROM orders")
_schema_query("typed_literal_value", lambda: parse(PREFIXES + ':S { :p_size [ "5"^^xsd:integer 7 ] }'), f"SELECT p_partkey, {_case('p_size IN (5, 7)')} FROM part", "{FOCUS rdf:type :part}@:S", "p_partkey")
_schema_query("node_kind_nonliteral", lambda: parse(PREFIXES + ":S { :c_nationkey NONLITERAL ; :c_name NOT BNODE }"), f"SELECT c_custkey, {_case('c_nationkey IS NOT NULL AND c_name IS NOT NULL')} FROM customer", "{FOCUS rdf:type :customer}@:S", "c_custkey")
_schema_query("value_expression_parsed", lambda: parse(PREFIXES + ':S { :o_orderstatus ["F"] ; = 1 + 2 * 3 }'), f"SELECT o_orderkey, {_case('o_orderstatus = ' + repr('F'))} FROM orders")
_schema_query("explicit_nodes", lambda: parse(PREFIXES + ':S { :r_name ["A"~] }'), "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CASE WHEN starts_with(r_name, 'A') THEN 'conformant' ELSE 'nonconformant' END AS status FROM region WHERE r_regionkey IN (0, 2)", "region:0@:S, region:2@!:S", "r_regionkey")
# not a conjunction, and symbols share a path: the solver works with derivatives
_schema_query("bag_derivatives", lambda: parse(PREFIXES + ':S { ( :line_flag ["A"] | :line_flag ["N" "R"] {2} ) }'), f"SELECT o_orderkey, {_case('(a AND NOT n AND NOT r) OR (NOT a AND n AND r)')} FROM ({_FLAGS})")
_schema_query("extends_base_conditions", lambda: parse(PREFIXES + ':B { :line_flag ["A" "N"] } AND { :line_flag ["A" "R"] } :S EXTENDS @:B { :line_flag ["N" "R"] * }'), f"SELECT o_orderkey, {_case('a')} FROM ({_FLAGS})")
_schema_query("extends_base_reference", lambda: parse(PREFIXES + ':C { :line_flag ["A"] } :B @:C AND NOT { :line_status ["F"] } :S EXTENDS @:B { :line_status . * ; :line_flag ["N"] ? }'), f"SELECT o_orderkey, {_case('a AND NOT r')} FROM ({_FLAGS})")

# inheritance and analysis of one schema

_TREE = PREFIXES + 'ABSTRACT :A { :o_totalprice MININCLUSIVE 1000 } :B EXTENDS @:A { :o_orderstatus ["F"] } :C EXTENDS @:B RESTRICTS @:B { ^:l_orderkey . + } :D { :o_custkey NOT @:B ; :x @:D ? }'


def schema_analysis(spark, _):
    """What the analysis says of a schema: kinds of edges, closures, paths and cycles."""
    s = parse(_TREE)
    local = lambda x: x.rsplit("/", 1)[-1]
    rows = [("extends" if k == "extends" else k, local(a), local(b)) for a, edges in analyze.inheritance(s).items() for k, b in edges]
    rows += [("descendant", "A", local(x)) for x in analyze.descendants(s, BASE + "A")] + [("ancestor", "C", local(x)) for x in analyze.ancestors(s, BASE + "C")]
    rows += [("path", "C", ("^" if inverse else "") + local(p)) for p, inverse in analyze.paths(s, BASE + "C")]
    rows += [("depends", local(a), local(b) + ("+" if g > 0 else "-")) for a, edges in analyze.dependencies(s).items() for b, g in edges]
    bad = parse(PREFIXES + ":X { :p NOT @:Y } :Y { :q @:X } :Z { :p NOT @:W } :W { :p NOT @:Z }")
    rows += [("negative", "cycle", ",".join(map(local, c))) for c in analyze.negative_cycles(analyze.dependencies(bad))]
    rows += [("odd", "cycle", ",".join(map(local, c))) for c in analyze.odd_negative_cycles(analyze.dependencies(bad))]
    rows += [("mentioned", "schema", local(x)) for x in analyze.references(s)]
    return spark.createDataFrame(rows, "kind string, subject string, object string")


_add(
    "schema_analysis",
    schema_analysis,
    """SELECT * FROM (VALUES ('extends', 'B', 'A'), ('extends', 'C', 'B'), ('restricts', 'C', 'B'), ('descendant', 'A', 'B'), ('descendant', 'A', 'C'), ('ancestor', 'C', 'A'), ('ancestor', 'C', 'B'),
  ('path', 'C', 'o_totalprice'), ('path', 'C', 'o_orderstatus'), ('path', 'C', '^l_orderkey'), ('depends', 'B', 'A+'), ('depends', 'C', 'B+'), ('depends', 'D', 'B-'), ('depends', 'D', 'D+'),
  ('negative', 'cycle', 'X,Y'), ('negative', 'cycle', 'W,Z'), ('odd', 'cycle', 'X,Y'), ('mentioned', 'schema', 'A'), ('mentioned', 'schema', 'B'), ('mentioned', 'schema', 'D')) AS t(kind, subject, object)""",
)


def schema_differences(spark, _):
    """Which parts of two schemas differ, and whether forms of one are the same."""
    a = parse(PREFIXES + ":A { :p [1 'x'@en] } :B { :q . } :C { :r . }")
    b = parse(PREFIXES + "PREFIX n: <http://n/> start = @:A :C { :r . } :B { :q . + } :A { :p [1 'x'@EN] }")
    rows = [(x,) for x in analyze.difference(a, b)] + [("same" if analyze.same_schema(a, shexj.loads(shexj.dumps(a))) else "other",)]
    return spark.createDataFrame([(x.replace(BASE, ""),) for (x,) in rows], "difference string")


_add("schema_differences", schema_differences, "SELECT unnest(['prefix n: None / http://n/', 'start', 'shape B', 'same']) AS difference")

# reasons and maps


def failure_reasons(spark, sf_dir):
    """Why orders fail, as text."""
    s = parse(PREFIXES + ':S CLOSED { rdf:type . ; :o_orderstatus ["F"] ; :o_totalprice . {2} ; :o_custkey . ; :o_orderdate . ; :o_orderpriority . ; :line_flag . * ; :line_status . * ; :line_no . * }')
    r = maps.run(graph(spark, sf_dir), s, _map("{FOCUS rdf:type :orders}@:S"))
    return r.select(key_of().alias("o_orderkey"), F.replace("reason", F.lit(BASE), F.lit("")).alias("reason"))


_add("failure_reasons", failure_reasons, "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'an arc satisfies no constraint of its path; cardinality of o_orderstatus; ' ELSE '' END || 'cardinality of o_totalprice' AS reason FROM orders")


def shape_map_json(spark, sf_dir):
    """A map with a node, a pattern and a query, through its JSON form."""
    query = f"SELECT s FROM triples WHERE p = '{BASE}r_name' AND o_lex LIKE 'E%'"
    text = maps.to_json([*_map("region:1@:S, {FOCUS ^:n_regionkey nation:2}@:S"), maps.Association(maps.Sql(query), BASE + "S")])
    g = graph(spark, sf_dir, [m for m in GRAPH if m.table in ("region", "nation")])
    out = None
    for a, kind in zip(maps.from_json(text, NAMES), ("node", "pattern", "query"), strict=True):
        one = maps.select(g, a.selector).select(F.lit(kind).alias("kind"), key_of().alias("r_regionkey"))
        out = one if out is None else out.unionByName(one)
    return out


_add("shape_map_json", shape_map_json, "SELECT 'node' AS kind, CAST(1 AS BIGINT) AS r_regionkey UNION ALL SELECT 'pattern', CAST(n_regionkey AS BIGINT) FROM nation WHERE n_nationkey = 2 UNION ALL SELECT 'query', CAST(r_regionkey AS BIGINT) FROM region WHERE starts_with(r_name, 'E')")


def result_json(spark, sf_dir):
    """The JSON rendering of a result map, read again."""
    s = parse(PREFIXES + ':F { :o_orderstatus ["F"] }')
    lines = maps.render(maps.run(graph(spark, sf_dir), s, _map("{FOCUS rdf:type :orders}@:F")), "json")
    x = lines.select(F.from_json("value", "node string, shape string, status string, reason string").alias("x"))
    return x.select(key_of("x.node").alias("o_orderkey"), F.regexp_extract("x.shape", "([^/]+)$", 1).alias("shape"), "x.status")


_add("result_json", result_json, f"SELECT o_orderkey, 'F' AS shape, {_case('o_orderstatus = ' + repr('F'))} FROM orders")

# schema paths


def shape_path_constraint(spark, sf_dir):
    """The second constraint that a path finds says which triples are counted."""
    s = parse(PREFIXES + ":S { :o_orderstatus . ; :o_totalprice . } AND @:T :T { :o_custkey . }")
    path = schema_path.parse_path("/@:S/1/2", BASE, NAMES)
    found, errors = schema_path.evaluate(s, path)
    assert not errors and len(found) == 1 and isinstance(found[0], TripleConstraint)
    t = graph(spark, sf_dir, [m for m in GRAPH if m.table == "orders"]).triples({found[0].predicate})
    return t.select(key_of("s").alias("o_orderkey"), F.col("o_lex").cast("double").alias("o_totalprice"))


_add("shape_path_constraint", shape_path_constraint, "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")


def shape_path_replace(spark, sf_dir):
    """A constraint at a path replaced, then the schema in use."""
    s = parse(PREFIXES + ':S { :o_orderpriority ["F"] ; :o_totalprice . }')
    mapped = schema_path.convert(s, schema_path.parse(f"PREFIX : <{BASE}> /@:S/:o_orderpriority ~> :o_orderstatus"))
    return maps.run(graph(spark, sf_dir), mapped, _map("{FOCUS rdf:type :orders}@:S")).select(key_of().alias("o_orderkey"), "status")


_add("shape_path_replace", shape_path_replace, f"SELECT o_orderkey, {_case('o_orderstatus = ' + repr('F'))} FROM orders")


def relative_names(spark, sf_dir):
    """Nodes as prefixed names and back."""
    s = replace(parse(PREFIXES), base=None)
    names = [(i, s.relativise(f"{BASE}nation/{i}")) for i in range(25)]
    back = [(i, n, s.qualify(n)) for i, n in names]
    nodes = maps.all_of_type(graph(spark, sf_dir, [m for m in GRAPH if m.table == "nation"]), BASE + "nation")
    table = spark.createDataFrame(back, "k long, name string, iri string")
    return nodes.join(F.broadcast(table), F.col("lex") == F.col("iri")).select(F.col("k").alias("n_nationkey"), "name")  # 25 rows


_add("relative_names", relative_names, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'nation:' || n_nationkey AS name FROM nation")


def literal_values(spark, sf_dir):
    """Languages and language strings as values."""
    s = parse(PREFIXES + ":S { :text [@en @fr] }")
    g = graph(spark, sf_dir, [m for m in GRAPH if m.table == "documents"])
    return maps.run(g, s, _map("{FOCUS rdf:type :documents}@:S")).select(key_of().alias("doc_id"), "status")


_add("literal_values", literal_values, f"SELECT doc_id, {_case('text IS NOT NULL AND coalesce(lower(lang) IN (' + repr('en') + ', ' + repr('fr') + '), false)')} FROM documents")


def language_string_value(spark, sf_dir):
    """One text in one language as the value."""
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = docs.select(F.concat(F.lit(f"<{BASE}conversations/"), "turn", F.lit(">")).alias("s"), F.lit(BASE + "role").alias("p"), F.lit("literal").alias("o_kind"), F.col("role").alias("o_lex"), F.lit(RDF + "langString").alias("o_dt"), F.when(F.col("turn") % 2 == 0, "en").otherwise("EN-gb").alias("o_lang"))
    s = parse(PREFIXES + f":S {{ :role [ {json.dumps('user')}@EN 'assistant'@en-GB ] + }}")
    return maps.run(Graph(rows), s, _map("{FOCUS :role _}@:S")).select(key_of().alias("turn"), "status")


_add("language_string_value", language_string_value, f"SELECT turn, {_case('bool_and(CASE WHEN turn % 2 = 0 THEN role = ' + repr('user') + ' ELSE role = ' + repr('assistant') + ' END)')} FROM (SELECT CAST(turn AS BIGINT) AS turn, role FROM conversations) GROUP BY turn")

