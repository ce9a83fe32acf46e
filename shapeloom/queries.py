"""Registered queries: one per operator, each over whole tables, with equivalent SQL.

The tables are seen as a graph by direct mapping (``GRAPH``), schemas are in
the compact syntax, and results carry integer keys and status strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import TRIPLES
from .operators import bags
from .operators import paths as pp
from .plans.validate import CONFORMANT, NONCONFORMANT
from .schema.ast import XSD
from .schema.shexc import parse
from .shapemap import maps
from .shapepath import mapping as schema_mapping
from .sources.graph import BASE, Column_, Graph, Link, MappedGraph, TableMapping, union

PREFIXES = f"""
PREFIX : <{BASE}>
PREFIX xsd: <{XSD}>
PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>
PREFIX region: <{BASE}region/>
PREFIX nation: <{BASE}nation/>
"""
NAMES = {"": BASE, "xsd": XSD, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "region": f"{BASE}region/", "nation": f"{BASE}nation/"}

C = Column_
_LINE_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

GRAPH = [
    TableMapping("region", "r_regionkey", [C("r_name")]),
    TableMapping("nation", "n_nationkey", [C("n_name"), C("n_regionkey", Link("region"))]),
    TableMapping("customer", "c_custkey", [C("c_name"), C("c_nationkey", Link("nation")), C("c_acctbal"), C("c_mktsegment")]),
    TableMapping("supplier", "s_suppkey", [C("s_name"), C("s_nationkey", Link("nation")), C("s_acctbal")]),
    TableMapping("part", "p_partkey", [C("p_name"), C("p_brand"), C("p_type"), C("p_size"), C("p_retailprice")]),
    TableMapping("orders", "o_orderkey", [C("o_custkey", Link("customer")), C("o_orderstatus"), C("o_totalprice"), C("o_orderdate"), C("o_orderpriority")]),
    # no columns of a line but all of them together identify it
    TableMapping("lineitem", f"concat(l_orderkey, '-', xxhash64({_LINE_COLUMNS}))", [C("l_orderkey", Link("orders")), C("l_partkey", Link("part")), C("l_quantity"), C("l_returnflag"), C("l_linestatus")]),
    # what an order's lines say, as values of the order
    TableMapping("lineitem", "l_orderkey", [C("line_flag", expr="l_returnflag"), C("line_status", expr="l_linestatus"), C("line_no", expr="l_linenumber", dt=XSD + "integer")], about="orders", typed=False, distinct=True),
    TableMapping("events", "event_id", [C("event_type"), C("value"), C("user_id"), C("k", expr="get_json_object(props, '$.k')", dt=XSD + "integer")]),
    TableMapping("documents", "doc_id", [C("text", lang="lang"), C("source")]),
    TableMapping("labels", "doc_id", [C("toxic"), C("quality")], about="documents", typed=False),
    TableMapping("pages", "page_id", [C("url", iri=True)]),
    TableMapping("conversations", "concat(conv_id, '-', turn)", [C("role"), C("prev", Link("conversations"), expr="if(turn > 0, concat(conv_id, '-', turn - 1), null)"), C("conv", expr="conv_id", dt=XSD + "integer")]),
]


class _Tables(dict):
    """Tables of a folder, opened when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def graph(spark: SparkSession, sf_dir: str, mappings: list[TableMapping] | None = None) -> MappedGraph:
    return MappedGraph(spark, _Tables(spark, sf_dir), GRAPH if mappings is None else mappings)


def key_of(node: str = "node"):
    return F.regexp_extract(node, r"/(-?[0-9]+)>$", 1).cast("long")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def _register(name: str, query, sql: str | None) -> None:
    _QUERIES[name] = query
    if sql:
        _ORACLE[name] = sql


def _case(condition: str) -> str:
    return f"CASE WHEN {condition} THEN '{CONFORMANT}' ELSE '{NONCONFORMANT}' END AS status"


def validation(name: str, shape_map: str, schema: str, sql: str, key: str, mappings=None, columns=None) -> None:
    """A query that runs a shape map and returns (key, status)."""

    def query(spark, sf_dir):
        result = maps.run(graph(spark, sf_dir, mappings), parse(PREFIXES + schema), maps.parse(shape_map, BASE, NAMES, BASE, NAMES))
        return result.select(*(columns() if columns else (key_of().alias(key), "status")))

    _register(name, query, sql)


# node constraints

validation("node_kind_iri_literal", "{FOCUS rdf:type :orders}@:S", ":S { :o_custkey IRI ; :o_totalprice LITERAL ; :o_orderstatus LITERAL }", f"SELECT o_orderkey, {_case('o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL')} FROM orders", "o_orderkey")
validation("datatype_integer", "{FOCUS rdf:type :events}@:S", ":S { :k xsd:integer ; :value xsd:double }", f"""SELECT event_id, {_case("regexp_full_match(json_extract_string(props, '$.k'), '[+-]?[0-9]+') AND value IS NOT NULL")} FROM events""", "event_id")
validation("value_set_strings", "{FOCUS rdf:type :orders}@:S", ':S { :o_orderstatus ["F" "O"] }', f"SELECT o_orderkey, {_case("o_orderstatus IN ('F', 'O')")} FROM orders", "o_orderkey")
validation("language_stem", "{FOCUS rdf:type :documents}@:S", ":S { :text [@en~ @fr~] }", f"""SELECT doc_id, {_case("lower(lang) IN ('en', 'fr') OR starts_with(lower(lang), 'en-') OR starts_with(lower(lang), 'fr-')")} FROM documents""", "doc_id")
validation("language_stem_range", "{FOCUS rdf:type :documents}@:S", ":S { :text [. - @en - @de~] }", f"""SELECT doc_id, {_case("lang IS NOT NULL AND lower(lang) <> 'en' AND NOT (lower(lang) = 'de' OR starts_with(lower(lang), 'de-'))")} FROM documents""", "doc_id")
validation("iri_stem", "{FOCUS rdf:type :pages}@:S", ":S { :url [<http://t>~] }", f"SELECT page_id, {_case('starts_with(url, ' + repr('http://t') + ')')} FROM pages", "page_id")
validation("iri_stem_range_exclusion", "{FOCUS rdf:type :pages}@:S", ":S { :url [<http://>~ - <http://th>~] }", f"SELECT page_id, {_case('starts_with(url, ' + repr('http://') + ') AND NOT starts_with(url, ' + repr('http://th') + ')')} FROM pages", "page_id")
validation("literal_stem_range", "{FOCUS rdf:type :part}@:S", ':S { :p_type ["S"~ - "ST"~ "PROMO"] }', f"""SELECT p_partkey, {_case("(starts_with(p_type, 'S') AND NOT starts_with(p_type, 'ST')) OR p_type = 'PROMO'")} FROM part""", "p_partkey")
validation("string_length_facets", "{FOCUS rdf:type :part}@:S", ":S { :p_name MINLENGTH 9 MAXLENGTH 11 }", f"SELECT p_partkey, {_case('length(p_name) BETWEEN 9 AND 11')} FROM part", "p_partkey")
validation("pattern_facet", "{FOCUS rdf:type :part}@:S", ":S { :p_brand /^brand#1[0-9]$/i }", f"""SELECT p_partkey, {_case("regexp_matches(p_brand, '^brand#1[0-9]$', 'i')")} FROM part""", "p_partkey")
validation("numeric_range_facets", "{FOCUS rdf:type :customer}@:S", ":S { :c_acctbal xsd:double MININCLUSIVE 0 MAXEXCLUSIVE 5000.5 }", f"SELECT c_custkey, {_case('c_acctbal >= 0 AND c_acctbal < 5000.5')} FROM customer", "c_custkey")
validation("digits_facets", "{FOCUS rdf:type :part}@:S", ":S { :p_size TOTALDIGITS 1 FRACTIONDIGITS 0 }", f"SELECT p_partkey, {_case('p_size BETWEEN -9 AND 9')} FROM part", "p_partkey")

# boolean, triple expressions

validation("boolean_and_or_not", "{FOCUS rdf:type :customer}@:S", ':S (@:A OR @:B) AND NOT @:C  :A { :c_mktsegment ["BUILDING"] }  :B { :c_acctbal MININCLUSIVE 5000 }  :C { :c_nationkey [nation:1~] }', f"""SELECT c_custkey, {_case("(c_mktsegment = 'BUILDING' OR c_acctbal >= 5000) AND NOT starts_with(CAST(c_nationkey AS VARCHAR), '1')")} FROM customer""", "c_custkey")
validation("flat_shape", "{FOCUS rdf:type :orders}@:S", ':S { :o_orderstatus ["F" "O"] ; :o_totalprice MININCLUSIVE 1000 ; :o_custkey IRI }', f"""SELECT o_orderkey, {_case("o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000")} FROM orders""", "o_orderkey")
_FLAGGED = [*(m for m in GRAPH if m.table == "nation"), TableMapping("nation", "n_nationkey", [C("flag", expr="if(n_nationkey % 3 = 0, 'x', null)")], typed=False)]
validation("flat_closed", "{FOCUS rdf:type :nation}@:S", ":S CLOSED { rdf:type [:nation] ; :n_name . ; :n_regionkey IRI }", f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, {_case('n_nationkey % 3 <> 0')} FROM nation", "n_nationkey", _FLAGGED)
_FLAGS = "SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'A'), false) AS a, coalesce(bool_or(l_returnflag = 'N'), false) AS n, coalesce(bool_or(l_returnflag = 'R'), false) AS r, coalesce(bool_or(l_linestatus = 'F'), false) AS f, count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linestatus) AS statuses, count(DISTINCT l_linenumber) AS numbers, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"
validation("flat_extra", "{FOCUS rdf:type :orders}@:S", ':S EXTRA :line_flag { :line_flag ["R"] ; :line_no xsd:integer {2,5} }', f"SELECT o_orderkey, {_case('r AND numbers BETWEEN 2 AND 5')} FROM ({_FLAGS})", "o_orderkey")
validation("cardinality_star_plus_opt_range", "{FOCUS rdf:type :orders}@:S", ":S { :line_no . {3,} ; :line_flag . + ; :line_status . ? ; :o_orderstatus . ; :none . * }", f"SELECT o_orderkey, {_case('numbers >= 3 AND flags >= 1 AND statuses <= 1')} FROM ({_FLAGS})", "o_orderkey")
validation("inverse_path", "{FOCUS rdf:type :orders}@:S", ":S { ^:l_orderkey IRI {2,4} }", f"SELECT o_orderkey, {_case('lines BETWEEN 2 AND 4')} FROM ({_FLAGS})", "o_orderkey")
validation("negated_constraint", "{FOCUS rdf:type :orders}@:S", ':S { ! :line_flag ["R"] ; :o_custkey . }', f"SELECT o_orderkey, {_case('NOT r AND flags <= 1')} FROM ({_FLAGS})", "o_orderkey")
validation("each_of_group_repeat", "{FOCUS rdf:type :orders}@:S", ":S { ( :line_flag . ; :line_status . ){1,2} }", f"SELECT o_orderkey, {_case('flags = statuses AND flags BETWEEN 1 AND 2')} FROM ({_FLAGS})", "o_orderkey")
validation("one_of_choice", "{FOCUS rdf:type :orders}@:S", ':S EXTRA :line_flag :line_status { :line_flag ["R"] | :line_status ["F"] }', f"SELECT o_orderkey, {_case('r <> f')} FROM ({_FLAGS})", "o_orderkey")
validation("inclusion", "{FOCUS rdf:type :orders}@:S", ':T { $:e ( :o_orderstatus ["F"] ; :o_orderpriority . ) } :S { &:e ; :o_custkey IRI }', f"SELECT o_orderkey, {_case('o_orderstatus = ' + repr('F'))} FROM orders", "o_orderkey")
validation("ambiguous_predicate", "{FOCUS rdf:type :orders}@:S", ':S { :line_flag ["A" "N"] ; :line_flag ["N" "R"] ? }', f"SELECT o_orderkey, {_case('(a AND NOT (n AND r)) OR (NOT a AND n)')} FROM ({_FLAGS})", "o_orderkey")

# references, recursion, negation

validation(
    "shape_reference_chain",
    "{FOCUS rdf:type :orders}@:O",
    ":O { :o_custkey @:C } :C { :c_nationkey @:N ; :c_acctbal MININCLUSIVE 0 } :N { :n_regionkey [region:0 region:2] }",
    f"SELECT o_orderkey, {_case('c_acctbal >= 0 AND n_regionkey IN (0, 2)')} FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey",
    "o_orderkey",
)
_TURN = lambda: (F.regexp_extract("node", r"/([0-9]+)-", 1).cast("long").alias("conv_id"), F.regexp_extract("node", r"-([0-9]+)>$", 1).cast("long").alias("turn"), "status")
validation(
    "recursive_reference",
    "{FOCUS rdf:type :conversations}@:T",
    ':T { :role ["user" "assistant"] ; :prev @:T ? }',
    f"""WITH RECURSIVE t AS (
  SELECT conv_id, turn, role IN ('user', 'assistant') AS ok FROM conversations WHERE turn = 0
  UNION ALL SELECT c.conv_id, c.turn, t.ok AND c.role IN ('user', 'assistant') FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1
) SELECT conv_id, turn, {_case('ok')} FROM t""",
    "turn",
    columns=_TURN,
)
validation("stratified_negation", "{FOCUS rdf:type :orders}@:O", ':O { :o_custkey NOT @:Rich ; :o_orderstatus NOT ["P"] } :Rich { :c_acctbal MININCLUSIVE 3000 }', f"SELECT o_orderkey, {_case('NOT coalesce(c_acctbal >= 3000, false) AND o_orderstatus <> ' + repr('P'))} FROM orders LEFT JOIN customer ON c_custkey = o_custkey", "o_orderkey")
validation("start_shape", "{FOCUS rdf:type :region}@START", 'start = @:R  :R { :r_name ["A"~] }', f"SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, {_case('starts_with(r_name, ' + repr('A') + ')')} FROM region", "r_regionkey")
validation("non_conformant_expected", "{FOCUS rdf:type :nation}@!:S", ":S { :n_regionkey [region:1] }", f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, {_case('n_regionkey = 1')}, n_regionkey <> 1 AS as_expected FROM nation", "n_nationkey", columns=lambda: (key_of().alias("n_nationkey"), "status", "as_expected"))

# inheritance

validation("extends_flat", "{FOCUS rdf:type :orders}@:B", ':A { :o_totalprice MININCLUSIVE 1000 } :B EXTENDS @:A { :o_orderstatus ["F"] }', f"SELECT o_orderkey, {_case('o_totalprice >= 1000 AND o_orderstatus = ' + repr('F'))} FROM orders", "o_orderkey")
validation("extends_partition", "{FOCUS rdf:type :orders}@:B", ':A { :line_flag ["A" "N"] } :B EXTENDS @:A { :line_flag ["N" "R"] }', f"SELECT o_orderkey, {_case('flags = 2 AND NOT (a AND n AND r) AND (a OR n) AND (n OR r)')} FROM ({_FLAGS})", "o_orderkey")
validation("abstract_descendants", "{FOCUS rdf:type :orders}@:A", 'ABSTRACT :A { :o_totalprice MININCLUSIVE 1000 } :B EXTENDS @:A { :o_orderstatus ["F"] } :C EXTENDS @:A { :o_orderstatus ["O"] ; :o_orderpriority ["1"~ "2"~] }', f"""SELECT o_orderkey, {_case("o_totalprice >= 1000 AND (o_orderstatus = 'F' OR (o_orderstatus = 'O' AND left(o_orderpriority, 1) IN ('1', '2')))")} FROM orders""", "o_orderkey")


def target_declarations(spark, sf_dir):
    declared = TableMapping("nation", "'Named'", [C("target", Link("nation"), expr="if(n_nationkey % 2 = 0, n_nationkey, null)", predicate="http://www.w3.org/ns/shacl#targetNode")], about="shapes", typed=False)
    g = graph(spark, sf_dir, [*(m for m in GRAPH if m.table == "nation"), declared])
    return maps.run_targets(g, parse(PREFIXES + f"<{BASE}shapes/Named> {{ :n_regionkey [region:1 region:2] }}")).select(key_of().alias("n_nationkey"), "status")


_register("target_declarations", target_declarations, f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, {_case('n_regionkey IN (1, 2)')} FROM nation WHERE n_nationkey % 2 = 0")

# selectors and paths


def selection(name: str, selector: str, sql: str, key: str) -> None:
    def query(spark, sf_dir):
        a = maps.parse(f"{selector}@:S", BASE, NAMES, BASE, NAMES)[0]
        return maps.select(graph(spark, sf_dir), a.selector).select(key_of().alias(key))

    _register(name, query, sql)


selection("selector_focus_subject", "{FOCUS :o_custkey _}", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL", "o_orderkey")
selection("selector_focus_object", "{_ :o_custkey FOCUS}", "SELECT DISTINCT o_custkey AS c_custkey FROM orders", "c_custkey")
selection("selector_triple_value", '{FOCUS :o_orderstatus "F"}', "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", "o_orderkey")
selection("selector_subject_given", "{nation:3 :n_regionkey FOCUS}", "SELECT CAST(n_regionkey AS BIGINT) AS r_regionkey FROM nation WHERE n_nationkey = 3", "r_regionkey")
selection("path_sequence", "{FOCUS :c_nationkey/:n_regionkey region:1}", "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1", "c_custkey")
selection("path_alternative", "{FOCUS :c_nationkey|:s_nationkey nation:7}", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 7 UNION ALL SELECT s_suppkey FROM supplier WHERE s_nationkey = 7", "k")
selection("path_inverse", "{region:2 ^:n_regionkey/^:c_nationkey FOCUS}", "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2", "c_custkey")


def sql_selector(spark, sf_dir):
    query = f"SELECT s FROM triples WHERE p = '{BASE}n_regionkey' AND o_lex = '{BASE}region/4'"
    return maps.select(graph(spark, sf_dir, [m for m in GRAPH if m.table == "nation"]), maps.Sql(query)).select(key_of().alias("n_nationkey"))


_register("selector_sql", sql_selector, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_regionkey = 4")


def _closure_query(path):
    def query(spark, sf_dir):
        pairs = pp.pairs(graph(spark, sf_dir, [m for m in GRAPH if m.table == "conversations"]), path)
        pairs = pairs.where(F.col("start").contains("/conversations/") & F.col("node").contains("/conversations/"))
        return pairs.groupBy(F.regexp_extract("start", r"/([0-9]+)-", 1).cast("long").alias("conv_id"), F.regexp_extract("start", r"-([0-9]+)>$", 1).cast("long").alias("turn")).agg(F.count("*").alias("reached"))

    return query


_PREV = pp.Step(BASE + "prev")
_register("path_plus", _closure_query(pp.Closure(_PREV)), "SELECT conv_id, turn, turn AS reached FROM conversations WHERE turn > 0")
_register("path_star", _closure_query(pp.Closure(_PREV, True)), "SELECT conv_id, turn, turn + 1 AS reached FROM conversations")
_register("path_optional", _closure_query(pp.Maybe(_PREV)), "SELECT conv_id, turn, CAST(CASE WHEN turn > 0 THEN 2 ELSE 1 END AS BIGINT) AS reached FROM conversations")

# graph access


def _arcs_of(spark, sf_dir):
    """All outgoing and incoming arcs of every nation, by direction and predicate."""
    g = graph(spark, sf_dir)
    nations = maps.all_of_type(g, BASE + "nation").select("node")
    counts = g.neighbours(nations).groupBy("node", "direction", "p").agg(F.count("*").alias("n"))
    return counts.groupBy(key_of().alias("n_nationkey"), "direction", F.regexp_extract("p", r"([^/#]+)$", 1).alias("predicate")).agg(F.sum("n").alias("arcs"))


_register(
    "neighbourhood",
    _arcs_of,
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'out' AS direction, unnest(['n_name', 'n_regionkey', 'type']) AS predicate, CAST(1 AS BIGINT) AS arcs FROM nation"
    " UNION ALL SELECT CAST(c_nationkey AS BIGINT), 'in', 'c_nationkey', count(*) FROM customer GROUP BY c_nationkey UNION ALL SELECT CAST(s_nationkey AS BIGINT), 'in', 's_nationkey', count(*) FROM supplier GROUP BY s_nationkey",
)


def direct_mapping(spark, sf_dir):
    """Triples of all mapped tables, by predicate."""
    counts = graph(spark, sf_dir).triples().groupBy("p").agg(F.count("*").alias("n"))
    return counts.groupBy(F.regexp_extract("p", r"([^/#]+)$", 1).alias("predicate")).agg(F.sum("n").alias("triples"))


#: Columns that are mapped as they are, by table; the others are spelled out below.
_PLAIN = {m.table: [c.name for c in m.columns if not c.expr] for m in GRAPH if m.typed} | {"labels": ["toxic", "quality"]}
_register(
    "direct_mapping",
    direct_mapping,
    " UNION ALL ".join(f"SELECT '{c}' AS predicate, count({c}) AS triples FROM {t}" for t, cs in _PLAIN.items() for c in cs)
    + " UNION ALL SELECT 'type', " + " + ".join(f"(SELECT count(*) FROM {m.table})" for m in GRAPH if m.typed)
    + "".join(f" UNION ALL SELECT '{p}', count(*) FROM (SELECT DISTINCT l_orderkey, {c} FROM lineitem WHERE {c} IS NOT NULL)" for p, c in (("line_flag", "l_returnflag"), ("line_status", "l_linestatus"), ("line_no", "l_linenumber")))
    + " UNION ALL SELECT 'k', count(json_extract_string(props, '$.k')) FROM events UNION ALL SELECT 'prev', count(*) FROM conversations WHERE turn > 0 UNION ALL SELECT 'conv', count(conv_id) FROM conversations",
)

# result maps

_STATUS = parse(PREFIXES + ':F { :o_orderstatus ["F"] } :P { :o_totalprice MININCLUSIVE 100000 }')


def _status_map(spark, sf_dir, label, selector="{FOCUS rdf:type :orders}"):
    return maps.run(graph(spark, sf_dir), _STATUS, maps.parse(f"{selector}@{label}", BASE, NAMES, BASE, NAMES))


def shape_map_merge(spark, sf_dir):
    """A query map whose selectors overlap becomes one row per node and shape."""
    text = '{FOCUS :o_orderstatus "F"}@:F, {FOCUS :o_orderstatus "O"}@:F, {FOCUS :o_orderstatus _}@:F'
    rows = maps.fixed(graph(spark, sf_dir), maps.parse(text, BASE, NAMES, BASE, NAMES))
    return rows.select(key_of().alias("o_orderkey"), "status")


_register("shape_map_merge", shape_map_merge, f"SELECT o_orderkey, '{CONFORMANT}' AS status FROM orders")


def result_map_compare(spark, sf_dir):
    a = _status_map(spark, sf_dir, ":F").withColumn("shape", F.lit("x"))
    b = _status_map(spark, sf_dir, ":P").withColumn("shape", F.lit("x"))
    return maps.compare(a, b).select(key_of().alias("o_orderkey"), "status_a", "status_b")


_register("result_map_compare", result_map_compare, f"SELECT o_orderkey, CASE WHEN f THEN '{CONFORMANT}' ELSE '{NONCONFORMANT}' END AS status_a, CASE WHEN p THEN '{CONFORMANT}' ELSE '{NONCONFORMANT}' END AS status_b FROM (SELECT o_orderkey, o_orderstatus = 'F' AS f, o_totalprice >= 100000 AS p FROM orders) WHERE f <> p")


def conformance_summary(spark, sf_dir):
    both = _status_map(spark, sf_dir, ":F").unionByName(_status_map(spark, sf_dir, ":P"))
    return maps.summary(both).withColumn("shape", F.regexp_extract("shape", r"([^/]+)$", 1))


_register("conformance_summary", conformance_summary, "SELECT 'F' AS shape, count(*) FILTER (o_orderstatus = 'F') AS conformant, count(*) FILTER (o_orderstatus <> 'F') AS nonconformant FROM orders UNION ALL SELECT 'P', count(*) FILTER (o_totalprice >= 100000), count(*) FILTER (o_totalprice < 100000) FROM orders")


def result_rendering(spark, sf_dir):
    return maps.render(_status_map(spark, sf_dir, ":F"), "compact")


_register("result_rendering", result_rendering, f"SELECT '<{BASE}orders/' || o_orderkey || '>@' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '!' END || '<{BASE}F>' AS value FROM orders")

# bags


def bag_union_intersection(spark, sf_dir):
    """Bags of flags of odd and of even lines, per order: sizes of their union and intersection."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    odd, even = (bags.of(line.where(F.col("l_linenumber") % 2 == r), ["l_orderkey"], "l_returnflag") for r in (1, 0))
    u = bags.union(odd, even, ["l_orderkey"]).groupBy("l_orderkey").agg(F.sum("n").alias("in_union"))
    i = bags.intersection(odd, even, ["l_orderkey"]).groupBy("l_orderkey").agg(F.sum("n").alias("in_both"))
    return u.join(i, "l_orderkey", "left").select("l_orderkey", "in_union", F.coalesce("in_both", F.lit(0)).cast("long").alias("in_both"))


_register(
    "bag_union_intersection",
    bag_union_intersection,
    "SELECT l_orderkey, CAST(sum(o + e) AS BIGINT) AS in_union, CAST(sum(least(o, e)) AS BIGINT) AS in_both FROM (SELECT l_orderkey, l_returnflag, count(*) FILTER (l_linenumber % 2 = 1) AS o, count(*) FILTER (l_linenumber % 2 = 0) AS e FROM lineitem GROUP BY ALL) GROUP BY l_orderkey",
)

# schema mappings


def mapping_rename_predicate(spark, sf_dir):
    """The data side of a schema mapping: predicates renamed, then validated by the mapped schema."""
    schema = parse(PREFIXES + ':S { :o_orderstatus ["F"] ; :o_totalprice MININCLUSIVE 50000 }')
    rules = schema_mapping.parse(f"PREFIX : <{BASE}> /@:S/:o_orderstatus ~> <http://other.example/status>")
    g = graph(spark, sf_dir, [m for m in GRAPH if m.table == "orders"])
    renamed = Graph(schema_mapping.rename(g.df, rules), distinct=False)
    result = maps.run(renamed, schema_mapping.convert(schema, rules), maps.parse("{FOCUS rdf:type :orders}@:S", BASE, NAMES, BASE, NAMES))
    return result.select(key_of().alias("o_orderkey"), "status")


_register("mapping_rename_predicate", mapping_rename_predicate, f"SELECT o_orderkey, {_case('o_totalprice >= 50000 AND o_orderstatus = ' + repr('F'))} FROM orders")


def graph_union(spark, sf_dir):
    """Two graphs as one set of triples."""
    g = graph(spark, sf_dir, [m for m in GRAPH if m.table == "nation"])
    more = g.triples({BASE + "n_regionkey"}).select(F.col("s"), F.col("p"), *TRIPLES_OBJECT)
    both = union(g, Graph(more, distinct=False))
    return both.df.groupBy(key_of("s").alias("n_nationkey")).agg(F.count("*").alias("triples"))


TRIPLES_OBJECT = [c.split()[0] for c in TRIPLES.split(", ")][2:]
_register("graph_union", graph_union, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(3 AS BIGINT) AS triples FROM nation")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_forms as forms
    from . import queries_more as more
    from .wikibase import queries as wb

    return _QUERIES | forms.QUERIES | more.QUERIES | wb.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import queries_forms as forms
    from . import queries_more as more
    from .wikibase import queries as wb

    return _ORACLE | forms.ORACLE | more.ORACLE | wb.ORACLE
