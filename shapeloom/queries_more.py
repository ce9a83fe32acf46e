"""Registered queries of evidence, choices over bases, even negation, reachability and analysis of derived schemas; each over whole tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import paths as pp
from .operators import blanks, reach
from .plans.storage import folder, keep, spread
from .queries import _FLAGS, GRAPH, NAMES, PREFIXES, _case, graph, key_of
from .schema import analyze, shexj
from .schema.ast import XSD
from .schema.shexc import parse
from .shapemap import maps
from .shapepath import tables
from .sources import rdf
from .sources.graph import BASE

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def _map(text: str):
    return maps.parse(text, BASE, NAMES, BASE, NAMES)


def _validation(name: str, schema: str, sql: str, of: str = "{FOCUS rdf:type :orders}@:S", columns=None) -> None:
    def query(spark, sf_dir):
        result = maps.run(graph(spark, sf_dir), parse(PREFIXES + schema), _map(of))
        return result.select(*(columns() if columns else (key_of().alias("o_orderkey"), "status")))

    _add(name, query, sql)


# evidence: which constraint every arc serves


def assignment_evidence(spark, sf_dir):
    """Arcs by the constraint they serve, for every conforming order: two constraints share a path."""
    schema = parse(PREFIXES + ':S { :line_flag ["A" "N"] ; :line_flag ["N" "R"] ? ; ^:l_orderkey IRI + ; :o_custkey IRI }')
    rows = maps.evidence(graph(spark, sf_dir), schema, _map("{FOCUS rdf:type :orders}@:S"))
    return rows.groupBy(key_of().alias("o_orderkey"), "constraint", F.regexp_extract("predicate", r"([^/]+)$", 1).alias("predicate"), "inverse").agg(F.count_distinct("target").alias("arcs"), F.count("*").alias("served"))


_CONFORM = f"SELECT * FROM ({_FLAGS}) WHERE (a AND NOT (n AND r)) OR (NOT a AND n)"
_add(
    "assignment_evidence",
    assignment_evidence,
    " UNION ALL ".join(
        f"SELECT o_orderkey, CAST({i} AS INTEGER) AS constraint, '{p}' AS predicate, {inverse} AS inverse, CAST({n} AS BIGINT) AS arcs, CAST({n} AS BIGINT) AS served FROM ({_CONFORM}) WHERE {n} > 0"
        for i, p, inverse, n in ((0, "line_flag", "false", "1"), (1, "line_flag", "false", "flags - 1"), (2, "l_orderkey", "true", "lines"), (3, "o_custkey", "false", "1"))
    ),
)


def choice_evidence(spark, sf_dir):
    """How many lines an order's evidence gives to each branch of a choice over line numbers, repeated groups included."""
    schema = parse(PREFIXES + ":S { ( :line_no [1 2 3] ; :line_no [4 5 6] ){2,3} | ( :line_no [1 2 3] {1,2} ; :line_no [2 3 4] ? ) }")
    rows = maps.evidence(graph(spark, sf_dir), schema, _map("{FOCUS rdf:type :orders}@:S"))
    served = rows.groupBy(key_of().alias("o_orderkey")).agg(F.count_if(F.col("constraint") < 2).alias("grouped"), F.count_if(F.col("constraint") >= 2).alias("single"))
    return served


# distinct line numbers of an order are 1..n: four and six of them pair off with 1-3 for every 4-6 if there are as many of both
_add(
    "choice_evidence",
    choice_evidence,
    """
SELECT o_orderkey, CASE WHEN low = high AND low BETWEEN 2 AND 3 AND rest = 0 THEN numbers ELSE 0 END AS grouped, CASE WHEN low = high AND low BETWEEN 2 AND 3 AND rest = 0 THEN 0 ELSE numbers END AS single FROM (
  SELECT o_orderkey, count(DISTINCT l_linenumber) AS numbers, count(DISTINCT l_linenumber) FILTER (l_linenumber <= 3) AS low, count(DISTINCT l_linenumber) FILTER (l_linenumber BETWEEN 4 AND 6) AS high,
    count(DISTINCT l_linenumber) FILTER (l_linenumber > 6) AS rest, max(l_linenumber) AS top
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
) WHERE (low = high AND low BETWEEN 2 AND 3 AND rest = 0) OR (numbers BETWEEN 1 AND 3 AND low >= 1 AND top <= 4)
""",
)

# a base that is a choice, with conditions on the node in it

_validation(
    "extends_base_choice",
    f':B ( <{BASE}orders/1>~ AND {{ :line_flag ["A" "N"] }} ) OR {{ :line_flag ["R"] ; :line_status ["F"] }} :S EXTENDS @:B {{ :line_flag ["N" "R"] ? ; :line_status . * }}'.replace(f"<{BASE}orders/1>~", f"[ <{BASE}orders/1>~ ]"),
    f"SELECT o_orderkey, {_case('(starts_with(CAST(o_orderkey AS VARCHAR), ' + repr('1') + ') AND ((a AND NOT (n AND r)) OR (NOT a AND n))) OR (NOT a AND r AND f)')} FROM ({_FLAGS})",
)

# negation twice around a cycle

_TURNS = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role = 'user' AS p, true AS q FROM conversations WHERE turn = 0
  UNION ALL SELECT c.conv_id, c.turn, c.role IN ('user', 'assistant') AND NOT t.q, NOT t.p FROM conversations AS c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1
) SELECT conv_id, turn, shape, CASE WHEN CASE WHEN shape = 'P' THEN p ELSE q END THEN 'conformant' ELSE 'nonconformant' END AS status FROM t, (SELECT unnest(['P', 'Q']) AS shape)
"""
_validation(
    "even_negation",
    ':P { :role ["user" "assistant"] ; :prev NOT @:Q ? } :Q { :role . ; :prev NOT @:P ? }',
    _TURNS.replace("role = 'user' AS p", "role IN ('user', 'assistant') AS p"),
    "{FOCUS rdf:type :conversations}@:P, {FOCUS rdf:type :conversations}@:Q",
    lambda: (F.regexp_extract("node", r"/([0-9]+)-", 1).cast("long").alias("conv_id"), F.regexp_extract("node", r"-([0-9]+)>$", 1).cast("long").alias("turn"), F.regexp_extract("shape", r"([^/]+)$", 1).alias("shape"), "status"),
)
_validation("self_reference", ":S @:S AND { :o_custkey @:C } :C @:C OR { :none . }", f"SELECT o_orderkey, {_case('o_custkey IS NOT NULL')} FROM orders")

# reachability without pairs

_CHATS = [m for m in GRAPH if m.table == "conversations"]
_TURN_OF = lambda c: (F.regexp_extract(c, r"/([0-9]+)-", 1).cast("long").alias("conv_id"), F.regexp_extract(c, r"-([0-9]+)>$", 1).cast("long").alias("turn"))


def _replies(spark, sf_dir):
    """Arcs (start, node) from every turn to the one before it."""
    return pp.pairs(graph(spark, sf_dir, _CHATS), pp.Step(BASE + "prev")).select("start", "node")


def reach_counts(spark, sf_dir):
    """How many turns each turn leads back to, by doubling pointers."""
    return reach.counts(_replies(spark, sf_dir)).select(*_TURN_OF("start"), "reached")


def reach_intervals(spark, sf_dir):
    """How many turns follow each turn, by the intervals of the forest of replies."""
    down = _replies(spark, sf_dir).select(F.col("node").alias("start"), F.col("start").alias("node"))
    return reach.intervals(down).select(*_TURN_OF("node"), (F.col("last") - F.col("first")).alias("later"))


_add("reach_counts", reach_counts, "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(turn AS BIGINT) AS reached FROM conversations WHERE turn > 0")
_add("reach_intervals", reach_intervals, "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, max(turn) OVER (PARTITION BY conv_id) - turn AS later FROM conversations QUALIFY max(turn) OVER (PARTITION BY conv_id) > 0")

# one large Turtle document in parts


def rdf_turtle_files(spark, sf_dir):
    """Customers written as Turtle files, long strings and nested nodes included, and read again by blocks."""
    quoted = 'concat(\'"""\', c_name, \'. A "quote", a [ bracket.\', chr(10), \'# no comment. \', c_custkey, \'"""\')'
    text = f"""concat('PREFIX : <{BASE}> <{BASE}customer/', c_custkey, '> :c_name ', {quoted}, '@en ; :c_acctbal ', format_string('%.2f', c_acctbal), ' ; :at [ :nation <{BASE}nation/', c_nationkey, '> ; :notes ( "a." [ :b 1.5 ] ) ] .')"""
    path = folder(spark, "turtle")
    spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr(text).alias("value")).write.text(path)
    schema = parse(PREFIXES + ":S { :c_name [@en~] ; :c_acctbal xsd:decimal MININCLUSIVE 0 ; :at { :nation [nation:1~] ; :notes BNODE } }")
    return maps.run(rdf.read_turtle(spark, path), schema, _map("{FOCUS :c_name _}@:S")).select(key_of().alias("c_custkey"), "status")


_add("rdf_turtle_files", rdf_turtle_files, f"SELECT c_custkey, {_case('round(c_acctbal, 2) >= 0 AND starts_with(CAST(c_nationkey AS VARCHAR), ' + repr('1') + ')')} FROM customer")

# a schema for every part, analysed where it lies

_VARIANT = """concat('PREFIX : <http://e/> :A { :p ', if(p_size % 2 = 0, 'NOT ', ''), '@:B ; :q ', if(p_size % 3 = 0, 'NOT ', ''), '@:C ? } :B { :r @:C ? } :C { :s ', if(p_size % 5 = 0, 'NOT ', ''), '@:A ? } ',
  'ABSTRACT :E { :t [', p_size, '] } :D EXTENDS @:E ', if(p_size % 7 = 0, 'RESTRICTS @:A ', ''), '{ ^:u . ; :v . }', if(p_size % 4 = 0, ' :F EXTENDS @:D { :w . }', ''))"""


def schema_facts(text: str, other: str) -> tuple:
    """What the analysis says of one schema, and where it differs from another."""
    s, o, e = parse(text), parse(other), "http://e/"
    deps = analyze.dependencies(s)
    return (
        bool(analyze.negative_cycles(deps)), bool(analyze.odd_negative_cycles(deps)), not analyze.problems(s), len(analyze.references(s)), sum(k == "restricts" for x in analyze.inheritance(s).values() for k, _ in x),
        len(analyze.descendants(s, e + "E")), len(analyze.ancestors(s, e + ("F" if e + "F" in s.labels else "D"))), len(analyze.paths(s, e + "D")), analyze.same_schema(s, shexj.loads(shexj.dumps(s))), ",".join(x.replace(f"shape {e}", "") for x in analyze.difference(s, o)),
    )


def schema_corpus(spark, sf_dir):
    """What the analysis says of one schema a part: negation in cycles, references, inheritance, paths, forms and differences."""

    def facts(frames):
        import pandas as pd

        seen = of = None
        for pdf in frames:
            out = []
            for key, *texts in zip(pdf["p_partkey"], pdf["text"], pdf["other"], strict=True):
                if texts != seen:
                    seen, of = texts, schema_facts(*texts)
                out.append((key, *of))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FACTS.split(", ")])

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    texts = part.selectExpr("p_partkey", f"{_VARIANT} AS text", f"{_VARIANT.replace('p_size', '(p_size + 1)')} AS other")
    # equal texts have equal facts: each task works out those of a text once; no text is left to one task alone
    return spread(texts, "text", "other", F.pmod(F.xxhash64("p_partkey"), F.lit(8))).mapInPandas(facts, _FACTS)


_FACTS = "p_partkey long, negative boolean, odd boolean, well_formed boolean, refs long, restricts long, descendants long, ancestors long, paths long, same_json boolean, differs string"
_add(
    "schema_corpus",
    schema_corpus,
    """
SELECT p_partkey, n2 OR n3 OR n5 AS negative, n2 <> n5 OR n3 <> n5 AS odd, NOT (n2 <> n5 OR n3 <> n5) AS well_formed, CAST(4 + CASE WHEN f THEN 1 ELSE 0 END AS BIGINT) AS refs,
  CAST(CASE WHEN n7 THEN 1 ELSE 0 END AS BIGINT) AS restricts, CAST(1 + CASE WHEN f THEN 1 ELSE 0 END AS BIGINT) AS descendants, CAST(1 + CASE WHEN f THEN 1 ELSE 0 END AS BIGINT) AS ancestors, CAST(3 AS BIGINT) AS paths, true AS same_json,
  'A,' || CASE WHEN n5 OR p_size % 5 = 4 THEN 'C,' ELSE '' END || CASE WHEN n7 OR p_size % 7 = 6 THEN 'D,' ELSE '' END || 'E' || CASE WHEN f OR p_size % 4 = 3 THEN ',F' ELSE '' END AS differs
FROM (SELECT p_partkey, p_size, p_size % 2 = 0 AS n2, p_size % 3 = 0 AS n3, p_size % 5 = 0 AS n5, p_size % 7 = 0 AS n7, p_size % 4 = 0 AS f FROM part)
""",
)

# equality up to the names of blank nodes


def blank_node_equality(spark, sf_dir):
    """Customers as blank nodes in two graphs with other names: which look the same, by label and part.  Every tenth has another balance in the second."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lit = lambda v: F.struct(F.lit("literal").alias("o_kind"), v.cast("string").alias("o_lex"), F.lit(XSD + "string").alias("o_dt"))
    node = lambda v: F.struct(F.lit("bnode").alias("o_kind"), v.alias("o_lex"), F.lit(None).cast("string").alias("o_dt"))

    def made(name, balance):
        me, account, twin = (F.concat(F.lit(f"_:{name}{x}"), "c_custkey") for x in "abc")
        arcs = [(me, "name", lit(F.col("c_name"))), (me, "has", node(account)), (me, "has", node(twin)), (account, "balance", lit(balance)), (twin, "balance", lit(balance)), (account, "other", node(twin)), (twin, "other", node(account))]
        t = customer.select(F.explode(F.array(*(F.struct(s.alias("s"), F.lit(BASE + p).alias("p"), o.alias("o")) for s, p, o in arcs))).alias("t"))
        return t.select("t.s", "t.p", "t.o.*", F.lit(None).cast("string").alias("o_lang"))

    a, b = made("x", F.col("c_acctbal")), made("y", F.when(F.col("c_custkey") % 10 == 0, -1).otherwise(F.col("c_acctbal")))
    key = lambda t, name: blanks.labels(t).where(F.col("node").startswith(f"_:{name}a")).select(F.regexp_extract("node", "([0-9]+)$", 1).cast("long").alias("c_custkey"), F.struct("label", "part").alias(name))
    return key(a, "x").join(key(b, "y"), "c_custkey").select("c_custkey", (F.col("x") == F.col("y")).alias("same"))


_add("blank_node_equality", blank_node_equality, "SELECT c_custkey, c_custkey % 10 <> 0 AS same FROM customer")

# shape paths over the same schemas: axes and set operations

_PATHS = {
    "constraints": "//tripleconstraint",
    "negated": "//shapenot/shaperef",
    "plain_refs": "//shaperef except //shapenot//shaperef",
    "either": "/@e:A//tripleconstraint , /@e:D//descendant tripleconstraint | //nodeconstraint",
    "both": "//tripleconstraint intersect /@e:C/*",
    "nested": "/@e:A/nested-or-self-triple-expression *",
}


def shape_path_sets(spark, sf_dir):
    """How many nodes paths with axes and set operations select in the schema of every part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    table = keep(spread(tables.nodes(part.selectExpr("p_partkey AS key", f"{_VARIANT} AS text")), "key"))  # the joins by key start from here
    found = None
    for name, path in _PATHS.items():
        one = tables.evaluate(table, tables.parse(path, {"e": "http://e/"})).groupBy("key").agg(F.count("*").alias("nodes")).select(F.col("key").alias("p_partkey"), F.lit(name).alias("path"), "nodes")
        found = one if found is None else found.unionByName(one)
    return found


_add(
    "shape_path_sets",
    shape_path_sets,
    """
WITH v AS (SELECT p_partkey, CAST(p_size % 2 = 0 AS INTEGER) + CAST(p_size % 3 = 0 AS INTEGER) + CAST(p_size % 5 = 0 AS INTEGER) AS n, CAST(p_size % 4 = 0 AS INTEGER) AS f FROM part)
SELECT p_partkey, path, CAST(nodes AS BIGINT) AS nodes FROM (
  SELECT p_partkey, unnest(['constraints', 'negated', 'plain_refs', 'either', 'both', 'nested']) AS path, unnest([7 + f, n, 4 - n, 2 + 2 + 1, 1, 3]) AS nodes FROM v
) WHERE nodes > 0
""",
)
