"""Queries over entity documents made from parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths as pp
from ..plans.storage import spread
from ..schema.shexc import parse as plain
from ..shapemap import maps
from ..sources.graph import Graph
from ..sources.rdf import ntriples_lines, of_documents, parse_turtle, to_ntriples, to_turtle
from . import model, rdf
from .entityschema import from_plain, parse, to_plain
from .matcher import Matcher

_P = "PREFIX : <http://www.wikidata.org/entity/>\n"


def entities(spark, sf_dir: str, more_links: tuple = ()):
    """A part is an item: P1 brand and P2 type (strings), P3 size (quantity, with qualifier P4 and, beyond 10, a reference P5), P6 the next part.

    more_links: further steps to parts that P6 leads to.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    top = part.agg(F.max("p_partkey").alias("top"))
    part = spread(part, "p_partkey")  # an entity is many times its row, so few files must not mean few tasks
    snak = lambda p, t, v: F.struct(F.lit(p).alias("property"), F.lit("value").alias("kind"), F.lit(t).alias("vtype"), v.cast("string").alias("value"))
    none = F.array().cast(f"ARRAY<{model.SNAK}>")
    no_refs = F.array().cast(f"ARRAY<ARRAY<{model.SNAK}>>")
    statement = lambda s, rank, q, r: F.struct(s["property"].alias("property"), s.alias("snak"), rank.alias("rank"), q.alias("qualifiers"), r.alias("refs"))
    size = F.concat(F.lit("+"), F.col("p_size"))
    normal = F.lit("normal")
    rank = F.when(F.col("p_size") % 3 == 0, "preferred").when(F.col("p_size") % 3 == 1, "deprecated").otherwise("normal")
    statements = F.array(
        statement(snak("P1", "string", F.col("p_brand")), normal, none, no_refs),
        statement(snak("P2", "string", F.col("p_type")), rank, none, no_refs),
        statement(snak("P2", "string", F.lit("ANY")), normal, none, no_refs),
        statement(snak("P3", "quantity", size), normal, F.array(snak("P4", "string", F.col("p_brand"))), F.when(F.col("p_size") > 10, F.array(F.array(snak("P5", "string", F.col("p_name"))))).otherwise(no_refs)),
        *(statement(snak("P6", "entity", F.concat(F.lit("Q"), (F.col("p_partkey") + step) % (F.col("top") + 1))), normal, none, no_refs) for step in (1, *more_links)),
    )
    return part.crossJoin(F.broadcast(top)).select(  # one row: the greatest key
        F.concat(F.lit("Q"), "p_partkey").alias("id"), F.lit("item").alias("type"), F.create_map(F.lit("en"), F.col("p_name")).alias("labels"),
        F.create_map(F.lit("en"), F.col("p_type")).alias("descriptions"), F.create_map(F.lit("en"), F.array("p_name", "p_brand")).alias("aliases"), statements.alias("statements"),
    )


def _with_statements(spark, sf_dir, *statements):
    """Parts with further statements, given as an array of (property, kind, type, value)."""
    none = F.array().cast(f"ARRAY<{model.SNAK}>")
    made = F.transform(F.concat(*statements), lambda s: F.struct(s["property"].alias("property"), s.alias("snak"), F.lit("normal").alias("rank"), none.alias("qualifiers"), F.array().cast(f"ARRAY<ARRAY<{model.SNAK}>>").alias("refs")))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("Q"), "p_partkey").alias("id"), made.alias("_more"))
    both = entities(spark, sf_dir).join(part, "id")
    return both.withColumn("statements", F.concat("statements", "_more")).drop("_more")


def _snak_kinds(spark, sf_dir):
    """P7 is an entity, a string, some unknown value or none, in turn."""
    kind = F.when(F.col("p_size") % 4 == 2, "somevalue").when(F.col("p_size") % 4 == 3, "novalue").otherwise("value")
    vtype = F.when(F.col("p_size") % 4 == 0, "entity").when(F.col("p_size") % 4 == 1, "string")
    rows = _with_statements(spark, sf_dir, F.array(F.struct(F.lit("P7").alias("property"), kind.alias("kind"), vtype.alias("vtype"), F.when(vtype.isNotNull(), F.lit("Q1")).alias("value"))))
    columns = {"iri": "IRI", "literal": "LITERAL", "bnode": "BNODE", "nonliteral": "NONLITERAL", "not_iri": "NOT IRI", "novalue": "NOT NONLITERAL AND NOT LITERAL"}
    return rows.select(_key(), *(F.coalesce(Matcher(parse(_P + f"<S> {{ :P7 {x} }}")).column(), F.lit(False)).alias(name) for name, x in columns.items()))


def _group_cardinality(spark, sf_dir):
    """P7 stands p_size mod 5 times and P8 p_size mod 3 times; groups of both repeat."""
    some = lambda p, n: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(F.lit(p).alias("property"), F.lit("value").alias("kind"), F.lit("string").alias("vtype"), i.cast("string").alias("value"), (i <= n).alias("on")))
    snaks = lambda p, n: F.transform(F.filter(some(p, n), lambda s: s["on"]), lambda s: F.struct(s["property"].alias("property"), s["kind"].alias("kind"), s["vtype"].alias("vtype"), s["value"].alias("value")))
    rows = _with_statements(spark, sf_dir, snaks("P7", F.col("p_size") % 5), snaks("P8", F.col("p_size") % 3))
    columns = {"pairs": "( :P7 . ; :P8 . ){1,2}", "ranges": "( :P7 . {2,3} ; :P8 . )*", "choices": "( :P7 . | :P8 . ){2,4}"}
    return rows.select(_key(), *(F.coalesce(Matcher(parse(_P + f"<S> {{ {x} }}")).column(), F.lit(False)).alias(name) for name, x in columns.items()))


def _key():
    return F.substring("id", 2, 20).cast("long").alias("p_partkey")


def _matching(schema: str):
    def query(spark, sf_dir):
        return Matcher(parse(_P + schema)).match(entities(spark, sf_dir)).select(_key(), "matches")

    return query


def _graph(schema: str, *labels: str, more_links: tuple = ()):
    """References followed: which parts have which labels."""

    def query(spark, sf_dir):
        held = Matcher(parse(_P + schema)).match_graph(entities(spark, sf_dir, more_links))
        return held.select(_key(), *(F.array_contains("ok_shapes", x).alias(x.lower()) for x in labels))

    return query


def _dump_filter(spark, sf_dir):
    """Matching entities with their matched statements only."""
    m = Matcher(parse(_P + '<S> EXTRA :P2 { :P2 [ "PROMO" ] ; :P3 MAXINCLUSIVE 25 }'))
    rows = m.filter(entities(spark, sf_dir), project=True)
    return rows.select(_key(), F.size("statements").cast("long").alias("statements"))


def _fold(spark, sf_dir):
    m = Matcher(parse(_P + "<S> { :P3 MININCLUSIVE 20 }"))
    return m.fold(entities(spark, sf_dir), F.count("*").alias("n"), F.max(F.substring("id", 2, 20).cast("long")).alias("last"))


def _truthy(spark, sf_dir):
    t = rdf.truthy(entities(spark, sf_dir)).where(F.col("p").endswith("/P2"))
    return t.groupBy(F.regexp_extract("s", r"/Q([0-9]+)>$", 1).cast("long").alias("p_partkey")).agg(F.min("o_lex").alias("least"), F.count("*").alias("n"))


def _rdf(spark, sf_dir):
    """All triples of the entities, by predicate."""
    counts = rdf.full(entities(spark, sf_dir)).groupBy("p").agg(F.count("*").alias("n"))
    return counts.groupBy(F.regexp_extract("p", r"([^/]+/[^/]+)$", 1).alias("predicate")).agg(F.sum("n").alias("n"))


def _rdf_text(spark, sf_dir):
    """Entities as N-Triples lines, read again."""
    again = ntriples_lines(to_ntriples(rdf.full(entities(spark, sf_dir)))).where(F.col("p").endswith("rdf-schema#label"))
    return again.select(F.regexp_extract("s", r"/Q([0-9]+)>$", 1).cast("long").alias("p_partkey"), F.col("o_lex").alias("label"), F.col("o_lang").alias("lang"))


def _turtle_text(spark, sf_dir):
    """Entities as Turtle, one document an entity, read again: all triples by predicate."""
    again = of_documents(to_turtle(rdf.full(entities(spark, sf_dir))), parse_turtle).df
    return again.groupBy(F.regexp_extract("p", r"([^/]+/[^/]+)$", 1).alias("predicate")).agg(F.count("*").alias("n"))


def _json(spark, sf_dir):
    """Public JSON lines of parts, as a dump has them, parsed and matched."""
    snak = lambda kind, value: f"""'{{"snaktype": "value", "property": "{kind}", "datavalue": ', {value}, '}}'"""
    text = """'{"type": "string", "value": "', p_brand, '"}'"""
    size = """'{"type": "quantity", "value": {"amount": "+', p_size, '", "unit": "1"}}'"""
    to = """'{"type": "wikibase-entityid", "value": {"entity-type": "item", "id": "Q', p_partkey + 1, '"}}'"""
    line = f"""concat('{{"type": "item", "id": "Q', p_partkey, '", "labels": {{"en": {{"language": "en", "value": "', p_name, '"}}}}, "aliases": {{"en": [{{"language": "en", "value": "', p_type, '"}}]}}, "claims": {{',
      '"P1": [{{"rank": "normal", "mainsnak": ', {snak("P1", text)}, '}}], "P6": [{{"rank": "normal", "mainsnak": ', {snak("P6", to)}, '}}], ',
      '"P3": [{{"rank": "preferred", "mainsnak": ', {snak("P3", size)}, ', "qualifiers": {{"P4": [', {snak("P4", text)}, ']}}, "references": [{{"snaks": {{"P5": [', {snak("P5", text)}, ']}}}}]}}]}}}}')"""
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr(line).alias("value"))
    m = Matcher(parse(_P + "<S> LABEL (en -> /e/) { :P1 /^Brand#1/ ; :P3 MININCLUSIVE 10 {| :P4 . |} REFERENCES {| :P5 . |} ; :P6 IRI }"))
    return m.match(model.parse_json(lines)).select(_key(), "matches", F.col("statements")[0]["property"].alias("first"), F.size("statements").cast("long").alias("statements"))


def _projected_choice(spark, sf_dir):
    """Of a choice only the operands that hold keep statements."""
    m = Matcher(parse(_P + "<S> { :P3 MININCLUSIVE 20 } OR EXTRA :P2 { :P2 [ 'PROMO' ] } OR { :P1 /^Brand#3/ }"))
    rows = m.filter(entities(spark, sf_dir), project=True)
    return rows.select(_key(), F.array_join(F.transform("statements", lambda s: s["property"]), " ").alias("kept"))


def _reasons(spark, sf_dir):
    m = Matcher(parse(_P + "<S> LABEL (en -> /ring$/) { :P1 /^Brand#1/ ; :P3 MININCLUSIVE 10 ; :P2 . }"))
    return entities(spark, sf_dir).select(_key(), F.array_join(m.reasons(), ", ").alias("reasons"))


def _graph_reasons(spark, sf_dir):
    """Why a part fails: its value, qualifiers, references, or the part that it leads to."""
    m = Matcher(parse(_P + "<S> { :P3 MININCLUSIVE 3 {| :P4 /^Brand#[12]/ |} REFERENCES {| :P5 /e/ |} ; :P6 @<T> } <T> { :P1 /^Brand#1/ }"))
    return m.reasons_graph(entities(spark, sf_dir)).select(_key(), F.array_join("reasons", ", ").alias("reasons"))


def _from_plain(spark, sf_dir):
    """A plain schema over direct properties, as an entity schema."""
    s = from_plain(plain('PREFIX wdt: <http://www.wikidata.org/prop/direct/> <S> EXTRA wdt:P2 { wdt:P2 [ "PROMO" "STANDARD" ] ; wdt:P3 MAXEXCLUSIVE 20 }'))
    return Matcher(s).match(entities(spark, sf_dir)).select(_key(), "matches")


def _to_plain(spark, sf_dir):
    """An entity schema as a plain one, over the entities' truthy triples and labels."""
    s = to_plain(parse(_P + "<S> LABEL (en -> /e/) { :P1 /^Brand#2/ ; :P3 MININCLUSIVE 10 }"))
    about = {"http://www.w3.org/2000/01/rdf-schema#label"}
    t = rdf.full(entities(spark, sf_dir)).where(F.col("p").startswith(rdf.PROP + "direct/") | F.col("p").isin(about))
    result = maps.run(Graph(t, distinct=False), s, [maps.Association(maps.Triples("subject", pp.Step(rdf.PROP + "direct/P1")), s.labels[0])])
    return result.select(F.regexp_extract("node", r"/Q([0-9]+)>$", 1).cast("long").alias("p_partkey"), "status")


def _literals(spark, sf_dir):
    """Times, quantities and places of many forms as literals."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    year = F.lpad((F.col("p_partkey") % 3000 + 1).cast("string"), 4, "0")
    return part.select(
        "p_partkey",
        rdf.time_literal(F.concat(F.lit("+"), year, F.lit("-00-00T00:00:00Z"))).alias("year"),
        rdf.time_literal(F.concat(F.lit("-"), year, F.lit("-05-00T00:00:00Z"))).alias("month"),
        rdf.quantity_literal((F.col("p_size") - 25).cast("string")).alias("quantity"),
        rdf.globe_literal(F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("place"),
    )


QUERIES = {
    "entity_match_statements": _matching("<S> { :P1 /^Brand#1/ ; :P3 MININCLUSIVE 5 MAXINCLUSIVE 30 }"),
    "entity_boolean": _matching("start = @<A> OR NOT @<B>  <A> { :P1 /^Brand#2/ } <B> { :P3 MININCLUSIVE 10 }"),
    "entity_one_of": _matching('<S> EXTRA :P2 { :P2 [ "PROMO" ] | :P3 MININCLUSIVE 40 }'),
    "entity_qualifiers": _matching("<S> { :P3 . {| :P4 /^Brand#1/ |} }"),
    "entity_references": _matching("<S> { :P3 . REFERENCES {| :P5 /^small/ |} }"),
    "entity_labels": _matching('<S> LABEL (en -> /ring$/) DESCRIPTION (en -> [ "ECONOMY" "PROMO" ]) ALIAS (en -> /^Brand#[12]/) { :P1 . }'),
    "entity_graph": _graph("<S> { :P3 MININCLUSIVE 3 ; :P6 @<T> } <T> { :P1 /^Brand#1/ }", "S", "T"),
    "entity_graph_or": _graph("<S> { :P6 @<T> } OR { :P3 MININCLUSIVE 30 } <T> { :P1 /^Brand#1/ }", "S"),
    "entity_graph_one_of": _graph("<S> EXTRA :P6 { :P6 @<T> | :P3 MININCLUSIVE 30 } <T> { :P1 /^Brand#1/ }", "S"),
    "entity_graph_not": _graph("<S> NOT { :P6 @<T> } <T> { :P1 /^Brand#1/ }", "S"),
    "entity_graph_extra": _graph("<S> EXTRA :P6 { :P6 @<T> } <U> { :P6 @<T> + } <V> EXTRA :P6 { :P6 @<T> {1,2} } <T> { :P1 /^Brand#1/ }", "S", "U", "V", more_links=(2,)),
    "entity_graph_recursive": _graph("<S> { :P3 MAXINCLUSIVE 45 ; :P6 @<S> OR @<T> } <T> { :P1 /^Brand#1/ }", "S"),
    "dump_filter": _dump_filter,
    "dump_fold": _fold,
    "best_rank_truthy": _truthy,
    "entity_rdf": _rdf,
    "entity_rdf_text": _rdf_text,
    "entity_literals": _literals,
    "entity_json": _json,
    "entity_projected_choice": _projected_choice,
    "entity_reasons": _reasons,
    "entity_graph_reasons": _graph_reasons,
    "entity_schema_from_plain": _from_plain,
    "entity_schema_to_plain": _to_plain,
    "entity_node_kinds": _snak_kinds,
    "entity_turtle_text": _turtle_text,
    "entity_group_cardinality": _group_cardinality,
}

ORACLE = {
    "entity_match_statements": "SELECT p_partkey, starts_with(p_brand, 'Brand#1') AND p_size BETWEEN 5 AND 30 AS matches FROM part",
    "entity_boolean": "SELECT p_partkey, starts_with(p_brand, 'Brand#2') OR p_size < 10 AS matches FROM part",
    "entity_one_of": "SELECT p_partkey, p_type = 'PROMO' OR p_size >= 40 AS matches FROM part",
    "entity_qualifiers": "SELECT p_partkey, starts_with(p_brand, 'Brand#1') AS matches FROM part",
    "entity_references": "SELECT p_partkey, p_size > 10 AND starts_with(p_name, 'small') AS matches FROM part",
    "entity_labels": "SELECT p_partkey, regexp_matches(p_name, 'ring$') AND p_type IN ('ECONOMY', 'PROMO') AND (regexp_matches(p_brand, '^Brand#[12]') OR regexp_matches(p_name, '^Brand#[12]')) AS matches FROM part",
    "entity_graph": "SELECT a.p_partkey, a.p_size >= 3 AND starts_with(b.p_brand, 'Brand#1') AS s, starts_with(a.p_brand, 'Brand#1') AS t FROM part a JOIN part b ON b.p_partkey = (a.p_partkey + 1) % (SELECT max(p_partkey) + 1 FROM part)",
    "entity_graph_or": "SELECT a.p_partkey, starts_with(b.p_brand, 'Brand#1') OR a.p_size >= 30 AS s FROM part a JOIN part b ON b.p_partkey = (a.p_partkey + 1) % (SELECT max(p_partkey) + 1 FROM part)",
    "entity_graph_one_of": "SELECT a.p_partkey, starts_with(b.p_brand, 'Brand#1') OR a.p_size >= 30 AS s FROM part a JOIN part b ON b.p_partkey = (a.p_partkey + 1) % (SELECT max(p_partkey) + 1 FROM part)",
    "entity_graph_not": "SELECT a.p_partkey, NOT starts_with(b.p_brand, 'Brand#1') AS s FROM part a JOIN part b ON b.p_partkey = (a.p_partkey + 1) % (SELECT max(p_partkey) + 1 FROM part)",
    "entity_graph_extra": "SELECT p_partkey, x <> y AS s, x AND y AS u, x OR y AS v FROM (SELECT a.p_partkey, starts_with(b.p_brand, 'Brand#1') AS x, starts_with(c.p_brand, 'Brand#1') AS y FROM part a, part b, part c, (SELECT max(p_partkey) + 1 AS n FROM part) WHERE b.p_partkey = (a.p_partkey + 1) % n AND c.p_partkey = (a.p_partkey + 2) % n)",
    "entity_graph_recursive": """WITH RECURSIVE o AS (
  SELECT p_partkey AS k, (p_partkey + 1) % (SELECT max(p_partkey) + 1 FROM part) AS next, p_size <= 45 AS small, starts_with(p_brand, 'Brand#1') AS t FROM part
), bad AS (
  SELECT k FROM o WHERE NOT small UNION SELECT o.k FROM o JOIN bad ON o.next = bad.k JOIN o n ON n.k = o.next WHERE NOT n.t
) SELECT k AS p_partkey, k NOT IN (SELECT k FROM bad) AS s FROM o""",
    "dump_filter": "SELECT p_partkey, CAST(2 AS BIGINT) AS statements FROM part WHERE p_type = 'PROMO' AND p_size <= 25",
    "dump_fold": "SELECT count(*) AS n, max(p_partkey) AS last FROM part WHERE p_size >= 20",
    "best_rank_truthy": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN 'ANY' ELSE least(p_type, 'ANY') END AS least, CAST(CASE p_size % 3 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS n FROM part",
    "entity_rdf": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_size > 10) AS r, count(DISTINCT p_name) FILTER (p_size > 10) AS names,
      sum(CASE p_size % 3 WHEN 2 THEN 2 ELSE 1 END) AS p2, sum(CASE WHEN p_name = p_brand THEN 1 ELSE 2 END) AS alt FROM part)
SELECT unnest(['direct/P1', 'direct/P3', 'direct/P6', 'prop/P1', 'prop/P3', 'prop/P6', 'statement/P1', 'statement/P3', 'statement/P6', 'qualifier/P4', '01/rdf-schema#label', 'schema.org/description']) AS predicate, n FROM n
UNION ALL SELECT unnest(['prop/P2', 'statement/P2']), 2 * n FROM n UNION ALL SELECT 'direct/P2', CAST(p2 AS BIGINT) FROM n UNION ALL SELECT 'skos/core#altLabel', CAST(alt AS BIGINT) FROM n
UNION ALL SELECT 'ns/prov#wasDerivedFrom', r FROM n UNION ALL SELECT 'prop/P5', names FROM n""",
    "entity_rdf_text": "SELECT p_partkey, p_name AS label, 'en' AS lang FROM part",
    "entity_literals": """SELECT p_partkey, y || '-01-01T00:00:00Z' AS year, '-' || y || '-05-01T00:00:00Z' AS month, CASE WHEN p_size >= 25 THEN '+' ELSE '' END || (p_size - 25) AS quantity, 'Point(' || p_partkey || ' ' || p_size || ')' AS place
  FROM (SELECT p_partkey, p_size, lpad(CAST(p_partkey % 3000 + 1 AS VARCHAR), 4, '0') AS y FROM part)""",
    "entity_json": "SELECT p_partkey, contains(p_name, 'e') AND starts_with(p_brand, 'Brand#1') AND p_size >= 10 AS matches, 'P1' AS first, CAST(3 AS BIGINT) AS statements FROM part",
    "entity_projected_choice": """SELECT p_partkey, concat_ws(' ', CASE WHEN starts_with(p_brand, 'Brand#3') THEN 'P1' END, CASE WHEN p_type = 'PROMO' THEN 'P2' END, CASE WHEN p_size >= 20 THEN 'P3' END) AS kept
  FROM part WHERE p_size >= 20 OR p_type = 'PROMO' OR starts_with(p_brand, 'Brand#3')""",
    "entity_reasons": """SELECT p_partkey, concat_ws(', ', CASE WHEN NOT regexp_matches(p_name, 'ring$') THEN 'label en' END, CASE WHEN NOT starts_with(p_brand, 'Brand#1') THEN 'no-match P1' END, CASE WHEN p_size < 10 THEN 'no-match P3' END,
  CASE WHEN NOT starts_with(p_brand, 'Brand#1') THEN 'too-few P1' END, CASE WHEN p_size < 10 THEN 'too-few P3' END, 'too-many P2') AS reasons FROM part""",
    "entity_graph_reasons": """SELECT p_partkey, concat_ws(', ', CASE WHEN NOT (v AND q AND r) THEN 'no-match P3' END, CASE WHEN NOT t THEN 'no-match P6' END, CASE WHEN v AND NOT q THEN 'qualifiers P3' END, CASE WHEN NOT t THEN 'reference P6' END,
  CASE WHEN v AND NOT r THEN 'references P3' END, CASE WHEN NOT (v AND q AND r) THEN 'too-few P3' END, CASE WHEN NOT t THEN 'too-few P6' END) AS reasons
  FROM (SELECT a.p_partkey, a.p_size >= 3 AS v, regexp_matches(a.p_brand, '^Brand#[12]') AS q, a.p_size > 10 AND contains(a.p_name, 'e') AS r, starts_with(b.p_brand, 'Brand#1') AS t
    FROM part a JOIN part b ON b.p_partkey = (a.p_partkey + 1) % (SELECT max(p_partkey) + 1 FROM part))""",
    "entity_schema_from_plain": "SELECT p_partkey, p_type IN ('PROMO', 'STANDARD') AND p_size < 20 AS matches FROM part",
    "entity_schema_to_plain": "SELECT p_partkey, CASE WHEN contains(p_name, 'e') AND starts_with(p_brand, 'Brand#2') AND p_size >= 10 THEN 'conformant' ELSE 'nonconformant' END AS status FROM part",
    "entity_node_kinds": "SELECT p_partkey, p_size % 4 = 0 AS iri, p_size % 4 = 1 AS literal, p_size % 4 = 2 AS bnode, p_size % 4 IN (0, 2) AS nonliteral, p_size % 4 <> 0 AS not_iri, p_size % 4 = 3 AS novalue FROM part",
    "entity_group_cardinality": "SELECT p_partkey, p_size % 5 = p_size % 3 AND p_size % 5 BETWEEN 1 AND 2 AS pairs, p_size % 5 >= 2 * (p_size % 3) AND p_size % 5 <= 3 * (p_size % 3) AS ranges, p_size % 5 + p_size % 3 BETWEEN 2 AND 4 AS choices FROM part",
}
ORACLE["entity_turtle_text"] = ORACLE["entity_rdf"]
