"""Work that grows with what a query needs: tables read, rows numbered, shuffles."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shapeloom import queries, queries_forms, queries_more
from shapeloom.functions.terms import TRIPLES
from shapeloom.operators import blanks
from shapeloom.plans import validate
from shapeloom.schema.ast import RDF, XSD
from shapeloom.sources.graph import BASE, Column_, Link, MappedGraph, TableMapping
from shapeloom.wikibase import entityschema, matcher, model
from shapeloom.wikibase.queries import entities

SF = "/root/testdata/sf0.001"


def read_by(df) -> set[str]:
    return {Path(f).stem for f in df.inputFiles()}


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_read_only_tables_that_can_hold_them(spark):
    """arcs around nations lie in three tables; an address of a page may be any IRI."""
    assert read_by(queries.queries()["neighbourhood"](spark, SF)) == {"nation", "customer", "supplier", "pages"}


@pytest.fixture
def mapped(spark):
    tables = {
        "a": spark.createDataFrame([(1, 2, "x", "http://shapes.example/b/9"), (2, None, None, None)], "k int, to int, name string, at string"),
        "b": spark.createDataFrame([(2, 'say "x"')], "k int, name string"),
    }
    mappings = [TableMapping("a", "k", [Column_("to", Link("b")), Column_("name"), Column_("at", iri=True)]), TableMapping("b", "k", [Column_("name")])]
    return MappedGraph(spark, tables, mappings)


def test_neighbours_of_every_kind_of_node(spark, mapped):
    """Links, IRIs as values, classes and literals lead to nodes; the answer is that of all arcs."""
    every = mapped.neighbours()
    for node, n in (("<http://shapes.example/b/2>", 3), ("<http://shapes.example/b/9>", 1), ("<http://shapes.example/a>", 2), ('"x"', 1), ("<http://shapes.example/a/1>", 4), ('"say \\"x\\""', 1), ("_:none", 0)):
        nodes = spark.createDataFrame([(node,)], "node string")
        got, want = mapped.neighbours(nodes).collect(), every.where(F.col("node") == node).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == n, node


def test_triples_make_only_what_is_asked_for(spark):
    """a count by predicate makes no subjects, values or nested rows."""
    plan = plan_of(queries.graph(spark, SF).triples().groupBy("p").count())
    assert "lambdafunction" not in plan and "named_struct" not in plan and "concat(<" not in plan and "date_format" not in plan


def test_triples_of_a_table(mapped):
    got = {(r["s"].rsplit("/", 1)[-1], r["p"].rsplit("/", 1)[-1], r["o_kind"], r["o_lex"], r["o_dt"]) for r in mapped.triples().where(F.col("s").contains("/a/")).collect()}
    cls = ("22-rdf-syntax-ns#type", "iri", BASE + "a", None)
    assert got == {("1>", "to", "iri", BASE + "b/2", None), ("1>", "name", "literal", "x", XSD + "string"), ("1>", "at", "iri", BASE + "b/9", None), ("1>", *cls), ("2>", *cls)}


def test_a_closed_shape_reads_only_tables_about_its_nodes(spark):
    """of a closed shape all predicates count, but only those of its nodes."""
    assert read_by(queries_forms.QUERIES["failure_reasons"](spark, SF)) == {"orders", "lineitem"}


@pytest.mark.parametrize("name", ["extends_base_reference", "extends_base_choice"])
def test_classes_of_arcs_are_counted_in_one_pass(spark, name):
    """F16, F17: no lists of classes a node, and no shuffle by vectors of counts."""
    query = queries_forms.QUERIES.get(name) or queries_more.QUERIES[name]
    plan = plan_of(query(spark, SF))
    assert "collect_list" not in plan and "MapInPandas" not in plan


def test_many_classes_take_a_second_pass(spark, monkeypatch):
    """Both ways of counting give the same verdicts."""
    run = lambda: sorted(map(repr, queries_forms.QUERIES["extends_base_reference"](spark, SF).collect()))
    few = run()
    monkeypatch.setattr(validate, "CLASSES", 1)
    assert run() == few


def test_only_arcs_that_fit_several_constraints_are_numbered(spark, monkeypatch):
    """arcs that fit one constraint serve it without any shuffle by place."""
    numbered, seen = validate._numbered, []
    monkeypatch.setattr(validate, "_numbered", lambda arcs, *more: (seen.append(arcs), numbered(arcs, *more))[1])
    queries_more.QUERIES["assignment_evidence"](spark, SF)
    assert len(seen) == 1 and seen[0].where("bit_count(mask) < 2").isEmpty() and not seen[0].isEmpty()


def test_forms_of_one_node_are_one(spark):
    """Terms that share an id (a language in other case, a string with its datatype or without) are one node."""
    rows = [('"x"@en', "literal", "x", RDF + "langString", "EN"), ('"x"@en', "literal", "x", RDF + "langString", "en"), ('"y"', "literal", "y", None, None), ('"y"', "literal", "y", XSD + "string", None)]
    nodes = spark.createDataFrame(rows, validate.NODE)
    assert validate._union_nodes([nodes, nodes]).count() == 2


def test_small_parts_with_ties_come_in_batches(spark, monkeypatch):
    """F8: no frame for each of many small parts; a larger part gives the same labels by a frame of its own."""
    twins = [(f"_:{k}{x}", "http://e/p", "bnode", f"_:{k}{y}", None, None) for k in range(3) for x, y in ("ab", "ba")]
    triples = spark.createDataFrame(twins, TRIPLES)
    made = blanks.labels(triples)
    plan = plan_of(made)
    assert "ArrowEvalPython" in plan and "FlatMapGroupsInPandas" not in plan
    few = sorted(map(repr, made.select("label", "part").collect()))
    monkeypatch.setattr(blanks, "SMALL", 0)
    assert sorted(map(repr, blanks.labels(triples).select("label", "part").collect())) == few and len(few) == 6


def test_entities_of_one_file_are_made_by_many_tasks(spark):
    """however few files the parts come from."""
    assert entities(spark, SF).select(F.spark_partition_id().alias("t")).distinct().count() >= 4


def test_rounds_write_only_what_changes(spark, monkeypatch):
    """of 40 entities ten lose a label one after the other; the others are not written again in every round."""
    snak = lambda p, kind, v: (p, "value", kind, v)
    of = lambda p, kind, v: (p, snak(p, kind, v), "normal", [], [])
    chain = [(f"Q{i}", [of("P6", "entity", f"Q{i + 1}"), *([of("P3", "string", "x")] if i < 9 else [])]) for i in range(10)]
    rings = [(f"Q{i}", [of("P6", "entity", f"Q{i}"), of("P3", "string", "x")]) for i in range(10, 40)]
    rows = spark.createDataFrame([(k, "item", {}, {}, {}, s) for k, s in chain + rings], model.ENTITY)
    wrote, kept = [], matcher.keep
    monkeypatch.setattr(matcher, "keep", lambda df: (out := kept(df), wrote.append(out.count()))[0])
    m = matcher.Matcher(entityschema.parse("PREFIX : <http://www.wikidata.org/entity/>\n<S> { :P3 . ; :P6 @<S> }"))
    held = {r["id"] for r in m.match_graph(rows).where("array_contains(ok_shapes, 'S')").collect()}
    assert held == {f"Q{i}" for i in range(10, 40)} and m.rounds >= 9
    assert sum(n >= 30 for n in wrote) <= 6
