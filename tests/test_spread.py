"""Rows of few files are dealt over all tasks, and equal texts are worked out once."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shapeloom import queries_forms, queries_more
from shapeloom.plans.storage import spread
from shapeloom.schema.ast import RDF, XSD
from shapeloom.sources import rdf


@pytest.fixture
def one_file(spark, tmp_path):
    """Parts in one file of one row group."""
    rows = spark.range(4000).select(F.col("id").alias("p_partkey"), (F.col("id") % 3 + 1).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def tasks(df) -> int:
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_equal_rows_meet_and_tasks_share(spark):
    rows = spark.range(1000, numPartitions=1).withColumn("k", F.col("id") % 50)
    assert tasks(spread(rows)) >= 4
    by = spread(rows, "k").select("k", F.spark_partition_id().alias("t"))
    assert by.distinct().count() == 50 and tasks(spread(rows, "k")) >= 4


def test_a_corpus_in_one_file_is_analysed_by_many_tasks(spark, one_file):
    found = queries_more.schema_corpus(spark, one_file)
    assert found.count() == 4000 and tasks(found) >= 4


def test_paths_of_a_corpus_never_broadcast_it(spark, one_file):
    """A schema's nodes are many times its text, so sizes guessed from files are no reason to send them everywhere."""
    found = queries_more.shape_path_sets(spark, one_file)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    # the table lies by key: only the second side of a join moves, and no path from the schemas themselves joins anything
    assert plan.count("SortMergeJoin") <= 9
    assert found.where("path = 'constraints'").count() == 4000


def test_documents_in_one_file_are_parsed_by_many_tasks(spark):
    documents = spark.range(400, numPartitions=1).selectExpr("concat('d', id) AS name", "concat('<http://e/', id, '> <http://e/p> [ <http://e/q> ', id, ' ] .') AS value")
    g = rdf.of_documents(documents, rdf.parse_turtle)
    assert g.df.count() == 800 and "Repartition" in g.df._jdf.queryExecution().optimizedPlan().toString()


def test_a_validation_parses_documents_once(spark):
    plan = queries_forms.QUERIES["rdf_turtle"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan


LINES = [
    ('<a\n> <p> <b\n> .', ("<a\n>", "p", "iri", "b\n", None, None)),
    ('_:x> <p> _:y> .', ("_:x>", "p", "bnode", "_:y>", None, None)),
    ('<a> <p> "x>\\n>y" . # <z> .', ("<a>", "p", "literal", "x>\n>y", XSD + "string", None)),
    ('<a> <p> ">\n>"@en-GB .', ("<a>", "p", "literal", ">\n>", RDF + "langString", "en-GB")),
    ('<a> <p> ""^^<t> .', ("<a>", "p", "literal", "", "t", None)),
    ('<a> <p> "" .', ("<a>", "p", "literal", "", XSD + "string", None)),
    ('<a> <p> <> .', ("<a>", "p", "iri", "", None, None)),
    ('<a> <> "$1 \\\\ > <> ." .', ("<a>", None, "literal", "$1 \\ > <> .", XSD + "string", None)),
]


def test_lines_are_cut_where_their_parts_end(spark):
    got = rdf.ntriples_lines(spark.createDataFrame([(x,) for x, _ in LINES], "value string")).collect()
    assert [tuple(r) for r in got] == [want for _, want in LINES]


def test_a_line_is_matched_once(spark):
    plan = rdf.ntriples_lines(spark.range(1).selectExpr("concat('<a> <p> ', id, ' .') AS value"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:[^") == 1


def test_what_is_no_line_raises(spark):
    with pytest.raises(Exception, match="no N-Triples line"):
        rdf.ntriples_lines(spark.createDataFrame([("<a> <p> .",)], "value string")).collect()


def test_triples_of_small_documents_share_frames(spark):
    """A frame of triples is filled from many documents."""
    frames = []

    class Documents:
        """Stands for a table: runs the function on one frame of documents."""

        sparkSession = spark

        def select(self, *_):
            return self

        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):
            return self

        def distinct(self):
            return self

        def mapInPandas(self, run, _):
            pdf = pd.DataFrame({"name": [f"d{i}" for i in range(3000)], "value": [f"<http://e/{i}> <http://e/p> 1 , 2 ." for i in range(3000)]})
            frames.extend(run(iter([pdf])))
            return self

    rdf.of_documents(Documents(), rdf.parse_turtle)
    assert [len(f) for f in frames] == [6000]
