"""Streams against batch: the same triples in several files, some of them twice."""

import pytest
from pyspark.sql import functions as F

from shapeloom.schema.ast import SchemaError
from shapeloom.schema.shexc import parse
from shapeloom.shapemap import maps
from shapeloom.sources import graph, rdf
from shapeloom.streaming import local

P = "PREFIX : <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
TTL = ":a :p 1, 2 ; :q 'x' ; :r 1 . :b :p 1 ; :q 'x', 'y' . :c :p 3, 4, 5 . :d :q 'z' ; :r 1, 2, 3 . :e :p 'n' ; :q 'x' . :f :p 1, 2, 3 ; :q 'x', 'y', 'z' ; :s 1 ."
SCHEMAS = [
    "{ :p xsd:integer + ; :q . }",
    "{ :p [1 2] ; :p [2 3] ? ; :q . * }",
    "CLOSED { :p . + ; :q . * }",
    "EXTRA :p { :p [1] ; :q . * ; :r . ? }",
    "{ :p . | :q . }",
    "{ ( :p . ; :q . ){1,3} }",
    "{ ! :r [2] ; :q . * ; :p . * }",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Triples with the time they came, in three files; every other one comes again in the last."""
    g = graph.of_terms(spark, rdf.parse_turtle(P + TTL)).df.coalesce(1).withColumn("_i", F.monotonically_increasing_id())
    at = str(tmp_path_factory.mktemp("stream") / "in")
    timed = g.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("_i") * 600))
    for part in (timed.where("_i % 2 = 0"), timed.where("_i % 2 = 1"), timed.where("_i % 3 = 0").withColumn("at", F.col("at") + F.expr("INTERVAL 5 MINUTES"))):
        part.drop("_i").coalesce(1).write.mode("append").parquet(at)
    return at


def streamed(spark, folder, schema, name, timed=False):
    schema_of = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema_of).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = local.flat_shape(stream, parse(P + ":S " + schema), "http://e/S", "at", "2 days") if timed else local.flat_shape(stream.drop("at"), parse(P + ":S " + schema), "http://e/S")
    seen: dict = {}

    def take(batch, _):
        for r in batch.collect():
            seen[r["node"]] = r["status"]

    q = rows.writeStream.outputMode("update").foreachBatch(take).start()
    q.processAllAvailable()
    q.stop()
    return seen


@pytest.mark.parametrize("i", range(len(SCHEMAS)))
def test_statuses_agree_with_batch(spark, folder, i):
    g = graph.of_terms(spark, rdf.parse_turtle(P + TTL))
    schema = parse(P + ":S " + SCHEMAS[i])
    nodes = ",".join(f":{x}@:S" for x in "abcdef")
    want = {r["node"]: r["status"] for r in maps.run(g, schema, maps.parse(nodes, "http://e/", {"": "http://e/"})).collect()}
    got = streamed(spark, folder, SCHEMAS[i], f"s{i}")
    # nodes without arcs that the shape looks at never come up in a stream
    assert got == {k: v for k, v in want.items() if k in got} and len(got) >= 4


def test_arcs_across_time_meet(spark, folder):
    assert streamed(spark, folder, SCHEMAS[1], "t", timed=True) == streamed(spark, folder, SCHEMAS[1], "u")


def test_what_needs_other_nodes_is_refused(spark, folder):
    for schema in ("{ :p @:T } :T { :q . }", "{ ^:p . }", "{ ( :p [1] | :p [2] ) }"):
        with pytest.raises(SchemaError):
            streamed(spark, folder, schema, "x")
