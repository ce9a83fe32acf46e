"""Turtle by blocks: the same triples as from the whole text, wherever blocks are cut."""

import pytest
from pyspark.sql import functions as F

from shapeloom.functions.terms import literal_id, term_row
from shapeloom.schema.ast import BNode
from shapeloom.sources import rdf, splits

TEXT = '''@prefix : <http://e/> .
# a comment. With a dot, a "quote and a [ bracket
@base <http://base/x/> .
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
:a :p 1.5, 2 , -3.0e2 ; :q "dot. in \\" a string" , 'single . one' ; a :T .
:b :p """long. string
with "quotes" . and a # hash
:not :a :triple . \\""" still "" inside
""" ; :q \'\'\'another
''not yet. [ ( \'\'\' ; :r <rel.ative> , <#frag.ment> .
:c :p [ :q [ :r "x." ; :s ( 1 2.5 "y. z" [ :t :u ] ) ] ; :v 3 ] . :d.e :p :f.g . :h :p "é𝄞."@en-GB , "5"^^xsd:integer.
[ :inner true ] :p _:shared .
_:shared :q _:other ; :r [] .
@prefix : <http://other/> .
BASE <more/>
:a :p <rel> . <s> a :T .
( 1 :x ) :p () .
'''


def rows(triples, n=0):
    """Triples by shape: blank nodes are told apart by how often they stand where."""
    rows = [(literal_id(s), p, *term_row(o)) for s, p, o in triples]
    return rows


def canonical(rows):
    """Blank nodes renamed by the arcs around them, a few rounds deep."""
    names = {x: "" for r in rows for x in ((r[0],) if r[0].startswith("_:") else ()) + ((r[3],) if r[2] == "bnode" else ())}
    for _ in range(6):
        new = {}
        for b in names:
            around = sorted(repr(("out", r[1], r[2], names.get(r[3], r[3]) if r[2] == "bnode" else r[3], r[4], r[5])) for r in rows if r[0] == b) + sorted(repr(("in", names.get(r[0], r[0]), r[1])) for r in rows if r[2] == "bnode" and r[3] == b)
            new[b] = str(hash(tuple(around)))
        names = new
    return sorted(repr((names.get(r[0], r[0]), r[1], r[2], names[r[3]] if r[2] == "bnode" else r[3], r[4], r[5])) for r in rows)


def read(spark, path, block, chunk):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        return [tuple(r) for r in splits.read_turtle(spark, path, "http://base/", chunk).df.collect()]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("block, chunk", [(40, 1), (64, 200), (151, 1), (333, 1 << 18), (1 << 20, 1), (1 << 20, 1 << 18)])
def test_blocks_agree_with_the_whole(spark, tmp_path, block, chunk):
    (tmp_path / "a.ttl").write_text(TEXT, encoding="utf-8")
    want = canonical(rows(rdf.parse_turtle(TEXT, "http://base/")))
    got = read(spark, str(tmp_path / "a.ttl"), block, chunk)
    assert canonical(got) == want and len(got) == len(want)


def test_blank_nodes_of_files_stay_apart(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.ttl").write_text("_:x <http://e/p> _:y . [] <http://e/p> [] .\n" * 3)
    (tmp_path / "none.ttl").write_text("")
    got = read(spark, str(tmp_path), 50, 1)
    assert len(got) == 2 * (1 + 3) and len({r[0] for r in got}) == 8 and len({r[3] for r in got if r[2] == "bnode"}) == 8


def test_states_compose():
    lines = TEXT.split("\n")
    whole, parts = splits.BlockMap(), []
    for i, line in enumerate(lines):
        whole.add(line)
        m = splits.BlockMap()
        m.add(line)
        parts.append({"file": "f", "start": i, "ends": [m.now[k][0] for k in range(3)], "depths": [m.now[k][1] for k in range(3)]})
    begins = splits.entries([*parts[::-1], {"file": "f", "start": len(lines), "ends": [0, 0, 0], "depths": [0, 0, 0]}])
    assert begins["f", len(lines)] == whole.now[0] == (splits.PLAIN, 0)
    assert begins["f", 6][0] == splits.DOUBLE and begins["f", 9][0] == splits.SINGLE


def test_a_large_file_is_parsed_by_many_tasks(spark, tmp_path):
    body = "".join(f':s{i} :p "value. {i}" ; :q [ :r {i} ] .\n' for i in range(20_000))
    (tmp_path / "l.ttl").write_text("@prefix : <http://e/> .\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        assert splits._lines(spark, str(tmp_path / "l.ttl")).rdd.getNumPartitions() >= 8
        g = rdf.read_turtle(spark, str(tmp_path / "l.ttl"))
        assert {r["p"][-1]: r["n"] for r in g.df.groupBy("p").agg(F.count("*").alias("n")).collect()} == {"p": 20_000, "q": 20_000, "r": 20_000}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bnode_type():
    assert isinstance(rdf.parse_turtle("_:x <http://e/p> 1 .")[0][0], BNode)


def test_what_declarations_come_to():
    lists = [
        ["PREFIX a: <http://x/>", "PREFIX a: <rel>", "BASE <http://b/>", "PREFIX c: <d/>", "BASE <e/>", "PREFIX f: <g>", "PREFIX c: <h>"],
        ["BASE <x/>", "PREFIX a: <r>", "BASE <y/>", "BASE <http://z/>", "BASE <http://w/>", "PREFIX : <>"],
        ["BASE <http://1/>", "BASE <two/>", "PREFIX p: <q>", "BASE <http://3/>"],
        ["prefix p: <http://e/>"] * 50,
    ]
    for a in lists:
        for before in ((None, {}), ("http://base/x/", {"a": "http://old/", "k": "http://kept/"})):
            for cut in range(len(a)):
                whole = splits.declared(splits.effective(a[:cut]), *before)
                assert splits.declared(splits.effective(a[cut:]), *whole) == splits.declared(a, *before)
    assert splits.effective(lists[3]) == ["prefix p: <http://e/>"] and len(splits.effective(["BASE <http://b/>", "PREFIX c: <d>"] * 9)) == 2


def test_declarations_before_every_statement_are_told_once_a_chunk(spark, tmp_path):
    """Every document of a joined file declares its prefixes again: what is handed to chunks must not grow with them."""
    n = 4000
    (tmp_path / "l.ttl").write_text("".join(f"PREFIX : <http://e/{i % 3}/> :s{i} :p {i} .\n" for i in range(n)))
    size = []
    keep = splits._known

    def measured(chunks, base):
        known = keep(chunks, base)
        size.append((chunks.agg(F.max(F.size("declared"))).first()[0], known.agg(F.max(F.size("prefixes"))).first()[0]))
        return known

    splits._known = measured
    try:
        got = read(spark, str(tmp_path), 20_000, 1000)
    finally:
        splits._known = keep
    assert size == [(1, 1)]
    assert sorted(r[0] for r in got) == sorted(f"<http://e/{i % 3}/s{i}>" for i in range(n))
