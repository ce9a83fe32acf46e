"""Golden cases: triples, schema and shape map to a result map."""

import pytest

from shapeloom.plans.validate import Actions, Validator
from shapeloom.schema.ast import SchemaError
from shapeloom.schema.shexc import parse
from shapeloom.shapemap import maps
from shapeloom.sources import graph, rdf

PREFIXES = "PREFIX : <http://e/>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"

CASES = [
    ("recursion", ":a :p :b . :b :p :a . :c :p :c . :d :p 1 .", ":S { :p @:S }", ":a@:S,:c@:S,:d@:S", ":a@:S,:c@:S,:d@!:S"),
    ("mutual, nothing to ask", ":a :q 1 .", ":S { :p @:T ? ; :q . } :T { :q @:S }", ":a@:S", ":a@:S"),
    ("mutual", ":a :p :b . :b :q :a . :c :p :c .", ":S { :p @:T } :T { :q @:S }", ":a@:S,:b@:T,:c@:S", ":a@:S,:b@:T,:c@!:S"),
    ("extends", ":x :p 1, 3 . :y :p 1 .", ":B { :p [1] } :A EXTENDS @:B { :p [3] }", ":x@:A,:y@:A", ":x@:A,:y@!:A"),
    ("extends base condition", ":x :p 'a', 'b' .", ":B { :p ['a'] } AND { :p ['b'] } :A EXTENDS @:B { }", ":x@:A", ":x@!:A"),
    ("extends, condition on the base's part", ":x :p 'a', 'b' . :y :p 'a' . :z :p 'b', 'c' .", ":B { :p ['b'] } AND { :p ['b'] } :A EXTENDS @:B { :p ['a'] }", ":x@:A,:y@:A,:z@:A", ":x@:A,:y@!:A,:z@!:A"),
    ("extends, NOT beside the base", ":x :p 1 ; :q 2 . :y :p 1 ; :q 3 . :z :p 1 .", ":B { :p [1] } AND NOT { :q [3] } :A EXTENDS @:B { :q . ? }", ":x@:A,:y@:A,:z@:A", ":x@:A,:y@:A,:z@:A"),
    ("extends twice with conditions", ":x :p 1, 2, 3 . :y :p 1, 3 .", ":C { :p [1 2] } AND { :p [1] } :B EXTENDS @:C { :p [2] } :A EXTENDS @:B { :p [3] }", ":x@:A,:y@:A", ":x@:A,:y@!:A"),
    ("extends a base with a node condition", ":x :p 1 ; :q 1 .", ":B IRI AND { :p [1] } AND { :p . } :C LITERAL AND { :p [1] } AND { :p . } :A EXTENDS @:B { :q . } :D EXTENDS @:C { :q . }", ":x@:A,:x@:D", ":x@:A,:x@!:D"),
    ("three constraints of one path", ":x :p 1,2,3 . :y :p 1,4 . :z :p 2,3 .", ":S { :p [1 2] ; :p [2 3] ; :p [1 3 4] ? }", ":x@:S,:y@:S,:z@:S", ":x@:S,:y@!:S,:z@:S"),
    ("abstract", ":x :p 1 . :y :p 1 ; :q 2 .", "ABSTRACT :A { :p [1 2] } :B EXTENDS @:A { :q [2] }", ":x@:A,:y@:A,:y@:B", ":x@!:A,:y@:A,:y@:B"),
    ("list", ":l1 :first :a; :rest :l2 . :l2 :first :b; :rest :nil . :l3 :first :b; :rest :l3; :z 1 .", ":Ls CLOSED { :first IRI; :rest [:nil] OR @:Ls }", ":l1@:Ls,:l2@:Ls,:l3@:Ls", ":l1@:Ls,:l2@:Ls,:l3@!:Ls"),
    ("choice", ":x :p 1; :q 2 . :y :p 1 .", ":S { :p . | :q . }", ":x@:S,:y@:S", ":x@!:S,:y@:S"),
    ("extra", ":x :p 1,2,'a' . :z :p 'a' .", ":S EXTRA :p { :p xsd:integer {1,2} }", ":x@:S,:z@:S", ":x@:S,:z@!:S"),
    ("group repeat", ":x :p 1,2; :q 2,3 . :y :p 1 .", ":S { ( :p .; :q . ){2} }", ":x@:S,:y@:S", ":x@:S,:y@!:S"),
    ("negated", ":x :p 1; :q 2 . :y :p 1 .", ":S { !:q .; :p . }", ":x@:S,:y@:S", ":x@!:S,:y@:S"),
    ("inverse", ":x :p :y . :z :p :y . :w :p :q.", ":S { ^:p IRI + } :T { ^:p [:w] }", ":y@:S,:q@:T,:x@:S", ":y@:S,:q@:T,:x@!:S"),
    ("not", ":x :p 1 . :y :p 'a' .", ":S NOT { :p xsd:integer }", ":x@:S,:y@:S", ":x@!:S,:y@:S"),
    ("nested", ":x :p [ :q 1 ] . :y :p [ :q 'a' ] .", ":S { :p { :q xsd:integer } }", ":x@:S,:y@:S", ":x@:S,:y@!:S"),
    ("start", ":x :p 1 . :y :p 'a' .", "start = @:S  :S IRI { :p xsd:integer }", ":x@START,:y@START", ":x@START,:y@!START"),
    ("ambiguous", ":x :p 1,2,3 . :y :p 1,3,4 .", ":S { :p [1 2]; :p [2 3] {1,2} }", ":x@:S,:y@:S", ":x@:S,:y@!:S"),
    ("no arcs", ":x :a 1 .", ":S { :a .? ; :b .* }", ":x@:S,:none@:S", ":x@:S,:none@:S"),
    ("datatypes", ":x :p 1 ; :q '2020-02-30'^^xsd:date . :y :p '128'^^xsd:byte .", ":I { :p xsd:integer } :D { :q xsd:date } :B { :p xsd:byte }", ":x@:I,:x@:D,:y@:B", ":x@:I,:x@!:D,:y@!:B"),
    ("languages", ":x :p 'a'@en-GB . :y :p 'a'@fr . :z :p 'a'@EN .", ":S { :p [@en~] } :T { :p [@en] }", ":x@:S,:y@:S,:z@:T,:x@:T", ":x@:S,:y@!:S,:z@:T,:x@!:T"),
    ("literal node", ":x :p 1 .", ":N xsd:integer MININCLUSIVE 1", "1@:N,0@:N,'a'@:N", "1@:N,0@!:N,'a'@!:N"),
    ("node facets", ":x :p 1 .", ":N IRI MAXLENGTH 10 :M BNODE", ":x@:N,:xyz@:N,:x@:M", ":x@:N,:xyz@!:N,:x@!:M"),
]


def run(spark, ttl, schema, shape_map, **options):
    g = graph.of_terms(spark, rdf.parse_turtle(PREFIXES + ttl))
    return maps.run(g, parse(PREFIXES + schema, "http://e/"), maps.parse(shape_map, "http://e/", {"": "http://e/"}), **options)


def expected(text):
    out = []
    for a in maps.parse(text, "http://e/", {"": "http://e/"}):
        out.append((maps.literal_id(a.selector.term), a.label, a.status))
    return sorted(out)


@pytest.mark.parametrize("ttl, schema, shape_map, want", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_case(spark, ttl, schema, shape_map, want):
    rows = run(spark, ttl, schema, shape_map).collect()
    assert sorted((r["node"], r["shape"], r["status"]) for r in rows) == expected(want)


def test_dependents_and_reasons(spark):
    rows = run(spark, ":a :p :b . :b :q :a .", ":S { :p @:T } :T { :q @:S }", ":a@:S", include_dependents=True).collect()
    assert {(r["node"], r["shape"].rsplit("/")[-1]) for r in rows} == {("<http://e/a>", "S"), ("<http://e/b>", "T")}
    rows = run(spark, ":x :p 1,2 .", ":S { :p . }", ":x@:S").collect()
    assert "cardinality of http://e/p" in rows[0]["reason"]


def test_actions(spark):
    rows = run(spark, ":x :p 1 .", ":S { :p . %<http://shex.io/extensions/Test/>{ fail(s) %} }", ":x@:S").collect()
    assert rows[0]["status"] == "nonconformant"
    seen = Actions()
    seen.register("http://e/never", lambda code: None)
    rows = run(spark, ":x :p 1 .", ":S { :p . %:never{ x %} }", ":x@:S", actions=seen).collect()
    assert rows[0]["status"] == "conformant"


def test_external(spark):
    outside = parse(PREFIXES + ":X { :p [1] }").shapes[0].expr
    rows = run(spark, ":x :p 1 .", ":S EXTERNAL", ":x@:S", resolver=lambda label: outside).collect()
    assert rows[0]["status"] == "conformant"
    with pytest.raises(SchemaError):
        run(spark, ":x :p 1 .", ":S EXTERNAL", ":x@:S")


def test_plans(spark):
    g = graph.of_terms(spark, [])
    v = Validator(parse(PREFIXES + ":N IRI :F { :p . ; :q .* } :O { :p . | :q . } :G { :p [1] | :p [2] } :H { :p [1] ; :p [2] } :R { :p @:R }"), g)
    assert [v.plan_of(f"http://e/{x}") for x in "NFOGHR"] == ["NODE", "FLAT", "SORBE", "GENERAL", "FLAT", "RECURSIVE FLAT"]


def test_flat_plan_has_one_aggregate_and_reads_two_columns(spark, tmp_path):
    from shapeloom.sources.graph import BASE, Column_, MappedGraph, TableMapping

    spark.range(10).selectExpr("id", "id % 3 as a", "id % 2 as b", "'x' as unused").write.parquet(str(tmp_path / "t"))
    g = MappedGraph(spark, {"t": spark.read.parquet(str(tmp_path / "t"))}, [TableMapping("t", "id", [Column_("a"), Column_("b"), Column_("unused")])])
    v = Validator(parse(f"<S> {{ <{BASE}a> . ; <{BASE}b> . }}", BASE), g)
    counted = v._counts(v.atoms[BASE + "S"], set(), {})[0]
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_empty_graph_and_map(spark):
    rows = run(spark, "", ":S { :p . ? } :T { :p . }", ":x@:S,:x@:T").collect()
    assert {(r["shape"], r["status"]) for r in rows} == {("http://e/S", "conformant"), ("http://e/T", "nonconformant")}


def test_count_conditions_agree_with_the_solver(spark):
    """Every bag of arcs over three constraints of one path, by conditions on counts and by assignment."""
    from itertools import product

    from shapeloom.functions import rbe

    values = [(1,), (2,), (3,), (1, 2), (2, 3), (1, 2, 3)]
    fits = {f"v{i}": some for i, some in enumerate(values)}
    sets = {k: " ".join(f"'{v}'" for v, some in fits.items() if k in some) for k in (1, 2, 3)}
    bags = [b for b in product(range(2), repeat=len(values)) if any(b)]
    ttl = " ".join(f":n{i} :p {', '.join(repr(v) for v, n in zip(fits, b, strict=True) if n)} ." for i, b in enumerate(bags))
    for bounds in (((1, 1), (1, 2), (0, None)), ((0, 1), (2, 2), (1, 1)), ((0, None), (0, 0), (1, 3))):
        text = " ; ".join(f":p [{sets[k]}] {{{lo},{'' if hi is None else hi}}}" for k, (lo, hi) in zip((1, 2, 3), bounds, strict=True))
        rows = run(spark, ttl, f":S {{ {text} }}", "{FOCUS :p _}@:S").collect()
        got = {int(r["node"].rsplit("/n", 1)[1][:-1]): r["status"] == "conformant" for r in rows}
        e = rbe.And(tuple(rbe.Symbol(k, lo, hi) for k, (lo, hi) in zip((1, 2, 3), bounds, strict=True)))
        want = {i: rbe.assignable(e, [(some, n) for some, n in zip(values, b, strict=True) if n]) for i, b in enumerate(bags)}
        assert got == want


def test_long_chains_take_few_rounds(spark):
    n = 300
    ttl = " ".join(f":c{i} :next :c{i + 1} ." for i in range(n)) + f" :c{n} :last 1 . :d0 :next :d1 . :d1 :next :d2 . :d2 :next :d0 . :e0 :next :e1, :e2 . :f0 :next :e0 . :g0 :next 1 ."
    g = graph.of_terms(spark, rdf.parse_turtle(PREFIXES + ttl))
    schema = parse(PREFIXES + ":S IRI { :next @:S ? ; :bad . {0} }", "http://e/")
    v = Validator(schema, g)
    ask = lambda text: {r["node"]: r["ok"] for r in v.evaluate({"http://e/S": maps.select(g, maps.parse(text + "@:S", "http://e/", {"": "http://e/"})[0].selector)})["http://e/S"].collect()}
    one = ask(":c0")
    assert all(one.values()) and len(one) == n + 1 and v.rounds <= 11
    got = ask("{FOCUS :next _}")
    assert all(got[f"<http://e/{x}>"] for x in ("c0", "d0", "d2")) and not any(got[f"<http://e/{x}>"] for x in ("e0", "f0", "g0"))


def test_rounds_look_again_at_what_lost_a_target_only(spark):
    ttl = ":a :p :b . :b :p :c . :c :q 1 . :d :p :e . :e :p :d . :f :p :a, :d . :g :p :d . :h :r :a ."
    want = {"a": False, "b": False, "c": False, "d": True, "e": True, "f": False, "g": True}
    rows = run(spark, ttl, ":S { :p @:S + } OR { :z . }", "{FOCUS :p _}@:S, :c@:S").collect()
    assert {r["node"][10:-1]: r["status"] == "conformant" for r in rows} == want


EVEN = ':P { :r ["u"] ; :prev NOT @:Q ? } :Q { :r . ; :prev NOT @:P ? }'


@pytest.mark.parametrize(
    "ttl, schema, shape_map, want",
    [
        (":a :r 'u' . :b :r 'u' ; :prev :a . :c :r 'u' ; :prev :b . :d :r 'v' ; :prev :c . :e :r 'u' ; :prev :d .".replace("'", '"'), EVEN, ":a@:P,:b@:P,:b@:Q,:c@:P,:c@:Q,:d@:P,:d@:Q,:e@:P,:e@:Q", ":a@:P,:b@!:P,:b@!:Q,:c@:P,:c@:Q,:d@!:P,:d@!:Q,:e@:P,:e@:Q"),
        # on a cycle of data each label may be assumed, when it is the one that is asked for
        (':x :r "u" ; :prev :x . :y :r "v" ; :prev :y .', EVEN, ":x@:P,:x@:Q,:y@:P,:y@:Q", ":x@:P,:x@:Q,:y@!:P,:y@:Q"),
        (":a :p :b . :b :p :c . :c :q 1 .", ":S NOT { :p NOT @:S } ", ":a@:S,:b@:S,:c@:S", ":a@:S,:b@:S,:c@:S"),
        (":a :p 1 . :b :q 1 .", ":S @:S AND { :p . } :T @:U OR { :q . } :U @:T", ":a@:S,:b@:S,:a@:T,:b@:U", ":a@:S,:b@!:S,:a@:T,:b@:U"),
    ],
    ids=["chain", "assumed", "double", "own reference"],
)
def test_even_negation(spark, ttl, schema, shape_map, want):
    rows = run(spark, ttl, schema, shape_map).collect()
    assert sorted((r["node"], r["shape"], r["status"]) for r in rows) == expected(want)
    assumed = {(r["node"][10:-1], r["shape"][-1]) for r in rows if "assumption" in (r["reason"] or "")}
    assert assumed == ({("x", "P"), ("x", "Q")} if ":x :r" in ttl else set())


def test_odd_negation_is_refused(spark):
    for schema in (":S { :p NOT @:S }", ":S { :p NOT @:T } :T { :p NOT @:U } :U { :p NOT @:S }", ":S EXTRA :p { :p @:S }", ":S NOT @:S"):
        with pytest.raises(SchemaError, match="odd number of negations"):
            Validator(parse(PREFIXES + schema, "http://e/"), graph.of_terms(spark, []))


BASE_CASES = [
    (":B (IRI AND { :p [1] }) OR { :p [2] } :A EXTENDS @:B { :q . ? }", ":x :p 1 ; :q 5 . _:b :p 1 . :y :p 2 . :z :p 3 .", {"x": True, "b": False, "y": True, "z": False}),
    (":B NOT LITERAL AND NOT { :p [1] } AND { :p . + } :A EXTENDS @:B { :p [1] * }", ":x :p 1, 2 . :y :p 1 . :z :p 2 .", {"x": True, "y": False, "z": True}),
    (":B { :p [1 2] + } OR BNODE :A EXTENDS @:B { :p [2 3] }", ":x :p 1, 2 . :y :p 3 . _:b :p 3 . :z :p 1, 3 .", {"x": True, "y": False, "b": True, "z": True}),
    (":C { :p [1 2] } :B @:C AND ({ :p [1] } OR { :p [2] ; :q [1] }) :A EXTENDS @:B { :q [1 2] * }", ":x :p 1 ; :q 2 . :y :p 2 ; :q 1 . :z :p 2 ; :q 2 .", {"x": True, "y": True, "z": False}),
]


@pytest.mark.parametrize("schema, ttl, want", BASE_CASES)
def test_choices_and_node_conditions_in_bases(spark, schema, ttl, want):
    rows = run(spark, ttl, schema, "{FOCUS :p _}@:A").collect()
    got = {(r["node"][10:-1] if r["node"].startswith("<") else "b"): r["status"] == "conformant" for r in rows}
    assert got == want


def served(spark, ttl, schema, shape_map):
    g = graph.of_terms(spark, rdf.parse_turtle(PREFIXES + ttl))
    rows = maps.evidence(g, parse(PREFIXES + schema, "http://e/"), maps.parse(shape_map, "http://e/", {"": "http://e/"})).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["node"][10:-1], []).append((r["part"], r["constraint"], r["target"].split("^^")[0].strip('"')))
    return {k: sorted(v) for k, v in out.items()}


def test_evidence(spark):
    flat = served(spark, ":x :p 1, 2 ; :q :y . :y :p 9 . :z :p 1 ; :q :x .", ":S EXTRA :p { :p [1 2 3] + ; :q IRI }", "{FOCUS :q _}@:S")
    assert flat == {"x": [(0, 0, "1"), (0, 0, "2"), (0, 1, "<http://e/y>")], "z": [(0, 0, "1"), (0, 1, "<http://e/x>")]}
    shared = served(spark, ":x :p 1, 2, 3 . :y :p 2 .", ":S { :p [1 2] ; :p [2 3] {1,2} }", "{FOCUS :p _}@:S")
    assert set(shared) == {"x"} and len(shared["x"]) == 3 and (0, 0, "1") in shared["x"] and {(0, 1, "2"), (0, 1, "3")} < set(shared["x"])
    inverse = served(spark, ":a :p :x . :b :p :x .", ":S { ^:p IRI {2} }", ":x@:S")
    assert inverse == {"x": [(0, 0, "<http://e/a>"), (0, 0, "<http://e/b>")]}
    either = served(spark, ":x :p 1 . :y :q 1 .", ":S { :p . } OR { :q . }", ":x@:S, :y@:S")
    assert either == {"x": [(0, 0, "1")], "y": [(1, 0, "1")]}
    bases = served(spark, ":x :p 1, 2, 3 .", ":B { :p [1 2] } AND { :p [1 2] } :A EXTENDS @:B { :p [2 3] {2} }", ":x@:A")
    assert bases == {"x": [(0, 0, "1"), (0, 1, "1"), (0, 2, "2"), (0, 2, "3")]}
    assert served(spark, ":x :p :y . :y :p :x .", ":S { :p @:S }", ":x@:S") == {"x": [(0, 0, "<http://e/y>")]}
    assert served(spark, ":x :p 1 .", ":S IRI", ":x@:S") == {} and served(spark, "", ":S { :p . }", ":x@:S") == {}


def test_many_arcs_over_six_constraints_in_a_choice(spark):
    """A node of 10,000 arcs; its counts are solved at once and every arc gets a constraint."""
    from pyspark.sql import functions as F

    n = 10_000
    lex = F.col("id").cast("string")
    rows = spark.range(n).select(F.lit("<http://e/x>").alias("s"), F.lit("http://e/p").alias("p"), F.lit("literal").alias("o_kind"), lex.alias("o_lex"), F.lit("http://www.w3.org/2001/XMLSchema#integer").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    g = graph.Graph(rows, distinct=False)
    c = lambda lo, hi, card: f":p xsd:integer MININCLUSIVE {lo} MAXEXCLUSIVE {hi} {card}"
    schema = f":S {{ ( {c(0, 6000, '+')} ; {c(2500, 9000, '{1,4000}')} ; {c(5000, 10000, '{0,3000}')} ) | ( {c(0, 7000, '')} ; {c(3000, 10000, '{1,2}')} ) {{1,}} | {c(0, 100, '*')} }}"
    rows = maps.evidence(g, parse(PREFIXES + schema, "http://e/"), maps.parse(":x@:S", "http://e/", {"": "http://e/"}))
    got = {r["constraint"]: (r["n"], r["low"], r["high"]) for r in rows.groupBy("constraint").agg(F.count("*").alias("n"), F.min(F.regexp_extract("target", r"([0-9]+)", 1).cast("int")).alias("low"), F.max(F.regexp_extract("target", r"([0-9]+)", 1).cast("int")).alias("high")).collect()}
    assert sum(v[0] for v in got.values()) == n == rows.select("target").distinct().count()
    if set(got) <= {0, 1, 2}:
        assert got[1][0] <= 4000 and got.get(2, (0,))[0] <= 3000 and got[0][2] < 6000 and 2500 <= got[1][1]
    else:
        assert set(got) == {3, 4} and got[3][0] <= got[4][0] <= 2 * got[3][0] and got[3][2] < 7000 and got[4][1] >= 3000
