"""A manifest of self-made cases, run as a whole: one per golden case, and cases that have to fail."""

from test_validate import CASES, EVEN, PREFIXES

from shapeloom.shapemap import manifest

HEAD = "PREFIX mf: <http://www.w3.org/2001/sw/DataAccess/tests/test-manifest#> PREFIX sht: <http://www.w3.org/ns/shacl/test-suite#> PREFIX : <http://e/>\n"


def test_suite(spark, tmp_path):
    entries, included = [], []
    for i, (_, ttl, schema, shape_map, want) in enumerate(CASES):
        (tmp_path / f"{i}.ttl").write_text(PREFIXES + ttl)
        (tmp_path / f"{i}.shex").write_text("BASE <http://e/>\n" + PREFIXES + schema)
        (tmp_path / f"{i}.sm").write_text(shape_map)
        (tmp_path / f"{i}.out").write_text(want)
        entries.append(f'[ a sht:Validate ; mf:name "case {i}" ; mf:action [ sht:schema <{i}.shex> ; sht:data <{i}.ttl> ; sht:map <{i}.sm> ] ; mf:result [ sht:resultShapeMap <{i}.out> ] ]')
    odd = {"odd": ":S { :p NOT @:S }", "missing": ":S { :p @:T }", "syntax": ":S { :p "}
    for name, text in odd.items():
        (tmp_path / f"{name}.shex").write_text(PREFIXES + text)
        included.append(f'[ a sht:NegativeStructure ; mf:name "{name}" ; mf:action [ sht:schema <{name}.shex> ] ]')
    (tmp_path / "even.shex").write_text(PREFIXES + EVEN)
    (tmp_path / "even.ttl").write_text(PREFIXES + ':a :r "u" . :b :r "u" ; :prev :a .')
    for focus, kind in (("a", "ValidationTest"), ("b", "ValidationFailure")):
        included.append(f'[ a sht:{kind} ; mf:name "even {focus}" ; mf:action [ sht:schema <even.shex> ; sht:data <even.ttl> ; sht:shape :P ; sht:focus :{focus} ] ]')
    included.append('[ a sht:ValidationTest ; mf:name "no data" ; mf:action [ sht:schema <even.shex> ; sht:data <gone.ttl> ; sht:shape :P ; sht:focus :a ] ]')
    (tmp_path / "more.ttl").write_text(HEAD + f":m mf:entries ( {' '.join(included)} ) .")
    (tmp_path / "manifest.ttl").write_text(HEAD + f":m mf:include ( <more.ttl> ) ; mf:entries ( {' '.join(entries)} ) .")
    found = manifest.read(str(tmp_path / "manifest.ttl"))
    rows = {r["name"]: r for r in manifest.run_all(spark, found).collect()}
    assert len(rows) == len(found) == len(CASES) + 6
    broken = rows.pop("no data")
    assert broken["ok"] is None and "FileNotFoundError" in broken["error"]
    assert all(r["ok"] for r in rows.values()), [tuple(r) for r in rows.values() if not r["ok"]]
