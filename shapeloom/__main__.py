"""Command line: ``python -m shapeloom validate|schema|convert|path|map ...``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def _schema(args):
    from .schema import resolve

    schema = resolve.load(args.schema, args.base)
    return resolve.closure(schema, resolve.file_fetcher(str(Path(args.schema).parent)))


def validate(args) -> int:
    from pyspark.sql import SparkSession

    from .shapemap import maps
    from .sources import rdf

    spark = SparkSession.builder.appName("shapeloom").getOrCreate()
    schema = _schema(args)
    form = args.data_format or {"nt": "ntriples", "rdf": "rdfxml", "xml": "rdfxml", "jsonld": "jsonld", "json": "jsonld"}.get(args.data.rsplit(".", 1)[-1], "turtle")
    graph = rdf.read(spark, args.data, form, args.base)
    text = Path(args.map).read_text(encoding="utf-8")
    wanted = maps.from_json(text, schema.prefixes) if args.map.endswith(".json") else maps.parse(text, args.base, schema.prefixes, schema.base or args.base, schema.prefixes)
    result = maps.run(graph, schema, wanted)
    if args.output:
        maps.write(result, args.output, args.form)
    else:
        for r in maps.render(result, args.form).toLocalIterator():
            print(r["value"])
    return 0


def schema(args) -> int:
    from .schema import analyze

    s = _schema(args)
    for label in s.labels:
        below = sorted(analyze.descendants(s, label))
        print(s.relativise(label) + (f" <- {', '.join(map(s.relativise, below))}" if below else ""))
    wrong = analyze.problems(s)
    print("\n".join(wrong), file=sys.stderr)
    return int(bool(wrong))


def convert(args) -> int:
    from .schema import shexj
    from .schema.show import show

    s = _schema(args)
    print(shexj.dumps(s) if args.to == "shexj" else show(s))
    return 0


def path(args) -> int:
    from .shapepath import mapping

    s = _schema(args)
    found, errors = mapping.evaluate(s, mapping.parse_path(args.path, args.base, s.prefixes))
    for x in found:
        print(x)
    for e in errors:
        print(e, file=sys.stderr)
    return int(bool(errors))


def rename(args) -> int:
    from .schema.show import show
    from .shapepath import mapping

    s = _schema(args)
    print(show(mapping.convert(s, mapping.parse(Path(args.mapping).read_text(encoding="utf-8"), args.base, s.prefixes))))
    return 0


def main(argv=None) -> int:
    top = argparse.ArgumentParser(prog="shapeloom")
    sub = top.add_subparsers(required=True)
    for name, run, more in (
        ("validate", validate, [("--data", {"required": True}), ("--data-format", {"choices": ["ntriples", "turtle", "rdfxml", "jsonld"]}), ("--map", {"required": True}), ("--form", {"default": "compact", "choices": ["compact", "details", "json"]}), ("--output", {})]),
        ("schema", schema, []),
        ("convert", convert, [("--to", {"default": "shexj", "choices": ["shexc", "shexj"]})]),
        ("path", path, [("--path", {"required": True})]),
        ("map", rename, [("--mapping", {"required": True})]),
    ):
        p = sub.add_parser(name)
        p.add_argument("--schema", required=True)
        p.add_argument("--base")
        for flag, options in more:
            p.add_argument(flag, **options)
        p.set_defaults(run=run)
    args = top.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
