"""Schemas from text, files and other schemas: formats, file search and import closure."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from . import shexc, shexj
from .ast import Schema, SchemaError

SUFFIXES = ("", ".shex", ".json")


def loads(text: str, form: str = "shexc", base: str | None = None) -> Schema:
    if form.lower() in ("shexc", "compact"):
        return shexc.parse(text, base)
    if form.lower() in ("shexj", "json"):
        return shexj.loads(text)
    if form.lower() in ("shexr", "turtle", "ttl"):
        from . import shexr

        return shexr.loads(text, base)
    raise SchemaError(f"no schema format {form}")


def _form_of(name: str) -> str:
    return "shexj" if name.endswith(".json") else "shexr" if name.endswith(".ttl") else "shexc"


def load(path: str, base: str | None = None) -> Schema:
    """Read a schema file; without a suffix, those of the two usual forms are tried."""
    for suffix in SUFFIXES:
        p = Path(str(path) + suffix)
        if p.is_file():
            return loads(p.read_text(encoding="utf-8"), _form_of(p.name), base)
    raise SchemaError(f"no schema {path}")


def file_fetcher(folder: str):
    """Imports by the last part of their IRI, from a folder."""

    def fetch(iri: str) -> Schema:
        return load(str(Path(folder) / iri.rstrip("/").rsplit("/", 1)[-1]), iri)

    return fetch


def closure(schema: Schema, fetch) -> Schema:
    """The schema with all it imports, each import once; equal labels must mean equal shapes."""
    shapes = {d.label: d for d in schema.shapes}
    start, seen, todo = schema.start, set(), list(schema.imports)
    prefixes = dict(schema.prefixes)
    while todo:
        iri = todo.pop(0)
        if iri in seen:
            continue
        seen.add(iri)
        other = fetch(iri)
        for d in other.shapes:
            if shapes.setdefault(d.label, d) != d:
                raise SchemaError(f"shape {d.label} is defined differently in {iri}")
        for p, i in other.prefixes.items():
            prefixes.setdefault(p, i)
        start = start if start is not None else other.start
        todo += [i for i in other.imports if i not in seen]
    return replace(schema, shapes=tuple(shapes.values()), start=start, prefixes=prefixes, imports=())
