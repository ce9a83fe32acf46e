"""JSON-LD documents as triples: inline contexts, nested nodes, typed and language-tagged values, lists, sets, reverse properties and graphs."""

from __future__ import annotations

import json

from ..schema.ast import RDF, XSD, BNode, Iri, Literal, SchemaError, resolve_iri


class _Context:
    """Terms, prefixes and defaults; a nested one starts from a copy of its parent."""

    def __init__(self, base: str | None = None):
        self.base, self.vocab, self.lang, self.terms = base, None, None, {}

    def with_(self, c) -> _Context:
        if c is None:
            return _Context(self.base)
        out = _Context(self.base)
        out.vocab, out.lang, out.terms = self.vocab, self.lang, dict(self.terms)
        for part in c if isinstance(c, list) else [c]:
            if part is None:
                out = _Context(self.base)
                continue
            if not isinstance(part, dict):
                raise SchemaError(f"context {part} is not in the document, and none is fetched")
            out.base = resolve_iri(out.base, part["@base"]) if part.get("@base") else out.base
            out.vocab, out.lang = part.get("@vocab", out.vocab), part.get("@language", out.lang)
            raw = {k: {"@id": v} if isinstance(v, str) or v is None else v for k, v in part.items() if not k.startswith("@")}
            out.terms |= raw
            for k, v in raw.items():
                at = v.get("@reverse") or v.get("@id", k)
                out.terms[k] = v | {"@iri": at if at is None or at.startswith("@") else out.term(at, {k})}
        return out

    def term(self, name: str, seen=frozenset()) -> str | None:
        """IRI of a term, a compact or a full IRI; None if it stands for nothing."""
        if name.startswith("@"):
            return name
        d = self.terms.get(name)
        if d is not None and name not in seen:
            return d["@iri"] if "@iri" in d else self.term(d.get("@id", name) or "", seen | {name}) if d.get("@id", name) != name else self._other(name, seen)
        return self._other(name, seen)

    def _other(self, name: str, seen) -> str | None:
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//"):
            space = self.term(prefix, seen | {name}) if prefix in self.terms and prefix not in seen else None
            return space + local if space else name
        if colon:
            return name
        return self.vocab + name if self.vocab is not None else None

    def iri(self, name: str) -> str:
        """IRI of a value of ``@id``: compact, or against the base."""
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//") and prefix in self.terms:
            return self.term(prefix) + local
        return resolve_iri(self.base, name)


class _Document:
    def __init__(self):
        self.n, self.out = 0, []

    def fresh(self) -> BNode:
        self.n += 1
        return BNode(f"_:anon{self.n}")

    def ref(self, name: str, c: _Context):
        return BNode(f"_:id{name[2:]}") if name.startswith("_:") else Iri(c.iri(name))

    def node(self, x: dict, c: _Context):
        """The subject of a node object, whose triples are added."""
        if "@context" in x:
            c = c.with_(x["@context"])
        keys = {k: c.term(k) for k in x}
        ids = [x[k] for k, v in keys.items() if v == "@id"]
        s = self.ref(ids[0], c) if ids else self.fresh()
        for k, v in keys.items():
            if v == "@type":
                for t in _many(x[k]):
                    name = c.term(t)
                    self.out.append((s, RDF + "type", self.ref(t, c) if t.startswith("_:") else Iri(name or c.iri(t))))
            elif v == "@graph" or v == "@included":
                for y in _many(x[k]):
                    self.node(y, c)
            elif v == "@reverse":
                for name, ys in x[k].items():
                    for y in _many(ys):
                        self.out.append((self.value(y, {"@type": "@id"}, c), c.term(name), s))
            elif v is not None and not v.startswith(("@", "_:")) and ":" in v:
                d = c.terms.get(k, {})
                self.property(s, v, x[k], d, c)
        return s

    def property(self, s, predicate: str, value, d: dict, c: _Context) -> None:
        if d.get("@container") == "@language" and isinstance(value, dict):
            for lang, texts in sorted(value.items()):
                self.out += [(s, predicate, Literal(t, RDF + "langString", lang) if lang != "@none" else Literal(t)) for t in _many(texts)]
            return
        if d.get("@container") == "@list" and not (isinstance(value, dict) and "@list" in value):
            value = {"@list": _many(value)}
        for y in _many(value):
            if y is None:
                continue
            o = self.value(y, d, c)
            if o is not None:
                self.out.append((o, predicate, s) if "@reverse" in d else (s, predicate, o))

    def value(self, y, d: dict, c: _Context):
        if isinstance(y, dict):
            if "@list" in y:
                head: Iri | BNode = Iri(RDF + "nil")
                for item in reversed([self.value(z, d, c) for z in _many(y["@list"])]):
                    cell = self.fresh()
                    self.out += [(cell, RDF + "first", item), (cell, RDF + "rest", head)]
                    head = cell
                return head
            if "@value" in y:
                if y["@value"] is None:
                    return None
                return _literal(y["@value"], c.term(y["@type"]) if y.get("@type") else None, y.get("@language"))
            return self.node(y, c)
        kind = d.get("@type")
        if isinstance(y, str) and kind == "@id":
            return self.ref(y, c)
        if isinstance(y, str) and kind == "@vocab":
            return self.ref(y, c) if y.startswith("_:") else Iri(c.term(y) or c.iri(y))
        return _literal(y, c.term(kind) if kind and not kind.startswith("@") else None, d.get("@language", c.lang) if isinstance(y, str) and not kind else None)


def _literal(v, datatype: str | None, lang: str | None) -> Literal:
    if isinstance(v, bool):
        return Literal("true" if v else "false", datatype or XSD + "boolean")
    if isinstance(v, int) or isinstance(v, float) and v == int(v) and abs(v) < 1e21 and datatype != XSD + "double":
        return Literal(str(int(v)), datatype or XSD + "integer")
    if isinstance(v, float):
        mantissa, _, power = f"{v:.15E}".partition("E")
        mantissa = mantissa.rstrip("0")
        return Literal(f"{mantissa}{'0' if mantissa.endswith('.') else ''}E{int(power)}", datatype or XSD + "double")
    if lang:
        return Literal(v, RDF + "langString", lang)
    return Literal(v, datatype or XSD + "string")


def _many(x) -> list:
    if isinstance(x, dict) and "@set" in x:
        return _many(x["@set"])
    return x if isinstance(x, list) else [x]


def parse(text: str, base: str | None = None) -> list[tuple]:
    """(subject, predicate IRI, object) of a JSON-LD document; named graphs are read as one."""
    doc, data = _Document(), json.loads(text)
    for x in _many(data):
        doc.node(x, _Context(base))
    return doc.out
