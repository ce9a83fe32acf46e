"""RDF/XML documents as triples: node and property elements, attributes, parse types, reification ids, languages and bases."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from ..schema.ast import RDF, XSD, BNode, Iri, Literal, SchemaError, resolve_iri

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = f"{{{RDF}}}"


def _name(tag: str) -> str:
    space, _, local = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
    if not space:
        raise SchemaError(f"{tag}: a name without a namespace")
    return space + local


class _Document:
    def __init__(self, base: str | None):
        self.base, self.n = base, 0

    def fresh(self) -> BNode:
        self.n += 1
        return BNode(f"_:anon{self.n}")

    def node(self, e: ET.Element, base, lang):
        """A node element: its subject comes back, its triples are yielded by ``triples``."""
        base, lang = e.get(f"{_XML}base", base), e.get(f"{_XML}lang", lang)
        if (about := e.get(f"{_R}about")) is not None:
            s = Iri(resolve_iri(base, about) if about else (base or "").partition("#")[0])
        elif (own := e.get(f"{_R}ID")) is not None:
            s = Iri(resolve_iri(base, "#" + own))
        elif (label := e.get(f"{_R}nodeID")) is not None:
            s = BNode(f"_:id{label}")
        else:
            s = self.fresh()
        return s, self._of_node(e, s, base, lang)

    def _of_node(self, e, s, base, lang):
        if e.tag != f"{_R}Description":
            yield s, RDF + "type", Iri(_name(e.tag))
        yield from self._attributes(e, s, base, lang)
        place = 0
        for p in e:
            if p.tag == f"{_R}li":
                place += 1
                predicate = f"{RDF}_{place}"
            else:
                predicate = _name(p.tag)
            yield from self._property(p, s, predicate, p.get(f"{_XML}base", base), p.get(f"{_XML}lang", lang))

    def _attributes(self, e, s, base, lang):
        syntax = {f"{_R}{x}" for x in ("about", "ID", "nodeID", "resource", "parseType", "datatype")}
        for k, v in e.attrib.items():
            if k in syntax or k.startswith(_XML) or not k.startswith("{"):
                continue
            yield s, _name(k), Iri(resolve_iri(base, v)) if k == f"{_R}type" else _text(v, None, lang)

    def _property(self, p, s, predicate, base, lang):
        kind, inner = p.get(f"{_R}parseType"), list(p)
        extra = ()
        if kind == "Literal":
            o = Literal((p.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in inner), RDF + "XMLLiteral")
        elif kind == "Resource":
            o = self.fresh()
            extra = self._of_node(_described(p), o, base, lang)
        elif kind == "Collection":
            items = [self.node(x, base, lang) for x in inner]
            cells = [self.fresh() for _ in items]
            o = cells[0] if cells else Iri(RDF + "nil")
            ends = [*cells[1:], Iri(RDF + "nil")]
            extra = [t for c, (x, ts), end in zip(cells, items, ends, strict=True) for t in [(c, RDF + "first", x), (c, RDF + "rest", end), *ts]]
        elif inner:
            if len(inner) > 1:
                raise SchemaError(f"{predicate}: more than one node in a property")
            o, extra = self.node(inner[0], base, lang)
        elif (to := p.get(f"{_R}resource")) is not None:
            o = Iri(resolve_iri(base, to) if to else (base or "").partition("#")[0])
            extra = self._attributes(p, o, base, lang)
        elif (label := p.get(f"{_R}nodeID")) is not None:
            o = BNode(f"_:id{label}")
            extra = self._attributes(p, o, base, lang)
        elif any(k.startswith("{") and not k.startswith((_XML, _R)) or k == f"{_R}type" for k in p.attrib):
            o = self.fresh()
            extra = self._attributes(p, o, base, lang)
        else:
            o = _text(p.text or "", p.get(f"{_R}datatype"), lang)
        yield s, predicate, o
        if (own := p.get(f"{_R}ID")) is not None:
            r = Iri(resolve_iri(base, "#" + own))
            yield from ((r, RDF + "type", Iri(RDF + "Statement")), (r, RDF + "subject", s), (r, RDF + "predicate", Iri(predicate)), (r, RDF + "object", o))
        yield from extra


def _described(p: ET.Element) -> ET.Element:
    e = ET.Element(f"{_R}Description")
    e.extend(list(p))
    return e


def _text(value: str, datatype: str | None, lang: str | None) -> Literal:
    if datatype is None and lang:
        return Literal(value, RDF + "langString", lang)
    return Literal(value, datatype or XSD + "string")


def parse(text: str, base: str | None = None) -> list[tuple]:
    """(subject, predicate IRI, object) of an RDF/XML document."""
    root = ET.fromstring(text)
    doc, out = _Document(base), []
    if root.tag == f"{_R}RDF":
        own, lang = root.get(f"{_XML}base", base), root.get(f"{_XML}lang")
        for e in root:
            out += doc.node(e, own, lang)[1]
    else:
        out += doc.node(root, base, None)[1]
    return out
