"""JSON form of schemas: decoding and encoding."""

from __future__ import annotations

import json

from .ast import (
    XSD,
    Annotation,
    BNode,
    Declaration,
    EachOf,
    Inclusion,
    Iri,
    LanguageTag,
    Literal,
    NodeConstraint,
    OneOf,
    Schema,
    SchemaError,
    SemAct,
    Shape,
    ShapeAnd,
    ShapeExternal,
    ShapeNot,
    ShapeOr,
    ShapeRef,
    Stem,
    StemRange,
    TripleConstraint,
    ValueExpr,
    triple_map,
)

COUNTS = ("length", "minlength", "maxlength", "totaldigits", "fractiondigits")
BOUNDS = ("mininclusive", "minexclusive", "maxinclusive", "maxexclusive")


def _many(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _term(x):
    if isinstance(x, str):
        return BNode(x) if x.startswith("_:") else Iri(x)
    if "value" not in x:
        raise SchemaError(f"no term: {x}")
    if x.get("language"):
        return Literal(x["value"], "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", x["language"])
    return Literal(x["value"], x.get("type") or XSD + "string")


def _value(x):
    if isinstance(x, str) or "value" in x:
        return _term(x)
    kind = x.get("type", "")
    if kind == "Language":
        return LanguageTag(x["languageTag"])
    for name, short in (("Iri", "iri"), ("Literal", "literal"), ("Language", "language")):
        if kind == f"{name}Stem":
            return Stem(short, x["stem"])
        if kind == f"{name}StemRange":
            stem = x.get("stem")
            stem = None if isinstance(stem, dict) else stem
            return StemRange(short, stem, tuple(_exclusion(e, short) for e in x.get("exclusions", [])))
    raise SchemaError(f"no value: {x}")


def _exclusion(e, kind: str):
    if isinstance(e, str):
        return {"iri": Iri, "literal": Literal, "language": LanguageTag}[kind](e)
    return _value(e)


def _acts(xs) -> tuple:
    return tuple(SemAct(a["name"], a.get("code")) for a in _many(xs))


def _notes(xs) -> tuple:
    return tuple(Annotation(a["predicate"], _term(a["object"])) for a in _many(xs))


def _number(x) -> Literal:
    if isinstance(x, int):
        return Literal(str(x), XSD + "integer")
    return Literal(repr(x), XSD + ("double" if "e" in repr(x) else "decimal"))


def shape_expr(x):
    if isinstance(x, str):
        return ShapeRef(x)
    kind = x.get("type")
    if kind in ("ShapeAnd", "ShapeOr"):
        return {"ShapeAnd": ShapeAnd, "ShapeOr": ShapeOr}[kind](tuple(shape_expr(e) for e in x["shapeExprs"]))
    if kind == "ShapeNot":
        return ShapeNot(shape_expr(x["shapeExpr"]))
    if kind == "ShapeExternal":
        return ShapeExternal()
    if kind == "ShapeRef":
        return ShapeRef(x["reference"])
    if kind == "NodeConstraint":
        facets = []
        for name in (*COUNTS, "pattern", *BOUNDS):
            if name in x:
                facets.append((name, x[name], x.get("flags", "")) if name == "pattern" else (name, x[name]) if name in COUNTS else (name, _number(x[name])))
        values = tuple(_value(v) for v in x["values"]) if "values" in x else None
        return NodeConstraint(x.get("nodeKind"), x.get("datatype"), tuple(facets), values)
    if kind == "Shape":
        return Shape(
            triple_expr(x["expression"]) if x.get("expression") is not None else None,
            bool(x.get("closed", False)),
            tuple(dict.fromkeys(_many(x.get("extra")))),
            tuple(_many(x.get("extends"))),
            tuple(_many(x.get("restricts"))),
            _acts(x.get("semActs")),
            _notes(x.get("annotations")),
        )
    raise SchemaError(f"no shape expression: {kind}")


def triple_expr(x):
    if isinstance(x, str):
        return Inclusion(x)
    kind = x.get("type")
    lo, hi = x.get("min", 1), x.get("max", 1)
    hi = None if hi in (-1, "*") else hi
    common = {"acts": _acts(x.get("semActs")), "annotations": _notes(x.get("annotations")), "id": x.get("id")}
    if kind in ("EachOf", "OneOf"):
        return {"EachOf": EachOf, "OneOf": OneOf}[kind](tuple(triple_expr(e) for e in x["expressions"]), lo, hi, **common)
    if kind == "TripleConstraint":
        value = shape_expr(x["valueExpr"]) if "valueExpr" in x else None
        return TripleConstraint(x["predicate"], None if value == Shape() else value, lo, hi, bool(x.get("inverse")), bool(x.get("negated")), **common)
    if kind == "Inclusion":
        return Inclusion(x["include"])
    raise SchemaError(f"no triple expression: {kind}")


def loads(text: str) -> Schema:
    x = json.loads(text)
    if not isinstance(x, dict) or x.get("type") != "Schema":
        raise SchemaError("no schema")
    shapes = []
    for d in x.get("shapes", []):
        if d.get("type") == "ShapeDecl":
            shapes.append(Declaration(d["id"], shape_expr(d["shapeExpr"]), bool(d.get("abstract", False))))
        else:
            shapes.append(Declaration(d["id"], shape_expr({k: v for k, v in d.items() if k != "id"}), bool(d.get("abstract", False))))
    start = shape_expr(x["start"]) if "start" in x else None
    out = Schema(tuple(shapes), start, _acts(x.get("startActs")), x.get("prefixes", {}), x.get("base"), tuple(x.get("imports", [])))
    triple_map(out)
    return out


# encoding -------------------------------------------------------------------


def _term_json(t):
    if isinstance(t, Iri | BNode):
        return t.value
    out = {"value": t.lex}
    if t.lang:
        out["language"] = t.lang
    elif t.dt != XSD + "string":
        out["type"] = t.dt
    return out


def _value_json(v):
    if isinstance(v, LanguageTag):
        return {"type": "Language", "languageTag": v.tag}
    if isinstance(v, Stem):
        return {"type": f"{v.kind.capitalize()}Stem", "stem": v.stem}
    if isinstance(v, StemRange):
        plain = {"iri": lambda e: e.value, "literal": lambda e: e.lex, "language": lambda e: e.tag}[v.kind]
        return {"type": f"{v.kind.capitalize()}StemRange", "stem": {"type": "Wildcard"} if v.stem is None else v.stem, "exclusions": [_value_json(e) if isinstance(e, Stem) else plain(e) for e in v.exclusions]}
    return _term_json(v)


def _shared(x) -> dict:
    out: dict = {}
    if x.acts:
        out["semActs"] = [{"type": "SemAct", "name": a.name} | ({"code": a.code} if a.code is not None else {}) for a in x.acts]
    if x.annotations:
        out["annotations"] = [{"type": "Annotation", "predicate": a.predicate, "object": _term_json(a.object)} for a in x.annotations]
    return out


def shape_json(se):
    if isinstance(se, ShapeRef):
        return se.label
    if isinstance(se, ShapeAnd | ShapeOr):
        return {"type": type(se).__name__, "shapeExprs": [shape_json(e) for e in se.exprs]}
    if isinstance(se, ShapeNot):
        return {"type": "ShapeNot", "shapeExpr": shape_json(se.expr)}
    if isinstance(se, ShapeExternal):
        return {"type": "ShapeExternal"}
    if isinstance(se, NodeConstraint):
        out: dict = {"type": "NodeConstraint"}
        if se.kind:
            out["nodeKind"] = se.kind
        if se.datatype:
            out["datatype"] = se.datatype
        for f in se.facets:
            out[f[0]] = (float(f[1].lex) if set(f[1].lex) & set(".eE") else int(f[1].lex)) if isinstance(f[1], Literal) else f[1]
            if len(f) > 2 and f[2]:
                out["flags"] = f[2]
        if se.values is not None:
            out["values"] = [_value_json(v) for v in se.values]
        return out
    out = {"type": "Shape"}
    if se.closed:
        out["closed"] = True
    for name in ("extra", "extends", "restricts"):
        if getattr(se, name):
            out[name] = list(getattr(se, name))
    if se.expression is not None:
        out["expression"] = triple_json(se.expression)
    return out | _shared(se)


def triple_json(te):
    if isinstance(te, Inclusion):
        return te.label
    if isinstance(te, ValueExpr):
        raise SchemaError("value expressions have no JSON form")
    out: dict = {"type": type(te).__name__}
    if te.id:
        out["id"] = te.id
    if isinstance(te, EachOf | OneOf):
        out["expressions"] = [triple_json(e) for e in te.exprs]
    else:
        for name in ("inverse", "negated"):
            if getattr(te, name):
                out[name] = True
        out["predicate"] = te.predicate
        if te.value is not None:
            out["valueExpr"] = shape_json(te.value)
    if (te.min, te.max) != (1, 1):
        out |= {"min": te.min, "max": -1 if te.max is None else te.max}
    return out | _shared(te)


def dumps(schema: Schema) -> str:
    out: dict = {"@context": "http://www.w3.org/ns/shex.jsonld", "type": "Schema"}
    if schema.imports:
        out["imports"] = list(schema.imports)
    if schema.start_acts:
        out["startActs"] = [{"type": "SemAct", "name": a.name} | ({"code": a.code} if a.code is not None else {}) for a in schema.start_acts]
    if schema.start is not None:
        out["start"] = shape_json(schema.start)
    if schema.shapes:
        out["shapes"] = [{"type": "ShapeDecl", "id": d.label} | ({"abstract": True} if d.abstract else {}) | {"shapeExpr": shape_json(d.expr)} for d in schema.shapes]
    return json.dumps(out, indent=2, ensure_ascii=False)
