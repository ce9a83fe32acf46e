"""Node constraints as pure column predicates over a term: no UDF, nothing per row in Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema.ast import RDF, XSD, BNode, Iri, LanguageTag, Literal, NodeConstraint, SchemaError, Stem, StemRange
from .terms import DECIMAL_TYPES, DOUBLE_TYPES, TermColumns, as_double, decimal_order, is_number, valid_lexical


def _all(xs) -> Column:
    return reduce(lambda a, b: a & b, xs, F.lit(True))


def _any(xs) -> Column:
    return reduce(lambda a, b: a | b, xs, F.lit(False))


def node_kind(kind: str, t: TermColumns) -> Column:
    return {"iri": t.kind == "iri", "bnode": t.kind == "bnode", "literal": t.kind == "literal", "nonliteral": t.kind != "literal"}[kind]


def datatype(dt: str, t: TermColumns) -> Column:
    return (t.kind == "literal") & (t.dt == dt) & valid_lexical(dt, t.lex)


def _stem(kind: str, stem: str, t: TermColumns) -> Column:
    if kind == "iri":
        return (t.kind == "iri") & t.lex.startswith(stem)
    if kind == "literal":
        return (t.kind == "literal") & t.lex.startswith(stem)
    tag, low = F.lower(t.lang), stem.lower()
    if not low:
        return t.lang.isNotNull()
    return t.lang.isNotNull() & ((tag == low) | tag.startswith(low + "-"))


def value(v, t: TermColumns) -> Column:
    """Membership of a term in one value of a value set."""
    if isinstance(v, Iri):
        return (t.kind == "iri") & (t.lex == v.value)
    if isinstance(v, BNode):
        return (t.kind == "bnode") & (t.lex == v.value)
    if isinstance(v, Literal):
        same = (t.kind == "literal") & (t.lex == v.lex)
        if v.lang:
            return same & (F.lower(t.lang) == v.lang.lower())
        return same & (t.dt == v.dt)
    if isinstance(v, LanguageTag):
        return t.lang.isNotNull() & (F.lower(t.lang) == v.tag.lower())
    if isinstance(v, Stem):
        return _stem(v.kind, v.stem, t)
    if isinstance(v, StemRange):
        kinds = {"iri": t.kind == "iri", "literal": t.kind == "literal", "language": t.lang.isNotNull()}
        inside = kinds[v.kind] if v.stem is None else _stem(v.kind, v.stem, t)
        return inside & ~_any(_excluded(v.kind, e, t) for e in v.exclusions)
    raise SchemaError(f"no value: {v}")


def _excluded(kind: str, e, t: TermColumns) -> Column:
    if isinstance(e, Stem):
        return _stem(kind, e.stem, t)
    if isinstance(e, Literal) and kind == "literal":
        return (t.kind == "literal") & (t.lex == e.lex)
    return value(e, t)


def value_set(values: tuple, t: TermColumns) -> Column:
    """OR over the values; plain IRIs and literals of one datatype fold into one IN list each."""
    iris = [v.value for v in values if isinstance(v, Iri)]
    by_type: dict[str, list[str]] = {}
    rest = []
    for v in values:
        if isinstance(v, Literal) and not v.lang:
            by_type.setdefault(v.dt, []).append(v.lex)
        elif not isinstance(v, Iri):
            rest.append(value(v, t))
    parts = [(t.kind == "iri") & t.lex.isin(iris)] if iris else []
    parts += [(t.kind == "literal") & (t.dt == dt) & t.lex.isin(xs) for dt, xs in by_type.items()]
    return _any(parts + rest)


def _java_pattern(p: str) -> str:
    """XPath's escapes that Java lacks."""
    name = r":A-Z_a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C-\u200D\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD"
    return p.replace(r"\i", f"[{name}]").replace(r"\c", rf"[{name}\-.0-9\u00B7\u0300-\u036F\u203F-\u2040]")


def facet(f: tuple, t: TermColumns) -> Column:
    name, arg = f[0], f[1]
    if name == "length":
        return F.length(t.lex) == arg
    if name == "minlength":
        return F.length(t.lex) >= arg
    if name == "maxlength":
        return F.length(t.lex) <= arg
    if name == "pattern":
        flags = f[2] if len(f) > 2 else ""
        return t.lex.rlike((f"(?{flags})" if flags else "") + _java_pattern(arg))
    if name in ("totaldigits", "fractiondigits"):
        lex = t.lex
        number = (t.kind == "literal") & t.dt.isin(DECIMAL_TYPES) & F.coalesce(lex.rlike(r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z"), F.lit(False))
        fraction = F.regexp_extract(lex, r"\.([0-9]*?)0*$", 1)
        whole = F.regexp_extract(lex, r"^[+-]?0*([0-9]*)", 1)
        if name == "fractiondigits":
            return number & (F.length(fraction) <= arg)
        # without a whole part, zeros that lead the fraction carry no digit
        digits = F.when(whole == "", F.length(F.regexp_replace(fraction, "^0+", ""))).otherwise(F.length(whole) + F.length(fraction))
        return number & (F.greatest(digits, F.lit(1)) <= arg)
    ops = {"mininclusive": lambda a, b: a >= b, "minexclusive": lambda a, b: a > b, "maxinclusive": lambda a, b: a <= b, "maxexclusive": lambda a, b: a < b}
    if name not in ops:
        raise SchemaError(f"no facet {name}")
    op, bound = ops[name], arg
    if not is_number(bound):
        raise SchemaError(f"{name} needs a number")
    doubles = op(as_double(t.lex), F.lit(float(bound.lex)))
    if bound.dt in DOUBLE_TYPES:
        exact = doubles
    else:
        exact = op(decimal_order(t.lex, bound.lex), F.lit(0))
    ok = F.when(t.dt.isin(DECIMAL_TYPES), exact).when(t.dt.isin(DOUBLE_TYPES), doubles)
    return (t.kind == "literal") & F.coalesce(ok, F.lit(False))


def compile_constraint(nc: NodeConstraint, t: TermColumns) -> Column:
    """kind AND datatype AND values AND facets; never null."""
    parts = []
    if nc.kind:
        parts.append(node_kind(nc.kind, t))
    if nc.datatype:
        parts.append(datatype(nc.datatype, t))
    if nc.values is not None:
        parts.append(value_set(nc.values, t))
    parts += [facet(f, t) for f in nc.facets]
    return F.coalesce(_all(parts), F.lit(False))


LANG_STRING = RDF + "langString"
STRING = XSD + "string"
