"""RDF terms as columns: kind, lexical form, datatype and language; a canonical id as join key."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema.ast import RDF, XSD, BNode, Iri, Literal

TRIPLES = "s string, p string, o_kind string, o_lex string, o_dt string, o_lang string"

#: Lexical forms of the built-in datatypes, from the public datatype specification.
LEXICAL = {
    "boolean": r"true|false|0|1",
    "integer": r"[+-]?[0-9]+",
    "decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)",
    "double": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "float": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "date": r"-?([1-9][0-9]{3,}|0[0-9]{3})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?",
    "time": r"(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?",
    "dateTime": r"-?([1-9][0-9]{3,}|0[0-9]{3})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?",
    "gYear": r"-?([1-9][0-9]{3,}|0[0-9]{3})(Z|[+-][0-9]{2}:[0-9]{2})?",
    "gYearMonth": r"-?([1-9][0-9]{3,}|0[0-9]{3})-(0[1-9]|1[0-2])(Z|[+-][0-9]{2}:[0-9]{2})?",
    "gMonth": r"--(0[1-9]|1[0-2])(Z|[+-][0-9]{2}:[0-9]{2})?",
    "gDay": r"---(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?",
    "gMonthDay": r"--(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?",
    "duration": r"-?P(?=.)([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?",
    "hexBinary": r"([0-9a-fA-F]{2})*",
    "base64Binary": r"(([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|([A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?",
    "language": r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*",
}

#: Bounds of the derived integer types (None: none).
INTEGERS = {
    "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None),
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}

DECIMAL_TYPES = [XSD + t for t in ("decimal", "integer", *INTEGERS)]
DOUBLE_TYPES = [XSD + t for t in ("double", "float")]


@dataclass(frozen=True)
class TermColumns:
    kind: Column
    lex: Column
    dt: Column
    lang: Column


def term_at(prefix: str = "o_", of: str = "") -> TermColumns:
    """The term in columns ``<prefix>kind`` and so on."""
    return TermColumns(*(F.col(f"{of}{prefix}{x}") for x in ("kind", "lex", "dt", "lang")))


def escaped(lex: Column) -> Column:
    x = F.replace(lex, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(raw), F.lit(shown))
    return x


def term_id(t: TermColumns) -> Column:
    """Canonical N-Triples form; the key of a node."""
    tail = F.when(t.lang.isNotNull(), F.concat(F.lit("@"), F.lower(t.lang))).when(t.dt.isNull() | (t.dt == XSD + "string"), F.lit("")).otherwise(F.concat(F.lit("^^<"), t.dt, F.lit(">")))
    return F.when(t.kind == "iri", F.concat(F.lit("<"), t.lex, F.lit(">"))).when(t.kind == "bnode", t.lex).otherwise(F.concat(F.lit('"'), escaped(t.lex), F.lit('"'), tail))


def resource(node: Column) -> TermColumns:
    """The term of a subject, which is an IRI or a blank node."""
    iri = F.substring(node, 1, 1) == "<"
    return TermColumns(F.when(iri, F.lit("iri")).otherwise(F.lit("bnode")), F.when(iri, F.substr(node, F.lit(2), F.length(node) - 2)).otherwise(node), F.lit(None).cast("string"), F.lit(None).cast("string"))


def literal_id(term) -> str:
    """Canonical form of a driver-side term."""
    if isinstance(term, Iri):
        return f"<{term.value}>"
    if isinstance(term, BNode):
        return term.value
    lex = term.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    tail = f"@{term.lang.lower()}" if term.lang else "" if term.dt == XSD + "string" else f"^^<{term.dt}>"
    return f'"{lex}"{tail}'


def term_row(term) -> tuple:
    """(kind, lex, dt, lang) of a driver-side term."""
    if isinstance(term, Iri):
        return ("iri", term.value, None, None)
    if isinstance(term, BNode):
        return ("bnode", term.value, None, None)
    return ("literal", term.lex, RDF + "langString" if term.lang else term.dt, term.lang)


def valid_lexical(dt: str, lex: Column) -> Column:
    """Whether a lexical form is in its datatype's lexical space; unknown datatypes accept all."""
    name = dt.removeprefix(XSD) if dt.startswith(XSD) else None
    if name in INTEGERS:
        lo, hi = INTEGERS[name]
        ok = lex.rlike(rf"\A(?:{LEXICAL['integer']})\z")
        number = lex.try_cast("decimal(38,0)")
        # a number too long for 38 digits is outside every bounded type
        sign = F.when(lex.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
        low = F.lit(True) if lo is None else F.coalesce(number >= F.lit(lo).cast("decimal(38,0)"), sign > 0)
        high = F.lit(True) if hi is None else F.coalesce(number <= F.lit(hi).cast("decimal(38,0)"), sign < 0)
        return ok & low & high
    if name in LEXICAL:
        ok = lex.rlike(rf"\A(?:{LEXICAL[name]})\z")
        if name in ("date", "dateTime"):  # days beyond their month's end
            day = F.regexp_extract(lex, r"^(-?[0-9]+-[0-9]{2}-[0-9]{2})", 1)
            ok = ok & (lex.startswith("-") | (F.length(day) > 10) | day.try_cast("date").isNotNull())
        return ok
    return F.lit(True)


def decimal_order(lex: Column, bound: str) -> Column:
    """-1, 0 or 1 as a decimal is below, at or above a bound; null if it is none.  Exact for any number of digits.

    Short ones go through the engine's decimals; of others sign, whole and
    fractional digits are compared as text, without the zeros that say nothing.
    """
    d = Decimal(bound)
    whole = F.regexp_extract(lex, r"^[+-]?0*([0-9]*)", 1)
    part = F.regexp_extract(lex, r"\.([0-9]*?)0*$", 1)
    digits = f"{d.copy_abs():f}"  # abs() would round
    b_whole, _, b_part = digits.partition(".")
    b_whole, b_part = b_whole.lstrip("0"), b_part.rstrip("0")
    sign = F.when((whole == "") & (part == ""), 0).when(lex.startswith("-"), -1).otherwise(1)
    b_sign = (d > 0) - (d < 0)
    size = F.when(F.length(whole) != len(b_whole), F.signum(F.length(whole) - len(b_whole)).cast("int"))
    size = size.when(whole != b_whole, F.when(whole < b_whole, -1).otherwise(1)).when(part != b_part, F.when(part < b_part, -1).otherwise(1)).otherwise(0)
    by_text = F.when(sign != b_sign, F.signum(sign - b_sign).cast("int")).otherwise(size * b_sign)
    ok = lex.rlike(rf"\A(?:{LEXICAL['decimal']})\z")
    if len(b_whole) > 20 or len(b_part) > 15:
        return F.when(ok, by_text)
    short = lex.try_cast("decimal(38,15)")
    return F.when(ok, F.when(F.length(lex) <= 16, F.signum(short - F.lit(d).cast("decimal(38,15)")).cast("int")).otherwise(by_text))


def as_double(lex: Column) -> Column:
    x = F.when(lex.endswith("INF"), F.when(lex.startswith("-"), F.lit("-Infinity")).otherwise(F.lit("Infinity"))).otherwise(lex)
    return F.when(lex.rlike(rf"\A(?:{LEXICAL['double']})\z"), x.try_cast("double"))


def is_number(t: Literal) -> bool:
    return t.dt in DECIMAL_TYPES or t.dt in DOUBLE_TYPES
