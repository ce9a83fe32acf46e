"""Parser of the compact syntax: a hand-written tokenizer and recursive descent."""

from __future__ import annotations

import re
from dataclasses import replace

from .ast import (
    RDF,
    XSD,
    Annotation,
    BinExpr,
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
    resolve_iri,
    triple_map,
)

_NAME_START = r"A-Za-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000EFFFF"
_NAME = _NAME_START + r"_\-0-9·̀-ͯ‿-⁀"
_PREFIX = rf"(?:[{_NAME_START}](?:[{_NAME}.]*[{_NAME}])?)?"
_PLX = r"%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]"
_LOCAL = rf"(?:[{_NAME_START}_:0-9]|{_PLX})(?:(?:[{_NAME}.:]|{_PLX})*(?:[{_NAME}:]|{_PLX}))?"

_UCHAR = r"\\u(?!D[89A-Fa-f])[0-9A-Fa-f]{4}|\\U00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
_ESC = rf"\\[tbnrf\"'\\]|{_UCHAR}"
_PATTERN_ESC = rf"\\[nrt\\|.?*+(){{}}$\-\[\]^/]|{_UCHAR}"

_TOKENS = [
    ("skip", r"(?:\s|\#[^\r\n]*|/\*(?:[^*]|\*(?!/))*\*/)+"),
    ("long", rf"'''(?:(?:'|'')?(?:[^'\\]|{_ESC}))*'''|\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|{_ESC}))*\"\"\""),
    ("string", rf"'(?:[^'\\\n\r]|{_ESC})*'|\"(?:[^\"\\\n\r]|{_ESC})*\""),
    ("code", r"\{(?:[^%\\]|\\.)*%\}(?<=%\})(?<!\{%\})"),
    ("iri", r"<(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"),
    ("regexp", rf"/(?:[^/\\\n\r]|{_PATTERN_ESC})+/[smix]*"),
    ("langtag", r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?![:\w])"),
    ("at", r"@"),
    ("bnode", rf"_:[{_NAME_START}_0-9](?:[{_NAME}.]*[{_NAME}])?"),
    ("pname", rf"{_PREFIX}:(?:{_LOCAL})?"),
    ("double", r"[+-]?(?:[0-9]+\.[0-9]*|\.?[0-9]+)[eE][+-]?[0-9]+"),
    ("decimal", r"[+-]?[0-9]*\.[0-9]+"),
    ("integer", r"[+-]?[0-9]+"),
    ("word", r"[A-Za-z]\w*"),
    ("op", r"\^\^|//|~|<=|>=|!=|[{}()\[\]|;,.&$^!=*+?%\-<>/]"),
]

TOKENS = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _TOKENS), re.S)
#: Where slashes are steps of paths.
PATH_TOKENS = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _TOKENS if n != "regexp"), re.S)

FACETS = {
    "length": "length", "minlength": "minlength", "maxlength": "maxlength", "pattern": "pattern",
    "mininclusive": "mininclusive", "minexclusive": "minexclusive", "maxinclusive": "maxinclusive", "maxexclusive": "maxexclusive",
    "totaldigits": "totaldigits", "fractiondigits": "fractiondigits",
}
STRING_FACETS = {"length", "minlength", "maxlength", "pattern"}
KINDS = {"iri": "iri", "bnode": "bnode", "nonliteral": "nonliteral", "literal": "literal"}
NUMERIC = {XSD + t for t in ("integer", "decimal", "float", "double", "byte", "int", "long", "short", "negativeInteger", "nonNegativeInteger", "nonPositiveInteger", "positiveInteger", "unsignedByte", "unsignedInt", "unsignedLong", "unsignedShort")}


def unescape(s: str) -> str:
    table = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}

    def one(m):
        x = m[1]
        if x[0] in "uU" and len(x) > 1:
            return chr(int(x[1:], 16))
        return table.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.S)


class Tokens:
    """Tokens with lookahead; shared by the parsers of all compact syntaxes."""

    def __init__(self, text: str, pattern=TOKENS):
        self.items: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if not m or m.end() == at:
                raise SchemaError(f"unexpected character at {at}: {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.items.append((m.lastgroup, m[0], at))
            at = m.end()
        self.items.append(("end", "", at))
        self.i = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.items[min(self.i + k, len(self.items) - 1)][:2]

    def next(self) -> tuple[str, str]:
        t = self.items[self.i]
        self.i = min(self.i + 1, len(self.items) - 1)
        return t[:2]

    def is_op(self, *ops: str, k: int = 0) -> bool:
        kind, text = self.peek(k)
        return kind in ("op", "at") and text in ops

    def word(self, k: int = 0) -> str:
        kind, text = self.peek(k)
        return text.lower() if kind == "word" else ""

    def accept(self, *ops: str) -> str | None:
        return self.next()[1] if self.is_op(*ops) else None

    def accept_word(self, *words: str) -> str | None:
        return self.next()[1].lower() if self.word() in words else None

    def expect(self, op: str) -> None:
        if not self.accept(op):
            self.fail(f"expected {op!r}")

    def fail(self, what: str):
        kind, text, at = self.items[self.i]
        raise SchemaError(f"{what} at {at}, found {text or kind!r}")


class Parser:
    def __init__(self, text: str, base: str | None = None, pattern=TOKENS):
        self.t = Tokens(text, pattern)
        self.base, self.prefixes = base, {}
        self.shapes: dict[str, Declaration] = {}
        self.start, self.start_acts, self.imports = None, [], []

    # terms

    def iri(self) -> str:
        kind, text = self.t.next()
        if kind == "iri":
            return resolve_iri(self.base, unescape(text[1:-1]))
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SchemaError(f"prefix {prefix}: is not declared")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        self.t.i -= 1
        self.t.fail("expected an IRI")

    def is_iri(self, k: int = 0) -> bool:
        return self.t.peek(k)[0] in ("iri", "pname")

    def label(self) -> str:
        if self.t.peek()[0] == "bnode":
            return self.t.next()[1]
        return self.iri()

    def predicate(self) -> str:
        kind, text = self.t.peek()
        if kind == "word" and text == "a":
            self.t.next()
            return RDF + "type"
        return self.iri()

    def string(self) -> str:
        kind, text = self.t.next()
        if kind == "long":
            return unescape(text[3:-3])
        if kind == "string":
            return unescape(text[1:-1])
        self.t.i -= 1
        self.t.fail("expected a string")

    def literal(self) -> Literal:
        kind, text = self.t.peek()
        if kind in ("integer", "decimal", "double"):
            self.t.next()
            return Literal(text, XSD + kind)
        if kind == "word" and text in ("true", "false"):
            self.t.next()
            return Literal(text, XSD + "boolean")
        lex = self.string()
        if self.t.peek()[0] == "langtag":
            return Literal(lex, RDF + "langString", self.t.next()[1][1:])
        if self.t.accept("^^"):
            return Literal(lex, self.iri())
        return Literal(lex)

    def is_literal(self) -> bool:
        kind, text = self.t.peek()
        return kind in ("string", "long", "integer", "decimal", "double") or kind == "word" and text in ("true", "false")

    # document

    def schema(self) -> Schema:
        opened = False
        while self.t.peek()[0] != "end":
            word = self.t.word()
            if word == "base":
                self.t.next()
                kind, text = self.t.next()
                if kind != "iri":
                    self.t.fail("expected an IRI")
                self.base = resolve_iri(self.base, unescape(text[1:-1]))
            elif word == "prefix":
                self.t.next()
                kind, text = self.t.next()
                if kind != "pname" or not text.endswith(":"):
                    self.t.fail("expected a prefix")
                kind, iri = self.t.next()
                if kind != "iri":
                    self.t.fail("expected an IRI")
                self.prefixes[text[:-1]] = resolve_iri(self.base, unescape(iri[1:-1]))
            elif word == "import":
                self.t.next()
                self.imports.append(self.iri())
            elif word == "start" and self.t.is_op("=", k=1):
                self.t.next()
                self.t.next()
                if self.start is not None:
                    self.t.fail("start is defined twice")
                self.start = self.shape_or(inline=False)
                opened = True
            elif self.t.is_op("%"):
                if opened:
                    self.t.fail("start actions come first")
                self.start_acts += self.acts()
            else:
                abstract = bool(self.t.accept_word("abstract"))
                label = self.label()
                if label in self.shapes:
                    raise SchemaError(f"shape {label} is defined twice")
                if self.t.accept_word("external"):
                    expr = ShapeExternal()
                else:
                    while self.t.word() == "restricts":
                        self.t.next()
                        self.t.accept("@")
                        self.label()
                    expr = self.shape_or(inline=False)
                self.shapes[label] = Declaration(label, expr, abstract)
                opened = True
        out = Schema(tuple(self.shapes.values()), self.start, tuple(self.start_acts), dict(self.prefixes), self.base, tuple(self.imports))
        triple_map(out)
        return out

    # shape expressions

    def shape_or(self, inline: bool):
        items = [self.shape_and(inline)]
        while self.t.accept_word("or"):
            items.append(self.shape_and(inline))
        return items[0] if len(items) == 1 else ShapeOr(tuple(items))

    def shape_and(self, inline: bool):
        items = [self.shape_not(inline)]
        while self.t.accept_word("and"):
            items.append(self.shape_not(inline))
        return items[0] if len(items) == 1 else ShapeAnd(tuple(items))

    def shape_not(self, inline: bool):
        if self.t.accept_word("not"):
            return ShapeNot(self.atom(inline))
        return self.atom(inline)

    def starts_shape(self) -> bool:
        opens = self.t.is_op("{") and self.t.peek(1)[0] != "integer" and not self.t.is_op("|", k=1)  # else a cardinality, or qualifiers
        return opens or self.t.peek()[0] == "code" or self.t.word() in ("closed", "extra", "extends", "restricts") or self.t.is_op("&")

    def starts_non_literal(self) -> bool:
        return self.t.word() in ("iri", "bnode", "nonliteral") or self.t.word() in STRING_FACETS or self.t.peek()[0] == "regexp"

    def atom(self, inline: bool):
        t = self.t
        if t.accept("("):
            e = self.shape_or(inline=False)
            t.expect(")")
            return e
        if t.is_op("."):
            t.next()
            return Shape()
        if t.word() == "external":
            t.next()
            return ShapeExternal()
        if t.is_op("@") or t.peek()[0] == "langtag":
            ref = self.reference()
            return ref
        if self.starts_shape():
            shape = self.shape(inline)
            if self.starts_non_literal():
                return ShapeAnd((shape, self.node_constraint()))
            return shape
        nc = self.node_constraint()
        if nc.kind != "literal" and nc.datatype is None and nc.values is None:  # a non-literal constraint may have a shape or a reference beside it
            if self.starts_shape():
                return ShapeAnd((nc, self.shape(inline)))
            if t.is_op("@") or t.peek()[0] == "langtag":
                return ShapeAnd((nc, self.reference()))
        return nc

    def reference(self):
        kind, text = self.t.peek()
        if kind == "langtag":
            raise SchemaError(f"{text} is no shape reference")
        self.t.expect("@")
        if self.t.word() == "start":
            self.t.next()
            return ShapeRef("START")
        return ShapeRef(self.label())

    def node_constraint(self) -> NodeConstraint:
        t = self.t
        kind = datatype = values = None
        if t.word() in KINDS:
            kind = KINDS[t.next()[1].lower()]
        elif self.is_iri():
            datatype = self.iri()
        elif t.is_op("["):
            values = self.value_set()
        facets = []
        while True:
            if t.peek()[0] == "regexp":
                text = t.next()[1]
                end = text.rindex("/")
                facets.append(("pattern", re.sub(r"\\/", "/", text[1:end]), text[end + 1 :]))
                continue
            word = t.word()
            if word not in FACETS:
                break
            t.next()
            if word == "pattern":
                facets.append(("pattern", self.string(), ""))
            elif word in ("length", "minlength", "maxlength", "totaldigits", "fractiondigits"):
                k, n = t.next()
                if k != "integer" or n.startswith("-"):
                    t.fail("expected a count")
                facets.append((word, int(n)))
            else:
                lit = self.literal()
                if lit.dt not in NUMERIC:
                    raise SchemaError(f"{word} needs a number")
                facets.append((word, lit))
        names = [f[0] for f in facets]
        if len(set(names)) < len(names):
            raise SchemaError("a facet is given twice")
        if kind is None and datatype is None and values is None and not facets:
            t.fail("expected a shape expression")
        if kind in ("iri", "bnode", "nonliteral") and any(n not in STRING_FACETS for n in names):
            raise SchemaError("numeric facets need literals")
        if datatype is not None and datatype not in NUMERIC and any(n not in STRING_FACETS for n in names):
            raise SchemaError(f"numeric facets do not go with {datatype}")
        return NodeConstraint(kind, datatype, tuple(facets), values)

    def value_set(self) -> tuple:
        self.t.expect("[")
        out = []
        while not self.t.accept("]"):
            out.append(self.value())
        return tuple(out)

    def value(self):
        t = self.t
        if t.accept("."):
            if not t.is_op("-"):
                t.fail("expected exclusions")
            kind, found = None, []
            while t.accept("-"):
                k, v = self.exclusion()
                if kind not in (None, k):
                    raise SchemaError("exclusions of two kinds")
                kind = k
                found.append(v)
            return StemRange(kind, None, tuple(found))
        kind, v = self.stemmed()
        if not (t.is_op("~")):
            return v
        t.next()
        stem = v.value if isinstance(v, Iri) else v.tag if isinstance(v, LanguageTag) else v.lex
        found = []
        while t.accept("-"):
            k, x = self.exclusion()
            if k != kind:
                raise SchemaError("exclusions of another kind")
            found.append(x)
        return StemRange(kind, stem, tuple(found)) if found else Stem(kind, stem)

    def stemmed(self):
        t = self.t
        if self.is_iri():
            return "iri", Iri(self.iri())
        if t.peek()[0] == "langtag":
            return "language", LanguageTag(t.next()[1][1:])
        if t.is_op("@"):
            t.next()
            if not t.is_op("~"):
                t.fail("expected ~")
            return "language", LanguageTag("")
        return "literal", self.literal()

    def exclusion(self):
        kind, v = self.stemmed()
        if self.t.accept("~"):
            if v == LanguageTag(""):
                raise SchemaError("an empty language stem excludes everything")
            return kind, Stem(kind, v.value if isinstance(v, Iri) else v.tag if isinstance(v, LanguageTag) else v.lex)
        return kind, v

    def shape(self, inline: bool) -> Shape:
        t = self.t
        closed, extra, extends, restricts = False, [], [], []
        while True:
            word = t.word()
            if word == "closed":
                t.next()
                closed = True
            elif word == "extra":
                t.next()
                extra.append(self.predicate())
                while self.is_iri() or (t.peek() == ("word", "a")):
                    extra.append(self.predicate())
            elif word in ("extends", "restricts") or t.is_op("&") :
                t.next()
                t.accept("@")
                target = extends if word != "restricts" else restricts
                target.append(self.label())
                while t.is_op("@") or word == "extends" and (self.is_iri() or t.peek()[0] == "bnode"):
                    t.accept("@")
                    target.append(self.label())
            else:
                break
        t.expect("{")
        expr = None if t.is_op("}") else self.one_of()
        t.expect("}")
        notes, acts = self.annotations(), self.acts()
        del inline
        return Shape(expr, closed, tuple(dict.fromkeys(extra)), tuple(extends), tuple(restricts), tuple(acts), tuple(notes))

    # triple expressions

    def one_of(self):
        items = [self.each_of()]
        while self.t.accept("|"):
            items.append(self.each_of())
        return items[0] if len(items) == 1 else OneOf(tuple(items))

    def each_of(self):
        items = [self.unary()]
        while self.t.accept(";"):
            if self.t.is_op("}", "|", ")"):
                break
            items.append(self.unary())
        return items[0] if len(items) == 1 else EachOf(tuple(items))

    def unary(self):
        t = self.t
        if t.accept("&"):
            return Inclusion(self.label())
        name = None
        if t.accept("$"):
            name = self.label()
        if t.accept("("):
            inner = self.one_of()
            t.expect(")")
            lo, hi = self.cardinality()
            notes, acts = self.annotations(), self.acts()
            if isinstance(inner, TripleConstraint) and (lo, hi) == (1, 1) and not notes and not acts and name is None:
                return inner
            if isinstance(inner, EachOf | OneOf) and (inner.min, inner.max, inner.id) == (1, 1, None) and not inner.annotations and not inner.acts:
                return replace(inner, min=lo, max=hi, annotations=tuple(notes), acts=tuple(acts), id=name)
            if isinstance(inner, TripleConstraint) and (inner.min, inner.max, inner.id) == (1, 1, None):
                return replace(inner, min=lo, max=hi, annotations=inner.annotations + tuple(notes), acts=inner.acts + tuple(acts), id=name)
            return EachOf((inner,), lo, hi, tuple(acts), tuple(notes), name)
        if t.is_op("=", "<", ">", "!=", "<=", ">=") or t.word() == "expr":
            t.next()
            return ValueExpr(self.value_expr(), name)
        return self.constraint(name)

    def value_expr(self):
        left = self.value_atom()
        while self.t.is_op("=", "!=", "+", "*", "-", "/", "<", ">", "<=", ">="):
            op = self.t.next()[1]
            left = BinExpr(op, left, self.value_atom())
        return left

    def value_atom(self):
        if self.t.accept("("):
            e = self.value_expr()
            self.t.expect(")")
            return e
        return self.literal() if self.is_literal() else Iri(self.iri())

    def constraint(self, name):
        t = self.t
        negated = inverse = False
        while t.is_op("!", "^"):
            if t.next()[1] == "!":
                if negated:
                    t.fail("a second !")
                negated = True
            else:
                if inverse:
                    t.fail("a second ^")
                inverse = True
        predicate = self.predicate()
        value = self.shape_or(inline=True)
        if value == Shape():
            value = None
        lo, hi = self.cardinality()
        notes, acts = self.annotations(), self.acts()
        return TripleConstraint(predicate, value, lo, hi, inverse, negated, tuple(acts), tuple(notes), name)

    def cardinality(self) -> tuple[int, int | None]:
        t = self.t
        for op, card in (("*", (0, None)), ("+", (1, None)), ("?", (0, 1))):
            if t.accept(op):
                return card
        if t.is_op("{") and t.peek(1)[0] == "integer":
            t.next()
            lo = int(t.next()[1])
            hi: int | None = lo
            if t.accept(","):
                hi = None
                if t.peek()[0] == "integer":
                    hi = int(t.next()[1])
                elif t.accept("*"):
                    pass
            t.expect("}")
            if hi is not None and hi < lo:
                raise SchemaError(f"cardinality {{{lo},{hi}}} is empty")
            return lo, hi
        return 1, 1

    def annotations(self) -> list[Annotation]:
        out = []
        while self.t.accept("//"):
            p = self.predicate()
            out.append(Annotation(p, self.literal() if self.is_literal() else Iri(self.iri())))
        return out

    def acts(self) -> list[SemAct]:
        out = []
        while self.t.accept("%"):
            name = self.iri()
            kind, text = self.t.peek()
            if kind == "code":
                self.t.next()
                out.append(SemAct(name, unescape_code(text[1:-2])))
            else:
                self.t.expect("%")
                out.append(SemAct(name))
        return out


def unescape_code(s: str) -> str:
    return re.sub(r"\\([%\\])", r"\1", s)


def parse(text: str, base: str | None = None) -> Schema:
    """Schema of a text in the compact syntax; raises SchemaError."""
    return Parser(text, base).schema()
