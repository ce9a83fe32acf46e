"""Turtle documents of any size, parsed in parallel by blocks.

A block of a file is what Spark reads of it in one go (whole lines).  Where a
statement ends depends on what came before: a dot may stand inside a long
string, or between brackets.  So it goes in three steps:

1. Every block is lexed from each state that a line can begin in (plain, or
   inside a long string of either quote), giving the state it ends in and how
   many brackets it opens: a map from states to states.
2. The maps are composed along the blocks of a file (a prefix scan over one
   small row a block), so each block knows the state it begins in.
3. Every block is cut after the dots that end statements.  What is before its
   first one is handed to the statement that an earlier block began.  A chunk of
   statements tells which declarations count after it (the last of every prefix);
   these are composed along a file, too, and each chunk is parsed with the base and
   the prefixes that hold where it begins.

The driver sees one row a block (its file, offset, and end states) and no text.

Defined results: triples are those of the whole document; blank nodes are named
apart by file, unlabelled ones by chunk too; an empty file gives none; a line
end inside a long string is one newline, whatever it was.  What the chunks of a file
declare, each prefix once a chunk, has to fit into a task's memory, and so does any one statement.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import TRIPLES, literal_id, term_row
from ..plans.storage import keep, spread
from ..schema.ast import BNode, resolve_iri
from ..schema.shexc import unescape
from .graph import Graph

PLAIN, DOUBLE, SINGLE = 0, 1, 2
CHUNK = 1 << 18  # characters of statements that are parsed together

_WORD = r"(?:[^\s\"'<>\[\](){};,.#\\]|\\.)+(?:\.+(?:[^\s\"'<>\[\](){};,.#\\]|\\.)+)*"
_TOKEN = re.compile(
    r"(?P<long>\"\"\"|''')|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|<[^<>\"{}|^`\s]*>|(?P<comment>\#)|(?P<open>[\[(])|(?P<close>[\])])|(?P<dot>\.)|" + _WORD + r"|[;,{}<>\"'\\]"
)
_ENDS = {DOUBLE: re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""'), SINGLE: re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''")}


def lex_line(line: str, state: int, dots: list | None = None) -> tuple[int, int]:
    """(state after the line, brackets opened less closed); ``dots`` gets (position, brackets so far) of every dot between tokens."""
    at, depth = 0, 0
    while True:
        if state != PLAIN:
            m = _ENDS[state].match(line, at)
            if not m:
                return state, depth
            at, state = m.end(), PLAIN
        m = _TOKEN.search(line, at)
        if not m or m.lastgroup == "comment":
            return PLAIN, depth
        at = m.end()
        if m.lastgroup == "long":
            state = DOUBLE if m[0] == '"""' else SINGLE
        elif m.lastgroup == "open":
            depth += 1
        elif m.lastgroup == "close":
            depth -= 1
        elif m.lastgroup == "dot" and dots is not None:
            dots.append((m.start(), depth))


class BlockMap:
    """The map of a block, line by line: for each state to begin in, the state now and the brackets."""

    def __init__(self):
        self.now = {s: (s, 0) for s in (PLAIN, DOUBLE, SINGLE)}

    def add(self, line: str) -> None:
        after = {s: lex_line(line, s) for s in {s for s, _ in self.now.values()}}
        self.now = {k: (after[s][0], d + after[s][1]) for k, (s, d) in self.now.items()}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines, with the block that they are in."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return rows.select("file", "start", "value")


def _blocks(batches):
    """(file, start, lines of one Arrow batch) in order; a block may come in several."""
    for batch in batches:
        files, starts, values = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        i = 0
        while i < len(values):
            j = i
            while j < len(values) and (files[j], starts[j]) == (files[i], starts[i]):
                j += 1
            yield files[i], starts[i], values[i:j]
            i = j


def _maps(batches):
    open_, key = None, None
    done = []
    for file, start, lines in _blocks(batches):
        if key != (file, start):
            if open_ is not None:
                done.append((*key, open_))
            open_, key = BlockMap(), (file, start)
        for line in lines:
            open_.add(line)
    if open_ is not None:
        done.append((*key, open_))
    rows = [{"file": f, "start": s, "ends": [m.now[k][0] for k in range(3)], "depths": [m.now[k][1] for k in range(3)]} for f, s, m in done]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("ends", pa.list_(pa.int32())), ("depths", pa.list_(pa.int32()))]))


def entries(maps: list) -> dict[tuple[str, int], tuple[int, int]]:
    """(state, brackets) that every block begins in: the maps of its file composed from the first block on."""
    out: dict = {}
    by_file = defaultdict(list)
    for r in maps:
        by_file[r["file"]].append(r)
    for file, rows in by_file.items():
        state, depth = PLAIN, 0
        for r in sorted(rows, key=lambda r: r["start"]):
            out[file, r["start"]] = (state, depth)
            state, depth = r["ends"][state], depth + r["depths"][state]
    return out


_LEAD = re.compile(r"(?:\s+|#[^\n]*(?:\n|$))*")
_DECLARATION = re.compile(r"@?(?:prefix\s+[^\s:]*:|base)\s*<[^<>\"{}|^`\s]*>\s*\.?", re.I)


def declarations(statement: str) -> list[str]:
    """The prefix and base declarations that a statement's text begins with, as text without their dots."""
    out, at = [], _LEAD.match(statement).end()
    while m := _DECLARATION.match(statement, at):
        out.append(m[0].lstrip("@").rstrip(". \n\t"))
        at = _LEAD.match(statement, m.end()).end()
    return out


_DECLARED = re.compile(r"(?:prefix\s+([^\s:]*):|base)\s*<([^>]*)>", re.I)
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def declared(declarations: list[str], base: str | None, prefixes: dict) -> tuple[str | None, dict]:
    """(base, prefixes) after declarations, of those before."""
    prefixes = dict(prefixes)
    for d in declarations:
        name, iri = _DECLARED.match(d).groups()
        iri = resolve_iri(base, unescape(iri))
        if name is None:
            base = iri
        else:
            prefixes[name] = iri
    return base, prefixes


def effective(declarations: list[str]) -> list[str]:
    """The declarations that still count at the end: the last of each prefix, and bases unless an absolute one follows that no prefix kept needs to come before."""
    kept, names, later = [], set(), False  # from the last one back; later: an absolute base follows
    needed = False  # a relative IRI that is kept further on hangs on the bases before it
    for d in reversed(declarations):
        name, iri = _DECLARED.match(d).groups()
        absolute = bool(_ABSOLUTE.match(unescape(iri)))
        if name is None:
            if later and not needed:
                continue
            later, needed = later or absolute, not absolute
        else:
            if name in names:
                continue
            names.add(name)
            needed = needed or not absolute
        kept.append(d)
    return kept[::-1]


_PIECE = "file string, start long, seq long, kind string, text string, declared array<string>"
_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("declared", pa.list_(pa.string()))])


class _Cutter:
    """One block's pieces: ``head`` (up to the first end of a statement), ``whole`` statements, ``tail``; ``none`` is a block without an end."""

    def __init__(self, file: str, start: int, state: int, depth: int, chunk: int):
        self.file, self.start, self.state, self.depth, self.chunk = file, start, state, depth, chunk
        self.seq, self.headed = 0, False
        self.statements, self.size, self.declared, self.now = [], 0, [], []

    def _piece(self, kind: str, text: str, declared: list) -> dict:
        self.seq += 1
        return {"file": self.file, "start": self.start, "seq": self.seq, "kind": kind, "text": text, "declared": declared}

    def _whole(self):
        if self.statements:
            yield self._piece("whole", "".join(self.statements), self.declared)
        self.statements, self.size, self.declared = [], 0, []

    def add(self, line: str):
        dots: list = []
        state, more = lex_line(line, self.state, dots)
        last = 0
        for at, d in dots:
            if self.depth + d:
                continue
            self.now.append(line[last : at + 1])
            statement, self.now, last = "".join(self.now), [], at + 1
            if not self.headed:
                self.headed = True
                yield self._piece("head", statement, [])
                continue
            self.statements.append(statement)
            if here := declarations(statement):
                self.declared = effective(self.declared + here)
            self.size += len(statement)
            if self.size >= self.chunk:
                yield from self._whole()
        self.now.append(line[last:] + "\n")
        self.state, self.depth = state, self.depth + more

    def end(self):
        yield from self._whole()
        yield self._piece("tail" if self.headed else "none", "".join(self.now), [])


def _cut(begins: dict, chunk: int):
    def run(batches):
        cutter, out, size = None, [], 0
        for file, start, lines in _blocks(batches):
            if cutter is None or (cutter.file, cutter.start) != (file, start):
                out += cutter.end() if cutter else []
                cutter = _Cutter(file, start, *begins[file, start], chunk)
            for line in lines:
                for piece in cutter.add(line):
                    out.append(piece)
                    size += len(piece["text"])
                if size > 4 * chunk:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                    out, size = [], 0
        out += cutter.end() if cutter else []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


def _owners(blocks: list) -> dict[tuple[str, int], int]:
    """Where the statement began that is open when a block begins: the last block before with an end of a statement, or -1."""
    out, file, owner = {}, None, -1
    for r in sorted(blocks, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, owner = r["file"], -1
        out[r["file"], r["start"]] = owner
        owner = r["start"] if r["kind"] == "tail" else owner
    return out


def _stitched(pieces: DataFrame) -> DataFrame:
    """Chunks of the statements that blocks' borders cut."""
    owners = _owners(pieces.where("kind IN ('tail', 'none')").select("file", "start", "kind").collect())

    def owner(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["owner"] = r["start"] if r["kind"] == "tail" else owners[r["file"], r["start"]]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*_ARROW, ("owner", pa.int64())]))

    def joined(batches):
        for batch in batches:
            rows = [{"file": r["file"], "start": r["owner"], "seq": 1 << 60, "kind": "whole", "text": (text := "".join(p["text"] for p in sorted(r["parts"], key=lambda p: p["start"]))), "declared": effective(declarations(text))} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    parts = pieces.where("kind != 'whole'").mapInArrow(owner, _PIECE + ", owner long")
    return parts.groupBy("file", "owner").agg(F.collect_list(F.struct("start", "text")).alias("parts")).mapInArrow(joined, _PIECE)


def _known(chunks: DataFrame, base: str | None) -> DataFrame:
    """(file, start, seq, base, prefixes) that hold where a chunk begins: what chunks declare, composed along each file."""

    def composed(batches):
        for batch in batches:
            for r in batch.to_pylist():
                now, prefixes, out = base, {}, []
                for c in sorted(r["chunks"], key=lambda c: (c["start"], c["seq"])):
                    out.append({"file": r["file"], "start": c["start"], "seq": c["seq"], "base": now, "prefixes": list(prefixes.items())})
                    if c["declared"]:
                        now, prefixes = declared(c["declared"], now, prefixes)
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=_HERE)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=_HERE)

    by_file = chunks.groupBy("file").agg(F.collect_list(F.struct("start", "seq", "declared")).alias("chunks"))
    return by_file.mapInArrow(composed, "file string, start long, seq long, base string, prefixes map<string, string>")


_HERE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("base", pa.string()), ("prefixes", pa.map_(pa.string(), pa.string()))])


def read_turtle(spark: SparkSession, path: str, base: str | None = None, chunk: int = CHUNK) -> Graph:
    """Triples of Turtle files of any size; see the module."""
    lines = _lines(spark, path)
    begins = entries(lines.mapInArrow(_maps, "file string, start long, ends array<int>, depths array<int>").collect())
    pieces = keep(lines.mapInArrow(_cut(begins, chunk), _PIECE))
    chunks = keep(pieces.where("kind = 'whole'").unionByName(_stitched(pieces)))
    names = [c.split()[0] for c in TRIPLES.split(", ")]

    def parse(batches):
        import pandas as pd

        from .rdf import Turtle

        class Chunk(Turtle):
            tag = ""

            def fresh(self):
                self.n += 1
                return BNode(f"_:anon-{self.tag}-{self.n}")

        def named(t, scope):
            return BNode(f"_:{scope}_{t.value[2:]}") if isinstance(t, BNode) else t

        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                t = Chunk(r["text"], r["base"])
                t.prefixes = dict(r["prefixes"] or [])
                t.tag = f"{r['start'] + 1}-{r['seq']}"
                rows = [(literal_id(named(s, r["scope"])), p, *term_row(named(o, r["scope"]))) for s, p, o in t.parse()]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(rows[at : at + 10_000], columns=names), schema=pa.schema([(n, pa.string()) for n in names]), preserve_index=False)

    here = ["file", "start", "seq"]
    # by place, so that chunks of one file go to many tasks
    met = chunks.join(_known(chunks.select(*here, "declared"), base).hint("merge"), here).select("start", "seq", "text", "base", "prefixes", F.concat(F.lit("b"), F.md5("file")).alias("scope"))
    parsed = Graph(spread(met, "scope", "start", "seq").mapInArrow(parse, TRIPLES))
    return Graph(keep(parsed.df), distinct=False)  # a validation reads a graph several times
