"""Chat formatting: roles of a transcript by a hidden Markov model, then canonical turns.

A transcript is lines of text in which speakers are marked, or not, in many
styles.  Each line is in one of six states: the start or the continuation of a
system, user or assistant turn.  A line shows a speaker marker (one of the
roles, or none), whether it opens a row of the transcript, and a shape (a
question or not, blank, short, medium or long).
How roles follow each other, how long turns are and how shapes go with roles
is counted over all rows that name a known role, across the borders of
partitions too; markers and rows have fixed odds.
Viterbi's best path gives the roles, and turns are rendered as
``<|role|>`` line, text, ``<|end|>`` line.

Rows are sorted by range over (conversation, turn), so a conversation of any
length is spread over partitions.  Viterbi is a chain of max-plus matrix
products: each partition sums up its first and last conversation as a 6 x 6
matrix, the driver chains those (one per partition) and fixes the state at each
border, and the partitions then decode between fixed borders.  The path is one
best path of the whole conversation.

Defined results: null text is an empty line; a null or unknown role marks
nothing, and context decides; null conversation ids form one conversation,
null turns come first; equal (conv_id, turn) are ordered by role and text;
repeated rows are separate turns.  Every row comes back once, with the role of
its first line; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ROLES = ("system", "user", "assistant")

#: Words that name a speaker.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "customer", "prompter", "prompt", "q", "you", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "agent", "gpt", "model", "chatbot", "a"),
}
_ROLE_OF = {n: i for i, r in enumerate(ROLES) for n in NAMES[r]}
_ALL = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
MARKER = re.compile(rf"\s*(?:\*\*|#+\s*|\[|<\|?|>\s*)?(?P<name>{_ALL})(?:\*\*\s*:|\s*:(?:\*\*)?|\]|\|?>|\s*>)[ \t]*", re.I | re.A)

RIGHT, SILENT = 0.85, 0.13  # a turn's first line shows its marker, or none; the rest is shared by wrong ones
QUIET = 0.97  # a continued line shows no marker
OPENS, REOPENS = 0.95, 0.02  # a turn's first line opens a row; a continued one does
SHAPES = 8


def observe(line: str) -> tuple[int, int, str]:
    """Marker (0 none, else role + 1), shape and the line without its marker."""
    m = MARKER.match(line)
    body = line[m.end() :] if m else line
    flat = body.strip()
    size = 0 if not flat else 1 if len(flat) < 40 else 2 if len(flat) < 160 else 3
    return (_ROLE_OF[m["name"].lower()] + 1 if m else 0), 2 * size + flat.endswith("?"), body


class Hmm:
    """Log odds; states 0-2 start a turn of a role, 3-5 continue it."""

    def __init__(self, first=None, follow=None, shapes=None, more: float = 0.5):
        first = np.ones(3) if first is None else np.asarray(first, float) + 1
        follow = np.ones((3, 3)) if follow is None else np.asarray(follow, float) + 1
        shapes = np.ones((6, SHAPES)) if shapes is None else np.asarray(shapes, float) + 1
        more = min(max(more, 0.02), 0.98)
        follow = follow / follow.sum(1, keepdims=True)
        step = np.zeros((6, 6))
        for r in range(3):
            for s in (r, r + 3):
                step[s, :3] = (1 - more) * follow[r]
                step[s, 3 + r] = more
        begin = np.concatenate([first / first.sum(), np.full(3, 1e-9)])
        marks = np.zeros((6, 4))
        for r in range(3):
            marks[r] = [SILENT, *((1 - RIGHT - SILENT) / 2,) * 3]
            marks[r, r + 1] = RIGHT
            marks[3 + r] = [QUIET, *((1 - QUIET) / 3,) * 3]
        with np.errstate(divide="ignore"):
            self.step, self.begin = np.log(step), np.log(begin)
        opens = np.array([OPENS] * 3 + [REOPENS] * 3)[:, None]
        marks = np.concatenate([marks * (1 - opens), marks * opens], axis=1)
        self.marks, self.shapes = np.log(marks), np.log(shapes / shapes.sum(1, keepdims=True))

    def emit(self, seen: list[tuple[int, int]]) -> np.ndarray:
        """seen: marker (0 none, else role + 1; 4 more where the line opens a row) and shape of each line."""
        x = np.array(seen, int).reshape(-1, 2)
        return self.marks[:, x[:, 0]].T + self.shapes[:, x[:, 1]].T

    def matrix(self, seen, opening: bool) -> np.ndarray:
        """Best odds from each state before the lines to each at their end; an opening segment has one row for all."""
        emit = self.emit(seen)
        if opening:
            now = np.tile(self.begin + emit[0], (6, 1))
        else:
            now = self.step + emit[0]
        for e in emit[1:]:
            now = (now[:, :, None] + self.step[None]).max(1) + e
        return now

    def path(self, seen, entry: int | None, leave: int | None) -> np.ndarray:
        """States of the lines, after state ``entry`` (None: an opening) and with the last one ``leave`` where given."""
        emit = self.emit(seen)
        now = (self.begin if entry is None else self.step[entry]) + emit[0]
        back = np.zeros((len(emit), 6), np.int8)
        for i in range(1, len(emit)):
            every = now[:, None] + self.step
            back[i] = every.argmax(0)
            now = every.max(0) + emit[i]
        out = np.zeros(len(emit), np.int8)
        out[-1] = now.argmax() if leave is None else leave
        for i in range(len(emit) - 1, 0, -1):
            out[i - 1] = back[i][out[i]]
        return out


STYLES = ("{}: ", "### {}: ", "[{}] ", "<|{}|> ", "**{}:** ")


def hidden(every: int = 3):
    """Whether a turn is one of those, one in ``every``, whose markers are held out."""
    return F.pmod(F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), F.lit(every)) == 0


def transcript(conversations: DataFrame, every: int | None = None) -> DataFrame:
    """(conv_id, turn, line): each row as transcript text, its role as a speaker marker where there is one.

    With ``every``, markers come in several styles and names, as transcripts
    from many places have them, and one in ``every`` turns has none.
    """
    known = F.col("role").isNotNull() & (F.trim("role") != "")
    if every is None:
        mark = F.when(known, F.concat(F.col("role"), F.lit(": "))).otherwise("")
    else:
        h = F.crc32(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("role")))
        names = F.create_map(*(F.lit(x) for r in ROLES for x in (r, "|".join(NAMES[r][:2]))))
        name = F.element_at(F.split(F.coalesce(F.try_element_at(names, F.lower(F.trim("role"))), F.col("role")), r"\|"), F.when(h % 2 == 0, 1).otherwise(-1).cast("int"))
        styles = F.array(*(F.lit(x) for x in STYLES))
        styled = F.replace(F.element_at(styles, (F.pmod(h, F.lit(len(STYLES))) + 1).cast("int")), F.lit("{}"), name)
        mark = F.when(known & ~hidden(every), styled).otherwise("")
    return conversations.select("conv_id", "turn", F.concat(mark, F.coalesce("text", F.lit(""))).alias("line"))


def _placed(rows: DataFrame) -> DataFrame:
    wide = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "line"]
    spread = rows.withColumn("_n", F.monotonically_increasing_id())  # equal rows may part
    return checkpoint(spread.repartitionByRange(wide, *order, "_n").sortWithinPartitions(*order, "_n").drop("_n").withColumn("_part", F.spark_partition_id()))


def _segments(batches):
    """Runs of one conversation: (key, [(turn, line)]), whole within a partition, with the partition's number."""
    key, held, part, begun = None, [], None, False
    for batch in batches:
        for conv, turn, line, p in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "line", "_part")), strict=True):
            if begun and conv != key:
                yield part, key, held
                held = []
            key, part, begun = conv, p, True
            held.append((turn, line))
    if begun:
        yield part, key, held


def _lines(rows) -> tuple[list[int], list[str], list[tuple[int, int]], list[str]]:
    owner, raw, seen, bodies = [], [], [], []
    for i, (_, text) in enumerate(rows):
        for line in text.split("\n"):
            m, shape, body = observe(line)
            opens = not owner or owner[-1] != i
            owner.append(i)
            raw.append(line)
            seen.append((m + 4 * opens, shape))
            bodies.append(body)
    return owner, raw, seen, bodies


def estimate(placed: DataFrame) -> Hmm:
    """Counts over all rows whose first line is marked.  What a partition's border cuts is counted where the parts meet, so partitions do not matter."""

    def run(batches):
        first, follow, shapes, more, total = np.zeros(3), np.zeros((3, 3)), np.zeros((6, SHAPES)), 0, 0
        edges = None  # partition, first conversation and role, last conversation and role
        for part, key, rows in _segments(batches):
            last, opening = None, None
            for i, (_, text) in enumerate(rows):
                lines = text.split("\n")
                m, shape, _ = observe(lines[0])
                role = m - 1
                if i == 0:
                    opening = role
                if role < 0:
                    last = None
                    continue
                if i == 0 and edges is not None:
                    first[role] += 1
                if last is not None:
                    follow[last, role] += 1
                shapes[role, shape] += 1
                for line in lines[1:]:
                    shapes[3 + role, observe(line)[1]] += 1
                more, total, last = more + len(lines) - 1, total + len(lines), role
            closing = -1 if last is None else last
            edges = (part, str(key), opening, str(key), closing) if edges is None else (*edges[:3], str(key), closing)
        if edges is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[*first, *follow.ravel(), *shapes.ravel(), more, total]], pa.list_(pa.float64())), *(pa.array([x]) for x in edges)], names=["x", "part", "head", "opening", "tail", "closing"])

    rows = placed.mapInArrow(run, "x array<double>, part long, head string, opening long, tail string, closing long").orderBy("part").collect()  # one row a partition
    x = np.zeros(3 + 9 + 6 * SHAPES + 2)
    tail, closing = None, -1
    for r in rows:
        x += r["x"]
        if r["opening"] >= 0:
            if r["head"] != tail:
                x[r["opening"]] += 1
            elif closing >= 0:
                x[3 + 3 * closing + r["opening"]] += 1
        tail, closing = r["tail"], r["closing"]
    return Hmm(x[:3], x[3:12].reshape(3, 3), x[12:-2].reshape(6, SHAPES), x[-2] / x[-1] if x[-1] else 0.5)


def _borders(placed: DataFrame, hmm: Hmm) -> dict[int, tuple[int | None, int | None]]:
    """Per partition the state before its first row and the state of its last line, where a conversation crosses."""

    def run(batches):
        def ends(segment):
            part, key, rows = segment
            seen = _lines(rows)[2]
            return part, str(key), hmm.matrix(seen, False).ravel().tolist(), hmm.matrix(seen, True)[0].tolist()

        it = _segments(batches)
        out, last = [ends(x) for x in itertools.islice(it, 1)], None
        for last in it:  # only the first and the last conversation matter
            pass
        if last is not None:
            out.append(ends(last))
        for k, (part, key, inner, opening) in enumerate(out):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int64()), pa.array([key]), pa.array([inner]), pa.array([opening])], names=["part", "k", "key", "inner", "opening"])

    rows = placed.mapInArrow(run, "part int, k long, key string, inner array<double>, opening array<double>").orderBy("part", "k").collect()
    chains: list[list] = []
    for r in rows:
        if chains and r["k"] == 0 and chains[-1][-1]["key"] == r["key"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    enter: dict[int, int] = {}
    leave: dict[int, int] = {}
    for chain in (c for c in chains if len(c) > 1):
        alphas = [np.array(chain[0]["opening"])]
        for r in chain[1:]:
            alphas.append((alphas[-1][:, None] + np.array(r["inner"]).reshape(6, 6)).max(0))
        state = int(alphas[-1].argmax())
        for i in range(len(chain) - 1, 0, -1):
            leave[chain[i]["part"]] = state if i < len(chain) - 1 else leave.get(chain[i]["part"])
            inner = np.array(chain[i]["inner"]).reshape(6, 6)
            state = int((alphas[i - 1] + inner[:, state]).argmax())
            enter[chain[i]["part"]] = state
        leave[chain[0]["part"]] = state
    parts = {r["part"] for r in rows}
    return {p: (enter.get(p), leave.get(p)) for p in parts}


def render(states, owner, bodies, raw, n: int, opened: bool) -> list[tuple[str, bool, int, str]]:
    """Per row: role of its first line, whether it starts a turn, its lines, and its part of the canonical text."""
    out = [["", False, 0, []] for _ in range(n)]
    for j, (s, i) in enumerate(zip(states, owner, strict=True)):
        row, start = out[i], s < 3
        if not row[2]:
            row[0], row[1] = ROLES[s % 3], bool(start)
        row[2] += 1
        if start:
            if j or opened:
                row[3].append("<|end|>")
            row[3].append(f"<|{ROLES[s % 3]}|>")
        row[3].append(bodies[j] if start else raw[j])
    return [(r, s, k, "\n".join(x)) for r, s, k, x in out]


def parse(rows: DataFrame, hmm: Hmm | None = None) -> DataFrame:
    """(conv_id, turn, role, new_turn, n_lines, rendered) of transcript rows (conv_id, turn, line).

    A conversation's rendered parts in order, joined by line ends, with a last
    ``<|end|>``, are its canonical text.
    """
    placed = _placed(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("line", F.lit("")).alias("line")))
    hmm = hmm or estimate(placed)
    borders = _borders(placed, hmm)

    def run(batches):
        it = _segments(batches)
        held, out = next(it, None), []
        first = True
        while held is not None:
            part, key, turns = held
            held = next(it, None)
            enter, leave = borders[part]
            entry, exit_ = enter if first else None, leave if held is None else None
            owner, raw, seen, bodies = _lines(turns)
            states = hmm.path(seen, entry, exit_)
            for (turn, _), x in zip(turns, render(states, owner, bodies, raw, len(turns), entry is not None), strict=True):
                out.append((key, turn, *x))
            first = False
            if len(out) >= 2000 or held is None:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "turn", "role", "new_turn", "n_lines", "rendered"])
                out = []

    return placed.mapInArrow(run, "conv_id long, turn long, role string, new_turn boolean, n_lines long, rendered string")


HELD_OUT = 3


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation with its recovered role and canonical text.

    The transcripts show speakers in several styles, and one in ``HELD_OUT``
    turns (``held_out``) shows none: there the role comes from context alone.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = parse(transcript(turns, HELD_OUT))
    return out.select("conv_id", "turn", F.coalesce(hidden(HELD_OUT), F.lit(False)).alias("held_out"), "role", "new_turn", "n_lines", "rendered")


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLE: dict[str, str] = {}
