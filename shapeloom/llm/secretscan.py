"""Secret scans: fixed rules, then a character convolutional network over every candidate.

Base rules give the kinds ``assign``, ``access`` and ``hex``: per kind, leftmost
non-overlapping matches of the whole text, of which those that are too short
are dropped.  A span is the whole match, in code points, end exclusive.

Candidates are, with punctuation trimmed off both ends:

* what the base rules found (of an assignment its value);
* runs of eight or more of ``A-Z a-z 0-9 + / _ . ~ ! @ # $ % ^ & * -`` (and up to
  two ``=``) that hold a digit, one of ``+ ~ ! @ # $ % ^ & *`` or capitals within,
  and any such run of sixteen or more, letters only included; without a
  letter (numbers with marks between) from sixteen digits on;
* the parts of such a run that ``&`` divides, and of one right after ``:`` or
  ``=`` what stands before an ``@``, by the same rules;
* runs of four or more that follow a key word and ``:`` or ``=``, so also the
  assignments that are too short for the base rule.

A small network (character embedding, one convolution, max-pooling, one
output) in numpy scores each with the ``CONTEXT`` characters on either side; a
longer one is scored in overlapping pieces and takes the highest.  Candidates
that overlap no base span and score at or above the threshold of their kind
(after a key word, letters only, others) become spans of kind ``model``; of
those that overlap each other the best-scored.  Base spans always stay;
``n_likely`` says how many of them the network would have called secrets too.

The tables carry no labelled findings, so secrets are generated (``findings``)
from a fixed seed, and harmless findings too; beside those stand the candidates
of a bounded sample of the documents themselves (``background``), away from key
words, which count as harmless, as secrets are rare among them.  Documents fall into two
folds, and each is scored by the network whose background is of the other.  A
held-out quarter calibrates the logit (Platt scaling) and sets each kind's
threshold: the highest that still recalls ``RECALL`` of its held-out secrets.

Defined results: null text counts as empty; no findings give the digest of the
empty string and empty ``spans``; repeated rows and null ids are judged like
any other.  Extra columns are kept; the derived ones are replaced.
"""

from __future__ import annotations

import hashlib
import io
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 or more: the same as all runs without the shorter ones
RUN = re.compile(r"[A-Za-z0-9+/_.~!@#$%^&*-]{8,}={0,2}")
KEYED = re.compile(r"""(?:pass|passwd|password|pwd|secret|token|key|credential|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.~!@#$%^&*-]{4,}={0,2})""", re.I | re.A)
AFTER_KEY = re.compile(r"""(?:pass|passwd|password|pwd|secret|token|key|credential|auth)["']?\x20*[:=]\x20*["']?$""", re.I | re.A)
MIXED = re.compile(r"[0-9+~!@#$%^*&]|[a-z][A-Z]")
LETTER = re.compile(r"[A-Za-z]")
PLAIN = re.compile(r"[A-Za-z]+")
SPLIT = re.compile(r"[^&]+")
KEY_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")
TRIM = "./-_!@#$%^*~&"
KINDS = ("assign", "access", "hex", "model")
CONTEXT, BODY, STEP = 24, 48, 32
WIDTH = BODY + 2 * CONTEXT
SHORT, LONG = 8, 16
BACKGROUND_DOCS, BACKGROUND = 500, 3000
#: Kinds of candidates, each with a threshold of its own: after a key word, letters only, others.
SHAPES = ("keyed", "letters", "mixed")
RECALL = {"keyed": 0.98, "letters": 0.96, "mixed": 0.97}


def base_matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of the fixed rules, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def _worth(core: str) -> bool:
    """Whether a run by itself is a candidate; numbers with marks between (addresses, dates, phones) are from 16 digits on."""
    if len(core) < LONG and not (len(core) >= SHORT and MIXED.search(core)):
        return False
    return bool(LETTER.search(core)) or sum(c.isdigit() for c in core) >= LONG


def _parts(body: str, start: int, value: bool):
    """A run without the punctuation at its ends, the parts that & divides, and of a value (after : or =) what stands before an @: (start, text)."""
    ends = [(0, len(body)), *((m.start(), m.end()) for m in SPLIT.finditer(body) if m.end() - m.start() < len(body))]
    ends += [(a, a + body[a:b].index("@")) for a, b in ends if "@" in body[a:b] and value]
    for a, b in ends:
        left = body[a:b].lstrip(TRIM)
        yield start + b - len(left), left.rstrip(TRIM)


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be secrets, and parts of them, that overlap no base span; they may overlap each other."""
    found = set()
    for m in RUN.finditer(text):
        value = text[max(0, m.start() - 1) : m.start()] in (":", "=")
        found |= {(s, s + len(core)) for s, core in _parts(m[0], m.start(), value) if _worth(core)}
    low = text.lower()
    if any(k in low for k in KEY_WORDS):
        for m in KEYED.finditer(text):
            found.add((m.start(1), m.start(1) + len(m[1].rstrip("."))))
            found |= {(s, s + len(core)) for s, core in _parts(m[1], m.start(1), True) if s == m.start(1)}
    out, i = [], 0
    taken = sorted((s, e) for s, _, e, _ in base)
    reach = 0  # the furthest end of the base spans passed so far
    for s, e in sorted(found):
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        # spans that begin before e and end after s overlap; those passed earlier may still reach in
        if reach <= s and e - s >= 4:
            out.append((s, e))
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Code per position of one piece: 0 outside the text, 1 other characters, then ASCII; +128 inside the candidate."""
    lo = start - CONTEXT
    part = text[max(0, lo) : end + CONTEXT].encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(part, np.uint32)
    c = np.where(c < 127, np.maximum(c, 2), 1).astype(np.uint8)
    out = np.zeros(WIDTH, np.uint8)
    shift = max(0, -lo)
    n = min(len(c), WIDTH - shift)
    out[shift : shift + n] = c[:n]
    out[CONTEXT : CONTEXT + end - start] += 128
    return out


def shape(text: str, start: int, end: int) -> str:
    """The kind of a candidate."""
    if AFTER_KEY.search(text, max(0, start - 40), start):
        return "keyed"
    return "letters" if PLAIN.fullmatch(text, start, end) else "mixed"


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate in overlapping pieces of at most BODY characters."""
    if end - start <= BODY:
        return [(start, end)]
    return [(s, min(s + BODY, end)) for s in range(start, end - BODY + STEP, STEP)]


@dataclass
class Network:
    emb: np.ndarray  # code x dim
    conv: np.ndarray  # (width * dim) x filters
    cb: np.ndarray
    out: np.ndarray
    ob: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    limits: tuple = (0.5,) * len(SHAPES)

    def limit(self, text: str, start: int, end: int) -> float:
        return self.limits[SHAPES.index(shape(text, start, end))]

    def to_bytes(self) -> bytes:
        """All of it as an npz file, to keep and to send."""
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        held = np.load(io.BytesIO(data))
        return cls(**{k: held[k] if held[k].ndim > 1 or k in ("cb", "out") else tuple(held[k].tolist()) if held[k].ndim else float(held[k]) for k in held.files})

    def hidden(self, x: np.ndarray):
        e = self.emb[x]
        k = self.conv.shape[0] // self.emb.shape[1]
        cols = np.concatenate([e[:, i : e.shape[1] - k + 1 + i] for i in range(k)], axis=2)
        z = cols @ self.conv + self.cb
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
        return cols, at, np.maximum(top, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self.hidden(x[i : i + 256])[2] @ self.out + self.ob for i in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))


def findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Generated findings: (text, start, end) of a candidate, and 1 for a secret."""
    rng = np.random.default_rng(seed)
    one = lambda xs: xs[int(rng.integers(0, len(xs)))]
    upper, small, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = upper + small + digits
    onset = "b c d f g h j k l m n p r s t v w z th st sch br tr qu pl cr fl gr pr ch sh".split()
    vowel = "a e i o u ea ie ou au ei io y".split()
    coda = ["", "", "", "n", "r", "s", "l", "nd", "ng", "st", "t", "ch", "ck", "m", "x", "é", "ß", "ó"]
    affix = "th wh tion ing sch keit ung pf tz ein ich heit ment ous able ver ge be un er en est ed ck ent ist lich isch ung and ter re de con pre".split()
    pick = lambda s, k: "".join(s[i] for i in rng.integers(0, len(s), k))
    word = lambda lo=1, hi=4: "".join(one(onset) + one(vowel) + one(coda) for _ in range(rng.integers(lo, hi)))
    number = lambda lo, hi: pick(digits, int(rng.integers(lo, hi)))

    def prose(k):
        words = [word() for _ in range(k)]
        mark = one(["", "", "", "***", "###", ",", ".", "!!"])
        return one([" ".join(words), " ".join(words).upper(), (mark + " ").join(words), " | ".join(words), "\n".join(words)])

    secret_bodies = (
        lambda: pick(alnum, int(rng.integers(16, 64))),
        lambda: pick(alnum + "+/", int(rng.integers(18, 64))) + "=" * int(rng.integers(0, 3)),
        lambda: pick(alnum + "-_", int(rng.integers(16, 48))),
        lambda: pick(digits + "ABCDEF", int(rng.integers(16, 48))),
        lambda: pick(digits + "abcdef", int(rng.integers(20, 65))),
        lambda: pick(small, int(rng.integers(16, 33))),
        lambda: pick(small, int(rng.integers(16, 20))),
        lambda: pick(upper, int(rng.integers(16, 33))),
        lambda: pick(small + digits, int(rng.integers(14, 40))),
        lambda: pick(upper + digits, int(rng.integers(16, 40))),
        lambda: one(["ghp_", "sk-", "xoxb-", "glpat-", "eyJ", "SG.", "pk_live_", "npm_", "AIza", "ya29."]) + pick(alnum, int(rng.integers(18, 48))),
        lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum + "-_", 20) + "." + pick(alnum + "-_", 20),
    )
    passwords = (
        lambda: pick(alnum + "!@#$%^*&", int(rng.integers(8, 20))),
        lambda: word(2, 3).capitalize() + number(1, 5) + one("!@#$%*"),
        lambda: word(1, 3) + one("!@#$%*-_.") + word(1, 3) + number(1, 4),
        lambda: pick(alnum, int(rng.integers(8, 16))),
    )
    heads = ("", "Authorization: Bearer ", "_key = ", '": "', "?k=", "export ", "value ", "use ", "(", "sig=", "x-key: ", "= ", ": ")
    keyed = ("password: ", "pwd=", "secret = '", "token=", 'api-key: "', "pass: ", "DB_PASSWORD=", "auth: ", "credential = ", "PASSWORD: ")
    plain = (
        lambda: word(6, 9),
        lambda: word(6, 9).upper(),
        lambda: word(5, 8).capitalize(),
        lambda: "-".join(word() for _ in range(rng.integers(2, 6))) + one(["", "-" + number(1, 5)]),
        lambda: "_".join(word() for _ in range(rng.integers(2, 6))) + one(["", number(1, 3)]),
        lambda: f"20{pick(digits, 2)}-0{pick('123456789', 1)}-1{pick(digits, 1)}" + one(["", f"T{pick('01', 1)}{pick(digits, 1)}", f"-{word()}-{word()}"]),
        lambda: "/".join(word() + number(0, 2) for _ in range(rng.integers(3, 6))) + one(["", ".html", ".py", ".tar.gz"]),
        lambda: "".join(word(1, 3).capitalize() for _ in range(rng.integers(2, 5))) + number(0, 3),
        lambda: word(1, 2) + "".join(word(1, 3).capitalize() for _ in range(rng.integers(1, 4))),
        lambda: f"{word()}.{number(1, 4)}@{one(['mail', 'post', word()])}{number(0, 3)}.{one(['example', word()])}.{one(['com', 'org', 'de', 'net'])}",
        lambda: f"{word()}{one(['', number(1, 4), '.' + word()])}@{word()}.{one(['com', 'org', 'de', 'net'])}",
        lambda: ".".join(number(1, 4) for _ in range(4)),
        lambda: f"{number(3, 4)}-{number(4, 5)}",
        lambda: number(8, 21),
        lambda: f"v{number(1, 2)}.{number(1, 3)}.{number(1, 3)}-{one(['beta', 'rc', 'alpha'])}{number(1, 2)}",
        lambda: word(2, 4) + "".join(one(["***", "###", "$$$", "%%%", "!!"]) + word(1, 3) for _ in range(rng.integers(1, 3))),
        lambda: word(2, 5) + number(1, 5),
        lambda: f"{number(1, 4)}.{number(1, 4)}%{word(1, 2)}",
        lambda: f"{one(['mail', 'db', 'www', 'host', word()])}{number(0, 3)}.{one(['example', word()])}.{one(['com', 'org', 'de', 'net', 'internal'])}" + one(["", "", "/" + word(1, 3)]),
        lambda: "".join(one(affix) for _ in range(rng.integers(5, 9))),
        lambda: "".join(one(affix) + one(["", one(vowel)]) for _ in range(rng.integers(5, 8))).capitalize(),
        lambda: f"www.{word(1, 3)}.{word(1, 3)}.{one(['com', 'org', 'de'])}/{word(1, 3)}",
    )
    out, ys = [], []
    while len(ys) < n:
        secret, after_word = rng.random() < 0.5, rng.random() < 0.3
        if secret and after_word:
            body, head = one(passwords + secret_bodies)(), one(keyed)
        elif secret and rng.random() < 0.08:
            body, head = f"{one(passwords)()}@{word()}.{word()}.com", f"{one(['postgres', 'mysql', 'ftp', 'https'])}://{word()}:"
        elif secret:
            body, head = one(secret_bodies)(), one(heads)
        elif after_word:
            body, head = one([word(1, 4), word(2, 4), *(one(plain)() for _ in range(2))]), one(["pass: ", "key: ", "token: ", "secret: ", "secret = ", "author: ", "key="])
        else:
            body, head = one(plain)(), one(("", "", "", "", "https://", "+1 (017) ", "see ", ": ", '"', "(", "= "))
        lead = prose(5) + one([" ", " ", "\n", " " + word()[:3]]) + head
        tail = one(['"', " ", " ", "\n", ", ", "&x=1 ", "'", ") ", ". ", "*** ", "!! ", "ó", "é "]) + prose(4)
        run = body.lstrip(TRIM).rstrip(TRIM) if not (secret and after_word) else body
        whole = re.match(r"[A-Za-z0-9+/_.~!@#$%^&*-]*={0,2}", run)[0]  # a word ends at its first letter beyond ASCII
        if len(whole) < 4 or len(whole) < SHORT and not after_word or not (after_word or _worth(whole)):
            continue
        at = len(lead) + body.index(run)
        out.append((lead + body + tail, at, at + len(whole)))
        ys.append(secret)
    return out, np.array(ys, float)


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Encoded ``findings``, the first piece of each."""
    found, y = findings(n, seed)
    return np.stack([encode(t, *pieces(s, e)[0]) for t, s, e in found]), y


def background(docs: DataFrame, most_docs: int = BACKGROUND_DOCS, most: int = BACKGROUND) -> np.ndarray:
    """Encoded candidates of a bounded sample, those near a key word left out: ``most`` of the first ``most_docs`` documents in a hash order of doc_id."""
    first = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("x", T.BinaryType())])

    def run(batches):
        for batch in batches:
            rows = set()
            for t in batch.column("text").to_pylist():
                t = t or ""
                for s, e in candidates(t, base_matches(t)):
                    if any(k in t[max(0, s - CONTEXT) : s].lower() for k in KEY_WORDS):
                        continue
                    rows.add(encode(t, *pieces(s, e)[0]).tobytes())
            keys = sorted((int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True), x) for x in rows)[:most]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.binary())], names=["h", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").mapInArrow(run, schema)
    rows = sample.distinct().orderBy("h", "x").limit(most).toArrow()["x"].to_pylist()
    return np.stack([np.frombuffer(x, np.uint8) for x in rows]) if rows else np.zeros((0, WIDTH), np.uint8)


def train(harmless: np.ndarray | None = None, n: int = 8000, epochs: int = 8, filters: int = 32, dim: int = 10, width: int = 5, min_recall: float = 0.98, seed: int = 11) -> Network:
    """Adam on the logistic loss, both classes weighed alike; a quarter of the findings calibrates and sets the threshold."""
    found, y = findings(n, seed)
    x, kinds = np.stack([encode(t, *pieces(s, e)[0]) for t, s, e in found]), np.array([SHAPES.index(shape(*f)) for f in found])
    if harmless is not None and len(harmless):
        x, y, kinds = np.concatenate([x, harmless]), np.concatenate([y, np.zeros(len(harmless))]), np.concatenate([kinds, np.full(len(harmless), -1)])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y, kinds = x[order], y[order], kinds[order]
    cut = len(y) * 3 // 4
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    net = Network(rng.normal(0, 0.3, (256, dim)), rng.normal(0, 0.2, (dim * width, filters)), np.zeros(filters), rng.normal(0, 0.2, filters), 0.0)
    params = [net.emb, net.conv, net.cb, net.out]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.005 if epoch < epochs * 3 // 4 else 0.0015
        for batch in np.array_split(rng.permutation(cut), max(1, cut // 64)):
            xb, yb = x[batch], y[batch]
            cols, at, top = net.hidden(xb)
            err = (1 / (1 + np.exp(-np.clip(top @ net.out + net.ob, -30, 30))) - yb) * cost[batch] / len(batch)
            g_out = top.T @ err
            g_top = np.outer(err, net.out) * (top > 0)
            used = np.take_along_axis(cols, at[:, :, None], 1)  # batch x filters x (width * dim)
            g_conv = np.einsum("bf,bfd->df", g_top, used)
            g_cols = np.einsum("bf,df->bfd", g_top, net.conv).reshape(len(batch), filters, width, dim)
            g_emb = np.zeros_like(net.emb)
            for k in range(width):
                np.add.at(g_emb, np.take_along_axis(xb, at + k, 1), g_cols[:, :, k])
            net.ob -= 4 * rate * err.sum()
            t += 1
            for p, g, m, v in zip(params, (g_emb, g_conv, g_top.sum(0), g_out), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    z, yc = net.logits(x[cut:]), y[cut:]
    for _ in range(200):
        e = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30))) - yc
        net.scale -= 0.1 * float((e * z).mean())
        net.shift -= 0.1 * float(e.mean())
    probability = net.probability(x[cut:])

    def highest(rows, recall):
        p = np.sort(probability[rows])
        return float(p[int(len(p) * (1 - recall))]) if len(p) else 0.5

    net.threshold = min(highest(yc == 1, min_recall), 0.5)
    net.limits = tuple(highest((yc == 1) & (kinds[cut:] == k), RECALL[name]) for k, name in enumerate(SHAPES))
    return net


def fold(docs: DataFrame) -> DataFrame:
    """``_fold`` 0 or 1 by a hash of doc_id."""
    return docs.withColumn("_fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))


def train_folds(docs: DataFrame) -> tuple[Network, Network]:
    """Networks for the documents of fold 0 and of fold 1; the background of each is of the other fold.  They are fitted side by side, in tasks."""
    spark, halves = docs.sparkSession, fold(docs.select("doc_id", "text"))
    rows = [(k, background(halves.where(F.col("_fold") == 1 - k)).tobytes()) for k in (0, 1)]

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"k": pdf["k"], "net": [train(np.frombuffer(x, np.uint8).reshape(-1, WIDTH)).to_bytes() for x in pdf["x"]]})

    made = spark.createDataFrame(rows, "k int, x binary").repartitionByRange(2, "k").mapInPandas(run, "k int, net binary").collect()
    return tuple(Network.from_bytes(r["net"]) for r in sorted(made, key=lambda r: r["k"]))


def apart(scored: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Of spans that overlap the best-scored one, of equals the longest."""
    out: list = []
    for _, s, e in sorted(scored, key=lambda x: (-x[0], x[1] - x[2], x[1])):
        if all(e <= a or s >= b for a, b in out):
            out.append((s, e))
    return sorted(out)


def all_spans(texts: list[str], net: Network) -> list[tuple[list, list, int, int]]:
    """Of each text: base spans, all spans, candidates scored, and base spans that the network calls secrets."""
    base = [base_matches(t) for t in texts]
    where, codes = [], []
    best: list[dict] = [{} for _ in texts]

    def flush():
        if codes:
            for (i, key), p in zip(where, net.probability(np.stack(codes)).tolist(), strict=True):
                best[i][key] = max(best[i].get(key, 0.0), p)
            where.clear()
            codes.clear()

    for i, (t, b) in enumerate(zip(texts, base, strict=True)):
        spots = [((s, e, k), v, e) for s, k, e, v in b] + [((s, e, 3), s, e) for s, e in candidates(t, b)]
        for key, s, e in spots:
            for a, z in pieces(s, e):
                where.append((i, key))
                codes.append(encode(t, a, z))
                if len(codes) >= 2048:
                    flush()
    flush()
    out = []
    for text, b, scores in zip(texts, base, best, strict=True):
        spans = [(s, k, e) for s, k, e, _ in b]
        added = [(s, 3, e) for s, e in apart([(p, s, e) for (s, e, k), p in scores.items() if k == 3 and p >= net.limit(text, s, e)])]
        out.append((spans, sorted(spans + added), len(scores), sum(p >= net.threshold for (_, _, k), p in scores.items() if k != 3)))
    return out


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, net: Network | tuple[Network, Network]) -> DataFrame:
    """``docs`` (with doc_id, if there are networks by fold) with n_assign, n_access, n_hex, base_sha256, spans, n_candidates (scored) and n_likely."""
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_candidates", "n_likely"]
    docs = docs.drop(*names)
    kinds = [T.LongType()] * 3 + [T.StringType()] * 2 + [T.LongType()] * 2
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    nets = net if isinstance(net, tuple) else (net,)
    shared = docs.sparkSession.sparkContext.broadcast(nets)
    rows = fold(docs.drop("_fold")) if len(nets) > 1 else docs
    schema = T.StructType([f for f in schema.fields if f.name != "_fold"]) if len(nets) > 1 else schema

    def found_in(batch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if len(shared.value) == 1:
            return all_spans(texts, shared.value[0])
        folds, out = batch.column("_fold").to_pylist(), [None] * len(texts)
        for k, model in enumerate(shared.value):
            mine = [i for i, f in enumerate(folds) if f == k]
            for i, f in zip(mine, all_spans([texts[i] for i in mine], model), strict=True):
                out[i] = f
        return out

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = found_in(batch)
                batch = batch.drop_columns(["_fold"]) if len(shared.value) > 1 else batch
                counts = [pa.array([sum(k == j for _, k, _ in f[0]) for f in found], pa.int64()) for j in range(3)]
                texts = [pa.array([hashlib.sha256(_joined(f[0]).encode()).hexdigest() for f in found], pa.string()), pa.array([_joined(f[1]) for f in found], pa.string())]
                scored = [pa.array([f[j] for f in found], pa.int64()) for j in (2, 3)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *counts, *texts, *scored], names=[*batch.schema.names, *names])

    return rows.mapInArrow(run, schema)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document's whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train_folds(docs))


def secret_base_rules(spark, sf_dir: str) -> DataFrame:
    """What the fixed rules find: the columns of op7 that SQL can express."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES = {"op7_secret_scan": op7_secret_scan, "secret_base_rules": secret_base_rules}
ORACLE = {
    "secret_base_rules": r"""
WITH p AS (
  SELECT unnest([0, 1, 2]) AS k, unnest(['assign', 'access', 'hex']) AS kind, unnest([
    '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)',
    '(AKIA)([A-Z0-9]+)', '()([0-9a-f]+)']) AS pattern, unnest([12, 14, 16]) AS least
), d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  SELECT doc_id, k, kind, least, regexp_extract_all(text, pattern) AS found, regexp_extract_all(text, pattern, 2) AS body, regexp_split_to_array(text, pattern) AS gaps
  FROM d, p
), l AS (SELECT doc_id, k, kind, least, body, list_transform(found, lambda x: length(x)) AS fl, list_transform(gaps, lambda x: length(x)) AS gl, unnest(range(1, len(found) + 1)) AS i FROM m
), s AS (
  SELECT doc_id, k, kind, CAST(list_sum(gl[1:i]) + coalesce(list_sum(fl[1:i - 1]), 0) AS BIGINT) AS a, fl[i] AS n FROM l WHERE length(body[i]) >= least
), g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
}
