"""Quality rules: cross-document line frequency, in DataFrame functions only.

Lines are normalised (ASCII letters lower-cased, digits to 0, everything but letters
and digits of any script dropped, so that spacing and punctuation do not hide
a repeat) and hashed.  Per host (``source``) the distinct documents of each
line are counted; a line found in more than ``max_docs`` documents of a host is
removed, whatever the host's size, and a document that keeps less than
``min_share`` of its words is depleted and rejected.  Two options: with
``max_share`` a line must also be in more than that share of the host's
documents, and with ``copies_count=False`` documents of one text are one.

Every text's own figures are computed in its row: repeated three-word windows
by sorting (hash, place) pairs of the row, without any shuffle.  Texts are read
twice, for the figures and for the lines; what is shuffled is one row (hashes
of host, line and text, doc_id) per distinct line of a document, pre-aggregated,
and one narrow row a document.  Lines above the limits meet the others by a
broadcast of checked size, or else salted.

Defined results: null and empty texts have no words and fail the base rules;
rows with equal doc_id, source and text are one document and get equal
verdicts; null ids with equal texts are one document too; null hosts form one
host; lines without a letter or digit are never removed.  Extra columns are
kept by ``rules``, whatever their names; the figures it adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, shielded, words_of

MAX_DOCS = 20
MIN_SHARE = 0.2
MIN_WORDS = 50
LINES_BROADCAST = 1_000_000
SALT = 32
PRIVATE = ("_words", "_sorted", "_after", "_places", "_gaps", "_lines", "_s", "_t", "_d", "_h", "_w", "_m", "_gone", "_salt")

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "kept")


def normal_line(line: Column) -> Column:
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.regexp_replace(low, r"[^\p{L}\p{N}]+", "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more: repeated windows' places in order cover up to three words each."""
    n = F.size(words)
    marked = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"), i.cast("int").alias("i")))
    ranked = F.sort_array(marked)
    return F.when(n >= 3, ranked)


def _base(docs: DataFrame) -> DataFrame:
    """Own figures of every text, one projection a step so that no array is computed twice."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.withColumn("_words", words_of(F.col("text")))
    step = step.withColumn("_sorted", repeat_words(F.col("_words")))
    # neighbours of equal hash mark places; sorted again, their gaps (3 at most) add up to the words covered
    s, m = F.col("_sorted"), F.size("_sorted")
    after = F.concat(F.slice(s, 2, F.greatest(m - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    step = step.withColumn("_after", F.when(m > 1, after))
    same = F.zip_with("_sorted", "_after", lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    step = step.withColumn("_places", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    p, k = F.col("_places"), F.size("_places")
    gaps = F.zip_with(F.slice(p, 2, F.greatest(k - 1, F.lit(0))), F.slice(p, 1, F.greatest(k - 1, F.lit(0))), lambda y, x: F.least(y - x, F.lit(3)))
    step = step.withColumn("_gaps", F.when(k > 1, gaps))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("_lines", lines)
    return step.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.coalesce(k, F.lit(0)) > 0, 3 + F.coalesce(F.aggregate("_gaps", F.lit(0), lambda a, x: a + x), F.lit(0))).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def _key(copies_count: bool) -> list[Column]:
    """Host and document of a row: hashes of source and text, and the doc_id (null where copies are one document)."""
    own = F.col("doc_id") if copies_count else F.lit(None).cast("long")
    return [F.xxhash64("source").alias("_s"), F.xxhash64("text").alias("_t"), own.alias("_d")]


def common_lines(lined: DataFrame, hosts: DataFrame | None, max_docs: int, max_share: float) -> DataFrame:
    """(_s, _h): lines above the limits of their host."""
    counts = lined.groupBy("_s", "_h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    if hosts is None:
        return counts.select("_s", "_h")
    return counts.join(hosts, "_s").where(F.col("docs") > F.col("host_docs") * max_share).select("_s", "_h")


def removed_words(docs: DataFrame, rows: DataFrame, max_docs: int, max_share: float, copies_count: bool) -> DataFrame:
    """(_s, _t, _d, _gone): words of each document's lines that are above its host's limits.

    rows: (_s, _t, _d) of every row, to tell repeated rows from repeated lines.
    """
    # normalised after the explode, in generated code; lines without letter or digit go after the aggregation
    each = docs.where("text is not null").select(*_key(copies_count), F.explode(F.split("text", "\n", -1)).alias("line"))
    hashed = each.select("_s", "_t", "_d", F.xxhash64(normal_line(F.col("line"))).alias("_h"), F.regexp_count("line", F.lit(WORD)).alias("_w"))
    # one row per document and line, however often the row itself or the line in it is repeated
    lined = checkpoint(hashed.groupBy("_s", "_t", "_d", "_h").agg(F.sum("_w").alias("_w")).where(F.col("_h") != F.xxhash64(F.lit(""))))
    hosts = rows.distinct().groupBy("_s").agg(F.count("*").alias("host_docs")) if max_share > 0 else None
    above = checkpoint(common_lines(lined, hosts, max_docs, max_share))
    if above.count() <= LINES_BROADCAST:
        hit = lined.join(F.broadcast(above), ["_s", "_h"])
    else:
        dealt = above.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hit = lined.withColumn("_salt", F.pmod(F.xxhash64("_t", "_d"), F.lit(SALT)).cast("int")).join(dealt, ["_s", "_h", "_salt"])
    total = hit.groupBy("_s", "_t", "_d").agg(F.sum("_w").alias("_w"))
    times = rows.groupBy("_s", "_t", "_d").agg(F.count("*").alias("_m")).where("_m > 1")
    t, m = total.alias("t"), times.alias("m")
    return t.join(m, _same("t", "m"), "left").select("t._s", "t._t", "t._d", (F.col("t._w") / F.coalesce("m._m", F.lit(1))).cast("long").alias("_gone"))


def _same(x: str, y: str) -> Column:
    return (F.col(f"{x}._s") == F.col(f"{y}._s")) & (F.col(f"{x}._t") == F.col(f"{y}._t")) & F.col(f"{x}._d").eqNullSafe(F.col(f"{y}._d"))


def rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = 0.0, min_share: float = MIN_SHARE, copies_count: bool = True) -> DataFrame:
    """``docs`` with the figures, kept_words and the verdict ``kept``."""
    docs, back = shielded(docs.drop(*FIGURES), PRIVATE)
    names = [c for c in docs.columns if c != "text"]
    figured = checkpoint(_base(docs).select(*(F.col(f"`{c}`") for c in names), *_key(copies_count), *FIGURES[:5]))
    gone = removed_words(docs.select("doc_id", "source", "text"), figured.select("_s", "_t", "_d"), max_docs, max_share, copies_count)
    joined = figured.alias("f").join(gone.alias("g"), _same("f", "g"), "left")
    n, rep = F.col("f.n_words"), F.col("f.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * rep > 50 * n)
    left = n - F.coalesce("g._gone", F.lit(0))
    out = joined.select(*(F.col(f"f.`{c}`") for c in names), *(F.col(f"f.{c}") for c in FIGURES[:5]), failed.alias("base_failed"), left.alias("kept_words"), (~failed & (left >= min_share * n)).alias("kept"))
    return out.withColumnsRenamed(back)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's figures and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return rules(docs).select("doc_id", *FIGURES[:6], "kept")


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE = {
    "op10_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), g AS (
  SELECT i, unnest(range(1, len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda k: array_to_string(ws[k : k + 2], ' '))) AS w FROM d WHERE len(ws) >= 3
), r AS (SELECT i, p FROM (SELECT i, p, count(*) OVER (PARTITION BY i, w) AS c FROM g) WHERE c > 1
), c AS (SELECT i, count(*) AS n FROM (SELECT DISTINCT i, p + unnest([0, 1, 2]) AS p FROM r) GROUP BY i
), t AS (SELECT DISTINCT source, doc_id, text FROM documents WHERE text IS NOT NULL
), u AS (SELECT source, doc_id, text, unnest(string_split(text, chr(10))) AS line FROM t
), l AS (
  SELECT source, doc_id, text, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\p{L}\p{N}]+', '', 'g') AS k,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM u
), a AS (
  SELECT source, k FROM (SELECT DISTINCT source, doc_id, text, k FROM l WHERE k <> '') GROUP BY ALL HAVING count(*) > 20
), x AS (SELECT l.source, l.doc_id, l.text, sum(w) AS gone FROM l JOIN a ON a.source IS NOT DISTINCT FROM l.source AND a.k = l.k GROUP BY ALL
), f AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(ls, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(x.gone, 0) AS gone
  FROM d LEFT JOIN c ON c.i = d.i LEFT JOIN x ON x.source IS NOT DISTINCT FROM d.source AND x.doc_id IS NOT DISTINCT FROM d.doc_id AND x.text = d.text
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= 0.2 * n_words AS kept
FROM f
"""
}
