"""The pipeline's stages, each against its own input."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(i)))
        made = spark.read.parquet(str(folder / str(i)))
        out.append((name, docs, made))
        docs = made
    return out


def test_columns_and_rows(stages):
    first = stages[0][1]
    for _, before, after in stages[:-1]:
        assert after.columns == first.columns
        assert after.join(before.select("doc_id").distinct(), "doc_id", "left_anti").isEmpty()
    for _, before, after in stages[:3]:
        assert 0.5 * before.count() < after.count() <= before.count() and after.count() == after.distinct().count()


def test_toxic_documents_go(spark, stages):
    # the smallest table has ten toxic labels to learn from: too few to measure by
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, folder).join(labels, "doc_id").cache()
    assert kept.where("toxic = 1").count() <= 0.2 * labels.where("toxic = 1").count()
    assert kept.where("toxic = 0").count() >= 0.97 * labels.where("toxic = 0").count()


def test_no_near_copies_are_left(stages):
    from test_operators import brute_components

    _, before, after = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    _, root = brute_components(rows)
    least = {}
    for (i, _), f in zip(rows, root, strict=True):
        least[f] = min(i, least.get(f, i))
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == set(least.values())


def test_no_item_is_left(spark, stages):
    _, before, after = stages[2]
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in before.collect() if any(i in flat(r["text"]) for i in items)}
    kept = {r["doc_id"] for r in after.collect()}
    assert not leaked & kept and kept == {r["doc_id"] for r in before.collect()} - leaked


def test_every_document_is_written(stages):
    _, before, after = stages[-1]
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


EXTRA = ("score", "predicted", "size", "target", "k", "_k", "_gone", "_copy", "_d", "_t", "copies", "slot", "hash", "_own_score")


def odd_rows():
    long = " ".join(f"w{i % 4999}" for i in range(200_000))
    texts = [None, "", " \t\n", "one", "one", long, long + " end", "plain words of a text that is like no other one here at all", "ein Ö für ß\n" * 3, None]
    rows = [(i, t, None if i % 3 == 0 else "en", (None, "s1", "s2")[i % 3], None) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, texts[7], None, None, None), (None, None, None, None, None), (7, "another text of the same id", "en", "s1", 3)]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    table = spark.createDataFrame([(*r, *(f"{c} {i}" for c in EXTRA)) for i, r in enumerate(odd_rows())], schema).repartition(3)
    for docs in (table, table.where("false")):
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert {r["k"] for r in rows} <= {r["k"] for r in docs.collect()} and all(r[c] == f"{c} {r['k'].split()[1]}" for r in rows for c in EXTRA)
        assert bool(rows) != docs.isEmpty()
    kept = [r["text"] for r in stage(spark, table, SF).collect()] if name != corpus_pipeline.STAGES[-1][0] else []
    if name == "n-gram Jaccard join":
        assert sorted(str(t)[:30] for t in kept) == sorted(str(t)[:30] for t in [None] * 3 + ["", " \t\n", "one", odd_rows()[5][1], odd_rows()[7][1], odd_rows()[8][1], "another text of the same id"])
    if name in ("toxicity", "benchmark decontamination"):
        assert len(kept) == table.count()
    if name == "mixing sources to target weights":
        assert all((t or "").split() for t in kept)
