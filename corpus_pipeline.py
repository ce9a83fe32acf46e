"""From raw documents to training shards, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and
returns the rows that go on; the caller writes them as Parquet and reads them
again for the next stage.  All but the last return the columns of documents,
extra ones included, whatever their names.

Defined results, stage by stage: rows with null or empty texts are not toxic as
such, are no one's copies, leak nothing, are never taken into the mix (they
have no words) and so reach no shard; null ids and null sources are values like
any other, except that rows with a null id train nothing; repeated rows are
judged alike, and the second stage keeps one of them; empty tables give empty
ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapeloom.llm import binaryoutput, decontam, mixing, ngramjoin, toxicity
from shapeloom.llm.common import scratch, shielded


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    safe, back = shielded(docs, ("score", "predicted"))
    return toxicity.score(safe, model).where("predicted = 0").drop("score", "predicted").withColumnsRenamed(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return ngramjoin.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights take it."""
    return mixing.repeat(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; returns each sequence's document, slot and place."""
    return binaryoutput.materialise(docs, scratch(spark, "shards"))


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a written table between any two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: Trained and randomised stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
