"""Corpus cleaning: toxic documents, repeated lines, near copies and benchmark passages go, the rest is tokenised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm import decontaminate, linededup, sentencepiece, simhash, toxicity
from traitloom.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of ``THRESHOLD`` or more go. The classifier learns from the labelled documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("_toxicity") < toxicity.THRESHOLD).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in the one with the largest id; ``n_chars`` follows the text."""
    out = linededup.dedup_lines(docs).withColumn("text", F.col("_deduped.text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (shingles of five words, similarity of 0.8 or more) the smallest doc_id stays."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (containment of 0.8 or more of its five-word shingles) go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, whether they give it back, and whether the sentencepiece library gives the same ids."""
    out = sentencepiece.tokenise(docs)
    ids = F.col("_pieces.token_ids")
    back = F.col("_pieces.decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", F.size(ids).alias("n_tokens"), ids.alias("token_ids"), back.alias("round_trip"), "_pieces.parity")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("sentencepiece", tokenise),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
