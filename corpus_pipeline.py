"""From raw documents to token ids, in four stages over the whole table.

Each stage works on all that its predecessor kept: documents of low quality or toxic ones go, one document of each group
of near copies stays, documents that hold a benchmark item go, and the rest is encoded.

Contract: the first three stages return the columns of their input, extra ones included, and never drop a row without an id
for its lack of one.  Rows that repeat (id and text, or text alone) are one group of copies: one of them stays after the second stage.  Rows without words are in
no group.  An empty table passes through; without labels the classifier keeps every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm import bpe, decontaminate, jaccard, quality, queries
from eventlake.llm.rows import materialize, release

NEAR_COPIES = jaccard.Measure(words=5, percent=80)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled documents of its own input (operator 5)."""
    return quality.keep_good(docs, "text", queries.quality_model(docs, queries.table(spark, sf_dir, "labels")), queries.GOOD_GRADE, queries.GOOD_PROBABILITY)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (operator 6): five words a shingle, a similarity of 0.8 or more."""
    return jaccard.keep_one_of_each(docs, "doc_id", "text", NEAR_COPIES)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the error budget (operator 4)."""
    return decontaminate.drop_leaks(docs, "text", queries.table(spark, sf_dir, "benchmark"), "item_id", "text")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves (operator 7)."""
    encoded = bpe.bpe_encode(docs, "doc_id", "text", f"{queries.TOKENIZERS}/word_bpe_49k.json")
    return bpe.bpe_digest(encoded, "doc_id", "ids")


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each),
    ("decontaminate", without_benchmark),
    ("bpe", token_ids),
]

#: SQL expresses neither the classifier nor the encoder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
