"""A training corpus from raw documents: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage works on all that the stage before it kept. run() writes a stage's rows into the shared
folder and reads them again before the next, so that a lost executor repeats one stage at most.

Cases: null ids are kept apart by their texts (near_dedup) or count as the least id (line_dedup); a null or
empty text has no words and is dropped by quality_rules; a null source is a source of its own, the last;
rows that repeat id and text are near-duplicates of one another, so one stays; a very long text is one row
throughout; an empty table gives an empty result with the same columns; further columns of documents pass
through to the mixture, whatever their names. The last stage gives a row for each copy that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timeloom.llm import bpe, lines, mixing, quality, simhash
from timeloom.llm.common import cut, discard, in_file_order, load, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the current policy of quality rules rejects."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes chunks of lines that an earlier document has, byte for byte."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target asks, in training order."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each document: doc_id, n_tokens, ids_sha256, decoded_sha256, in the order in
    which the mixture was written, which is the order of training."""
    return bpe.digests(docs, bpe.multilingual(), in_file_order(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: Fingerprints, chunk boundaries and merges are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:  # a stage's own tables go when it ends, its input when its output is written
            docs = cut(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
