"""From raw documents to token ids: quality filter, line deduplication, near-duplicate removal, source mix,
encoding. Each stage takes all documents that the one before kept; its result is written as Parquet and read
as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import lines, mixing, pieces, quality, simhash
from kinloom.llm.common import table, work_dir
from kinloom.llm.queries import tokenizer_file


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are. Null and empty texts have the score
    of the sample at large, so they go or stay together; repeated rows share their text's fate; without labels, and
    without documents, none is scored good."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and alike lines the first stays: by doc_id (null last), then by the text's hash, then by line. A document
    that loses all its lines stays, empty; null and empty texts and blank lines stay; repeated rows come out alike."""
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays (null last; ties by the text's hash;
    of repeated rows one). Null, empty and wordless texts are one component."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are what the mix takes of each document; those of which it takes nothing, empty and null ones too, go. A null
    source is a source; each row has its own share, repeated or not."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, a row for each row; null text counts as empty."""
    return pieces.digests(pieces.encoded(docs, tokenizer_file("piece_bpe_32k.model")))


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix_sources), ("encode", encode)]

#: The classifier, MinHash and the encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
