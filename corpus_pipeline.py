"""A corpus from raw documents to token ids, in stages that are each written as Parquet and read again.

Quality, then repeated lines, near copies, benchmark leaks, tokens.  Every stage works on all that the one before kept;
all but the last return the columns of ``documents``.  No stage is expressed in SQL, so ORACLE_SQL is None and
tests/llm compares every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import bpe, latent, lines, near, quality
from wardline.llm.common import small_batches, staged, table
from wardline.llm.contract import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without blocks of lines that an earlier document has, and without documents of which nothing is left."""
    small_batches(spark)
    return lines.dedup(docs, drop_emptied=True).drop("_wl_cut")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree in four fifths or more, by links."""
    small_batches(spark)
    return near.keep_one(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    small_batches(spark)
    return latent.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the digest of the text that they decode to."""
    small_batches(spark)
    return bpe.encoded(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
