"""From raw documents to token numbers: quality, near duplicates, repeated paragraphs, mixing, encoding.

Each stage takes (spark, docs, sf_dir); its result is written to the shared folder as Parquet and
reread as the next one's documents. All but the last return the columns of the documents.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns are handled as the
docstrings of the operators say; a null text counts as an empty one throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visitwise.llm import bpe, mixing, passages, quality, simhash
from visitwise.llm.common import table
from visitwise.sources.workspace import stage

#: SQL has no convolution, no XXH64 and no BPE; the tests chain plain versions of the stages.
ORACLE_SQL = None


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def remove_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs that stand, or nearly stand, earlier in the documents leave the texts."""
    return passages.remove_repeated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's repetition rate and their coin say."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of what they decode to: one row per emitted document."""
    return bpe.encode(docs, bpe.Vocabulary.load(), returns=bpe.Encoded(ids=True, digests=True))


STAGES = [
    ("quality", accept_quality),
    ("near_duplicates", drop_near_duplicates),
    ("paragraphs", remove_paragraphs),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
