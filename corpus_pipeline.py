"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Language ID rejects documents of no learned language, exact dedup and SimHash near-dedup keep
one document of each group, mixing repeats documents to equal shares of the sources, and byte-level BPE encodes what is left.

Every stage takes null and repeated ids, null and empty texts, wholly repeated rows, extra columns of any name, and empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import byte_bpe, exact_dedup, language_id, mixing, simhash
from sievewright.llm.common import ensure_checkpoint_dir, quoted
from sievewright.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language. All columns of documents; a null ``lang`` gets the predicted one.

    Documents without a letter (null and empty texts among them) go, and those that are like no language: mixtures, random letters.
    Repeated rows are judged alike; nulls in other columns don't matter. If nothing is labelled, all go.
    """
    return language_id.known(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts exactly one row, that of the largest doc_id (null last, ties by a hash of the row). All columns of documents.

    A null text equals an empty one.
    """
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component exactly one row, that of the smallest doc_id (null last, ties by a hash of the row). All columns of documents.

    Texts without a word, null ones among them, are one component.
    """
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have equal shares, shuffled. All columns of documents.

    A null source is a source of its own. Rows that repeat doc_id and text draw the same number of copies.
    """
    return mixing.mix(docs).select(*[F.col(quoted(c)) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids_sha256, decoded_sha256, token_ids of every copy. A null text has no tokens."""
    ranks, pattern = tokenizer()
    return byte_bpe.encode_documents(docs, ranks, pattern, keep=["doc_id", "source", "lang"])


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_neardup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: Language ID, SimHash and BPE aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. Between stages tables are written to the cluster's shared folder; only the last one is left, as the result reads it."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{n}-{name}")
            docs = spark.read.parquet(f"{base}/{n}-{name}")
            if n:  # what has been read in full isn't needed again
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{n - 1}-{STAGES[n - 1][0]}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
