"""A corpus pipeline of five operators, each written as Parquet and read again.

Every stage takes all documents that the one before it kept and, but for the
last, returns the columns of its input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import fresh, materialize, table
from assayer.llm.langid import keep_identified, train
from assayer.llm.minhash import first_of_groups
from assayer.llm.packing import pack, token_pieces
from assayer.llm.secret_scan import redact, secret_spans
from assayer.llm.substring import remove_repeats

#: The result is not expressible in SQL: tests hold it against a brute-force version.
ORACLE_SQL = None


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language is found; identified mixtures stay.

    That is, texts that are null or hold no letter, and all texts where no row has a
    language to learn from. Repeated rows and null ids are judged each; an empty
    table stays empty; all columns are kept.
    """
    return keep_identified(docs, train(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that with the smallest id.

    Five-word shingles, similarity 0.8. Documents without words, without an id or
    without a near duplicate stay; rows that share an id but not a text are judged
    apart, and of equal rows one stays. An empty table stays empty; all columns are
    kept, maps and names of this stage included.
    """
    return first_of_groups(docs, shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts stretches of 35 words or more that also occur elsewhere, in any row.

    Documents stay, cut to an empty text if need be. Null texts stay null; repeated
    rows count as occurrences of each other; null ids are allowed; an empty table
    stays empty; all columns are kept, and ``n_chars`` follows the text.
    """
    return _resized(remove_repeats(docs, window=35, text_only=True))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark.

    Null and empty texts stay as they are; repeated rows and null ids are scanned
    each; an empty table stays empty; all columns are kept, and ``n_chars`` follows
    the text.
    """
    (spans,) = fresh(docs, "secrets")
    return _resized(redact(secret_spans(docs, out=spans), spans=spans).drop(spans))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of 4096: one row per piece.

    Null text is empty: one token. Repeated rows and null ids are packed each; an
    empty table gives no rows; columns other than id and text are not needed.
    """
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids"))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``, in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
