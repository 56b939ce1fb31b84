"""A training-data pipeline over ``documents``: five stages, each one operator of ``tessellar.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of documents.

1. language: rows without letters, or whose language stays a guess, go.
2. near duplicates: one row of each SimHash component stays.
3. secrets: found secrets are masked in the text, and n_chars follows.
4. mixing: rows come as often as the mix takes them, and the part it takes of one document
   a source as that many words; rows taken 0 times go. Each row counts for itself, with or
   without id.
5. tokens: the ids of each whole text, and a digest of the text decoded from them.

Null and empty texts go in the first stage; a null source is a source; null ids stay
null; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import bpe, langid, mixing, secrets, simhash
from tessellar.llm.common import settle_table, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.deliver(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else mixed


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_rows(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mask_secrets", mask_secrets),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: No SQL: language and tokens are learned or read from files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for no, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if no < len(STAGES):
            docs = settle_table(docs)
    return docs
