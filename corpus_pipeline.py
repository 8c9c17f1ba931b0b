"""From raw documents to token digests: five stages over all documents.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosestat.llm import minhash_dedup, mixing, quality, secret_scan, tokens
from prosestat.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (op2).

    Null and empty texts are scored as texts without terms, by the prior; very long ones are
    scored whole; ties in a vote go to the earlier labelled text; rows of one doc_id are kept or
    rejected each by its own text; null ids, langs and sources stay as they are; an empty table
    gives no rows; other columns, whatever their names, are left out."""
    return quality.keep(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates (op1).

    Documents with a null id or no words (null, empty or blank texts) have no copies and stay;
    very long texts are compared whole; rows that repeat an id are one document, of which one
    row stays, the first by text, lang, source and n_chars; an empty table gives no rows; other
    columns, whatever their names, are left out."""
    flags = minhash_dedup.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c"))
    dropped = flags.where("c <> doc_id").select("doc_id")
    rows = docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti")
    named = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
    return named.select("doc_id", "r.*").unionByName(rows.where("doc_id is null"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kind (op7), and n_chars counted again where any were.

    Null and empty texts stay; very long ones are searched whole; spans that overlap are joined
    and named after the first, the kind listed first on ties; rows that repeat are treated alike;
    an empty table gives no rows; other columns, whatever their names, are left out."""
    return secret_scan.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources (op6), by documents: each block's words stand in the result as
    often as the mix takes the block, so each source's words come near its target. A document
    has a row for each time it is used, with the words that are used so often, and up to three.

    Documents without words (null, empty or blank texts) take no part in the mix and go; very
    long texts fill many blocks; a null source is one of its own, the last; null ids stay; rows
    that repeat are mixed apart; an empty table gives no rows; other columns, whatever their
    names, are left out."""
    return mixing.repeat(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests (op5).

    Null texts count as empty and have no ids; very long ones are encoded in pieces, as if whole;
    special-token strings are ordinary text; a null id is carried through; rows that repeat have
    a row each; an empty table gives no rows; other columns are left out."""
    return tokens.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_good), ("near_dedup", drop_copies), ("secrets", hide_secrets), ("mixing", mix_sources), ("encoding", encode)]

#: The classifier and the permutations have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
