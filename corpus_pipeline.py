"""Corpus pipeline: from raw documents to packed bins.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of ``documents``.

All stages take an empty table (they give no rows, and ``pack`` no pieces), null and repeated ids, nulls in any
column, empty and very long texts, and further columns of any name, which pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import line_dedup, ngram_join, packing, quality, secret_scan
from pathloom.llm.common import column, materialize, read_table, scratch, without_rows


def _recounted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``changed`` with its texts counted again, where ``docs`` has the column for it; null texts have no count."""

    def counted(name: str) -> Column:
        return F.char_length("text").cast(docs.schema[name].dataType).alias(name) if name == "n_chars" else column(name)

    return changed.select(*map(counted, docs.columns))


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Each row is scored by its own text, so rows that repeat an id, or have none, stay or go each for itself; null
    and empty texts are scored as empty. The other columns are not looked at.
    """
    own = ("doc_id", "text")
    rest = [c for c in docs.columns if c not in own]
    narrow = docs.select(*own, *([F.struct(*map(column, rest)).alias("rest")] if rest else []))
    kept = quality.score_quality(narrow, read_table(spark, sf_dir, "labels")).where("predicted = 1")
    return kept.select(*[F.col(c) if c in own else F.col("rest").getField(c).alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share.

    Every row stays: documents that lose all lines are empty, null texts stay null. Rows that repeat an id are one
    document where a line's documents are counted, and rows without an id are one together.
    """
    return _recounted(line_dedup.drop_repeated_lines(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id.

    Rows that share that id are one document and stay together; rows without an id stay, and so do empty and
    blank texts, which are linked with nothing.
    """
    found = materialize(ngram_join.similar_components(docs), "components")
    return without_rows(docs, found.where("doc_id <> component_id"), "doc_id")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked. Every row stays; null and empty texts have no secrets and stay as they are."""
    return _recounted(secret_scan.redact_secrets(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' pieces.

    Every row is packed, repeated ones and those without an id included; null and empty texts are one piece of no
    length. Ties go by id and text, and to the oldest bin.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good_documents),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The classifier, the entropy scan and the packing are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage wrote for itself and read is removed once its result is."""
    docs = read_table(spark, sf_dir, "documents")
    with scratch() as keep_last:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
            keep_last()
    return STAGES[-1][1](spark, docs, sf_dir)
