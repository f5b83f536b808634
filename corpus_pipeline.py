"""From raw documents to packed training sequences, one stage after the other.

All stages but the last return the columns of `documents`. Rows without id pass
every stage; rows that share an id share its fate.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.decontaminate import contaminated
from orderlens.llm.line_dedup import deduplicated_lines
from orderlens.llm.near_dedup import near_duplicates
from orderlens.llm.packing import packed_documents
from orderlens.llm.store import in_files, saved
from orderlens.llm.toxicity import fit_severity, severity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

NEAR_PERCENT = 80  # similarity of five-word shingle sets from which documents are near-duplicates

LEAST_ITEM_WORDS = 4  # of a benchmark item that a document must not hold

_PACKED = ("doc_id", "text", "__rest")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a struct of all other columns, whose names then can't clash with a stage's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in _PACKED]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("__none")).alias("__rest"))


def _unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that `_packed` took, some with new values."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), **new}
    return rows.select(*[own.get(c, F.col("__rest")[c]).alias(c) for c in columns])


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return in_files(docs.join(ids.distinct(), "doc_id", "left_anti").select(docs.columns), docs.count())


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    model = fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(severity(_packed(docs), model, _PACKED).where("not rejected"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document holds go; a document of nothing else goes with them."""
    cleaned = deduplicated_lines(_packed(docs)).where("lines_removed = 0 or trim(text) <> ''")
    length = F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("__rest.n_chars"))
    return in_files(_unpacked(cleaned, docs.columns, n_chars=length), docs.count())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group stays."""
    return _without(docs, near_duplicates(docs, NEAR_PERCENT).where("not kept").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Items of fewer than LEAST_ITEM_WORDS words, which any text may hold, mark none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = items.where(F.size(F.split(F.trim("text"), r"\s+")) >= LEAST_ITEM_WORDS)
    return _without(docs, contaminated(docs, items).select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of the documents that are left, each piece with its place in a sequence."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# A trained model, alignment and a tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
