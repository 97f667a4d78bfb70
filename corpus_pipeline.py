"""The corpus pipeline: filter by quality, dedup lines, keep one of near copies, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame. All
but the last return the columns that `docs` has, extra ones included. `run` writes every
stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossblock.llm import line_dedup, mixing, ngram_join, packing, quality
from crossblock.llm.common import fold, table
from crossblock.llm.queries import tokenizer
from crossblock.session import cut, scratch_path, workspace

#: Near copies: five-word shingles, similarity of 0.8 or more.
NEAR = ngram_join.Rule(width=5, part=4, whole=5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    It learns from the labels outside fold 0 of 5 and decides by the text alone, so equal
    texts are kept or go together. Without labels all stay.
    """
    vectors = cut(quality.measured(docs))
    learnt = quality.with_labels(
        vectors, table(spark, sf_dir, "labels"), key="doc_id", label="quality", where=fold("key", 5) != 0
    )
    return quality.kept(docs, quality.fit(learnt))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated three-line windows.

    n_chars follows the text. A document that loses all of its lines goes; one that had none
    stays.
    """
    cleaned = line_dedup.dedup(docs)

    def column(name: str):
        if name == "text":
            return F.col("text")
        own = F.col("row")[name]
        if name == "n_chars":
            own = F.when(F.col("removed") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return cleaned.where("removed = 0 OR left > 0").select(*[column(c) for c in docs.columns])


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the smallest doc_id."""
    return ngram_join.representatives(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken twice is two rows."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token piece of the mixed documents lies in the packed sequences."""
    items = cut(packing.pieces(docs, tokenizer()))
    return packing.pack(items).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", dedup_lines),
    ("ngram_join", keep_one_of_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage writes on its way is deleted when its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with workspace(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
