"""A corpus pipeline of four operators: quality, language, near copies, packing.

Each stage takes what its predecessor kept. The first two drop the documents that their classifier rejects, the
third keeps one document of each group of near copies, the last packs what is left into training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.llm import language_ftrl, ngram_jaccard, packing_gga, quality_cnn
from contentlake.llm.common import Scratch, documents, fold, labels

#: A document stays if its quality reaches the first limit and its language's calibrated probability the second.
QUALITY, LANGUAGE = 0.7, 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    net = quality_cnn.fit(docs, labels(spark, sf_dir).filter(fold("doc_id", 4) != 2))
    return docs.filter(net.column() >= QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; those without a letter or with a doubtful one go."""
    model = language_ftrl.fit(docs.filter(fold("doc_id", 3) != 1))
    return docs.filter(model.column()["score"] >= LANGUAGE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies; a row that occurs repeatedly stays once."""
    found = ngram_jaccard.near_copies(docs)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["kept"]), "left_semi").dropDuplicates(["doc_id", "text"])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row per piece of a document."""
    return packing_gga.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("language id", language), ("n-gram jaccard join", near_copies), ("best-fit packing", packing)]

#: Training and packing have no SQL form; tests hold the pipeline against its operators applied by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    scratch = Scratch(spark)
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
