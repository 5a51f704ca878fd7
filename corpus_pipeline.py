"""Training-corpus pipeline: quality classifier, line dedup, SimHash near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes every stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framejobs.llm import line_dedup, mixing, packing, quality_model, simhash
from framejobs.llm.common import prepare
from framejobs.llm.queries import GRADE, LEAST_CHANCE, documents, vocabulary
from framejobs.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that reach the best grade with enough probability; the others go, wordless ones included."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.train(docs, quality_model.graded(labels), 3)
    return quality_model.rate(docs, model, GRADE, LEAST_CHANCE).where("selected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines whose template recurs; a document left without a word goes. ``n_chars`` follows the text."""
    prepare(spark)
    clean = line_dedup.drop_recurring_lines(docs)
    clean = clean.where((F.col("n_dropped") == 0) | F.col("text").rlike(mixing.WORD))
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies, that of the smallest id; rows of one id or none are told apart by content."""
    prepare(spark)
    return simhash.survivors(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights; a document appears as often as the mix takes it."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents of the mix in windows of 1024 tokens."""
    prepare(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("source mixing", mixture),
    ("packing", windows),
]
#: The classifier is trained, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepare(spark), sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
