"""From documents to training sequences: toxic texts, near duplicates and benchmark leaks go, the rest is packed.

Each stage is `(name, function)`; a function takes (spark, docs, sf_dir) and returns the documents it keeps, with all their columns, the
last one the pieces of the packed sequences. `run` writes every stage as Parquet to the shared folder and reads it again.

Defined cases: documents with null or empty text are kept by the filters and packed as their end token. Rows that repeat a doc_id and its
text leave one row (the smallest); different texts of a doc_id are documents of their own; rows without a doc_id are never taken for copies. An empty table gives no pieces. Columns beside doc_id and text
are passed through, whatever their names. With fewer than `toxicity.FOLDS` texts of a class in the sample no text
is rejected as toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metframe.llm import decontaminate, minmax, packing, toxicity
from metframe.llm.common import one_row_per_id
from metframe.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the model learnt from the labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more of five-word shingles."""
    found = minmax.judged(docs, words=5, percent=80)
    copies = found.where("NOT kept").select(F.col("doc_id").alias("__copy"), F.col("text_hash").alias("__hash"))
    copies = materialize(copies.distinct(), "copies")
    if copies.count() <= minmax.SENT_IDS:
        copies = F.broadcast(copies)
    same_text = F.col("__hash").isNull() | (F.col("__hash") == F.xxhash64("text"))
    return one_row_per_id(docs, "doc_id", "text").join(copies, (F.col("doc_id") == F.col("__copy")) & same_text, "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, as of operator 6."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
