"""A corpus pipeline: each stage works on all rows that the one before it kept.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents; the last returns the packing of the documents that are left.

Null texts count as empty and pass the filters; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import dartminhash, decontaminate, exact_dedup, packing, toxicity
from docloom.llm.common import released, scratch, watched
from docloom.llm.queries import table, tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model calls toxic. It is fitted on the labelled rows of docs."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.drop_near(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("packing", pack)]

#: The stages have models, signatures and a tokenizer that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of what all stages keep. When a stage is written its scratch tables, and the
    output of the stage before, are deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with watched() as made:
            stage(spark, docs, sf_dir).write.parquet(path)
        released(spark, *made, *([last] if last else []))
        docs, last = spark.read.parquet(path), path
    return docs
