"""A corpus pipeline of five stages, each applying one operator of ``sievelake.llm``.

Each stage works on all its predecessor kept. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm import byte_bpe, decontaminate, exact_dedup, language_id, near_dedup
from sievelake.llm.common import fresh_path


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


STAGES = [
    ("language ID", language_id.stage),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("byte-level BPE", byte_bpe.stage),
]

#: Language ID, near copies, edit matching and BPE can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each reading what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
