"""Readers and writers of the engine's tables."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a malformed line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def save_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` writes one file, for results that are small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def save_pool(docs: DataFrame, path: str, buckets: int | None = None) -> None:
    """Persist a memory pool (doc_id, text, embedding) as Parquet, sorted by id within partitions."""
    laid = docs.repartition(buckets, "doc_id") if buckets else docs
    laid.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(path)


def embed(docs: DataFrame, model, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """Embeddings of a text column. ``model`` makes, once per worker, a function from a list of texts to vectors."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in batches:
            yield pd.Series(list(encode(texts.fillna("").tolist())))

    return docs.withColumn(out_col, F.pandas_udf(run, T.ArrayType(T.FloatType()))(F.col(text_col)))


def hashed_embedder(dimensions: int = 64):
    """A model for :func:`embed` that needs no download: hashed word counts, length one."""

    def model():
        import zlib

        import numpy as np

        def encode(texts: list[str]):
            out = np.zeros((len(texts), dimensions), np.float32)
            for row, text in zip(out, texts, strict=True):
                for w in text.lower().split():
                    h = zlib.crc32(w.encode())
                    row[h % dimensions] += 1 if h >> 16 & 1 else -1
                norm = float(np.sqrt((row**2).sum()))
                if norm:
                    row /= norm
            return out.tolist()

        return encode

    return model
