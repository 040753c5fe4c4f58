"""Shared helpers: text columns, and the stored tables of the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, stored

__all__ = ["documents", "id_bucket", "new_path", "stored", "text_of"]


def text_of(column: str = "text") -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_bucket(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo n. A null id is in bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0)).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
