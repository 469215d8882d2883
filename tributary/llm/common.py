"""Helpers that several operators share: word splitting in SQL, checkpoints, table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_dir, cut

__all__ = ["WORD_GAP", "checkpoint_dir", "cut", "table", "words_of"]

#: Separators of words everywhere in this subpackage: space and the five ASCII controls 0x09 to 0x0D.
WORD_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
