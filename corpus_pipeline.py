"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, tokenizing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the columns of
``documents``, whatever further columns these have; the last returns the tokenized documents' digests. Between stages
``run`` writes to the shared checkpoint folder, as a stage reads its input more than once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import byte_bpe, decontaminate, line_dedup, quality_rules, simhash
from tributary.llm.common import cut, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: No SQL: SimHash and byte-pair merging can't be expressed in it. tests/llm holds the run against brute force.
ORACLE_SQL = None


def wrapped(docs: DataFrame, *own: str) -> DataFrame:
    """The operator's own columns beside all columns as one value, so that no name of a document's column can clash."""
    return docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_rules.quality_rules(wrapped(docs, "text")).where("kept").select("__row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every later copy of a line goes, short ones too; a document that loses all of its lines stays, empty."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row")
    df = line_dedup.line_dedup(docs.select("doc_id", "text", rest), min_lines=1, min_words=1)
    left = {c: F.col(f"__row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in left:
        left["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("__row.n_chars"))
    return df.select(*[left[c].alias(c) for c in docs.columns])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return simhash.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    df = decontaminate.contaminated(wrapped(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"), short_items=True)
    return df.where(~F.col("contaminated")).select("__row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df = byte_bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), with_ids=False)
    return df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_copy_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
