"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, line_dedup, private_data, quality_classifier, quality_rules, simhash, substring_dedup, url_filters
from .common import table

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select("doc_id", *BASE_COLUMNS, "base_failed", "kept")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS "
        "t(turn, role)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.digests(chat_format.format_chats(turns))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = private_data.find_private_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ", ".join(f"'{k}'" for k in private_data.BASE_KINDS)
    said = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return df.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(pii, s -> s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in private_data.BASE_KINDS],
        F.expr(f"sha2({said.format(f'filter(pii, s -> s.kind IN ({base}))')}, 256)").alias("base_sha256"),
        F.expr(said.format("pii")).alias("spans"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), short_items=True)
    return df.select("doc_id", "contaminated", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("items"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False)
    return df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = url_filters.url_filters(table(spark, sf_dir, "pages").select("page_id", "url"))
    return df.select("page_id", "host", "path", "rule", "verdict")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_private_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the base kinds alone, which SQL can express."""
    return op3_private_data(spark, sf_dir).drop("spans")


def op8_url_filters_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as deep as they are, siblings merged at any fan-out, unlabelled branches judged as what surrounds them."""
    df = url_filters.url_filters(table(spark, sf_dir, "pages").select("page_id", "url"), depth=None, many=2, inherit=True)
    return df.select("page_id", "host", "path", "rule", "verdict")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_line_dedup_every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=1, min_words=1)
    return df.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_quality_rules,
            op2_chat_format,
            op3_private_data,
            op4_decontaminate,
            op5_substring_dedup,
            op6_simhash,
            op7_byte_bpe,
            op8_url_filters,
            op9_quality_classifier,
            op10_line_dedup,
        )
    }


def variants() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Further queries of operators that ``queries`` has, with other parameters or columns."""
    return {f.__name__: f for f in (op3_private_data_base, op8_url_filters_inherited, op10_line_dedup_every_line)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.oracle(),
        "op2_chat_format": chat_format.oracle(),
        "op4_decontaminate": decontaminate.ORACLE,
        "op5_substring_dedup": substring_dedup.ORACLE,
        "op8_url_filters": url_filters.oracle(),
        "op10_line_dedup": line_dedup.ORACLE,
    }


def variant_sql() -> dict[str, str]:
    return {
        "op3_private_data_base": private_data.base_oracle(),
        # as many levels as suffice for the given pages
        "op8_url_filters_inherited": url_filters.oracle(depth=6, many=2, inherit=True),
        "op10_line_dedup_every_line": line_dedup.ORACLE_EVERY_LINE,
    }
