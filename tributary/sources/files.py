"""File formats by name, write modes, inspection."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import BAD_PARAMETER, FORMAT, IO, PipelineError

#: Format names of documents, and Spark's.
READERS = {
    "csv": "csv",
    "parquet": "parquet",
    "json": "json",
    "ndjson": "json",
    "jsonl": "json",
    "orc": "orc",
    "text": "text",
    "xml": "xml",
    "binaryfile": "binaryFile",
    "jdbc": "jdbc",
    "avro": "avro",
    "delta": "delta",
    "iceberg": "iceberg",
}
WRITERS = {k: v for k, v in READERS.items() if k != "binaryfile"}
MODES = {"error": "errorifexists", "errorifexists": "errorifexists", "overwrite": "overwrite", "append": "append", "ignore": "ignore"}


def option(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def format_name(name: str, known: dict[str, str]) -> str:
    if str(name).lower() not in known:
        raise PipelineError(FORMAT, f'unknown format "{name}"')
    return known[str(name).lower()]


def options_of(kind: str, options: dict[str, Any] | None, reading: bool) -> dict[str, str]:
    """Text options for Spark. CSV: no header unless told, types inferred unless told (or given a schema)."""
    out = {k: option(v) for k, v in (options or {}).items()}
    if kind == "csv":
        out.setdefault("header", "false" if reading else "true")
        if reading and "schema" not in out:
            out.setdefault("inferSchema", "true")
    return out


def read_input(spark: SparkSession, format: str, path: str, options: dict[str, Any] | None = None) -> DataFrame:
    """A lazy frame; Parquet reads only the columns and row groups that the rest of the pipeline asks for.

    The option ``schema`` gives the columns as DDL, which spares CSV and JSON the pass that infers them.
    """
    kind = format_name(format, READERS)
    given = options_of(kind, options, True)
    reader = spark.read.format(kind)
    if schema := given.pop("schema", None):
        reader = reader.schema(schema)
    try:
        return reader.options(**given).load() if kind == "jdbc" else reader.options(**given).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise PipelineError(IO, f"no such path: {path}") from e
        raise


def write_output(df: DataFrame, format: str, path: str, mode: str = "error", options: dict[str, Any] | None = None) -> None:
    """Writes as Spark does, one file a partition. ``partitionBy`` among the options lists columns, comma-separated."""
    kind = format_name(format, WRITERS)
    if str(mode).lower() not in MODES:
        raise PipelineError(BAD_PARAMETER, f'unknown write mode "{mode}"')
    low = [c.lower() for c in df.columns]
    if twice := sorted({c for c in low if low.count(c) > 1}):
        raise PipelineError(BAD_PARAMETER, f"columns that occur twice can't be written: {', '.join(twice)}")
    given = options_of(kind, options, False)
    writer = df.write.format(kind).mode(MODES[str(mode).lower()])
    if by := given.pop("partitionBy", None):
        writer = writer.partitionBy(*[c.strip() for c in by.split(",")])
    try:
        writer.options(**given).save(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_ALREADY_EXISTS", "TABLE_OR_VIEW_ALREADY_EXISTS"):
            raise PipelineError(IO, f"{path} exists") from e
        raise


def coerced(value: str) -> Any:
    """Text options as booleans and numbers where they are written so."""
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def inspect(spark: SparkSession, format: str, path: str, options: dict[str, str] | None = None) -> dict[str, Any]:
    """Fields (name, type, nullable) and the number of rows."""
    df = read_input(spark, format, path, {k: coerced(v) if isinstance(v, str) and k != "schema" else v for k, v in (options or {}).items()})
    return {
        "fields": [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema.fields],
        "rows": df.count(),
    }
