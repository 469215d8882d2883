"""An extension: the same operators on Structured Streaming frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import BAD_PARAMETER, PipelineError
from ..functions.expressions import expr, identifier
from ..operators import Context, plan

#: Operators that look at one row at a time, or join a stream with a table.
STATELESS = (
    "select",
    "where",
    "addColumns",
    "dropColumns",
    "renameColumns",
    "castColumns",
    "schemaEnforce",
    "conditional",
    "flatten",
    "parse",
    "fillNa",
    "dropNa",
    "replace",
    "union",
    "unpivot",
    "custom",
    "join",
    "hint",
    "sql",
)


def read_stream(spark: SparkSession, format: str, schema: str, path: str | None = None, options: dict[str, Any] | None = None) -> DataFrame:
    reader = spark.readStream.format(format).schema(schema).options(**{k: str(v) for k, v in (options or {}).items()})
    return reader.load(path) if path else reader.load()


def plan_stream(steps: list[tuple[str, dict]], df: DataFrame, name: str = "stream", **tables: DataFrame) -> DataFrame:
    """Applies operators one after another; tables are static sides of joins and unions."""
    context = Context(df.sparkSession)
    for kind, parameters in steps:
        if kind not in STATELESS:
            raise PipelineError(BAD_PARAMETER, f"{kind} keeps rows back; streams take {', '.join(STATELESS)}")
        df = plan(kind, parameters, {name: df, **tables}, context)
    return df


def windowed(
    df: DataFrame,
    time: str,
    agg: list[str],
    size: str,
    slide: str | None = None,
    by: list[str] = (),
    late: str = "0 seconds",
    session: bool = False,
) -> DataFrame:
    """Aggregates over tumbling, sliding or session windows; rows later than ``late`` are left out."""
    window = F.session_window(time, size) if session else F.window(time, size, slide)
    out = df.withWatermark(time, late).groupBy(window.alias("window"), *[identifier(c) for c in by]).agg(*[expr(a) for a in agg])
    return out.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *[identifier(c) for c in out.columns if c != "window"],
    )


def deduplicated(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; keys are remembered for ``late``."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def write_stream(
    df: DataFrame,
    format: str,
    checkpoint: str,
    path: str | None = None,
    mode: str = "append",
    once: bool = True,
    options: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Starts the query; ``once`` takes what there is and ends."""
    writer = df.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).options(**(options or {}))
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start(path) if path else writer.start()
