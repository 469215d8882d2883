"""Running a pipeline.

Every asset becomes one lazy frame; the outputs' writes are the jobs. Outputs of a wave are written at the same time, each
under a tag of its own by which it can be cancelled. A frame that two outputs need is kept (memory, then disk) until the
run ends, so that it is computed once; a frame read by one output only is never stored.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..errors import IO, PipelineError
from ..operators import Context, plan
from ..quality import QualityReport, run_suites
from ..sources import read_input, write_output
from . import hooks
from .dag import waves
from .model import Pipeline
from .parser import parse

LOG = logging.getLogger("tributary")


@dataclass
class Run:
    frames: dict[str, DataFrame] = field(default_factory=dict)
    written: list[str] = field(default_factory=list)
    quality: QualityReport | None = None


def sinks_of(pipeline: Pipeline) -> dict[str, set[str]]:
    """The outputs that need each asset."""
    need: dict[str, set[str]] = {n: set() for n in pipeline.assets}
    for wave in reversed(waves(pipeline)):
        for n in wave:
            a = pipeline.assets[n]
            for d in a.depends:
                need[d] |= {n} if a.kind == "output" else need[n]
    return need


def shared(pipeline: Pipeline) -> set[str]:
    """Assets worth keeping: needed by several outputs, and read directly by several assets or outputs."""
    need, readers = sinks_of(pipeline), {n: 0 for n in pipeline.assets}
    for a in pipeline.assets.values():
        for d in a.depends:
            readers[d] += 1
    return {n for n, a in pipeline.assets.items() if a.kind not in ("input", "output") and len(need[n]) > 1 and readers[n] > 1}


def planned(spark: SparkSession, pipeline: Pipeline, context: Context, keep: set[str] = frozenset()) -> dict[str, DataFrame]:
    """The frames of all assets but the outputs. Assertions, pivots without values, tail and crosstab look at data here."""
    frames: dict[str, DataFrame] = {}
    for wave in waves(pipeline):
        for name in wave:
            a = pipeline.assets[name]
            if a.kind == "input":
                frames[name] = read_input(spark, a.parameters["format"], a.parameters["path"], a.parameters.get("options"))
            elif a.kind != "output":
                frames[name] = plan(a.kind, a.parameters, {d: frames[d] for d in a.depends}, context)
                if name in keep:
                    frames[name] = frames[name].persist(StorageLevel.MEMORY_AND_DISK)
    return frames


def overwritten_inputs(pipeline: Pipeline) -> None:
    read = {a.parameters["path"].rstrip("/") for a in pipeline.assets.values() if a.kind == "input"}
    for a in pipeline.assets.values():
        if a.kind == "output" and str(a.parameters.get("mode")).lower() == "overwrite" and a.parameters["path"].rstrip("/") in read:
            raise PipelineError(IO, f"{a.parameters['path']} would be overwritten while it is read")


def execute(
    spark: SparkSession,
    pipeline: Pipeline,
    file: str = "",
    now: datetime | None = None,
    tag: str | None = None,
    writers: int = 4,
    log: Callable[[str], None] = LOG.warning,
) -> Run:
    """Runs hooks, outputs and quality suites. ``tag``: spark.interruptTag(tag) cancels the run's jobs."""
    overwritten_inputs(pipeline)
    hooks.before(pipeline.hooks, file)
    run, done, keep = Run(), False, shared(pipeline)
    tag = tag or f"run-{uuid.uuid4()}"
    try:
        spark.addTag(tag)
        run.frames = planned(spark, pipeline, Context(spark, now, log), keep)
        outputs = [a for a in pipeline.assets.values() if a.kind == "output"]

        def write(a) -> str:
            spark.addTag(tag)
            p = a.parameters
            write_output(run.frames[p["from"]], p["format"], p["path"], p.get("mode") or "error", p.get("options"))
            return a.name

        if len(outputs) == 1:
            run.written = [write(outputs[0])]
        else:
            with ThreadPoolExecutor(max_workers=writers) as pool:
                run.written = list(pool.map(write, outputs))
        if pipeline.quality:
            run.quality = run_suites(pipeline.quality, run.frames, now=now)
        done = True
        return run
    finally:
        for name in keep & run.frames.keys():
            run.frames[name].unpersist()
        spark.removeTag(tag)
        hooks.after(pipeline.hooks, done, log, file)


def etl(spark: SparkSession, text: str, variables: dict[str, str] | None = None, **how) -> Run:
    """Parses and runs a document."""
    return execute(spark, parse(text, variables), **how)


def validate(text: str, variables: dict[str, str] | None = None) -> dict:
    """{valid, error?}"""
    try:
        parse(text, variables)
    except PipelineError as e:
        return {"valid": False, "error": str(e)}
    return {"valid": True}
