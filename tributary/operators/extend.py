"""SQL over assets, registered components, enrichment over HTTP."""

from __future__ import annotations

import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BAD_PARAMETER, COMPONENT, ENRICH, PipelineError
from ..functions.expressions import identifier, normalised
from .registry import known, only, operator

COMPONENTS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def register_component(name: str, f: Callable[[DataFrame, dict], DataFrame]) -> None:
    """Makes ``f(df, options)`` available to the custom operator."""
    COMPONENTS[name] = f


VIEWS = threading.Lock()


@operator("sql", "query", "views", sources=lambda p: list(p.get("views") or []))
def sql(ctx, p, inputs) -> DataFrame:
    """A query over the listed assets by their names; double quotes hold names.

    The names are views only while the query is analysed, one query at a time; a view of the session's own that has the
    same name is put back afterwards.
    """
    spark = ctx.spark
    with VIEWS:
        own = {n: spark.table(identifier(n)) for n in inputs if spark.catalog.tableExists(n) and spark.catalog.getTable(n).isTemporary}
        try:
            for name, df in inputs.items():
                df.createOrReplaceTempView(identifier(name))
            return spark.sql(normalised(p["query"]))
        finally:
            for name in inputs:
                spark.catalog.dropTempView(name)
            for name, df in own.items():
                df.createOrReplaceTempView(identifier(name))


@operator("custom", "from component", "options")
def custom(ctx, p, inputs) -> DataFrame:
    if p["component"] not in COMPONENTS:
        raise PipelineError(COMPONENT, f'no component "{p["component"]}"')
    return COMPONENTS[p["component"]](only(inputs), p.get("options") or {})


def fetched(url: str, method: str, headers: dict, timeout: float, retries: int) -> str:
    """The response's body. Server errors and lost connections are tried again after 100, 200, 400 ... ms; others not."""
    for attempt in range(retries + 1):
        try:
            request = urllib.request.Request(url, method=method, headers=headers)
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt == retries:
                raise
        except OSError:
            if attempt == retries:
                raise
        time.sleep(0.1 * 2**attempt)
    raise AssertionError


@operator("enrich", "from url key_column response_column", "method headers timeout max_retries on_error parallel")
def enrich(ctx, p, inputs) -> DataFrame:
    """The body of a request for each distinct key, joined back; ``${keyColumn}`` in the url is the key.

    Requests run on the executors, one partition after another key by key; a key that fails fails the run, gives null or
    drops its rows (on_error fail, null, skip). Rows with a null key stay, with a null response.
    """
    df, mode = only(inputs), str(p.get("on_error") or "fail").lower()
    if mode not in ("fail", "null", "skip"):
        raise PipelineError(BAD_PARAMETER, f"enrich: {mode}")
    key = identifier(known(df, [p["key_column"]], "enrich")[0])
    url, method, headers = p["url"], str(p.get("method") or "GET").upper(), dict(p.get("headers") or {})
    timeout, retries, name = float(p.get("timeout") or 30_000) / 1000, int(p.get("max_retries") or 0), p["key_column"]

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bodies, failed = [], []
            for k in frame["__key"]:
                place = url.replace("${keyColumn}", urllib.parse.quote(k, safe="")).replace(
                    "${" + name + "}",
                    urllib.parse.quote(k, safe=""),
                )
                try:
                    bodies.append(fetched(place, method, headers, timeout, retries))
                    failed.append(False)
                except (OSError, urllib.error.HTTPError) as e:
                    if mode == "fail":
                        raise RuntimeError(f"{ENRICH}: {place}: {e}") from e
                    bodies.append(None)
                    failed.append(True)
            yield pd.DataFrame({"__key": frame["__key"], "__body": pd.Series(bodies, dtype=object), "__failed": failed})

    keys = df.select(
        F.col(key).cast("string").alias("__key")
    ).where("__key IS NOT NULL").distinct().repartition(int(p.get("parallel") or 8), "__key")
    found = keys.mapInPandas(ask, "__key string, __body string, __failed boolean")
    out = df.join(found, F.col(key).cast("string") == F.col("__key"), "left")
    if mode == "skip":
        out = out.where("NOT coalesce(__failed, false)")
    return out.select(*[F.col(identifier(c)) for c in df.columns if c != p["response_column"]], F.col("__body").alias(p["response_column"]))
