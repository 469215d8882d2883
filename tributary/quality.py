"""Quality suites: checks of assets after a run, one aggregation for all checks of a suite that need no join."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.expressions import expr, identifier

STATISTICS = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "stdev": F.stddev, "stddev": F.stddev}
UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


@dataclass(frozen=True)
class CheckResult:
    suite: str
    check_type: str
    passed: bool
    severity: str
    message: str
    metric: float | None = None


@dataclass
class QualityReport:
    results: list[CheckResult] = field(default_factory=list)

    @property
    def has_errors(self) -> bool:
        return any(not r.passed and r.severity == "error" for r in self.results)


def within(value: float | None, bound: Any) -> bool:
    """min, max and an inclusive between, all of them; a plain number is a minimum."""
    if value is None:
        return False
    bound = bound if isinstance(bound, dict) else {"min": bound}
    low, high = bound.get("between") or (None, None)
    return all(
        [
            bound.get("min") is None or value >= bound["min"],
            bound.get("max") is None or value <= bound["max"],
            low is None or low <= value <= high,
        ]
    )


def age(text: str | float) -> timedelta:
    """``36h``, ``7d`` or seconds."""
    if m := re.fullmatch(r"\s*([0-9.]+)\s*([smhdw])[a-z]*\s*", str(text)):
        return timedelta(**{UNITS[m[2]]: float(m[1])})
    return timedelta(seconds=float(text))


def ratio(good: Column) -> Column:
    """The share of rows, 1 for an empty table."""
    return F.when(F.count("*") == 0, F.lit(1.0)).otherwise(F.count_if(good) / F.count("*"))


def valid(check: dict) -> Column:
    """Null values are invalid; without any condition all are valid."""
    c, conditions = F.col(identifier(check["column"])), []
    if check.get("accepted_values") is not None:
        conditions.append(c.cast("string").isin([str(v) for v in check["accepted_values"]]))
    if r := check.get("range"):
        if r.get("min") is not None:
            conditions.append(c > r["min"] if r.get("strict_min") else c >= r["min"])
        if r.get("max") is not None:
            conditions.append(c < r["max"] if r.get("strict_max") else c <= r["max"])
    if check.get("pattern") is not None:
        conditions.append(c.like(check["pattern"]))
    if not conditions:
        return F.lit(True)
    out = c.isNotNull()
    for k in conditions:
        out = out & k
    return out


def metrics(check: dict) -> list[Column]:
    """What the check needs of its table, as aggregates."""
    kind = check["type"]
    if kind == "completeness":
        return [ratio(F.col(identifier(check["column"])).isNotNull())]
    if kind == "uniqueness":
        columns = check.get("columns") or [check["column"]]
        return [
            F.when(F.count("*") == 0, F.lit(1.0)).otherwise(
                F.count_distinct(F.struct(*[identifier(c) for c in columns])) / F.count("*")
            )
        ]
    if kind == "volume":
        return [F.count("*")]
    if kind == "validity":
        return [ratio(valid(check))]
    if kind == "statistical":
        return [STATISTICS[s](F.col(identifier(check["column"]))).cast("double") for s in STATISTICS if s in check]
    if kind == "freshness":
        return [F.unix_micros(F.max(F.col(identifier(check["column"]))).cast("timestamp"))]  # a point in time, whatever the zones
    if kind in ("cross_column", "crossColumn", "custom"):
        return [ratio(expr(check.get("condition") or check["expression"]))]
    return []


def judged(suite: str, check: dict, values: list, frames: dict[str, DataFrame], df: DataFrame, now: datetime) -> CheckResult:
    kind, metric, message = check["type"], None, ""
    least = float(check.get("threshold", 1.0))
    if kind == "schema":
        required = check.get("required") or check.get("columns") or []
        missing = [c for c in required if c not in df.columns]
        passed, message = not missing, f"missing columns: {', '.join(missing)}" if missing else "all columns are there"
    elif kind == "referential":
        target = frames[check["reference"]] if "reference" in check else frames[check["ref_asset"]]
        key = target.select(F.col(identifier(check["ref_column"])).alias("__ref")).where("__ref IS NOT NULL").distinct()
        met = df.select(F.col(identifier(check["column"])).alias("__key")).join(key, F.col("__key") == F.col("__ref"), "left")
        metric = met.agg(ratio(F.col("__ref").isNotNull())).first()[0]
        passed, message = metric >= least, f"{metric:.4f} matched, {least} needed"
    elif kind == "volume":
        metric = float(values[0])
        passed, message = within(metric, {k: check[k] for k in ("min", "max", "between") if k in check}), f"{values[0]} rows"
    elif kind == "statistical":
        names = [s for s in STATISTICS if s in check]
        out = [s for s, v in zip(names, values, strict=True) if not within(v, check[s])]
        metric = values[0] if values else None
        passed, message = not out, ", ".join(f"{s} = {v}" for s, v in zip(names, values, strict=True))
    elif kind == "freshness":
        last = values[0]
        if last is None:
            passed, message = False, "no value"
        else:
            last = datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=last)
            old = (now if now.tzinfo else now.replace(tzinfo=timezone.utc)) - last
            metric = old.total_seconds()
            passed, message = check.get("max_age") is None or old <= age(check["max_age"]), f"last value {last}"
    elif kind in ("completeness", "uniqueness", "validity", "cross_column", "crossColumn", "custom"):
        metric = float(values[0])
        passed, message = metric >= least, f"{metric:.4f}, {least} needed"
    else:
        raise ValueError(f"unknown check {kind}")
    return CheckResult(suite, kind, bool(passed), str(check.get("severity") or "error").lower(), message, metric)


def run_suites(suites: list[dict], frames: dict[str, DataFrame], now: datetime | None = None) -> QualityReport:
    """Results in the order of suites and checks; a check that can't be run is a failed one. ``now`` without a zone is UTC;
    dates and times without one are read in the session's.

    A suite: {suite, target, filter?, checks[], escalate?}. ``escalate: n`` turns warnings into errors if n checks fail.
    """
    now, report = now or datetime.now(timezone.utc), QualityReport()
    for s in suites:
        name, checks = s.get("suite") or s.get("name") or s["target"], s.get("checks") or []
        try:
            df = frames[s["target"]]
            if s.get("filter"):
                df = df.where(expr(s["filter"]))
        except Exception as e:
            report.results += [CheckResult(name, c["type"], False, "error", str(e)[:300]) for c in checks]
            continue
        slots: list[list[Column] | str] = []
        for c in checks:
            try:
                wanted = metrics(c)
                if wanted:
                    df.agg(*wanted)  # analysed alone: a wrong column fails its own check only
                slots.append(wanted)
            except Exception as e:
                slots.append(str(e)[:300])
        flat = [m for x in slots if isinstance(x, list) for m in x]
        try:
            row = list(df.agg(*[m.alias(f"m{k}") for k, m in enumerate(flat)]).first()) if flat else []
        except Exception as e:
            report.results += [CheckResult(name, c["type"], False, "error", str(e)[:300]) for c in checks]
            continue
        found = []
        for c, x in zip(checks, slots, strict=True):
            if isinstance(x, str):
                found.append(CheckResult(name, c["type"], False, "error", x))
                continue
            values, row = row[: len(x)], row[len(x) :]
            try:
                found.append(judged(name, c, values, frames, df, now))
            except Exception as e:
                found.append(CheckResult(name, c["type"], False, "error", str(e)[:300]))
        if s.get("escalate") and sum(not r.passed for r in found) >= int(s["escalate"]):
            found = [CheckResult(r.suite, r.check_type, r.passed, "error", r.message, r.metric) for r in found]
        report.results += found
    return report
