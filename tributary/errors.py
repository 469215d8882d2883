"""Errors with the codes that a pipeline's user sees."""

from __future__ import annotations


class PipelineError(Exception):
    """A failure with a code such as ``V-001``; its text begins with the code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


UNKNOWN_ASSET, DUPLICATE_ASSET, UNKNOWN_OPERATOR, BAD_PARAMETER = "V-001", "V-002", "V-003", "V-004"
CYCLE, FORMAT, IO, QUALITY, COMPONENT, HOOK, ENRICH = "E-CYCLE-001", "E-FMT-001", "E-IO-002", "E-QUALITY-001", "E-COMP-001", "E-HOOK-001", "E-ENRICH-001"
