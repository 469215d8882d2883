"""Shell commands before and after a run."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable

from ..errors import HOOK, PipelineError


def run_hook(command: str, status: str, file: str) -> None:
    env = os.environ | {"PIPELINE_STATUS": status, "PIPELINE_FILE": file}
    done = subprocess.run(["sh", "-c", command], env=env, capture_output=True, text=True)
    if done.returncode:
        raise PipelineError(HOOK, f"{command!r} ended with {done.returncode}: {done.stderr.strip()[-200:]}")


def before(hooks: dict[str, list[str]], file: str = "") -> None:
    """The first that fails ends the run before anything is read."""
    for h in hooks.get("pre") or hooks.get("pre_execution") or []:
        run_hook(h, "pre", file)


def after(hooks: dict[str, list[str]], succeeded: bool, log: Callable[[str], None], file: str = "") -> None:
    """All of them run, whatever the run's end; failures are logged."""
    for h in hooks.get("post") or hooks.get("post_execution") or []:
        try:
            run_hook(h, "completed" if succeeded else "failed", file)
        except PipelineError as e:
            log(str(e))
