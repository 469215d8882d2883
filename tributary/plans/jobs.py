"""Jobs: runs of documents in the background, and an HTTP face for them."""

from __future__ import annotations

import json
import os
import re
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from ..errors import HOOK, PipelineError
from ..sources import inspect
from .executor import etl, validate
from .explain import explain
from .parser import parse

QUEUED, RUNNING, COMPLETED, FAILED, CANCELLED = "queued", "running", "completed", "failed", "cancelled"
ENDED = (COMPLETED, FAILED, CANCELLED)


@dataclass
class Job:
    text: str
    variables: dict[str, str]
    hooks: bool = True
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    status: str = QUEUED
    error: str | None = None
    submitted: float = field(default_factory=time.time)
    started: float | None = None
    ended: float | None = None

    def view(self) -> dict:
        took = None if self.started is None else int(1000 * ((self.ended or time.time()) - self.started))
        return {"id": self.id, "status": self.status, "error": self.error, "duration_ms": took}


class JobStore:
    """Queued, running, then completed, failed or cancelled. Kept in memory: a restart forgets jobs."""

    def __init__(self, spark: SparkSession, workers: int | None = None):
        self.spark, self.jobs, self.change = spark, {}, threading.Condition()
        self.pool = ThreadPoolExecutor(max_workers=workers or os.cpu_count())

    def submit(self, text: str, variables: dict[str, str] | None = None, hooks: bool = True) -> Job:
        """Checks the document first; one that isn't valid raises and makes no job, nor does one with hooks if ``hooks`` is
        false: these are shell commands."""
        if parse(text, variables).hooks and not hooks:
            raise PipelineError(HOOK, "documents with hooks are not taken here")
        job = Job(text, variables or {}, hooks)
        with self.change:
            self.jobs[job.id] = job
        self.pool.submit(self.run, job)
        return job

    def to(self, job: Job, status: str, error: str | None = None) -> bool:
        with self.change:
            if job.status in ENDED:
                return False
            job.status, job.error = status, error
            job.started = time.time() if status == RUNNING else job.started
            job.ended = time.time() if status in ENDED else None
            self.change.notify_all()
            return True

    def run(self, job: Job) -> None:
        if not self.to(job, RUNNING):
            return
        try:
            etl(self.spark, job.text, job.variables, tag=f"job-{job.id}")
        except Exception as e:  # whatever ends a job is its result
            self.to(job, FAILED, str(e)[:2000])
        else:
            self.to(job, COMPLETED)

    def cancel(self, id: str) -> Job:
        """A queued job never starts; a running one's Spark jobs are interrupted."""
        job = self.jobs[id]
        if self.to(job, CANCELLED):
            self.spark.interruptTag(f"job-{id}")
        return job

    def wait(self, id: str, timeout: float = 300) -> Job:
        """The job when it has ended, or as it is after the timeout."""
        job = self.jobs[id]
        with self.change:
            self.change.wait_for(lambda: job.status in ENDED, timeout)
        return job

    def close(self) -> None:
        self.pool.shutdown(wait=True, cancel_futures=True)


def serve(
    store: JobStore,
    host: str = "127.0.0.1",
    port: int = 0,
    version: str = "1",
    hooks: bool | None = None,
    origin: str | None = None,
) -> ThreadingHTTPServer:
    """An HTTP server (call serve_forever): /api/health, validate, explain, inspect, jobs, jobs/{id}, jobs/{id}/wait.

    hooks: take documents that hold shell commands; unless told, only where the port can be reached from this machine alone. origin: the one web origin whose pages may
    read answers; requests that name another are refused, so that a page a browser happens to show can't start jobs.
    """

    hooks = host in ("127.0.0.1", "::1", "localhost") if hooks is None else hooks

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body) -> None:
            raw = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            if origin:
                self.send_header("Access-Control-Allow-Origin", origin)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def handle_one(self, method: str) -> None:
            url = urlsplit(self.path)
            size = int(self.headers.get("Content-Length") or 0)
            if self.headers.get("Origin") not in (None, origin):
                self.rfile.read(size)
                return self.answer(403, {"error": "other origin"})
            try:
                body = json.loads(self.rfile.read(size)) if size else {}
                self.answer(*self.routed(method, url.path.rstrip("/"), parse_qs(url.query), body))
            except KeyError:
                self.answer(404, {"error": "not found"})
            except (PipelineError, ValueError) as e:
                self.answer(400, {"error": str(e)})

        def routed(self, method: str, path: str, query: dict, body: dict):
            text, variables = body.get("yaml", ""), body.get("variables") or {}
            if (method, path) == ("GET", "/api/health"):
                return 200, {"status": "ok", "version": version}
            if (method, path) == ("POST", "/api/validate"):
                return 200, validate(text, variables)
            if (method, path) == ("POST", "/api/explain"):
                return 200, {"plan": explain(parse(text, variables))}
            if (method, path) == ("POST", "/api/inspect"):
                return 200, inspect(store.spark, body.get("format", ""), body.get("path", ""), body.get("options"))
            if (method, path) == ("POST", "/api/jobs"):
                return 202, store.submit(text, variables, hooks).view()
            if (method, path) == ("GET", "/api/jobs"):
                return 200, [j.view() for j in store.jobs.values()]
            if m := re.fullmatch(r"/api/jobs/([^/]+)(/wait)?", path):
                if method == "GET" and m[2]:
                    return 200, store.wait(m[1], float(query.get("timeout", ["300"])[0])).view()
                if method == "GET":
                    return 200, store.jobs[m[1]].view()
                if method == "DELETE" and not m[2]:
                    return 200, store.cancel(m[1]).view()
            raise KeyError(path)

        def do_GET(self) -> None:
            self.handle_one("GET")

        def do_POST(self) -> None:
            self.handle_one("POST")

        def do_DELETE(self) -> None:
            self.handle_one("DELETE")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
