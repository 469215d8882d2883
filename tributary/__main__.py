"""python -m tributary run FILE [NAME=VALUE...] | validate FILE | explain FILE | serve [--host --port --workers --hooks --origin]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import PipelineError
from .plans.executor import etl, validate
from .plans.explain import explain
from .plans.jobs import JobStore, serve
from .plans.parser import parse


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tributary", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("run", "validate", "explain"):
        c = commands.add_parser(name)
        c.add_argument("file")
        c.add_argument("variables", nargs="*", metavar="NAME=VALUE")
    c = commands.add_parser("serve")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8080)
    c.add_argument("--workers", type=int, default=None, help="jobs that run at the same time; one a processor unless told")
    c.add_argument("--hooks", action="store_true", help="take documents with shell commands (not taken unless told)")
    c.add_argument("--origin", default=None, help="the web origin whose pages may call")
    return p.parse_args(given)


def main(given: list[str] | None = None) -> int:
    a = arguments(given)
    if a.command == "serve":
        store = JobStore(SparkSession.builder.getOrCreate(), a.workers)
        server = serve(store, a.host, a.port, hooks=a.hooks, origin=a.origin)
        print(f"http://{a.host}:{server.server_port}", flush=True)
        try:
            server.serve_forever()
        finally:
            store.close()
        return 0
    with open(a.file) as f:
        text = f.read()
    variables = dict(v.split("=", 1) for v in a.variables)
    try:
        if a.command == "validate":
            found = validate(text, variables)
            print("valid" if found["valid"] else found["error"])
            return 0 if found["valid"] else 1
        if a.command == "explain":
            print(explain(parse(text, variables)))
            return 0
        run = etl(SparkSession.builder.getOrCreate(), text, variables, file=a.file)
    except PipelineError as e:
        print(e, file=sys.stderr)
        return 1
    return 1 if run.quality and run.quality.has_errors else 0


if __name__ == "__main__":
    sys.exit(main())
