"""Documents, order of assets, plan text, hooks, runs, jobs, files, quality, streams."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from datetime import datetime
from threading import Thread

import pytest

from tributary.errors import PipelineError
from tributary.plans import hooks
from tributary.plans.dag import order, waves
from tributary.plans.executor import etl, planned, shared, validate
from tributary.plans.explain import explain
from tributary.plans.jobs import CANCELLED, COMPLETED, FAILED, JobStore, serve
from tributary.plans.model import Asset, Pipeline
from tributary.plans.parser import parse
from tributary.quality import run_suites
from tributary.sources import inspect, read_input, write_output
from tributary.streaming import deduplicated, plan_stream, read_stream, windowed, write_stream

#: A harbour master's list: name, harbour and length of each boat.
FLEET = [("Petrel", "north", 31), ("Osprey", "south", 18), ("Gannet", "north", 44), ("Dunlin", "quay", 12), ("Curlew", "south", 27), ("Avocet", "north", 9), ("Plover", "quay", 53),
         ("Fulmar", "south", 22), ("Merlin", "east", 36), ("Kittiwake", "north", 15), ("Shearwater", "quay", 48), ("Tern", "south", 7), ("Skua", "quay", 29)]
HARBOURS = {"north": "Wick", "south": "Looe", "quay": "Cobh"}
BOATS = "id,name,harbour,length\n" + "".join(f"{k},{n},{h},{m}\n" for k, (n, h, m) in enumerate(FLEET, 101))
PLACES = "id,town\n" + "".join(f"{h},{t}\n" for h, t in HARBOURS.items())
LENGTHS = sorted((m for *_, m in FLEET), reverse=True)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    (d / "boats.csv").write_text(BOATS)
    (d / "places.csv").write_text(PLACES)
    return d


DOCUMENT = """
version: "2.0"
input:
  - {name: boats, format: csv, path: "${DIR}/boats.csv", options: {header: true}}
  - {name: places, format: csv, path: "${DIR}/places.csv", options: {header: "true"}}
transformation:
  - name: joined
    join:
      left: boats
      right:
        - name: places
          type: inner
          on: ["boats.harbour = places.id"]
  - name: by_place
    group: {from: joined, by: [town], agg: ["avg(length) AS mean", "count(*) AS n"]}
  - name: top
    addColumns: {from: boats, columns: [{name: fee, expression: "length * 2.5"}]}
  - name: sorted
    orderBy: {from: top, columns: [{column: length, direction: desc}]}
  - name: first
    limit: {from: sorted, count: 5}
output:
  - {name: by_place, format: parquet, path: "${DIR}/${OUT:out}/by_place", mode: overwrite}
  - {name: first, format: json, path: "${DIR}/${OUT:out}/first", mode: overwrite}
"""


def test_document_runs(spark, folder):
    run = etl(spark, DOCUMENT, {"DIR": str(folder)})
    assert run.written == ["output:0:by_place", "output:1:first"]
    assert {
        (r.town, r.n) for r in spark.read.parquet(f"{folder}/out/by_place").collect()
    } == {(t, sum(x == h for _, x, _ in FLEET)) for h, t in HARBOURS.items()}
    first = spark.read.json(f"{folder}/out/first")
    assert first.count() == 5 and sorted(r.fee for r in first.collect()) == sorted(2.5 * m for m in LENGTHS[:5])


def test_form_b_and_filter(spark, folder):
    text = f"""
pipeline: {{name: small}}
assets:
  - {{asset_ref: e, source: {{input: {{format: csv, path: "{folder}/boats.csv", options: {{header: true}}}}}}}}
  - {{asset_ref: rich, source: {{where: {{from: e, filter: "length > 28"}}}}}}
  - {{asset_ref: w, source: {{output: {{from: rich, format: csv, path: "{folder}/b", mode: overwrite}}}}}}
"""
    run = etl(spark, text)
    n = sum(m > 28 for m in LENGTHS)
    assert run.frames["rich"].count() == n
    assert read_input(spark, "csv", f"{folder}/b", {"header": True}).count() == n


def test_validation(folder):
    ok = DOCUMENT.replace("${DIR}", "x")
    assert validate(ok) == {"valid": True}
    bad = {
        "V-001": ok.replace("from: joined", "from: nobody"),
        "V-002": ok.replace("name: top", "name: joined"),
        "V-003": ok.replace("limit:", "limitt:"),
        "V-004": ok.replace("count: 5", "counts: 5"),
        "E-CYCLE-001": "transformation:\n - {name: a, where: {from: b, filter: x}}\n - {name: b, where: {from: a, filter: x}}",
    }
    for code, text in bad.items():
        found = validate(text)
        assert not found["valid"] and found["error"].startswith(code), found
    assert "DIR has no value" in validate(DOCUMENT)["error"]
    assert not validate("a: [")["valid"] and not validate("text")["valid"]


def diamond():
    a = lambda n, *d: Asset(n, "union", {}, d)
    return Pipeline({x.name: x for x in (a("d", "b", "c"), a("b", "a"), a("c", "a"), Asset("a", "input", {"format": "csv", "path": "p"}))})


def test_waves():
    assert [sorted(w) for w in waves(diamond())] == [["a"], ["b", "c"], ["d"]]
    assert order(diamond())[0] == "a" and order(diamond())[-1] == "d"


def test_explain():
    text = explain(parse(DOCUMENT.replace("${DIR}", "x")))
    for part in (
        "--- Inputs ---",
        "--- Transformations ---",
        "--- Outputs ---",
        "joined = JOIN <- boats, places (2 inputs)",
        "Execution waves: 5",
        "Total: 9 assets",
    ):
        assert part in text, text


def test_shared_assets():
    p = parse(
        "input: [{name: i, format: csv, path: p}]\ntransformation: [{name: a, where: {from: i, filter: x}}, {name: b, "
        "limit: {from: a, count: 1}}]\noutput: [{name: a, format: csv, path: q}, {name: b, format: csv, path: r}]"
    )
    assert shared(p) == {"a"}


def test_split_routes_nulls_to_the_fail_side(spark, tmp_path):
    spark.createDataFrame([(1,), (5,), (None,)], "v int").write.parquet(str(tmp_path / "t"))
    p = parse(
        f"input: [{{name: t, format: parquet, path: {tmp_path}/t}}]\ntransformation: [{{name: s, split: {{from: t, "
        f"condition: v > 2}}}}]"
    )
    from tributary.operators import Context

    frames = planned(spark, p, Context(spark))
    assert frames["s_pass"].count() == 1 and frames["s_fail"].count() == 2


def test_hooks(spark, folder, tmp_path):
    hooks.before({"pre": ["true"]})
    with pytest.raises(PipelineError, match="E-HOOK-001"):
        hooks.before({"pre": ["false"]})
    said = []
    hooks.after({"post": ["false", f'echo "$PIPELINE_STATUS" > {tmp_path}/status']}, True, said.append)
    assert len(said) == 1 and (tmp_path / "status").read_text() == "completed\n"
    text = DOCUMENT.replace("${OUT:out}", "never") + 'hooks: {pre: ["exit 3"]}\n'
    with pytest.raises(PipelineError, match="E-HOOK-001"):
        etl(spark, text, {"DIR": str(folder)})
    assert not (folder / "never").exists()


def test_files(spark, folder, tmp_path):
    df = read_input(spark, "csv", f"{folder}/boats.csv", {"header": True})
    assert df.columns == ["id", "name", "harbour", "length"] and dict(df.dtypes)["length"] == "int"
    assert read_input(spark, "csv", f"{folder}/boats.csv").count() == len(FLEET) + 1
    for kind in ("parquet", "json", "ndjson", "orc", "csv"):
        write_output(df, kind, f"{tmp_path}/{kind}")
        assert read_input(spark, kind, f"{tmp_path}/{kind}", {"header": True} if kind == "csv" else None).count() == len(FLEET)
    with pytest.raises(PipelineError, match="E-IO-002"):
        write_output(df, "parquet", f"{tmp_path}/parquet")
    write_output(df, "parquet", f"{tmp_path}/parquet", "ignore")
    write_output(df, "parquet", f"{tmp_path}/parquet", "append")
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 2 * len(FLEET)
    for bad in (lambda: read_input(spark, "xls", "p"), lambda: write_output(df, "xls", "p")):
        with pytest.raises(PipelineError, match="E-FMT-001"):
            bad()
    with pytest.raises(PipelineError, match="occur twice"):
        write_output(df.join(df, "id"), "parquet", f"{tmp_path}/twice")
    with pytest.raises(PipelineError, match="E-IO-002"):
        read_input(spark, "parquet", f"{tmp_path}/nothing")
    found = inspect(spark, "csv", f"{folder}/boats.csv", {"header": "true"})
    assert found["rows"] == len(FLEET) and found["fields"][0] == {"name": "id", "type": "int", "nullable": True}


def test_other_origins_and_hooks_from_outside_are_refused(spark, folder):
    store = JobStore(spark, workers=1)
    for options, origin, code in (
        (({}), "http://evil.test", 403),
        ({"origin": "http://own.test"}, "http://own.test", 202),
        ({"hooks": False}, None, 400),
        ({}, None, 202),
    ):
        server = serve(store, **options)
        Thread(target=server.serve_forever, daemon=True).start()
        body = json.dumps({"yaml": DOCUMENT + 'hooks: {pre: ["true"]}\n', "variables": {"DIR": str(folder), "OUT": "origins"}}).encode()
        request = urllib.request.Request(
            f"http://127.0.0.1:{server.server_port}/api/jobs",
            body,
            {"Origin": origin} if origin else {},
            method="POST",
        )
        try:
            with urllib.request.urlopen(request) as a:
                assert (a.status, a.headers["Access-Control-Allow-Origin"]) == (code, options.get("origin"))
                store.wait(json.loads(a.read())["id"])
        except urllib.error.HTTPError as e:
            assert e.code == code
        server.shutdown()
    with pytest.raises(PipelineError, match="E-HOOK-001"):
        store.submit('hooks: {pre: ["true"]}\n' + DOCUMENT, {"DIR": "x"}, hooks=False)


def test_command_line(spark, folder, tmp_path, capsys):
    from tributary.__main__ import arguments, main

    file = tmp_path / "doc.yaml"
    file.write_text(DOCUMENT)
    assert main(["validate", str(file), f"DIR={folder}"]) == 0 and main(["validate", str(file)]) == 1
    assert main(["explain", str(file), f"DIR={folder}"]) == 0 and "joined = JOIN" in capsys.readouterr().out
    assert main(["run", str(file), f"DIR={folder}", "OUT=cli"]) == 0 and spark.read.json(f"{folder}/cli/first").count() == 5
    assert main(["run", str(file), "DIR=/nowhere"]) == 1
    a = arguments(["serve", "--port", "0", "--workers", "3"])
    assert (a.host, a.port, a.workers, a.hooks) == ("127.0.0.1", 0, 3, False)


def test_freshness_compares_points_in_time(spark):
    df = spark.sql(
        "SELECT timestamp '2024-01-01 12:00:00+05:00' AS at, timestamp_ntz '2024-01-01 07:00:00' AS plain, date "
        "'2024-01-01' AS day, '2024-01-01 07:00:00' AS text"
    )
    checks = lambda age: [{"type": "freshness", "column": c, "max_age": age} for c in ("at", "plain", "text")]
    for now in (datetime(2024, 1, 1, 8), datetime.fromisoformat("2024-01-01T13:00:00+05:00")):
        for age, good in (("1h", True), ("59m", False)):
            found = run_suites([{"suite": "s", "target": "t", "checks": checks(age)}], {"t": df}, now).results
            assert [r.passed for r in found] == [good] * 3 and found[0].metric == 3600.0


def test_overwriting_an_input_is_refused(spark, folder):
    text = (
        f"input: [{{name: t, format: csv, path: {folder}/boats.csv}}]\noutput: [{{name: t, format: csv, path: "
        f"{folder}/boats.csv, mode: overwrite}}]"
    )
    with pytest.raises(PipelineError, match="overwritten while it is read"):
        etl(spark, text)


def test_jobs_over_http(spark, folder):
    store = JobStore(spark, workers=1)
    server = serve(store)
    Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        r = urllib.request.Request(
            f"http://127.0.0.1:{server.server_port}{path}",
            json.dumps(body).encode() if body is not None else None,
            method=method,
        )
        try:
            with urllib.request.urlopen(r) as a:
                return a.status, json.loads(a.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    body = {"yaml": DOCUMENT, "variables": {"DIR": str(folder), "OUT": "jobs"}}
    assert call("GET", "/api/health")[1]["status"] == "ok"
    assert call("POST", "/api/validate", body) == (200, {"valid": True})
    assert "JOIN" in call("POST", "/api/explain", body)[1]["plan"]
    assert call("POST", "/api/explain", {"yaml": "x"})[0] == 400
    assert call(
        "POST",
        "/api/inspect",
        {"format": "csv", "path": f"{folder}/boats.csv", "options": {"header": "true"}},
    )[1]["rows"] == len(FLEET)
    code, job = call("POST", "/api/jobs", body)
    assert code == 202 and call("GET", f"/api/jobs/{job['id']}/wait?timeout=60")[1]["status"] == COMPLETED
    failing = {"yaml": DOCUMENT.replace("boats.csv", "none.csv"), "variables": body["variables"]}
    failed = call("GET", f"/api/jobs/{call('POST', '/api/jobs', failing)[1]['id']}/wait")[1]
    assert failed["status"] == FAILED and "E-IO-002" in failed["error"]
    assert call("POST", "/api/jobs", {"yaml": "x"})[0] == 400 and call("GET", "/api/jobs/nope")[0] == 404
    slow = {"yaml": DOCUMENT + 'hooks: {pre: ["sleep 2"]}\n', "variables": body["variables"]}
    first, second = call("POST", "/api/jobs", slow)[1], call("POST", "/api/jobs", slow)[1]
    assert call("DELETE", f"/api/jobs/{second['id']}")[1]["status"] == CANCELLED
    assert call("GET", f"/api/jobs/{first['id']}/wait?timeout=60")[1]["status"] == COMPLETED
    assert store.jobs[second["id"]].status == CANCELLED and len(call("GET", "/api/jobs")[1]) == 4
    server.shutdown()
    store.close()


def test_quality(spark):
    df = spark.createDataFrame(
        [(1, "a", 5.0, datetime(2024, 1, 1)), (2, "b", None, datetime(2024, 1, 2)), (2, None, 7.0, None), (4, "zz", 9.0, None)],
        "id int, s string, v double, at timestamp_ntz",
    )
    ref = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    checks = [
        ({"type": "completeness", "column": "v", "threshold": 0.7}, True, 0.75),
        ({"type": "completeness", "column": "v", "threshold": 0.9, "severity": "warning"}, False, 0.75),
        ({"type": "uniqueness", "columns": ["id"], "threshold": 1}, False, 0.75),
        ({"type": "uniqueness", "columns": ["id", "s"]}, True, 1.0),
        ({"type": "volume", "between": [1, 4]}, True, 4.0),
        ({"type": "validity", "column": "s", "accepted_values": ["a", "b"], "threshold": 0.6}, False, 0.5),
        ({"type": "validity", "column": "v", "range": {"min": 5, "strict_min": True}, "threshold": 0.5}, True, 0.5),
        ({"type": "validity", "column": "s", "pattern": "_", "threshold": 0.5}, True, 0.5),
        ({"type": "validity", "column": "s"}, True, 1.0),
        ({"type": "schema", "required": ["id", "nope"]}, False, None),
        ({"type": "statistical", "column": "v", "mean": {"between": [7, 7]}, "max": {"max": 8}}, False, 7.0),
        ({"type": "freshness", "column": "at", "max_age": "2d"}, True, None),
        ({"type": "freshness", "column": "at", "max_age": "1h"}, False, None),
        ({"type": "referential", "column": "id", "reference": "ref", "ref_column": "id", "threshold": 0.75}, True, 0.75),
        ({"type": "crossColumn", "condition": "v > id"}, False, 0.75),
        ({"type": "custom", "expression": "id > 0"}, True, 1.0),
        ({"type": "custom", "expression": "nope > 0"}, False, None),
        ({"type": "mystery"}, False, None),
    ]
    frames = {"t": df, "ref": ref, "none": df.limit(0)}
    report = run_suites([{"suite": "s", "target": "t", "checks": [c for c, _, _ in checks]}], frames, datetime(2024, 1, 3))
    for r, (c, passed, metric) in zip(report.results, checks, strict=True):
        assert r.passed is passed, (c, r)
        assert metric is None or abs(r.metric - metric) < 1e-9, (c, r)
    assert report.has_errors and report.results[1].severity == "warning"
    empty = run_suites(
        [
            {"target": "none", "checks": [{"type": "completeness", "column": "v"}]},
            {"target": "t", "filter": "id = 4", "checks": [{"type": "volume", "max": 1}]},
        ],
        frames,
    )
    assert [r.passed for r in empty.results] == [True, True] and not empty.has_errors
    soft = {"target": "t", "escalate": 1, "checks": [{"type": "completeness", "column": "v", "severity": "warning"}]}
    assert run_suites([soft], frames).has_errors
    assert not run_suites([{"target": "gone", "checks": [{"type": "volume"}]}], frames).results[0].passed


def test_streams(spark, tmp_path):
    rows = [
        (1, datetime(2024, 1, 1, 0, 0), 1.0),
        (1, datetime(2024, 1, 1, 0, 4), 2.0),
        (2, datetime(2024, 1, 1, 0, 7), -1.0),
        (1, datetime(2024, 1, 1, 0, 9), 4.0),
        (9, datetime(2024, 1, 2), 0.5),
    ]
    spark.createDataFrame(rows, "k int, at timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    names = spark.createDataFrame([(1, "one"), (2, "two"), (9, "nine")], "key int, name string")
    stream = read_stream(spark, "parquet", "k int, at timestamp, v double", str(tmp_path / "in"))
    steps = [
        ("where", {"from": "stream", "filter": "v > 0"}),
        ("join", {"left": "stream", "right": [{"name": "names", "on": ["stream.k = names.key"]}]}),
    ]
    out = windowed(plan_stream(steps, stream, names=names), "at", ["sum(v) AS total"], "5 minutes", by=["name"], late="1 minute")
    write_stream(out, "parquet", str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination(90)
    got = {(r.name, r.window_start.minute, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.name != "nine"}
    assert got == {("one", 0, 3.0), ("one", 5, 4.0)}
    first = deduplicated(read_stream(spark, "parquet", "k int, at timestamp, v double", str(tmp_path / "in")), ["k"], "at", "1 day")
    write_stream(first, "parquet", str(tmp_path / "cp2"), str(tmp_path / "out2")).awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 3
    with pytest.raises(PipelineError, match="keeps rows back"):
        plan_stream([("tail", {"from": "stream", "count": 1})], stream)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
