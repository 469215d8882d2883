"""YAML documents to pipelines.

Form A has ``input``, ``transformation`` and ``output`` lists; an output's name is the asset that it writes. Form B has one list
``assets`` of ``{asset_ref, source: {operator: parameters}}``. ``${NAME}`` and ``${NAME:default}`` are replaced in the text.
"""

from __future__ import annotations

import re
from typing import Any

import yaml

from ..errors import BAD_PARAMETER, DUPLICATE_ASSET, UNKNOWN_ASSET, PipelineError
from ..operators.columns import split_filters
from ..operators.registry import checked
from .model import Asset, Pipeline

VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")
#: Written inside documents for other ends: the key of an enrichment's url.
RESERVED = ("keyColumn",)
#: Other spellings of operators.
SYNONYMS = {
    "groupBy": "group",
    "group_by": "group",
    "filter": "where",
    "order": "orderBy",
    "asofJoin": "asOfJoin",
    "dropNulls": "dropNa",
    "sort": "orderBy",
}
#: Mappings whose keys are data, not parameter names.
VERBATIM = ("options", "mappings", "values", "headers", "set", "metadata")


class Loader(yaml.SafeLoader):
    """YAML with only true and false as booleans: ``on`` is the key of a join's conditions."""


Loader.yaml_implicit_resolvers = {k: [(tag, r) for tag, r in v if tag != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def substituted(text: str, variables: dict[str, str]) -> str:
    def value(m: re.Match) -> str:
        if m[1] in variables:
            return str(variables[m[1]])
        if m[2] is not None:
            return m[2]
        if m[1] in RESERVED:
            return m[0]
        raise PipelineError(BAD_PARAMETER, f"variable {m[1]} has no value")

    return VARIABLE.sub(value, text)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


def normal(value: Any) -> Any:
    """Parameter names in one spelling."""
    if isinstance(value, dict):
        return {snake(str(k)): v if snake(str(k)) in VERBATIM and isinstance(v, dict) else normal(v) for k, v in value.items()}
    return [normal(v) for v in value] if isinstance(value, list) else value


def listed(document: dict, *names: str) -> list:
    for n in names:
        if document.get(n) is not None:
            if not isinstance(document[n], list):
                raise PipelineError(BAD_PARAMETER, f'"{n}" is no list')
            return document[n]
    return []


def entries(document: dict) -> list[tuple[str, str, dict]]:
    """(name, kind, parameters) in the document's order."""
    out = []
    for x in listed(document, "input", "inputs"):
        out.append((x.get("name"), "input", {k: v for k, v in normal(x).items() if k != "name"}))
    for x in listed(document, "transformation", "transformations"):
        kinds = [k for k in x if k not in ("name", "metadata")]
        if len(kinds) != 1:
            raise PipelineError(BAD_PARAMETER, f"transformation {x.get('name')}: one operator is expected, not {len(kinds)}")
        out.append((x.get("name"), kinds[0], normal(x[kinds[0]]) or {}))
    for x in listed(document, "output", "outputs"):
        out.append(
            (
                None,
                "output",
                {"from": x.get("from", x.get("name")), **{k: v for k, v in normal(x).items() if k not in ("name", "from")}},
            )
        )
    for x in listed(document, "assets"):
        source = x.get("source") or {}
        if len(source) != 1:
            raise PipelineError(BAD_PARAMETER, f"asset {x.get('asset_ref')}: one source is expected")
        kind, parameters = next(iter(source.items()))
        out.append((None if kind == "output" else x.get("asset_ref"), kind, normal(parameters) or {}))
    return out


def parse(text: str, variables: dict[str, str] | None = None) -> Pipeline:
    """The validated pipeline of a document."""
    try:
        document = yaml.load(substituted(text, variables or {}), Loader)
    except yaml.YAMLError as e:
        raise PipelineError(BAD_PARAMETER, f"not YAML: {e}") from e
    if not isinstance(document, dict):
        raise PipelineError(BAD_PARAMETER, "the document is no mapping")
    assets: dict[str, Asset] = {}

    def add(name: str, kind: str, parameters: dict, depends: list[str]) -> None:
        if not name or not isinstance(name, str):
            raise PipelineError(BAD_PARAMETER, f"{kind}: an asset has no name")
        if name in assets:
            raise PipelineError(DUPLICATE_ASSET, f'asset "{name}" occurs twice')
        assets[name] = Asset(name, kind, parameters, tuple(dict.fromkeys(depends)))

    outputs = 0
    for name, kind, parameters in entries(document):
        kind = SYNONYMS.get(kind, kind)
        if not isinstance(parameters, dict):
            raise PipelineError(BAD_PARAMETER, f"{name}: parameters are no mapping")
        if kind == "input":
            need(name, parameters, "format", "path")
            add(name, kind, parameters, [])
        elif kind == "output":
            need(f"output {outputs}", parameters, "from", "format", "path")
            add(f"output:{outputs}:{parameters['from']}", kind, parameters, [parameters["from"]])
            outputs += 1
        elif kind == "split":
            checked(kind, parameters)
            for side, sql in zip(("pass", "fail"), split_filters(parameters["condition"]), strict=True):
                add(parameters.get(side) or f"{name}_{side}", "where", {"from": parameters["from"], "filter": sql}, [parameters["from"]])
        else:
            add(name, kind, parameters, checked(kind, parameters).sources(parameters))
    for a in assets.values():
        for d in a.depends:
            if d not in assets:
                raise PipelineError(UNKNOWN_ASSET, f'asset "{a.name}" references unknown asset "{d}"')
    about = document.get("pipeline") or {}
    hooks = {snake(k): [h if isinstance(h, str) else h.get("command") or h.get("run") for h in v] for k, v in (document.get("hooks") or {}).items()}
    pipeline = Pipeline(
        assets,
        hooks,
        normal(listed(document, "quality")),
        str(about.get("name") or ""),
        str(document.get("version") or ""),
    )
    from .dag import waves

    waves(pipeline)
    return pipeline


def need(name: str, parameters: dict, *names: str) -> None:
    for n in names:
        if not parameters.get(n):
            raise PipelineError(BAD_PARAMETER, f'{name}: "{n}" is missing')
