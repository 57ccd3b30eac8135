"""Readers of API descriptions, compose files and workflow files: one parsed record a file."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath
from typing import Any

import yaml

#: Names of API descriptions, their methods, names of compose files.
OPENAPI_NAMES = {"openapi.yaml", "openapi.yml", "openapi.json", "swagger.yaml", "swagger.yml", "swagger.json", "api.yaml", "api.yml", "api.json"}
OPENAPI_METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
COMPOSE_NAME = re.compile(r"^docker-compose(\.[a-z0-9_-]+)?\.(ya?ml)$", re.IGNORECASE)


def record(path: str, language: str, **fields: Any) -> dict:
    return {"file": path, "language": language, "symbols": [], "classes": [], "infra": [], "dags": [], "errors": []} | fields


def basename(path: str) -> str:
    return PurePosixPath(path).name


def is_openapi(path: str) -> bool:
    return basename(path).lower() in OPENAPI_NAMES


def is_compose(path: str) -> bool:
    return bool(COMPOSE_NAME.match(basename(path)))


def _load(path: str, source: str) -> tuple[Any, str | None]:
    try:
        return (json.loads(source) if path.endswith(".json") else yaml.safe_load(source)), None
    except (ValueError, yaml.YAMLError, RecursionError) as error:
        return None, str(error)


def _text(value: Any) -> str | None:
    if value is None:
        return None
    return str(value).lower() if isinstance(value, bool) else str(value)


def _number(value: Any) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def parse_openapi(path: str, source: str) -> dict:
    """A route for each path and method; version 2 prefixes its base path."""
    doc, error = _load(path, source)
    if error is not None:
        return record(path, "yaml", errors=[f"OpenAPI parse error: {error}"])
    if not isinstance(doc, dict):
        return record(path, "yaml", errors=["OpenAPI file has no root object."])
    if not doc.get("openapi") and not doc.get("swagger"):
        return record(path, "yaml", errors=["Not an OpenAPI/Swagger document (missing 'openapi' or 'swagger' key)."])
    paths = doc.get("paths")
    infra: list[dict] = []
    for route, item in paths.items() if isinstance(paths, dict) else ():
        full = f"{doc.get('basePath') or ''}{route}"
        for method in OPENAPI_METHODS:
            operation = item.get(method) if isinstance(item, dict) else None
            if not isinstance(operation, dict):
                continue
            name, tags = operation.get("operationId"), operation.get("tags")
            metadata = {"method": method.upper(), "source": "openapi_spec"}
            metadata |= {"operationId": str(name)} if name else {}
            metadata |= {"summary": str(operation["summary"])} if operation.get("summary") else {}
            metadata |= {"tags": ",".join(map(str, tags))} if tags else {}
            infra.append({"kind": "http_route_define", "target": full, "detail": f"OpenAPI: {method.upper()} {full}" + (f" ({name})" if name else ""), "line": len(infra) + 1, "metadata": metadata})
    return record(path, "yaml", infra=infra)


def _ports(ports: Any) -> list[str]:
    found = []
    for port in ports if isinstance(ports, list) else ():
        if isinstance(port, str):
            found.append(port.split(":")[0])
        elif isinstance(port, dict):
            found.append(str(next((port[k] for k in ("published", "target") if port.get(k) is not None), "")))
    return [p for p in found if p]


def _names(value: Any) -> list[str]:
    return [str(x) for x in value] if isinstance(value, (list, dict)) else []


def parse_compose(path: str, source: str) -> dict:
    """A service pattern for each service."""
    doc, error = _load(path, source)
    if error is not None:
        return record(path, "yaml", errors=[f"Docker Compose parse error: {error}"])
    if not isinstance(doc, dict):
        return record(path, "yaml", errors=["Docker Compose file has no root object."])
    infra = []
    services = doc.get("services")
    for name, service in services.items() if isinstance(services, dict) else ():
        if isinstance(service, dict):
            image = service.get("image") or ("<local-build>" if service.get("build") else "<unknown>")
            metadata = {"image": str(image), "ports": ",".join(_ports(service.get("ports"))), "dependsOn": ",".join(_names(service.get("depends_on"))), "networks": ",".join(_names(service.get("networks"))), "source": "docker_compose"}
            infra.append({"kind": "docker_service", "target": str(name), "detail": f"Docker service: {name} ({image})", "line": 1, "metadata": metadata})
    return record(path, "yaml", infra=infra)


def parse_workflow(path: str, source: str) -> dict:
    """Each mapping at the top is a workflow, each mapping below ``tasks`` a task."""
    doc, error = _load(path, source)
    if error is not None:
        return record(path, "yaml", errors=[f"YAML parse error: {error}"])
    if not isinstance(doc, dict):
        return record(path, "yaml", errors=["YAML file has no top-level object."])
    dags = []
    for name, dag in doc.items():
        if not isinstance(dag, dict):
            continue
        defaults = dag.get("default_args") if isinstance(dag.get("default_args"), dict) else {}
        tasks = []
        for task, t in dag["tasks"].items() if isinstance(dag.get("tasks"), dict) else ():
            if isinstance(t, dict):
                needs = t.get("dependencies")
                tasks.append({
                    "name": str(task), "operator": _text(t.get("operator")) or "unknown", "callable_file": _text(t.get("python_callable_file")), "callable_name": _text(t.get("python_callable_name")),
                    "bash_command": _text(t.get("bash_command")), "sql": _text(t.get("sql")), "conn_id": _text(t.get("postgres_conn_id")), "dependencies": [str(x) for x in needs if x is not None] if isinstance(needs, list) else [],
                    "op_kwargs": json.dumps(t["op_kwargs"], default=str) if isinstance(t.get("op_kwargs"), dict) else None, "retries": _number(t.get("retries")), "timeout_secs": _number(t.get("execution_timeout_secs")),
                })
        dags.append({"name": str(name), "schedule": _text(dag.get("schedule_interval")), "description": _text(dag.get("description")), "owner": _text(defaults.get("owner")), "concurrency": _number(dag.get("concurrency")), "tasks": tasks})
    return record(path, "yaml", dags=dags)
