"""Read-only JSON-RPC over lines: every named operation is a tool; nothing can be written, fetched or run."""

from __future__ import annotations

import json
from typing import TextIO

from cairngraph import api
from cairngraph.plans import ops
from cairngraph.plans.store import Store

PROTOCOL = "2024-11-05"
MOST_ROWS = 100


def tools(registry: ops.Registry | None = None) -> list[dict]:
    names = [*api.OPERATIONS, *(api.REGISTRY_OPERATIONS if registry else ())]
    return [{"name": n.replace("-", "_"), "description": f"{n.replace('-', ' ')} of the stored graph", "inputSchema": api.schema(n)} for n in names]


def answer(store: Store, request: dict, registry: ops.Registry | None = None) -> dict | None:
    """The response to a request; None for a notification. With a registry, the tools over configured graphs answer too."""
    if request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
        return _error(request.get("id"), -32600, "invalid request")
    method, params, id_ = request["method"], request.get("params") or {}, request.get("id")
    if "id" not in request:
        return None
    if method == "initialize":
        return _result(id_, {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "cairngraph", "version": "1"}})
    if method == "ping":
        return _result(id_, {})
    if method == "tools/list":
        return _result(id_, {"tools": tools(registry)})
    if method != "tools/call":
        return _error(id_, -32601, "unknown method")
    name, given = str(params.get("name", "")).replace("_", "-"), params.get("arguments") or {}
    if name in api.OPERATIONS:
        run = lambda: api.OPERATIONS[name](store, given)
    elif registry is not None and name in api.REGISTRY_OPERATIONS:
        run = lambda: api.REGISTRY_OPERATIONS[name](store, registry, given)
    else:
        return _error(id_, -32602, "unknown tool")
    known = api.schema(name)
    if (odd := sorted(set(given) - set(known["properties"]))) or (odd := sorted(set(known["required"]) - set(given))):
        return _error(id_, -32602, f"unknown or missing arguments: {', '.join(odd)}")
    try:
        limit = min(MOST_ROWS, int(given.get("limit", MOST_ROWS)))
        rows = api.records(run(), limit + 1)
        body = {"rows": api.sanitized(rows[:limit]), "has_more": len(rows) > limit}
    except (ValueError, KeyError) as e:
        return _result(id_, {"isError": True, "content": [{"type": "text", "text": api.truncated(str(e))}]})
    return _result(id_, {"content": [{"type": "text", "text": json.dumps(body, sort_keys=True)}]})


def _result(id_: object, result: object) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "result": result}


def _error(id_: object, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}


def serve(store: Store, lines: TextIO, out: TextIO, registry: ops.Registry | None = None) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            done = _error(None, -32700, "parse error")
        else:
            done = answer(store, request, registry) if isinstance(request, dict) else _error(None, -32600, "invalid request")
        if done is not None:
            out.write(json.dumps(done, sort_keys=True) + "\n")
            out.flush()
