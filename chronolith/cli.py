"""Command line and a JSON-RPC loop over the facade."""

from __future__ import annotations

import argparse
import json
import sys

from . import plans

TOOLS = {
    "get_context": lambda log, a: log.context(a.get("hours", 2)),
    "get_activity": lambda log, a: plans.to_json(log.day(a["day"]) if a.get("day") else log.recent(a.get("hours", 2))),
    "get_steps": lambda log, a: json.dumps(log.steps(a["frame"], a.get("day"), a.get("hours", 3), include_text=a.get("include_text", True), max_steps=a.get("max_steps", 250)), ensure_ascii=False),
    "get_day_summary": lambda log, a: json.dumps({"coverage": log.day(a.get("day"))["coverage"], "apps": [r.asDict() for r in log.apps(a.get("day")).limit(15).collect()]}, ensure_ascii=False),
    "get_patterns": lambda log, a: json.dumps([r.asDict() for r in log.patterns(a.get("days", 7)).limit(40).collect()], ensure_ascii=False),
    "get_communications": lambda log, a: json.dumps([r.asDict(True) for r in log.communications(a.get("hours", 24), a.get("day"), [a["kind"]] if a.get("kind") else None).collect()], ensure_ascii=False),
}


def handle(log, line: str) -> dict | None:
    """The JSON-RPC 2.0 reply to one line, None for a notification."""
    try:
        request = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "invalid request"}}
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request["method"], request.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "chronolith", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "inputSchema": {"type": "object"}} for n in sorted(TOOLS)]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    if not isinstance(params, dict) or params.get("name") not in TOOLS or not isinstance(params.get("arguments", {}), dict):
        return reply | {"error": {"code": -32602, "message": "no such tool"}}
    try:
        text, failed = TOOLS[params["name"]](log, params.get("arguments", {})), False
    except Exception as e:  # a tool's failure is its answer
        text, failed = f"{type(e).__name__}: {e}", True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(log, source=None, sink=None) -> None:
    for line in source or sys.stdin:
        if line.strip() and (reply := handle(log, line)) is not None:
            print(json.dumps(reply, ensure_ascii=False), file=sink or sys.stdout, flush=True)


def main(argv: list[str] | None = None, log=None) -> int:
    p = argparse.ArgumentParser(prog="chronolith")
    p.add_argument("--source", "--db", default=".")
    p.add_argument("--debug", action="store_true", help="why each entry begins, and tracebacks")
    p.add_argument("--format", "-f", choices=["json", "yaml", "markdown", "context"], default="json")
    p.add_argument("--min-minutes", type=float, default=0.5)
    p.add_argument("--tz", default="UTC")
    p.add_argument("--layout", choices=["azerty"])
    sub = p.add_subparsers(dest="command")
    sub.add_parser("today")
    sub.add_parser("day").add_argument("date")
    c = sub.add_parser("context")
    c.add_argument("--hours", type=float, default=2)
    c.add_argument("--max-frames", type=int, default=40)
    sub.add_parser("apps").add_argument("date", nargs="?")
    c = sub.add_parser("patterns")
    c.add_argument("--days", type=int, default=7)
    c.add_argument("--include-text", action="store_true")
    c = sub.add_parser("comms")
    c.add_argument("--hours", type=float, default=24)
    c.add_argument("--day")
    c.add_argument("--kind", action="append")
    c = sub.add_parser("steps")
    c.add_argument("--frame")
    c.add_argument("--find")
    c.add_argument("--hours", type=float, default=3)
    c.add_argument("--day")
    c.add_argument("--no-text", action="store_true")
    c.add_argument("--max-steps", type=int, default=250)
    sub.add_parser("mcp")
    a = p.parse_args(argv)
    if not a.command:
        p.print_help()
        return 1
    if log is None:
        from pyspark.sql import SparkSession

        from .api import ActivityLog

        spark = SparkSession.builder.appName("chronolith").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        log = ActivityLog(spark, a.source, layout=a.layout, min_minutes=a.min_minutes, tz=a.tz)
    show = {"json": plans.to_json, "yaml": plans.to_yaml, "markdown": plans.to_markdown, "context": plans.context_block}[a.format]
    try:
        if a.command in ("today", "day"):
            print(show(log.day(getattr(a, "date", None), debug=a.debug)))
        elif a.command == "context":
            print(log.context(a.hours, a.max_frames))
        elif a.command == "mcp":
            serve(log)
        elif a.command == "steps":
            frame = a.frame
            if a.find:
                found = log.find(a.find, a.day, a.hours, a.max_steps)
                if "error" in found:
                    print(json.dumps(found))
                    return 3
                frame = found["frame"]
            print(json.dumps(log.steps(frame, a.day, a.hours, include_text=not a.no_text, max_steps=a.max_steps), ensure_ascii=False, indent=2))
        else:
            rows = {"apps": lambda: log.apps(a.date), "patterns": lambda: log.patterns(a.days, a.include_text), "comms": lambda: log.communications(a.hours, a.day, a.kind)}[a.command]()
            for r in rows.toLocalIterator():
                print(json.dumps(r.asDict(True), ensure_ascii=False))
    except Exception as e:  # whatever fails, a line and an exit code, no traceback
        if a.debug:
            raise
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
