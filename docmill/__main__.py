"""``python -m docmill``: crawl a table of pages, search, list, manage, or serve requests as JSON lines."""

from __future__ import annotations

import argparse
import inspect
import json
import sys
import threading
from pathlib import Path

from pyspark.sql import SparkSession

from docmill import __version__
from docmill.api import DocTools, InvalidParams
from docmill.sources.project import project_info


TOOLS = ("search_docs", "list_docs", "crawl_docs", "reload_docs", "manage_docs")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docmill", description=__doc__)
    p.add_argument("--data", default=str(Path.home() / ".docmill"), help="folder of the global store")
    p.add_argument("--verbose", action="store_true", help="report progress on standard error")
    p.add_argument("--timeout", type=float, help="seconds after which a command is given up (exit code 3)")
    p.add_argument("--pages", help="Parquet table (url, html) to crawl over")
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("crawl")
    c.add_argument("url")
    c.add_argument("--mode", default="single")
    c.add_argument("--focus", default="all")
    c.add_argument("--max-pages", type=int, default=100)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=5)
    s.add_argument("--source-filter")
    s.add_argument("--content-type")
    ls = sub.add_parser("list")
    ls.add_argument("--limit", type=int, default=1000)
    ls.add_argument("--after")
    sub.add_parser("tools", help="names, descriptions and arguments of the tools")
    m = sub.add_parser("manage")
    m.add_argument("operation")
    m.add_argument("target", nargs="?")
    m.add_argument("--max-age-days", type=int)
    m.add_argument("--dry-run", action="store_true")
    sub.add_parser("serve")
    return p


def described() -> list[dict]:
    """Name, description and arguments (with their defaults) of each tool."""
    out = []
    for name in TOOLS:
        f = getattr(DocTools, name)
        arguments = {k: None if v.default is inspect.Parameter.empty else v.default for k, v in inspect.signature(f).parameters.items() if k != "self"}
        required = [k for k, v in inspect.signature(f).parameters.items() if k != "self" and v.default is inspect.Parameter.empty]
        out.append({"name": name, "description": inspect.getdoc(f) or "", "arguments": arguments, "required": required})
    return out


def answer(tools: DocTools, line: str) -> dict:
    """The reply to a request {tool, arguments}; the tool ``info`` tells of the server and its tools."""
    try:
        call = json.loads(line)
        if call.get("tool") == "info":
            return {"result": {"name": "docmill", "version": __version__, "tools": described()}}
        tool = getattr(tools, call["tool"]) if call.get("tool") in TOOLS else None
        if tool is None:
            return {"error": {"code": -32601, "message": f"no tool {call.get('tool')!r}"}}
        return {"result": tool(**call.get("arguments", {}))}
    except (InvalidParams, TypeError, json.JSONDecodeError) as e:
        return {"error": {"code": -32602, "message": str(e)}}


def within(seconds: float | None, call, spark: SparkSession):
    """The result of ``call``; after ``seconds`` its jobs are cancelled and a TimeoutError comes."""
    if seconds is None:
        return call()
    box: list = []

    def run() -> None:
        try:
            box.append((True, call()))
        except BaseException as e:  # handed on to the caller
            box.append((False, e))

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if not box:
        spark.sparkContext.cancelAllJobs()
        raise TimeoutError(f"given up after {seconds} seconds")
    fine, value = box[0]
    if not fine:
        raise value
    return value


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "tools":
        print(json.dumps(described(), indent=2))
        return 0
    spark = SparkSession.builder.appName("docmill").getOrCreate()
    project = project_info(Path.cwd(), Path(a.data))
    tools = DocTools(spark, str(project.database_path), pages=spark.read.parquet(a.pages) if a.pages else None, project=project)
    if a.verbose:
        tools.on_progress = lambda p: print(f"{p.crawled} pages, {p.queued} waiting, {p.failed} failed, last {p.current_url}", file=sys.stderr, flush=True)
    if a.command in (None, "serve"):
        for line in sys.stdin:
            print(json.dumps(answer(tools, line), default=str), flush=True)
        return 0
    calls = {
        "crawl": lambda: tools.crawl_docs(a.url, a.mode, a.focus, a.max_pages),
        "search": lambda: tools.search_docs(a.query, a.limit, a.source_filter, a.content_type),
        "list": lambda: tools.list_docs(a.limit, a.after),
        "manage": lambda: tools.manage_docs(a.operation, a.target, a.max_age_days, a.dry_run),
    }
    try:
        result = within(a.timeout, calls[a.command], spark)
    except TimeoutError as e:
        print(e, file=sys.stderr)
        return 3
    print(json.dumps(result, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
