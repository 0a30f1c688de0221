"""Command line: python -m siltstone COMMAND --db PATH ...; answers are JSON lines."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .operators import headers, observe
from .operators.vector import HashingProvider
from .plans.engine import STRATEGIES, Engine
from .sources import activity, manifests


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siltstone")
    top.add_argument("--db", default=".siltstone/db")
    top.add_argument("--log", default=".siltstone/activity.log")
    top.add_argument("--registry", default=os.path.expanduser("~/.siltstone/corpora"))
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("index", "refresh"):
        commands.add_parser(name).add_argument("root")
    find = commands.add_parser("find")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--strategy", choices=STRATEGIES, default="routed")
    find.add_argument("--bodies", action="store_true")
    retrieve = commands.add_parser("retrieve")
    retrieve.add_argument("root")
    retrieve.add_argument("id")
    graph = commands.add_parser("graph")
    graph.add_argument("symbol")
    graph.add_argument("--direction", choices=("callers", "callees"), default="callers")
    evaluate = commands.add_parser("eval")
    evaluate.add_argument("manifest")
    evaluate.add_argument("--strategy", choices=STRATEGIES, default="routed")
    setup = commands.add_parser("setup")
    setup.add_argument("name")
    setup.add_argument("root")
    commands.add_parser("delete").add_argument("name")
    commands.add_parser("serve").add_argument("root")
    for name in ("embed", "status", "stats", "list"):
        commands.add_parser(name)
    return top


def serve(engine: Engine, a: argparse.Namespace, asked, answers) -> None:
    """Answer JSON requests (id, method, params), a line each, until the input ends; an error is an answer as well."""
    activity.served(a.log, engine.provider.model_id if engine.has_embeddings() else None, "on" if engine.has_embeddings() else "off")

    def find(query: str, limit: int = 10, strategy: str = "routed") -> list[dict]:
        rows = [r.asDict(recursive=True) for r in headers.slim(engine.find_headers(query, limit, strategy)).collect()]
        activity.found(a.log, query, len(rows), sum(len(json.dumps(r, default=str)) for r in rows) // 4, None)
        return rows

    def retrieve(ids: list[str]) -> list[dict]:
        rows = [r.asDict() for r in engine.retrieve(a.root, ids).collect()]
        for row in rows:
            activity.retrieved(a.log, row["id"], row["source_path"])
        return rows

    def find_related(symbol: str, direction: str = "callers") -> list[dict]:
        rows = [r.asDict(recursive=True) for r in engine.related(symbol, direction, headers.MAX_LIMIT).orderBy("rank").collect()]
        activity.related(a.log, symbol, direction, len(rows))
        return rows

    def list_corpora() -> list[dict]:
        activity.listed(a.log, len(known := manifests.profiles(a.registry)))
        return known

    methods = {f.__name__: f for f in (find, retrieve, find_related, list_corpora)}
    for line in asked:
        request: dict = {}
        try:
            request = json.loads(line)
            answer = {"result": methods[request["method"]](**request.get("params", {}))}
        except Exception as e:  # noqa: BLE001
            activity.failed(a.log, str(request.get("method", "serve")), json.dumps(request.get("params", {})), f"{type(e).__name__}: {e}".splitlines()[0])
            answer = {"error": f"{type(e).__name__}: {e}".splitlines()[0]}
        print(json.dumps({"id": request.get("id"), **answer}, default=str), file=answers, flush=True)


def main(arguments: list[str] | None = None) -> int:
    a = _parser().parse_args(arguments)
    show = lambda value: print(json.dumps(value, default=str))
    if a.command == "setup":
        manifests.set_profile(a.registry, a.name, a.root)
        return 0
    if a.command == "delete":
        return int(not manifests.remove_profile(a.registry, a.name))
    if a.command == "list":
        known = manifests.profiles(a.registry)
        for profile in known:
            show(profile)
        activity.listed(a.log, len(known))
        return 0

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    engine = Engine(spark, os.path.abspath(a.db) if "://" not in a.db else a.db, HashingProvider())
    if a.command in ("index", "refresh"):
        show(engine.index(a.root, force=a.command == "refresh"))
    elif a.command == "embed":
        show(engine.refresh_embeddings())
    elif a.command == "status":
        show(engine.status().first().asDict())
    elif a.command == "stats":
        show(observe.stats(observe.parsed(manifests.read_log(spark, os.path.abspath(a.log)))).first().asDict())
    elif a.command == "find":
        hits = engine.find(a.query, a.limit, a.strategy) if a.bodies else headers.slim(engine.find_headers(a.query, a.limit, a.strategy))
        rows = hits.collect()  # at most the limit
        for row in rows:
            show(row.asDict(recursive=True))
        activity.found(a.log, a.query, len(rows), sum(len(json.dumps(r.asDict(), default=str)) for r in rows) // 4, None)
    elif a.command == "retrieve":
        for row in engine.retrieve(a.root, [a.id]).collect():
            show(row.asDict())
            activity.retrieved(a.log, a.id, row["source_path"])
    elif a.command == "graph":
        rows = engine.related(a.symbol, a.direction, headers.MAX_LIMIT).orderBy("rank").collect()
        for row in rows:
            show(row.asDict(recursive=True))
        activity.related(a.log, a.symbol, a.direction, len(rows))
    elif a.command == "serve":
        serve(engine, a, sys.stdin, sys.stdout)
    else:
        cases = manifests.read_manifest(spark, os.path.abspath(a.manifest))
        limit = cases.select("limit").first()[0]
        show(engine.evaluate(cases, limit, a.strategy).first().asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
