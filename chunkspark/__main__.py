"""Command line: index domains, ask, and serve."""

from __future__ import annotations

import argparse
import sys

from chunkspark.config import ChatConfig, DomainConfig, EmbeddingConfig, LoggingConfig, settings


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chunkspark", description="Index source files and documents, and search them.")
    top.add_argument("--state", default="./state", help="folder of the index")
    top.add_argument("--domains", help="folder of domain files (*.yaml)")
    top.add_argument("--chat", help="YAML file of chat settings")
    top.add_argument("--dimension", type=int, default=EmbeddingConfig.dimension, help="dimension of embeddings")
    top.add_argument("--verbose", "-v", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="bring the index up to date")
    parse.add_argument("path", nargs="?", help="a folder, instead of the domain files")
    parse.add_argument("--output", choices=("table", "json"), default="table")
    ask = commands.add_parser("ask", help="answer a question")
    ask.add_argument("question")
    find = commands.add_parser("search", help="nearest chunks as JSON")
    find.add_argument("query")
    find.add_argument("--top-k", type=int, default=10)
    serve = commands.add_parser("serve", help="serve the index")
    serve.add_argument("how", choices=("tools", "http"))
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=7773)
    return top


def main(given: list[str] | None = None, out=None) -> int:
    from pyspark.sql import SparkSession

    from chunkspark.functions.display import shown
    from chunkspark.plans.index import Index
    from chunkspark.plans.processors import create_processor
    from chunkspark.serve import Service, http_server, serve_tools
    from chunkspark.sources.domains import discover_domains, load_plugins

    out = out or sys.stdout
    a = arguments().parse_args(given)
    LoggingConfig(level="DEBUG" if a.verbose else "WARNING").apply()
    for name in load_plugins():
        print(f"plugin {name} failed", file=sys.stderr)
    spark = SparkSession.builder.appName("chunkspark").getOrCreate()
    config = EmbeddingConfig(dimension=a.dimension)
    index = Index(spark, a.state, config)
    domains = discover_domains(a.domains) if a.domains else {}
    if a.command == "parse" and a.path:
        domains = {a.path: DomainConfig(a.path, a.path, "codebase", meta={"directory_path": a.path})}
    processors = [create_processor(d, config) for d in domains.values()]
    service = Service(index, settings(ChatConfig, a.chat), processors)
    if a.command == "parse":
        if not processors:
            print("nothing to parse: give a path or --domains", file=sys.stderr)
            return 2
        rows = [(p.domain.id, c.found, c.dirty, c.deleted, c.chunks) for p in processors for c in [index.run(p)]]
        print(shown(spark.createDataFrame(rows, "domain string, found long, dirty long, deleted long, chunks long"), a.output), file=out)
    elif a.command == "search":
        for line in service.search(a.query, a.top_k):
            print(line, file=out)
    elif a.command == "ask":
        for row in service.ask(a.question):
            print(row["answer"] if "answer" in row else f"{row['status'].lower()} ...", file=out)
    elif a.how == "tools":
        serve_tools(service)
    else:
        with http_server(service, a.host, a.port) as server:
            server.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
