"""The index for tools and for browsers: JSON-RPC over standard input, and HTTP."""

from __future__ import annotations

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from chunkspark.config import ChatConfig
from chunkspark.operators.chat import FAILED, NO_CONTEXT, STEPS, answer, model_of
from chunkspark.plans.index import Index
from chunkspark.plans.processors import Processor
from chunkspark.plans.retrieve import prompts, search_tool
from chunkspark.streaming.jobs import event_text

TOOL = {
    "name": "search_code",
    "description": "The chunks of the index that are nearest to a question, as JSON.",
    "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "top_k": {"type": "integer", "minimum": 1}}, "required": ["query"]},
}


class Service:
    """Searches and answers over the domains of an index."""

    def __init__(self, index: Index, chat: ChatConfig | None = None, processors: list[Processor] | None = None):
        self.index, self.chat, self.processors = index, chat or ChatConfig(), processors or []
        self._parsing = threading.Lock()
        #: The outcome of each domain's last run: status, and error if it failed.
        self.parsed: dict[str, dict] = {}

    def stores(self) -> dict:
        return {d: self.index.search_store(d) for d in self.index.domain_ids()}

    def search(self, query: str, k: int = 10) -> list[str]:
        stores = self.stores()
        return search_tool(stores, query, k, self.index.config) if stores else []

    def ask(self, question: str):
        """Status rows of a question as they come; the last one has the answer and its context."""
        row = {"qid": 0, "question": question}
        try:
            yield row | {"status": STEPS[0]}
            yield row | {"status": STEPS[1]}
            stores = self.stores()
            asked = self.index.spark.createDataFrame([(0, question)], "qid long, question string")
            if not stores:
                yield row | {"status": STEPS[-1], "answer": NO_CONTEXT, "retrieved_context": []}
                return
            prompted = prompts(asked, stores, config=self.index.config)
            yield row | {"status": STEPS[2]}
            found = answer(prompted, model_of(self.chat.model)).first()
            yield row | {"status": "ERROR" if found["failed"] else STEPS[-1], "answer": found["answer"], "retrieved_context": found["retrieved_context"]}
        except Exception as e:  # what a client gets instead of a broken stream  # noqa: BLE001
            yield row | {"status": "ERROR", "answer": FAILED, "error": str(e), "retrieved_context": []}

    def parse(self) -> threading.Thread:
        """Bring all domains up to date in the background, one run after another; `parsed` has what became of each."""
        def work() -> None:
            with self._parsing:
                for p in self.processors:
                    name = p.domain.id
                    self.parsed[name] = {"status": "running"}
                    try:
                        self.index.run(p)
                        self.parsed[name] = {"status": "done"}
                    except Exception as e:  # a domain that fails doesn't keep the others  # noqa: BLE001
                        self.parsed[name] = {"status": "failed", "error": str(e)}

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        return thread


def handle(service: Service, message: dict) -> dict | None:
    """The reply to one JSON-RPC message of a tool client; None for notifications."""
    if "id" not in message:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": message["id"]}
    method, given = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "chunkspark", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [TOOL]}}
    if method == "tools/call":
        if given.get("name") != TOOL["name"]:
            return reply | {"error": {"code": -32602, "message": f"no tool {given.get('name')!r}"}}
        try:
            said = given.get("arguments") or {}
            found = service.search(said["query"], int(said.get("top_k", 10)))
        except Exception as e:  # noqa: BLE001
            return reply | {"result": {"isError": True, "content": [{"type": "text", "text": str(e)}]}}
        return reply | {"result": {"content": [{"type": "text", "text": x} for x in found]}}
    return reply | {"error": {"code": -32601, "message": f"no method {method!r}"}}


def serve_tools(service: Service, source=None, sink=None) -> None:
    """Answer messages, one a line, until the input ends."""
    source, sink = source or sys.stdin, sink or sys.stdout
    for line in source:
        if not line.strip():
            continue
        try:
            reply = handle(service, json.loads(line))
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            print(json.dumps(reply), file=sink, flush=True)


def http_server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """GET /health, /search?query=, /chat?question= (server-sent events), /parse (outcomes); POST /parse. The caller starts and ends it."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def reply(self, status: int, body: object) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            url = urlparse(self.path)
            given = {k: v[0] for k, v in parse_qs(url.query).items()}
            if url.path == "/health":
                self.reply(200, {"status": "ok"})
            elif url.path == "/parse":
                self.reply(200, dict(service.parsed))
            elif url.path == "/search" and given.get("query"):
                self.reply(200, [json.loads(x) for x in service.search(given["query"], int(given.get("top_k", 10)))])
            elif url.path == "/chat" and given.get("question"):
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                for row in service.ask(given["question"]):
                    self.wfile.write(event_text(row).encode())
                    self.wfile.flush()
            else:
                self.reply(404 if url.path not in ("/search", "/chat") else 400, {"error": "not found" if url.path not in ("/search", "/chat") else "nothing asked"})

        def do_POST(self) -> None:  # noqa: N802
            if self.path == "/parse":
                service.parse()
                self.reply(202, {"status": "started"})
            else:
                self.reply(404, {"error": "not found"})

    return ThreadingHTTPServer((host, port), Handler)
