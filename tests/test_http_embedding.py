import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from chunkspark.config import EmbeddingConfig
from chunkspark.operators import embed as E


class Server(ThreadingHTTPServer):
    """Vectors of a text's length and mode; `faults` are answered first."""

    daemon_threads = True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.requests, self.faults, self.shape, self.keys = [], [], "data", []

    @property
    def config(self):
        return EmbeddingConfig("http", "m", 2, url=f"http://127.0.0.1:{self.server_port}/embed", batch_texts=3, batch_characters=50, tries=3, timeout=5)


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.keys.append(self.headers.get("Authorization"))
        fault = self.server.faults.pop(0) if self.server.faults else None
        if fault:
            self.send_response(fault)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        self.server.requests.append(asked["input"])
        vectors = [[float(len(t)), float(asked["input_type"] == "query")] for t in asked["input"]]
        rows = [{"index": i, "embedding": v} for i, v in enumerate(vectors)][::-1]
        body = json.dumps({"data": rows} if self.server.shape == "data" else {"embeddings": vectors}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = Server()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def test_batches_by_texts_and_characters_each_text_once(server):
    texts = ["a", "bb", "a", "", "dddd", "x" * 60, "ee"]
    assert E.embed_texts(texts, server.config) == [[float(len(t)), 0.0] for t in texts]
    assert server.requests == [["a", "bb", ""], ["dddd"], ["x" * 60], ["ee"]]
    server.shape = "embeddings"
    assert E.embed_texts("abc", server.config, "query") == [3.0, 1.0]


def test_what_may_pass_is_tried_again(server, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "s3")
    config = server.config
    config.key_variable = "SOME_KEY"
    server.faults = [429, 503]
    assert E.embed_texts("abc", config) == [3.0, 0.0] and server.keys == ["Bearer s3"] * 3
    server.faults = [503, 503, 503]
    with pytest.raises(RuntimeError, match="answered 503"):
        E.embed_texts("abc", config)
    server.faults = [400]
    with pytest.raises(RuntimeError, match="answered 400"):
        E.embed_texts("abc", config)
    assert server.faults == []


def test_wrong_answers_and_settings(server):
    config = server.config
    config.dimension = 3
    with pytest.raises(RuntimeError, match="gave 1 vectors"):
        E.embed_texts("abc", config)
    with pytest.raises(RuntimeError, match="needs a url"):
        E.embed_texts("abc", EmbeddingConfig("http"))


def test_in_tasks(spark, server):
    rows = spark.createDataFrame([(i, "x" * (i % 5) if i % 7 else None) for i in range(60)], "id long, t string").repartition(3)
    got = {r.id: r.v for r in rows.select("id", E.embedding(F.col("t"), server.config).alias("v")).collect()}
    assert got == {i: [float(i % 5 if i % 7 else 0), 0.0] for i in range(60)}
    assert sum(map(len, server.requests)) <= 15 and max(map(len, server.requests)) <= 3
